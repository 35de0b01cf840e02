"""Nested ranges out of opening and closing marks: depth, end and parent of each, by prefix sums in two levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Marks that are summed up in one piece; a key's pieces are then summed up among themselves.
PIECE = 512
#: Tags that nothing can be inside of (fixed values).
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
TAG = r"</?[A-Za-z][^<>]*>"


def tags(pages: DataFrame) -> DataFrame:
    """(page_id, pos, name, step): the tags of html in order, 1 for those that open and -1 for those that close.

    Tags that stand alone count in pos and have no row; null pages have none.
    """
    each = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(TAG), F.lit(0))).alias("pos", "tag"))
    named = each.select("page_id", F.col("pos").cast("long").alias("pos"), "tag", F.lower(F.regexp_extract("tag", r"^</?([A-Za-z][A-Za-z0-9]*)", 1)).alias("name"))
    real = named.filter(~F.col("name").isin(*VOID) & ~F.col("tag").endswith("/>"))
    return real.select("page_id", "pos", "name", F.when(F.col("tag").startswith("</"), -1).otherwise(1).cast("long").alias("step"))


def nested(marks: DataFrame, key: str, pos: str, step: str, piece: int = PIECE) -> DataFrame:
    """The opening marks (step 1) with depth, end (the pos that closes it, null for none) and parent (the pos around it).

    Of the marks that cross one depth, those that open and close take turns, so the mark of a rank among those that open
    there is closed by that of the same rank among those that close, or the next, where a mark closed first that none
    had opened. A key's marks are dealt out in pieces of ``piece`` places, so a key with most of the rows spreads; only
    one row for each piece, or piece and depth, meets the others of its key. Positions are distinct within a key.
    """
    cut = marks.withColumn("_piece", F.floor(F.col(pos) / piece))
    inner = Window.partitionBy(key, "_piece").orderBy(pos)
    before = lambda *by: Window.partitionBy(key, *by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(key, "_piece").agg(F.sum(step).alias("_sum"))
    sums = sums.select(key, "_piece", F.coalesce(F.sum("_sum").over(before()), F.lit(0)).alias("_before"))
    after = F.col("_before") + F.sum(step).over(inner.rowsBetween(Window.unboundedPreceding, 0))
    level = after + F.when(F.col(step) < 0, 1).otherwise(0)
    deep = cut.join(sums, [key, "_piece"]).withColumn("depth", level).drop("_before")

    at = Window.partitionBy(key, "depth", "_piece", step).orderBy(pos)
    counts = deep.groupBy(key, "depth", step, "_piece").agg(F.count("*").alias("_n"), F.min(pos).alias("_first"))
    starts = counts.select(key, "depth", step, "_piece", F.coalesce(F.sum("_n").over(before("depth", step)), F.lit(0)).alias("_start"))
    placed = deep.withColumn("_rank", F.row_number().over(at)).join(starts, [key, "depth", step, "_piece"]).withColumn("_rank", F.col("_start") + F.col("_rank")).drop("_start")
    first = lambda s: F.min(F.when(F.col(step) == s, F.col("_first")))
    shifts = counts.groupBy(key, "depth").agg(F.when(first(-1) < first(1), 1).otherwise(0).alias("_shift"))
    opens, closes = placed.filter(F.col(step) > 0), placed.filter(F.col(step) < 0)
    ends = closes.join(shifts, [key, "depth"]).select(key, "depth", (F.col("_rank") - F.col("_shift")).alias("_rank"), F.col(pos).alias("end"))
    ended = opens.join(ends, [key, "depth", "_rank"], "left").drop("_rank")

    # A parent is the last mark before that opened one depth above: in the same piece, or in the last one that has any.
    roles = ended.select(key, "_piece", F.col("depth").alias("_depth"), pos, F.col(pos).alias("_as_parent"), F.lit(False).alias("_child"))
    roles = roles.unionByName(ended.select(key, "_piece", (F.col("depth") - 1).alias("_depth"), pos, F.lit(None).cast("long").alias("_as_parent"), F.lit(True).alias("_child")))
    near = F.last("_as_parent", True).over(Window.partitionBy(key, "_piece", "_depth").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1))
    near = roles.withColumn("_near", near).filter("_child").select(key, pos, "_depth", "_piece", "_near")
    far = roles.groupBy(key, "_depth", "_piece").agg(F.max("_as_parent").alias("_last"))
    far = far.select(key, "_depth", "_piece", F.last("_last", True).over(before("_depth")).alias("_far"))
    parents = near.join(far, [key, "_depth", "_piece"]).select(key, pos, F.coalesce("_near", "_far").alias("parent"))
    return ended.drop("_piece").join(parents, [key, pos])
