"""The edge table: resolution of targets, neighbours of a symbol, and the graph view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.text import glob_to_like
from quarry.operators.joins import split_join
from quarry.operators.ranges import containing


def first_symbol(symbols: DataFrame) -> DataFrame:
    """The symbol that a qualname stands for: its first by file, line and id."""
    key = F.struct("file", "line_start", "id")
    rest = [c for c in symbols.columns if c != "qualname"]
    return symbols.groupBy("qualname").agg(F.min_by(F.struct(*rest), key).alias("s")).select("qualname", *[F.col(f"s.{c}") for c in rest])


def resolve_exact(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """edges with ``resolved`` set where the target is a known qualname."""
    known = symbols.select(F.col("qualname").alias("to_qualname")).distinct().withColumn("known", F.lit(True))
    out = split_join(edges.drop("resolved"), known, "to_qualname", True).withColumn("resolved", F.coalesce("known", F.lit(False)))
    return out.select(*edges.columns, *([] if "resolved" in edges.columns else ["resolved"]))


def short_target(source: Column, target: Column) -> Column:
    """A bare target within the scope of the source: all up to its last dot, then the target; else null."""
    bare = ~target.contains(".") & (target != "")
    return F.when(bare & source.contains("."), F.concat(F.regexp_extract(source, r"^(.*\.)[^.]*$", 1), target))


def resolve(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Both passes: exact targets, then bare ones within the source's scope, which are rewritten."""
    known = symbols.select("qualname").distinct()
    exact = known.select(F.col("qualname").alias("to_qualname"), F.lit(True).alias("exact"))
    near = known.select(F.col("qualname").alias("candidate"), F.lit(True).alias("near"))
    tried = split_join(edges, exact, "to_qualname", True).withColumn("candidate", F.when(F.col("exact").isNull(), short_target(F.col("from_qualname"), F.col("to_qualname"))))
    out = split_join(tried, near, "candidate", True)
    return out.select(
        "from_qualname",
        F.when(F.col("near"), F.col("candidate")).otherwise(F.col("to_qualname")).alias("to_qualname"),
        "kind",
        (F.coalesce("exact", F.lit(False)) | F.coalesce("near", F.lit(False))).alias("resolved"),
    )


def with_ends(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """edges with ``from`` and ``to``, each the qualname, file and lines of the first symbol of that end.

    An end without a symbol has an empty file and lines 0.
    """
    ends, out = first_symbol(symbols).select("qualname", "file", "line_start", "line_end"), edges
    for end in ("from", "to"):
        name = f"{end}_qualname"
        own = ends.select(F.col("qualname").alias(name), F.struct("file", "line_start", "line_end").alias("e"))
        lines = [F.coalesce(F.col(f"e.{c}"), F.lit(0)).alias(c) for c in ("line_start", "line_end")]
        view = F.struct(F.col(name).alias("qualname"), F.coalesce("e.file", F.lit("")).alias("file"), *lines)
        out = split_join(out, own, name, True).withColumn(end, view).drop("e")
    return out


def edge_json(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """One JSON view for each edge: both ends, kind and whether it is resolved."""
    return with_ends(edges, symbols).select(F.to_json(F.struct("from", "to", "kind", "resolved")).alias("view"))


def neighbours_of(edges: DataFrame, symbols: DataFrame, targets: DataFrame, incoming: bool) -> DataFrame:
    """Edges into (or out of) the targets (qualname) with the places of both ends."""
    side = "to_qualname" if incoming else "from_qualname"
    some = edges.join(targets.select(F.col("qualname").alias(side)).distinct(), side, "left_semi")
    out = with_ends(some, symbols)
    places = [F.col(f"{end}.{c}").alias(f"{end}_{c}") for end in ("from", "to") for c in ("file", "line_start")]
    return out.select("from_qualname", "to_qualname", "kind", "resolved", *places)


def graph_nodes(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One node per qualname: first symbol's label and kind, all locations, and its outgoing edges, resolved or not.

    The locations are lines FILE:START-END in title, the edges lines KIND TARGET in targets.
    """
    where = F.array_sort(F.collect_list(F.struct("file", "line_start", "line_end")))
    places = symbols.groupBy("qualname").agg(where.alias("places"))
    title = F.array_join(F.transform("places", lambda p: F.concat(p["file"], F.lit(":"), p["line_start"].cast("string"), F.lit("-"), p["line_end"].cast("string"))), "\n")
    line = F.concat("kind", F.lit(" "), "to_qualname", F.when(F.col("resolved"), "").otherwise(" ?"))
    out = edges.groupBy(F.col("from_qualname").alias("qualname")).agg(F.count("*").alias("outgoing"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("targets"))
    return (
        first_symbol(symbols).select("qualname", F.col("name").alias("label"), F.col("kind").alias("node_group"))
        .join(places, "qualname").join(out, "qualname", "left")
        .select(F.col("qualname").alias("id"), "label", "node_group", title.alias("title"), F.size("places").cast("long").alias("locations"), F.coalesce("outgoing", F.lit(0)).alias("outgoing"), F.coalesce("targets", F.lit("")).alias("targets"))
    )


def selected(symbols: DataFrame, glob: str = "", kinds: list[str] | None = None) -> DataFrame:
    """Symbols of files that a glob takes and of the given kinds, all without any, in order of file, line and id."""
    some = symbols.filter(F.col("file").ilike(glob_to_like(glob))) if glob else symbols
    return (some.filter(F.col("kind").isin(*kinds)) if kinds else some).orderBy("file", "line_start", "id")


def node_data(symbols: DataFrame, edges: DataFrame, snippet: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (id, label, node_group, snippet), their places (id, file, line_start, line_end) and their outgoing edges.

    Three tables keyed by id, so that no node has to hold all places of a name, or all edges of a hub, in one row.
    """
    nodes = first_symbol(symbols.withColumn("snippet", snippet)).select(F.col("qualname").alias("id"), F.col("name").alias("label"), F.col("kind").alias("node_group"), "snippet")
    places = symbols.select(F.col("qualname").alias("id"), "file", "line_start", "line_end")
    out = split_join(edges, nodes.select(F.col("id").alias("from_qualname")), "from_qualname").select(F.col("from_qualname").alias("id"), "to_qualname", "kind", "resolved")
    return nodes, places, out


def graph_edges(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose source is a symbol; dashed where unresolved."""
    known = symbols.select(F.col("qualname").alias("from_qualname")).distinct()
    return edges.join(known, "from_qualname", "left_semi").select("from_qualname", "to_qualname", F.col("kind").alias("label"), (~F.col("resolved")).alias("dashes"))


def graph_externals(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Unknown targets of kept edges, one node each, labelled by what follows the last dot."""
    known = symbols.select(F.col("qualname").alias("to_qualname")).distinct()
    out = graph_edges(symbols, edges).join(known, "to_qualname", "left_anti").select(F.col("to_qualname").alias("id")).distinct()
    return out.select("id", F.substring_index("id", ".", -1).alias("label"))


def neighbours(edges: DataFrame) -> DataFrame:
    """The size of each node's neighbourhood, itself included, whatever the direction."""
    both = edges.select(F.col("from_qualname").alias("id"), F.col("to_qualname").alias("other")).union(edges.select("to_qualname", "from_qualname"))
    return both.union(both.select("id", F.col("id"))).distinct().groupBy("id").agg(F.count("*").alias("neighbours"))


def neighbourhood(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, other, kind, incoming): the targets (qualname), and each edge between one of them and another node."""
    known = targets.select(F.col("qualname").alias("id")).distinct()
    out = edges.select(F.col("from_qualname").alias("id"), F.col("to_qualname").alias("other"), "kind", F.lit(False).alias("incoming"))
    into = edges.select(F.col("to_qualname").alias("id"), F.col("from_qualname").alias("other"), "kind", F.lit(True).alias("incoming"))
    return out.unionByName(into).join(known, "id", "left_semi")


def by_qualname(symbols: DataFrame, qualname: str) -> DataFrame:
    return symbols.filter(F.col("qualname") == qualname).orderBy("file", "line_start", "id")


def by_file(symbols: DataFrame, file: str) -> DataFrame:
    return symbols.filter(F.col("file") == file).orderBy("line_start", "id")


def narrowest(symbols: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target (file, line) the symbol with the narrowest range around the line, the first on ties.

    Equal targets are looked up once; the narrowest is found in every task before rows move.
    """
    around = containing(targets.select("file", "line").distinct(), symbols, "file", "line", "line_start", "line_end")
    best = F.min_by(F.struct(*symbols.columns), F.struct(F.col("line_end") - F.col("line_start"), "line_start", "id"))
    return around.groupBy("file", "line").agg(best.alias("s")).select("line", *[F.col(f"s.{c}") for c in symbols.columns])


def hydrate(symbols: DataFrame, ids: DataFrame) -> DataFrame:
    """Symbols by (pos, id), in the order of pos; unknown ids drop out and repeated ones repeat."""
    return ids.join(symbols, "id").orderBy("pos")


def ranked_text_search(nodes: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Nodes whose label or id holds a text: names that begin with it, names that hold it, then ids."""
    label, id_ = F.lower("label"), F.lower("id")
    rank = F.when(label.startswith(text), 1).when(label.contains(text), 2).when(id_.contains(text), 3)
    return nodes.select("id", "label", rank.alias("rank")).filter("rank is not null").orderBy("rank", F.length("label"), "id").limit(limit)


def row_numbers(by: list[str], order: list) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))
