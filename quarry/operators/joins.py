"""Joins that stand uneven keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The keys with the most rows are hot, so many of them at most, if they have so many rows at least.
HOT_KEYS, HOT_ROWS = 2000, 10_000


def split_join(rows: DataFrame, lookup: DataFrame, key: str, outer: bool = False) -> DataFrame:
    """rows with the columns of lookup, which has distinct keys; ``outer`` keeps rows without one, null keys included.

    Lookup rows of hot keys, HOT_KEYS at most, are broadcast, and the rows of these keys stay where they are. All other
    rows are joined by a shuffle. Keys are counted in each task first.
    """
    extra, kind = [c for c in lookup.columns if c != key], "left" if outer else "inner"
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= HOT_ROWS)
    found = counts.orderBy(F.desc("_n"), key).limit(HOT_KEYS).select(key).collect()
    if not found:
        return rows.join(lookup, key, kind).select(*rows.columns, *extra)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, rows.select(key).schema).withColumn("_hot", F.lit(True)))
    marked = rows.join(hot, key, "left")
    stay = marked.filter("_hot").join(F.broadcast(lookup.join(hot, key, "left_semi")), key, kind)
    move = marked.filter("_hot is null").join(lookup, key, kind)
    return stay.select(*rows.columns, *extra).unionByName(move.select(*rows.columns, *extra))
