"""File snapshots: difference, replacement and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, status) of the files that are added, changed or removed, by path and sha1."""
    both = previous.select("path", F.col("sha1").alias("old")).join(current.select("path", F.col("sha1").alias("new")), "path", "full_outer")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select("path", status.alias("status")).filter("status is not null")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with equal keys."""
    return old.join(new, key, "left_anti").unionByName(new)


def delete_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows without those of the given files (path); a file's symbols, edges and postings go with it."""
    return rows.join(files, rows["file"] == files["path"], "left_anti")


def incremental(old_symbols: DataFrame, previous: DataFrame, current: DataFrame, parse, failed: DataFrame | None = None) -> DataFrame:
    """Symbols after an index run: those of unchanged files stay, changed and added files are parsed anew.

    ``parse`` takes the current rows of these files. Files in ``failed`` (path) keep their old symbols.
    """
    touched = diff(previous, current)
    if failed is not None:
        touched = touched.join(failed, "path", "left_anti")
    fresh = current.join(touched.filter("status <> 'removed'").select("path"), "path", "left_semi")
    return delete_files(old_symbols, touched).unionByName(parse(fresh))


def summary(previous: DataFrame, current: DataFrame) -> DataFrame:
    """One row: files parsed, skipped and removed."""
    states = previous.select("path", F.col("sha1").alias("old")).join(current.select("path", F.col("sha1").alias("new")), "path", "full_outer")
    return states.agg(
        F.count_if(F.col("new").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))).alias("parsed"),
        F.count_if(F.col("old").eqNullSafe(F.col("new"))).alias("skipped"),
        F.count_if(F.col("new").isNull()).alias("removed"),
    )
