"""Helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only on a single machine where none is set, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = getattr(spark, "_quarry_dir", None) or f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark._quarry_dir = named
    return named.rstrip("/")


def materialize(df: DataFrame, *by: str) -> DataFrame:
    """Write df as Parquet in the shared folder, parted by the columns ``by``, and read it again.

    This cuts lineage, and what follows survives the loss of any executor. Row order and partition ids of the
    result are fixed, so values made before it, such as monotonically_increasing_id(), no longer change.
    """
    path = f"{shared_dir(df.sparkSession)}/quarry/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ids_out(df: DataFrame, *names: str) -> DataFrame:
    """df with ids as strings, for Python: beside a null, pandas would turn integers into doubles and lose digits."""
    return df.withColumns({c: F.col(f"`{c}`").cast("string") for c in names})


def ids_back(df: DataFrame, name: str, kind: T.DataType) -> DataFrame:
    """df with ids of their own type again."""
    return df.withColumn(name, F.col(f"`{name}`").cast(kind))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


#: Values of an array that running() takes at once, and characters of a text that read() does.
RUN, CHUNK = 64, 512


def running(values: str, merge: str, start: str, levels: int = 3) -> str:
    """SQL for the running total of the array ``values``: element i merges the elements up to i.

    merge is SQL over a and x, such as ``a + x``, and must be associative. Blocks of RUN values are summed up first,
    then their totals likewise, so the work is linear where an array that grows by one value at a time is quadratic.
    """
    n = levels
    total = f"aggregate(v, {start}, (a, x) -> {merge})"
    if not n:
        return f"transform({values}, (y, i) -> aggregate(slice({values}, 1, i + 1), {start}, (a, x) -> {merge}))"
    blocks = f"transform(sequence(0, (size(v{n}) - 1) div {RUN}), k -> slice(v{n}, k * {RUN} + 1, {RUN}))"
    totals = f"transform(b{n}, v -> {total})"
    within = f"transform(v, (y, i) -> aggregate(slice(v, 1, i + 1), CASE WHEN k = 0 THEN {start} ELSE s{n}[k - 1] END, (a, x) -> {merge}))"
    out = f"flatten(transform(b{n}, (v, k) -> {within}))"
    out = bound(f"s{n}", running(f"t{n}", merge, start, n - 1), out)
    out = bound(f"b{n}", blocks, bound(f"t{n}", totals, out))
    return bound(f"v{n}", values, f"CASE WHEN size(v{n}) = 0 THEN v{n} ELSE {out} END")


def bound(name: str, value: str, body: str) -> str:
    """SQL for body, in which name stands for value; value is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def in_chunks(text: str) -> str:
    """SQL for text in pieces of CHUNK code points, for read()."""
    return f"regexp_extract_all({text}, r'(?s).{{1,{CHUNK}}}', 0)"


def read(chunks: str, start: str, end: str) -> str:
    """SQL for the code points [start, end) of a text in_chunks(), without counting through all that stand before."""
    first = f"({start}) div {CHUNK}"
    part = f"slice({chunks}, int({first}) + 1, int(greatest(({end} - 1) div {CHUNK} - {first} + 1, 0)))"
    return f"substr(array_join({part}, ''), int(({start}) % {CHUNK}) + 1, int({end} - ({start})))"


#: At most so many groups count as hot, see attach().
HOT_GROUPS = 2000


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, n: int) -> DataFrame:
    """Inner join of rows with one row per group, however uneven the groups are.

    ``size`` is a column of groups with the rows of each group, ``n`` the number of rows. Groups of at least
    n / HOT_GROUPS rows number at most HOT_GROUPS, so they are broadcast and their rows stay where they are; the rows
    of all other groups are joined by a shuffle. Keys must not be null.
    """
    least = max(32, n // HOT_GROUPS)
    extra = [c for c in groups.columns if c not in keys]
    hot = groups.filter(F.col(size) >= least)
    marked = rows.join(F.broadcast(hot), keys, "left")
    cold = marked.filter(F.col(size).isNull()).select(*rows.columns).join(groups.filter(F.col(size) < least), keys)
    return marked.filter(F.col(size).isNotNull()).select(*rows.columns, *extra).unionByName(cold.select(*rows.columns, *extra))
