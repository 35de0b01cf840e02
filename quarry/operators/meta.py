"""Figures of an index as a table of keys and values, and the registry of indexed repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as t

#: Known keys and their types; all other keys are kept and not read.
KEYS = {"schema_ver": "int", "indexer_ver": "int", "repo_root": "string", "indexed_at": "timestamp", "embedder": "string", "symbol_count": "long", "file_count": "long"}


def write(figures: DataFrame, by: str) -> DataFrame:
    """(by, key, value) for the columns of figures that are known keys; times as UTC text."""
    known = [k for k in KEYS if k in figures.columns]
    text = lambda k: F.date_format(k, "yyyy-MM-dd'T'HH:mm:ss'Z'") if KEYS[k] == "timestamp" else F.col(k).cast("string")
    return figures.select(by, *[text(k).alias(k) for k in known]).unpivot(by, known, "key", "value")


def read(rows: DataFrame, by: str) -> DataFrame:
    """One row of typed columns for each ``by`` from (by, key, value); numbers that cannot be read are 0, times null.

    Of a repeated key the row with the greatest ``at`` counts, or the greatest value where there is no such column.
    """
    order = F.col("at") if "at" in rows.columns else F.col("value")
    wide = rows.filter(F.col("key").isin(*KEYS)).groupBy(by).pivot("key", list(KEYS)).agg(F.max_by("value", order))

    def typed(k: str, kind: str) -> Column:
        if kind == "timestamp":
            return t.parse_timestamp(F.col(k))
        return F.coalesce(F.col(k).try_cast(kind), F.lit(0 if kind != "string" else "").cast(kind))

    return wide.select(by, *[typed(k, kind).alias(k) for k, kind in KEYS.items()])


def run_figures(states: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for an index run: files parsed, skipped, removed and total, and new and total symbols and edges.

    states has (path, old, new) hashes; symbols and edges are those after the run, each with its file.
    """
    touched = states.filter(F.col("new").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))).select(F.col("path").alias("file"), F.lit(True).alias("touched"))
    files = states.agg(
        F.count_if(F.col("new").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))).alias("parsed"),
        F.count_if(F.col("old").eqNullSafe(F.col("new"))).alias("skipped"),
        F.count_if(F.col("new").isNull()).alias("removed"),
        F.count("new").alias("total_files"),
    )
    for name, rows in (("symbols", symbols), ("edges", edges)):
        counted = rows.join(touched, "file", "left").agg(F.count("touched").alias(name), F.count("*").alias(f"total_{name}"))
        files = files.join(counted)  # one row each
    return files


def upsert(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Registry entries (name, path ...) in order of names, with new ones in place of those of equal names."""
    return entries.join(new, "name", "left_anti").unionByName(new).orderBy("name")


def remove(entries: DataFrame, key: str) -> DataFrame:
    """Entries without the one of that name or path."""
    return entries.filter((F.col("name") != key) & (t.clean_path(F.col("path")) != t.clean_path(F.lit(key))))


def resolve(requests: DataFrame, entries: DataFrame, indexed: DataFrame, default: str | None = None) -> DataFrame:
    """requests (id, flag, cwd) with ``path`` and ``step``, how the repository was found; null and 6 where none was.

    entries (pos, name, path) are in the order of pos; indexed (path) are the folders that hold an index. Steps: 1 the
    flag is a name or path, 2 cwd lies in an entry, the first of them by pos, 3 the nearest folder around cwd that holds
    an index, 4 the entry of the default name, 5 the only entry. A flag that is not known ends at step 1 with no path.
    """
    known = entries.select("pos", "name", t.clean_path(F.col("path")).alias("root"))
    at = t.clean_path(F.col("cwd"))
    parts = F.split(at, "/")
    above = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    around = requests.filter("cwd <> ''").select("id", F.explode(above).alias("root"))
    entered = around.join(known, "root").groupBy("id").agg(F.min_by("root", "pos").alias("entered"))
    nearest = around.join(indexed.select(t.clean_path(F.col("path")).alias("root")).distinct(), "root").groupBy("id").agg(F.max_by("root", F.length("root")).alias("nearest"))
    flags = known.select(F.col("name").alias("flag"), F.col("root").alias("named"), "pos").unionByName(known.select(F.col("root").alias("flag"), F.col("root").alias("named"), "pos"))
    flags = flags.groupBy("flag").agg(F.min_by("named", "pos").alias("named"))
    # One row: the default's path and the only entry's.
    rest = known.agg(F.min(F.when(F.col("name") == F.lit(default), F.col("root"))).alias("chosen"), F.when(F.count("*") == 1, F.min("root")).alias("only"))
    out = requests.join(flags, "flag", "left").join(entered, "id", "left").join(nearest, "id", "left").join(F.broadcast(rest))
    given = F.coalesce("flag", F.lit("")) != ""
    step = F.when(given, 1).when(F.col("entered").isNotNull(), 2).when(F.col("nearest").isNotNull(), 3).when(F.col("chosen").isNotNull(), 4).when(F.col("only").isNotNull(), 5).otherwise(6)
    path = F.when(given, F.col("named")).otherwise(F.coalesce("entered", "nearest", "chosen", "only"))
    return out.select("id", path.alias("path"), step.alias("step"))


#: The line that begins an entry of a registry file, and the columns of entries in the order of their lines.
SECTION = "[[index]]"
ENTRY = {"name": "string", "path": "string", "created_at": "timestamp", "last_indexed": "timestamp", "file_count": "long", "symbol_count": "long", "embedder": "string", "schema_ver": "long"}


def to_lines(entries: DataFrame) -> DataFrame:
    """(name, n, line): a registry file, line n of each entry; null values have no line, missing columns neither.

    Texts stand in quotes with escapes, times as they are in UTC, numbers plain. In the order of (name, n), it is the file.
    """
    quoted = lambda c: F.substring(F.to_json(F.array(c)), 2, 1 << 30)

    def value(key: str) -> Column:
        kind = ENTRY[key]
        text = F.date_format(key, "yyyy-MM-dd'T'HH:mm:ss'Z'") if kind == "timestamp" else F.col(key).cast("string")
        text = F.regexp_replace(quoted(F.col(key)), r"\]$", "") if kind == "string" else text
        return F.when(F.col(key).isNotNull(), F.concat(F.lit(f"  {key} = "), text))

    lines = F.array_compact(F.array(F.lit(SECTION), *[value(k) for k in ENTRY if k in entries.columns], F.lit("")))
    return entries.select("name", F.posexplode(lines).alias("n", "line"))


def from_lines(lines: DataFrame, order: list[str], file: str) -> DataFrame:
    """Entries of registry files: lines (line, the columns of order, and file, the name of the file).

    The header of each line is the last one before it, carried down over the lines that are none. Unknown keys, comments
    and lines before the first header are passed over; of a repeated key the last line counts; what is not of its kind
    is null. A registry has one entry per repository, and its file is read in one piece.
    """
    by = Window.partitionBy(file).orderBy(*order)
    at = F.row_number().over(by)
    headed = lines.withColumn("at", at).withColumn("entry", F.last(F.when(F.trim("line") == SECTION, F.col("at")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    pairs = headed.filter("entry is not null").select(file, "entry", "at", F.regexp_extract("line", r"^\s*([A-Za-z_]+)\s*=", 1).alias("key"), F.trim(F.regexp_extract("line", r"^\s*[A-Za-z_]+\s*=(.*)$", 1)).alias("raw"))
    wide = pairs.groupBy(file, "entry").pivot("key", list(ENTRY)).agg(F.max_by("raw", "at"))

    def typed(key: str, kind: str) -> Column:
        if kind == "timestamp":
            return t.parse_timestamp(F.col(key))
        return F.get_json_object(F.concat(F.lit('{"v":'), key, F.lit("}")), "$.v") if kind == "string" else F.col(key).try_cast(kind)

    return wide.select(*[typed(k, kind).alias(k) for k, kind in ENTRY.items()]).filter("name is not null")


def save_registry(entries: DataFrame, folder: str) -> None:
    """Write entries in order of their names as one text file."""
    to_lines(entries).orderBy("name", "n").coalesce(1).select("line").write.mode("overwrite").text(folder)


def load_registry(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of the registry files in a folder."""
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place")]
    return from_lines(spark.read.text(folder).select(F.col("value").alias("line"), *at), ["start", "place"], "file")
