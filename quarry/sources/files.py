"""Source trees as DataFrames: reading, and the filters of a walk."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import walk_language
from quarry.sources import ignore

MAX_BYTES = 1 << 20
#: Folders that are never walked, besides the one that holds the index (fixed values).
EXCLUDED = (".git", "node_modules", ".venv", "venv", "__pycache__", "dist", "build", "target", ".next", ".mypy_cache", ".pytest_cache", ".ruff_cache")
#: Files at the root whose lines are ignore rules, in this order.
IGNORE_FILES = (".gitignore", ".quarryignore")
#: Names and contents that mark secrets (fixed values).
SECRET_NAME = r"^(\.env(\..*)?|.*\.pem|.*\.key|id_rsa.*|id_ed25519.*)$"
SECRET_TEXT = r"AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]*-----"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def in_excluded(path: Column, own: str = ".quarry") -> Column:
    """Whether any folder of a path is an excluded one, in any case; ``own`` is the folder of the index."""
    folders = F.transform(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), F.lower)
    return F.arrays_overlap(folders, F.array(*[F.lit(x) for x in (*EXCLUDED, own)]))


def secret_name(path: Column) -> Column:
    return base_name(path).rlike(SECRET_NAME)


def secret_text(text: Column) -> Column:
    return text.rlike(SECRET_TEXT)


def ignore_pattern(rule: str) -> str:
    """A regular expression for one line of an ignore file, over paths from the root."""
    anchored, folder = rule.strip("/").find("/") >= 0 or rule.startswith("/"), rule.endswith("/")
    body = re.escape(rule.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"^{'' if anchored else '(?:.*/)?'}{body}{'/.*' if folder else '(?:/.*)?'}$"


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the last rule that matches a path ignores it; ``!`` takes a path back, comments and blanks are skipped."""
    out = F.lit(False)
    for rule in (r.strip() for r in rules):
        if rule and not rule.startswith("#"):
            out = F.when(path.rlike(ignore_pattern(rule.removeprefix("!"))), F.lit(not rule.startswith("!"))).otherwise(out)
    return out


def ignore_lines(root: str, extra: list[str] | None = None, names: tuple[str, ...] = IGNORE_FILES) -> list[str]:
    """The lines of the ignore files at root, then the extra ones; missing files have none.

    Spark's readers skip files whose names start with a dot, so the driver opens these few itself. That takes a root it
    can open; for other stores give the lines as extra ones.
    """
    files = [Path(root.removeprefix("file://"), name) for name in names]
    return [line for f in files if f.is_file() for line in f.read_text(encoding="utf-8").splitlines()] + (extra or [])


def walk(spark: SparkSession, root: str, rules: list[str] | None = None, max_bytes: int = MAX_BYTES, stream: bool = False) -> DataFrame:
    """(path, sha1, size_bytes, language, text) of the files under root that a walk keeps; ``stream`` for those to come.

    Names and sizes are tested before contents are read. Rules are those of the ignore files at root, then the given ones;
    what lies below an ignored folder stays ignored. A stream, which judges each file on its own, tests one rule after the
    other, and there a later rule can take back what lies below such a folder.
    """
    rules = ignore_lines(root, rules)
    reader = spark.readStream if stream else spark.read
    raw = reader.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), f"^{re.escape(root.rstrip('/'))}/", "")
    named = raw.withColumn("path", path).filter(~in_excluded(F.col("path")) & ~secret_name(F.col("path")) & (F.col("length") <= max_bytes))
    if stream:
        named = named.filter(~ignored(F.col("path"), rules))
    elif rules:
        listed = ignore.rule_table(spark.createDataFrame(list(enumerate(rules)), "pos long, line string"))
        judged = ignore.ignored_paths(named.select("path"), listed).filter("ignored")
        named = named.join(judged, "path", "left_anti")
    text = F.decode("content", "UTF-8")
    return named.filter(~secret_text(text)).select("path", F.sha1("content").alias("sha1"), F.col("length").alias("size_bytes"), walk_language(F.col("path")).alias("language"), text.alias("text"))
