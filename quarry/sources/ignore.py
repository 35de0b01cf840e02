"""Ignore rules as a table: which of many rules decides about each of many paths."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules up to which they are broadcast.
FEW_RULES = 10_000
RULE = "pos long, ignores boolean, folder boolean, kind string, key string, pattern string"


def parsed(line: str) -> tuple[bool, bool, bool, list[str]] | None:
    """(negated, folders only, anchored, tokens) of a rule; None for comments and blanks.

    A token is a literal character, or a wildcard as a regular expression of two characters and more. Backslashes take
    the next character literally; brackets are classes, ``!`` or ``^`` inverts them, and one that is never closed is a
    character. No wildcard but ``**`` matches a slash.
    """
    line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    negated, line = line.startswith("!"), line.removeprefix("!")
    folder, line = line.endswith("/"), line.rstrip("/")
    anchored, line = "/" in line, line.removeprefix("/")
    out, k = [], 0
    while k < len(line):
        c = line[k]
        end = line.find("]", k + 2 + (line[k + 1 : k + 2] in ("!", "^"))) if c == "[" else -1
        if c == "\\" and k + 1 < len(line):
            k += 1
            out.append(line[k])
        elif line.startswith("**/", k) and (k == 0 or line[k - 1] == "/"):
            out.append("(?:.*/)?")
            k += 2
        elif line.startswith("**", k):
            out.append(".*")
            k += 1
        elif c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif end > 0:
            body = line[k + 1 : end]
            inverted = body[:1] in ("!", "^")
            body = re.sub(r"([\\\[\]&~^])", r"\\\1", body[inverted:])
            out.append(f"(?!/)[{'^' * inverted}{body}]")
            k = end
        else:
            out.append(c)
        k += 1
    return negated, folder, anchored, out


def rule_row(pos: int, line: str) -> tuple | None:
    """A row of RULE: a regular expression for a rule, and a key that paths must have to match it.

    Kinds of keys: path (the whole path), name (its last part), end (what follows the last dot of a name), first and last
    character of the name, or any.
    """
    found = parsed(line)
    if found is None:
        return None
    negated, folder, anchored, tokens = found
    pattern = "^" + ("" if anchored else "(?:.*/)?") + "".join(x if len(x) > 1 else re.escape(x) for x in tokens) + "$"
    plain = [x if len(x) == 1 else None for x in tokens]
    cut = max((k for k, x in enumerate(plain) if x == "/" or (x is None and tokens[k] in (".*", "(?:.*/)?"))), default=-1)
    name = plain[cut + 1 :]
    # After ``**`` that is not a whole part, a name may begin anywhere.
    whole = cut < 0 or plain[cut] == "/" or tokens[cut] == "(?:.*/)?"
    dot = max((k for k, x in enumerate(name) if x == "."), default=-1)
    if None not in plain:
        kind, key = ("path", "".join(plain)) if anchored else ("name", "".join(plain))
    elif dot >= 0 and None not in name[dot:] and len(name) > dot + 1:
        kind, key = "end", "".join(name[dot + 1 :])
    elif whole and name and name[0] is not None:
        kind, key = "first", name[0]
    elif name and name[-1] is not None:
        kind, key = "last", name[-1]
    else:
        kind, key = "any", ""
    return pos, not negated, folder, kind, key, pattern


def rule_table(rules: DataFrame) -> DataFrame:
    """RULE for rules (pos, line); later positions overrule earlier ones, comments and blanks have no row."""

    def compiled(frames: Iterable):
        import pandas as pd

        names = [x.split(" ")[0] for x in RULE.split(", ")]
        for pdf in frames:
            rows = [rule_row(p, x) for p, x in zip(pdf["pos"].tolist(), pdf["line"].tolist())]
            yield pd.DataFrame([r for r in rows if r], columns=names)

    return rules.filter("line is not null").selectExpr("bigint(pos) AS pos", "line").mapInPandas(compiled, RULE)


def ignored_paths(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, ignored) for files (path) under the rules of a table (RULE): by the last rule that matches.

    What lies below an ignored folder stays ignored, whatever later rules say of it. Folders that many files share are
    judged once. A path meets rules through equal keys only; those of kind any, which begin and end with wildcards, meet
    all paths. Null paths are not ignored.
    """
    paths = files.select("path").distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("node"), (k < F.size(parts)).alias("folder")))
    places = paths.filter("path is not null").select("path", F.inline(above))
    nodes = places.select("node", "folder").distinct()
    name = F.substring_index("node", "/", -1)
    keys = {"path": F.col("node"), "name": name, "end": F.when(name.contains("."), F.substring_index(name, ".", -1)), "first": F.substring(name, 1, 1), "last": F.substring(name, -1, 1), "any": F.lit("")}
    keyed = nodes.select("node", "folder", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in keys.items()])).alias("k")).select("node", "folder", "k.*")
    table = rules.withColumnRenamed("folder", "folders")
    table = F.broadcast(table) if table.count() <= FEW_RULES else table
    met = keyed.join(table, ["kind", "key"]).filter((F.col("folder") | ~F.col("folders")) & F.expr("node rlike pattern"))
    judged = met.groupBy("node", "folder").agg(F.max_by("ignores", "pos").alias("ignores"))
    bad = places.join(judged.filter("ignores"), ["node", "folder"]).select("path").distinct().withColumn("ignored", F.lit(True))
    return files.select("path").join(bad, "path", "left").select("path", F.coalesce("ignored", F.lit(False)).alias("ignored"))
