"""Ignore rules as a table, registry files, vectors as bytes, re-ranking by a text, node tables."""

import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as t
from quarry.functions import vectors
from quarry.operators import graph, index, meta
from quarry.sources import ignore


def rules(spark, lines):
    return ignore.rule_table(spark.createDataFrame(list(enumerate(lines)), "pos long, line string"))


def ignored(spark, paths, lines):
    got = ignore.ignored_paths(spark.createDataFrame([(p,) for p in paths], "path string"), rules(spark, lines)).collect()
    return {r["path"]: r["ignored"] for r in got}


def test_ignore_grammar(spark):
    cases = {
        "*.log": (["a.log", "d/b.log"], ["a.log.txt", "log"]), "/top": (["top", "top/x"], ["d/top"]), "build/": (["build/x", "d/build/y"], ["build"]), "a/b": (["a/b", "a/b/c"], ["d/a/b"]),
        "**/deep": (["deep", "x/y/deep"], ["deeper"]), "x/**/y": (["x/y", "x/a/b/y"], ["x/ay"]), "x/**": (["x/a", "x/a/b"], ["x"]), "?.c": (["a.c", "d/b.c"], ["ab.c", "/.c"]), "[a-c]z": (["az", "cz"], ["dz", "/z"]),
        "[!a-c]z": (["dz"], ["az", "z"]), "[^a]z": (["bz"], ["az"]), r"\#x": (["#x"], ["x"]), r"\!x": (["!x"], ["x"]), r"a\*b": (["a*b"], ["acb"]), r"end\ ": (["end "], ["end"]), "trail  ": (["trail"], ["trail  "]),
        "[x": (["[x"], ["x"]), "[]a]": (["]", "a"], ["b"]), "q[.]r": (["q.r"], ["qxr"]), "*a*": (["bab", "a"], ["b"]), "# no": ([], ["# no", "no"]), "": ([], ["x"]), "a+(b)": (["a+(b)"], ["aab"]), "fo**o": (["foo", "fobaro"], ["fo"]),
    }
    for rule, (yes, no) in cases.items():
        got = ignored(spark, yes + no, [rule])
        assert got == {**dict.fromkeys(yes, True), **dict.fromkeys(no, False)}, rule


def test_order_of_rules_and_folders(spark):
    assert ignored(spark, ["a.py", "d/a.py", "keep/a.py", "out/keep.py", "out/x"], ["*.py", "!/keep/a.py", "out/", "!out/keep.py"]) == {"a.py": True, "d/a.py": True, "keep/a.py": False, "out/keep.py": True, "out/x": True}
    assert ignored(spark, ["a", None], ["!a", "a", "!a"]) == {"a": False, None: False}
    assert ignored(spark, ["a"], ["# nothing"]) == {"a": False}


@pytest.mark.parametrize("few", [ignore.FEW_RULES, 0])
def test_many_rules_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(ignore, "FEW_RULES", few)
    random.seed(2)
    part = lambda: random.choice(["a", "b", "ab", "*", "a*", "*b", "?", "[ab]", "**", "c.x", "*.x", "*.*"])
    lines = [random.choice(["", "", "!"]) + random.choice(["", "/"]) + "/".join(part() for _ in range(random.randint(1, 3))) + random.choice(["", "/"]) for _ in range(60)]
    paths = sorted({"/".join(random.choice(["a", "b", "ab", "c.x", "ba", "b.x"]) for _ in range(random.randint(1, 4))) for _ in range(150)})
    compiled = [ignore.rule_row(k, x) for k, x in enumerate(lines)]

    def verdict(node, folder):
        last = [r[1] for r in compiled if (folder or not r[2]) and re.search(r[5], node)]
        return bool(last) and last[-1]

    def brute(path):
        parts = path.split("/")
        return any(verdict("/".join(parts[:k]), k < len(parts)) for k in range(1, len(parts) + 1))

    for some in (lines[:6], lines):
        compiled = [ignore.rule_row(k, x) for k, x in enumerate(some)]
        assert ignored(spark, paths, some) == {p: brute(p) for p in paths}


def test_registry_file(spark, tmp_path):
    rows = [('b "x" \\ é\n\t', "/r/b", 3, None), ("a", "C:\\r", 0, "lexical")]
    entries = spark.createDataFrame(rows, "name string, path string, file_count long, embedder string").withColumn("created_at", F.timestamp_seconds(F.lit(1_900_000_000)))
    meta.save_registry(entries, f"file://{tmp_path}/one")
    read = meta.load_registry(spark, f"file://{tmp_path}/one")
    assert sorted(map(tuple, read.select("name", "path", "file_count", "embedder").collect())) == sorted(rows)
    meta.save_registry(read, f"file://{tmp_path}/two")
    lines = [[r[0] for r in spark.read.text(f"file://{tmp_path}/{x}").collect()] for x in ("one", "two")]
    assert lines[0] == lines[1] and lines[0][:2] == ["[[index]]", '  name = "a"'] and "  created_at = 2030-03-17T17:46:40Z" in lines[0]
    (tmp_path / "hand").mkdir()
    (tmp_path / "hand/r.toml").write_text('# mine\nname = "lost"\n[[index]]\nname="n"\nfile_count = x\nother = 1\nfile_count = 7\n[[index]]\npath = "nameless"\n')
    assert [(r["name"], r["file_count"], r["path"]) for r in meta.load_registry(spark, f"file://{tmp_path}/hand").collect()] == [("n", 7, None)]


def test_vectors_as_bytes(spark):
    nan, inf = float("nan"), float("inf")
    numbers = [0.0, -0.0, 1.0, -1.5, 3.4028234663852886e38, 1.1754943508222875e-38, 1.1754942106924411e-38, 1.401298464324817e-45, -1.401298464324817e-45, inf, -inf, 0.1, 2.0**-126, 16777217.0, 8388607.5]
    random.seed(3)
    numbers += [struct.unpack("<f", struct.pack("<I", random.getrandbits(32) & 0xFF7FFFFF))[0] for _ in range(200)]
    rows = [(0, numbers), (1, []), (2, None), (3, [1.0, None]), (4, [nan])]
    df = spark.createDataFrame(rows, "k int, v array<float>").withColumn("b", vectors.to_blob("v"))
    got = {r["k"]: r["b"] for r in df.collect()}
    assert bytes(got[0]) == struct.pack(f"<I{len(numbers)}f", len(numbers), *numbers) and bytes(got[1]) == bytes(4) and got[2] is None is got[3] and bytes(got[4]) == bytes.fromhex("010000000000c07f")
    back = {r["k"]: r["r"] for r in df.select("k", vectors.from_blob("b").alias("r")).collect()}
    assert struct.pack(f"<{len(numbers)}f", *back[0]["vector"]) == bytes(got[0])[4:] and back[1]["vector"] == [] and back[0]["error"] is None and back[2]["vector"] is None
    bad = spark.createDataFrame([(b"",), (b"\x01\x00\x00",), (b"\x01\x00\x00\x00\x00",), (b"\x00\x00\x00\x00\x00",)], "b binary").select(vectors.from_blob("b").alias("r")).collect()
    assert all(r["r"]["vector"] is None and ("short" in r["r"]["error"]) == (k < 2) for k, r in enumerate(bad))


def test_rerank_by_text(spark):
    rows = [(1, "red apple tree", 1, 9.0), (2, "green apple pie", 2, 8.0), (3, "stone wall", 3, 7.0), (4, "", 4, 6.0), (5, "green apple pie", 5, 5.0)]
    hits = spark.createDataFrame(rows, "id long, snippet string, rank int, score double")
    got = index.rerank_text(hits, "apple pie, green", 5).collect()
    assert [r["id"] for r in got][:2] == [2, 5] and got[0]["score"] == pytest.approx(1.0) and {r["id"]: r["score"] for r in got}[4] == 0.0
    for same in (index.rerank_text(hits, "?", 3), index.rerank_text(hits, "apple pie", 3, None)):
        assert [(r["id"], r["score"]) for r in same.collect()] == [(1, 9.0), (2, 8.0), (3, 7.0)]


def test_checked_values_and_prefixes(spark):
    df = spark.createDataFrame([("call",), ("visit",)], "x string")
    assert [r[0] for r in df.filter("x = 'call'").select(t.checked(F.col("x"), t.EDGE_KINDS, "kind")).collect()] == ["call"]
    with pytest.raises(Exception, match="unknown kind: visit"):
        df.select(t.checked(F.col("x"), t.EDGE_KINDS, "kind")).collect()
    pairs = spark.createDataFrame([("a_b", "a_"), ("axb", "a_"), ("a%c", "a%"), ("abc", "a%"), ("a\\b", "a\\"), ("x", "")], "x string, p string")
    assert [r[0] for r in pairs.select(t.prefix_match(F.col("x"), F.col("p"))).collect()] == [True, False, True, False, True, True]
    names = spark.createDataFrame([("$a",), ("a$1",), ("a\n",), ("",)], "x string")
    assert [r[0] for r in names.select(t.is_identifier(F.col("x"), "$")).collect()] == [True, True, False, False]


def test_node_tables(spark):
    symbols = spark.createDataFrame([(1, "f", "m.f", "function", "b.py", 3, 4), (2, "f", "m.f", "class", "a.py", 9, 9), (3, "g", "m.g", "method", "a.py", 1, 2)], "id long, name string, qualname string, kind string, file string, line_start int, line_end int")
    edges = spark.createDataFrame([("m.f", "m.g", "call", True), ("m.f", "os.x", "call", False), ("gone", "m.g", "call", True)], "from_qualname string, to_qualname string, kind string, resolved boolean")
    nodes, places, out = (sorted(map(tuple, x.collect())) for x in graph.node_data(symbols, edges, F.concat("kind", "name")))
    assert nodes == [("m.f", "f", "class", "classf"), ("m.g", "g", "method", "methodg")] and len(places) == 3
    assert out == [("m.f", "m.g", "call", True), ("m.f", "os.x", "call", False)]
    assert [r["id"] for r in graph.selected(symbols, "a*", ["class", "method"]).collect()] == [3, 2] and graph.selected(symbols).count() == 3
