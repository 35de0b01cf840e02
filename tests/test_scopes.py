"""Text search by runs of letters, nested ranges, and the graph as a folder of pages."""

import json
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.operators import grams, nesting, report


def test_search_by_runs_of_letters(spark, tmp_path):
    random.seed(7)
    name = lambda: "".join(random.choice("abAB_é文") for _ in range(random.randint(1, 9)))
    nodes = sorted({(f"{name()}.{name()}", random.choice([name(), "", None])) for _ in range(300)})
    nodes = list({i: (i, x) for i, x in nodes}.values())
    patterns = ["a", "AB", "ab", "b_", "abA", "ABAB", "é", "文文", "zz", "abzab", ".", "", None, "a.b", "AbAbAbAbAbAb"] + [random.choice(nodes)[0][1:6] for _ in range(30)]
    held = grams.build(spark.createDataFrame(nodes, "id string, label string").repartition(4), str(tmp_path))
    asked = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    got = {}
    for r in grams.search(held, asked, 7).orderBy("pattern", "place").collect():
        got.setdefault(r["pattern"], []).append((r["id"], r["rank"]))
    for p in {p for p in patterns if p}:
        low, found = p.lower(), []
        for i, x in nodes:
            x = x or ""
            rank = 1 if x.lower().startswith(low) else 2 if low in x.lower() else 3 if low in i.lower() else 0
            if rank:
                found.append((rank, len(x), i.encode(), i))
        assert got.get(p, []) == [(i, rank) for rank, _, _, i in sorted(found)[:7]], p
    assert None not in got and "" not in got
    rare = grams.candidates(held, spark.createDataFrame([("abA文",)], "pattern string")).count()
    assert rare < len(nodes) / 4
    assert grams.search(grams.build(spark.createDataFrame([], "id string, label string"), str(tmp_path / "none")), asked).count() == 0


def brute_nested(steps):
    """depth, end and parent of each opening mark, by a stack."""
    out, stack, depth = {}, [], 0
    for pos, step in steps:
        if step > 0:
            depth += 1
            out[pos] = [depth, None, stack[-1] if stack else None]
            stack.append(pos)
        else:
            depth -= 1
            if stack:
                out[stack.pop()][1] = pos
    return {pos: tuple(x) for pos, x in out.items()}


@pytest.mark.parametrize("piece", [3, 7, 10_000])
def test_nested_marks(spark, piece):
    random.seed(9)
    keys = {k: [(p, random.choice([1, 1, -1] if k % 3 else [1, -1, -1])) for p in sorted(random.sample(range(200), random.randint(0, 90)))] for k in range(12)}
    keys[99] = [(p, 1 if p % 2 == 0 else -1) for p in range(400)]  # one key with many marks, side by side
    rows = [(k, p, s) for k, marks in keys.items() for p, s in marks]
    got = {}
    for r in nesting.nested(spark.createDataFrame(rows, "k long, pos long, step long").repartition(4), "k", "pos", "step", piece).collect():
        got.setdefault(r["k"], {})[r["pos"]] = (r["depth"], r["end"], r["parent"])
    assert got == {k: b for k, marks in keys.items() if (b := brute_nested(marks))}


def test_tags(spark):
    html = '<!DOCTYPE html><DIV a="1"><br><img src=x><p>a < b</p><hr/></div></b><i/>'
    rows = nesting.tags(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).orderBy("pos").collect()
    assert [(r["pos"], r["name"], r["step"]) for r in rows] == [(0, "div", 1), (3, "p", 1), (4, "p", -1), (6, "div", -1), (7, "b", -1)]


def test_graph_as_a_folder(spark, tmp_path):
    symbols = spark.createDataFrame([(k, f"n{k}", f"m.n{k}", "function", "a.py", k, k) for k in range(60)] + [(99, "x<y", "m.x<y", "class", "a.py", 1, 1)], "id long, name string, qualname string, kind string, file string, line_start int, line_end int")
    rows = [("m.n0", f"m.n{k}", "call", True) for k in range(60)] + [("m.n1", "os.walk</script>", "call", False), ("gone", "m.n1", "call", True)]
    edges = spark.createDataFrame(rows, "from_qualname string, to_qualname string, kind string, resolved boolean")
    assert report.write_shards(symbols, edges, f"file://{tmp_path}/g", 10) == 7
    nodes, found = [], []
    for page in Path(f"{tmp_path}/g").glob("shard=*/part-*"):
        text = page.read_text()
        assert text.startswith("<!doctype html>") and text.count("</script>") == 1
        data = json.loads(re.sub(r",(\s*\])", r"\1", re.search(r"const data = (\{.*?\}), list = ", text, re.S)[1]))
        nodes += [n["id"] for n in data["nodes"]]
        found += [(e["from_qualname"], e["to_qualname"], e["dashes"]) for e in data["edges"]]
        assert {e["from_qualname"] for e in data["edges"]} <= {n["id"] for n in data["nodes"]}
    assert sorted(nodes) == sorted([f"m.n{k}" for k in range(60)] + ["m.x<y", "os.walk</script>"])
    assert sorted(found) == sorted((a, b, not r) for a, b, _, r in rows[:-1])
    assert report.write_shards(symbols.filter(F.lit(False)), edges, f"file://{tmp_path}/none", 10) == 1
