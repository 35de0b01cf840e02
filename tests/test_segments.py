import pytest
from pyspark.sql import functions as F

from quarry.operators import graph, index, joins, segments

FILES = "path string, sha1 string, language string, size_bytes long"


def parse_of(spark, contents, seen):
    """A toy language: a line ``def NAME: WORDS`` is a symbol of the file's module, a line ``use NAME`` an edge of the file's first symbol."""

    def parse(rows):
        symbols, edges, failed = [], [], []
        for r in rows.collect():
            seen.append(r["path"])
            text = contents[r["path"]]
            if "broken" in text:
                failed.append((r["path"],))
                continue
            module, first = r["path"].removesuffix(".x"), None
            for k, line in enumerate(text.split("\n")):
                if line.startswith("def "):
                    name, _, words = line[4:].partition(":")
                    first = first or f"{module}.{name}"
                    symbols.append((1000 * int(r["path"][1:-2]) + k, name, f"{module}.{name}", "function", "global", r["path"], k + 1, k + 1, module, "", words.strip()))
                elif line.startswith("use "):
                    edges.append((first, line[4:], "call", r["path"]))
        symbol = ", ".join(x for x in segments.SYMBOL.split(", ") if x.split()[0] not in ("born", "block"))
        return spark.createDataFrame(symbols, symbol), spark.createDataFrame(edges, "from_qualname string, to_qualname string, kind string, file string"), spark.createDataFrame(failed, "path string")

    return parse


def run(spark, store, contents, seen, **options):
    listing = spark.createDataFrame([(p, str(hash(c)), "x", len(c)) for p, c in contents.items()], FILES)
    return segments.run(store, listing, lambda paths: paths, parse_of(spark, contents, seen), "2031-01-01T00:00:00Z", **options)


def same_as_full(spark, store, contents):
    """Every table of the store equals that of one build of what is there now."""
    m = store.manifest()
    symbols, edges, _ = parse_of(spark, contents, [])(spark.createDataFrame([(p,) for p in contents], "path string"))
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=str)
    assert rows(store.files(m), "path", "sha1") == sorted((p, str(hash(c))) for p, c in contents.items())
    assert rows(store.of_files("symbols", m), "id", "qualname", "snippet") == rows(symbols, "id", "qualname", "snippet")
    assert rows(store.index(m).postings, "symbol_id", "token", "tf", "length") == rows(index.term_freq(symbols), "symbol_id", "token", "tf", "length")
    assert rows(store.tokens(m), "token", "df") == rows(index.doc_freq(symbols), "token", "df")
    assert rows(store.edges(m), "from_qualname", "to_qualname", "kind", "resolved") == rows(graph.resolve(edges, symbols), "from_qualname", "to_qualname", "kind", "resolved")
    stats = index.corpus_stats(symbols).first()
    assert (m.files, m.symbols, m.edges) == (len(contents), stats["n"], edges.count()) and store.index(m).average == pytest.approx(stats["avg_len"])


def test_runs_follow_changes(spark, tmp_path, monkeypatch):
    store, seen = segments.Store(spark, str(tmp_path / "store")), []
    assert store.manifest() == segments.Manifest() and store.files(store.manifest()).count() == 0
    one = {f"f{k}.x": f"def top{k}: alpha word{k}\nuse f{(k + 1) % 6}.top{(k + 1) % 6}\nuse help{k}\nuse os.walk" for k in range(6)}
    assert run(spark, store, one, seen) == {"parsed": 6, "skipped": 0, "removed": 0, "symbols": 6, "edges": 18, "total_symbols": 6, "total_files": 6}
    same_as_full(spark, store, one)

    # Nothing changed: nothing is parsed, and only the time is written.
    before, seen[:] = store.manifest(), []
    assert run(spark, store, one, seen, indexer_ver=9) == {"parsed": 0, "skipped": 6, "removed": 0, "symbols": 0, "edges": 0, "total_symbols": 6, "total_files": 6}
    assert not seen and store.manifest() == before._replace(version=2)

    # One file edited (its help comes, so an edge of it resolves), one removed (an edge of another file no longer does), one new.
    two = {**one, "f0.x": one["f0.x"] + "\ndef help0: beta", "f7.x": "def top7: alpha alpha"}
    del two["f3.x"]
    assert run(spark, store, two, seen) == {"parsed": 2, "skipped": 0, "removed": 1, "symbols": 3, "edges": 3, "total_symbols": 7, "total_files": 7 - 1}
    assert sorted(seen) == ["f0.x", "f7.x"]
    same_as_full(spark, store, two)
    hits = lambda built: [(r["id"], r["score"]) for r in index.search(built, "alpha word").collect()]
    full = index.build(parse_of(spark, two, [])(spark.createDataFrame([(p,) for p in two], "path string"))[0], str(tmp_path / "full"))
    assert hits(store.index(store.manifest())) == hits(full) != []

    # A file that fails keeps what it had and is tried again.
    seen[:] = []
    broken = {**two, "f1.x": "broken", "f3.x": "def top3: back"}
    assert run(spark, store, broken, seen)["skipped"] == 1
    assert sorted(r["qualname"] for r in store.of_files("symbols", store.manifest()).filter("file = 'f1.x'").collect()) == ["f1.top1"]
    seen[:] = []
    mended = {**two, "f3.x": "def top3: back"}
    assert run(spark, store, mended, seen)["parsed"] == 0 and not seen
    same_as_full(spark, store, mended)

    # Forced, and from nothing.
    seen[:] = []
    assert run(spark, store, mended, seen, force=True)["parsed"] == 7 and len(seen) == 7
    same_as_full(spark, store, mended)
    assert len(store.manifest().segments) < 5  # some were merged on the way
    listing = spark.createDataFrame([], FILES)
    assert segments.reindex(store, listing, lambda paths: paths, parse_of(spark, {}, seen), "now")["removed"] == 7
    m = store.manifest()
    assert (m.files, m.symbols, m.edges, m.length, m.holders) == (0, 0, 0, 0, 0) and store.tokens(m).count() == 0 == store.edges(m).count()


def test_split_join(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 12)
    monkeypatch.setattr(joins, "HOT_KEYS", 5)
    rows = spark.createDataFrame([(k, "hub" if k < 3000 else f"x{k % 50}" if k % 7 else None) for k in range(4000)], "id long, key string")
    lookup = spark.createDataFrame([("hub", 1), ("x3", 2), ("x4", 3), ("absent", 4)], "key string, v int")
    for outer, kind in ((False, "inner"), (True, "left")):
        assert sorted(map(tuple, joins.split_join(rows, lookup, "key", outer).select("id", "v").collect())) == sorted(map(tuple, rows.join(lookup, "key", kind).select("id", "v").collect()))
    none = lookup.filter(F.lit(False))
    assert joins.split_join(rows, none, "key").count() == 0 and joins.split_join(rows.limit(0), lookup, "key", True).count() == 0


def test_a_run_that_keeps_no_row_reads_nothing_older(spark, tmp_path):
    """The manifest names the new segment alone, and older ones are not even read: they may be gone."""
    store, one = segments.Store(spark, str(tmp_path / "store")), {f"f{k}.x": f"def top{k}: alpha word{k}\nuse help{k}" for k in range(3)}
    run(spark, store, one, [])
    two = {**one, "f1.x": "def top1: beta\nuse f1.top1"}
    run(spark, store, two, [])
    assert len(store.manifest().segments) == 2
    for kind in ("symbols", "edges", "names", "postings"):
        (tmp_path / "store" / "segment-1" / kind).rename(tmp_path / f"away-{kind}")
    assert run(spark, store, two, [], force=True)["parsed"] == 3
    m = store.manifest()
    assert [k for k, *_ in m.segments] == [3] == list(m.resolved) and not m.dead
    same_as_full(spark, store, two)


def test_segments_of_one_size_merge(spark, tmp_path):
    store, contents = segments.Store(spark, str(tmp_path / "store")), {}
    for k in range(4):
        contents |= {f"f{2 * k}.x": f"def top{k}: alpha word{k}\nuse f1.top", f"f{2 * k + 1}.x": "def top: beta", "f0.x": f"def top0: alpha again{k}"}
        run(spark, store, dict(contents), [])
    m = store.manifest()
    assert len(m.segments) == 1 and m.segments[0][2] == (1, 2, 3, 4)
    same_as_full(spark, store, contents)
