from pyspark.sql import functions as F

from quarry.operators import report
from quarry.sources import files as S
from quarry.sources import parsers as P
from quarry.streaming import reindex as R

PYTHON = '''"""Module."""
from . import near
import a.b as ab

A, b = 1, 2
class C(ab.Base, Generic[T]):
    """Does
    much."""
    field: int = 3
    class Inner: pass
    def f(self, /, x=near, *, y: str = "é", **kw):
        def inner():
            helper(ab)
        z = near
        return self.g().h()

@decorated
def hidden(): pass
'''


def test_parse_python():
    symbols, edges = P.parse_python("pkg.m", PYTHON)
    got = {(s["qualname"], s["kind"], s["scope"]) for s in symbols}
    assert got == {
        ("pkg.m.near", "import", "global"), ("pkg.m.ab", "import", "global"), ("pkg.m.A", "constant", "global"), ("pkg.m.b", "variable", "global"), ("pkg.m.C", "class", "global"),
        ("pkg.m.C.field", "variable", "class"), ("pkg.m.C.f", "method", "class"), ("pkg.m.C.f.self", "variable", "param"), ("pkg.m.C.f.x", "variable", "param"), ("pkg.m.C.f.y", "variable", "param"),
        ("pkg.m.C.f.kw", "variable", "param"), ("pkg.m.C.f.z", "variable", "local"),
    }
    by = {s["qualname"]: s for s in symbols}
    assert by["pkg.m.C"]["docstring"] == "Does much."
    assert by["pkg.m.C.f.y"]["snippet"] == 'y: str = "é"' and by["pkg.m.C.f"]["parent_qualname"] == "pkg.m.C"
    kinds = sorted((e["from_qualname"], e["to_qualname"], e["kind"]) for e in edges)
    assert ("pkg.m", "..near", "import") in kinds and ("pkg.m", "a.b", "import") in kinds and ("pkg.m.C", "ab.Base", "inherit") in kinds
    assert ("pkg.m.C.f", "helper", "call") in kinds and ("pkg.m.C.f", "ab", "reference") in kinds and ("pkg.m.C.f", "self.g", "call") in kinds
    assert ("pkg.m.C.f", "near", "reference") not in kinds


def test_parse_isolates_errors(spark):
    rows = [("m.py", "def ("), ("e.py", ""), ("n.py", None), ("ok/__init__.py", "X = 1"), ("zero.py", "a\x00b"), ("deep.py", "(" * 5000), ("d/notes.txt", "a\nb\n"), ("A.java", "package q; class A { }")]
    parsed = P.parse(spark.createDataFrame(rows, "path string, text string")).collect()
    assert {r["file"] for r in parsed if r["error"]} == {"m.py", "zero.py", "deep.py"}
    assert [[s["qualname"] for s in r["symbols"]] for r in parsed if r["file"] == "ok/__init__.py"] == [["ok.X"]]
    assert {(s["qualname"], s["line_end"]) for r in parsed if r["file"] in ("d/notes.txt", "A.java") for s in r["symbols"]} == {("notes.txt", 2), ("q.A", 1)}
    empty = P.parse(spark.createDataFrame([], "path string, text string"))
    assert P.symbols_of(empty).count() == 0 and P.edges_of(empty).count() == 0


def test_stream_keeps_newest(spark, tmp_path):
    store, state = str(tmp_path / "store"), str(tmp_path / "state")
    schema = "path string, sha1 string, language string, size_bytes long, text string"
    inbox = str(tmp_path / "inbox")

    def arrive(rows):
        spark.createDataFrame(rows, "path string, text string").select("path", F.sha1("text").alias("sha1"), F.lit("python").alias("language"), F.octet_length("text").cast("long").alias("size_bytes"), "text").write.mode("append").parquet(inbox)
        R.run(spark.readStream.schema(schema).parquet(inbox), store, state)
        return {r["path"]: r["text"] for r in R.current(spark, store).collect()}

    assert arrive([("a.py", "x = 1"), ("b.py", "y = 1")]) == {"a.py": "x = 1", "b.py": "y = 1"}
    assert arrive([("a.py", "x = 2")]) == {"a.py": "x = 2", "b.py": "y = 1"}
    assert arrive([("c.py", "")]) == {"a.py": "x = 2", "b.py": "y = 1", "c.py": ""}


def test_html(spark):
    symbols = spark.createDataFrame([(1, "f", "m.f", "function", "m.py", 1, 2), (2, "g", "m.g", "function", "m.py", 3, 4)], "id long, name string, qualname string, kind string, file string, line_start int, line_end int")
    edges = spark.createDataFrame([("m.f", "</script>.x", "call", False), ("m.f", "m.g", "call", True)], "from_qualname string, to_qualname string, kind string, resolved boolean")
    page = report.html(symbols, edges)
    assert page.count("</script>") == 1 and "m.py:1-2" in page and '"external"' in page
    assert '"m.g"' not in report.html(symbols, edges, 1)


def test_walk_as_stream(spark, tmp_path):
    root, store, state = tmp_path / "src", str(tmp_path / "store"), str(tmp_path / "state")
    (root / ".git").mkdir(parents=True)
    (root / ".git" / "config").write_text("x")
    (root / "a.py").write_text("x = 1")
    R.run(S.walk(spark, str(root), stream=True), store, state)
    (root / "a.py").unlink()
    (root / "b.go").write_text("package b")
    R.run(S.walk(spark, str(root), stream=True), store, state)
    assert {(r["path"], r["language"], r["text"]) for r in R.current(spark, store).collect()} == {("a.py", "python", "x = 1"), ("b.go", "go", "package b")}


def test_walk_keeps_out_of_ignored_folders(spark, tmp_path):
    for path in ("out/x.py", "out/keep.py", "src/a.py", "src/b.tmp", "src/[c].py", "é/d.py"):
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text("x = 1")
    (tmp_path / ".gitignore").write_text("# rules\nout/\n!out/keep.py\n*.tmp\n")
    walked = lambda *rules: {r["path"] for r in S.walk(spark, str(tmp_path), list(rules)).collect()}
    assert walked() == {"src/a.py", "src/[c].py", "é/d.py"}
    assert walked("!*.tmp", "/src/a*", r"\[c\].py") == {"src/b.tmp", "é/d.py"}
