"""Views of the driver's tables in the shape of the index tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, path, sha1, language, size_bytes, text)"""
    return files_of(table(spark, sf_dir, "documents"))


def files_of(d: DataFrame) -> DataFrame:
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(F.col("doc_id").alias("id"), path.alias("path"), F.sha1("text").alias("sha1"), F.col("lang").alias("language"), F.octet_length("text").cast("long").alias("size_bytes"), "text")


FILES = """files AS (SELECT doc_id AS id, source || '/' || lang || '/' || doc_id || '.txt' AS path, sha1(text) AS sha1, lang AS language,
  strlen(text) AS size_bytes, text FROM documents)"""


def documents_as_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_symbols(table(spark, sf_dir, "documents"))


def spark_symbols(d: DataFrame) -> DataFrame:
    kind = F.when(F.col("lang") == "en", "function").when(F.col("lang") == "fr", "method").when(F.col("lang") == "de", "class").otherwise("constant")
    scope = F.when(F.col("doc_id") % 3 == 0, "global").when(F.col("doc_id") % 3 == 1, "class").otherwise("local")
    parent = F.concat("source", F.lit("."), "lang")
    return d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("name"), F.concat(parent, F.lit(".doc"), F.col("doc_id").cast("string")).alias("qualname"), kind.alias("kind"), scope.alias("scope"),
        F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"), F.lit(1).alias("line_start"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).alias("line_end"), parent.alias("parent_qualname"), F.lit("").alias("docstring"), F.col("text").alias("snippet"),
    )


DOC_SYMBOLS = r"""symbols AS (SELECT doc_id AS id, source AS name, source || '.' || lang || '.doc' || doc_id AS qualname,
  CASE lang WHEN 'en' THEN 'function' WHEN 'fr' THEN 'method' WHEN 'de' THEN 'class' ELSE 'constant' END AS kind,
  CASE doc_id % 3 WHEN 0 THEN 'global' WHEN 1 THEN 'class' ELSE 'local' END AS scope,
  source || '/' || lang || '/' || doc_id || '.txt' AS file, 1 AS line_start,
  (length(text) - length(replace(text, chr(10), '')) + 1)::INTEGER AS line_end, source || '.' || lang AS parent_qualname, '' AS docstring, text AS snippet FROM documents)"""


def places_as_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, suppliers and customers as nested symbols, and parts, whose qualnames repeat."""
    r, n, s, c, p = (table(spark, sf_dir, x) for x in ("region", "nation", "supplier", "customer", "part"))
    rn = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    nation = F.concat("r_name", F.lit("."), "n_name")
    folder = F.concat("r_name", F.lit("/"), "n_name")

    def rows(df, id_, name, qualname, kind, scope, file, line, parent):
        return df.select(id_.cast("long").alias("id"), name.alias("name"), qualname.alias("qualname"), F.lit(kind).alias("kind"), F.lit(scope).alias("scope"), file.alias("file"), line.cast("int").alias("line_start"), (line + 9 + line % 7).cast("int").alias("line_end"), parent.alias("parent_qualname"))

    of_region = rows(r, F.col("r_regionkey"), F.col("r_name"), F.col("r_name"), "class", "global", F.col("r_name"), F.col("r_regionkey") + 1, F.lit(""))
    of_nation = rows(rn, F.col("n_nationkey") + 100, F.col("n_name"), nation, "class", "class", F.col("r_name"), F.col("n_nationkey") * 5 + 10, F.col("r_name"))
    of_supplier = rows(s.join(rn, s["s_nationkey"] == n["n_nationkey"]), F.col("s_suppkey") + 1_000_000_000, F.col("s_name"), F.concat(nation, F.lit("."), "s_name"), "method", "class", folder, F.col("s_suppkey") % 500 + 1, nation)
    of_customer = rows(c.join(rn, c["c_nationkey"] == n["n_nationkey"]), F.col("c_custkey") + 2_000_000_000, F.col("c_name"), F.concat(nation, F.lit("."), "c_name"), "function", "class", folder, F.col("c_custkey") % 2000 + 1, nation)
    of_part = rows(p, F.col("p_partkey") + 4_000_000_000, F.col("p_brand"), F.concat("p_brand", F.lit("."), "p_type"), "variable", "global", F.col("p_brand"), F.col("p_partkey") % 900 + 1, F.col("p_brand"))
    return of_region.union(of_nation).union(of_supplier).union(of_customer).union(of_part)


PLACES = """rn AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey), raw AS (
  SELECT r_regionkey::BIGINT AS id, r_name AS name, r_name AS qualname, 'class' AS kind, 'global' AS scope, r_name AS file, r_regionkey + 1 AS l, '' AS parent_qualname FROM region
  UNION ALL SELECT n_nationkey + 100, n_name, r_name || '.' || n_name, 'class', 'class', r_name, n_nationkey * 5 + 10, r_name FROM rn
  UNION ALL SELECT s_suppkey + 1000000000, s_name, r_name || '.' || n_name || '.' || s_name, 'method', 'class', r_name || '/' || n_name, s_suppkey % 500 + 1, r_name || '.' || n_name FROM supplier JOIN rn ON s_nationkey = n_nationkey
  UNION ALL SELECT c_custkey + 2000000000, c_name, r_name || '.' || n_name || '.' || c_name, 'function', 'class', r_name || '/' || n_name, c_custkey % 2000 + 1, r_name || '.' || n_name FROM customer JOIN rn ON c_nationkey = n_nationkey
  UNION ALL SELECT p_partkey + 4000000000, p_brand, p_brand || '.' || p_type, 'variable', 'global', p_brand, p_partkey % 900 + 1, p_brand FROM part
), symbols AS (SELECT id, name, qualname, kind, scope, file, l::INTEGER AS line_start, (l + 9 + l % 7)::INTEGER AS line_end, parent_qualname FROM raw)"""


def trade_as_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges among places: nations inherit regions, customers call suppliers by bare name and refer to nations and orders."""
    r, n, s, c, o = (table(spark, sf_dir, x) for x in ("region", "nation", "supplier", "customer", "orders"))
    rn = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    nation = F.concat("r_name", F.lit("."), "n_name")
    customers = c.join(rn, c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", nation.alias("nation"), F.concat(nation, F.lit("."), "c_name").alias("q"))

    def rows(df, source, target, kind):
        return df.select(source.alias("from_qualname"), target.alias("to_qualname"), F.lit(kind).alias("kind"))

    return (
        rows(rn, nation, F.col("r_name"), "inherit")
        .union(rows(customers, F.col("q"), F.col("nation"), "reference"))
        .union(rows(customers.join(s, F.col("c_custkey") % 100 == F.col("s_suppkey")), F.col("q"), F.col("s_name"), "call"))
        .union(rows(o.join(customers, o["o_custkey"] == customers["c_custkey"]), F.col("q"), F.concat(F.lit("order."), F.col("o_orderkey").cast("string")), "reference"))
    )


TRADE = """customers AS (SELECT c_custkey, r_name || '.' || n_name AS nation, r_name || '.' || n_name || '.' || c_name AS q FROM customer JOIN rn ON c_nationkey = n_nationkey), edges AS (
  SELECT r_name || '.' || n_name AS from_qualname, r_name AS to_qualname, 'inherit' AS kind FROM rn
  UNION ALL SELECT q, nation, 'reference' FROM customers
  UNION ALL SELECT q, s_name, 'call' FROM customers JOIN supplier ON c_custkey % 100 = s_suppkey
  UNION ALL SELECT q, 'order.' || o_orderkey, 'reference' FROM orders JOIN customers ON o_custkey = c_custkey)"""

RESOLVED = """known AS (SELECT DISTINCT qualname FROM symbols), tried AS (
  SELECT e.*, k.qualname IS NOT NULL AS exact, CASE WHEN k.qualname IS NULL AND NOT contains(to_qualname, '.') AND to_qualname <> '' AND contains(from_qualname, '.')
    THEN regexp_extract(from_qualname, '^(.*\\.)[^.]*$', 1) || to_qualname END AS candidate FROM edges e LEFT JOIN known k ON k.qualname = to_qualname
), resolved AS (SELECT from_qualname, CASE WHEN k.qualname IS NOT NULL THEN candidate ELSE to_qualname END AS to_qualname, kind, exact OR k.qualname IS NOT NULL AS resolved
  FROM tried LEFT JOIN known k ON k.qualname = candidate), first AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qualname ORDER BY file, line_start, id) AS rn FROM symbols) WHERE rn = 1)""".replace("\\\\", "\\")


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct identifier-like strings of all tables (x)."""
    columns = (("nation", "n_name"), ("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name"), ("part", "p_type"), ("part", "p_brand"), ("events", "event_type"), ("documents", "source"))
    out = None
    for name, column in columns:
        one = table(spark, sf_dir, name).select(F.col(column).alias("x")).distinct()
        out = one if out is None else out.union(one)
    return out.distinct()


IDENTIFIERS = """ids AS (SELECT n_name AS x FROM nation UNION SELECT c_name FROM customer UNION SELECT s_name FROM supplier UNION SELECT p_name FROM part
  UNION SELECT p_type FROM part UNION SELECT p_brand FROM part UNION SELECT event_type FROM events UNION SELECT source FROM documents)"""


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", "html")


#: Lines of a Python file about a customer; {k} is its key.
SOURCE = """import os
from shop.base import Account as Base, fee

LIMIT = 10
class Customer{k}(Base):
    \'\'\'Holds {k}.\'\'\'
    rate = 1
    def pay(self, amount: int, *rest, when=None):
        total, left = fee(amount), 0
        return os.sum(total)
def open{k}(x):
    return check(x)
"""


def customers_as_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): a Python file for each customer, every tenth with a syntax error."""
    k = F.col("c_custkey").cast("string")
    text = F.replace(F.lit(SOURCE), F.lit("{k}"), k)
    path = F.concat(F.lit("shop/n"), F.col("c_nationkey").cast("string"), F.lit("/c"), k, F.lit(".py"))
    return table(spark, sf_dir, "customer").select(path.alias("path"), F.concat(text, F.when(F.col("c_custkey") % 10 == 0, "def (").otherwise("")).alias("text"))


SOURCES = "src AS (SELECT c_custkey AS k, 'shop/n' || c_nationkey || '/c' || c_custkey || '.py' AS file, 'shop.n' || c_nationkey || '.c' || c_custkey AS m FROM customer)"
#: (name, within the module or below, kind, scope, first and last line, parent) of each symbol, as SQL.
SOURCE_SYMBOLS = """(VALUES ('os', '', 'import', 'global', 1, 1), ('Base', '', 'import', 'global', 2, 2), ('fee', '', 'import', 'global', 2, 2), ('LIMIT', '', 'constant', 'global', 4, 4),
  ('Customer#', '', 'class', 'global', 5, 10), ('rate', '.Customer#', 'variable', 'class', 7, 7), ('pay', '.Customer#', 'method', 'class', 8, 10),
  ('self', '.Customer#.pay', 'variable', 'param', 8, 8), ('amount', '.Customer#.pay', 'variable', 'param', 8, 8), ('rest', '.Customer#.pay', 'variable', 'param', 8, 8), ('when', '.Customer#.pay', 'variable', 'param', 8, 8),
  ('total', '.Customer#.pay', 'variable', 'local', 9, 9), ('left', '.Customer#.pay', 'variable', 'local', 9, 9),
  ('open#', '', 'function', 'global', 11, 12), ('x', '.open#', 'variable', 'param', 11, 11)) v(name, parent, kind, scope, line_start, line_end)"""
SOURCE_EDGES = """(VALUES ('', 'os', 'import'), ('', 'shop.base.Account', 'import'), ('', 'shop.base.fee', 'import'), ('.Customer#', 'Base', 'inherit'),
  ('.Customer#.pay', 'fee', 'call'), ('.Customer#.pay', 'fee', 'reference'), ('.Customer#.pay', 'os.sum', 'call'), ('.Customer#.pay', 'os', 'reference'), ('.open#', 'check', 'call')) v(source, target, kind)"""


#: By language: extension, module as SQL, text of a file about a part, and its symbols below the module as
#: (suffix, kind, first and last line); # is the part's key.
LANGUAGE_FILES = {
    "java": (".java", "'shop.parts'", "package shop.parts;\nimport java.util.List;\nclass Part# extends Base {\n  int price(List<String> notes) {\n    return ask(notes);\n  }\n}\n", [("List", "import", 2, 2), ("Part#", "class", 3, 7), ("Part#.price", "method", 4, 6), ("Part#.price.notes", "variable", 4, 4)]),
    "csharp": (".cs", "'Shop.Parts'", "using System.Text;\nnamespace Shop.Parts {\n  class Part# : Base {\n    int Price(string note) {\n      return Ask(note);\n    }\n  }\n}\n", [("Text", "import", 1, 1), ("Part#", "class", 3, 7), ("Part#.Price", "method", 4, 6), ("Part#.Price.note", "variable", 4, 4)]),
    "ts": (".ts", "'parts.p' || k", "import { ask } from './shop';\nclass Part# extends Base {\n  price(note: string): number {\n    return ask(note);\n  }\n}\n", [("ask", "import", 1, 1), ("Part#", "class", 2, 6), ("Part#.price", "method", 3, 5), ("Part#.price.note", "variable", 3, 3)]),
    "go": (".go", "'parts'", "package parts\nimport \"fmt\"\ntype Part# struct {\n  n int\n}\nfunc (p *Part#) Price(note string) int {\n  return fmt.Ask(note)\n}\n", [("fmt", "import", 2, 2), ("Part#", "class", 3, 5), ("Part#.Price", "method", 6, 8), ("Part#.Price.note", "variable", 6, 6)]),
    "rust": (".rs", "'parts.p' || k", "use std::fmt;\nstruct Part# {\n  n: u8\n}\nimpl Part# {\n  fn price(&self) -> u8 {\n    ask(self.n)\n  }\n}\n", [("fmt", "import", 1, 1), ("Part#", "class", 2, 4), ("Part#.price", "method", 6, 8), ("Part#.price.self", "variable", 6, 6)]),
    "cpp": (".cpp", "'parts.p' || k", "#include <shop/base.h>\nnamespace shop {\nclass Part# : public Base {\n  int price(int note) const {\n    return ask(note);\n  }\n};\n}\n", [("base", "import", 1, 1), ("shop.Part#", "class", 3, 7), ("shop.Part#.price", "method", 4, 6), ("shop.Part#.price.note", "variable", 4, 4)]),
}


def parts_as_sources(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """(path, text): a file for each part in a language."""
    extension, _, text, _ = LANGUAGE_FILES[language]
    k = F.col("p_partkey").cast("string")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("parts/p"), k, F.lit(extension)).alias("path"), F.replace(F.lit(text), F.lit("#" if language != "cpp" else "Part#"), k if language != "cpp" else F.concat(F.lit("Part"), k)).alias("text"))


def parts_sql(language: str) -> str:
    extension, module, _, symbols = LANGUAGE_FILES[language]
    rows = ", ".join(f"('{q}', '{kind}', {a}, {b})" for q, kind, a, b in symbols)
    return f"SELECT 'parts/p' || k || '{extension}' AS file, {module} || '.' || replace(suffix, '#', k::VARCHAR) AS qualname, kind, line_start, line_end FROM (SELECT p_partkey AS k FROM part) CROSS JOIN (VALUES {rows}) v(suffix, kind, line_start, line_end)"
