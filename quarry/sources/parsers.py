"""Symbols and edges out of source texts: one row per file in, its rows out; Spark spreads the files."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as t
from quarry.sources.braces import PATTERNS, module_of, parse_braces

#: Languages that share the patterns of another.
SAME = {"js": "ts", "tsx": "ts"}

SYMBOL = "name string, qualname string, kind string, scope string, line_start int, line_end int, parent_qualname string, docstring string, snippet string"
EDGE = "from_qualname string, to_qualname string, kind string"
PARSED = f"file string, error string, symbols array<struct<{SYMBOL.replace(' ', ':').replace(',:', ',')}>>, edges array<struct<{EDGE.replace(' ', ':').replace(',:', ',')}>>"

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
ASSIGNED = (ast.Assign, ast.AnnAssign)


def _snippet(lines: list[str], first: ast.AST, last: ast.AST, n: int = 10) -> str:
    """Source from the start of one node to the end of another, at most n lines and then an ellipsis."""
    own = lines[first.lineno - 1 : last.end_lineno]
    own[-1] = own[-1].encode()[: last.end_col_offset].decode(errors="ignore")
    own[0] = own[0].encode()[first.col_offset :].decode(errors="ignore")
    return "\n".join(own[:n] + ["…"] * (len(own) > n))


def _all_caps(name: str) -> bool:
    return name.upper() == name and any(c.isupper() for c in name)


def _targets(node: ast.AST) -> list[str]:
    """Names that a statement assigns; of tuples their direct names."""
    out = []
    for target in node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []:
        out += [x.id for x in (target.elts if isinstance(target, ast.Tuple) else [target]) if isinstance(x, ast.Name)]
    return out


def _dotted(node: ast.AST) -> str | None:
    return ast.unparse(node) if isinstance(node, (ast.Name, ast.Attribute)) else None


def _imports(node: ast.AST) -> list[tuple[str, str]]:
    """(name bound here, target) of an import statement; a star binds none."""
    if isinstance(node, ast.Import):
        return [(a.asname or a.name.split(".")[0], a.name) for a in node.names]
    if isinstance(node, ast.ImportFrom):
        source = "." * node.level + (node.module or "")
        return [(a.asname or a.name, f"{source}.{a.name}") for a in node.names if a.name != "*"]
    return []


def _parameters(args: ast.arguments) -> list[tuple[ast.arg, ast.AST]]:
    """Each parameter with the node its text ends at: its default, or itself."""
    plain = args.posonlyargs + args.args
    ends = dict(zip(plain[len(plain) - len(args.defaults) :], args.defaults)) | {k: d for k, d in zip(args.kwonlyargs, args.kw_defaults) if d}
    return [(a, ends.get(a, a)) for a in [*plain, args.vararg, *args.kwonlyargs, args.kwarg] if a]


def _uses(body: list[ast.stmt], imported: set[str]) -> Iterator[tuple[str, str]]:
    """(target, kind) of calls by dotted name, and of imported names that are used as values."""
    for root in body:
        for node in ast.walk(root):
            if isinstance(node, ast.Call) and (name := _dotted(node.func)):
                yield name, "call"
            direct = [node.value, *getattr(node, "targets", [])] if isinstance(node, ASSIGNED) else []
            for child in ast.iter_child_nodes(node):
                if isinstance(child, ast.Name) and child.id in imported and child not in direct:
                    yield child.id, "reference"


def parse_python(module: str, source: str) -> tuple[list[dict], list[dict]]:
    """Symbols and edges of one file. Raises SyntaxError or ValueError where it cannot be parsed.

    Statements of the module itself and of its classes count; decorated definitions, branches and nested definitions
    make no symbols, but calls inside nested definitions belong to the function around them. All parameters count.
    """
    lines, imported = source.split("\n"), set()
    symbols, edges = [], []

    def symbol(node, name, kind, scope, parent, end=None):
        owner = parent or module
        doc = ast.get_docstring(node, clean=False) if isinstance(node, (*FUNCTIONS, ast.ClassDef)) else None
        text = _snippet(lines, node, end or node)
        symbols.append(dict(name=name, qualname=f"{owner}.{name}", kind=kind, scope=scope, line_start=node.lineno, line_end=(end or node).end_lineno, parent_qualname=parent, docstring=" ".join((doc or "").split()), snippet=text))
        return f"{owner}.{name}"

    def edge(source, target, kind):
        edges.append(dict(from_qualname=source, to_qualname=target, kind=kind))

    def members(body, scope, parent):
        for node in body:
            if isinstance(node, FUNCTIONS) and not node.decorator_list:
                own = symbol(node, node.name, "method" if parent else "function", scope, parent)
                for arg, end in _parameters(node.args):
                    symbol(arg, arg.arg, "variable", "param", own, end)
                for inner in node.body:
                    for name in _targets(inner):
                        symbol(inner, name, "variable", "local", own)
                for target, kind in _uses(node.body, imported):
                    edge(own, target, kind)
            elif isinstance(node, ast.ClassDef) and not node.decorator_list and not parent:
                own = symbol(node, node.name, "class", scope, parent)
                for base in filter(None, map(_dotted, node.bases)):
                    edge(own, base, "inherit")
                members(node.body, "class", own)
            elif not parent and (names := _imports(node)):
                for name, target in names:
                    symbol(node, name, "import", scope, parent)
                    imported.add(name)
                    edge(module, target, "import")
            else:
                for name in _targets(node):
                    symbol(node, name, "constant" if not parent and _all_caps(name) else "variable", scope, parent)

    members(ast.parse(source).body, "global", "")
    return symbols, edges


def whole_file(path: str, source: str) -> tuple[list[dict], list[dict]]:
    """The one symbol of a file in no known language."""
    name, lines = path.split("/")[-1], source.split("\n")
    last = max(1, len(lines) - source.endswith("\n"))
    return [dict(name=name, qualname=name, kind="variable", scope="global", line_start=1, line_end=last, parent_qualname="", docstring="", snippet="\n".join(lines[:10]))], []


def parse_file(path: str, language: str, module: str, source: str) -> tuple[list[dict], list[dict]]:
    language = SAME.get(language, language)
    if language == "python":
        return parse_python(module, source)
    if language in PATTERNS:
        return parse_braces(language, module_of(language, path, source), source)
    return whole_file(path, source)


def parse(files: DataFrame) -> DataFrame:
    """(file, error, symbols, edges) for each of files (path, text); the extension tells the language.

    A null text is empty. A file that cannot be parsed has its error and no rows; its old rows stay in an incremental run.
    """

    def work(frames):
        for pdf in frames:
            rows = []
            for path, language, module, source in zip(pdf["path"], pdf["language"], pdf["module"], pdf["text"]):
                error, found = None, ([], [])
                try:
                    found = parse_file(path, language, module, source)
                except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                    error = f"{type(e).__name__}: {e}"
                rows.append((path, error, *found))
            yield pd.DataFrame(rows, columns=["file", "error", "symbols", "edges"])

    path = F.coalesce("path", F.lit(""))
    return files.select(path.alias("path"), t.detect_language(path).alias("language"), t.module_name(path).alias("module"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(work, PARSED)


def symbols_of(parsed: DataFrame) -> DataFrame:
    """Symbols with ids that stay the same while the file does."""
    each = parsed.select("file", F.posexplode("symbols").alias("pos", "s"))
    return each.select(F.xxhash64("file", "pos").alias("id"), "file", "s.*")


def edges_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("file", F.inline("edges"))
