"""Column functions over identifiers, texts and paths, all built in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Borders inside an identifier: lower to upper case, before the last capital of a run, letters and digits, underscores.
BORDERS = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{L})(?=\p{Nd})|(?<=\p{Nd})(?=\p{L})|_"
#: Weights of the fields of a symbol in its token list (fixed values).
WEIGHTS = {"name": 4.0, "qualname": 3.0, "docstring": 1.0, "snippet": 0.5}

#: Kinds of symbols and edges, and scopes (fixed values).
SYMBOL_KINDS = ("function", "method", "class", "variable", "import", "constant")
SCOPES = ("global", "class", "local", "param")
EDGE_KINDS = ("call", "import", "inherit", "reference")

#: File extension -> language (fixed values).
LANGUAGES = {
    ".py": "python", ".js": "js", ".jsx": "js", ".mjs": "js", ".cjs": "js", ".ts": "ts", ".tsx": "tsx", ".java": "java", ".cs": "csharp",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c++": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".go": "go", ".rs": "rust",
}
#: The narrower map of the tree walk (fixed values).
WALK_LANGUAGES = {".py": "python", ".ts": "ts", ".tsx": "ts", ".js": "ts", ".jsx": "ts", ".mjs": "ts", ".cjs": "ts", ".go": "go", ".rs": "rust"}


def split_camel(name: Column) -> Column:
    """Lower-cased parts of an identifier, in order, without empty ones."""
    return F.filter(F.transform(F.split(name, BORDERS), F.lower), lambda x: x != "")


def split_identifier(name: Column) -> Column:
    """Distinct parts of at least two characters, after the whole identifier in lower case; empty for no identifier."""
    whole = F.lower(name)
    parts = F.filter(split_camel(name), lambda x: F.length(x) >= 2)
    return F.when(F.coalesce(name, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(whole), parts)))


def split_text_raw(text: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{Nd}_]+"), lambda x: x != "")


def split_text(text: Column) -> Column:
    """The runs in lower case, those of at least two characters, repeats included."""
    runs = F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{Nd}_]+")
    return F.filter(F.transform(runs, F.lower), lambda x: F.length(x) >= 2)


def text_runs(text: Column) -> Column:
    """The runs in lower case, as split_text() has them, but empty ones and those of one character are still there.

    A text is put in lower case at once, but for texts where that may move a border: with a letter whose lower case has two
    characters or depends on its neighbours, or with one that is newer than the classes of letters. These go run by run.
    """
    text = F.coalesce(text, F.lit(""))
    odd = (F.octet_length(text) > F.length(text)) & text.rlike(r"[\u0130\u03a3\p{Cn}]")
    return F.when(odd, F.transform(F.split(text, r"[^\p{L}\p{Nd}_]+"), F.lower)).otherwise(F.split(F.lower(text), r"[^\p{L}\p{Nd}_]+"))


def tokenize_query(query: Column) -> Column:
    """Distinct parts of all identifiers in a query, in order."""
    return F.array_distinct(F.flatten(F.transform(split_text_raw(query), split_identifier)))


def token_lists(name: Column, qualname: Column, docstring: Column, snippet: Column) -> dict[str, Column]:
    """The tokens of each field of a symbol, repeats included."""
    segments = F.array_distinct(F.flatten(F.transform(F.filter(F.split(F.coalesce(qualname, F.lit("")), r"\."), lambda x: x != ""), split_identifier)))
    return {"name": split_identifier(name), "qualname": segments, "docstring": split_text(docstring), "snippet": split_text(snippet)}


def symbol_tokens(name: Column, qualname: Column, docstring: Column, snippet: Column) -> Column:
    """All postings of a symbol as an array of (token, field, weight), repeats included."""

    def postings(field: str, tokens: Column) -> Column:
        return F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(field).alias("field"), F.lit(WEIGHTS[field]).alias("weight")))

    return F.concat(*[postings(field, tokens) for field, tokens in token_lists(name, qualname, docstring, snippet).items()])


def checked(value: Column, known: tuple[str, ...], what: str) -> Column:
    """The value, if it is a known one; any other, null included, ends the query with an error that names it."""
    return F.when(value.isin(*known), value).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(value, F.lit("null")))).cast("string"))


def glob_to_like(glob: str) -> str:
    """A LIKE pattern (escape character backslash): ``*`` and ``**`` any text, ``?`` one character."""
    out, star = "", False
    for c in glob:
        if c == "*":
            out += "" if star else "%"
        else:
            out += "_" if c == "?" else f"\\{c}" if c in "%_\\" else c
        star = c == "*"
    return out


def like_pattern(glob: Column) -> Column:
    """The same for a column of globs."""
    return F.translate(F.regexp_replace(escape_like(glob), r"\*+", "%"), "?", "_")


def comma_list(text: Column) -> Column:
    """Trimmed parts of a comma-separated list, without blanks."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def escape_like(text: Column) -> Column:
    return F.regexp_replace(text, r"([%_\\])", r"\\$1")


def prefix_match(text: Column, term: Column) -> Column:
    """Whether a text begins with a term, whatever wildcards of LIKE the term holds."""
    return F.like(text, F.concat(escape_like(term), F.lit("%")))


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.[^./]+$", 0)


def _lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(""))


def detect_language(path: Column) -> Column:
    return _lookup(extension(path), LANGUAGES)


def walk_language(path: Column) -> Column:
    return _lookup(extension(F.lower(path)), WALK_LANGUAGES)


def line_count(text: Column) -> Column:
    """Lines of a text; the last one counts without a line feed too, and an empty text has one."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    return F.greatest(feeds + F.when(text.endswith("\n"), 0).otherwise(1), F.lit(1))


def first_lines(text: Column, n: int = 10) -> Column:
    return F.substring_index(text, "\n", n)


def snippet(text: Column, n: int = 10) -> Column:
    """The first n lines, and an ellipsis line where there are more."""
    return F.when(F.size(F.split(text, "\n")) > n, F.concat(first_lines(text, n), F.lit("\n…"))).otherwise(text)


def module_name(path: Column, language: Column | None = None, clause: Column | None = None) -> Column:
    """Dotted module of a path in a language; ``clause`` is the package or namespace that its file declares.

    Paths become dots without their extension. Python drops a trailing package marker, Rust its crate and module files
    (an empty rest is ``crate``), Java and C# take the clause where there is one, C++ puts it behind, Go takes the folder,
    else the clause, else ``main``, and other files are known by their base name. No language stands for Python.
    """
    clause = F.coalesce(clause, F.lit("")) if clause is not None else F.lit("")
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")
    dots = F.replace(F.regexp_replace(plain, r"\.[^./]*$", ""), F.lit("/"), F.lit("."))
    python = F.regexp_replace(dots, r"\.__init__$", "")
    if language is None:
        return python
    rust = F.regexp_replace(F.regexp_replace(F.regexp_replace(dots, r"\.mod$", ""), r"\.main$", ""), r"\.lib$", "")
    folder = F.replace(F.regexp_extract(plain, r"^(.*)/[^/]*$", 1), F.lit("/"), F.lit("."))
    return (
        F.when(language == "python", python)
        .when(language.isin("js", "ts", "tsx"), dots)
        .when(language.isin("java", "csharp"), F.when(clause != "", clause).otherwise(dots))
        .when(language == "cpp", F.when(clause != "", F.concat(dots, F.lit("."), clause)).otherwise(dots))
        .when(language == "go", F.when(~folder.isin("", "."), folder).when(clause != "", clause).otherwise("main"))
        .when(language == "rust", F.when(rust == "", "crate").otherwise(rust))
        .otherwise(F.substring_index(plain, "/", -1))
    )


def is_identifier(text: Column, more: str = "") -> Column:
    """A letter or underscore, then letters, digits and underscores; characters in ``more``, such as ``$``, count as letters."""
    also = "".join(f"\\{c}" for c in more)
    return F.coalesce(text.rlike(rf"^[\p{{L}}_{also}][\p{{L}}\p{{Nd}}_{also}]*\z"), F.lit(False))


def is_all_caps(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^_?[\p{Lu}\p{Nd}_]+$") & text.rlike(r"\p{Lu}"), F.lit(False))


def clean_docstring(text: Column) -> Column:
    """Quotes of one style stripped from both ends, white space trimmed and collapsed."""
    bare = F.regexp_replace(F.trim(text), r'(?s)^("""|\'\'\'|"|\')(.*)\1$', "$2")
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


def clean_comment(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*(//[/!]?|#+|/\*+|\*+/|\*)", " "), r"[ \t\r\n]+", " "))


def last_path_segment(path: Column) -> Column:
    last = F.trim(F.substring_index(path, "::", -1))
    return F.when(last.rlike(r"[{},]"), "").otherwise(last)


def parse_target(target: Column) -> Column:
    """(file, line) of a target FILE:LINE with a line above zero, else nulls, which is a qualname."""
    file, line = F.regexp_extract(target, r"(?s)^(.+):([0-9]{1,9})$", 1), F.regexp_extract(target, r"(?s)^(.+):([0-9]{1,9})$", 2)
    number = F.when(line != "", line).cast("int")
    return F.struct(F.when(number > 0, file).alias("file"), F.when(number > 0, number).alias("line"))


def body(text: Column, start: Column, end: Column, limit: int = 0) -> Column:
    """Lines start to end (from 1 on, inclusive) of a text, with an ellipsis line after ``limit`` of them; null for no range.

    An end beyond the text is its last line; a start below 1, beyond the text or behind the end gives null.
    """
    lines = F.split(text, "\n")
    length = F.least(end, F.size(lines)) - start + 1
    taken = F.least(length, F.lit(limit)) if limit else length
    found = F.array_join(F.slice(lines, start, taken), "\n")
    found = F.concat(found, F.when(length > limit, F.lit("\n…")).otherwise("")) if limit else found
    return F.when((start >= 1) & (length >= 1), found)


def relative_path(root: Column, path: Column) -> Column:
    """path from root on, with forward slashes; ``.`` for root itself, null for a path that is not under it.

    Backslashes are slashes, and parts ``.`` and ``..`` are resolved first.
    """
    root, path = clean_path(root), clean_path(path)
    base = F.when(root == "/", root).otherwise(F.concat(root, F.lit("/")))
    return F.when(path == root, ".").when(F.startswith(path, base), F.substr(path, F.length(base) + 1))


def clean_path(path: Column) -> Column:
    """An absolute path without repeated slashes, ``.`` and ``..``."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", "."))
    up = lambda out: F.when(F.size(out) > 0, F.slice(out, 1, F.size(out) - 1)).otherwise(out)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda out, x: F.when(x == "..", up(out)).otherwise(F.concat(out, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def read_hint(file: Column, start: Column, end: Column) -> Column:
    """How to read all of a symbol's body; a range that ends before it starts has one line."""
    count = F.greatest(end - start + 1, F.lit(1))
    return F.format_string("hint:     full body via Read %s offset=%d limit=%d (%d lines)", file, start, count, count)


def timestamp_text(at: Column) -> Column:
    """A UTC time to the second, ``(never)`` for none."""
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("(never)"))


def parse_timestamp(text: Column) -> Column:
    """The time of such a text, null for any other."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssX"))


def staleness(version: Column, expected: int) -> Column:
    """Why an index of a version has to be built anew; empty where it need not. 0 and null stand for no version."""
    return (
        F.when(F.coalesce(version, F.lit(0)) == 0, F.lit(f"index predates versions, reindex to get version {expected}"))
        .when(version == expected, "")
        .otherwise(F.format_string(f"index version %d, expected {expected}, reindex to refresh", version))
    )


def null_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))
