"""Symbols and edges of languages with braces, from one pattern table: definitions, parameters, imports, bases and calls.

Comments and strings are blanked first. What stands before each opening brace is a head; heads of types and functions
open a scope, all others belong to the scope around them. Functions inside functions make no symbols, and their calls
belong to the function around them. Fields and local variables are not extracted.
"""

from __future__ import annotations

import bisect
import re

BLANKED = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|'(?:\\.[^'\n]*|[^'\\\n])'", re.S)
CALL = re.compile(r"([A-Za-z_$][\w$]*(?:(?:\.|::)[A-Za-z_$][\w$]*)*!?)\s*\(")
#: Words that look like calls or functions but are neither.
KEYWORDS = frozenset("if for while switch catch return else new do try match func fn function using lock foreach synchronized sizeof typeof super await throw defer go select case".split())
PLAIN = r"(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^<>]*>)?\s*\((?P<params>[^{}]*?)\)"
TYPE = r"\b(?:class|interface|enum|record|struct)\s+(?P<name>\w+)(?P<bases>[^{};]*)$"

#: Patterns by language, over the end of a head, and for imports over lines; ``first``: parameter names come first.
PATTERNS = {
    "java": dict(types=[TYPE], functions=[rf"[\w>\]]\s+{PLAIN}\s*(?:throws[\w\s,.]*)?$", rf"(?:^|[\s]){PLAIN}\s*$"], imports=r"^\s*import\s+(?:static\s+)?(?P<target>[\w.]+)\s*;", first=False),
    "csharp": dict(types=[TYPE], functions=[rf"[\w>\]?]\s+{PLAIN}\s*(?:where[^{{}}]*)?(?::\s*(?:base|this)\s*\([^()]*\)\s*)?$"], imports=r"^\s*using\s+(?:static\s+)?(?P<target>[\w.]+)\s*;", first=False),
    "ts": dict(
        types=[TYPE],
        functions=[rf"\bfunction\s*\*?\s*{PLAIN}[^(){{}};]*$", r"\b(?:const|let|var)\s+(?P<name>[\w$]+)[^=;]*=\s*(?:async\s*)?\((?P<params>[^{}]*?)\)[^(){};=]*=>\s*$", rf"(?:^|[\s]){PLAIN}\s*(?::[^(){{}};=]*)?$"],
        imports=r"^\s*import\s[^'\"\n]*?(?P<alias>[\w$]+)?\s*\}?\s*from\s*['\"](?P<target>[^'\"\n]+)['\"]", first=True,
    ),
    "go": dict(
        types=[r"\btype\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+(?:struct|interface)\s*(?P<bases>)$"],
        functions=[r"\bfunc\s*(?:\(\s*(?:\w+\s+)?\*?(?P<owner>\w+)[^()]*\)\s*)?(?P<name>\w+)(?:\[[^\]]*\])?\s*\((?P<params>[^{}]*?)\)[^{};]*$"],
        imports=r"^\s*(?:import\s+)?(?P<alias>[\w.]+\s)?\s*\"(?P<target>[\w./-]+)\"\s*$", first=True,
    ),
    "rust": dict(
        types=[r"\b(?:struct|enum|union|trait)\s+(?P<name>\w+)(?P<bases>[^{};]*)$", r"\bimpl\b\s*(?:<[^<>]*>)?\s*(?:(?P<bases>[\w:]+)(?:<[^<>]*>)?\s+for\s+)?(?P<impl>\w+)(?:<[^<>]*>)?[^{};]*$"],
        functions=[r"\bfn\s+(?P<name>\w+)\s*(?:<[^<>]*>)?\s*\((?P<params>[^{}]*?)\)[^{};]*$"], imports=r"^\s*(?:pub\s+)?use\s+(?P<target>[\w:]+)\s*;", first=True,
    ),
    "cpp": dict(
        types=[r"\b(?:class|struct)\s+(?P<name>\w+)(?P<bases>[^{};()]*)$"],
        functions=[r"(?:^|[\s*&])(?:(?P<owner>\w+)::)?(?P<name>~?\w+)\s*\((?P<params>[^{}]*?)\)\s*(?:const|noexcept|override|final|\s)*(?::[^{};]*)?$"],
        imports=r"^\s*#\s*include\s*[<\"](?P<target>[^>\"\n]+)[>\"]", first=False,
    ),
}
NAMESPACE = re.compile(r"\bnamespace\s+([\w:]+)\s*$")
NOT_BASES = frozenset("extends implements where public private protected virtual final sealed partial".split())


def module_of(language: str, path: str, source: str) -> str:
    """The module that qualnames begin with: of the path, or of the package that a file names."""
    dotted = re.sub(r"\.[^./]+$", "", path).replace("/", ".")
    if language == "java":
        named = re.search(r"^\s*package\s+([\w.]+)\s*;", source, re.M)
        return named[1] if named else dotted
    if language == "csharp":
        return (re.findall(r"^\s*namespace\s+([\w.]+)", source, re.M) or [dotted])[-1]
    if language == "go":
        named = re.search(r"^\s*package\s+(\w+)", source, re.M)
        return ".".join(path.split("/")[:-1]) or (named[1] if named else "main")
    if language == "rust":
        return re.sub(r"(^|\.)(mod|main|lib)$", "", dotted) or "crate"
    return dotted


def _blank(match: re.Match) -> str:
    return re.sub(r"[^\n]", " ", match[0])


def _names(params: str, first: bool) -> list[str]:
    """Names of a parameter list, split at commas outside brackets."""
    flat = params
    for _ in range(8):  # nested type arguments, innermost first
        less = re.sub(r"<[^<>]*>|\[[^\[\]]*\]|\([^()]*\)", "", flat)
        if less == flat:
            break
        flat = less
    out = []
    for part in flat.split(","):
        words = re.findall(r"[A-Za-z_$][\w$]*", part.split("=")[0].split(":")[0] if first else part.split("=")[0])
        words = [w for w in words if w not in ("mut", "readonly", "public", "private", "protected")]
        if words:
            out.append(words[0] if first else words[-1])
    return out


def parse_braces(language: str, module: str, source: str) -> tuple[list[dict], list[dict]]:
    """Symbols and edges of one file; unbalanced braces end with the file."""
    spec, text = PATTERNS[language], BLANKED.sub(_blank, source)
    lines = source.split("\n")
    symbols, edges = [], []
    starts = [0] + [m.end() for m in re.finditer("\n", text)]

    def line(at: int) -> int:
        return bisect.bisect_right(starts, at)

    def symbol(name, kind, scope, parent, at):
        row = dict(name=name, qualname=f"{parent or module}.{name}", kind=kind, scope=scope, line_start=line(at), line_end=line(at), parent_qualname=parent, docstring="", snippet=lines[line(at) - 1])
        symbols.append(row)
        return row

    def edge(source_name, target, kind):
        edges.append(dict(from_qualname=source_name, to_qualname=target, kind=kind))

    for m in re.finditer(spec["imports"], source, re.M):
        target = m["target"]
        alias = (m.groupdict().get("alias") or "").strip()
        name = alias or target.split("/")[-1].split(".")[0] if language == "cpp" else alias or re.split(r"[./:]+", target.rstrip("./:"))[-1]
        edge(module, target, "import")
        if name not in ("_", "."):
            symbol(name, "import", "global", "", m.start("target"))

    scopes = [("module", "", None)]  # (what, qualname, its symbol)
    begin, depth = 0, 0
    for m in re.finditer(r"[{};()]", text):
        c = m[0]
        depth = max(0, depth + (c == "(") - (c == ")"))
        if c in "()" or c == ";" and depth:
            continue
        what, parent, _ = scopes[-1]
        head, at, begin = text[begin : m.start()], begin, m.end()
        if what == "function":
            for call in CALL.finditer(head):
                if call[1] not in KEYWORDS:
                    edge(parent, call[1], "call")
        if c == "}":
            if len(scopes) > 1:
                row = scopes.pop()[2]
                if row and scopes[-1][2] is not row:
                    row["line_end"] = line(m.start())
                    row["snippet"] = "\n".join(lines[row["line_start"] - 1 : row["line_end"]][:10] + ["…"] * (row["line_end"] - row["line_start"] >= 10))
            depth = 0
        elif c == "{":
            opened = scopes[-1]
            space = NAMESPACE.search(head) if language == "cpp" else None
            if space:
                opened = ("module", f"{parent or module}.{space[1].replace('::', '.')}", None)
            elif what != "function":
                inside = "class" if what == "type" else "global"
                kind = next((x for x in (re.search(p, head) for p in spec["types"]) if x), None)
                call = None if kind else next((x for x in (re.search(p, head) for p in spec["functions"]) if x and x["name"] not in KEYWORDS), None)
                if kind:
                    g = kind.groupdict()
                    if g.get("name"):
                        row = symbol(g["name"], "class", inside, parent, at + kind.start("name"))
                        own = row["qualname"]
                    else:
                        row, own = None, f"{module}.{g['impl']}"
                    for base in re.findall(r"[A-Za-z_][\w.:]*", re.sub(r"<[^<>]*>", "", g.get("bases") or "")):
                        if base not in NOT_BASES:
                            edge(own, base.strip(":"), "inherit")
                    opened = ("type", own, row)
                elif call:
                    of = call.groupdict().get("owner")
                    owner, inside = (f"{parent or module}.{of}", "class") if of else (parent, inside)
                    row = symbol(call["name"], "method" if inside == "class" else "function", inside, owner, at + call.start("name"))
                    for name in _names(call["params"], spec["first"]):
                        symbol(name, "variable", "param", row["qualname"], at + call.start("params"))
                    opened = ("function", row["qualname"], row)
            scopes.append(opened)
            depth = 0
    return symbols, edges
