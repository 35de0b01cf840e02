from quarry.sources.braces import parse_braces

CASES = {
    "java": ("""package p;
import java.util.List;
/* class No { } */
public class A<T> extends B implements C {
    int n = 1;
    public A(int k) { this.n = k; }
    List<String> f(Map<String, Integer> m, int... rest) throws E {
        if (n > 0) { for (int i = 0; i < 3; i++) { g("x(", m); } }
        return m.get();
    }
}
""", {("A", "class"), ("A.A", "method"), ("A.A.k", "variable"), ("A.f", "method"), ("A.f.m", "variable"), ("A.f.rest", "variable"), ("List", "import")},
        {("", "java.util.List", "import"), (".A", "B", "inherit"), (".A", "C", "inherit"), (".A.f", "g", "call"), (".A.f", "m.get", "call")}),
    "csharp": ("using System.Text;\nnamespace N { class A : B { public int F(string s) { return Go(s); } } }",
        {("A", "class"), ("A.F", "method"), ("A.F.s", "variable"), ("Text", "import")}, {("", "System.Text", "import"), (".A", "B", "inherit"), (".A.F", "Go", "call")}),
    "ts": ("""import { x } from './lib';
export class A extends B { run(a: number, b?: string): void { x(a); } }
export function f(q: Map<string, number>) { const g = (y) => { h(); }; }
const k = async (z) => { f(z); };
""", {("x", "import"), ("A", "class"), ("A.run", "method"), ("A.run.a", "variable"), ("A.run.b", "variable"), ("f", "function"), ("f.q", "variable"), ("k", "function"), ("k.z", "variable")},
        {("", "./lib", "import"), (".A", "B", "inherit"), (".A.run", "x", "call"), (".f", "h", "call"), (".k", "f", "call")}),
    "go": ("""package main
import (
	"fmt"
	j "encoding/json"
)
type S struct {
	n int
}
func (s *S) Do(a int, b string) error { return fmt.Errorf("{%d", a) }
func main() { s := S{1}; s.Do(1, "x") }
""", {("fmt", "import"), ("j", "import"), ("S", "class"), ("S.Do", "method"), ("S.Do.a", "variable"), ("S.Do.b", "variable"), ("main", "function")},
        {("", "fmt", "import"), ("", "encoding/json", "import"), (".S.Do", "fmt.Errorf", "call"), (".main", "s.Do", "call")}),
    "rust": ("""use std::fmt;
pub struct P<'a> { x: &'a str }
impl<'a> Show for P<'a> { fn show(&self, mut n: u8) -> String { println!("{}", n); helper('{') } }
fn main() { run(); }
""", {("fmt", "import"), ("P", "class"), ("P.show", "method"), ("P.show.self", "variable"), ("P.show.n", "variable"), ("main", "function")},
        {("", "std::fmt", "import"), (".P", "Show", "inherit"), (".P.show", "println!", "call"), (".P.show", "helper", "call"), (".main", "run", "call")}),
}


def test_languages():
    for language, (source, symbols, edges) in CASES.items():
        got, links = parse_braces(language, "m", source)
        assert {(s["qualname"].removeprefix("m."), s["kind"]) for s in got} == symbols, language
        assert {(e["from_qualname"].removeprefix("m"), e["to_qualname"], e["kind"]) for e in links} == edges, language
    lines = {s["qualname"]: (s["line_start"], s["line_end"]) for s in parse_braces("java", "m", CASES["java"][0])[0]}
    assert lines["m.A"] == (4, 11) and lines["m.A.f"] == (7, 10)


def test_broken_files():
    for source in ("", "}}}", "{" * 1000, "class A {", "((((", "class", "'"):
        for language in CASES:
            parse_braces(language, "m", source)
