import ast
import os
import sys

import pytest

from quernel.llm import syntax
from quernel.llm.grammars import LANGUAGES, language
from quernel.llm.peg import Grammar, Tokens

sys.setrecursionlimit(20_000)
VALID = {
    "python": ["", "x = 1\n", 'def f(a, *b, c: int = 3, **d) -> "x":\n    """open ( ["""\n    return [y for y in a if y]\n', "class A(B, metaclass=C):\n  @p\n  async def f(self):\n    async with a as b, c: pass\n", "match x:\n    case [1, *y] if y:\n        pass\n", "a = (1,\n  2)\ntry:\n\tf()\nexcept* E as e:\n\traise X from e\nfinally: pass\n", "x: int = lambda a, *b: a if b else {**c, 'd': 1}\nprint(f'{x!r}', *a, k=v)\n"],
    "rust": ["fn main() {}\n", "pub(crate) fn f<'a, T: X + 'a>(x: &'a mut [T; 3], y: impl Fn(u8) -> u8) -> Result<Vec<Vec<u8>>, E> where T: Y { if let Some(x) = y && z { return x?; } let c = 'x'; match x { A::B { c, .. } | D(1..=3) => {} _ => loop { break 'a 1 } } x as u32 }", '#[derive(A)]\nstruct A<T>(pub T);\nconst X: &str = r#"<<<<<<< HEAD "quoted" "#;\nimpl<T> B for A<T> { type C = D; fn f(&self) { self.0.await; a[1..].b::<C>(|x, y| x + y); vec![1, 2]; } }', "macro_rules! m { ($a:expr) => { $a }; }\nenum E { A = 1, B { c: u8 }, C(d) }\nuse a::{b, c::*, self as d};\n"],
    "typescript": ["export default class A<T> extends B<T> implements C { private readonly x?: Map<string, number[]> = new Map(); get y(): number { return 1 } static async *z() {} }\n", "const f = async <T,>(a: T, { b, ...c }: X = {}): Promise<void> => { for (const [k, v] of a) if (k) continue; else break }\ntype U = A extends infer B ? { [K in keyof B]?: B[K] } : never\n", "const a = `x ${ b + `y` } {`; let r = /[/{]+/g.test(s) ? a?.b?.[1] ?? c : d as E<F>\nexport { a as b } from './c'\ninterface I { (x: number): string; [k: string]: any }\n", 'if(!a){throw new Error("x{")}for(let b=0;b<9;b++){c(b,"d")}var e=(f,g)=>f.h?g:1;function i(j){return j.k(1)+2}i.j=function(k){l=k[1]||null;return{m:l}};\n'],
    "go": ["package a\n\nimport (\n\t\"x\"\n\ty \"z\"\n)\n\nconst (\n\tA = iota\n\tB\n)\n\ntype T[K comparable] struct {\n\tX int `json:\"x\"`\n\t*Y\n}\n\nfunc (t *T[K]) F(a, b int, c ...string) (n int, err error) {\n\tif x, ok := m[k]; ok && x > 1 {\n\t\treturn\n\t} else {\n\t\tgo func() { <-c }()\n\t}\n\tfor i, v := range []int{1, 2} {\n\t\tswitch v := v.(type) {\n\t\tcase int:\n\t\t\tx <- v\n\t\tdefault:\n\t\t}\n\t\t_ = i\n\t}\n\treturn map[string]T{\"a\": {1}}, nil\n}\n"],
    "kotlin": ["package a.b\n\nimport c.d.*\n\ndata class A<T : B>(val x: Int = 1, private var y: String?) : C(x), D by e {\n    companion object { const val Z = \"\"\"{ ( \"\"\" }\n    override fun f(a: Int): List<T> = listOf(1, 2).map { it + 1 }\n        .filter { x -> x > 1 }\n    val g: Int\n        get() = 1\n}\n\nfun main() {\n    val (a, b) = p ?: return\n    for (i in 0 until 10 step 2) { when (i) { 1, 2 -> x(); in 3..4 -> { } else -> throw E(\"x\") } }\n    if (a) b() else c[1]!!.d = e as? F\n}\n"],
    "c": ["#include <x.h>\n#define A(b) \\\n  ((b) + 1)\ntypedef struct a { int b : 3; char *c[4]; } a_t;\nstatic const int t[] = { 1, [2] = 3, 0xffu };\nint (*fp)(int, char *);\nint f(struct a *x, ...) {\n  for (int i = 0; i < 3; i++) { if (x->b) goto end; else switch (i) { case 1: break; default: continue; } }\nend:\n  return (int)sizeof(a_t) + *x->c[0] ? 1 : 'x';\n}\n"],
    "cpp": ["#include <x>\nnamespace a::b {\ntemplate <typename T, int N = 3>\nclass A final : public B<T>, private C {\npublic:\n  explicit A(int x) : y_(x), B<T>{x} {}\n  virtual ~A() = default;\n  const std::vector<std::vector<int>>& f() const override { return v_; }\nprivate:\n  std::map<std::string, int> v_;\n};\n}\nint X::g(const std::string& s) {\n  auto l = [&, x = 1](auto a) -> int { return a < x; };\n  for (const auto& [k, v] : m) { throw E(\"x\"); }\n  return static_cast<int>(s.size()) >> 2;\n}\nenum class E : int { A, B = 2 };\n"],
    "swift": ["import Foundation\n\n@objc public final class A<T: B>: C, D where T: E {\n    private var x: [String: Int]? = nil\n    let y: (Int, String) -> Void\n    init?(_ a: Int, with b: String = \"\\(c(1))\") throws { guard let a = b, a > 1 else { return nil } }\n    var z: Int { get { 1 } set { x = newValue } }\n    func f(_ m: [Int], in n: Int...) async -> Int? {\n        for k in 0..<26 where k > 1 { switch k { case .a(let b), 2...3: break\n        default: fallthrough } }\n        let s = \"\"\"\n        { ( \"\n        \"\"\"\n        return m.map { $0 + 1 }.first ?? (try? await g()) as? Int\n    }\n}\nenum E: Int { case a = 1, b(x: Int) }\n"],
}
INVALID = {
    "python": ["def f(:\n", "x = (1\n", "if a:\nb\n", "  x = 1\n y = 2\n", "x = 01\n", "a = 'b\n", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "def f():\n    return 1\n  }\n"],
    "rust": ["fn f( {", "fn f() { let x = ; }", "import a from b;", "fn f() { x", "=======\nfn f() {}"],
    "typescript": ["const x = ;", "function f() {", "def f(x):\n  return 1\n", "class A { x(: }", "<<<<<<< a\nlet x = 1\n=======\n>>>>>>> b\n", 'x("a'],
    "go": ["package a\nfunc f( {\n}\n", "func f() {}\n", "package a\nimport x from y\n"],
    "kotlin": ["fun f( {\n}\n", "class A {\n fun f() {\n}\n", "def f():\n    pass\n"],
    "c": ["int f( {", "class A { public: int x; };", "int f(void) { return 1 ", "int main() { std::string s; }", "use a::b;"],
    "cpp": ["class A { int x; ", "fn f() -> u8 { 1 }", "int f() { return (1; }"],
    "swift": ["func f( {\n}\n", "let x: = 1\n", "class A {\n", "fun f() {}\n"],
}


@pytest.mark.parametrize("name", sorted(LANGUAGES))
def test_valid_and_invalid(name):
    own = language(name)
    for text in VALID[name] * 2:
        ok, far = own.grammar.parse(own.tokenise(text))
        assert ok, (text, text[own.offset(text, far) :][:60])
    for text in INVALID[name]:
        assert not own.grammar.parse(own.tokenise(text))[0], text


def test_python_agrees_with_the_compiler_on_mutations():
    import random

    rng, own = random.Random(4), language("python")
    for text in VALID["python"]:
        for _ in range(40):
            k = rng.randrange(len(text) + 1)
            cut = text[:k] + rng.choice(["", "(", ")", ":", "\n", "x ", "=", "if "]) + text[k + rng.randrange(3) :]
            try:
                ast.parse(cut)
                want = True
            except (SyntaxError, ValueError):
                want = False
            if want:  # the grammar accepts a superset: what the compiler takes must parse
                assert own.grammar.parse(own.tokenise(cut))[0], cut


def test_fast_and_slow_parsers_agree():
    for name, texts in (VALID | {k: VALID[k] + v for k, v in INVALID.items()}).items():
        own = language(name)
        for text in texts:
            s = own.tokenise(text)
            assert (own.grammar.fast["file"](s + "\0", 0, {-1: 0}) == len(s)) == (own.grammar.slow["file"](s + "\0", 0, {-1: 0}) == len(s)), text


def test_grammar_notation_and_positions():
    g = Grammar("file <- (item ';')* !.\nitem <- IDENT ('.' IDENT)* / '(' item ')'", Tokens("if", "->"))
    assert g.parse("i.i;(i);") == (True, 8)
    assert g.parse("i.i;(i;") == (False, 6)
    with pytest.raises(ValueError):
        Grammar("file <- nothing", Tokens("", ""))


def test_causes():
    assert syntax.parse_source("fn f() {}", "rust") == (True, 9, None)
    assert syntax.parse_source("fn f() { let x", "rust")[2] == "truncated"
    assert syntax.parse_source("fn f() {\n<<<<<<< HEAD\n  a();\n=======\n  b();\n>>>>>>> x\n}", "rust")[2] == "merge_conflict"
    assert syntax.parse_source("def f():\n    pass\n", "go")[2] == "other_format"
    assert syntax.parse_source('{"a": [1, null]}', "go")[2] == "other_format"
    assert syntax.parse_source("fn f() { ) }", "rust")[:2] == (False, 9)
    assert syntax.parse_source("x = " + "(" * 30_000, "python")[0] is False


def test_positions_equal_the_compilers_lines():
    lines = open(syntax.__file__).read().split("\n")
    told = equal = 0
    for k in range(0, len(lines), 3):
        for edit in (lambda x: x + " )", lambda x: x + " = = 3", lambda x: "<<<<<<< HEAD\n" + x):
            text = "\n".join([*lines[:k], edit(lines[k]), *lines[k + 1 :]])
            try:
                ast.parse(text)
            except SyntaxError as e:
                valid, at, _ = syntax.parse_source(text, "python")
                assert not valid
                told, equal = told + 1, equal + (text.count("\n", 0, at) + 1 == e.lineno)
    assert told > 100 and equal >= 0.98 * told
    go = "package a\n\nfunc f() {\n    x := 1\n\n    // note\n    y := g(x,\n        2)\n    if x { ]\n}\n"
    assert go[syntax.parse_source(go, "go")[1]] == "]"
    for name in ("kotlin", "swift", "typescript", "python"):  # each offset is the token's own character
        own, text = language(name), "a = b(1,\n  2)\nc = d\n\n\ne = 'x'\n"
        tokens = own.tokenise(text)
        for k, c in enumerate(tokens):
            if c in "()=,":
                assert text[own.offset(text, k)] == c


def test_deep_nesting_templates_and_comments():
    assert syntax.parse_source("int x = " + "(" * 8_000 + "1" + ")" * 8_000 + ";", "c")[0]
    assert syntax.parse_source("x = " + "[" * 20_000 + "1" + "]" * 20_000 + "\n", "python")[0]
    assert not syntax.parse_source("x = " + "[" * 20_000 + "1" + "]" * 19_999 + "\n", "python")[0]
    template = "const z = `a ${x.map(y => { return { k: { z: `q${y}` } } })} b`;\n"
    assert syntax.parse_source(template, "typescript")[0]
    broken = template.replace("} } })", "} } )")
    assert syntax.parse_source(broken, "typescript")[:2] == (False, broken.index(" )} b") + 1)
    for name, good in {
        "rust": "/* a /* b /* c /* d /* e */ */ */ */ */ fn f() {}\n", "kotlin": 'fun f() { println("a ${g("x", { b -> "c${b}" })} d") }\n', "swift": 'func f() { print("a \\(g("x", h: "c\\(b((1)))")) d") }\n',
    }.items():
        assert syntax.parse_source(good, name)[0]
        assert not syntax.parse_source(good + "}", name)[0]
    assert not syntax.parse_source("/* a /* b /* c /* d /* e */ */ */ */ fn f() {}\n", "rust")[0]


ROW = "file_id bigint, repo_id string, path string, language string, parts array<struct<start_byte:bigint,chunk_id:bigint,blob:binary>>, valid int"


def test_operator_on_odd_rows(spark):
    part = lambda t, at=0, c=1: (at, c, t.encode())
    rows = [
        (1, "r", "a", " RS ", [part("() {}", 4, 2), part("fn f"), part("fn f")], 0),
        (2, "r", "b", "rust", [part("fn f(")], 0), (3, "r", "c", None, [part("x")], 0), (4, None, "d", "markdown", [part("# (")], 0),
        (5, "r", "e", "cobol", [part("x")], 0), (6, "r", "f", "Py", [], 0), (7, "r", "g", "py", None, 0), (8, "r", "h", "python", [part("x = 1\n" * 50_000)], 0),
    ]
    df = spark.createDataFrame(rows, ROW)
    got = {r.file_id: r.valid for r in syntax.parse_files(df).collect()}
    assert got == {1: True, 2: False, 3: None, 4: True, 5: None, 6: True, 7: True, 8: True}
    assert {(r.repo_id, r.language): (r.n_files, r.n_invalid) for r in syntax.invalid_rates(syntax.parse_files(df)).collect()}[("r", "rust")] == (2, 1)
    assert syntax.parse_files(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_python_files_equal_the_compiler(spark):
    from quernel.llm.chunk_source import load_sources, whole_source

    sf = "/root/testdata/sf0.01"
    found = {r.file_id for r in syntax.p1_found(spark, sf).collect()}
    n = 0
    for r in load_sources(spark, sf).collect():
        if (r.language or "").strip().lower() in ("python", "py"):
            try:
                ast.parse(whole_source(r.parts))
                bad = False
            except (SyntaxError, ValueError):
                bad = True
            assert bad == (r.file_id in found), r.file_id
            n += 1
    assert n > 50
