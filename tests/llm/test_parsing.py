import ast

import duckdb
import pytest

from glosswork.llm import parsing

GOOD = {
    "python": "@d(1)\nclass A(B, metaclass=M):\n    x: int = 3\n    async def f(self, *a, k=1, **kw) -> int:\n        for i, (j, *k) in enumerate(x for x in a if x not in kw):\n            print(f'{i!r}', i if j else k, a[1:, ::2], lambda q, *r: q)\n        with open(a) as b, c as d:\n            pass\n        try:\n            return {**kw, 'a': 1}\n        except (A, B) as e:\n            raise X from e\n        finally:\n            del a[0]\n",
    "javascript": "import a, {b as c} from 'x';\nexport default class A extends B { static #x = 1; get y() { return this.#x } async *g() { yield* z } }\nconst f = async ({a, b: [c] = []}, ...r) => `v${a ? `in${b}` : '}'}`;\nlet q = a / b / c, re = /[/]\\//g;\nfor (const [k, v] of Object.entries(o)) { if (k) continue; else break }\n",
    "typescript": "interface A<T> extends B { readonly x?: T[]; f(a: number): Promise<Map<string, Array<T>>>; [k: string]: any }\ntype U = 'a' | { b: number };\nexport function g<T extends A<T>>(x: T, y?: string): x is T { return x as any }\nenum E { A = 1, B }\n",
    "java": "package a.b;\nimport java.util.*;\npublic class A<T extends B & C> implements D {\n  private final Map<String, List<int[]>> m = new HashMap<>();\n  @Override public <R> R f(Function<? super T, R> g) throws E { for (var x : m.keySet()) { g.apply((T) x); } return x -> -x; }\n}\n",
    "go": "package a\nimport (\n\t\"fmt\"\n)\ntype T struct {\n\tA, B int `json:\"a\"`\n\t*C\n}\nfunc (t *T) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[a]; ok {\n\t\tgo func() { ch <- v }()\n\t}\n\tfor i := range c {\n\t\tx += i\n\t}\n\treturn x, nil\n}\n",
    "c": "#ifndef A_H\n#define A_H\n#ifdef __cplusplus\nextern \"C\" {\n#endif\ntypedef struct s { int a[3], *b; unsigned f : 3; } s_t;\nstatic int (*fp)(int, char *);\nint f(const char *x, ...) { for (int i = 0; i < 3; i++) { x += sizeof(s_t); } return (int) *x ? 1 : 2; }\n#endif\n",
    "cpp": "#include <map>\nnamespace a { template <typename T> class B : public C<T> { public: explicit B(int x) : x_(x) {} ~B() = default; virtual int f() const override { return [&](auto y) { return y + x_; }(1); } private: std::map<std::string, std::vector<int>> m; int x_{0}; }; }\n",
    "rust": "use a::{b, c::*};\n#[derive(Debug)]\npub struct A<'a, T: B + 'a> { x: &'a T, y: Vec<Option<u8>> }\nimpl<'a, T> A<'a, T> where T: B { fn f(&mut self) -> Result<(), E> { let c = 'x'; match self.y { Some(n) if n > 1 => println!(\"{}\", n), _ => { return Ok(()) } } for i in 0..10 { g(i)?; } Ok(()) } }\n",
}


@pytest.mark.parametrize("lang", sorted(GOOD))
def test_valid_cut_and_conflict(lang):
    p, text = parsing.parser(lang), GOOD[lang]
    assert p.check(text) is None
    assert p.check(text.replace("\n", "\r\n")) is None
    lines = text.splitlines()
    marked = "\n".join([*lines[:-1], "<<<<<<< HEAD", lines[-1], "=======", lines[-1], ">>>>>>> topic", ""])
    assert p.check(marked)[0] == "conflict"
    opener = {"python": "(", "rust": "fn f() {", "go": "\nfunc f() {", "java": "class Z {", "c": "int f() {", "cpp": "int f() {"}.get(lang, "{")
    assert p.check(text + opener)[0] == "truncated"


def test_python_as_its_own_parser(data):
    rows = duckdb.sql(f"SELECT content FROM '{data}/source_files.parquet' WHERE lang = 'python'").fetchall()
    for (text,) in rows:
        try:
            ast.parse(text)
            valid = True
        except (SyntaxError, ValueError):
            valid = False
        assert (parsing.parser("python").check(text) is None) == valid


def test_rows_and_rates(spark):
    rows = [(1, "r", "python", "x = 1\n"), (2, "r", "python", "x = (\n"), (2, "r", "python", "x = (\n"), (3, None, "python", ""), (4, "r", "cobol", "x"), (5, "r", None, "x"), (6, "r", "go", None), (7, "r", "python", "x = 1\n" * 20000 + ")")]
    files = spark.createDataFrame([(*r, "e") for r in rows], "file_id long, repo string, lang string, content string, valid string")
    got = parsing.parse(files)
    assert sorted((r.file_id, r.valid) for r in got.collect() if r.valid is not None) == [(1, True), (2, False), (2, False), (3, True), (7, False)]
    assert next(r for r in got.collect() if r.file_id == 7).line == 20001
    assert {(r.repo, r.lang): (r.files, r.parse_error) for r in parsing.rates(got).collect()} == {("r", "python"): (4, 3), (None, "python"): (1, 0)}
    assert parsing.parse(files.limit(0)).count() == 0


@pytest.mark.parametrize(
    "lang, text, want",
    [
        ("python", "import os, sys,, re\n", ("syntax", 15)),
        ("python", "def f():\n    return (1\n", ("truncated", 22)),
        ("python", 'x = f"{a["b"]}"\n', None),
        ("javascript", "let a = `x${b + `y${c}` }z`; // end", None),
        ("javascript", "let a = `x${b + }z`;", ("syntax", 8)),
        ("javascript", '{ "a": 1, "b": [2] }', ("syntax", 5)),
        ("c", "int f(void) {\n#if A\n return 1;\n#elif B\n return 2;\n#else\n return 3;\n#endif\n}\n", None),
        ("c", "int f(void) {\n#if A\n return 1;\n#else\n return 3 +;\n#endif\n}\n", ("syntax", 48)),
        ("c", "#if 0\n any ( thing\n#endif\nint x;\n", None),
        ("c", "#if 0\n<<<<<<< HEAD\n#endif\nint x;\n", ("conflict", 6)),
        ("c", "#if A\nint x;\n", ("truncated", 12)),
        ("rust", 'fn main() { /* a /* b */ c */ let x = r####"a"####; }', None),
        ("cpp", 'auto s = R"xy(a)" )xy"; int y;', None),
        ("python", "x = " + "(" * 90000 + ")" * 90000 + "\n", ("nesting", 0)),
    ],
)
def test_places_branches_and_templates(lang, text, want):
    import sys

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(parsing.DEPTH)
    try:
        assert parsing.parser(lang).check(text) == want
    finally:
        sys.setrecursionlimit(limit)


def test_kept_statements_do_not_change_verdicts():
    p = parsing.parser("java")
    lines = ["class A { int x = 3; void f() { a = b; } }", "class A { int x = ; }", "class A { void f() { a = ; } int x = 3; }", "class A { int x = 3; int x = ; }"]
    fresh = [parsing.Parser("java").check(t) for t in lines]
    assert [p.check(t) for t in lines for _ in range(2)][::2] == fresh == [p.check(t) for t in lines]


def test_filled_by_source_and_null_repo(spark):
    files = spark.createDataFrame([(1, None, "s", "a.py", "python", "x ="), (2, None, "s", "b.py", "python", "x = 1\n")], "file_id long, repo string, sha string, file string, lang string, content string")
    manifest = spark.createDataFrame([(None, "s", "a.py", "ai"), (None, "s", "a.py", "ai"), (None, "s", "b.py", "human")], "repo string, sha string, file string, source string")
    stats = spark.createDataFrame([("2026-01-01", s, None, "python", 1) for s in ("ai", "human", "other")], "run_at string, source string, repo string, lang string, files long")
    got = {r.source: (r.files, r.parse_error) for r in parsing.filled(stats, parsing.parse(files), manifest).collect()}
    assert got == {"ai": (1, 1), "human": (1, 0), "other": (None, None)}
