import ast
import warnings

import duckdb
import pytest

from silverloom.llm.grammars import LANGUAGES, parsed_as, room, valid_ecma, valid_go, valid_python
from silverloom.llm.parsing import judge, parse_rates, parsed_files, ranked

GO = ["package a\n", 'package a\n\nimport "fmt"\n\nfunc f[T any, U ~int | string](x T, ys ...U) (n int, err error) {\n\tfor i, y := range ys {\n\t\tfmt.Println(i, y)\n\t}\n\treturn\n}\n',
      "package a\ntype S struct {\n\tA, B int `json:\"a\"`\n\t*T\n\tm map[string][]chan<- int\n}\ntype I interface {\n\tM(x int) (y string)\n\t~int | E\n}\n",
      "package a\nfunc (s *S[T]) m() { if x := g(); x > 1 { L: for { break L } } else if y { } else { switch z := x.(type) { case int, []byte: fallthrough; default: } } }",
      "package a\nvar a = [...]int{1, 2: 3}\nvar f = func(a, b int) func() { return nil }\nconst (\n\tx = iota\n\ty\n)\nvar p = &S{A: 1, B: []int{1}}",
      "package a\nfunc f() { select { case c <- 1: case v, ok := <-c: default: }; go func() {}(); defer x.y(); a[1:2:3] = b; for ; ; { }; for range 3 { } }",
      "package a\nfunc f() { x := T{}; if x == (T{}) { }; for _, v := range []int{1} { _ = v }; y := a.B[int]{1} ; z, w = <-c, *p; i++; s = `a\n`; r := '\\u00e9' }"]
BAD_GO = ["", "func f() {}", "package a\nfunc f() {", "package a\nfunc f() { if x { }", "package a\nx := 1\n", "package a\nfunc f() { a + }", "package a\nfunc f() { return 1, }\n",
          "package a\nfunc f() { x := [1, 2] }", "package a\n<<<<<<< HEAD\n", 'package a\nvar s = "abc\n', "package a\nfunc f() { for i := 0; i < 3 { } }", "package a\nfunc f() { 1 := 2 }", "package a\nfunc f()\n{\n}\n", "package a\nimport fmt\n", "package a\nvar r = 'ab'\n"]
JS = ["", "import a, { b as c } from 'x'; import * as d from \"y\"; export default class extends a {}; export { c }; export * from 'z';", "const { a = 1, ...b } = c, [d, , e = 2] = f;",
      "for (const x of y) ; for (let i = 0, n = 3; i < n; i++) {} for (a in b) c; for await (const z of w) {}", "x = y => ({ ...y, [k]: 1, get a() { return 1 }, async *g() { yield* h() } })",
      "const f = async (a, { b } = {}, ...c) => { await a; };", "a\n++b\nc = d\n/e/g.test(f)", "var r = a / b / c, q = /[/\\]]+/gi;", "`a${`b${c}`}d` + tag`x\\u`", "label: while (1) { if (a) continue label; else break }",
      "class A extends (B, C) { static #p = 1; static { this.x = 2 } 'q'() {} *g() {} async m() { return super.m?.(...a)?.[0] ?? #p in this } get; set = 3\n static async = 4 }",
      "if (a) b; else c\ndo d; while (e) f", "try { x } catch { y } finally { z }", "let async; async = 1; async (x); of = 2", "new.target; " if False else "a?.b?.[c]?.(d)", "throw new Error(`x`)", "export const a = 1, b = 2", "await import('x')",
      "switch (a) { case 1: case 2: b(); break; default: c }", "0x1f + 0b1 + 1_000n + .5e-3", "({ a, b } = c); [d.e, f[0]] = g", "#!/usr/bin/env node\nx", "a = b ? (c) : d => e", "a = b ? (c, d) => e : f", "(function () { return })()"]
BAD_JS = ["let x = ;", "function f( {", "if (a { }", "const a;", "return 1", "import { a from 'b'", "a b", "x = 'abc\n'", "`abc", "({ a = 1 })", "1 = 2", "f() = 1", "a ? b", "class A { x y }", "var class = 1", "function f() { await x }", "<<<<<<< HEAD", "a => { } b", "for (const x = 1 of y) ;",
          "export function () {}", "interface A { b: string }", "const a: number = 1", "x as Y", "<div>a</div>", "/abc", "def f():\n  pass", "package a", "{{#each x}}", "with (a) b", "let x\nlet = 3", "enum A { B }", "'\\u12'", "try { }"]
TS = ["interface A<T = {}> extends B, C<T> { a?: string; readonly [k: string]: any; (x: number): void; new (y): A; m<U>(z: U): U; get g(): number }", "type F<T> = T extends (infer U extends string)[] ? U : never; type G = { readonly [K in keyof T]?: T[K] };",
      "enum E { A = 1, B, 'c' = 'x' } declare module 'm' { export const a: number } namespace N.M { export type T = 1 }", "abstract class A<T> extends B<T> implements C, D { constructor(private readonly x: number, public y?: string) { super() } abstract m(): void; declare z: string; static override async w?(): Promise<void>; p!: T }",
      "function f<T extends keyof U>(this: Window, a: T, b?: number, ...c: string[]): asserts a is string { } function g(x: number): x is 3;", "const x = y as unknown as Z[], w = v!, u = t satisfies S; let a: [x: number, y?: string, ...z: any[]];",
      "const f = <T,>(x: T): T => x; const g = async <T>(x: T) => { }; h<string>(1); new Map<string, Array<number>>();", "import type { A } from 'a'; import { type B, C } from 'b'; export type { D } from 'd'; import e = require('e'); export = e;",
      "let u: typeof x.y | (() => void) | (new (...a: any) => B) | `a${string}`; let v = a < b && c > d;", "@Dec() class A { @P() m(@Q x) { } }", "let a = b ? (c: number) => d : e", "type A = B['c'][number] | unique symbol; let x: unknown = <any>y;"]
BAD_TS = ["interface A { b: }", "let a: = 1", "type A =", "function f(a: number {", "class A { m( }", "const x = <T>(", "enum { A }", "let x: Array<number = 1", "<div>a</div>", "package a\n\nfunc f() {}", "def f():\n    return 1"]
JSX = ["x = <a.b c:d='e' {...f} g={h} i>t &amp; {/* c */} {j} <k/> </a.b>", "y = <><p>it's</p>{a && <b/>}</>", "const z = () => <div>{list.map((x) => (<li key={x}>{x}</li>))}</div>"]
BAD_JSX = ["x = <a></b>", "x = <a", "x = <a>{</a>", "x = <a b=c/>", "x = <a/><b/>", "x = <a>}</a>"]


def _name(i):
    return i[:40]


@pytest.mark.parametrize("text", GO, ids=_name)
def test_go(text):
    assert valid_go(text)


@pytest.mark.parametrize("text", BAD_GO, ids=_name)
def test_bad_go(text):
    assert not valid_go(text)


@pytest.mark.parametrize("text", JS, ids=_name)
def test_js(text):
    assert valid_ecma(text) and valid_ecma(text, ts=True)


@pytest.mark.parametrize("text", BAD_JS, ids=_name)
def test_bad_js(text):
    assert not valid_ecma(text)


@pytest.mark.parametrize("text", TS, ids=_name)
def test_ts(text):
    assert valid_ecma(text, ts=True)
    if "import type" not in text:
        assert not valid_ecma(text)


@pytest.mark.parametrize("text", BAD_TS, ids=_name)
def test_bad_ts(text):
    assert not valid_ecma(text, ts=True)


@pytest.mark.parametrize("text", JSX, ids=_name)
def test_jsx(text):
    assert valid_ecma(text, jsx=True) and valid_ecma(text, ts=True, jsx=True) and not valid_ecma(text) and not valid_ecma(text, ts=True)


@pytest.mark.parametrize("text", BAD_JSX, ids=_name)
def test_bad_jsx(text):
    assert not valid_ecma(text, jsx=True) and not valid_ecma(text, ts=True, jsx=True)


def test_python_equals_the_parser():
    rows = duckdb.sql("SELECT content FROM '/root/testdata/sf0.01/file_events.parquet' WHERE content IS NOT NULL").fetchall()
    extra = ["", "def f():\n", "return 1", "  x", "from __future__ import annotations\nx: int", "x = 1\nfrom __future__ import division", "nonlocal x", "print 1", "a\x00b", "x = '" + "y" * 100_000 + "'", "(" * 300, "match x:\n  case [1, *_]: pass", "await x"]
    for text in [r[0] for r in rows] + extra:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
            want = True
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            want = False
        assert valid_python(text) == want, text[:80]


def test_byte_order_mark():
    assert valid_python("\ufeffx = 1") and valid_go("\ufeffpackage a") and valid_ecma("\ufeffx")


def test_deep_nesting_ends():
    assert parsed_as("(" * 100_000) == dict.fromkeys(LANGUAGES, False)


def test_long_chains_and_deep_literals():
    chain = " else ".join(f"if (a === {i}) {{ b(); }}" for i in range(20_000))
    go = "package a\nfunc f() {\n" + " else ".join(f"if a == {i} {{ b() }}" for i in range(20_000)) + "\n}\n"
    with room():
        assert valid_ecma(chain) and valid_ecma("x = " + "[" * 50_000 + "]" * 50_000) and valid_ecma("x = " + " + ".join("a" for _ in range(50_000)))
        assert valid_go(go) and not valid_go(go[:-3]) and valid_go("package a\nvar x = " + "(" * 50_000 + "1" + ")" * 50_000)
        assert valid_ecma("x = " + "[" * 50_000 + "]" * 49_999) is False


def test_deep_python():
    """A long sum is valid; what the interpreter's own parser cannot hold is neither valid nor invalid."""
    assert valid_python("x = " + " + ".join(["a"] * 20_000)) is True and valid_python("x = " + " + ".join(["a"] * 20_000) + "\ny = (") is False
    assert valid_python("if a:\n  b\n" + "elif a:\n  b\n" * 8000) is None
    assert judge("if a:\n  b\n" + "elif a:\n  b\n" * 8000, "python") == ("undecided", None)


def test_all_languages_at_once_equal_each_alone():
    texts = GO + BAD_GO + JS + BAD_JS + TS + BAD_TS + JSX + BAD_JSX
    texts += [r[0] for r in duckdb.sql("SELECT DISTINCT content FROM '/root/testdata/sf0.001/file_events.parquet' WHERE content IS NOT NULL").fetchall()]
    for text in texts:
        want = {"python": valid_python(text), "go": valid_go(text), "javascript": valid_ecma(text), "jsx": valid_ecma(text, jsx=True), "typescript": valid_ecma(text, ts=True), "tsx": valid_ecma(text, ts=True, jsx=True)}
        assert parsed_as(text) == want, text[:80]


def test_verdicts():
    py, go = "def f(self):\n    return None\n", "package a\n\nfunc f() {\n}\n"
    assert ranked(py)[0] == "python" and ranked(go)[0] == "go"
    assert judge(py, "go") == ("wrong extension", "python") and judge(go, "javascript") == ("wrong extension", "go")
    assert judge("const a = 1;", "typescript") == ("valid", "typescript")
    assert judge("const a: number = 1;", "javascript") == ("wrong extension", "typescript")
    assert judge("<<<<<<< HEAD\n", "python") == ("corrupt", None)


def test_table_cases(spark):
    schema = "delivery_id long, project string, path string, content string, language int, verdict int, ext int"
    rows = [(1, "p", "/a.PY", "x = 1", 1, 1, 1), (2, None, "/b.go", "def f(): pass", 1, 1, 1), (3, "p", "/c.txt", "?", 1, 1, 1), (4, "p", None, "x", 1, 1, 1), (5, "p", "/d.js", None, 1, 1, 1), (6, "p", "/e.mjs", "", 1, 1, 1), (6, "p", "/e.mjs", "", 1, 1, 1),
            (7, "p", "/f.ts", "let a: " + "A | " * 50_000 + "B", 1, 1, 1), (8, "p", "/g.tsx", "}", 1, 1, 1)]
    got = parsed_files(spark.createDataFrame(rows, schema))
    assert sorted((r.delivery_id, r.verdict, r.parses_as) for r in got.collect()) == [(1, "valid", "python"), (2, "wrong extension", "python"), (6, "valid", "javascript"), (6, "valid", "javascript"), (7, "valid", "typescript"), (8, "corrupt", None)]
    rates = {(r.project, r.language): (r.n_files, r.failure_rate) for r in parse_rates(got).collect()}
    assert rates[None, "go"] == (1, 1.0) and rates["p", "javascript"] == (2, 0.0) and rates["p", "tsx"] == (1, 1.0)
    assert parsed_files(spark.createDataFrame([], schema)).count() == 0
