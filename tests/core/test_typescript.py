"""The token reader: expected definitions follow from the languages' grammar by hand."""

import random

import pytest

from lodegrain.operators.typescript import Reader

CODE = """import { a, b as c } from "./x";
// comment naming ghost1
/* block ghost2 */
export default class Svc<T extends Base> extends Other<T> implements I {
  private readonly x: Map<string, number> = new Map();
  static count = 0
  #secret = 1;
  handle = (e: Event) => {
    const inner = `tpl ${deep({k: "}"})} ghost3`;
    function local<T>(q: T): T { return q; }
  }
  constructor(private y: number) { super(); }
  get val(): number { return this.y }
  set val(v) { this.y = v }
  @Dec({a: 1}) async *run<T>(p: T): Promise<{ z: number }> {
    if (p) { return /re'{ghost4/.test(p); }
  }
  abstract over(): void
  delete(id: string): void;
  [Symbol.iterator]() { }
  "quoted"() {}
  go?() { let w = 1, v = function () { return 2 }, u = (x) => x; }
}
export const arrow = async (a: number): Promise<void> => {
  for (const it of list) { }
  try { } catch (err) { }
};
const enum Col { Red, Green }
export type Alias<T> = { a: T } |
  string;
interface Opt extends A<B> {
  m(): void;
}
let q = (1 + 2) / 3 / d, r = x => x
const { d1, d2 } = obj;
export function over(a: string): void;
export function over(a: any) {
  const f = function named() {};
  return function gen() {}
}
var iife = function () { return 1 }()
const obj2 = { function: 1, class: 2, key: class Inner { meth() {} } };
declare function ext(): number
namespace N { export function nested() {} }
"""
WANT = [
    ("Svc", "class", 4, 21, 23, True), ("Svc.run", "method", 15, 22, 17, True), ("Svc.over", "method", 18, 11, 18, True), ("Svc.delete", "method", 19, 2, 19, True), ("Svc.go", "method", 22, 2, 22, True), ("inner", "variable", 9, 10, 9, False),
    ("local", "function", 10, 13, 10, False), ("w", "variable", 22, 14, 22, False), ("v", "function", 22, 21, 22, False), ("u", "function", 22, 51, 22, False), ("arrow", "function", 24, 13, 27, True), ("Col", "enum", 28, 11, 28, False),
    ("Alias", "type", 29, 12, 30, True), ("Opt", "interface", 31, 10, 33, False), ("q", "variable", 34, 4, 34, False), ("r", "function", 34, 25, 34, False), ("over", "function", 36, 16, 36, True), ("over", "function", 37, 16, 40, True),
    ("f", "function", 38, 8, 38, False), ("iife", "variable", 41, 4, 41, False), ("obj2", "variable", 42, 6, 42, False), ("ext", "function", 43, 17, 43, False), ("nested", "function", 44, 30, 44, True),
]


def found(text, jsx=False):
    return sorted(d[:6] for d in Reader(text, jsx).defined)


def test_declarations_at_any_depth():
    assert found(CODE) == sorted(WANT)


def test_names_leave_out_comments_literals_and_declared_places():
    names = set(Reader(CODE, False).names())
    assert names >= {"a", "b", "c", "Base", "Other", "deep", "list", "obj", "d1", "gen", "named", "Inner", "meth", "val", "y", "key"}
    assert not names & {"ghost1", "ghost2", "ghost3", "ghost4", "Svc", "run", "handle", "count", "x1", "it", "err", "arrow", "Col", "Alias", "Opt", "over", "quoted", "tpl", "re"}


def test_jsx_text_is_no_code():
    text = """export const App = () => {
  return <div className="it's" data-x='{' onClick={() => go(1)}>Don't stop {items.map(i => <Item key={i} />)} ghost <b>x y</b></div>;
};
function After<T,>(a) { return a < b && c > d }
const G = <T,>(x: T) => x;
const el = cond ? <A.B/> : <></>;
class Z { m() { return <p>it's {"}"}</p> } n() {} }
"""
    got = [(n, k, line, end) for n, k, line, _, end, _ in found(text, True)]
    assert got == [("After", "function", 4, 4), ("App", "function", 1, 3), ("G", "function", 5, 5), ("Z", "class", 7, 7), ("Z.m", "method", 7, 7), ("Z.n", "method", 7, 7), ("el", "variable", 6, 6)]
    names = set(Reader(text, True).names())
    assert names >= {"go", "items", "Item", "b", "c", "d"} and not names & {"ghost", "stop", "Don", "it"}


@pytest.mark.parametrize("text", ["", "\n", "{", "}", "((((", "`${", "`${`${", "class", "class {", "function", "const", "const =", "export", "@", "@a", "<a", "<a b={", "/*", "'\\", "interface I", "type T =", "enum E {", "class A { m(", "class A { [", "const f = (", "x = <"])
def test_broken_texts_end(text):
    for jsx in (False, True):
        Reader(text, jsx).names()


def test_any_run_of_tokens_ends_and_long_files_take_linear_time():
    rng = random.Random(4)
    parts = ["class", "A", "{", "}", "(", ")", "=>", "const", "x", "=", "function", "`", "${", "<", ">", "/", "'", "\n", ";", "export", "@", "type", ":", "[", "]", "async", "*", "//", "/*", "*/"]
    for _ in range(3000):
        text = " ".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        for jsx in (False, True):
            Reader(text, jsx).names()
    nested = "".join(f"const f{i} = () => {{\n" for i in range(3000)) + "}\n" * 3000
    assert [d[4] for d in found(nested)] and {d[0]: d[4] for d in found(nested)}["f0"] == 6000
    assert len(found("let a = {" + "k: [1, 2]," * 100_000 + "};\nfunction g() {}")) == 2
