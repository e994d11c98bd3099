"""Symbols of source files against answers by hand: nested and commented declarations, strings and
patterns that hold brackets and keywords, both of them in each language."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import code

TS = """// Auth business logic
import { a } from "./a";
/* class Hidden { } */
@Injectable({ scope: "x}" })
export class AuthService extends Base<Map<string, number>> {
  private re = /[{}/]\\/class A {/g;
  handler = async (x: number) => { return `class T { ${x} }`; };

  constructor(private readonly a: A) { super(); }

  /** Validate a set
   * of credentials. */
  async validate(c: Credentials = { a: 1 }): Promise<{ ok: boolean }> {
    if (c) { return { ok: true } }
    function inner() {}
    return "} class B {" ? { ok: 1 / 2 } : null
  }
  abstract sketch(): void;
  static get name(): string { return 'it\\'s' }
}
export interface Credentials { user: string; check(): void }
export type Id = string | number
export const TTL = 3600, LIMIT: number = 5;
export enum Kind { A, B }
const make = (x) => {
  class Local {}
  return x
}
export default function run() { const inside = 1 }
type Pair = {
  a: string
}
let late
"""
PHP = """<html>class No {}</html>
<?php
namespace App\\Auth;
use App\\Util\\Hasher;
const LIMIT = 5;
/**
 * Users by name.
 */
#[Entity]
final class UserService extends Base implements Contract {
    private $x = ['a' => 1];
    public function find(string $name = "} {"): ?User { $f = function () { return 1; }; return $f; }
    # function ghost() {}
    abstract protected function sketch();
    public static function make(): static {
        $text = <<<EOT
        class Fake { function no() {} }
        EOT;
        return new class { public function anon() {} };
    }
}
interface Contract { public function find(); }
trait Logs { protected function log() { } }
enum Suit: string { case A = 'a'; public function label(): string { return 'x'; } }
function helper(&$x) { if ($x) { return 1; } else { return 2; } }
?>
<b>function out() {}</b>
"""
RUST = """//! File doc
use std::fmt;
/// A point in space.
#[derive(Debug, Clone)]
pub struct Point { x: i32 }
pub struct Unit;
/* outer /* struct Inner {} */ still */
impl<T: Into<String>> fmt::Display for Wrap<T> where T: Clone {
    fn fmt(&self, f: &mut fmt::Formatter<'_>) -> fmt::Result { write!(f, "{{}} fn no() {{") }
}
impl Point {
    /// Makes one.
    pub const fn new(x: i32) -> Self { let s = r#"fn raw() { "quoted" }"#; let c = '{'; Self { x } }
    pub(crate) async fn go(&self) {}
}
pub trait Shape { fn area(&self) -> f64; fn name(&self) -> String { String::new() } }
pub enum Color { Red, Green { a: u8 } }
const MAX: usize = 10;
static mut COUNT: u32 = 0;
type Alias = Vec<Vec<u8>>;
macro_rules! square { ($x:expr) => { $x * $x }; }
mod outer {
    pub mod inner { pub fn deep() {} pub struct Leaf; }
    mod elsewhere;
}
fn free<'a>(x: &'a str) -> &'a str { fn nested() {} x }
"""
CPP = """#ifndef APP_H
#define APP_H
#include "base.h"
#define SQUARE(x) \\
  ((x) * (x))
namespace app {
namespace detail { struct Node { int value; void touch(); }; }
/// Runs it.
class Service final : public Base<int>, private Other {
public:
  Service(int a) : a_(a), b_{2} { }
  ~Service();
  template <typename T> T get() const { return T{}; }
  virtual int run(const char* s = "class X {") = 0;
  int operator+(const Service& o) const;
  enum class Mode { A, B };
private:
  int a_, b_;
};
int Service::run(const char* s) { if (s) { return 1; } return 0; }
using Ids = std::vector<int>;
static int counter = 0;
void prototype(int a);
template <class T>
T largest(T a, T b) { return R"(class Raw { void no(); })" ? a : b; }
}
typedef struct { int x; } Pair;
typedef unsigned int u32;
union Either { int i; float f; };
extern "C" { void c_api(void); }
// int ghost() { }
int main() { struct Local { int z; }; for (;;) { } }
#endif
"""
LUA = """--[[ function ghost() end ]]
local json = require("json")
local M = {}
-- Greets.
-- Twice.
function M.greet(name)
  local s = [[ function fake() end ]]
  if name then for i = 1, 2 do print(i) end elseif s then return 1 else return 2 end
end
function M:close() repeat local x = 1 until x end
local function helper(a) return function() return a end end
local LIMIT, other = 10, "end"
M.size = 5
M.make = function(x)
  return x
end
function global_one() end
print("function no() end")
"""
# path: (language, source, {(kind, qualified without the path): (first line, last line)})
WANT = {
    "a/auth.ts": ("typescript", TS, {
        ("class", "AuthService"): (5, 20), ("method", "AuthService.constructor"): (9, 9), ("method", "AuthService.validate"): (13, 17), ("method", "AuthService.name"): (19, 19),
        ("interface", "Credentials"): (21, 21), ("type", "Id"): (22, 22), ("const", "TTL"): (23, 23), ("const", "LIMIT"): (23, 23), ("enum", "Kind"): (24, 24), ("const", "make"): (25, 28),
        ("function", "run"): (29, 29), ("type", "Pair"): (30, 32), ("const", "late"): (33, 33),
    }),
    "b/user.php": ("php", PHP, {
        ("const", "LIMIT"): (5, 5), ("class", "UserService"): (10, 21), ("method", "UserService.find"): (12, 12), ("method", "UserService.sketch"): (14, 14), ("method", "UserService.make"): (15, 20),
        ("interface", "Contract"): (22, 22), ("trait", "Logs"): (23, 23), ("method", "Logs.log"): (23, 23), ("enum", "Suit"): (24, 24), ("method", "Suit.label"): (24, 24), ("function", "helper"): (25, 25),
    }),
    "c/lib.rs": ("rust", RUST, {
        ("struct", "Point"): (5, 5), ("struct", "Unit"): (6, 6), ("impl", "impl Display for Wrap"): (8, 10), ("method", "Wrap.fmt"): (9, 9), ("impl", "impl Point"): (11, 15), ("method", "Point.new"): (13, 13),
        ("method", "Point.go"): (14, 14), ("trait", "Shape"): (16, 16), ("method", "Shape.area"): (16, 16), ("method", "Shape.name"): (16, 16), ("enum", "Color"): (17, 17), ("const", "MAX"): (18, 18),
        ("const", "COUNT"): (19, 19), ("type", "Alias"): (20, 20), ("macro", "square"): (21, 21), ("mod", "outer"): (22, 25), ("mod", "outer::inner"): (23, 23), ("function", "outer::inner::deep"): (23, 23),
        ("struct", "outer::inner::Leaf"): (23, 23), ("function", "free"): (26, 26),
    }),
    "d/app.hpp": ("cpp", CPP, {
        ("macro", "SQUARE"): (4, 5), ("namespace", "app"): (6, 26), ("namespace", "app::detail"): (7, 7), ("struct", "app::detail::Node"): (7, 7), ("method", "app::detail::Node.touch"): (7, 7),
        ("class", "app::Service"): (9, 19), ("method", "app::Service.Service"): (11, 11), ("method", "app::Service.~Service"): (12, 12), ("method", "app::Service.get"): (13, 13), ("method", "app::Service.run"): (14, 14),
        ("method", "app::Service.operator+"): (15, 15), ("enum", "app::Service::Mode"): (16, 16), ("type", "app::Ids"): (21, 21), ("const", "app::counter"): (22, 22), ("function", "app::prototype"): (23, 23),
        ("function", "app::largest"): (24, 25), ("struct", "Pair"): (27, 27), ("type", "u32"): (28, 28), ("struct", "Either"): (29, 29), ("function", "c_api"): (30, 30), ("function", "main"): (32, 32),
    }),
    "e/init.lua": ("lua", LUA, {
        ("const", "M"): (3, 3), ("method", "M.greet"): (6, 9), ("method", "M.close"): (10, 10), ("function", "helper"): (11, 11), ("const", "LIMIT"): (12, 12), ("const", "other"): (12, 12), ("const", "M.size"): (13, 13),
        ("method", "M.make"): (14, 16), ("function", "global_one"): (17, 17),
    }),
}


@pytest.fixture(scope="module")
def found(spark):
    files = [(p, lang, text) for p, (lang, text, _) in WANT.items()] + [("f/empty.ts", "typescript", ""), ("g/none.lua", "lua", None), ("h/x.py", "python", "class A: pass")]
    return code.symbols(spark.createDataFrame(files, "path string, lang string, content string")).collect()


@pytest.mark.parametrize("path", WANT)
def test_symbols(found, path):
    _, text, want = WANT[path]
    got = {(r.kind, r.qualified.removeprefix(path + ":")): (r.start_line, r.end_line) for r in found if r.path == path}
    assert got.pop(("module", path)) == (1, text.count("\n") + 1)
    assert got == want


def test_signatures_and_docs(found):
    by = {r.qualified: r for r in found}
    assert by["a/auth.ts:AuthService"].signature == "export class AuthService extends Base<Map<string, number>>"
    assert by["a/auth.ts:AuthService.validate"].signature == "async validate(c: Credentials = { a: 1 }): Promise<{ ok: boolean }>"
    assert by["a/auth.ts:AuthService.validate"].doc == "Validate a set"
    assert by["b/user.php:UserService"].doc == "Users by name."
    assert by["c/lib.rs:Point"].doc == "A point in space."
    assert by["c/lib.rs:Point.new"].doc == "Makes one."
    assert by["c/lib.rs:free"].signature == "fn free<'a>(x: &'a str) -> &'a str"
    assert by["d/app.hpp:app::Service"].doc == "Runs it."
    assert by["e/init.lua:M.greet"].doc == "Greets."
    assert by["a/auth.ts:Id"].signature == "export type Id = string | number"


def test_odd_files(found):
    assert [(r.kind, r.qualified) for r in found if r.path == "f/empty.ts"] == [("module", "f/empty.ts")]
    assert not any(r.path == "h/x.py" for r in found)


def test_long_and_broken_files(spark):
    many = "".join(f"export function f{k}() {{ return [{k}, '}}'] }}\n" for k in range(3000))
    text = 'const s = "' + "\\n" * 1500 + "x" * 200_000 + '";\n' + "/*" + "*" * 100_000 + "*/\nclass After {}\n"
    rows = [("many.ts", "typescript", many), ("long.ts", "typescript", text), ("open.ts", "typescript", "class A { foo() { ("), ("shut.ts", "typescript", "} } class B {}"), ("open.rs", "rust", 'fn a() { "never closed')]
    got = code.symbols(spark.createDataFrame(rows, "path string, lang string, content string")).groupBy("path").agg(F.count_if(F.col("kind") != "module").alias("n"))
    counts = dict(map(tuple, got.collect()))
    assert counts["many.ts"] == 3000 and counts["long.ts"] == 2 and counts["shut.ts"] >= 0 and len(counts) == 5
