"""Coverage reports, diffs, source files and configuration."""

import json
import subprocess

import pytest

from codeperil import config
from codeperil.functions.globs import glob_regex
from codeperil.sources import files, gitdiff, istanbul, lcov, rust, typescript

LCOV = """TN:x
DA:1,1
SF:src/a.rs
DA:1,2
DA:1,3,abc
DA:2,0
DA:x,1
DA:3,-1
DA:0,5
DA:4
BRDA:1,0,0,-
BRDA:1,0,1,0
BRDA:1,0,2,4
BRDA:1,0,2,-
BRDA:1,0
end_of_record
DA:9,9
SF:
DA:5,5
SF:src/b.rs
BRDA:7,0,0,1
SF:src/a.rs
DA:2,18446744073709551615
DA:2,7
DA:6,18446744073709551616
"""


def rows(frame, *columns):
    return sorted(tuple(r[c] if not hasattr(r[c], "as_tuple") else int(r[c]) for c in columns) for r in frame.collect())


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
@pytest.mark.parametrize("way", ["file", "text"])
def test_lcov(spark, tmp_path, ends, way):
    text = LCOV.replace("\n", ends)
    path = tmp_path / "lcov.info"
    path.write_bytes(text.encode())
    got = lcov.read_lcov(spark, str(path)) if way == "file" and ends == "\n" else lcov.parse_blocks(lcov.blocks_of(spark.createDataFrame([("r", text)], "report string, text string")))
    assert rows(got.lines, "file_path", "line", "hits") == [("src/a.rs", 1, 5), ("src/a.rs", 2, 2**64 - 1), ("src/a.rs", 9, 9)]
    branches = {(r["file_path"], r["line"], r["branch"]): None if r["taken"] is None else int(r["taken"]) for r in got.branches.collect()}
    assert branches == {("src/a.rs", 1, 0): None, ("src/a.rs", 1, 1): 0, ("src/a.rs", 1, 2): 4, ("src/b.rs", 7, 0): 1}
    assert [r["file_path"] for r in got.files.collect()] == ["src/a.rs"]  # a file without lines is absent
    problems = sorted((r["line_number"], r["kind"], r["content"]) for r in got.diagnostics.collect())
    assert problems == [(7, "MalformedRecord", "DA:x,1"), (8, "MalformedRecord", "DA:3,-1"), (9, "MalformedRecord", "DA:0,5"), (10, "MalformedRecord", "DA:4"), (15, "MalformedRecord", "BRDA:1,0"), (18, "EmptySourceFile", None), (25, "MalformedRecord", "DA:6,18446744073709551616")]


@pytest.mark.parametrize("text, good", [(LCOV, True), ("SF:a\nDA:1,1\n", True), ("DA:1,1\nSF:a\nDA:0,1\n", False), ("", False), ("SF:a\nDA:2,x\nDA:3,4,sum", True)])
def test_lcov_preflight(spark, tmp_path, text, good):
    path = tmp_path / "x.info"
    path.write_text(text)
    assert lcov.has_data(spark, str(path)) == good


def test_longest_suffix(spark):
    sources = spark.createDataFrame([("/ci/build/src/a.rs",), ("src/deep/b.rs",), ("../x.rs",), ("gone.rs",), ("w\\src\\a.rs",)], "source string")
    known = spark.createDataFrame([("src/a.rs",), ("a.rs",), ("b.rs",), ("deep/b.rs",), ("x.rs",)], "file_path string")
    got = {r["source"]: r["file_path"] for r in lcov.longest_suffix_paths(sources, known).collect()}
    assert got == {"/ci/build/src/a.rs": "src/a.rs", "src/deep/b.rs": "deep/b.rs", "../x.rs": "x.rs", "w\\src\\a.rs": "src/a.rs"}


def entry(path, s, statements, b=None, branches=None, **more):
    loc = lambda n: {"start": {"line": n, "column": None}, "end": {"line": n, "column": 3}}
    return {"path": path, "s": s, "statementMap": {k: loc(n) for k, n in statements.items()}, "b": b or {}, "branchMap": {k: {"loc": loc(n), **({"line": n + 1} if n > 90 else {})} for k, n in (branches or {}).items()}, "f": {}, **more}


def test_istanbul(spark):
    flat = {
        "/w/src/a.ts": entry("/w/src/a.ts", {"0": 5, "1": 2, "2": 0, "9": 1}, {"0": 1, "1": 1, "2": 4}, {"0": [1, 0], "1": [2], "42": [7]}, {"0": 3, "1": 95}),
        "b": entry("/w/src/b.ts", {"0": 1}, {}),
        "c": entry("/w/src/c.ts", {}, {}),
        "d": entry("/w/src/d.ts", {"0": 1}, {"0": 1}),
    }
    discovered = spark.createDataFrame([("a.ts",), ("b.ts",), ("c.ts",)], "file_path string")
    for text in (json.dumps(flat), json.dumps({"coverage-final": flat})):
        got = istanbul.parse_reports(spark.createDataFrame([(text,)], "text string"), discovered)
        assert rows(got.lines, "file_path", "line", "hits") == [("a.ts", 1, 2), ("a.ts", 4, 0)]
        assert rows(got.branches, "file_path", "line", "taken") == [("a.ts", 3, 0), ("a.ts", 3, 1), ("a.ts", 96, 2)]
        assert rows(got.files, "file_path") == [("a.ts",), ("c.ts",)]  # c is present without lines
        assert rows(got.diagnostics, "kind", "file_path") == [("BranchMismatch", "/w/src/a.ts"), ("MissingField", "/w/src/b.ts"), ("PathUnresolved", "/w/src/d.ts")]
    odd = istanbul.parse_reports(spark.createDataFrame([('{"x": 1, "a": [2]}',)], "text string"))
    assert odd.lines.count() == 0 and [r["kind"] for r in odd.diagnostics.collect()] == ["SchemaUnrecognized"]
    assert "[a, x]" in odd.diagnostics.first()["message"]


DIFF = """diff --git a.rs a.rs
index 1..2 100644
--- a.rs
+++ a.rs
@@ -1,2 +3,4 @@ fn x
+a
@@ -9 +12 @@
+b
@@ -20,3 +24,0 @@
-c
diff --git new.rs new.rs
new file mode 100644
--- /dev/null
+++ new.rs
@@ -0,0 +1,5 @@
+x
diff --git gone.rs gone.rs
--- gone.rs
+++ /dev/null
@@ -1 +1 @@
"""


def test_diff(spark):
    got = gitdiff.parse_diff(spark.createDataFrame([(DIFF,)], "text string"))
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([("a.rs", False, 3, 6), ("a.rs", False, 12, 12), ("new.rs", True, None, None)], got.schema).collect()))
    assert gitdiff.parse_diff(spark.createDataFrame([("",)], "text string")).count() == 0


RUST = '''
//! inner
use std::fmt;
/// Documented.
#[inline]
pub fn plain(a: bool, b: bool) -> i32 { if a && b || !a { 1 } else if b { 2 } else { 3 } }
mod outer {
    pub struct W<T> { x: T }
    impl<T: Clone> W<T> where T: Sized {
        fn run(&self, v: &'static str) -> Result<(), String> {
            let Some(c) = v.chars().next() else { return Err("{".into()); };
            'top: loop {
                match c { 'a' | 'b' if v.len() > 1 => break 'top, '\\'' => {} _ => continue }
            }
            let f = |x: u32| -> u32 { if x > 1 { x } else { 0 } };
            let s = Foo { a: if true { 1 } else { 2 }, ..Default::default() };
            for i in 0..3 { while let Some(_) = self.next()? { fn inner() { loop {} } } }
            println!("{}", if true { 1 } else { 2 });
            Ok(())
        }
    }
    trait T { fn no(&self); fn yes(&self) { let _x = r#"if "quoted" {"#; } }
}
impl fmt::Display for &'static Bar { fn fmt(&self) -> bool { a < b && (c as usize) < d } }
'''


def test_rust_counts():
    got = {f["qualified_name"]: f for f in rust.rust_functions(RUST)}
    assert set(got) == {"plain", "outer::W::run", "outer::W::inner", "outer::T::yes", "<unknown>::fmt"}
    assert got["plain"]["complexity"] == 1 + 1 + 1 + 1 + 1  # if, &&, ||, else if
    assert (got["plain"]["start_line"], got["plain"]["end_line"]) == (4, 6)
    # let-else, loop, match 2, break, continue, if in closure 2, for, while 2 (its condition is not looked into)
    assert got["outer::W::run"]["complexity"] == 1 + 1 + 1 + 2 + 1 + 1 + 2 + 1 + 2
    assert got["outer::W::inner"]["complexity"] == 2
    assert got["<unknown>::fmt"]["complexity"] == 2
    flat = {f["qualified_name"]: f for f in rust.rust_functions(RUST, "cyclomatic")}
    # let-else, loop, 2 arms, break, continue, if, struct field's if, for, while, ?
    assert flat["outer::W::run"]["complexity"] == 1 + 1 + 1 + 2 + 1 + 1 + 1 + 1 + 1 + 1 + 1
    for f in [*got.values(), *flat.values()]:
        assert sum(c["increment"] for c in f["contributors"]) == f["complexity"] - 1
        assert [(c["line"], c["column"]) for c in f["contributors"]] == sorted((c["line"], c["column"]) for c in f["contributors"])
    for bad in ("fn f( {", "fn f() { if }", 'fn f() { "open }', "fn f() { (] }"):
        with pytest.raises(ValueError):
            rust.rust_functions(bad)


SCRIPT = """
import { x, type Y } from './y';
export const add = (a: number, b?: Map<string, number[]>): number => a && b ? 1 : 2;
export default class Widget<T extends object = {}> extends Base<T> implements I {
  #secret = () => this.a?.b?.[0] ?? 1;
  static { if (x) { y(); } }
  private async *run<K>(this: Widget<T>, k: K): AsyncGenerator<K> { for await (const v of k as any) { yield v! } }
  get 'odd name'() { return /[/]if(/.test(`${x ? `${y || z}` : 1}`); }
  [computed()]() {}
}
namespace A.B { export function f(q) { switch (q) { case 1: case 2: return 1; default: return 0 } } function g() { try { h() } catch { } finally { } } }
type U = { [k: string]: (a: number) => void } | `x${string}`;
function outer() { const inner = function () { do { } while (a < b && c > d); }; return list.map(v => v > 1 ? <T,>(z: T) => z : null); }
if (top || level) { }
"""


def test_script_counts():
    got = {}
    for f in typescript.script_functions(SCRIPT, "a.ts"):
        got[f["qualified_name"]] = f["complexity"]
    assert got == {
        "add": 3, "Widget.#secret": 3, "Widget.<static-init>": 2, "Widget.run": 2, "Widget.odd name": 3, "Widget.<computed>": 1, "A.B.f": 3, "A.B.g": 2, "inner": 3, "<arrow>": 2, "outer": 1,
    }
    page = "const V = ({ a }) => (<div className={a ? 'x' : 'y'} {...p}>text {a && <b>it's</b>} </div>);\nmodule.exports = { go() { return 1 }, f: () => 2 };"
    assert [(f["qualified_name"], f["complexity"]) for f in typescript.script_functions(page, "v.jsx")] == [("V", 3), ("<anonymous>", 1), ("<arrow>", 1)]
    one = typescript.script_functions("/* é */ function f() { if (é) {} }", "a.js")[0]
    assert (one["start_column"], one["contributors"][0]["column"]) == (10, 25)  # in bytes
    for bad in ("function f( {", "const = 1", "f(", "`${"):
        with pytest.raises(ValueError):
            typescript.script_functions(bad, "a.ts")


def test_discovery_and_extraction(spark, tmp_path):
    root = tmp_path / "src"
    for name, text in {"b.rs": "fn b() {}", "a/x y+z.rs": "fn a() { loop {} }", "broken.rs": "fn (", "skip/c.rs": "fn c() {}", "gen.rs": "fn g() {}", ".hidden.rs": "fn h() {}", "A.RS": "", "n.txt": ""}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    subprocess.run(["git", "init", "-q"], cwd=tmp_path, check=True)
    (root / ".gitignore").write_text("gen.rs\n")
    found = files.discover_roots([str(root)], ("rs",), ["skip/**"])
    assert [k for k, _ in found] == ["a/x y+z.rs", "b.rs", "broken.rs"]
    assert "gen.rs" in [k for k, _ in files.discover_roots([str(root)], ("rs",), gitignore=False)]
    functions, bad = files.extract(files.read_sources(spark, found), "rust", "cognitive")
    assert [(r["file_path"], r["qualified_name"], r["complexity"]) for r in functions.orderBy("ordinal").collect()] == [("a/x y+z.rs", "a", 2), ("b.rs", "b", 1)]
    assert [r["file_path"] for r in bad.collect()] == ["broken.rs"]
    with pytest.raises(files.MetricNotSupported):
        files.extract(files.read_sources(spark, found), "typescript", "cognitive")


def test_globs():
    import re

    for pattern, path, fits in [("src/*.rs", "src/a/b.rs", True), ("**/f.rs", "f.rs", True), ("**/f.rs", "a/b/f.rs", True), ("a/**", "a/b/c", True), ("a/**", "a", False), ("{a,b}.rs", "b.rs", True), ("[!a].rs", "a.rs", False), ("a?c", "abc", True), ("a.c", "abc", False)]:
        assert bool(re.match(glob_regex(pattern), path)) == fits, (pattern, path)


def test_config_checks_and_precedence():
    text = """threshold = 20.0
metric = "cyclomatic"
src = "lib"
exclude = ["a", "b"]
[[overrides]]
pattern = "x/**"
threshold = 8
[language.rust]
preset = "strict"
exclude = ["b", "c"]
[views.ci]
top = 5
sort = "path"
[output]
annotation_limit = 3
[delta]
epsilon = 0.5
"""
    c = config.parse_config(text)
    e = config.effective(config.Flags(exclude=("z", "a")), c, "rust")
    assert (e.threshold, e.metric, e.src, e.exclude, e.annotation_limit, e.epsilon, e.overrides) == (8.0, "cyclomatic", ("lib",), ("z", "a", "b", "c"), 3, 0.5, (("x/**", 8.0),))
    assert config.effective(config.Flags(), c, "typescript").threshold == 20.0
    assert config.effective(config.Flags(lenient=True), c, "rust").threshold == 25.0
    assert config.effective(config.Flags(), None, "rust").threshold == 15.0
    assert config.view_preset(c, "ci")["top"] == 5
    with pytest.raises(config.ConfigError, match="available presets: ci"):
        config.view_preset(c, "no")
    for bad in ('threshold = 1\npreset = "strict"', "threshold = 0", "odd = 1", 'metric = "x"', "[output]\nannotation_limit = 0", "[delta]\nepsilon = -1.0", '[views.x]\nsort = "y"', "[views.x]\nmin_coverage = 50.0\nmax_coverage = 1.0", "[language.rust]\nthreshold = -1.0", "x = ["):
        with pytest.raises(config.ConfigError):
            config.parse_config(bad)


def test_files_of_one_partition_are_dealt(spark):
    """Parsing is dealt over the cores, however the table of sources lies."""
    rows = [(f"f{i}.rs", i, f"fn f{i}() {{ if x {{ }} }}") for i in range(200)]
    functions, faults = files.extract(spark.createDataFrame(rows, "file_path string, place long, text string").coalesce(1), "rust", "cognitive")
    assert functions.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert sorted(r["qualified_name"] for r in functions.collect()) == sorted(f"f{i}" for i in range(200))
    assert faults.count() == 0
