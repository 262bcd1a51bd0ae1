import pytest

from codeloom.plans import cypher, raw_sql
from codeloom.sources import extract, scan
from codeloom.sources.extract import extract_file

from .test_graph import edges, f, nodes

TS = """import { add } from './math';
import type { User } from "./user";
export { greet } from './greeter';
// function hidden() {}
export const PI = 3.14;
export class Controller extends Base implements Api {
  private svc: Service;
  constructor(svc: Service) { this.svc = svc; }
  async handleGet(id: string): Promise<User> {
    if (id) { return this.svc.get(id); }
    return add("function no() {", 2);
  }
}
interface User { id: string; }
export const run = async (x: number) => { helper(x); };
function helper(x) {
  new Controller(x);
  return x;
}
"""


def test_typescript():
    got = extract_file("/p/c.ts", TS)
    assert {(n[1], n[2], n[5]) for n in got.nodes} == {("Controller", "Class", True), ("constructor", "Method", True), ("handleGet", "Method", True), ("User", "Interface", False), ("run", "Function", True), ("helper", "Function", False)}
    lines = {n[1]: (n[3], n[4]) for n in got.nodes}
    assert lines["Controller"] == (6, 13) and lines["handleGet"] == (9, 12) and lines["helper"] == (16, 19)
    assert {(i[0], i[2]) for i in got.imports} == {("./math", False), ("./user", True), ("./greeter", False)}
    called = {c[1] for c in got.calls}
    assert {"this.svc.get", "add", "helper", "EXTENDS:Base", "IMPLEMENTS:Api"} == called
    assert len(got.owners) == 2
    import hashlib

    assert {n[0] for n in got.nodes if n[1] == "handleGet"} == {hashlib.sha256(b"/p/c.ts:Controller.handleGet:Method").hexdigest()[:16]}


def test_go():
    got = extract_file("pkg/a.go", 'package a\nimport (\n  f "fmt"\n  "os"\n)\ntype Store struct {\n  x int\n}\ntype Reader interface { Read() }\ntype ID string\nfunc (s *Store) Get(k string) error {\n  return helper(k)\n}\nfunc helper(k string) error { os.Exit(1); return nil }\n')
    assert {(n[1], n[2], n[5], n[6]) for n in got.nodes} == {("Store", "Class", True, "pkg"), ("Reader", "Interface", True, "pkg"), ("ID", "Type", True, "pkg"), ("Get", "Method", True, "pkg"), ("helper", "Function", False, "pkg")}
    assert {(i[0], i[1]) for i in got.imports} == {("fmt", "f"), ("os", "")}
    assert [c[1] for c in got.calls] == ["helper"]


def test_python():
    got = extract_file("a.py", "import os\nfrom .x import y\nclass A:\n    def run(self):\n        def inner(): pass\n        return self.b.c(1)\ndef _hidden(): pass\n")
    assert {(n[1], n[2], n[5]) for n in got.nodes} == {("A", "Class", True), ("run", "Function", True), ("_hidden", "Function", False)}
    assert [i[0] for i in got.imports] == [".x"] and [c[1] for c in got.calls] == ["self.b.c"]
    assert not extract_file("a.py", "def (").nodes


def test_other_languages():
    java = extract_file("A.java", "import java.util.List;\npublic class A {\n  private int x;\n  public A() { }\n  public List<String> get(int k) throws E { return other(k); }\n  void other(int k) { }\n}\ninterface B { void run(); }\nenum C { X }\n")
    assert {(n[1], n[2]) for n in java.nodes} >= {("A", "Class"), ("get", "Method"), ("other", "Method"), ("B", "Interface"), ("run", "Method"), ("C", "Class")}
    assert java.imports[0][0] == "java.util.List" and not java.calls
    rust = extract_file("a.rs", "use std::io::{Read, Write};\npub fn run(x: u8) -> u8 { helper(x); x.go(); y::z(1) }\nfn helper(x: u8) {}\npub struct S { a: u8 }\ntrait T { fn t(&self); }\n")
    assert {(n[1], n[2], n[5]) for n in rust.nodes} >= {("run", "Function", True), ("helper", "Function", False), ("S", "Class", False), ("T", "Interface", False)}
    assert "helper" in {c[1] for c in rust.calls} and "x.go" not in {c[1] for c in rust.calls}
    cpp = extract_file("a.cpp", '#include <vector>\n#include "b.h"\nclass A {\n public:\n  int get(int x) const { return help(x); }\n};\nint help(int x) { return x; }\n')
    assert {(n[1], n[2]) for n in cpp.nodes} >= {("A", "Class"), ("get", "Function"), ("help", "Function")}
    assert [i[0] for i in cpp.imports] == ["vector", "b.h"] and "help" in {c[1] for c in cpp.calls}
    with pytest.raises(extract.UnknownLanguage):
        extract_file("a.c", "int x;")


def test_extract_table(spark):
    files = spark.createDataFrame([("/p/c.ts", TS), ("x.unknown", "?"), ("e.ts", ""), ("n.ts", None)], "path string, text string")
    found = extract.records(files)
    assert extract.nodes_of(found).count() == 6 and extract.owners_of(found).count() == 2 and extract.imports_of(found).count() == 3


def test_scan(spark, tmp_path):
    for name in ("src/main.ts", "node_modules/pkg/index.js", "app.js", "app.min.js", "secret.ts", "docs/a.md", "build/out.ts", "keep/secret.ts"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("export function a() {}\n")
    got = scan.scan(spark, str(tmp_path), ["# c", "", "/secret.ts", "build/"])
    assert {r.path for r in got.collect()} == {"src/main.ts", "app.js", "keep/secret.ts"}
    assert scan.scan(spark, str(tmp_path), known_only=False).filter("path = 'docs/a.md'").count() == 1


@pytest.mark.parametrize(("pattern", "path", "hit"), [("*.log", "a/b.log", True), ("/x", "a/x", False), ("/x", "x/y", True), ("a/**/b", "a/c/d/b", True), ("a/**/b", "a/b", True), ("tmp/", "tmp", False), ("tmp/", "q/tmp/f", True), ("f?o", "fxo", True), ("f[ab]o", "fco", False), ("*.ts", "a/b.tsx", False)])
def test_ignore_lines(spark, pattern, path, hit):
    from pyspark.sql import functions as F

    assert spark.range(1).select(scan.ignored(F.lit(path), [pattern])).first()[0] is hit
    assert spark.range(1).select(scan.ignored(F.lit(path), [pattern, "!" + pattern])).first()[0] is False


@pytest.fixture
def graph(spark):
    n = nodes(spark, f("n1", "main", "main.go"), f("n2", "O'Neil", "b.go", "Class", 7), f("n3", "helper", "c.go", first=9, exported=False))
    return n, edges(spark, ("n1", "n2", "CALLS", 0.9), ("n1", "n3", "CALLS", 0.5), ("n2", "n3", "IMPORTS", 1))


@pytest.mark.parametrize(("text", "want"), [
    ("MATCH (n:Function) RETURN n.name", {("main",), ("helper",)}),
    ("match (n:Function {name: 'main'}) return n.uid", {("n1",)}),
    ("MATCH (n) WHERE n.filePath = 'main.go' RETURN n.name", {("main",)}),
    ("MATCH (n) WHERE n.name = 'O''Neil' RETURN n.uid AS id", {("n2",)}),
    ("MATCH (n) WHERE NOT n.exported = true OR (n.startLine > 5 AND n.kind <> 'Function') RETURN n.uid", {("n2",), ("n3",)}),
    ("MATCH (n) WHERE n.name CONTAINS 'el' AND n.name ENDS WITH 'er' RETURN n.uid LIMIT 5;", {("n3",)}),
    ("MATCH (n) WHERE n.uid IN ['n1', 'n3'] AND n.clusterId IS NOT NULL RETURN n.uid", {("n1",), ("n3",)}),
    ("MATCH (a:Function)-[r:CALLS]->(b) WHERE r.confidence > 0.8 RETURN a.name", {("main", "O'Neil", "CALLS", 0.9)}),
    ("MATCH (b)<-[r]-(a {name: 'main'}) WHERE b.kind = 'Function'", {("main", "helper", "CALLS", 0.5)}),
])
def test_patterns(graph, text, want):
    assert {tuple(r) for r in cypher.run(text, *graph).collect()} == want


@pytest.mark.parametrize("text", ["CREATE (n)", "MATCH n", "MATCH (n) WHERE n.secret = 1", "MATCH (n) RETURN m.name", "MATCH (n) LIMIT x", "MATCH (n) WHERE n.name ~ 'x'", ""])
def test_wrong_patterns(graph, text):
    with pytest.raises(cypher.PatternError):
        cypher.run(text, *graph)


def test_raw_sql(spark, graph):
    n, e = graph
    got = raw_sql.run(spark, "SELECT name, kind FROM nodes WHERE name LIKE 'MAIN' -- x", nodes=n, edges=e)
    assert got.columns == ["name", "kind"] and got.count() == 1
    assert raw_sql.run(spark, "SELECT count(*) AS n FROM nodes WHERE file_path GLOB '?.go'", nodes=n).first()[0] == 2
    for bad in ("DROP TABLE nodes", "SELECT 1; SELECT 2", "INSERT INTO nodes SELECT 1", "WITH x AS (SELECT 1) INSERT INTO nodes SELECT * FROM x"):
        with pytest.raises(raw_sql.NotReading):
            raw_sql.checked(bad)
    assert raw_sql.checked("SELECT 'a;b; drop table x'")


def test_broken_files_touch_no_others(spark):
    from codeloom.sources import extract

    files = spark.createDataFrame([("a.ts", "export function f<T"), ("b.ts", "function g() {}"), ("c.txt", "x"), ("d.py", None)], "path string, text string")
    found = extract.records(files)
    assert [r.name for r in extract.nodes_of(found).collect()] == ["g"] and extract.failures_of(found).count() == 0
    row = ("failed", None, "KeyError", None, "e.rs", None, None, None, None, "no", None)
    assert extract.failures_of(spark.createDataFrame([row], extract.KINDS)).first().asDict() == {"file_path": "e.rs", "error": "KeyError", "message": "no"}
