import pytest

from codeloom.plans import tools
from codeloom.sources.registry import Registry

FILES = {
    "src/math.ts": "export function add(a, b) {\n  return a;\n}\nexport function multiply(a, b) {\n  return add(a, b);\n}\n",
    "src/index.ts": "import { add } from './math';\nexport function main() {\n  add(1, 2);\n  multiply(1, 2);\n}\n",
    "src/log.ts": "export class Logger {\n  info(x) { write(x); }\n  warn(x) { write(x); }\n}\nfunction write(x) {\n}\n",
}


@pytest.fixture
def root(tmp_path):
    for name, text in FILES.items():
        (tmp_path / "repo" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / name).write_text(text)
    return tmp_path / "repo"


def test_index_and_ask(spark, root, tmp_path):
    registry = Registry(spark, f"file://{tmp_path}/store")
    assert tools.analyze(spark, registry, "one", str(root), embed=True) == {"mode": "full", "changed": 3, "failed": 0}
    assert tools.analyze(spark, registry, "one", str(root)) == {"mode": "fresh", "changed": 0, "failed": 0}
    s = tools.Session(registry)
    assert {r.name for r in s.call("query", query="add!").collect()} == {"add"}
    assert {r.name for r in s.call("find_referencing", name="add").collect()} == {"main", "multiply"}
    assert {r.name for r in s.call("impact", target="main").collect()} == {"add", "multiply"}
    assert {(r.from_name, r.to_name) for r in s.call("cypher", query="MATCH (a)-[r:MEMBER_OF]->(b)").collect()} == {("info", "Logger"), ("warn", "Logger")}
    assert [r.name for r in s.call("get_symbols_overview", file="src/log.ts").collect()] == ["Logger", "write"]
    assert s.call("find_symbol_body", name="add").first()["body"].startswith("export function add")
    assert s.call("symbol_coordinates", name="main").first()["start_line"] == 2
    assert s.call("context", name="add").filter("direction = 'incoming'").count() == 2
    assert s.call("rename", symbol="add", new_name="plus").first()["status"] == "planned"
    assert s.sql("SELECT count(*) FROM process_steps WHERE name = 'main'").first()[0] == 3
    assert s.resource("context").first()["nodes"] == 7
    assert s.resource("clusters").count() >= 1 and s.resource("processes").count() >= 1 and s.resource("schema").count() > 10
    assert "one/clusters" in s.resources()
    with pytest.raises(tools.ToolError):
        s.call("nothing")
    with pytest.raises(tools.ToolError):
        s.resource("nothing")


def test_incremental_index_keeps_other_files(spark, root, tmp_path):
    registry = Registry(spark, f"file://{tmp_path}/store")
    tools.analyze(spark, registry, "one", str(root))
    (root / "src/math.ts").write_text("export function plus(a, b) {\n  return write(a);\n}\n")
    (root / "src/index.ts").unlink()
    s = tools.Session(registry)
    assert {(r.path, r.status) for r in s.call("detect_changes").collect()} == {("src/math.ts", "modified"), ("src/index.ts", "deleted")}
    assert tools.analyze(spark, registry, "one", str(root)) == {"mode": "incremental", "changed": 2, "failed": 0}
    assert {r.name for r in registry.read("one", "nodes").collect()} == {"plus", "Logger", "info", "warn", "write"}
    # The changed file's call finds a symbol of a file that didn't change.
    assert {r.name for r in s.call("find_referencing", name="write").collect()} >= {"plus", "info", "warn"}


def test_partial_index_keeps_edges_of_other_files(spark, root, tmp_path):
    """The defining file changes, a broken one comes, the ignore file counts; edges are those of a full build."""
    (root / ".gitignore").write_text("secret*\n")
    (root / "secret.ts").write_text("export function hidden() {}\n")
    registry = Registry(spark, f"file://{tmp_path}/store")
    tools.analyze(spark, registry, "one", str(root))
    assert registry.read("one", "nodes").filter("name = 'hidden'").count() == 0
    (root / "src/math.ts").write_text(FILES["src/math.ts"] + "export function more(a) {\n  return a;\n}\n")
    (root / "src/cut.ts").write_text("export function f<T")
    s = tools.Session(registry, "one")
    assert {(r.path, r.status) for r in s.call("detect_changes").collect()} == {("src/math.ts", "modified"), ("src/cut.ts", "added")}
    assert tools.analyze(spark, registry, "one", str(root))["mode"] == "incremental"
    tools.analyze(spark, registry, "two", str(root))
    one, two = (sorted(map(tuple, registry.read(name, "edges").collect())) for name in ("one", "two"))
    assert one == two and {r.name for r in s.call("find_referencing", name="add").collect()} == {"main", "multiply"}


def test_registry(spark, root, tmp_path):
    registry = Registry(spark, f"file://{tmp_path}/store")
    assert registry.all() == [] and registry.resolve() == "" and registry.frame().count() == 0
    tools.analyze(spark, registry, "one", str(root))
    assert registry.resolve() == "one" and registry.get("one")["path"] == str(root)
    registry.register("inner", str(root / "src"))
    assert registry.resolve() == "" and registry.find(str(root / "src/x.ts"))["name"] == "inner"
    s = tools.Session(registry, "inner")
    got = s.call("query_repo", tool="symbol_coordinates", target="one", name="main").first()
    assert (got.target_repo, got.current_repo, got.tool) == ("one", "inner", "symbol_coordinates")
    for tool in ("rename", "query_repo"):
        with pytest.raises(tools.ToolError):
            s.call("query_repo", tool=tool, target="one")
    with pytest.raises(tools.ToolError):
        tools.Session(registry, "gone").call("query", query="x")
    assert registry.unregister("one") and not registry.unregister("one")
    assert registry.read("one", "nodes").count() == 0
