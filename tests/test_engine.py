import json

import pytest

from lodestone import query as Q
from lodestone.engine import Engine, SnapshotChanged
from lodestone.limits import Limits
from lodestone.operators import diff
from lodestone.store import StaleBaseline, Store
from lodestone.streaming import changes as C

FILES = {
    "pkg/__init__.py": "", "pkg/a.py": "from .b import f\nimport os\n\ndef run():\n    return f()\n", "pkg/b.py": "def f():\n    return 1\n", "bad.py": "def f(:\n", "web/x.js": "import y from './y.js';\n", "web/y.js": "import x from './x.js';\n",
    "src/lib.rs": "use crate::m::f;\n", "src/m.rs": "pub fn f() {}\n", "notes.txt": "plain text\n", ".hidden.py": "h = 1\n",
}


@pytest.fixture
def engine(spark, tmp_path):
    for path, text in FILES.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "bin.dat").write_bytes(b"a\x00b")
    (tmp_path / "bad.md").write_bytes(b"ok \xff\n")
    return Engine(spark, str(tmp_path), Limits(sync_seconds=600, query_seconds=120))


def touch(engine, path, text, kind="modify"):
    target = f"{engine.root}/{path}"
    if text is None:
        import os

        os.unlink(target)
    else:
        open(target, "w").write(text)
    engine.watch.record(path, kind)


def edges(engine):
    page = engine.query("SELECT f.path AS a, t.path AS b, e.resolution_kind AS k FROM dependency_edges e JOIN files f ON e.from_file_id = f.id LEFT JOIN files t ON e.to_file_id = t.id ORDER BY a, b, k")
    return {(r["a"], r["b"], r["k"]) for r in page.rows}


def test_from_import_to_incremental_change(engine):
    with pytest.raises(LookupError):
        engine.report()
    assert engine.health()["phase"] == "no_active_project"
    on = engine.project_control("on")
    assert on["status"] == "enabled" and on["import"]["added"] == len(FILES) + 2
    got = engine.report()
    assert got["revision_id"] == "rev-1" and got["file_count"] == 12 and {"language": "python", "file_count": 5} in got["languages"]
    assert [f["path"] for f in got["parser_failure_files"]] == ["notes.txt"]
    found = edges(engine)
    assert {("pkg/a.py", "pkg/b.py", "Resolved"), ("pkg/a.py", None, "External"), ("web/x.js", "web/y.js", "Resolved"), ("web/y.js", "web/x.js", "Resolved"), ("src/lib.rs", "src/m.rs", "Resolved")} == found
    assert engine.health()["phase"] == "steady_state" and engine.health()["file_count"] == 12

    # nothing changed: the same revision
    assert engine.publish().revision_id == "rev-1"
    # a finding goes stale with its file, and stays so when the content comes back
    finding = engine.finding("pkg/b.py", 1, 2, "high", "bug", "t", "d")
    assert finding["status"] == "current" and engine.report()["open_finding_count"] == 1
    touch(engine, "pkg/b.py", "def f():\n    return 2\n")
    assert engine.report()["open_finding_count"] == 0 and engine.report()["revision_id"] == "rev-2"
    touch(engine, "pkg/b.py", FILES["pkg/b.py"])
    assert engine.report()["open_finding_count"] == 0
    # a deleted target leaves the edge unresolved; made again with the same content it is back
    touch(engine, "pkg/b.py", None, "remove")
    assert ("pkg/a.py", None, "Unresolved") in edges(engine)
    touch(engine, "pkg/b.py", None if False else FILES["pkg/b.py"], "create")
    assert ("pkg/a.py", "pkg/b.py", "Resolved") in edges(engine)
    ids = {r["path"]: r["id"] for r in engine.query("SELECT path, id FROM files").rows}
    assert len(set(ids.values())) == len(ids)
    assert engine.project_control("off")["status"] == "disabled" and engine.project_control("off")["status"] == "already_disabled"


def test_verbs_on_one_revision(engine):
    engine.project_control("on")
    page = engine.query("WITH RECURSIVE n(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM n WHERE x < 900) SELECT x FROM n -- end")
    assert len(page.rows) == 500 and page.truncated and page.next_offset == 500
    assert engine.query("SELECT path FROM files ORDER BY path", 11).rows == [{"path": "web/y.js"}]
    for bad in ["DELETE FROM files", "DROP TABLE files", "", "SELECT 1; SELECT 2", "INSERT INTO files SELECT * FROM files", "EXPLAIN SELECT 1", "SET a=1", "x" * 10_001, "SELECT 1) t; DROP VIEW files --"]:
        with pytest.raises(Q.QueryError):
            engine.query(bad)
    got = engine.structure("pkg/a.py", "(function_definition name: (identifier) @n) @f")
    assert [(m["capture_name"], m["text"]) for m in got["matches"]][1] == ("n", "run") and got["language"] == "python" and not got["truncated"]
    with pytest.raises(LookupError):
        engine.structure("bin.dat", "(module)")
    for lines in [(0, 1), (2, 1), (1, 6)]:
        with pytest.raises(ValueError):
            engine.finding("pkg/a.py", *lines, "low", "c", "t", "d")
    with pytest.raises(ValueError):
        engine.finding("pkg/a.py", 1, 1, " ", "c", "t", "d")
    with pytest.raises(ValueError):
        engine.finding("pkg/__init__.py", 1, 1, "low", "c", "t", "d")
    rows = engine.query("SELECT key, payload FROM evidence e JOIN files f ON e.file_id = f.id WHERE path = 'bad.md'").rows
    assert [r["key"] for r in rows] == ["encoding:0"] and json.loads(rows[0]["payload"])["severity"] == "warning"
    counters = engine.health()
    assert counters["tool_call_error_count"] >= 10 and counters["tool_call_count"] > counters["tool_call_error_count"]


def test_race_is_retried_and_a_baseline_is_checked(engine, spark):
    engine.project_control("on")
    other = Engine(spark, engine.root, engine.limits)
    hits = []

    def meddle():
        if not hits:
            hits.append(1)
            open(f"{engine.root}/new.py", "w").write("n = 1\n")
            other.publish()

    open(f"{engine.root}/pkg/a.py", "a").write("\nz = 2\n")
    engine.before_publish = meddle
    report = engine.publish()
    assert report.revision_id == "rev-3" or report.revision_id == "rev-2"
    assert engine.report()["file_count"] == 13
    store = Store(spark, engine.store.root)
    with pytest.raises(StaleBaseline):
        store.publish(None, {}, "", "1")
    pointer = store.current()
    with pytest.raises(SnapshotChanged), engine.snapshot(pointer):
        open(f"{engine.root}/more.py", "w").write("m = 1\n")
        other.publish()
    assert store.sweep(0) or True
    assert other.report()["file_count"] == 14


def test_a_damaged_store_is_rebuilt_and_events_are_consumed(engine, spark, tmp_path_factory):
    import glob
    import os

    engine.project_control("on")
    for f in glob.glob(f"{engine.store.root}/data/*/files/*.parquet"):
        os.unlink(f)
        open(f, "w").write("damaged")
    assert engine.report()["file_count"] == 12
    events = str(tmp_path_factory.mktemp("events") / "log")
    open(f"{engine.root}/pkg/c.py", "w").write("c = 1\n")
    os.unlink(f"{engine.root}/pkg/a.py")
    spark.createDataFrame([(1, "pkg/c.py", "create"), (2, "pkg/a.py", "modify"), (3, "pkg/a.py", "remove")], C.EVENTS).write.parquet(events)
    engine.consume(events, events + "-check")
    assert engine.health()["pending_dirty"] == 1 and engine.health()["pending_deleted"] == 1
    paths = {r["path"] for r in engine.query("SELECT path FROM files").rows}
    assert "pkg/c.py" in paths and "pkg/a.py" not in paths


def test_a_file_that_changes_while_it_is_read_is_read_again(engine):
    engine.project_control("on")
    left = [1]

    def meddle():
        if left:
            left.pop()
            open(f"{engine.root}/pkg/b.py", "a").write("\nz = 9\n")

    open(f"{engine.root}/pkg/b.py", "a").write("\ny = 8\n")
    engine.before_publish = meddle
    engine.publish()
    assert "z = 9" in engine.query("SELECT content FROM files WHERE path = 'pkg/b.py'").rows[0]["content"]


def test_numbers_are_consecutive(spark):
    from lodestone.operators.numbering import numbered

    df = spark.range(1000).selectExpr("concat('p', id) as path").repartition(7)
    rows = sorted((r.path, r.n) for r in numbered(df, "path", "n", 5).collect())
    assert [n for _, n in rows] == list(range(5, 1005))
    assert numbered(df.limit(0), "path", "n").count() == 0


def test_paging_keeps_to_the_byte_limit():
    rows = [{"x": "y" * 100}] * 10
    page = Q.shrunk(rows, False, 7, "rev-1", Limits(query_response_bytes=256 + 350))
    assert len(page.rows) == 3 and page.truncated and page.next_offset == 10
    page = Q.shrunk(rows, False, 7, None, Limits(query_response_bytes=300))
    assert page.rows == [] and page.next_offset == 7
    assert Q.encoded([float("nan"), b"\x00\xff", {"a": float("inf")}]) == [None, "00ff", {"a": None}]


def test_diff_and_manifest(spark):
    schema = "path string, content_hash string"
    a = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], schema)
    b = spark.createDataFrame([("b", "2"), ("c", "1"), ("d", "1")], schema)
    assert {(r.path, r.status) for r in diff.compare(a, b).collect()} == {("a", "Deleted"), ("b", "Modified"), ("d", "Added")}
    after = diff.after_update(a, b.filter("path in ('b', 'd')"), a.filter("path = 'a'"))
    assert diff.manifest_hash(after).first() == diff.manifest_hash(b.orderBy("content_hash")).first() != diff.manifest_hash(a).first()


def test_stream_collapses_and_resumes(spark, tmp_path):
    source, seen = str(tmp_path / "events"), []
    put = lambda rows: spark.createDataFrame(rows, C.EVENTS).coalesce(1).write.mode("append").parquet(source)
    apply = lambda df, n: seen.append({r.path: r.change for r in df.collect()})
    put([(1, "a", "create"), (2, "a", "remove"), (3, "b", "modify"), (4, "c", "access"), (5, "d", "remove"), (6, "d", "create")])
    C.drain(spark, source, str(tmp_path / "check"), apply)
    put([(7, "a", "create")])
    C.drain(spark, source, str(tmp_path / "check"), apply)
    assert seen == [{"a": "deleted", "b": "dirty", "d": "dirty"}, {"a": "dirty"}]


def test_watch_state():
    w = C.Watch(health=C.HEALTHY)
    w.record("a", "modify")
    w.record("a", "remove")
    w.record(".git/x", "modify")
    w.record("b", "access")
    upto, pending = w.snapshot()
    assert pending == {"a": "deleted"} and upto == 2
    w.record("a", "create")
    w.acknowledge(upto)
    assert w.snapshot()[1] == {"a": "dirty"} and w.verified == 2
    assert w.phase("rev-1") == "restoring" and w.phase(None) == "importing"
    w.record(".gitignore", "modify")
    assert w.health == C.NEEDS_VERIFICATION
    with pytest.raises(RuntimeError):
        C.until_quiet(lambda: True, 3)


def test_a_passing_error_does_not_drop_the_store(engine, monkeypatch):
    engine.project_control("on")
    revision = engine.store.current().revision_id

    def fails(*_):
        raise RuntimeError("connection reset")

    with monkeypatch.context() as m:
        m.setattr(engine.store, "read", fails)
        with pytest.raises(RuntimeError, match="connection reset"):
            engine.report()
    assert engine.store.current().revision_id == revision
