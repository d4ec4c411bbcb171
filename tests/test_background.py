import threading

from pyspark.sql import functions as F

from scrollmill.operators import enrich, hosts
from scrollmill.plans.ingest import Report
from scrollmill.sources.store import Store
from scrollmill.streaming.background import LOOK, RESCAN, SETTLE, Cadence, Scan


def test_a_scan_beside_a_reader(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.jsonl").write_text('{"type":"user","message":{"content":"one"}}\n{"type":"assistant","message":{"content":"two"}}\n')
    store = Store(spark, str(tmp_path / "store"))
    scan = Scan(store, {0: [str(root)]})
    scan._thread.join()
    got = scan.snapshot()
    assert got.finished and got.committed_chunks == 1 and got.report.records == 2 and store.version == 1

    begun = threading.Event()

    def slow(store, roots, stop):
        begun.set()
        while not stop():
            pass
        return Report(stopped=True)

    with Scan(store, {}, slow) as scan:
        begun.wait()
        assert not scan.snapshot().finished
    assert scan.snapshot().report.stopped and scan.snapshot().committed_chunks == 0

    def broken(store, roots, stop):
        raise OSError("no disk")

    assert Scan(store, {}, broken).stop().error == "OSError: no disk"


def test_cadence():
    now = [0.0]
    c = Cadence(lambda: now[0])
    assert c.should_scan(False) and not c.should_scan(False)
    now[0] += RESCAN
    assert not c.should_scan(True) and c.should_scan(False)
    c.press()
    assert not c.should_look(False, False)
    now[0] += SETTLE
    assert c.should_look(False, False) and not c.should_look(True, True)
    now[0] += LOOK
    assert not c.should_look(True, False) and c.should_look(True, True)


def test_host_wire_and_missing_sessions(spark):
    answers = spark.createDataFrame([('{"result":{"workspaces":[{"workspace_id":"w","cwd":"/a"},{"workspace_id":"v"}]}}',), ("x",), (None,)], "answer string")
    assert [tuple(r) for r in hosts.workspaces_of(answers).collect()] == [("w", "/a", 0)]
    blocks = spark.createDataFrame([('[{"claude_session_id":"AB","state":"Working"},{"state":"idle"}]',), ("{",)], "answer string")
    assert [tuple(r) for r in hosts.states_of(blocks).collect()] == [("ab", "working")]
    names = "agent int, native_id string, cwd string, repository string, repository_root string, worktree string, branch string, commit_hash string, source_generation bigint, source_end bigint"
    sessions = spark.createDataFrame([(0, "s", "/a", None, None, None, None, None, 0, 1)], names)
    keys = spark.createDataFrame([(0, "s"), (0, "gone")], "agent int, native_id string")
    paths = spark.createDataFrame([("/a", "Directory")], "path string, state string")
    got = {r["native_id"]: (r["availability"], r["options"]) for r in enrich.availability_of(keys, sessions, paths).collect()}
    assert got == {"s": ("OnDisk", []), "gone": ("TranscriptOnly", [])}
    lines = enrich.running_commands()
    assert any("python" in x for x in lines)
    assert enrich.served_sessions(spark.createDataFrame([(x,) for x in lines], "line string")).filter(F.lit(False)).count() == 0
