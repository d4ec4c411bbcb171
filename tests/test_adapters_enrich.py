import datetime as dt
import json

from pyspark.sql import functions as F

from scrollmill.operators import adapters, enrich

RAW = "record_id bigint, file_id bigint, agent int, byte_start bigint, line string, kind string"


def raw(spark, rows):
    return spark.createDataFrame([(i, 1, a, i * 10, r if isinstance(r, str) or r is None else json.dumps(r), "x") for i, (a, r) in enumerate(rows)], RAW)


def test_events(spark):
    block = lambda *b: {"content": [{"type": t, "text": x} for t, x in b]}
    rows = [
        (0, {"type": "user", "message": {"content": "hi"}}), (0, {"type": "assistant", "message": block(("text", "a"), ("tool_use", "no"), ("text", "b"))}),
        (0, {"type": "user", "message": {"content": [{"type": "tool_result", "content": "x"}]}}), (0, {"type": "user", "isMeta": True, "message": {"content": "m"}}),
        (0, {"type": "system", "message": {"content": "s"}}), (0, {"type": "user", "content": "direct"}), (0, {"type": "user", "message": {"content": "   "}}), (0, "{"), (0, None),
        (1, {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "out"}]}}),
        (1, {"type": "response_item", "payload": {"type": "message", "role": "assistant", "channel": "analysis", "content": "no"}}),
        (1, {"type": "response_item", "payload": {"type": "message", "role": "user", "channel": "analysis", "content": "yes"}}),
        (1, {"type": "response_item", "payload": {"type": "message", "role": "developer", "content": "no"}}), (1, {"type": "event_msg", "payload": {"type": "message", "role": "user", "content": "no"}}),
        (1, {"type": "message", "role": "user", "content": "bare"}), (1, {"type": "response_item", "payload": {"type": "function_call_output", "output": "no"}}), (None, {"type": "user", "content": "no"}),
    ]
    df = raw(spark, rows).drop("kind")
    got = {r["record_id"]: (r["kind"], r["text"]) for r in adapters.events(df).collect()}
    assert got == {0: (0, "hi"), 1: (1, "a\nb"), 5: (0, "direct"), 9: (1, "out"), 11: (0, "yes"), 14: (0, "bare")}
    assert adapters.events(df.limit(0)).count() == 0


def test_session_facts(spark):
    rows = [
        (0, {"sessionId": "s1", "cwd": "/a", "timestamp": "bad", "gitBranch": 7}), (0, {"session_id": "s2", "timestamp": "2026-01-01T00:00:00.5+02:00", "gitBranch": "HEAD"}),
        (0, {"cwd": "/b", "timestamp": "2026-01-02T00:00:00Z", "git_branch": "main", "prRepository": "o/n"}), (0, "{"),
    ]
    r = adapters.session_facts(raw(spark, rows)).first()
    assert (r["native_id"], r["cwd"], r["branch"], r["repository"], r["n_malformed"]) == ("s2", "/b", "main", "o/n", 1)
    assert r["started_at"] == dt.datetime(2025, 12, 31, 22, 0, 0, 500000)


def test_labels_and_plans(spark):
    urls = {"https://h.org/a/b.git": "a/b", "git@h.org:o/n.git": "o/n", "/srv/x/y": "y", "ssh://g@h/o/n/": "o/n", "": None, None: None}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r["u"]: r["l"] for r in df.select("u", adapters.repository_label(F.col("u")).alias("l")).collect()} == urls
    ids = ["00000000-0000-0000-0000-000000000000", "ffffffff-ffff-ffff-ffff-ffffffffffff", "12345678-9ABC-def0-1234-56789abcdef0", "no", None]

    def base36(u):
        n, out = int(u.replace("-", ""), 16), ""
        for _ in range(25):
            n, d = divmod(n, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
        return "ah-" + out

    got = spark.createDataFrame([(i, u) for i, u in enumerate(ids)], "i int, native_id string").select("i", enrich.resume_name(F.col("native_id")).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in got] == [*map(base36, ids[:3]), None, None]
    paths = spark.createDataFrame([("/",), ("/a/b",), ("a",), ("/a/../b",), ("/a/",), ("/a/.git",), (None,)], "p string")
    assert [r[0] for r in paths.select(enrich.is_clean_path(F.col("p"))).collect()] == [True, True, False, False, False, False, False]


def test_served_and_live(spark):
    u, v = "11111111-1111-1111-1111-111111111111", "22222222-2222-2222-2222-222222222222"
    lines = spark.createDataFrame([(f"claude --session-id {u}",), (f"claude --resume /x/{v}.jsonl --resume nope",), (f"/bin/codex resume {u}",), (f"other resume {v}",), (None,), ("",)], "line string")
    served = enrich.served_sessions(lines)
    assert {tuple(r) for r in served.collect()} == {(0, u), (0, v), (1, u)}
    sessions = spark.createDataFrame([(0, u), (0, v), (1, u), (0, "z")], "agent int, native_id string")
    agents = spark.createDataFrame([(v, "Blocked"), ("z", "idle"), ("z", "done")], "session_id string, state string")
    got = {(r["agent"], r["native_id"]): r["grp"] for r in enrich.live_priorities(sessions, agents, served).collect()}
    assert got == {(0, u): 5, (0, v): 0, (1, u): 5}


def test_observe(tmp_path):
    assert enrich.observe(str(tmp_path))["root"] is None


def test_only_complete_objects_are_records(spark):
    good = ['{"a":1}', ' {"a":[{"b":1}]} ', "{}"]
    bad = ['{"a":1} x', '{"a":1}]', '{"a":1}}', '{"a":1}]}', '{"a":1}]}}', '{"a":1},{"b":2}', '{"a":1}],[{"b":2}', '{"a":1},"z":2', '"type": "u"', "[1]", '{"a":1', "", "{", None, "3", '{"a":NaN}']
    rows = adapters.parse(spark.createDataFrame([(0, x) for x in good + bad], "agent int, line string"))
    assert sorted(r["line"] for r in rows.filter("v is not null").collect()) == sorted(good)
