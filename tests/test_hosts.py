import json

from pyspark.sql import functions as F

from scrollmill.functions.tokens import prefix_end
from scrollmill.operators import enrich, hosts, search

A, B, C = (f"{x * 8}-0000-4000-8000-{x * 12}" for x in "abc")


def wire(**agent):
    base = {"workspace_id": "w1", "pane_id": "p", "agent": "claude", "name": None, "cwd": "/x", "agent_session": None}
    return base | agent


def test_agents_of(spark):
    session = {"source": "host:claude", "agent": "claude", "kind": "id", "value": A}
    agents = [wire(pane_id="1", agent_session=session), wire(pane_id="2", agent="codex", agent_session=session), wire(pane_id="3", agent="other"), wire(pane_id="4", agent=None),
              wire(pane_id="5", agent_session=session | {"kind": "path"}), wire(pane_id="6", agent_session=session | {"source": "else:claude"})]
    answers = spark.createDataFrame([(json.dumps({"result": {"agents": agents}}),), ("{",), (None,), ("{}",)], "answer string")
    got = {r["id"]: (r["agent"], r["session_id"]) for r in hosts.agents_of(answers, "host").collect()}
    assert got == {"1": (0, A), "2": (1, None), "5": (0, None), "6": (0, None)}


def test_only_a_single_match_counts(spark):
    sessions = spark.createDataFrame([(0, A, "/x"), (0, B, "/x"), (0, C, "/y"), (1, A, "/x"), (0, "no id", "/x"), (0, None, None)], "agent int, native_id string, cwd string")
    workspaces = spark.createDataFrame([("w1", "/x", 0), ("w9", "/x", 1), ("w2", "/y", 2)], "workspace_id string, cwd string, place int")
    name = spark.range(1).select(enrich.resume_name(F.lit(B))).first()[0]
    rows = [("1", "w1", 0, A, None, "/x"), ("2", "w1", 0, None, name, "/x"), ("3", "w2", 0, C, None, "/y"), ("4", "w2", 0, C, None, "/z"), ("5", "w9", 1, A, None, "/x"), ("6", "w1", 1, None, None, "/x")]
    agents = spark.createDataFrame(rows, "id string, workspace_id string, agent int, session_id string, name string, cwd string")
    key = lambda df: {(r["agent"], r["native_id"], r["id"]) for r in df.collect()}
    assert key(hosts.matching(sessions, workspaces, agents)) == {(0, A, "1"), (0, B, "2")}
    assert key(hosts.sole_in_folder(sessions, workspaces, agents)) == {(0, C, "3"), (1, A, "6")}
    served = spark.createDataFrame([(0, C), (0, "gone")], "agent int, native_id string")
    live = {(r["agent"], r["native_id"], r["grp"]) for r in hosts.live_sessions(sessions, workspaces, agents, served).collect()}
    assert live == {(0, A, 0), (0, B, 0), (0, C, 0)}
    assert hosts.live_sessions(sessions.limit(0), workspaces.limit(0), agents.limit(0), served.limit(0)).count() == 0


def test_notices(spark):
    rows = spark.createDataFrame([("focused", 0, "o/r"), ("started", 1, None), ("running", 1, "o/r")], "o string, a int, r string")
    got = [r[0] for r in rows.select(hosts.notice(F.col("o"), F.col("a"), F.col("r"))).collect()]
    assert got[:2] == ["Opened running Claude session in o/r", "Resumed Codex session"] and got[2].startswith("This Codex session is already running")


def test_prefix_end_and_percentiles(spark):
    last = chr(0x10FFFF)
    for prefix in ("k", "kz", chr(0xD7FF), "k" + last, "日"):
        end = prefix_end(prefix)
        assert end > prefix + last * 3 and not any(0xD800 <= ord(c) < 0xE000 for c in end)
    assert prefix_end(chr(0xD7FF)) == chr(0xE000) and prefix_end("k" + last) == "l" and prefix_end(last) == last * 2
    times = [5.0, 1.0, 9.0, 1.0, 7.0, 3.0, None]
    got = {r["p"]: r["value"] for r in search.percentiles(spark.createDataFrame([(t,) for t in times], "t double"), "t", [0, 50, 95, 100]).collect()}
    known = sorted(t for t in times if t is not None)
    assert got == {p: known[min(len(known) * p // 100, len(known) - 1)] for p in (0, 50, 95, 100)}
    assert search.percentiles(spark.createDataFrame([], "t double"), "t", [50]).count() == 0
