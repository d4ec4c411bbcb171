import datetime as dt
import random

from scrollmill.llm import conversations as c

SCHEMA = "message_id bigint, agent int, session_id string, type string, timestamp timestamp, ordinal bigint, text string, reason string, run int"


def at(i):
    return dt.datetime(2026, 1, 1) + dt.timedelta(seconds=i)


def rows(agent, session, parts):
    """(type, ordinal, text) in order of time."""
    return [(t, o, x, i, agent, session) for i, (t, o, x) in enumerate(parts)]


CASES = {
    "fine": [("user", 0, "a"), ("Assistant ", 1, "b"), ("tool_result", 2, ""), ("assistant", 3, "c")],
    "gap": [("user", 0, "a"), ("assistant", 2, "b")],
    "start": [("user", 1, "a"), ("assistant", 2, "b")],
    "twice": [("user", 0, "a"), ("assistant", 1, "b"), ("assistant", 1, "other")],
    "twice at the start": [("user", 0, "a"), ("user", 0, "other"), ("assistant", 1, "b")],
    "two in a fork": [("user", 0, "a"), ("assistant", 1, "b"), ("user", 1, "c"), ("assistant", 2, "d"), ("assistant", 2, "e")],
    "least of all": [("user", -(1 << 63), "a"), ("assistant", -(1 << 63) + 1, "b")],
    "most of all": [("user", (1 << 63) - 1, "a"), ("assistant", 0, "b")],
    "below zero": [("user", -1, "a"), ("assistant", 0, "b")],
    "repeat": [("user", 0, "a"), ("assistant", 1, "b"), ("ASSISTANT", 1, " b ")],
    "some null": [("user", 0, "a"), ("assistant", None, "b")],
    "blank": [("user", 0, " ​"), ("assistant", 1, None), ("system", 2, "x")],
    "no speaker": [(None, 0, "x"), ("system", 1, "y")],
    "late start": [("user", 0, "⠀"), ("assistant", 1, "b")],
    "open end": [("user", 0, "a"), ("assistant", 1, "b"), ("user", 2, "c")],
    "two users": [("user", 0, "a"), ("progress", 1, "z"), ("user", 2, "b"), ("assistant", 3, "c")],
    "by time": [("user", None, "a"), ("assistant", None, "b"), ("user", None, "c"), ("assistant", None, "d")],
    "by time open": [("assistant", None, "a"), ("user", None, "b")],
}
WANT = {
    "fine": None, "gap": "broken", "start": "broken", "twice": "broken", "twice at the start": "broken", "two in a fork": "broken", "below zero": "broken", "least of all": "broken", "most of all": "broken", "repeat": None, "some null": "broken", "blank": "empty", "no speaker": "empty",
    "late start": "broken", "open end": "no_reply", "two users": "no_reply", "by time": None, "by time open": "broken",
}


def frame(spark, cases, shuffle=True):
    out = [(t, o, x, i, 0, s) for s, parts in cases.items() for i, (t, o, x) in enumerate(parts)]
    if shuffle:
        random.Random(1).shuffle(out)
    data = [(n, a, s, t, at(i), o, x, "clash", 1) for n, (t, o, x, i, a, s) in enumerate(out)]
    return spark.createDataFrame(data, SCHEMA)


def test_reasons(spark):
    got = {r["session_id"]: r["reason"] for r in c.sessions(frame(spark, CASES)).collect()}
    assert got == WANT


def test_one_hot_session_over_many_tasks(spark):
    long = [("user" if i % 2 == 0 else "assistant", i, f"t{i}") for i in range(2000)]
    cases = {"long": long, "broken long": [*long[:1500], *long[1501:]], "hot time": [(t, None, x) for t, _, x in long], "unanswered": [*long[:900], ("user", 900, "a"), ("user", 901, "b"), *[(t, i + 2, x) for t, i, x in long[900:]]]}
    df = frame(spark, cases)
    found = {r["session_id"]: (r["reason"], r["n_runs"]) for r in c.sessions(df).collect()}
    assert {k: v[0] for k, v in found.items()} == {"long": None, "broken long": "broken", "hot time": None, "unanswered": "no_reply"}
    assert max(n for _, n in found.values()) > 1
    turns = c.rebuild(df).filter("session_id = 'hot time'").orderBy("turn").collect()
    assert [r["text"] for r in turns] == [x for _, _, x in long] and [r["turn"] for r in turns] == list(range(2000))


def test_same_id_of_two_agents_nulls_and_empty(spark):
    data = [(1, 0, "s", "user", at(0), 0, "a", "", 0), (2, 0, "s", "assistant", at(1), 1, "b", "", 0), (3, 1, "s", "user", at(0), 0, "a", "", 0), (4, None, None, "user", None, None, "x", "", 0)]
    df = spark.createDataFrame(data, SCHEMA)
    assert {(r["agent"], r["session_id"], r["reason"]) for r in c.sessions(df).collect()} == {(0, "s", None), (1, "s", "no_reply"), (None, None, "no_reply")}
    assert c.sessions(df.limit(0)).count() == 0 and c.rebuild(df.limit(0)).count() == 0


def test_pointer_jumping(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(300)]
    tree = [("r", None), ("x", "r"), ("y", "r"), ("z", "y")]
    odd = [("lost", "gone"), ("below", "lost"), ("p", "q"), ("q", "p"), ("tail", "p"), ("self", "self")]
    got = {r["node"]: (r["root"], r["depth"], r["state"]) for r in c.jump(spark.createDataFrame(chain + tree + odd, "node string, parent string")).collect()}
    assert all(got[f"n{i}"] == ("n0", i, "ok") for i in range(300))
    assert got["z"] == ("r", 2, "ok") and got["below"] == ("lost", 1, "orphan")
    assert {k for k, v in got.items() if v[2] == "cycle"} == {"p", "q", "tail", "self"}
    assert c.paths(spark.createDataFrame(tree + odd, "node string, parent string")).count() == 4


def test_every_place_of_a_gap_or_repeat(spark):
    """Sessions with a row lost or an ordinal repeated at any place, dealt over tasks, against a plain count."""
    cases = {}
    for i in range(40):
        rows = [("user" if k % 2 == 0 else "assistant", k, f"t{k}") for k in range(12)]
        cases[f"whole {i}"] = rows
        cases[f"lost {i}"] = [r for r in rows if r[1] != i % 12]
        cases[f"twice {i}"] = [*rows, ("assistant", i % 12, "again")]
    got = {r["session_id"]: r["reason"] for r in c.sessions(frame(spark, cases)).collect()}
    for name, rows in cases.items():
        ordinals = sorted(o for _, o, _ in rows)
        want = "broken" if ordinals != list(range(len(rows))) or min(rows, key=lambda r: r[1])[0] != "user" else None
        want = want or ("no_reply" if len(rows) % 2 else None)
        assert got[name] == want, name


def test_threads(spark):
    odd = [("r", None), ("x", "r"), ("x", "r"), ("lost", "gone"), ("below", "lost"), ("p", "q"), ("q", "p"), (None, "r"), ("self", "self")]
    got = {tuple(r) for r in c.threads(spark.createDataFrame(odd, "node string, parent string")).collect()}
    assert got == {("r", "ok", 2, 1), ("lost", "orphan", 2, 1), (None, "cycle", 3, None)}
    assert c.threads(spark.createDataFrame([], "node string, parent string")).count() == 0
