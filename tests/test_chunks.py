import random

from pyspark.sql import functions as F

from scrollmill.operators import chunks

SCHEMA = (
    "event_id bigint, agent int, native_id string, kind int, timestamp timestamp, source_path string, source_file_id bigint,"
    " source_generation bigint, source_start bigint, source_end bigint, text string, head string"
)


def brute(events, most):
    """Row-by-row folding of one sorted file at a time."""
    out, file, open_, ordinal = [], None, None, {}

    def close():
        nonlocal open_
        if open_ is None:
            return
        whole = "\n".join(open_[5])
        parts = list(chunks.pieces(whole, most)) if len(whole.encode()) >= most else [whole]
        for p in parts:
            key = open_[0]
            out.append((*key, ordinal.get(key, 0), open_[1], open_[2], open_[3], open_[4], p))
            ordinal[key] = ordinal.get(key, 0) + 1
        open_ = None

    seen = set()
    for e in sorted(events, key=lambda e: (e[1], e[6], e[7], e[8], e[9], e[3] if e[3] is not None else -1)):
        text = " ".join((e[10] or "").split())
        mark = (e[1], e[6], e[7], e[2], e[8], e[3], text)
        if e[3] not in (0, 1) or not text or mark in seen:
            continue
        seen.add(mark)
        key = (e[1], e[6], e[7])
        if open_ is not None and (open_[0] != key or open_[1] != e[2] or open_[2] != e[3] or e[3] == 0):
            close()
        if open_ is None:
            open_ = [key, e[2], e[3], e[8], e[9], []]
        open_[3], open_[4] = min(open_[3], e[8]), max(open_[4], e[9])
        open_[5].append(text)
        if len("\n".join(open_[5]).encode()) >= most:
            close()
    close()
    return sorted(map(repr, out))


def _events(seed, n):
    rng = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        file = 1 if rng.random() < 0.6 else rng.randint(2, 4)
        at += 10
        text = rng.choice(["alpha beta", " long " * rng.randint(1, 9), "é" * rng.randint(1, 30), " \t", None, "x"])
        rows.append((i, 0, rng.choice(["s1", "s1", "s1", "s2"]), rng.choice([0, 1, 1, 1, 1, None, 2]), None, "/p", file, 0, at, at + 9, text, "clash"))
    return rows + rows[:3]


def test_fold_equals_brute_force(spark):
    for seed in (1, 2):
        rows = _events(seed, 300)
        got = chunks.fold(spark.createDataFrame(rows, SCHEMA), most=48).collect()
        mine = sorted(repr((r["agent"], r["source_file_id"], r["source_generation"], r["ordinal"], r["native_id"], r["kind"], r["source_start"], r["source_end"], r["text"])) for r in got)
        assert mine == brute(rows, 48)
        assert all(len(r["text"].encode()) <= 48 for r in got)
        last = {}
        for r in got:
            last[r["source_file_id"]] = max(last.get(r["source_file_id"], 0), r["ordinal"])
        assert all(r["ordinal"] == last[r["source_file_id"]] for r in got if r["is_open"])


def test_fold_one_long_run_and_empty(spark):
    rows = [(i, 0, "s", 1, None, "/p", 1, 0, i, i, f"w{i:03d}", "c") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r["text"].count("w") for r in chunks.fold(df).collect()] == [200]
    assert chunks.fold(df.limit(0)).count() == 0
    assert list(chunks.pieces("aéé", 4)) == ["aé", "é"]


def test_restart_equivalence(spark):
    """Folding may stop at any event: saved and resumed, the chunks are those of one call."""
    rows = [r for r in _events(5, 60) if r[0] is not None][:60]
    rows.sort(key=lambda r: r[8])
    whole = spark.createDataFrame(rows, SCHEMA)
    key = lambda r: (r["source_file_id"], r["ordinal"])
    shown = lambda found: sorted((*key(r), r["native_id"], r["kind"], r["source_start"], r["source_end"], r["text"], r["is_open"]) for r in found)
    want = shown(chunks.fold(whole, most=24).collect())
    for at in (0, 7, 23, 41, 59, 60):
        first = chunks.fold(spark.createDataFrame(rows[:at], SCHEMA), most=24)
        state = chunks.saved(first).withColumn("source_path", F.lit("/p"))
        opened = chunks.restored(state, 24)
        assert opened.filter("not is_valid").count() == 0
        second = chunks.fold(spark.createDataFrame(rows[at:], SCHEMA), most=24, opened=opened)
        assert shown([*first.filter("not is_open").collect(), *second.collect()]) == want
        again = chunks.restored(chunks.saved(second, opened).withColumn("source_path", F.lit("/p")), 24)
        assert {r["source_file_id"] for r in again.collect()} == {w[0] for w in want}


def test_states_that_are_not_valid(spark):
    good = '{"next_ordinal":2,"pending":{"session_id":{"agent":"Claude","native_id":"s"},"ordinal":2,"timestamp_millis":5,"source_path":"/p","file_id":1,"generation":0,"start":0,"end":9,"text":"abc","kind":"User"}}'
    states = [good, None, "", '{"next_ordinal":3,"pending":null}', good.replace('"ordinal":2,"t', '"ordinal":1,"t'), good.replace("Claude", "Other"), good.replace('"end":9', '"end":-1'),
              good.replace("5,", "-5,"), good.replace("abc", "x" * 99), "{", '{"next_ordinal":2000000000,"pending":null}', good.replace("User", "Tool")]
    df = spark.createDataFrame([(0, i, 0, "/p", s) for i, s in enumerate(states)], "agent int, source_file_id bigint, source_generation bigint, source_path string, open_turn_state string")
    got = sorted(chunks.restored(df, 32).collect(), key=lambda r: r["source_file_id"])
    assert [r["is_valid"] for r in got] == [True] * 4 + [False] * 8
    assert (got[0]["text"], got[0]["kind"], got[0]["next_ordinal"]) == ("abc", 0, 2) and got[3]["next_ordinal"] == 3 and got[1]["text"] is None
