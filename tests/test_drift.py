import datetime as dt
import json

from pyspark.sql import functions as F

from scrollmill.operators import drift

CATALOG = [(0, "sessionId", "string", True), (0, "isMeta", "boolean", True), (0, "cwd", "string", True), (0, "content", "string|array", False), (1, "payload", "object", True)]


def _frames(spark, records):
    raw = [(i, f, a, line if isinstance(line, str) or line is None else json.dumps(line), "x") for i, (f, a, line) in enumerate(records)]
    catalog = spark.createDataFrame(CATALOG, "agent int, field_name string, json_types string, is_required boolean")
    return spark.createDataFrame(raw, "record_id bigint, file_id bigint, agent int, line string, field string"), catalog


def test_changes(spark):
    records = [
        (1, 0, {"sessionId": "s", "isMeta": False, "cwd": "/a"}), (1, 0, {"session_id": "s", "isMeta": None, "cwd": 7}),
        (2, 0, {"SessionID": ["s"], "workdir": "/a", "extra": 1}), (2, 0, "{"), (3, 0, "{"), (3, 0, None), (4, 0, {}),
        (5, 1, {"payload": {}, "content": 1}), (6, None, {"a": 1}), (7, 9, {"sessionId": 1}), (1, 0, {"sessionId": "s"}),
    ]
    raw, catalog = _frames(spark, records)
    got = {(r["file_id"], r["change"], r["field_name"]) for r in drift.changes(raw, catalog).collect()}
    assert got == {
        (1, "renamed", "sessionId"), (1, "retyped", "cwd"),
        (2, "renamed", "sessionId"), (2, "retyped", "sessionId"), (2, "renamed", "cwd"), (2, "added", "extra"), (2, "removed", "isMeta"),
        (4, "removed", "sessionId"), (4, "removed", "isMeta"), (4, "removed", "cwd"), (5, "added", "content"), (6, "added", "a"), (7, "added", "sessionId"),
    }


def test_stand_in_by_values(spark):
    plain = [(1, 0, {"sessionId": f"{i:04d}-ab", "isMeta": False, "cwd": f"/srv/w{i}/x"}) for i in range(200)]
    odd = [(2, 0, {"sessionId": f"{i:04d}-ab", "isMeta": False, "place": f"/srv/w{i}/x", "mood": "fine"}) for i in range(30)]
    raw, catalog = _frames(spark, plain + odd)
    got = {(r["change"], r["field_name"]) for r in drift.changes(raw, catalog).collect()}
    assert got == {("renamed", "cwd"), ("added", "mood")}


def test_unify_union_and_empty(spark):
    raw, catalog = _frames(spark, [(1, 0, {"session-id": "s", "isMeta": True, "z": [1]}), (1, 0, {"sessionId": "t", "session_id": "u"}), (2, 1, {"payload": {"k": 1}}), (3, 0, "no")])
    rows = {r["record_id"]: r for r in drift.unify(raw, catalog).collect()}
    assert rows[0]["sessionId"] == "s" and rows[0]["isMeta"] is True and json.loads(rows[0]["extra"]) == {"z": [1]}
    assert rows[1]["sessionId"] == "t" and json.loads(rows[2]["payload"]) == {"k": 1} and 3 not in rows
    schema = {(r["agent"], r["field_name"]): r["json_type"] for r in drift.union_schema(raw, catalog).collect()}
    assert schema[0, "sessionId"] == "string" and schema[0, "z"] == "array" and schema[1, "payload"] == "object"
    assert drift.changes(raw.limit(0), catalog).count() == 0
    assert {r["change"] for r in drift.changes(raw, catalog.limit(0)).collect()} == {"added"}


def test_cast_to_the_union(spark):
    values = [("sessionId", ["a", "b"]), ("isMeta", [True, None]), ("cwd", ["/a", 3]), ("content", [1, 2])]
    records = [(1, 0, {n: v[i] for n, v in values}) for i in range(2)]
    raw, catalog = _frames(spark, records)
    kinds = dict(drift.unify(raw, catalog).dtypes)
    assert (kinds["sessionId"], kinds["isMeta"], kinds["cwd"], kinds["content"], kinds["payload"]) == ("string", "boolean", "string", "bigint", "string")
    assert [r["cwd"] for r in drift.unify(raw, catalog).orderBy("record_id").collect()] == ['"/a"', "3"]
    for more, kind in ((2.5, "double"), (1 << 70, "double"), ("x", "string"), (None, "bigint")):
        raw, catalog = _frames(spark, [*records, (2, 0, {"content": more})])
        assert dict(drift.unify(raw, catalog).dtypes)["content"] == kind
        drift.unify(raw, catalog).collect()


def test_log_in_order(spark):
    fields = [{"cwd": "/a"}, {"cwd": 1, "new": 1}, {"cwd": "/b", "new": 2.5}, {"cwd": [1]}, {"cwd": None}]
    raw, catalog = _frames(spark, [(9 - i, 0, {"sessionId": "s", "isMeta": False, **f}) for i, f in enumerate(fields)])
    raw = raw.withColumn("read_at", F.make_timestamp(*map(F.lit, (2026, 1, 1, 0, 0)), (10 - F.col("file_id")).cast("decimal(8,6)")))
    rows = drift.log(raw, catalog).orderBy("at", "file_id", "field_name", "change").collect()
    lattice = [(r["file_id"], r["change"], r["field_name"], r["type_before"], r["type_after"]) for r in rows if r["type_after"]]
    assert lattice == [
        (9, "appeared", "cwd", None, "string"), (9, "appeared", "isMeta", None, "boolean"), (9, "appeared", "sessionId", None, "string"),
        (8, "promoted", "cwd", "string", "json"), (8, "appeared", "new", None, "integer"), (7, "promoted", "new", "integer", "number"),
    ]
    assert {(r["file_id"], r["change"]) for r in rows if not r["type_after"]} == {(8, "retyped"), (8, "added"), (7, "added"), (6, "retyped")}
    assert rows[0]["at"] == dt.datetime(2026, 1, 1, 0, 0, 1) and drift.log(raw.limit(0), catalog).count() == 0


def test_looks_are_of_whole_values():
    a, b = "x-1/" * 200 + "end", "x-1/" * 200 + "end!"
    assert drift._look(a) != drift._look(b) and len(drift._look(a)) < 40 and drift._look(a) == drift._look(a.replace("1", "27"))


def test_a_few_records_prove_no_stand_in(spark):
    plain = [(1, 0, {"sessionId": f"{i:04d}-ab", "isMeta": False, "cwd": f"/srv/w{i}/x"}) for i in range(200)]
    for n, change in ((3, "added"), (12, "renamed")):
        odd = [(2, 0, {"sessionId": f"{i:04d}-ab", "isMeta": False, "place": f"/srv/w{i}/x"}) for i in range(n)]
        raw, catalog = _frames(spark, plain + odd)
        assert change in {r["change"] for r in drift.changes(raw, catalog).collect()}
