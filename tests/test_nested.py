import json

from scrollmill.operators import nested

SCHEMA = "record_id bigint, line string, node_path string, parent_len int"


def test_labels_links_and_odd_rows(spark):
    record = {"message": {"content": [{"type": "x"}, {"input": {"edits": [{"a": 1, "deep": [[{"b": 2}]]}]}}]}, "other": [{"no": 1}], "payload": [[{"z": 1}]], "Message": [{}]}
    rows = [
        (1, json.dumps(record)), (2, None), (3, ""), (4, "[{}]"), (5, '{"content":[{"a":1},]}'), (6, '{"content":"[{}]"}'),
        (7, '{"content":[{"k.x]":[{}]}]}'), (8, json.dumps(record)), (None, '{"content":[{}]}'), (9, '{"content":[{"\\ud800":[{}]}]}'),
    ]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = {}
    for r in nested.flatten(df).collect():
        got.setdefault(r["record_id"], set()).add((r["node_path"], r["parent_path"]))
    want = {
        ("message.content[0]", ""), ("message.content[1]", ""), ("message.content[1].input.edits[0]", "message.content[1]"),
        ("message.content[1].input.edits[0].deep[0][0]", "message.content[1].input.edits[0]"), ("payload[0][0]", ""),
    }
    assert got[1] == want and got[8] == want
    assert set(got) == {1, 7, 8, 9, None}
    assert got[7] == {("content[0]", ""), ("content[0].k.x][0]", "content[0]")}
    assert got[9] == {("content[0]", ""), ("content[0].�[0]", "content[0]")}


def test_tables_and_empty(spark):
    df = spark.createDataFrame([(1, '{"content":[{"type":"a","n":1},{"type":"b","sub":[{"q":true}]}]}')], "record_id bigint, line string")
    nodes = nested.flatten(df, with_body=True)
    flat = nested.flat_table(nodes, "content[]", ["type", "n"]).orderBy("node_path").collect()
    assert [(r["type"], r["n"]) for r in flat] == [("a", "1"), ("b", None)]
    per = {r["schema_path"]: (r["n_rows"], r["n_top"]) for r in nested.schema_tables(nodes).collect()}
    assert per == {"content[]": (2, 2), "content[].sub[]": (1, 0)}
    assert nested.flatten(df.limit(0)).count() == 0


def test_flat_rows_keep_all_fields(spark):
    record = {
        "type": "x", "tags": ["t"], "message": {"role": "user", "usage": {"in": 3}, "content": [{"input": {"command": "ls", "files": ["a", None, []], "env": {}, "none": []}, "k.v": 1}, "plain"]},
        "payload": {"type": "p"}, "content": "text",
    }
    df = spark.createDataFrame([(1, json.dumps(record)), (2, '{"a":1}'), (3, "no"), (4, None)], "record_id bigint, line string")
    got = {(r["record_id"], r["node_path"]): (r["parent_path"], r["kind"], r["element_no"], json.loads(r["body"])) for r in nested.flat_rows(df).collect()}
    top = {"type": "x", "tags": ["t"], "message.role": "user", "message.usage.in": 3, "payload.type": "p", "content": "text"}
    at = "message.content[0]"
    assert got == {
        (1, ""): (None, "record", None, top), (2, ""): (None, "record", None, {"a": 1}),
        (1, at): ("", "object", 0, {"input.command": "ls", "input.env": {}, "input.none": [], "k\\.v": 1}),
        (1, "message.content[1]"): ("", "value", 1, {"value": "plain"}),
        (1, at + ".input.files[0]"): (at, "value", 0, {"value": "a"}),
        (1, at + ".input.files[1]"): (at, "value", 1, {"value": None}),
        (1, at + ".input.files[2]"): (at, "value", 2, {"value": []}),
    }
    flat = nested.flat_table(nested.flatten(df, with_body=True), "message.content[]", ["input.command"]).collect()
    assert [r["input.command"] for r in flat] == ["ls"]


def test_rows_are_a_query():
    import __spark_entry__

    assert "p1_rows" in __spark_entry__.queries()
