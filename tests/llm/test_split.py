import hashlib
import json

from hypothesis import given, settings, strategies as st

from scrollmill.llm import split


def check(text, most, overlap):
    parts = split.pieces(text, most, overlap)
    assert "".join(text[core:end] for _, core, end, _ in parts) == text
    for k, (start, core, end, _) in enumerate(parts):
        assert len(text[start:end].encode("utf-8", "surrogatepass")) <= most and (core < end or not text)
        if k:
            want = min(overlap, most // 2)
            assert want - 3 <= len(text[start:core].encode("utf-8", "surrogatepass")) <= want or start == 0
    return parts


@given(st.text(alphabet="ab .\n,é東😀", max_size=300), st.integers(16, 60), st.integers(0, 20))
@settings(max_examples=150, deadline=None)
def test_round_trip_limit_overlap(text, most, overlap):
    check(text, most, overlap)


def test_natural_boundaries():
    text = "First line here.\n\nSecond part is here. And more of it follows.\n\nThird one."
    parts = check(text, 50, 4)
    assert [b for *_, b in parts] == ["paragraph", "paragraph", "end"]
    assert [b for *_, b in check("x" * 100, 40, 8)][:-1] == ["character"] * 3
    assert len(check("word " * 60_000, 16384, 512)) < 25


def test_operator(spark):
    limits = spark.createDataFrame([("search_chunks", "text", 20, 4), ("indexed_files", "open_turn_state.pending.text", 10, 2), ("raw_records", "line", 12, 0)], "item_table string, field_name string, max_bytes bigint, overlap_bytes bigint")
    chunks = spark.createDataFrame([(1, "short", 9), (2, "one two three four five six", 9), (2, "one two three four five six", 9), (3, None, 9), (4, "", 9)], "chunk_id bigint, text string, max_bytes int")
    files = spark.createDataFrame([(7, json.dumps({"pending": {"text": "ä" * 9}})), (8, json.dumps({"pending": None})), (9, ""), (10, None)], "file_id bigint, open_turn_state string")
    records = spark.createDataFrame([(5, "123456789012"), (6, "1234567890123")], "record_id bigint, line string")
    got = split.split_oversized(split.items_of(chunks, files, records, limits)).collect()
    assert {(r["item_table"], r["item_id"]) for r in got} == {("search_chunks", 2), ("indexed_files", 7), ("raw_records", 6)}
    assert all(r["n_pieces"] > 1 for r in got) and max(r["n_bytes"] for r in got) <= 20
    empty = split.items_of(chunks.limit(0), files.limit(0), records.limit(0), limits)
    assert split.split_oversized(empty).count() == 0


def test_small_limits_and_rejoining(spark):
    for most in range(1, 12):
        for overlap in (0, 1, most, 99):
            text = "aé日𝄞 b. cd\n\nxyz" * 4
            parts = split.pieces(text, most, overlap)
            assert "".join(text[core:end] for _, core, end, _ in parts) == text
            assert all(len(text[s:e].encode()) <= most or e - c == 1 for s, c, e, _ in parts)
            if most >= 8:
                assert all(len(text[s:e].encode()) <= most for s, c, e, _ in parts)
    items = spark.createDataFrame([("t", 1, "one two three. " * 20, 64, 16), ("t", 2, "日本" * 40, 64, 60), ("t", 3, None, 64, 16), ("t", 4, "", 64, 16)], "item_table string, item_id bigint, text string, max_bytes int, overlap_bytes int")
    pieces = split.split_oversized(items)
    got = {r["item_id"]: r for r in split.rejoined(pieces).collect()}
    assert set(got) == {1, 2} and got[1]["n_most"] <= 64 and got[1]["n_overlap"] >= 13
    assert got[2]["digest"] == hashlib.md5(("日本" * 40).encode()).hexdigest()
    assert {r["item_id"]: r["is_overlap_lowered"] for r in pieces.collect()} == {1: False, 2: True}
