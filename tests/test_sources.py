import json
import os

import pytest

from scrollmill.sources import jsonl, preview
from scrollmill.sources.store import Conflict, Store


def lines(*texts):
    return "".join(t + "\n" for t in texts)


def test_discover(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name in ("x.jsonl", "a/y.jsonl", "a/b/z.jsonl", "a/no.json"):
        (tmp_path / name).write_text("{}\n")
    os.symlink(tmp_path, tmp_path / "a" / "loop")
    os.symlink(tmp_path / "x.jsonl", tmp_path / "link.jsonl")
    root = str(tmp_path)
    found = jsonl.discover([root, root, root + "/missing", root + "/x.jsonl"])
    assert [os.path.relpath(p, root) for p in found] == ["a/b/z.jsonl", "a/y.jsonl", "x.jsonl"]
    assert jsonl.discover([root], lambda: True) is None
    assert jsonl.default_roots(0, {"HOME": "/h"}) == ["/h/.claude/projects"] and len(jsonl.default_roots(1, {"CODEX_HOME": "/c"})) == 2


def test_records_by_any_ranges(tmp_path):
    path = tmp_path / "f.jsonl"
    texts = ["a", "", "é" * 9, "x" * 50, "{}", "tail"]
    path.write_text(lines(*texts) + "unfinished")
    size = path.stat().st_size
    whole = list(jsonl.records(str(path), 0, size, size))
    assert [d.decode() for _, _, d in whole] == texts
    for step in (1, 3, 7, 20, 1000):
        parts = [r for a in range(0, size, step) for r in jsonl.records(str(path), a, min(a + step, size), size)]
        assert parts == whole
    stop = len(lines("a", "").encode()) + 3
    assert len(list(jsonl.records(str(path), 0, stop, stop))) == 2


def test_read_and_faults(spark, tmp_path, monkeypatch):
    good, bad = tmp_path / "g.jsonl", tmp_path / "b.jsonl"
    good.write_bytes(b'{"a":1}\n\xff\xfe\nlast\n')
    rows = jsonl.read(spark, [(str(good), 0, good.stat().st_size), (str(bad), 0, 10)]).orderBy("source_path", "byte_start").collect()
    assert [(r["line"], r["n_malformed"]) for r in rows if r["error"] is None] == [('{"a":1}', 0), (None, 1), ("last", 0)]
    assert len([r for r in rows if r["error"]]) == 1
    tail = jsonl.read(spark, [(str(good), 8, good.stat().st_size)]).collect()
    assert len(tail) == 2 and jsonl.read(spark, []).count() == 0


def test_classify(spark, tmp_path):
    cols = "path string, dev bigint, ino bigint, ctime bigint, ctime_nsec bigint, size bigint, modified bigint"
    listing = spark.createDataFrame([("new", 1, 1, 1, 1, 9, 1), ("same", 1, 2, 1, 1, 9, 1), ("more", 1, 3, 2, 1, 12, 2), ("other", 1, 9, 1, 1, 9, 1), ("null", 1, 5, 1, 1, 9, 1)], cols)
    old = [("same", 1, 2, 1, 1, 9, 1, 9, 2, 0), ("more", 1, 3, 1, 1, 9, 1, 9, 2, 0), ("other", 1, 4, 1, 1, 9, 1, 9, 2, 3), ("null", None, 5, 1, 1, 9, 1, 9, 2, 0), ("gone", 1, 7, 1, 1, 9, 1, 9, 2, 0)]
    manifest = spark.createDataFrame(old, cols + ", committed_offset bigint, checkpoint_format int, generation bigint")
    assert {r["path"]: r["action"] for r in jsonl.classify(listing, manifest).collect()} == {"new": "new", "same": "settled", "more": "append", "other": "check", "null": "check"}


def test_samples_and_preview(tmp_path):
    path = tmp_path / "f.jsonl"
    path.write_text(lines(*[json.dumps({"n": i}) for i in range(100)]))
    size = path.stat().st_size
    before = jsonl.sample(str(path), size)
    with path.open("a") as f:
        f.write("more\n")
    assert jsonl.sample(str(path), size) == before
    parts, cut_before, cut_after = preview.window(str(path), 200, 210, size, context=30)
    assert cut_before and cut_after and any(b'{"n": 2' in d for _, _, d in parts)
    assert preview.window(str(path), 0, size, size)[1:] == (False, False)


def test_a_record_of_any_length_is_read_in_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(jsonl, "MOST_RECORD", 10)
    monkeypatch.setattr(jsonl, "BLOCK", 4)
    path = tmp_path / "f.jsonl"
    path.write_bytes(b"0123456789\n" + b"x" * 99 + b"\n" + b"01234567890\nend\n")
    size = path.stat().st_size
    assert [(b - a, d) for a, b, d in jsonl.records(str(path), 0, size, size)] == [(10, b"0123456789"), (99, None), (11, None), (3, b"end")]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.read("t") is None and store.version == 0
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    store.commit({"t": one}, 0)
    two = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    store.commit({"t": store.upsert("t", two, ["k"])}, 1)
    assert sorted(tuple(r) for r in store.read("t").collect()) == [(1, "a"), (2, None), (3, "c")]
    with pytest.raises(Conflict):
        store.commit({"t": one}, 1)
    assert store.status() == {"t": 3} and store.reclaim() == 1 and store.compact("t", 1) == 3
    assert oct(os.stat(store.root).st_mode)[-3:] == "700"


def test_streaming_tail(spark, tmp_path):
    from scrollmill.streaming.tail import register

    root = tmp_path / "in"
    root.mkdir()
    (root / "a.jsonl").write_text(lines("1", "2") + "3")
    register(spark)

    def run():
        q = (
            spark.readStream.format("jsonl_tail").option("roots", str(root)).load().writeStream.format("parquet")
            .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        q.awaitTermination()
        return sorted((r["line"], r["byte_start"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [("1", 0), ("2", 2)]
    with (root / "a.jsonl").open("a") as f:
        f.write("3\n4\n")
    (root / "b.jsonl").write_text(lines("new"))
    assert run() == [("1", 0), ("2", 2), ("33", 4), ("4", 7), ("new", 0)]


def test_verify_by_hashes(spark, tmp_path):
    names = ("grown", "same", "rewritten", "rewritten_longer", "settled", "shrunk", "new", "gone")
    paths = {n: str(tmp_path / f"{n}.jsonl") for n in names}
    for n in names[:6]:
        with open(paths[n], "w") as f:
            f.write(lines("first", "second"))
    size = os.path.getsize(paths["same"])
    committed = {n: (jsonl.fingerprint(paths[n]), jsonl.sample(paths[n], size)) for n in names[:6]}
    for n, mode, text in (
        ("grown", "a", lines("third")), ("rewritten", "r+", lines("FIRST", "second")), ("rewritten_longer", "r+", lines("FIRST", "second", "third")),
        ("shrunk", "w", lines("first")), ("new", "w", lines("a")),
    ):
        with open(paths[n], mode) as f:
            f.write(text)
    stat = "dev bigint, ino bigint, ctime bigint, ctime_nsec bigint, size bigint, modified bigint"
    old = [(paths[n], *f.values(), size if n != "same" else 6, 2, 4, size, h) for n, (f, h) in committed.items()]
    manifest = spark.createDataFrame(old, f"path string, {stat}, committed_offset bigint, checkpoint_format int, generation bigint, sampled_size bigint, hashes string")
    gone = dict.fromkeys(committed["same"][0], 1)
    listing = spark.createDataFrame([(paths[n], *(jsonl.fingerprint(paths[n]) or gone).values()) for n in names], f"path string, {stat}")
    got = {os.path.basename(r["path"])[:-6]: (r["action"], r["start"], r["generation"]) for r in jsonl.verify(listing, manifest).collect()}
    assert got == {
        "grown": ("append", size, 4), "same": ("append", 6, 4), "rewritten": ("rebuild", 0, 5), "rewritten_longer": ("rebuild", 0, 5),
        "settled": ("settled", size, 4), "shrunk": ("rebuild", 0, 5), "new": ("new", 0, 0), "gone": ("failed", None, None),
    }
    assert jsonl.verify(listing.limit(0), manifest).count() == 0
