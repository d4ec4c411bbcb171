import json
import os

import pytest

from scrollmill.operators import search
from scrollmill.plans import ingest
from scrollmill.plans.ingest import Report
from scrollmill.sources import preview
from scrollmill.sources.store import Conflict, Store


def said(role, text, **more):
    return json.dumps({"type": role, "timestamp": "2026-03-01T10:00:00Z", "message": {"content": [{"type": "text", "text": text}]}, **more}) + "\n"


@pytest.fixture
def place(spark, tmp_path):
    root = tmp_path / "in" / "deep"
    root.mkdir(parents=True)
    store = Store(spark, str(tmp_path / "store"))
    return root, store, {0: [str(tmp_path / "in")]}


def found(store):
    rows = ingest.live(store, store.read("chunks")).collect()
    return sorted((os.path.basename(r["source_path"]), r["native_id"], r["ordinal"], r["kind"], r["text"], r["is_open"]) for r in rows)


def ids(store, word):
    index = ingest.index(store)
    return sorted(r["text"] for r in index.with_chunks(search.search(index, word).results).collect())


def test_scan_append_rescan_and_rebuild(spark, place):
    root, store, roots = place
    a, b = root / "a.jsonl", root / "b.jsonl"
    first = said("user", "first question", sessionId="s1", cwd="/w", gitBranch="main") + said("assistant", "an answer") + "{broken\n"
    more = said("assistant", "goes on")
    a.write_text(first + more[:15])
    b.write_text(said("user", "question in b"))
    got = ingest.ingest(store, roots)
    assert (got.files, got.skipped, got.records, got.malformed, got.failed, got.chunks) == (2, 0, 3, 1, 0, 1)
    assert got.bytes == len(first) + b.stat().st_size
    assert got.summary() == f"indexed 2 files (0 failed), 3 records ({got.bytes} bytes, 1 chunks; 1 malformed)"
    assert found(store) == [("a.jsonl", "s1", 0, 0, "first question", False), ("a.jsonl", "s1", 1, 1, "an answer", True), ("b.jsonl", "unidentified-source-2", 0, 0, "question in b", True)]
    assert ids(store, "answer") == ["an answer"]
    sessions = {r["native_id"]: r for r in ingest.sessions(store).collect()}
    assert (sessions["s1"]["cwd"], sessions["s1"]["branch"], sessions["s1"]["git_origin"]) == ("/w", "main", 1) and sessions["s1"]["started_at"] is not None

    # nothing changed: nothing is read
    got = ingest.ingest(store, roots)
    assert (got.files, got.skipped, got.records, got.bytes) == (2, 1, 0, 0)  # a line is still unfinished in the other

    # the open turn goes on, and only the new bytes are read
    offset = {r["path"]: r["committed_offset"] for r in ingest.manifest(store).collect()}[str(a)]
    a.write_text(first + more + said("user", "thanks", sessionId="s2"))
    got = ingest.ingest(store, roots)
    assert got.bytes == a.stat().st_size - offset and got.records == 2
    assert [r[1:] for r in found(store) if r[0] == "a.jsonl"] == [("s1", 0, 0, "first question", False), ("s1", 1, 1, "an answer\ngoes on", False), ("s2", 2, 0, "thanks", True)]
    assert ids(store, "answer") == ["an answer\ngoes on"]
    assert {"s1", "s2"} <= {r["native_id"] for r in ingest.sessions(store).collect()}

    # rewritten in place with the same size, times restored: read anew under the next generation
    stat = a.stat()
    with a.open("r+") as f:
        f.write(first.replace("question", "QUESTION"))
    os.utime(a, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert ingest.ingest(store, roots).records == 4
    assert {r["generation"] for r in ingest.manifest(store).collect() if r["path"] == str(a)} == {1}
    assert [r[4] for r in found(store) if r[0] == "a.jsonl"] == ["first QUESTION", "an answer\ngoes on", "thanks"]
    assert len(ids(store, "answer")) == 1

    # replaced by another file of the same name; renamed: old rows stay, new ones are added
    other = root / "c.tmp"
    other.write_text(first)
    os.replace(other, a)
    os.rename(b, root / "d.jsonl")
    got = ingest.ingest(store, roots)
    names = [r[0] for r in found(store)]
    assert names.count("a.jsonl") == 2 and names.count("b.jsonl") == 1 and names.count("d.jsonl") == 1
    before = found(store)
    ingest.tidy(store)
    assert found(store) == before and len(ids(store, "question")) == 3
    assert len(os.listdir(os.path.join(store.root, "chunks"))) == 1
    modes = {oct(os.stat(os.path.join(f, n)).st_mode)[-3:] for f, _, ns in os.walk(os.path.join(store.root, "manifest")) for n in ns}
    assert modes == {"600"}


def test_any_number_of_scans_gives_the_same_chunks(spark, place, tmp_path):
    root, store, roots = place
    lines = []
    for i in range(12):
        lines.append(said("assistant" if i % 4 else "user", f"turn {i} " + "x" * (9000 if i in (5, 6) else 3), **({"sessionId": "s1"} if i == 2 else {})))
    for upto in (1, 3, 6, 7, 12):
        (root / "a.jsonl").write_text("".join(lines[:upto]))
        ingest.ingest(store, roots)
    whole = Store(spark, str(tmp_path / "whole"))
    ingest.ingest(whole, roots)
    plain = lambda s: [r for r in found(s)]
    mine, want = plain(store), plain(whole)
    assert [(r[2], r[3], r[4], r[5]) for r in mine] == [(r[2], r[3], r[4], r[5]) for r in want] and len(want) > 5
    assert [r[1] for r in mine] == [r[1] for r in want]


def test_faults_and_conflicts(spark, place, monkeypatch):
    root, store, roots = place
    (root / "a.jsonl").write_text(said("user", "fine"))
    (root / "bad.jsonl").write_text(said("user", "late"))
    listed = ingest.jsonl.listing

    def late(spark, paths):
        out = ingest.cut(listed(spark, paths))
        with (root / "bad.jsonl").open("a") as f:
            f.write(said("user", "more"))
        return out

    monkeypatch.setattr(ingest.jsonl, "listing", late)
    got = ingest.ingest(store, roots)
    assert (got.deferred, got.failed, got.files) == (1, 0, 2) and [r[0] for r in found(store)] == ["a.jsonl"]
    monkeypatch.setattr(ingest.jsonl, "listing", listed)
    assert ingest.ingest(store, roots).records == 2
    assert len(found(store)) == 3
    with pytest.raises(Conflict):
        store.commit({}, store.version - 1)
    # one commit came first, between its start and its end
    monkeypatch.setattr(store, "pointer", lambda p=store.pointer(): p | {"version": p["version"] - 1})
    with pytest.raises(Conflict):
        store.commit({}, store.version)
    monkeypatch.undo()
    assert ingest.ingest(store, roots, stop=lambda: True).stopped
    assert ingest.ingest(Store(spark, store.root + "2"), {0: [], 1: ["/missing"]}) == Report()
    assert Report(failed=1, files=3, skipped=2, deferred=1).summary().startswith("indexed 3 files (1 failed, 1 deferred, 2 unchanged), 0 records")
    assert Report(deferred=2, errors=["a\x07b"]).notes() == ["indexing error: a�b", "2 file(s) changed while being read and were left for the next run"]


def test_git_of_each_folder_once(spark, place):
    root, store, roots = place
    (root / "a.jsonl").write_text(said("user", "one", sessionId="s1", cwd="/w", gitBranch="old"))
    (root / "b.jsonl").write_text(said("user", "two", sessionId="s2", cwd="/none", gitBranch="kept"))
    ask = lambda cwd: dict(root="/r", worktree=None, branch="now", commit="c" * 40, url=None) if cwd == "/w" else dict.fromkeys(("root", "worktree", "branch", "commit", "url"))
    ingest.ingest(store, roots, git=ask)
    got = {r["native_id"]: (r["branch"], r["repository_root"], r["git_origin"]) for r in ingest.sessions(store).collect()}
    assert got == {"s1": ("now", "/r", 0), "s2": ("kept", None, 1)}


def test_preview(spark, place):
    root, store, roots = place
    path = root / "a.jsonl"
    path.write_text(said("user", "first\x07 one", sessionId="s1") + said("assistant", "reply here\n\nUser: quoted") + said("user", "last"))
    ingest.ingest(store, roots)
    known = ingest.manifest(store)
    row = known.collect()[0]
    chunk = [r for r in store.read("chunks").collect() if r["kind"] == 1][0]
    look = lambda **k: preview.preview(known, str(path), row["file_id"], k.pop("generation", 0), chunk["source_start"], chunk["source_end"], **k)
    got = look()
    assert got.text == "User: first� one\n\nAssistant: reply here\n\nUser: quoted\n\nUser: last" and not got.cut_before and not got.cut_after
    got = look(context=0)
    assert got.text.startswith("Assistant: reply") and got.cut_before and got.cut_after
    with pytest.raises(preview.Stale):
        look(generation=1)
    assert preview.session_for_source(ingest.sessions(store), str(path), row["file_id"], 0).count() == 1
    with path.open("a") as f:
        f.write(said("user", "more"))
    with pytest.raises(preview.Stale):
        look()
    texts = spark.createDataFrame([("User: a\nb\n\n\nAssistant: c\n",), ("loose\n\nUser: d",), ("",), (None,), ("x User: y",)], "t string")
    blocks = [None if r[0] is None else [tuple(b) for b in r[0]] for r in texts.select(preview.messages(texts["t"])).collect()]
    assert blocks == [[("User", "a\nb"), ("Assistant", "c")], [(None, "loose"), ("User", "d")], [], None, [(None, "x User: y")]]
