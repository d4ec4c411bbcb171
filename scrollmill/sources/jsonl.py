"""Append-only JSONL files: discovery, change detection and reading by byte offset."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Records above this are skipped as malformed; bytes hashed at either end of a file; checkpoint format.
MOST_RECORD, SAMPLE, FORMAT = 4 << 20, 4096, 2
#: Bytes that one task reads of a file at most: a large file is cut into ranges at line ends.
RANGE = 64 << 20
#: Bytes read at once of one record; records sent on at once.
BLOCK, SENT = 1 << 20, 512


def default_roots(agent: int, env: dict[str, str] | None = None) -> list[str]:
    """Where an agent keeps its transcripts unless told otherwise."""
    env = dict(os.environ) if env is None else env
    home = env.get("HOME", "")
    if agent == 0:
        return [os.path.join(env.get("CLAUDE_CONFIG_DIR") or os.path.join(home, ".claude"), "projects")]
    base = env.get("CODEX_HOME") or os.path.join(home, ".codex")
    return [os.path.join(base, x) for x in ("sessions", "archived_sessions")]


def discover(roots: list[str], stop: Callable[[], bool] = lambda: False) -> list[str] | None:
    """Regular `.jsonl` files under `roots`, sorted, each once; None if stopped on the way.

    Links are not followed, missing or unreadable folders passed over; a root may be a file.
    """
    found = set()
    for root in roots:
        if os.path.islink(root):
            continue
        if os.path.isfile(root) and root.endswith(".jsonl"):
            found.add(root)
        for folder, _, names in os.walk(root, followlinks=False):
            if stop():
                return None
            for name in names:
                path = os.path.join(folder, name)
                if os.path.splitext(name)[1] == ".jsonl" and os.path.isfile(path) and not os.path.islink(path):
                    found.add(path)
    return sorted(found)


def fingerprint(path: str) -> dict[str, int] | None:
    """Size, times and identity of a file, null if it is gone."""
    try:
        s = os.stat(path, follow_symlinks=False)
    except OSError:
        return None
    return {"dev": s.st_dev, "ino": s.st_ino, "ctime": s.st_ctime_ns // 10**9, "ctime_nsec": s.st_ctime_ns % 10**9, "size": s.st_size, "modified": s.st_mtime_ns}


STAT = "dev bigint, ino bigint, ctime bigint, ctime_nsec bigint, size bigint, modified bigint"


def listing(spark: SparkSession, paths: list[tuple[int, str]]) -> DataFrame:
    """`agent, path` and the fingerprint of each file, asked in tasks; null where a file is gone."""
    if not paths:
        return spark.createDataFrame([], f"agent int, path string, {STAT}")
    named = spark.createDataFrame(paths, "agent int, path string").repartition(min(len(paths), spark.sparkContext.defaultParallelism), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [fingerprint(p) or dict.fromkeys(_STAT_NAMES) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([s[n] for s in stats], pa.int64()) for n in _STAT_NAMES)], ["agent", "path", *_STAT_NAMES])

    return named.mapInArrow(run, f"agent int, path string, {STAT}")


_STAT_NAMES = [x.split()[0] for x in STAT.split(", ")]


def sample(path: str, size: int) -> str:
    """SHA-256 of the first and last bytes of the file's first `size` bytes."""
    with open(path, "rb") as f:
        head = f.read(min(SAMPLE, size))
        f.seek(max(0, size - SAMPLE))
        tail = f.read(min(SAMPLE, size))
    return hashlib.sha256(head).hexdigest() + hashlib.sha256(tail).hexdigest()


def classify(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """`listing` (path and fingerprint) with `action` by the manifest: new, settled, append or check.

    Settled means that format, identity, times and size are as committed and all bytes were read;
    such a file is not opened. The other actions are by the fingerprint alone: only `verify`, which
    opens the files, decides whether an `append` or `check` file is read on or read anew.
    Files of the manifest that are gone keep their rows: absence removes nothing.
    """
    names = ["dev", "ino", "ctime", "ctime_nsec", "size", "modified"]
    old = manifest.select("path", *(F.col(c).alias(f"m_{c}") for c in [*names, "committed_offset", "checkpoint_format", "generation"]))
    same = F.lit(True)
    for c in names:
        same = same & (F.col(c) == F.col(f"m_{c}"))
    settled = same & (F.col("m_committed_offset") == F.col("size")) & (F.col("m_checkpoint_format") == FORMAT)
    grown = (F.col("dev") == F.col("m_dev")) & (F.col("ino") == F.col("m_ino")) & (F.col("size") >= F.col("m_size")) & (F.col("m_checkpoint_format") == FORMAT)
    action = (
        F.when(F.col("m_committed_offset").isNull(), "new")
        .when(F.coalesce(settled, F.lit(False)), "settled")
        .when(F.coalesce(grown, F.lit(False)), "append")
        .otherwise("check")
    )
    return listing.join(old, "path", "left").select(listing["*"], action.alias("action"), F.col("m_committed_offset").alias("committed_offset"), F.col("m_generation").alias("generation"))


def verify(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """`path, action, start, generation, error`: what is to be read of each listed file.

    `manifest` has, besides the columns of `classify`, `sampled_size` and `hashes` (`sample` at the
    commit). A file is read on from its committed offset (`append`) only if identity and format
    are the same, both ends of the sampled bytes have the same hashes, and it grew or is as it
    was; else it is a `rebuild` from 0 under the next generation, whose old chunks are to be
    removed. `settled` files are not opened; `unchanged` ones prove read to the end. A file that
    changes while it is hashed is `deferred`, one that can't be read `failed`, both with `error`.
    """
    names = ["ctime", "ctime_nsec", "size", "modified"]
    known = manifest.select(
        "path", "sampled_size", "hashes", "checkpoint_format", *(F.col(c).alias(f"m_{c}") for c in ["dev", "ino", *names])
    ).withColumn("known", F.lit(True))
    unchanged = F.lit(True)
    for c in names:
        unchanged = unchanged & F.col(c).eqNullSafe(F.col(f"m_{c}"))
    ready = F.col("known") & (F.col("dev") == F.col("m_dev")) & (F.col("ino") == F.col("m_ino")) & (F.col("checkpoint_format") == FORMAT)
    rows = classify(listing, manifest).join(known, "path", "left").select(
        "path", "action", "size", "committed_offset", "generation", "sampled_size", "hashes",
        F.coalesce(ready & F.col("hashes").isNotNull() & (F.col("size") >= F.col("sampled_size")), F.lit(False)).alias("ready"),
        unchanged.alias("unchanged"), F.coalesce(F.col("size") > F.col("m_size"), F.lit(False)).alias("grown"),
    )

    def decide(path, action, size, offset, generation, sampled, hashes, ready, unchanged, grown) -> tuple:
        if action == "settled":
            return path, action, offset, generation, None
        try:
            before = json_stat(path)
            found = fingerprint(path)
            if found is None:
                return path, "failed", None, generation, "gone"
            valid = ready and sample(path, sampled) == hashes
            if json_stat(path) != before or found["size"] != size:
                return path, "deferred", None, generation, CHANGED
        except OSError as e:
            return path, "failed", None, generation, str(e)
        if valid and unchanged and offset == size:
            return path, "unchanged", offset, generation, None
        if valid and (unchanged or grown) and offset is not None:
            return path, "append", offset, generation, None
        return (path, "new", 0, 0, None) if action == "new" else (path, "rebuild", 0, (generation or 0) + 1, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            out = [decide(*r) for r in zip(*(c.to_pylist() for c in batch.columns))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["path", "action", "start", "generation", "error"])

    return rows.mapInArrow(run, "path string, action string, start bigint, generation bigint, error string")


def ranges(path: str, start: int, end: int, size: int = RANGE) -> list[tuple[str, int, int]]:
    """(path, start, end) of at most `size` bytes, so that one large file is read by many tasks."""
    return [(path, at, min(at + size, end)) for at in range(start, end, size)]


def records(path: str, start: int, end: int, stop: int) -> Iterator[tuple[int, int, bytes | None]]:
    """(start, end, bytes) of the complete records that begin in [start, end) of the first `stop` bytes.

    A range that does not begin at a line's start begins after the next line end; the record that
    reaches over its end is read whole. Bytes are None for a record that is too large. A last line
    without its line end is no record yet.
    """
    with open(path, "rb") as f:
        at = start
        if start > 0:
            f.seek(start - 1)
            if f.read(1) != b"\n":
                at += _record(f, stop - at, 0)[1]
        f.seek(at)
        while at < end:
            kept, length, whole = _record(f, stop - at)
            if not whole:
                return
            yield at, at + length - 1, kept if length <= MOST_RECORD + 1 else None
            at += length


def _record(f, left: int, most: int = MOST_RECORD) -> tuple[bytes, int, bool]:
    """(At most `most` bytes of the next record, its length with the line end, whether it has one).

    The rest of a longer record is read a block at a time and dropped, so memory is bounded.
    """
    kept, length = bytearray(), 0
    while left > length:
        part = f.readline(min(BLOCK, left - length))
        if not part:
            break
        if len(kept) < most:
            kept += part[: most - len(kept)]
        length += len(part)
        if part.endswith(b"\n"):
            return bytes(kept[: length - 1]), length, True
    return bytes(kept), length, False


_DDL = "source_path string, byte_start bigint, byte_end bigint, line string, n_malformed int, error string"


def read(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """`read_listed` of files given as (path, offset to start at, bytes at listing)."""
    if not files:
        return spark.createDataFrame([], _DDL)
    return read_listed(spark.createDataFrame([(*f, json_stat(f[0])) for f in files], "path string, start bigint, size bigint, stat string"))


def read_listed(files: DataFrame, most_tasks: int | None = None) -> DataFrame:
    """Records of `files` (`path, start, size, stat`), read by range in parallel.

    `size` is the bytes at listing, `stat` the `json_stat` then. Columns `source_path, byte_start,
    byte_end, line, n_malformed, error`. A record too large or not in UTF-8 has a null line and
    counts as malformed; a file that cannot be read, or that changed while it was read, gives a row
    with its `error` for each of its ranges, beside rows that then don't count; no other file is
    affected. Records are sent on a few at a time, so a range is never held whole.
    """
    begin = F.expr(f"explode(sequence(start, greatest(start, size - 1), {RANGE}L))")
    listed = files.filter("size > start").select("path", begin.alias("start"), "size", "stat")
    listed = listed.select("path", "start", F.least(F.col("start") + RANGE, "size").alias("stop"), "size", "stat")
    tasks = max(1, min(most_tasks or 1 << 20, 8 * files.sparkSession.sparkContext.defaultParallelism))
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string()]
    names = ["source_path", "byte_start", "byte_end", "line", "n_malformed", "error"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop, size, stat in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held, error = [], 0, None
                try:
                    for a, b, data in records(path, start, stop, size):
                        try:
                            line = None if data is None else data.decode()
                        except UnicodeDecodeError:
                            line = None
                        rows.append((path, a, b, line, int(line is None), None))
                        held += b - a
                        if len(rows) >= SENT or held >= BLOCK:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if json_stat(path) != stat:
                        error = CHANGED
                except OSError as e:
                    error = CHANGED if json_stat(path) != stat else str(e)
                if error is not None:
                    rows.append((path, start, stop, None, 0, error))
                if rows:
                    yield batch_of(rows)

    return listed.repartition(tasks, "path", "start").mapInArrow(run, _DDL)


#: What is said of a file that was written to while it was read: it is deferred, not failed.
CHANGED = "changed while it was read"


def json_stat(path: str) -> str:
    found = fingerprint(path)
    return "gone" if found is None else "/".join(str(v) for v in found.values())
