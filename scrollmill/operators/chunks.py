"""Folding events into single-speaker chunks of bounded size.

Each user event is a chunk; assistant events that follow one another merge; a change of speaker,
session or source closes the open chunk, and so does reaching the size limit, at which the text
is cut into pieces at character boundaries. Order matters only inside such a run, so rows are
range-partitioned by (file, generation, start), each task marks where its runs begin, one row a
task tells the driver which run goes on across an edge, and rows are dealt out anew by run: a
file with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from scrollmill.functions.blank import trimmed
from scrollmill.session import attach, cut

MOST_BYTES = 16384
_FILE = ["agent", "source_file_id", "source_generation"]
_COLUMNS = [*_FILE, "native_id", "source_start", "source_end", "kind", "timestamp", "source_path", "text"]


def normalized(text: Column) -> Column:
    """White space runs as one space, none outside."""
    return trimmed(F.regexp_replace(text, r"(?U)\s+", " "))


def pieces(text: str, most: int) -> Iterator[str]:
    """`text` in pieces of at most `most` UTF-8 bytes, cut between characters; at least one character each."""
    data, at = text.encode(), 0
    while at < len(data):
        stop = min(at + max(4, most), len(data))
        while stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop -= 1
        yield data[at:stop].decode()
        at = stop


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _row_type(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def fold(events: DataFrame, most: int = MOST_BYTES, final: bool = True, opened: DataFrame | None = None) -> DataFrame:
    """Chunks of `events` (the columns of normalized events).

    Columns: `agent, native_id, source_file_id, source_generation, source_path, ordinal, kind,
    timestamp, source_start, source_end, text, n_events, is_open`. A chunk has its first event's
    time in milliseconds (null if that has none), the least start and the greatest end of its
    events; `ordinal` counts from 0 per file and generation. Null and blank texts, null kinds and
    other kinds than 0 and 1 are dropped; events repeated under one (file, generation, start,
    kind, text) count once. Each file's last chunk `is_open`, unless it was closed by its size;
    without `final` it is left out. `opened` (the result of `restored`) resumes files: their open
    turns go on, and ordinals count from where they stood, so that events folded in any number of
    calls give the same chunks as in one.
    """
    plain = [c for c in _COLUMNS if c != "text"]
    rows = (
        events.filter("kind in (0, 1)")
        .withColumn("text", normalized(F.col("text")))
        .filter("text != ''")
        .groupBy(*_FILE, "native_id", "source_start", "kind", F.md5(F.col("text").cast("binary")).alias("_digest"))
        .agg(F.min("source_end").alias("source_end"), F.min("timestamp").alias("timestamp"), F.min("source_path").alias("source_path"), F.first("text").alias("text"))
        .select(*_COLUMNS)
    )
    if opened is not None:
        rows = rows.unionByName(opened.filter("text is not null").select(*(F.col(c).cast(rows.schema[c].dataType).alias(c) for c in plain), "text"))
    order = [*_FILE, "source_start", "source_end", "kind", "native_id"]
    n = _tasks(events)
    ordered = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order))
    edges = _edges(ordered)
    runs = _marked(ordered, edges)
    dealt = runs.repartition(n, *_FILE, "head").sortWithinPartitions(*_FILE, "head", "source_start", "source_end")
    chunks = _folded(dealt, most)
    placed = _numbered(chunks, n)
    if opened is not None:
        bases = cut(opened.select(*_FILE, F.col("next_ordinal").alias("_base")))
        placed = attach(placed, bases, _FILE, by="source_start").withColumn("ordinal", F.col("ordinal") + F.coalesce("_base", F.lit(0))).select(*placed.columns)
    return placed if final else placed.filter("not is_open")


#: The form of an open turn as text, and what is allowed in it.
_TURN = (
    "next_ordinal bigint, pending struct<session_id:struct<agent:string,native_id:string>,ordinal:bigint,timestamp_millis:bigint,"
    "source_path:string,file_id:bigint,generation:bigint,start:bigint,end:bigint,text:string,kind:string>"
)
MOST_ORDINAL = 1_000_000_000
_AGENTS, _KINDS = ("Claude", "Codex"), ("User", "Assistant")


def saved(chunks: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """`agent, source_file_id, source_generation, open_turn_state`: where each file's folding stands, as JSON.

    `chunks` is the result of `fold`; `before` the `restored` states it went on from, for files
    without a chunk since.
    """
    name = lambda c, names: F.when(F.col(c) == 0, names[0]).otherwise(names[1])
    turn = F.struct(
        F.struct(name("agent", _AGENTS).alias("agent"), "native_id").alias("session_id"), "ordinal",
        F.unix_millis("timestamp").alias("timestamp_millis"), "source_path", F.col("source_file_id").alias("file_id"),
        F.col("source_generation").alias("generation"), F.col("source_start").alias("start"), F.col("source_end").alias("end"), "text",
        name("kind", _KINDS).alias("kind"),
    )
    per = chunks.select(*_FILE, (F.col("ordinal") + F.when(F.col("is_open"), 0).otherwise(1)).alias("next"), F.when(F.col("is_open"), turn).alias("turn"))
    if before is not None:
        per = per.unionByName(before.select(*_FILE, F.col("next_ordinal").alias("next")), allowMissingColumns=True)
    whole = per.groupBy(*_FILE).agg(F.max("next").alias("next_ordinal"), F.first("turn", ignorenulls=True).alias("pending"))
    return whole.select(*_FILE, F.to_json(F.struct("next_ordinal", "pending"), {"ignoreNullFields": "false"}).alias("open_turn_state"))


def restored(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """`files` (agent, source_file_id, source_generation, source_path, open_turn_state) with the turn that is open.

    Adds `next_ordinal` (0 without a state), `is_valid`, and of a valid pending turn `native_id,
    kind, timestamp, source_start, source_end, text` (null without one). A state is invalid if it is
    no JSON of the form, its ordinal is too high or not the turn's own, its text is over twice the
    limit, its bytes are in disorder, its time is negative, or its agent or kind is none.
    """
    none = F.coalesce("open_turn_state", F.lit("")) == ""
    read = files.withColumn("_s", F.from_json("open_turn_state", _TURN))
    p = F.col("_s.pending")
    sound = (
        (F.octet_length(p["text"]) <= 2 * max(4, most)) & (p["start"] <= p["end"]) & (p["ordinal"] == F.col("_s.next_ordinal"))
        & (F.coalesce(p["timestamp_millis"], F.lit(0)) >= 0) & p["session_id"]["agent"].isin(*_AGENTS) & p["session_id"]["native_id"].isNotNull() & p["kind"].isin(*_KINDS)
    )
    valid = none | F.coalesce(F.col("_s.next_ordinal").between(0, MOST_ORDINAL) & (p.isNull() | F.coalesce(sound, F.lit(False))), F.lit(False))
    kept = F.when(valid, p)
    return read.select(
        *files.columns, F.coalesce("_s.next_ordinal", F.lit(0)).cast("bigint").alias("next_ordinal"), valid.alias("is_valid"),
        kept["session_id"]["native_id"].alias("native_id"), F.when(kept["kind"] == "User", 0).when(kept.isNotNull(), 1).alias("kind"),
        F.timestamp_millis(kept["timestamp_millis"]).alias("timestamp"), kept["start"].alias("source_start"), kept["end"].alias("source_end"), kept["text"].alias("text"),
    )


def _key(r) -> tuple:
    return tuple(r[c] for c in _FILE)


def _edges(ordered: DataFrame) -> dict[int, int]:
    """For each task whose first row goes on with a run begun before it: where that run begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        head = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                file, session, start, kind = row[:3], row[3], row[4], row[5]
                here = (file, session, kind)
                if last is None:
                    first = (here, start)
                elif here != last or kind == 0:
                    head = start
                last = here
        if last is not None:
            (f0, s0, k0), _ = first
            f1, s1, k1 = last
            rows = [[TaskContext.get().partitionId()], *[[x] for x in f0], [s0], [k0], [first[1]], *[[x] for x in f1], [s1], [k1], [head]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64()])],
                ["p", "a0", "f0", "g0", "s0", "k0", "first", "a1", "f1", "g1", "s1", "k1", "head"],
            )

    ddl = "p int, a0 int, f0 bigint, g0 bigint, s0 string, k0 int, first bigint, a1 int, f1 bigint, g1 bigint, s1 string, k1 int, head bigint"
    names = [*_FILE, "native_id", "source_start", "kind"]
    rows = ordered.select(*names).mapInArrow(run, ddl).collect()  # a row a task
    out: dict[int, int] = {}
    before = None
    for r in sorted(rows, key=lambda r: r["p"]):
        start = (r["a0"], r["f0"], r["g0"], r["s0"], r["k0"])
        begun = r["first"]
        if before is not None and before[0] == start and r["k0"] == 1:
            begun = out[r["p"]] = before[1]
        before = ((r["a1"], r["f1"], r["g1"], r["s1"], r["k1"]), begun if r["head"] is None else r["head"])
    return out


def _marked(ordered: DataFrame, edges: dict[int, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, head = None, None
        for batch in batches:
            heads = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                here = (row[:3], row[3], row[6])
                if last is None:
                    head = edges.get(TaskContext.get().partitionId(), row[4])
                elif here != last or row[6] == 0:
                    head = row[4]
                heads.append(head)
                last = here
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.int64())], [*batch.schema.names, "head"])

    return ordered.mapInArrow(run, _row_type(ordered, _COLUMNS) + ", head bigint")


def _folded(dealt: DataFrame, most: int) -> DataFrame:
    names = [*_FILE, "native_id", "source_path", "head", "part", "kind", "timestamp", "source_start", "source_end", "text", "n_events", "is_full"]
    ddl = _row_type(dealt, [*_FILE, "native_id", "source_path"]) + ", head bigint, part int, kind int, timestamp timestamp, source_start bigint, source_end bigint, text string, n_events int, is_full boolean"
    at = {c: i for i, c in enumerate([*_COLUMNS, "head"])}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        schema = None
        for key, group in groupby(rows(batches), key=lambda r: (*r[:4], r[at["head"]], r[at["kind"]])):
            part, texts, size, open_ = 0, [], 0, None

            def close(limit: bool) -> Iterator[tuple]:
                whole = "\n".join(texts)
                for k, text in enumerate(pieces(whole, most) if limit else [whole]):
                    yield (*key[:4], open_[3], key[4], part + k, key[5], open_[0], open_[1], open_[2], text, len(texts), limit)

            for r in group:
                if open_ is None:
                    open_ = [r[at["timestamp"]], r[at["source_start"]], r[at["source_end"]], r[at["source_path"]]]
                    texts, size = [], 0
                open_[1] = min(open_[1], r[at["source_start"]])
                open_[2] = max(open_[2], r[at["source_end"]])
                size += len(r[at["text"]].encode()) + bool(texts)
                texts.append(r[at["text"]])
                if size >= most:
                    made = list(close(True))
                    out += made
                    part += len(made)
                    open_ = None
            if open_ is not None:
                out += close(False)
            if len(out) > 512:
                yield _batch(out, names)
                out = []
        if out:
            yield _batch(out, names)

    return dealt.mapInArrow(run, ddl)


def _batch(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.timestamp("us", "UTC"), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def _numbered(chunks: DataFrame, n: int) -> DataFrame:
    """`ordinal` of each chunk in its file: counted within tasks of a range partitioning, carried over edges."""
    order = [*_FILE, "head", "part", "native_id"]
    ordered = cut(chunks.repartitionByRange(n, *order).sortWithinPartitions(*order))
    per = ordered.withColumn("p", F.spark_partition_id()).groupBy("p", *_FILE).agg(F.count(F.lit(1)).alias("n"))
    # of each task its first and last file are enough: only these can reach over an edge
    ends = per.groupBy("p").agg(F.min(F.struct(*_FILE, "n")).alias("lo"), F.max(F.struct(*_FILE, "n")).alias("hi"), F.count(F.lit(1)).alias("files")).orderBy("p").collect()
    carry: dict[int, int] = {}
    before: tuple | None = None
    last_task = {}
    for r in ends:
        lo, hi = _key(r["lo"]), _key(r["hi"])
        start = before[1] if before is not None and before[0] == lo else 0
        carry[r["p"]] = start
        before = (hi, r["hi"]["n"] + (start if hi == lo else 0))
        last_task[hi] = r["p"]
        if lo not in last_task or lo == hi:
            last_task[lo] = r["p"]
    edge = {p for p in carry}
    goes_on = {a["p"] for a, b in zip(ends, ends[1:]) if _key(a["hi"]) == _key(b["lo"])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        file, place, held = None, 0, None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            at = []
            for key in keys:
                if key != file:
                    place = carry.get(task, 0) if file is None and task in edge else 0
                    file = key
                at.append(place)
                place += 1
            done = pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "ordinal"])
            if held is not None:
                yield _open(held, keys[0] != held[1])
            held = (done, keys[-1], keys)
        if held is not None:
            yield _open(held, task not in goes_on)

    def _open(held, ends_: bool) -> pa.RecordBatch:
        batch, _, keys = held
        flags = [a != b for a, b in zip(keys, keys[1:])] + [ends_]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags)], [*batch.schema.names, "is_open"])

    numbered = ordered.mapInArrow(run, _row_type(ordered, ordered.columns) + ", ordinal bigint, is_open boolean")
    return numbered.select(
        "agent", "native_id", "source_file_id", "source_generation", "source_path", "ordinal", "kind",
        F.date_trunc("millisecond", "timestamp").alias("timestamp"), "source_start", "source_end", "text", "n_events",
        (F.col("is_open") & ~F.col("is_full")).alias("is_open"),
    )
