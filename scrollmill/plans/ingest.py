"""From folders of transcripts to a searchable store: list, verify, read, parse, fold, commit.

A scan lists the files, compares them with the manifest, and reads of each what is new: nothing
of a settled file, the bytes after the committed offset of one that grew, all of one that is new
or was rewritten. Every record is parsed once into a narrow row (its event, its session facts);
folding goes on from each file's open turn. One commit then adds a part to each table:

- `chunks` and `postings`: closed chunks stay for ever; the open turn of a file is written too, so
  that it can be found, and counts only until the file's next commit;
- `manifest` and `sessions`: the newest row of each file and session counts.

A rebuilt file's rows of older generations don't count any more. So nothing is ever rewritten to
add rows, and `tidy` drops what no longer counts. Files that change while they are read are left
for the next scan, faulty ones reported; neither holds up the others.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from scrollmill.functions.tokens import CONTROLS
from scrollmill.operators import adapters, chunks, enrich, postings
from scrollmill.session import attach, cut
from scrollmill.sources import jsonl
from scrollmill.sources.store import Store

#: Errors that a report tells at most; all are counted.
MOST_ERRORS = 32
_MANIFEST = (
    f"path string, agent int, file_id bigint, generation bigint, committed_offset bigint, {jsonl.STAT}, checkpoint_format int, sampled_size bigint, hashes string,"
    " open_turn_state string, native_id string, cwd string, started_at timestamp, branch string, commit_hash string, repository_url string, repository string, version bigint"
)
_NAMES = [x.split()[0] for x in _MANIFEST.split(", ")]
_FACTS = ["native_id", "cwd", "started_at", "branch", "commit_hash", "repository_url", "repository"]
_FILE = ["agent", "source_file_id", "source_generation"]


@dataclass
class Report:
    """What one scan did."""

    files: int = 0
    skipped: int = 0
    failed: int = 0
    deferred: int = 0
    bytes: int = 0
    records: int = 0
    malformed: int = 0
    chunks: int = 0
    errors: list[str] = field(default_factory=list)
    stopped: bool = False

    def summary(self) -> str:
        """The line that is printed after a scan."""
        more = "".join(f", {n} {what}" for n, what in ((self.deferred, "deferred"), (self.skipped, "unchanged")) if n)
        return f"indexed {self.files} files ({self.failed} failed{more}), {self.records} records ({self.bytes} bytes, {self.chunks} chunks; {self.malformed} malformed)"

    def notes(self) -> list[str]:
        """A line for each error told, and one for all files that were left for the next scan."""
        late = [f"{self.deferred} file(s) changed while being read and were left for the next run"] if self.deferred else []
        return [f"indexing error: {CONTROLS.sub('�', e)}" for e in self.errors] + late


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows of each key that of the highest version."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("r")).select(*keys, "r.*")


def manifest(store: Store) -> DataFrame:
    """The newest row of each file."""
    rows = store.read("manifest")
    return store.spark.createDataFrame([], _MANIFEST) if rows is None else newest(rows, ["path"]).select(*_NAMES)


def sessions(store: Store) -> DataFrame | None:
    """The newest row of each session, whole: its nulls replace older values."""
    rows = store.read("sessions")
    return None if rows is None else newest(rows, ["agent", "native_id"])


def live(store: Store, rows: DataFrame) -> DataFrame:
    """Of rows of chunks or postings those that count: of the file's generation, an open turn's only of its last commit."""
    if not store.pointer()["facts"].get("has_old"):
        return rows
    files = cut(manifest(store).select("agent", F.col("file_id").alias("source_file_id"), F.col("generation").alias("_generation"), F.col("version").alias("_version")))
    found = attach(rows, files, ["agent", "source_file_id"], by="chunk_id")
    return found.filter("source_generation = _generation and (not is_open or version = _version)").select(*rows.columns)


def index(store: Store) -> postings.Index | None:
    """What searches read."""
    made = store.read("postings")
    if made is None:
        return None
    counts = live(store, store.read("chunks")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()
    return postings.Index(live(store, made), None, live(store, store.read("chunks")), counts["n"], counts["t"])


def _facts(seen: DataFrame) -> DataFrame:
    """A row per file: the last id and folder, the first time, the first of each recorded Git fact."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("byte_start"))).alias(c)
    first = lambda c, name: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("byte_start"))).alias(name)
    return seen.groupBy("path").agg(
        last("native_id"), last("cwd"), first("at", "started_at"), *(first(c, c) for c in ("branch", "commit_hash", "repository_url", "repository")),
        F.max("byte_end").alias("last_byte"), F.count(F.lit(1)).alias("n_records"), F.sum(F.col("is_malformed").cast("bigint")).alias("n_malformed"),
    )


def _with_ids(seen: DataFrame, prior: DataFrame) -> DataFrame:
    """Events with the session id that held when they were written: the last one named before, else the file's own placeholder.

    Most files name one id; only the records of files that name several are put in order.
    """
    ids = seen.filter("native_id is not null").select("path", "byte_start", "native_id")
    started = ids.groupBy("path").agg(F.min("native_id").alias("lo"), F.max("native_id").alias("hi"), F.min("byte_start").alias("from_byte"))
    several = ids.join(started.filter("lo != hi").select("path"), "path", "left_semi")
    # changes of id, in order: as many as there are changes, not as there are records
    before = F.expr("lag(native_id) over (partition by path order by byte_start)")
    changes = several.withColumn("before", before).filter("before is null or before != native_id").groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("byte_start", "native_id"))).alias("changes")
    )
    per = cut(
        started.join(changes, "path", "left")
        .join(prior.select("path", F.col("native_id").alias("old")), "path", "full")
        .select("path", "old", F.coalesce("changes", F.when(F.col("lo").isNotNull(), F.array(F.struct(F.col("from_byte").alias("byte_start"), F.col("lo").alias("native_id"))))).alias("changes"))
    )
    events = seen.filter("text is not null").drop("native_id")
    told = F.filter("changes", lambda x: x["byte_start"] <= F.col("byte_start"))
    placeholder = F.concat(F.lit("unidentified-source-"), F.col("file_id"))
    return events.join(per, "path", "left").withColumn("native_id", F.coalesce(F.try_element_at(told, F.lit(-1))["native_id"], "old", placeholder))


def _sealed(todo: DataFrame) -> DataFrame:
    """`path, hashes, fault`: hashes of both ends of each file, or what was found wrong now that it was read."""

    def run(batches):
        for batch in batches:
            out = []
            for path, size, stat in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    hashes, fault = jsonl.sample(path, size), None
                    if jsonl.json_stat(path) != stat:
                        fault = jsonl.CHANGED
                except OSError as e:
                    hashes, fault = None, jsonl.CHANGED if jsonl.json_stat(path) != stat else str(e)
                out.append((path, hashes, fault))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["path", "hashes", "fault"])

    return todo.select("path", "size", "stat").mapInArrow(run, "path string, hashes string, fault string")


def ingest(store: Store, roots: dict[int, list[str]], stop: Callable[[], bool] = lambda: False, git: Callable[[str], dict] | None = None) -> Report:
    """Scan `roots` (agent to folders) once and commit what is new; `git` tells of a folder what Git says of it now.

    `stop` is asked between the steps: a scan that is stopped commits nothing. Files that are gone
    keep their rows; a renamed file is a new one. Paths are listed on the driver, everything else
    is done in tasks; the folders are ones that all executors share.
    """
    spark, report = store.spark, Report()
    base = store.version
    paths: dict[str, int] = {}
    for agent, folders in roots.items():
        found = jsonl.discover(folders, stop)
        if found is None:
            return Report(stopped=True)
        for p in found:
            paths.setdefault(p, agent)
    known = cut(manifest(store))
    listed = cut(jsonl.listing(spark, [(a, p) for p, a in paths.items()]))
    todo = _plan(listed, known, base)
    asked = todo.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sum(F.ceil((F.col("size") - F.col("start")) / jsonl.RANGE)).alias("ranges")).collect()
    counts = {r["action"]: r["n"] for r in asked}
    tasks = sum(r["ranges"] or 0 for r in asked if r["action"] in ("new", "append", "rebuild"))
    report.files, report.skipped = sum(counts.values()), counts.get("settled", 0) + counts.get("unchanged", 0)
    work = todo.filter("action in ('new', 'append', 'rebuild')")
    backfill = todo.filter("action = 'unchanged'")
    if stop():
        return Report(stopped=True)

    records = jsonl.read_listed(work.select("path", "start", "size", "stat"), tasks).withColumnRenamed("source_path", "path")
    seen = cut(
        adapters.observed(records.join(work.select("path", "agent", "file_id", "generation"), "path")).drop("n_malformed")
    )
    faults = (
        seen.filter("error is not null").groupBy("path").agg(F.min("error").alias("fault"))
        .unionByName(_sealed(work).filter("fault is not null").select("path", "fault"))
        .unionByName(todo.filter("action in ('failed', 'deferred')").select("path", F.col("error").alias("fault")))
        .unionByName(todo.filter("not is_valid").select("path", F.lit("the open turn is not valid").alias("fault")))
        .groupBy("path").agg(F.min("fault").alias("fault"))
    )
    faults = cut(faults)
    if stop():
        return Report(stopped=True)
    for r in faults.groupBy((F.col("fault") == jsonl.CHANGED).alias("late")).agg(F.count(F.lit(1)).alias("n")).collect():
        if r["late"]:
            report.deferred = r["n"]
        else:
            report.failed = r["n"]
    report.errors = [f"{r['path']}: {r['fault']}" for r in faults.filter(F.col("fault") != jsonl.CHANGED).orderBy("path").limit(MOST_ERRORS).collect()]
    good = work.join(faults.select("path"), "path", "left_anti")
    seen = seen.join(faults.select("path"), "path", "left_anti").filter("error is null")

    resumed = good.filter("action = 'append'")
    opened = cut(resumed.select(
        "agent", F.col("file_id").alias("source_file_id"), F.col("generation").alias("source_generation"), F.col("path").alias("source_path"),
        "next_ordinal", F.struct("pending.*").alias("p"),
    ).select("agent", "source_file_id", "source_generation", "source_path", "next_ordinal", "p.*"))
    events = _with_ids(seen, resumed.select("path", "old.native_id")).select(
        "agent", F.col("file_id").alias("source_file_id"), F.col("generation").alias("source_generation"), F.col("path").alias("source_path"), "native_id",
        F.col("byte_start").alias("source_start"), F.col("byte_end").alias("source_end"), "kind", "timestamp", "text",
    )
    folded = chunks.fold(events, opened=opened)
    made = cut(postings.tokenized(folded.withColumn("chunk_id", chunk_id())).withColumn("version", F.lit(base + 1).cast("bigint")))

    facts = cut(_facts(seen))
    totals = facts.agg(F.sum("n_records").alias("n"), F.sum("n_malformed").alias("m")).first()
    report.malformed = totals["m"] or 0
    report.records = (totals["n"] or 0) - report.malformed
    report.chunks = made.filter("not is_open").count()
    states = chunks.saved(made, opened)
    rows = _manifest_rows(good, facts, states, _sealed(work), base + 1)
    rows = cut(rows)
    report.bytes = rows.agg(F.sum(F.col("committed_offset") - F.col("start"))).first()[0] or 0
    # an unchanged file that had to be hashed: its stat is kept, so the next scan need not open it
    settled = known.join(backfill.select("path", *(F.col(c).alias(f"_{c}") for c in ("dev", "ino", "ctime", "ctime_nsec", "modified"))), "path").select(
        *(F.col(f"_{c}").alias(c) if c in ("dev", "ino", "ctime", "ctime_nsec", "modified") else F.col(c) for c in _NAMES)
    )
    new_rows = rows.select(*_NAMES).unionByName(settled)
    if stop():
        return Report(stopped=True)
    if rows.filter("action != 'append' or committed_offset > start").isEmpty() and not counts.get("unchanged"):
        return report
    # only an append or a rebuild leaves rows behind that no longer count
    old = any(counts.get(a) for a in ("append", "rebuild"))
    store.commit(
        {}, base, append={
            "chunks": made, "postings": postings.postings(made), "manifest": new_rows, "sessions": _session_rows(rows, made, git),
        }, facts={"has_old": True} if old else None,
    )
    return report


def chunk_id() -> Column:
    """The id of a chunk: a hash of its file, generation and ordinal, the same in every scan."""
    return F.xxhash64("agent", "source_file_id", "source_generation", "ordinal")


def _plan(listed: DataFrame, known: DataFrame, base: int) -> DataFrame:
    """A row per listed file: what to do, from which byte, under which id, and its open turn."""
    decided = jsonl.verify(listed.drop("agent"), known).withColumnsRenamed({"start": "_start", "generation": "_generation"})
    state = chunks.restored(
        known.select("path", "agent", "file_id", "native_id", F.col("file_id").alias("source_file_id"), F.col("generation").alias("source_generation"), F.col("path").alias("source_path"), "open_turn_state").drop("native_id")
    ).select("path", F.col("file_id").alias("_id"), "next_ordinal", "is_valid", F.struct("native_id", "kind", "timestamp", "source_start", "source_end", "text").alias("pending"))
    rows = decided.join(listed, "path").join(state, "path", "left").join(known.select("path", F.struct(*_FACTS).alias("old")), "path", "left")
    # new ids go on from the highest one, in the order of paths; numbered once, as they must not change
    highest = known.agg(F.coalesce(F.max("file_id"), F.lit(0))).first()[0]
    fresh = [r["path"] for r in decided.filter("action = 'new'").select("path").orderBy("path").toLocalIterator()]
    ids = listed.sparkSession.createDataFrame([(p, highest + i + 1) for i, p in enumerate(fresh)], "path string, new_id bigint")
    resumed = F.col("action") == "append"
    return cut(rows.join(ids, "path", "left").select(
        "path", "agent", "action", "error", F.col("_start").alias("start"), F.coalesce("_generation", F.lit(0)).cast("bigint").alias("generation"), F.coalesce("_id", "new_id").alias("file_id"),
        *jsonl._STAT_NAMES, F.concat_ws("/", *(F.col(c).cast("string") for c in jsonl._STAT_NAMES)).alias("stat"),
        F.when(resumed, F.col("next_ordinal")).otherwise(0).alias("next_ordinal"), (~resumed | F.coalesce("is_valid", F.lit(True))).alias("is_valid"), "pending",
        F.when(resumed, F.col("old")).alias("old"),
    ))


def _manifest_rows(good: DataFrame, facts: DataFrame, states: DataFrame, sealed: DataFrame, version: int) -> DataFrame:
    """The manifest's rows of the files that were read, and the byte each was read from."""
    known = good.select("path", "agent", "file_id", "generation", "start", "action", "old", *jsonl._STAT_NAMES)
    # of id and folder the newest counts, of the rest what was known first
    facts = facts.withColumnsRenamed({c: f"new_{c}" for c in _FACTS})
    pick = lambda c: F.coalesce(*((f"new_{c}", f"old.{c}") if c in ("native_id", "cwd") else (f"old.{c}", f"new_{c}"))).alias(c)
    state = states.select("agent", F.col("source_file_id").alias("file_id"), F.col("source_generation").alias("generation"), "open_turn_state")
    own = known.join(facts, "path", "left").join(state, ["agent", "file_id", "generation"], "left").join(sealed.select("path", "hashes"), "path")
    return own.select(
        "path", "agent", "file_id", "generation", F.greatest("start", F.coalesce(F.col("last_byte") + 1, F.col("start"))).alias("committed_offset"), *jsonl._STAT_NAMES,
        F.lit(jsonl.FORMAT).alias("checkpoint_format"), F.col("size").alias("sampled_size"), "hashes", "open_turn_state", *map(pick, _FACTS), F.lit(version).cast("bigint").alias("version"), "start", "action",
    )


def _session_rows(rows: DataFrame, made: DataFrame, git: Callable[[str], dict] | None) -> DataFrame:
    """A session's row for each id of a file: the last one with the file's facts, others of their chunks alone."""
    own = rows.select(
        "agent", F.coalesce("native_id", F.concat(F.lit("unidentified-source-"), F.col("file_id"))).alias("native_id"), F.col("path").alias("source_path"), F.col("file_id").alias("source_file_id"),
        F.col("generation").alias("source_generation"), F.lit(0).cast("bigint").alias("source_start"), F.col("committed_offset").alias("source_end"),
        "cwd", "repository", "branch", "commit_hash", "started_at", "repository_url", "version",
    )
    whole = enrich.with_git(own, git)
    other = made.groupBy("agent", "native_id").agg(
        *(F.max_by(c, "source_end").alias(c) for c in ("source_path", "source_file_id", "source_generation")), F.min("source_start").alias("source_start"), F.max("source_end").alias("source_end"), F.max("version").alias("version"),
    ).join(own.select("agent", "native_id"), ["agent", "native_id"], "left_anti")
    return whole.unionByName(other, allowMissingColumns=True)


def write_transcripts(lines: DataFrame, folder: str) -> None:
    """Append `lines` (`agent, file_id, byte_start, line`) to a transcript file each in the order of bytes, `folder/agent-A/ID.jsonl`.

    A file is written by one task, as appending is. A task that is retried would append twice: this is for
    making test folders. Other columns are not read.
    """

    def run(batches):
        path, out = None, None
        for batch in batches:
            for agent, file_id, line in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if path != (agent, file_id):
                    if out is not None:
                        out.close()
                    path = (agent, file_id)
                    os.makedirs(f"{folder}/agent-{agent}", exist_ok=True)
                    out = open(f"{folder}/agent-{agent}/{file_id}.jsonl", "a", encoding="utf-8", newline="")
                out.write(line + "\n")
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32())], ["n"])

    rows = lines.select("agent", "file_id", "byte_start", "line").repartition("agent", "file_id").sortWithinPartitions("agent", "file_id", "byte_start")
    rows.mapInArrow(run, "n int").count()


def tidy(store: Store, files: int = 1) -> int:
    """Rewrite the tables without the rows that no longer count, remove old parts; the version made."""
    base = store.version
    kept = {"chunks": live(store, store.read("chunks")), "postings": postings.in_order(live(store, store.read("postings")), files), "manifest": manifest(store), "sessions": sessions(store)}
    made = store.commit({n: df if n == "postings" else df.repartition(files) for n, df in kept.items()}, base, facts={"has_old": False})
    store.reclaim()
    return made
