"""Rebuilding conversations from message rows by parent pointers.

The parent of a message is the message of its session with the ordinal below its own, or, in a
session without ordinals, the one before it in time. A conversation is a path: every message but
the first has its parent, and no message has two children. Following pointers row by row would
take as many steps as the longest session is long, and gathering a session in one task fails for
one that holds a third of all rows. So:

1. rows are range-partitioned by (agent, session, order), which deals long sessions over many
   tasks, and each task contracts its rows to runs, in which every row's parent is the row before;
   a run goes by the key of its last row and points to the key that its first row's parent has;
2. runs are resolved by iterative pointer-jumping joins (`jump`), which double the distance each
   round; a session that is one run from its first ordinal on is resolved already;
3. a run whose parent is no run's key is an orphan: a message is missing there. Runs of equal
   depth are a fork: an ordinal is held twice. Either breaks the session. Sound runs are a path,
   and their depth is their place in the conversation.

`jump` works on any table of nodes and parents, also finds cycles, and has a query of its own over
records that carry explicit pointers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from scrollmill.functions.blank import has_text, trimmed
from scrollmill.session import cut

_KEY = ["agent", "session_id"]
_USER, _ASSISTANT = 1, 2


def jump(nodes: DataFrame) -> DataFrame:
    """Resolve the parent pointers of `nodes` (`node`, `parent`; other columns are dropped).

    Returns `node`, `root`, `depth` (steps to the root) and `state`: `ok`, `orphan` (the chain
    ends at a parent that is no node; `root` is then the last node before it) or `cycle` (the
    chain never ends; `root` and `depth` are null). `node` is unique and not null; a null parent
    makes a root. Each round joins the open pointers with all pointers by node and doubles the
    distance covered, so a chain of n nodes takes log2(n) rounds; each round's table is written
    to the checkpoint folder.
    """
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
    linked = nodes.select("node", "parent").join(known, "parent", "left")
    first = linked.select(
        "node",
        F.when(F.col("there"), F.col("parent")).otherwise(F.col("node")).alias("to"),
        F.when(F.col("there"), 1).otherwise(0).cast("bigint").alias("depth"),
        F.when(F.col("there"), None).when(F.col("parent").isNull(), "ok").otherwise("orphan").alias("state"),
    )
    at = cut(first)
    left = at.count()
    while left > 0:
        open_ = at.filter("state is null")
        if open_.isEmpty():
            break
        ahead = at.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"), F.col("state").alias("end"))
        moved = open_.drop("state").join(ahead, "to", "left").select(
            "node", F.col("next").alias("to"), (F.col("depth") + F.col("more")).alias("depth"), F.col("end").alias("state")
        )
        at = cut(at.filter("state is not null").unionByName(moved))
        left //= 2
    return at.select(
        "node",
        F.when(F.col("state").isNotNull(), F.col("to")).alias("root"),
        F.when(F.col("state").isNotNull(), F.col("depth")).alias("depth"),
        F.coalesce("state", F.lit("cycle")).alias("state"),
    )


def paths(nodes: DataFrame) -> DataFrame:
    """Root-to-leaf order of `nodes` (`node`, `parent`): `root`, `depth`, `node` of sound chains.

    Rows sorted by root and depth read each conversation from its root; nodes of chains with an
    orphan or a cycle are left out.
    """
    return jump(nodes).filter("state = 'ok'").select("root", "depth", "node")


def threads(records: DataFrame) -> DataFrame:
    """`root, state, n_nodes, longest` of the threads that explicit pointers of records make.

    `records` has `node` and `parent`; a node that is null is left out, of a repeated one the least
    parent counts. Chains with a cycle have a null root and are one row together.
    """
    known = records.filter("node is not null").groupBy("node").agg(F.min("parent").alias("parent"))
    return jump(cut(known)).groupBy("root", "state").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("depth").alias("longest"))


def distinct_messages(rows: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per message: rows equal in session, ordinal, type and text count once.

    Types are compared without letter case and outer space, texts without outer space; of a
    message's times and ids the least is kept. `said` is 1 for a user's text, 2 for an
    assistant's, 0 for anything else or a blank.
    """
    kind = F.lower(trimmed(F.col("type")))
    text = trimmed(F.col("text"))
    said = F.when(~has_text(F.col("text")), 0).when(kind == "user", _USER).when(kind == "assistant", _ASSISTANT).otherwise(0)
    plain = rows.select(
        F.col("agent").cast("int"),
        "session_id",
        F.col("ordinal").cast("bigint"),
        kind.alias("kind"),
        F.md5(text.cast("binary")).alias("digest"),
        said.alias("said"),
        F.col("timestamp").alias("at"),
        F.col("message_id").cast("bigint"),
        *([text.alias("text")] if with_text else []),
    )
    return plain.groupBy(*_KEY, "ordinal", "kind", "digest").agg(
        F.max("said").alias("said"),
        F.min("at").alias("at"),
        F.min("message_id").alias("message_id"),
        *([F.first("text").alias("text")] if with_text else []),
    )


def _in_order(messages: DataFrame, tasks: int) -> DataFrame:
    order = [*_KEY, "ordinal", "at", "message_id"]
    return messages.repartitionByRange(tasks, *order).sortWithinPartitions(*order)


_RUN = [
    ("agent", pa.int32()),
    ("session_id", pa.string()),
    ("run", pa.int32()),
    ("n", pa.int64()),
    ("n_ordinals", pa.int64()),
    ("first_ordinal", pa.int64()),
    ("last_ordinal", pa.int64()),
    ("n_said", pa.int64()),
    ("first_said", pa.int32()),
    ("last_said", pa.int32()),
    ("unanswered", pa.int64()),
]
_RUN_DDL = (
    "agent int, session_id string, run int, n bigint, n_ordinals bigint, first_ordinal bigint, last_ordinal bigint,"
    " n_said bigint, first_said int, last_said int, unanswered bigint"
)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contract the sorted rows of a task to a row per run: rows of a session that follow one another."""
    task = TaskContext.get().partitionId()
    rows: list[list] = []
    open_: list | None = None
    for batch in batches:
        for agent, session, ordinal, said in zip(*(batch.column(i).to_pylist() for i in range(4))):
            follows = open_ is not None and open_[1] == session and open_[0] == agent
            if follows:
                before = open_[6]
                follows = ordinal is None if before is None else ordinal == before + 1
            if not follows:
                open_ = [agent, session, task, 0, 0, ordinal, ordinal, 0, 0, 0, 0]
                rows.append(open_)
            open_[3] += 1
            open_[4] += ordinal is not None
            open_[6] = ordinal
            if said:
                open_[10] += said == _USER and open_[9] == _USER
                open_[7] += 1
                open_[8] = open_[8] or said
                open_[9] = said
        if len(rows) > 8192:
            yield _runs(rows[:-1])
            rows = rows[-1:]
    if rows:
        yield _runs(rows)


def _runs(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _RUN)], [n for n, _ in _RUN])


def _tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sessions(rows: DataFrame) -> DataFrame:
    """A row per session with `reason`: null if it is kept, else `empty`, `broken` or `no_reply`.

    The first reason that applies: `empty` = no user or assistant row with text; `broken` = the
    session has ordinals and those of its messages are not 0, 1, 2, … each held once (a null
    among ordinals breaks it too), or an assistant's text comes first; `no_reply` = a user's text
    that no assistant's text follows before the next user's text or the end. In a session without
    ordinals rows go by time, null times first, ties by message id. A null agent or session id
    is a value like any other. Columns: `agent`, `session_id`, `reason`, `n_messages`, `n_runs`.
    """
    slim = distinct_messages(rows).select(*_KEY, "ordinal", "said", "at", "message_id")
    return _verdicts(_chained(_heads(_in_order(slim, _tasks(rows)))))


def _heads(ordered: DataFrame) -> DataFrame:
    """The runs of all sessions, contracted task by task and written once."""
    return cut(ordered.select(*_KEY, "ordinal", "said").mapInArrow(_contract, _RUN_DDL))


def _key(*parts) -> Column:
    return F.to_json(F.struct(F.col("agent"), F.col("session_id"), *parts), {"ignoreNullFields": "false"})


def _chained(runs: DataFrame) -> DataFrame:
    """Runs with `depth`, their place in the session, and the `state` of the chain of their parents.

    A run with ordinals points to the ordinal before its first, a run without to the session's run
    before it (there is one a task). Only sessions of several runs, or of a run that does not begin
    at 0, have pointers left to resolve.
    """
    own = Window.partitionBy(*_KEY)
    many = runs.withColumn("n_runs", F.count(F.lit(1)).over(own))
    whole = (F.col("n_runs") == 1) & (F.col("first_ordinal").isNull() | (F.col("first_ordinal") == 0))
    done = many.filter(whole).withColumn("depth", F.lit(0).cast("bigint")).withColumn("state", F.lit("ok"))
    numbered = F.col("last_ordinal").isNotNull()
    several = many.filter(~whole).withColumn("node", F.when(numbered, _key(F.col("last_ordinal").alias("at"))).otherwise(_key(F.col("run").alias("run"))))
    before = F.lag(F.when(~numbered, F.col("node"))).over(own.orderBy(numbered, "run"))
    several = several.withColumn(
        "parent", F.when(~numbered, before).when(F.col("first_ordinal") != 0, _key(F.try_subtract(F.col("first_ordinal"), F.lit(1).cast("bigint")).alias("at")))
    )
    several = cut(several)
    # an ordinal held twice may end two runs: one node, of which the two have the same depth
    found = jump(several.groupBy("node").agg(F.min("parent").alias("parent"))).select("node", "depth", "state")
    return done.unionByName(several.join(found, "node").select(done.columns))


def _verdicts(chained: DataFrame) -> DataFrame:
    before = Window.partitionBy(*_KEY).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    # a sound session has at most a run a task, and a broken one is not in the order of its messages
    seen = chained.withColumn("last", F.last(F.when(F.col("n_said") > 0, F.col("last_said")), ignorenulls=True).over(before))
    open_turn = F.col("unanswered") + F.when((F.col("last") == _USER) & (F.col("first_said") == _USER), 1).otherwise(0)
    first = F.struct(F.coalesce("first_ordinal", F.lit(-1)), "run")
    whole = seen.groupBy(*_KEY).agg(
        F.sum("n").alias("n_messages"),
        F.sum("n_said").alias("n_said"),
        F.sum("n_ordinals").alias("n_ordinals"),
        F.sum(F.when(F.col("state") == "ok", 0).otherwise(1)).alias("lost"),
        F.countDistinct("depth").alias("n_depths"),
        F.sum(open_turn).alias("open_turns"),
        F.min_by("first_said", F.when(F.col("n_said") > 0, first)).alias("began"),
        F.max_by("last_said", F.when(F.col("n_said") > 0, first)).alias("ended"),
        F.count(F.lit(1)).alias("n_runs"),
    )
    no_path = (F.col("lost") > 0) | (F.col("n_depths") < F.col("n_runs"))
    gaps = (F.col("n_ordinals") > 0) & (no_path | (F.col("n_ordinals") < F.col("n_messages")))
    reason = (
        F.when(F.col("n_said") == 0, "empty")
        .when(gaps | (F.col("began") == _ASSISTANT), "broken")
        .when((F.col("open_turns") > 0) | (F.col("ended") == _USER), "no_reply")
    )
    return whole.select(*_KEY, reason.alias("reason"), "n_messages", "n_runs")


def rebuild(rows: DataFrame) -> DataFrame:
    """The turns of all kept sessions: `agent, session_id, turn, role, text, timestamp, message_id`.

    `turn` counts the session's user and assistant texts from zero in order. A row per turn and
    not a list per session: a session may hold a third of all rows.
    """
    # written once: both passes must see the same rows in the same task, and the bounds of a range
    # partitioning come from a sample
    ordered = cut(_in_order(distinct_messages(rows, with_text=True), _tasks(rows)))
    chained = cut(_chained(_heads(ordered)))
    before = Window.partitionBy(*_KEY).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chained.select(*_KEY, "run", F.coalesce(F.sum("n_said").over(before), F.lit(0)).alias("offset"))
    kept = _verdicts(chained).filter("reason is null").select(*_KEY)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        key, place = None, 0
        for batch in batches:
            at = []
            for agent, session, said in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (agent, session) != key:
                    key, place = (agent, session), 0
                at.append(place)
                place += said != 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([task] * len(at), pa.int32()), pa.array(at, pa.int64())],
                [*batch.schema.names, "run", "place"],
            )

    columns = [*_KEY, "said", "at", "message_id", "text"]
    ordered = ordered.select(*columns)
    at_type = ordered.schema["at"].dataType.simpleString()
    ddl = f"agent int, session_id string, said int, at {at_type}, message_id bigint, text string, run int, place bigint"
    numbered = ordered.mapInArrow(number, ddl).filter("said > 0")
    placed = numbered.join(offsets.withColumnsRenamed({k: f"o_{k}" for k in [*_KEY, "run"]}), [
        numbered["agent"].eqNullSafe(F.col("o_agent")), numbered["session_id"].eqNullSafe(F.col("o_session_id")), numbered["run"] == F.col("o_run"),
    ])
    last = placed.join(kept.withColumnsRenamed({k: f"k_{k}" for k in _KEY}), [
        F.col("agent").eqNullSafe(F.col("k_agent")), F.col("session_id").eqNullSafe(F.col("k_session_id")),
    ], "left_semi")
    return last.select(
        *_KEY,
        (F.col("offset") + F.col("place")).alias("turn"),
        F.when(F.col("said") == _USER, "user").otherwise("assistant").alias("role"),
        "text",
        F.col("at").alias("timestamp"),
        "message_id",
    )
