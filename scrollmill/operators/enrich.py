"""Provenance, availability and resumption of sessions, as column expressions and small joins."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

UUID = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
# States of an agent in a host, most urgent first.
STATES = ("blocked", "error", "done", "working", "idle", "running")
# Variables that would point Git at another repository.
GIT_VARIABLES = (
    "GIT_DIR", "GIT_WORK_TREE", "GIT_INDEX_FILE", "GIT_OBJECT_DIRECTORY", "GIT_ALTERNATE_OBJECT_DIRECTORIES",
    "GIT_COMMON_DIR", "GIT_NAMESPACE", "GIT_CEILING_DIRECTORIES", "GIT_QUARANTINE_PATH", "GIT_PREFIX",
)


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(UUID), F.lit(False))


def is_full_commit(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^(?:[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})$"), F.lit(False))


def is_clean_path(path: Column) -> Column:
    """Absolute, and without an empty, `.`, `..` or `.git` part; `/` alone is clean."""
    parts = F.slice(F.split(path, "/"), 2, 1 << 20)
    return F.coalesce((path == "/") | (path.startswith("/") & ~F.exists(parts, lambda p: p.isin("", ".", "..", ".git"))), F.lit(False))


def recovery_options(sessions: DataFrame, paths: DataFrame) -> DataFrame:
    """`sessions` with `states` of cwd, root and worktree from `paths` (`path, state`), and `options`.

    `paths` says for probed paths Missing, File or Directory; a path not in it, and any that is
    not clean, counts as Missing. `availability` is OnDisk, Recoverable, RepositoryKnown or
    TranscriptOnly; `options` are the ways back in order of preference.
    """
    known = paths.groupBy("path").agg(F.max(F.when(F.col("state") == "Directory", 1).otherwise(0)).alias("is_dir"))
    out = sessions
    for name in ("cwd", "repository_root", "worktree"):
        side = known.select(F.col("path").alias(f"_{name}_path"), (F.col("is_dir") == 1).alias(f"_{name}"))
        out = out.join(side, F.when(is_clean_path(F.col(name)), F.col(name)) == F.col(f"_{name}_path"), "left").drop(f"_{name}_path")
        out = out.withColumn(f"_{name}", F.coalesce(f"_{name}", F.lit(False)))
    options = F.array_compact(
        F.array(
            F.when(F.col("_worktree"), "OpenWorktree"),
            F.when(F.col("_repository_root"), "OpenRepository"),
            F.when(F.col("_repository_root") & ~F.col("_worktree") & recreation_target(), "RecreateWorktree"),
        )
    )
    known_repo = F.coalesce("repository", "repository_root", "commit_hash", "branch").isNotNull()
    return out.select(
        sessions["*"],
        F.when(F.col("_cwd"), "OnDisk").when(F.size(options) > 0, "Recoverable").when(known_repo, "RepositoryKnown").otherwise("TranscriptOnly").alias("availability"),
        options.alias("options"),
    )


def availability_of(keys: DataFrame, sessions: DataFrame, paths: DataFrame) -> DataFrame:
    """`agent, native_id, availability, options` for each of `keys`; a session without a row is TranscriptOnly."""
    known = recovery_options(sessions, paths).groupBy("agent", "native_id").agg(F.max_by(F.struct("availability", "options"), F.struct("source_generation", "source_end")).alias("x"))
    return keys.join(known, ["agent", "native_id"], "left").select(
        "agent", "native_id", F.coalesce("x.availability", F.lit("TranscriptOnly")).alias("availability"), F.coalesce("x.options", F.array().cast("array<string>")).alias("options")
    )


def running_commands() -> list[str]:
    """The command lines of the processes of this machine, arguments parted by spaces; none where it does not tell."""
    lines = []
    for pid in filter(str.isdigit, os.listdir("/proc") if os.path.isdir("/proc") else []):
        try:
            with open(f"/proc/{pid}/cmdline", "rb") as f:
                lines.append(f.read().rstrip(b"\0").replace(b"\0", b" ").decode("utf-8", "replace"))
        except OSError:  # gone, or another user's
            continue
    return [x for x in lines if x]


def recreation_target() -> Column:
    """Whether a session's worktree may be made again: clean paths, a full commit, cwd inside the worktree."""
    root, tree, cwd = F.col("repository_root"), F.col("worktree"), F.col("cwd")
    inside = (cwd == tree) | cwd.startswith(F.concat(tree, F.lit("/")))
    return F.coalesce(is_clean_path(root) & is_clean_path(tree) & is_clean_path(cwd) & is_full_commit(F.col("commit_hash")) & (root != tree) & inside, F.lit(False))


def recreation_argv() -> Column:
    """The command that makes a session's worktree again; null where it may not."""
    argv = F.array(F.lit("git"), F.lit("-C"), F.col("repository_root"), *map(F.lit, ("worktree", "add", "--detach", "--")), F.col("worktree"), F.col("commit_hash"))
    return F.when(recreation_target(), argv)


def resume_argv() -> Column:
    """The command that resumes a session by its native id; null unless that is a UUID."""
    claude = F.array(F.lit("claude"), F.lit("--resume"), F.col("native_id"))
    codex = F.array(F.lit("codex"), F.lit("resume"), F.col("native_id"))
    return F.when(is_uuid(F.col("native_id")), F.when(F.col("agent") == 0, claude).when(F.col("agent") == 1, codex))


def resume_name(native_id: Column) -> Column:
    """`ah-` and the UUID as 25 digits to the base 36; null unless it is a UUID.

    The 128 bits are divided digit by digit as decimals of 38 digits, high and low half apart.
    """
    bits = F.lower(F.replace(native_id, F.lit("-"), F.lit("")))
    digits = F.lit("0123456789abcdefghijklmnopqrstuvwxyz")
    limbs = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(bits, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint"))

    def step(state: Column, _: Column) -> Column:
        divided = F.aggregate(
            state["limbs"],
            F.struct(F.expr("cast(array() as array<bigint>)").alias("q"), F.lit(0).cast("bigint").alias("r")),
            lambda acc, x: F.struct(
                F.array_append(acc["q"], F.floor((acc["r"] * 65536 + x) / 36).cast("bigint")).alias("q"), ((acc["r"] * 65536 + x) % 36).cast("bigint").alias("r")
            ),
        )
        return F.struct(divided["q"].alias("limbs"), F.concat(F.substring(digits, divided["r"].cast("int") + 1, F.lit(1)), state["out"]).alias("out"))

    start = F.struct(limbs.alias("limbs"), F.lit("").alias("out"))
    return F.when(is_uuid(native_id), F.concat(F.lit("ah-"), F.aggregate(F.sequence(F.lit(1), F.lit(25)), start, step)["out"]))


def context_label() -> Column:
    """`repository / branch`, either alone, or that none is recorded."""
    return F.coalesce(F.nullif(F.concat_ws(" / ", "repository", "branch"), F.lit("")), F.lit("no repository recorded"))


def day(time: Column) -> Column:
    return F.coalesce(F.date_format(time, "yyyy-MM-dd"), F.lit("unknown date"))


def git_precedence(observed: Column, stored: Column, recorded: Column) -> Column:
    """Of three structs of Git facts: the live one if it has a root, else the stored, else the recorded."""
    return F.when(observed["root"].isNotNull(), observed).otherwise(F.coalesce(stored, recorded))


def served_sessions(lines: DataFrame) -> DataFrame:
    """`agent, native_id` that running commands serve, from their command `line`s; each once.

    `--session-id ID` and `--resume ID` (or a path ending in `ID.jsonl`) name sessions of the one
    agent, `resume ID` of the other where a part of the line is its command.
    """
    words = lines.select(F.split(F.trim("line"), r"\s+").alias("w"))
    pairs = words.select("w", F.posexplode("w").alias("i", "flag")).withColumn("value", F.try_element_at("w", F.col("i") + 2))
    base = F.regexp_replace(F.regexp_replace("value", r"^.*/", ""), r"\.jsonl$", "")
    codex = F.exists("w", lambda x: F.regexp_replace(x, r"^.*/", "") == "codex")
    agent = F.when(F.col("flag").isin("--session-id", "--resume"), 0).when((F.col("flag") == "resume") & codex, 1)
    plain = F.when(F.col("flag") == "--resume", base).otherwise(F.col("value"))
    return pairs.select(agent.alias("agent"), plain.alias("native_id")).filter(F.col("agent").isNotNull() & is_uuid(F.col("native_id"))).distinct()


def live_priorities(sessions: DataFrame, agents: DataFrame, served: DataFrame) -> DataFrame:
    """`agent, native_id, grp` of live sessions: the group of the one host agent of its id, else running.

    `agents` (`session_id, state`) are a host's; a session that several of them claim has none.
    An unknown state takes no group. `served` is the result of `served_sessions`.
    """
    states = F.create_map(*[F.lit(x) for i, s in enumerate(STATES) for x in (s, i)])
    sole = agents.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.first("state").alias("state")).filter("n = 1")
    claimed = sole.select(F.col("session_id").alias("native_id"), F.try_element_at(states, F.lower("state")).alias("grp"))
    running = served.select("agent", "native_id", F.lit(STATES.index("running")).alias("served"))
    keys = sessions.select("agent", "native_id").distinct()
    joined = keys.join(claimed, "native_id", "left").join(running, ["agent", "native_id"], "left")
    return joined.select("agent", "native_id", F.coalesce("grp", "served").alias("grp")).filter("grp is not null")


def observe(cwd: str, timeout: float = 10.0) -> dict[str, str | None]:
    """What Git says of a folder now: `root, worktree, branch, commit, url`; nulls where it says nothing."""
    env = {k: v for k, v in os.environ.items() if k not in GIT_VARIABLES}

    def ask(*args: str) -> str | None:
        try:
            done = subprocess.run(["git", "-C", cwd, *args], env=env, capture_output=True, text=True, timeout=timeout)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return done.stdout.strip() or None if done.returncode == 0 else None

    tree = ask("rev-parse", "--show-toplevel")
    common = ask("rev-parse", "--path-format=absolute", "--git-common-dir")
    branch = ask("symbolic-ref", "--short", "-q", "HEAD")
    root = os.path.dirname(common) if common and common.endswith("/.git") else tree
    return {
        "root": root if tree else None,
        "worktree": tree if tree and tree != root else None,
        "branch": branch,
        "commit": ask("rev-parse", "HEAD"),
        "url": ask("remote", "get-url", "origin"),
    }


def newest_sessions(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """Upsert by (agent, native_id): an arriving row replaces the stored one whole, nulls too."""
    keys = ["agent", "native_id"]
    return stored.join(arriving.select(*keys).distinct(), keys, "left_anti").unionByName(arriving)


_GIT = "root string, worktree string, branch string, commit string, url string"


def git_contexts(sessions: DataFrame, ask: Callable[[str], dict] = observe) -> DataFrame:
    """`cwd, live`: what `ask` says of each folder of `sessions`, asked once a folder, in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([(x.split()[0], pa.string()) for x in _GIT.split(", ")])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ask(c) for c in batch.column(0).to_pylist()], kind)], ["cwd", "live"])

    return sessions.select("cwd").dropna().distinct().mapInArrow(run, f"cwd string, live struct<{_GIT.replace(' string', ':string')}>")


def with_git(sessions: DataFrame, ask: Callable[[str], dict] | None) -> DataFrame:
    """`sessions` with `repository_root, worktree, git_origin` (0 observed, 1 recorded) and `git_observed_at`.

    What Git says now of a session's folder replaces what the transcript recorded, whole, if it
    knows a root there; without `ask` nothing is observed.
    """
    recorded = F.struct(
        F.lit(None).cast("string").alias("root"), F.lit(None).cast("string").alias("worktree"), F.col("branch"), F.col("commit_hash").alias("commit"), F.col("repository_url").alias("url")
    )
    known = F.coalesce("branch", "commit_hash", "repository_url").isNotNull()
    seen = sessions.withColumn("live", F.lit(None).cast(f"struct<{_GIT.replace(' string', ':string')}>")) if ask is None else sessions.join(git_contexts(sessions, ask), "cwd", "left")
    is_live = F.coalesce(F.col("live.root").isNotNull(), F.lit(False))
    g = git_precedence(F.col("live"), F.lit(None).cast(f"struct<{_GIT.replace(' string', ':string')}>"), recorded)
    done = seen.withColumn("g", g)
    rest = [c for c in sessions.columns if c not in ("branch", "commit_hash", "repository_url")]
    return done.select(
        *rest, F.col("g.branch").alias("branch"), F.col("g.commit").alias("commit_hash"), F.col("g.url").alias("repository_url"), F.col("g.root").alias("repository_root"), F.col("g.worktree").alias("worktree"),
        F.when(is_live, 0).when(known, 1).alias("git_origin"), F.when(is_live, F.current_timestamp()).alias("git_observed_at"), F.lit(None).cast("timestamp").alias("ended_at"),
    )
