"""Which sessions a terminal host shows running: its wire records as rows, and small joins that trust only a single match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scrollmill.operators.enrich import is_uuid, resume_name

# The agents that a host may report, by their number.
AGENTS = ("claude", "codex")
_WIRE = (
    "result struct<agents:array<struct<workspace_id:string,pane_id:string,agent:string,name:string,cwd:string,"
    "agent_session:struct<source:string,agent:string,kind:string,value:string>>>>"
)


def agents_of(answers: DataFrame, host: str, answer: str = "answer") -> DataFrame:
    """`id, workspace_id, agent, session_id, name, cwd` of the agents in a host's JSON answers.

    Agents of other kinds are dropped. A session id counts only if its source is the host's own for
    this agent, its agent is the same and it is an id; else it is null. An answer that can't be read
    has no agents.
    """
    a = F.col("a")
    session = a["agent_session"]
    agrees = (session["source"] == F.concat(F.lit(f"{host}:"), a["agent"])) & (session["agent"] == a["agent"]) & (session["kind"] == "id")
    read = answers.select(F.explode(F.from_json(answer, _WIRE)["result"]["agents"]).alias("a"))
    return read.filter(a["agent"].isin(*AGENTS)).select(
        a["pane_id"].alias("id"), a["workspace_id"].alias("workspace_id"), F.when(a["agent"] == AGENTS[0], 0).otherwise(1).alias("agent"),
        F.when(agrees, session["value"]).alias("session_id"), a["name"].alias("name"), a["cwd"].alias("cwd"),
    )


def workspaces_of(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """`workspace_id, cwd, place` of the workspaces in a host's JSON answers, in their order; without a folder they are dropped."""
    wire = "result struct<workspaces:array<struct<workspace_id:string,cwd:string>>>"
    read = answers.select(F.posexplode(F.from_json(answer, wire)["result"]["workspaces"]).alias("place", "w"))
    return read.select("w.workspace_id", "w.cwd", "place").dropna()


def states_of(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """`session_id, state` of the agents in another kind of host's JSON list of blocks; both in small letters, null ids dropped."""
    wire = "array<struct<session_id:string,block_id:string,claude_session_id:string,cwd:string,state:string>>"
    read = answers.select(F.explode(F.from_json(answer, wire)).alias("b"))
    return read.select(F.lower("b.claude_session_id").alias("session_id"), F.lower("b.state").alias("state")).filter("session_id is not null")


def _in_workspace(sessions: DataFrame, workspaces: DataFrame, agents: DataFrame) -> DataFrame:
    """Each session with the agents of its kind in the workspace (the first by place) open at its folder."""
    first = workspaces.groupBy(F.col("cwd").alias("w_cwd")).agg(F.min_by("workspace_id", "place").alias("workspace_id"))
    keys = sessions.select("agent", "native_id", "cwd").distinct()
    placed = keys.join(first, keys["cwd"] == first["w_cwd"]).drop("w_cwd")
    live = agents.select(F.col("agent"), "workspace_id", F.col("id"), F.col("session_id"), F.col("name"), F.col("cwd").alias("a_cwd"))
    return placed.join(live, ["agent", "workspace_id"])


def matching(sessions: DataFrame, workspaces: DataFrame, agents: DataFrame) -> DataFrame:
    """`agent, native_id, id`: sessions that exactly one live agent shows, and that agent.

    `workspaces` has `workspace_id, cwd, place`. An agent shows a session if it reports its id, or
    reports none and bears the name under which the session would be resumed.
    """
    rows = _in_workspace(sessions, workspaces, agents).filter(is_uuid(F.col("native_id")))
    shown = rows.filter(F.when(F.col("session_id").isNotNull(), F.col("session_id") == F.col("native_id")).otherwise(F.col("name") == resume_name(F.col("native_id"))))
    return _sole(shown)


def sole_in_folder(sessions: DataFrame, workspaces: DataFrame, agents: DataFrame) -> DataFrame:
    """`agent, native_id, id`: sessions in whose folder exactly one agent of their kind runs, and that agent."""
    return _sole(_in_workspace(sessions, workspaces, agents).filter(F.col("a_cwd") == F.col("cwd")))


def _sole(rows: DataFrame) -> DataFrame:
    # one row of two is as good as none: they name no agent in particular
    return rows.groupBy("agent", "native_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).filter("n = 1").drop("n")


def live_sessions(sessions: DataFrame, workspaces: DataFrame, agents: DataFrame, served: DataFrame) -> DataFrame:
    """`agent, native_id, grp` of the sessions that run: served by a process, or shown by exactly one agent; one group."""
    known = sessions.select("agent", "native_id").distinct()
    shown = matching(sessions, workspaces, agents).select("agent", "native_id")
    return known.join(shown.unionByName(served.select("agent", "native_id")).distinct(), ["agent", "native_id"], "left_semi").withColumn("grp", F.lit(0))


def notice(outcome: Column, agent: Column, repository: Column) -> Column:
    """What a reader is told after asking to resume: `focused`, `started` or `running` (elsewhere, so nothing was started)."""
    name = F.when(agent == 0, "Claude").otherwise("Codex")
    verb = F.when(outcome == "focused", "Opened running").otherwise("Resumed")
    elsewhere = F.concat(F.lit("This "), name, F.lit(" session is already running on this machine; showing it here instead of starting a second one"))
    return F.when(outcome == "running", elsewhere).otherwise(F.concat(verb, F.lit(" "), name, F.lit(" session"), F.coalesce(F.concat(F.lit(" in "), repository), F.lit(""))))
