"""Queries for full-text search, ingestion and enrichment over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scrollmill.functions.tokens import clean_controls, clean_terminal
from scrollmill.operators import adapters, chunks, enrich, hosts, postings, search
from scrollmill.plans.query_language import expression
from scrollmill.plans import ingest
from scrollmill.session import local_path, shared_folder, table
from scrollmill.sources import jsonl
from scrollmill.sources.store import Store

# What the search queries ask for.
TYPED = {
    "search_term": "watermark",
    "search_and": "watermark AND ledger",
    "search_implicit_and": "stale lock zephyr",
    "search_or": "checksum OR mismatch",
    "search_not": "retry NOT buffer",
    "search_mixed": "snapshot AND cursor OR harbor NOT token",
    "search_phrase": '"connection reset"',
    "search_prefix": "finger*",
    "search_phrase_prefix": '"borrow of mov"*',
    "search_punctuated": "cursor-map",
    "search_user": "rebuilt",
    "search_assistant": "rebuilt",
}
ROLES = {"search_user": 0, "search_assistant": 1}
MISSPELLED = "manfest jagged"



_indexes: dict[tuple, postings.Index] = {}


def index(spark: SparkSession, sf_dir: str) -> postings.Index:
    """The index of the chunks under `sf_dir`: built once a session, and anew if the table's files or their size changed."""
    chunks_ = table(spark, sf_dir, "search_chunks")
    size = int(chunks_._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    key = (spark.sparkContext.applicationId, sf_dir, size, *sorted(chunks_.inputFiles()))
    if key not in _indexes:
        _indexes[key] = postings.build(chunks_, shared_folder(spark, "index"))
    return _indexes[key]


def _hits(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = search.hits(index(spark, sf_dir), expression(TYPED[name]), ROLES.get(name))
        return found.select("chunk_id", F.round("score", 6).alias("score"))

    run.__name__ = name
    return run


def search_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.search(index(spark, sf_dir), "watermark ledger", limit=50)
    return out.results.select("chunk_id", F.round("score", 6).alias("score"))


def search_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.search(index(spark, sf_dir), MISSPELLED, limit=1000)
    return out.results.select("chunk_id", F.round("score", 6).alias("score"))


def _priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group for every session whose branch is main: by the length of its folder's path."""
    known = table(spark, sf_dir, "sessions").filter("branch = 'main'")
    return known.select("agent", "native_id", (F.length("cwd") % 5).cast("int").alias("grp")).filter("grp is not null")


def search_prioritized(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.search(index(spark, sf_dir), "watermark", limit=200, priorities=_priorities(spark, sf_dir))
    return out.results.select("place", "chunk_id", "grp")


def search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command line prints for a search: joined with sessions, snippets, marks."""
    out = search.search(index(spark, sf_dir), "broken pipe", limit=50)
    results = index(spark, sf_dir).with_chunks(out.results)
    known = search.with_sessions(results, table(spark, sf_dir, "sessions"))
    return search.output_lines(search.with_snippets(known, expression("broken pipe")))


def search_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.search(index(spark, sf_dir), "stack overfl*", limit=50)
    marked = search.with_ranges(search.with_snippets(index(spark, sf_dir).with_chunks(out.results), expression("stack overfl*")), ["stack", "overfl*"])
    return marked.select("chunk_id", "snippet", F.to_json("marks").alias("marks"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vocabulary(index(spark, sf_dir))


def near_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = search.vocabulary(index(spark, sf_dir))
    found = search.near_words(terms, "ledgr") or []
    return spark.createDataFrame([(i, w) for i, w in enumerate(found)], "place int, term string")


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(t)) for t in ("indexed_files", "sessions", "search_chunks")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def sessions_by_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sessions").groupBy("agent").agg(F.count(F.lit(1)).alias("n"))


def top_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "search_chunks").groupBy("agent", "native_id").agg(F.count(F.lit(1)).alias("n"))
    return per.orderBy(F.col("n").desc(), "agent", "native_id").limit(20)


def next_file_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "indexed_files").agg((F.coalesce(F.max("file_id"), F.lit(0)) + 1).alias("next_id"))


def file_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The committed files classified against themselves as listed: settled, or to be read on."""
    files = table(spark, sf_dir, "indexed_files")
    listing = files.select("path", "dev", "ino", "ctime", "ctime_nsec", "size", "modified")
    return jsonl.classify(listing, files).select("path", "action", "committed_offset", "generation")


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The committed files against a listing made later: some grew, some were replaced, some are new, some are gone."""
    files = table(spark, sf_dir, "indexed_files")
    turn = F.col("file_id") % 7
    listing = files.filter(turn != 6).select(
        F.when(turn == 0, F.concat("path", F.lit(".new"))).otherwise(F.col("path")).alias("path"), "dev", F.when(turn == 1, F.col("ino") + 1).otherwise(F.col("ino")).alias("ino"),
        F.when(turn == 2, F.col("ctime") + 5).otherwise(F.col("ctime")).alias("ctime"), "ctime_nsec",
        F.when(turn == 2, F.col("size") + 100).when(turn == 3, F.col("size") - 1).otherwise(F.col("size")).alias("size"), "modified",
    )
    return jsonl.classify(listing, files).select("path", "action", "committed_offset", "generation")


def complete_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "indexed_files").dropna(subset=["dev", "ino", "ctime", "ctime_nsec", "checkpoint_format"]).select("path", "file_id")


def transcript_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = adapters.events(table(spark, sf_dir, "raw_records"))
    return found.select("record_id", "agent", "kind", F.md5(F.col("text").cast("binary")).alias("digest"))


def transcript_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = adapters.session_facts(table(spark, sf_dir, "raw_records"))
    return facts.withColumn("started_at", F.unix_micros("started_at"))


def event_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.fold(table(spark, sf_dir, "normalized_events"))


def event_chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunks.fold(table(spark, sf_dir, "normalized_events"))
    return made.select("agent", "source_file_id", "source_generation", "ordinal", "kind", F.md5(F.col("text").cast("binary")).alias("digest"))


def ingested_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw records written as transcript files, ingested in two scans, and the chunks of the store.

    The second scan finds every file longer by its later half of records, so open turns go on.
    """
    folder = local_path(shared_folder(spark, "transcripts"))
    lines = table(spark, sf_dir, "raw_records").groupBy("file_id", "byte_start").agg(F.first("agent").alias("agent"), F.first("line").alias("line"))
    lines = lines.select("file_id", "agent", "byte_start", F.coalesce("line", F.lit("")).alias("line"))
    store = Store(spark, f"{folder}/store")
    for later in (False, True):
        ingest.write_transcripts(lines.filter((F.pmod("byte_start", F.lit(1 << 40)) >= F.lit(20_000)) == later), folder)
        ingest.ingest(store, {a: [f"{folder}/agent-{a}"] for a in (0, 1)})
    found = ingest.live(store, store.read("chunks"))
    name = F.regexp_extract("source_path", r"(\d+)\.jsonl$", 1).cast("bigint")
    return found.select("agent", name.alias("file_id"), "ordinal", "kind", F.md5(F.col("text").cast("binary")).alias("digest"))


def open_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns that are open in the committed files, and whether their states are valid."""
    files = table(spark, sf_dir, "indexed_files").select(
        F.lit(0).alias("agent"), F.col("file_id").alias("source_file_id"), F.col("generation").alias("source_generation"), F.col("path").alias("source_path"), "open_turn_state"
    )
    found = chunks.restored(files)
    return found.select("source_file_id", "next_ordinal", "is_valid", "native_id", "kind", "source_start", "source_end", F.octet_length("text").alias("n_bytes"))


def session_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "sessions")
    return known.select(
        "agent", "native_id", "source_file_id", enrich.context_label().alias("context"), enrich.day(F.col("started_at")).alias("day"),
        F.when(F.col("agent") == 0, "claude").otherwise("codex").alias("agent_name"), adapters.repository_label(F.col("repository_url")).alias("label"),
        enrich.is_clean_path(F.col("cwd")).alias("clean"), enrich.is_full_commit(F.col("commit_hash")).alias("full_commit"), enrich.is_uuid(F.col("native_id")).alias("uuid"),
    )


def session_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "sessions")
    probed = known.select(F.explode(F.array("cwd", "repository_root", "worktree")).alias("path")).dropna().distinct()
    paths = probed.select("path", F.when(F.length("path") % 3 == 0, "Directory").when(F.length("path") % 3 == 1, "File").otherwise("Missing").alias("state"))
    out = enrich.recovery_options(known, paths)
    return out.select("agent", "native_id", "source_file_id", "availability", F.array_join("options", ",").alias("options"))


def resume_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "sessions")
    return known.select("agent", "native_id", F.array_join(enrich.resume_argv(), " ").alias("argv")).distinct()


def resume_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sessions").select("native_id", enrich.resume_name(F.col("native_id")).alias("name")).distinct()


def _host(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions, and a host that has a workspace at some of their folders and agents in some of these."""
    known = table(spark, sf_dir, "sessions")
    folders = known.select("cwd").dropna().distinct().filter(F.length("cwd") % 4 != 0)
    workspaces = folders.select(F.md5(F.col("cwd").cast("binary")).alias("workspace_id"), "cwd", F.lit(0).alias("place"))
    turn = F.col("source_file_id") % 5
    agents = known.filter(turn < 3).select(
        F.concat("native_id", F.lit(":"), "source_file_id").alias("id"), F.md5(F.col("cwd").cast("binary")).alias("workspace_id"), "agent",
        F.when(turn == 0, F.col("native_id")).alias("session_id"), F.when(turn == 1, enrich.resume_name(F.col("native_id"))).alias("name"), "cwd",
    )
    return known, workspaces, agents


def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, workspaces, agents = _host(spark, sf_dir)
    return hosts.matching(known, workspaces, agents)


def sole_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, workspaces, agents = _host(spark, sf_dir)
    return hosts.sole_in_folder(known, workspaces, agents)


def sessions_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sessions").select("native_id", "agent", "source_file_id", "cwd").orderBy("native_id", "agent", "source_file_id")


def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(clean_controls(F.col("text")).cast("binary")).alias("report"), F.md5(clean_terminal(F.col("text")).cast("binary")).alias("terminal"))


def newest_session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions after an upsert of each key's row of the latest generation and byte."""
    known = table(spark, sf_dir, "sessions").withColumn("version", F.struct("source_generation", "source_end", "source_file_id"))
    rows = known.groupBy("agent", "native_id").agg(F.count(F.lit(1)).alias("n_rows"))
    keys = ["agent", "native_id"]
    newest = ingest.newest(known, keys).withColumnsRenamed({k: f"_{k}" for k in keys})
    return rows.join(newest, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).select(*keys, F.col("source_file_id").alias("file"), "n_rows")


_TOKENS = r"coalesce(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}\p{M}\p{Co}]+'), [])"


# What each typed text asks for, written out by hand: its phrases (`*` for a prefix), when a
# row is a hit, and for each phrase when it counts. The library's parser has no part in it.
_ASKED = {
    "search_term": (["watermark"], "tf0 > 0", ["true"]),
    "search_and": (["watermark", "ledger"], "tf0 > 0 and tf1 > 0", ["true", "true"]),
    "search_implicit_and": (["stale", "lock", "zephyr"], "tf0 > 0 and tf1 > 0 and tf2 > 0", ["true", "true", "true"]),
    "search_or": (["checksum", "mismatch"], "tf0 > 0 or tf1 > 0", ["true", "true"]),
    "search_not": (["retry", "buffer"], "tf0 > 0 and tf1 = 0", ["true", "true"]),
    "search_mixed": (["snapshot", "cursor", "harbor", "token"], "(tf0 > 0 and tf1 > 0) or (tf2 > 0 and tf3 = 0)", ["tf0 > 0 and tf1 > 0", "tf0 > 0 and tf1 > 0", "tf2 > 0 and tf3 = 0", "tf2 > 0 and tf3 = 0"]),
    "search_phrase": (["connection reset"], "tf0 > 0", ["true"]),
    "search_prefix": (["finger*"], "tf0 > 0", ["true"]),
    "search_phrase_prefix": (["borrow of mov*"], "tf0 > 0", ["true"]),
    "search_punctuated": (["cursor map"], "tf0 > 0", ["true"]),
    "search_user": (["rebuilt"], "tf0 > 0", ["true"]),
    "search_assistant": (["rebuilt"], "tf0 > 0", ["true"]),
    "search_top": (["watermark", "ledger"], "tf0 > 0 and tf1 > 0", ["true", "true"]),
    "search_fallback": (["manfest*", "manifest", "manifests", "jagged"], "(tf0 > 0 or tf1 > 0 or tf2 > 0) and tf3 > 0", ["true"] * 4),
    "search_prioritized": (["watermark"], "tf0 > 0", ["true"]),
}


def _tf_sql(phrase: str) -> str:
    words = phrase.removesuffix("*").split()
    fits = lambda x, k: f"starts_with({x}, '{words[k]}')" if phrase.endswith("*") and k == len(words) - 1 else f"{x} = '{words[k]}'"
    if len(words) == 1:
        return f"len(list_filter(toks, lambda x: {fits('x', 0)}))"
    tests = " and ".join(fits(f"toks[i + {k}]", k) for k in range(len(words)))
    return f"len(list_filter(range(1, len(toks) - {len(words) - 2}), lambda i: {tests}))"


def hits_sql(name: str) -> str:
    """SQL for the hits of a search: tokens, statistics over all rows, score."""
    asked, match, gates = _ASKED[name]
    counts = ", ".join(f"{_tf_sql(p)} as tf{i}" for i, p in enumerate(asked))
    having = ", ".join(f"sum(case when tf{i} > 0 then 1 else 0 end) as h{i}" for i in range(len(asked)))
    idf = lambda i: f"case when h{i} < n_rows or h{i} = 0 then greatest(ln((n_rows - h{i} + 0.5) / (h{i} + 0.5)), 1e-6) else 1e-6 end"
    norm = "(0.3 + len(toks) * (0.9 * n_rows / n_tokens))"
    tf = [f"(case when {gate} then tf{i} else 0 end)" for i, gate in enumerate(gates)]
    score = " + ".join(f"{x} * (({idf(i)}) * 2.2) / ({x} + {norm})" for i, x in enumerate(tf))
    role = f" and kind = {ROLES[name]}" if name in ROLES else ""
    return f"""
        with tokenized as (select *, {_TOKENS} as toks from search_chunks),
        counted as (select *, {counts} from tokenized),
        stats as (select count(*) as n_rows, sum(len(toks)) as n_tokens, {having} from counted),
        hit as (select counted.*, -({score}) as score from counted, stats where ({match}){role})
    """


# Records as text to JSON values, in the order in which the formats look for them. This reader of JSON lets a
# comma pass before a closing brace, so such lines are left out first.
_RECORDS = r"""
    with good as (
        select *, json_type(line) = 'OBJECT' as is_object from raw_records
        where json_valid(line) and strlen(line) <= 4194304 and not regexp_matches(line, ',\s*\}\s*$') and not regexp_matches(line, ',\s*\]\s*\}+\s*$')
    ), part as (
        select *, case when agent <> 0 and json_exists(line, '$.payload') then json_extract(line, '$.payload') else line::json end as p,
            case when json_exists(line, '$.message') then json_extract(line, '$.message') else line::json end as m from good
    )
"""
_EVENTS = _RECORDS + r""", spoken as (
        select *, case when json_type(line, '$.type') = 'VARCHAR' then json_extract_string(line, '$.type') end as type,
            case when agent = 0 then case when json_exists(m, '$.content') then json_extract(m, '$.content') else m end
                when json_exists(p, '$.content') then json_extract(p, '$.content') else json_extract(line, '$.content') end as c,
            case when json_exists(line, '$.isMeta') then json_extract(line, '$.isMeta') else json_extract(line, '$.is_meta') end as meta,
            case when json_exists(line, '$.role') then json_extract(line, '$.role') else json_extract(p, '$.role') end as r,
            case when json_exists(p, '$.channel') then json_extract(p, '$.channel') else json_extract(line, '$.channel') end as ch,
            case when json_exists(p, '$.recipient') then json_extract(p, '$.recipient') else json_extract(line, '$.recipient') end as rc
        from part
    ), block as (
        select *, case when json_type(c) = 'ARRAY' then json_extract(c, '$[*]') end as b,
            case when json_type(r) = 'VARCHAR' then r->>'$' end as role, case when json_type(ch) = 'VARCHAR' then ch->>'$' end as channel,
            case when json_type(rc) = 'VARCHAR' then rc->>'$' end as recipient
        from spoken
    ), told as (
        select *, case when b is not null
                then nullif(array_to_string(list_transform(list_filter(b, lambda x: json_type(x, '$.type') = 'VARCHAR' and json_extract_string(x, '$.type') in ('text', 'input_text', 'output_text')
                    and json_type(x, '$.text') = 'VARCHAR'), lambda x: json_extract_string(x, '$.text')), chr(10)), '')
                when json_type(c) = 'VARCHAR' then c->>'$' end as said,
            coalesce(len(b) > 0 and len(list_filter(b, lambda x: not coalesce(json_type(x, '$.type') = 'VARCHAR' and json_extract_string(x, '$.type') = 'tool_result', false))) = 0, false) as tools
        from block
    ), heard as (
        select record_id, agent, said, case
            when agent = 0 and type in ('user', 'assistant') and coalesce(meta::varchar, '') <> 'true' and not (type = 'user' and tools) then type
            when agent = 1 and (type = 'message' or (type = 'response_item' and json_type(p, '$.type') = 'VARCHAR' and json_extract_string(p, '$.type') = 'message')) and role in ('user', 'assistant')
                and (role = 'user' or (coalesce(channel, 'final') in ('final', 'commentary') and coalesce(recipient, 'all') = 'all')) then role end as speaker
        from told
    )
"""
_TEXT = lambda at: f"case when json_type({at[0]}, '{at[1]}') = 'VARCHAR' then json_extract_string({at[0]}, '{at[1]}') end"
_EITHER = lambda a, b: f"case when json_exists(line, '{a}') then {_TEXT(('line', a))} else {_TEXT(('line', b))} end"
_FULL = lambda x: rf"case when regexp_matches({x}, '[^\s\x0b\x85\p{{Z}}]') then {x} end"
_URL = _FULL(_TEXT(("p", "$.git.repository_url")))
_SESSIONS = _RECORDS + rf""", fact as (
        select file_id, agent, byte_start,
            case when agent = 0 then {_EITHER('$.sessionId', '$.session_id')}
                when {_TEXT(('line', '$.type'))} = 'session_meta' then coalesce({_TEXT(('p', '$.id'))}, {_TEXT(('line', '$.session_id'))}) end as native_id,
            case when agent = 0 then {_TEXT(('line', '$.cwd'))} else {_TEXT(('p', '$.cwd'))} end as cwd,
            case when regexp_full_match({_TEXT(('line', '$.timestamp'))}, '\d{{4}}-\d{{2}}-\d{{2}}[Tt ]\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?([Zz]|[+-]\d{{2}}:\d{{2}})')
                then epoch_us(try_cast(upper({_TEXT(('line', '$.timestamp'))}) as timestamptz)) end as us,
            nullif({_FULL('(' + f"case when agent = 0 then {_EITHER('$.gitBranch', '$.git_branch')} else {_TEXT(('p', '$.git.branch'))} end" + ')')}, 'HEAD') as branch,
            case when agent <> 0 then {_FULL('coalesce(' + _TEXT(('p', '$.git.commit_hash')) + ', ' + _TEXT(('p', '$.git.commit')) + ')')} end as commit_hash,
            case when agent <> 0 then {_URL} end as repository_url,
            case when agent = 0 then {_FULL('(' + _EITHER('$.prRepository', '$.pr_repository') + ')')} end as own_repository
        from part where is_object
    ), bare as (select *, regexp_replace(regexp_replace(trim(repository_url), '/+$', ''), '\.git$', '') as u from fact),
    labelled as (
        select *, regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://') as scheme, regexp_matches(u, '^[^/]+:') as colon,
            list_filter(string_split(case when regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://') then regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '')
                when regexp_matches(u, '^[^/]+:') then regexp_replace(u, '^[^/:]*:', '') else u end, '/'), lambda x: x <> '') as parts from bare
    ), whole as (
        select *, coalesce(own_repository, nullif(array_to_string(case when scheme or colon then parts[greatest(1, len(parts) - 1):] else parts[len(parts):] end, '/'), '')) as repository from labelled
    ), kept as (
        select file_id, agent, arg_max(native_id, byte_start) filter (native_id is not null) as native_id, arg_max(cwd, byte_start) filter (cwd is not null) as cwd,
            arg_min(us, byte_start) filter (us >= 0) as started_at, arg_min(branch, byte_start) filter (branch is not null) as branch,
            arg_min(commit_hash, byte_start) filter (commit_hash is not null) as commit_hash, arg_min(repository_url, byte_start) filter (repository_url is not null) as repository_url,
            arg_min(repository, byte_start) filter (repository is not null) as repository from whole group by all
    ), counts as (
        select r.file_id, r.agent, count(*) as n_records, sum(case when g.record_id is null then 1 else 0 end) as n_malformed
        from raw_records r left join good g on r.record_id = g.record_id group by all
    )
    select counts.file_id, counts.agent, native_id, cwd, started_at, branch, commit_hash, repository_url, repository, n_records, n_malformed
    from counts left join kept on counts.file_id = kept.file_id and counts.agent = kept.agent
"""
# Runs of one speaker, folded event by event: a turn that reaches the limit is closed and cut between characters.
_CHUNKS = r"""
    with event as (
        select distinct on (agent, source_file_id, source_generation, native_id, source_start, kind, body) agent, source_file_id as f, source_generation as g, native_id, source_start, kind, body,
            min(source_end) over (partition by agent, source_file_id, source_generation, native_id, source_start, kind, body) as source_end
        from (select *, trim(regexp_replace(text, '[\s\x0b\x85\p{Z}]+', ' ', 'g')) as body from normalized_events where kind in (0, 1)) where body <> ''
    )""" + (_FOLD := r""", marked as (
        select *, case when kind = 1 and lag(kind) over w = 1 and lag(native_id) over w = native_id then 0 else 1 end as begins from event
        window w as (partition by agent, f, g order by source_start, source_end, kind, native_id)
    ), run as (
        select *, sum(begins) over (partition by agent, f, g order by source_start, source_end, kind, native_id rows unbounded preceding) as run from marked
    ), listed as (
        select agent, f, g, run, kind, list({'closed': cast([] as varchar[]), 'turn': body} order by source_start, source_end, native_id) as events from run group by all
    ), folded as (
        select *, list_reduce(events, lambda a, x: case when strlen(concat_ws(chr(10), nullif(a.turn, ''), x.turn)) >= 16384
                then {'closed': list_append(a.closed, concat_ws(chr(10), nullif(a.turn, ''), x.turn)), 'turn': ''}
                else {'closed': a.closed, 'turn': concat_ws(chr(10), nullif(a.turn, ''), x.turn)} end, {'closed': cast([] as varchar[]), 'turn': ''}) as done from listed
    ), turn as (
        select agent, f, g, run, kind, generate_subscripts(done.closed, 1) as place, unnest(done.closed) as body, true as is_full from folded
        union all select agent, f, g, run, kind, 1000000, done.turn, false from folded where done.turn <> ''
    ), cut as (
        select *, case when is_full then list_reduce(list_transform(string_split(body, ''), lambda c: {'ends': cast([] as bigint[]), 'at': 1::bigint, 'size': strlen(c)}),
                lambda a, x: case when a.size + x.size > 16384 then {'ends': list_append(a.ends, a.at), 'at': a.at + 1, 'size': x.size}
                else {'ends': a.ends, 'at': a.at + 1, 'size': a.size + x.size} end).ends else cast([] as bigint[]) end as ends from turn
    ), piece as (
        select agent, f, g, run, kind, place, unnest(range(0, len(ends) + 1)) as k, body, ends from cut
    )
    , made as (
        select agent, f, g, row_number() over (partition by agent, f, g order by run, place, k) - 1 as ordinal, kind,
            md5(substr(body, case when k = 0 then 1 else ends[k] + 1 end, case when k = len(ends) then length(body) else ends[k + 1] - case when k = 0 then 0 else ends[k] end end)) as digest
        from piece
    )
""") + "select agent, f as source_file_id, g as source_generation, ordinal, kind, digest from made"
_INGESTED = (
    _EVENTS
    + rf""", id as (
        select distinct on (file_id, byte_start) file_id, byte_start, case when agent = 0 then {_EITHER('$.sessionId', '$.session_id')}
            when {_TEXT(('line', '$.type'))} = 'session_meta' then coalesce({_TEXT(('p', '$.id'))}, {_TEXT(('line', '$.session_id'))}) end as named from part where is_object
    ), held as (select file_id, byte_start, coalesce(last_value(named ignore nulls) over (partition by file_id order by byte_start rows unbounded preceding), '-') as native_id from id),
    event as (
        select distinct on (g.file_id, g.byte_start) g.agent, g.file_id as f, 0 as g, held.native_id, g.byte_start as source_start, g.byte_start as source_end,
            case speaker when 'user' then 0 else 1 end as kind, trim(regexp_replace(said, '[\s\x0b\x85\p{{Z}}]+', ' ', 'g')) as body
        from heard join good g on heard.record_id = g.record_id join held on held.file_id = g.file_id and held.byte_start = g.byte_start
        where speaker is not null and regexp_matches(said, '[^\s\x0b\x85\p{{Z}}]')
    )""".replace("\\\\", "\\")
    + _FOLD
    + "select agent, f as file_id, ordinal, kind, digest from made"
)
_POWERS = ", ".join(f"{36**k}::uhugeint" for k in range(24, -1, -1))

_SAME_SOURCE = " and ".join(f"x.{c} is not distinct from l.{c}" for c in ("source_path", "source_file_id", "source_generation", "source_start", "source_end"))
_PRIORITIZED = hits_sql("search_prioritized") + f""",
    grps as (select agent, native_id, min(length(cwd) % 5) as grp from sessions where branch = 'main' and cwd is not null group by all order by grp, agent, native_id limit 1000),
    best as (select hit.*, grps.grp, row_number() over (partition by hit.agent, hit.native_id order by score, ordinal, chunk_id) as rn from hit join grps on hit.agent = grps.agent and hit.native_id = grps.native_id),
    lifted as (select * from best where rn = 1 order by grp, score, agent, native_id limit 200),
    rest as (select x.*, null as grp from hit x where not exists (select 1 from lifted l where {_SAME_SOURCE})),
    listed as (select chunk_id, grp, score, agent, native_id, ordinal from lifted union all select chunk_id, grp, score, agent, native_id, ordinal from rest)
    select cast(row_number() over (order by grp is null, grp, score, agent, native_id, ordinal, chunk_id) - 1 as integer) as place, chunk_id, cast(grp as integer) as grp
    from listed qualify place < 200
"""

_CLEAN = "({0} = '/' or (starts_with({0}, '/') and len(list_filter(string_split({0}, '/')[2:], lambda p: p in ('', '.', '..', '.git'))) = 0))"
_TARGET = (
    "coalesce(" + " and ".join(_CLEAN.format(c) for c in ("repository_root", "worktree", "cwd"))
    + " and regexp_full_match(commit_hash, '[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64}') and repository_root <> worktree"
    + " and (cwd = worktree or starts_with(cwd, worktree || '/')), false)"
)
_BARE = r"regexp_replace(regexp_replace(trim(repository_url), '/+$', ''), '\.git$', '')"

# A name under which a session is resumed stands for its id, so that it need not be spelled here.
_HOST = """
    with s as (select distinct agent, native_id, cwd, coalesce(regexp_full_match(native_id, '[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}'), false) as uuid from sessions),
    w as (select distinct md5(cwd) as workspace_id, cwd from sessions where cwd is not null and length(cwd) % 4 <> 0),
    a as (select native_id || ':' || source_file_id as id, md5(cwd) as workspace_id, agent, case when source_file_id % 5 = 0 then native_id end as session_id,
        case when source_file_id % 5 = 1 then native_id end as named, cwd from sessions where source_file_id % 5 < 3)
"""

ORACLE = {name: hits_sql(name) + "select chunk_id, round(score, 6) as score from hit" for name in TYPED} | {
    "search_top": hits_sql("search_top") + "select chunk_id, round(score, 6) as score from hit order by hit.score, agent, native_id, ordinal, chunk_id limit 50",
    "search_fallback": hits_sql("search_fallback")
    + "select chunk_id, round(score, 6) as score from hit order by hit.score, agent, native_id, ordinal, chunk_id limit 1000",
    "search_prioritized": _PRIORITIZED,
    "vocabulary": f"""
        with one as (select chunk_id, unnest({_TOKENS}) as term from search_chunks)
        select term, count(distinct chunk_id) as n_chunks, count(*) as n_occurrences from one group by term""",
    "near_words": f"""
        with one as (select chunk_id, unnest({_TOKENS}) as term from search_chunks),
        terms as (select term, count(distinct chunk_id) as n from one group by term),
        near as (select term, damerau_levenshtein(term, 'ledgr') as d, n from terms
            where (starts_with(term, 'l') or starts_with(term, 'el')) and not starts_with(term, 'ledgr'))
        select cast(row_number() over (order by d, n desc, term) - 1 as integer) as place, term from near where d <= 1 qualify place < 5""",
    "status_counts": " union all ".join(f"select count(*) as n, '{t}' as name from {t}" for t in ("indexed_files", "sessions", "search_chunks")),
    "sessions_by_agent": "select agent, count(*) as n from sessions group by agent",
    "top_sessions": "select agent, native_id, count(*) as n from search_chunks group by all order by n desc, agent, native_id limit 20",
    "next_file_id": "select coalesce(max(file_id), 0) + 1 as next_id from indexed_files",
    "file_actions": """
        select path, case when committed_offset is null then 'new'
            when coalesce(committed_offset = size and checkpoint_format = 2 and dev = dev and ino = ino and ctime = ctime and ctime_nsec = ctime_nsec and size = size and modified = modified, false) then 'settled'
            when coalesce(dev = dev and ino = ino and size >= size and checkpoint_format = 2, false) then 'append' else 'check' end as action, committed_offset, generation
        from indexed_files""",
    "file_changes": """
        with listing as (
            select case when file_id % 7 = 0 then path || '.new' else path end as path, dev, case when file_id % 7 = 1 then ino + 1 else ino end as ino,
                case when file_id % 7 = 2 then ctime + 5 else ctime end as ctime, ctime_nsec, case file_id % 7 when 2 then size + 100 when 3 then size - 1 else size end as size, modified
            from indexed_files where file_id % 7 <> 6
        )
        select l.path, case when f.committed_offset is null then 'new'
            when coalesce(l.dev = f.dev and l.ino = f.ino and l.ctime = f.ctime and l.ctime_nsec = f.ctime_nsec and l.size = f.size and l.modified = f.modified
                and f.committed_offset = l.size and f.checkpoint_format = 2, false) then 'settled'
            when coalesce(l.dev = f.dev and l.ino = f.ino and l.size >= f.size and f.checkpoint_format = 2, false) then 'append' else 'check' end as action, f.committed_offset, f.generation
        from listing l left join indexed_files f on l.path = f.path""",
    "open_turns": """
        with s as (select file_id, open_turn_state as o, json_extract(nullif(open_turn_state, ''), '$.pending') as p, (json_extract(nullif(open_turn_state, ''), '$.next_ordinal'))::bigint as n from indexed_files),
        v as (
            select *, coalesce(o, '') = '' or coalesce(n between 0 and 1000000000 and (p is null or json_type(p) = 'NULL' or coalesce(
                strlen(p->>'$.text') <= 32768 and (p->>'$.start')::bigint <= (p->>'$.end')::bigint and (p->>'$.ordinal')::bigint = n and coalesce((p->>'$.timestamp_millis')::bigint, 0) >= 0
                and (p->>'$.session_id.agent') in ('Claude', 'Codex') and (p->>'$.session_id.native_id') is not null and (p->>'$.kind') in ('User', 'Assistant'), false)), false) as ok from s
        )
        select file_id as source_file_id, coalesce(n, 0) as next_ordinal, ok as is_valid, case when ok then p->>'$.session_id.native_id' end as native_id,
            case when ok then case p->>'$.kind' when 'User' then 0 when 'Assistant' then 1 end end as kind, case when ok then (p->>'$.start')::bigint end as source_start,
            case when ok then (p->>'$.end')::bigint end as source_end, case when ok then strlen(p->>'$.text')::integer end as n_bytes from v""",
    "transcript_events": _EVENTS + r"""
        select record_id, agent, case speaker when 'user' then 0 else 1 end as kind, md5(said) as digest from heard
        where speaker is not null and regexp_matches(said, '[^\s\x0b\x85\p{Z}]')""",
    "transcript_sessions": _SESSIONS,
    "event_chunk_texts": _CHUNKS,
    "ingested_chunks": _INGESTED,
    "resume_names": f"""
        with id as (select distinct native_id, case when regexp_full_match(native_id, '[0-9A-Fa-f]{{8}}(-[0-9A-Fa-f]{{4}}){{3}}-[0-9A-Fa-f]{{12}}') then lower(replace(native_id, '-', '')) end as h from sessions),
        number as (select native_id, case when h is not null then ('0x' || substr(h, 1, 16))::ubigint::uhugeint * 18446744073709551616::uhugeint + ('0x' || substr(h, 17))::ubigint::uhugeint end as n from id)
        select native_id, 'ah-' || array_to_string(list_transform([{_POWERS}], lambda w: substr('0123456789abcdefghijklmnopqrstuvwxyz', ((n // w) % 36)::integer + 1, 1)), '') as name from number""",
    "complete_fingerprints": "select path, file_id from indexed_files where dev is not null and ino is not null and ctime is not null and ctime_nsec is not null and checkpoint_format is not null",
    "session_labels": rf"""
        with s as (select *, {_BARE} as bare from sessions),
        p as (select *, regexp_matches(bare, '^[A-Za-z][A-Za-z0-9+.-]*://') as scheme, regexp_matches(bare, '^[^/]+:') as colon from s),
        q as (select *, list_filter(string_split(case when scheme then regexp_replace(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '') when colon then regexp_replace(bare, '^[^/:]*:', '') else bare end, '/'), lambda x: x <> '') as parts from p)
        select agent, native_id, source_file_id,
            case when repository is not null and branch is not null then repository || ' / ' || branch else coalesce(repository, branch, 'no repository recorded') end as context,
            coalesce(strftime(started_at, '%Y-%m-%d'), 'unknown date') as "day", case when agent = 0 then 'claude' else 'codex' end as agent_name,
            nullif(array_to_string(case when scheme or colon then parts[greatest(1, len(parts) - 1):] else parts[len(parts):] end, '/'), '') as label,
            coalesce({_CLEAN.format('cwd')}, false) as clean, coalesce(regexp_full_match(commit_hash, '[0-9A-Fa-f]{{40}}|[0-9A-Fa-f]{{64}}'), false) as full_commit,
            coalesce(regexp_full_match(native_id, '[0-9A-Fa-f]{{8}}(-[0-9A-Fa-f]{{4}}){{3}}-[0-9A-Fa-f]{{12}}'), false) as uuid
        from q""",
    "session_availability": f"""
        with s as (select *, coalesce({_CLEAN.format('cwd')} and length(cwd) % 3 = 0, false) as d_cwd,
                coalesce({_CLEAN.format('repository_root')} and length(repository_root) % 3 = 0, false) as d_root,
                coalesce({_CLEAN.format('worktree')} and length(worktree) % 3 = 0, false) as d_tree, {_TARGET} as target from sessions),
        o as (select *, concat_ws(',', case when d_tree then 'OpenWorktree' end, case when d_root then 'OpenRepository' end, case when d_root and not d_tree and target then 'RecreateWorktree' end) as options from s)
        select agent, native_id, source_file_id, case when d_cwd then 'OnDisk' when options <> '' then 'Recoverable'
            when coalesce(repository, repository_root, commit_hash, branch) is not null then 'RepositoryKnown' else 'TranscriptOnly' end as availability, options from o""",
    "resume_plans": """
        select distinct agent, native_id, case when regexp_full_match(native_id, '[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}')
            then case when agent = 0 then 'claude --resume ' || native_id when agent = 1 then 'codex resume ' || native_id end end as argv from sessions""",
    "sessions_in_order": "select native_id, agent, source_file_id, cwd from sessions order by native_id, agent, source_file_id",
    "live_sessions": _HOST + """
        select s.agent, s.native_id, min(a.id) as id from s join w on s.cwd = w.cwd join a on a.agent = s.agent and a.workspace_id = w.workspace_id
        where s.uuid and case when a.session_id is not null then a.session_id = s.native_id else a.named = s.native_id end group by all having count(*) = 1""",
    "sole_agents": _HOST + """
        select s.agent, s.native_id, min(a.id) as id from s join w on s.cwd = w.cwd join a on a.agent = s.agent and a.workspace_id = w.workspace_id
        where a.cwd = s.cwd group by all having count(*) = 1""",
    "newest_session_rows": """
        select agent, native_id, arg_max(source_file_id, (source_generation, source_end, source_file_id)) as file, count(*) as n_rows from sessions group by all""",
    "clean_texts": r"""
        select doc_id, md5(regexp_replace(text, '[\x00-\x08\x0b-\x1f\x7f-\x9f]', '�', 'g')) as report,
            md5(regexp_replace(text, '[\x00-\x1f\x7f-\x9f\x{200e}\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}\x{061c}]', ' ', 'g')) as terminal from documents""",
}

QUERIES = {name: _hits(name) for name in TYPED} | {
    f.__name__: f
    for f in (
        search_top, search_fallback, search_prioritized, search_lines, search_marks, vocabulary, near_words, status_counts, sessions_by_agent,
        top_sessions, next_file_id, file_actions, file_changes, complete_fingerprints, transcript_events, transcript_sessions, event_chunks, event_chunk_texts, ingested_chunks, open_turns, session_labels,
        session_availability, resume_plans, resume_names, live_sessions, sole_agents, sessions_in_order, clean_texts, newest_session_rows,
    )
}
