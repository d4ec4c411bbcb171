"""Queries over the driver's tables for the operators of this package, and SQL to check them by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scrollmill.llm import conversations, leaks, mix, pii, split, truncation
from scrollmill.operators import adapters
from scrollmill.session import cut, table


def p2_pieces(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    return split.split_oversized(split.items_of(t("search_chunks"), t("indexed_files"), t("raw_records"), t("size_limits")), with_text)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversized items: those that the splitter cut into more than one piece."""
    pieces = p2_pieces(spark, sf_dir, with_text=False)
    return pieces.filter("piece_no = 0 and n_pieces > 1").select("item_table", "item_id")


def p2_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the pieces of each oversized item keep to its limit, overlap as stated, and give the item back."""
    limits = table(spark, sf_dir, "size_limits").select("item_table", "max_bytes", "overlap_bytes")
    whole = split.rejoined(p2_pieces(spark, sf_dir)).join(F.broadcast(limits), "item_table")
    # an overlap is short of what is stated by less than one character
    return whole.select(
        "item_table", "item_id", "digest", (F.col("n_most") <= F.col("max_bytes")).alias("fits"), (F.col("n_pieces") > 1).alias("is_cut"),
        (F.col("n_overlap") * 4 > F.col("overlap_bytes") - 4).alias("overlaps"),
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = pii.items_of(table(spark, sf_dir, "normalized_events"), table(spark, sf_dir, "search_chunks"))
    found = pii.spans(items, table(spark, sf_dir, "person_lexicon"))
    return found.select("item_table", "item_id", "pii_type", "start_char")


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = pii.items_of(table(spark, sf_dir, "normalized_events"), table(spark, sf_dir, "search_chunks"))
    return pii.redacted(items, table(spark, sf_dir, "person_lexicon"))


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the terms in name frames disclose, in bits, and whether that is above the thresholds."""
    items = pii.items_of(table(spark, sf_dir, "normalized_events"), table(spark, sf_dir, "search_chunks"))
    told = pii.disclosure(cut(pii.scan(items, table(spark, sf_dir, "person_lexicon"))))
    return told.withColumn("discloses", (F.col("share") >= pii.LEAST_SHARE) & (F.col("bits") >= pii.LEAST_BITS))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversations.sessions(table(spark, sf_dir, "message_rows"))
    return found.filter("reason is not null").select("agent", "session_id", "reason")


def p4_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations.rebuild(table(spark, sf_dir, "message_rows"))
    return turns.select("agent", "session_id", "turn", "role", "message_id")


def p4_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threads of the records that carry pointers, with orphans and cycles among them."""
    parsed = adapters.parse(table(spark, sf_dir, "raw_records"))
    text = lambda key: adapters.string(F.col("v"), f"$.{key}")
    return conversations.threads(parsed.select(text("uuid").alias("node"), text("parentUuid").alias("parent")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each leaked item is in, and the most of its own words that one holds."""
    found = leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("share").alias("most"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix.Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return spark.createDataFrame([(s,) for s in plan.unmet()], "source string")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).shares()


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).selection()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents")).filter("is_cut").select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.rates(truncation.truncated(table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_pieces, p2_rejoined, p3_found, p3_redacted, p3_terms, p4_found, p4_turns, p4_threads, p6_found, p6_items, p7_found, p7_shares, p7_selection, p8_found, p8_rates)
}

_MESSAGES = r"""
with plain as (
    select agent, session_id, ordinal, lower(trim(type)) as kind, trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) as body,
        coalesce(regexp_matches(text, '[^\s\p{Z}\p{Cc}\p{Cf}]'), false) as seen, "timestamp" as tm, message_id
    from message_rows
), message as (
    select agent, session_id, ordinal, kind, body,
        max(case when not seen then 0 when kind = 'user' then 1 when kind = 'assistant' then 2 else 0 end) as said,
        min(tm) as tm, min(message_id) as message_id
    from plain group by all
), spoken as (
    select agent, session_id, message_id, said, lead(said) over w as next_said, row_number() over w - 1 as turn
    from message where said > 0
    window w as (partition by agent, session_id order by ordinal nulls first, tm nulls first, message_id)
), turns as (
    select agent, session_id, min(case when turn = 0 then said end) as began,
        max(case when said = 1 and coalesce(next_said, 1) = 1 then 1 else 0 end) as no_reply
    from spoken group by all
), session as (
    select agent, session_id, count(*) as n, count(ordinal) as n_ordinals, count(distinct ordinal) as n_distinct,
        min(ordinal) as least, max(ordinal) as most, max(said) as said
    from message group by all
), verdict as (
    select session.agent, session.session_id,
        case when said = 0 then 'empty'
            when (n_ordinals > 0 and (n_ordinals <> n or n_distinct <> n or least <> 0 or most <> n - 1)) or began = 2 then 'broken'
            when no_reply = 1 then 'no_reply' end as reason
    from session left join turns on session.agent = turns.agent and session.session_id = turns.session_id
)
"""

ORACLE = {
    "p2_found": """
        select 'search_chunks' as item_table, chunk_id as item_id from search_chunks
        where strlen(text) > (select max_bytes from size_limits where item_table = 'search_chunks')
        union all
        select 'indexed_files', file_id from indexed_files
        where strlen(json_extract_string(nullif(open_turn_state, ''), '$.pending.text'))
            > (select max_bytes from size_limits where item_table = 'indexed_files')
        union all
        select 'raw_records', record_id from raw_records
        where strlen(line) > (select max_bytes from size_limits where item_table = 'raw_records')
    """,
    "p2_rejoined": """
        with item as (
            select 'search_chunks' as item_table, chunk_id as item_id, text from search_chunks
            union all select 'indexed_files', file_id, json_extract_string(nullif(open_turn_state, ''), '$.pending.text') from indexed_files
            union all select 'raw_records', record_id, line from raw_records
        )
        select item.item_table, item_id, md5(text) as digest, true as fits, true as is_cut, true as overlaps
        from item join size_limits on item.item_table = size_limits.item_table where strlen(text) > max_bytes""",
    "p4_found": _MESSAGES + "select agent, session_id, reason from verdict where reason is not null",
    "p4_turns": _MESSAGES
    + """select s.agent, s.session_id, s.turn, case s.said when 1 then 'user' else 'assistant' end as role, s.message_id
        from spoken s join verdict v on s.agent = v.agent and s.session_id = v.session_id where v.reason is null""",
    "p4_threads": r"""
        with recursive good as (
            select line from raw_records
            where json_valid(line) and not regexp_matches(line, ',\s*\}\s*$') and not regexp_matches(line, ',\s*\]\s*\}+\s*$')
        ), named as (
            select case when json_type(line, '$.uuid') = 'VARCHAR' then json_extract_string(line, '$.uuid') end as node,
                case when json_type(line, '$.parentUuid') = 'VARCHAR' then json_extract_string(line, '$.parentUuid') end as parent
            from good where json_type(line) = 'OBJECT'
        ), known as (select node, min(parent) as parent from named where node is not null group by node),
        walk as (
            select k.node, k.node as root, 0::bigint as depth, case when k.parent is null then 'ok' else 'orphan' end as state
            from known k where k.parent is null or k.parent not in (select node from known)
            union all
            select k.node, w.root, w.depth + 1, w.state from known k join walk w on k.parent = w.node
        )
        select root, state, count(*) as n_nodes, max(depth) as longest from walk group by root, state
        union all
        select null, 'cycle', count(*), null from known where node not in (select node from walk) having count(*) > 0""",
}
