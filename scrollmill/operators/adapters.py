"""Transcript records of two formats into session facts and user or assistant events.

A record is parsed once to a VARIANT and probed by key; no schema is inferred, as content may be
text in one record and an array of blocks in the next. All expressions stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scrollmill.session import once, spread

CLAUDE, CODEX = 0, 1
#: Records above this size are malformed.
MOST_BYTES = 4 << 20
_SHOWN = ("text", "input_text", "output_text")
#: Session facts of a record: the last of the first two counts, of the others the first.
FACTS = ("native_id", "cwd", "at", "branch", "commit_hash", "repository_url", "repository")


def get(v: Column, path: str) -> Column:
    """The value at `path` as a VARIANT; null only where the key is absent."""
    return F.try_variant_get(v, path, "variant")


def is_type(v: Column, name: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(name), F.lit(False))


def string(v: Column, path: str = "$") -> Column:
    """The string at `path`; null for any other type, numbers too."""
    inner = get(v, path)
    return F.when(is_type(inner, "STRING"), F.try_variant_get(inner, "$", "string"))


def boolean(v: Column, path: str) -> Column:
    inner = get(v, path)
    return F.coalesce(F.when(is_type(inner, "BOOLEAN"), F.try_variant_get(inner, "$", "boolean")), F.lit(False))


def non_blank(text: Column) -> Column:
    """`text`, or null where it is only white space; the kept value is not trimmed."""
    return F.when(text.rlike(r"(?U)\S"), text)


def instant(text: Column) -> Column:
    """The time of an RFC 3339 text; null where it can't be read or lies before 1970."""
    formed = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"), text)
    read = F.try_to_timestamp(F.upper(formed))
    return F.when(read >= F.timestamp_seconds(F.lit(0)), read)


def text_of(content: Column, blocks: Column) -> Column:
    """Text of a content value: a string itself, of `blocks` the shown texts by lines, else null.

    `blocks` is the content as an array, null if it is none; it is asked first, as telling the
    type of a large value costs more.
    """
    texts = F.transform(
        F.filter(blocks, lambda b: string(b, "$.type").isin(*_SHOWN) & string(b, "$.text").isNotNull()), lambda b: string(b, "$.text")
    )
    return F.when(blocks.isNotNull(), F.when(F.size(texts) > 0, F.array_join(texts, "\n"))).otherwise(string(content))


def branch_name(text: Column) -> Column:
    kept = non_blank(text)
    return F.when(kept != "HEAD", kept)


def repository_label(url: Column) -> Column:
    """`owner/name` of a remote's address, `name` of a bare path; null where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"/+$", ""), r"\.git$", "")
    scheme = bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    scp = ~scheme & bare.rlike(r"^[^/]+:")
    path = F.when(scheme, F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")).when(scp, F.regexp_replace(bare, r"^[^/:]*:", "")).otherwise(bare)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    keep = F.when(scheme | scp, 2).otherwise(1)
    taken = F.when(F.size(parts) <= keep, parts).otherwise(F.slice(parts, F.size(parts) - keep + 1, keep))
    return F.nullif(F.array_join(taken, "/"), F.lit(""))


def parse(records: DataFrame) -> DataFrame:
    """`records` (agent, line, …) with `v`, the parsed object; null for lines that are no complete JSON object, or oversized.

    The parser reads one value and passes over what follows it, so a line is read as the one element
    of an array, followed by a mark in the array around it: what is left open, closed too early or
    follows is then an error or moves the mark.
    """
    held = F.try_parse_json(F.concat(F.lit("[["), "line", F.lit(f"],{_MARK}]")))
    whole = once(spread(records), "_held", F.when(F.octet_length("line") <= MOST_BYTES, held))
    marked = F.try_variant_get("_held", "$[1]", "bigint").eqNullSafe(F.lit(_MARK)) & get(F.col("_held"), "$[0][1]").isNull()
    return once(whole, "v", F.when(marked & F.col("line").rlike(r"^\s*\{"), get(F.col("_held"), "$[0][0]"))).drop("_held")


#: Any number that no record holds at its top level.
_MARK = 724_339_187_265


def _either(v: Column, *paths: str) -> Column:
    """The first of the keys that is there, whatever its type."""
    return F.coalesce(*(get(v, p) for p in paths))


def facts(parsed: DataFrame) -> DataFrame:
    """Session facts of each record: `native_id, cwd, started_at, branch, commit, repository_url, repository`."""
    v = F.col("v")
    claude = F.col("agent") == CLAUDE
    meta = string(v, "$.type") == "session_meta"
    payload = F.coalesce(get(v, "$.payload"), v)
    git = get(payload, "$.git")
    pick = lambda a, b: F.when(claude, a).otherwise(b)
    url = string(git, "$.repository_url")
    return parsed.select(
        "*",
        pick(string(_either(v, "$.sessionId", "$.session_id")), F.when(meta, F.coalesce(string(payload, "$.id"), string(v, "$.session_id")))).alias("native_id"),
        pick(string(v, "$.cwd"), string(payload, "$.cwd")).alias("cwd"),
        instant(string(v, "$.timestamp")).alias("at"),
        pick(branch_name(string(_either(v, "$.gitBranch", "$.git_branch"))), branch_name(string(git, "$.branch"))).alias("branch"),
        pick(F.lit(None), non_blank(F.coalesce(string(git, "$.commit_hash"), string(git, "$.commit")))).alias("commit_hash"),
        pick(F.lit(None), non_blank(url)).alias("repository_url"),
        pick(non_blank(string(_either(v, "$.prRepository", "$.pr_repository"))), repository_label(non_blank(url))).alias("repository"),
    )


def _with_speech(parsed: DataFrame) -> DataFrame:
    """`parsed` with `_speaker` (null unless the record is an event), `_content` and `_blocks` of its text."""
    v = F.col("v")
    is_claude = F.col("agent") == CLAUDE
    parsed = once(parsed, "_payload", F.coalesce(F.when(~is_claude, get(v, "$.payload")), v))
    payload = F.col("_payload")
    message = F.coalesce(get(v, "$.message"), v)
    spoken_of = F.when(is_claude, F.coalesce(get(message, "$.content"), message)).otherwise(F.coalesce(get(payload, "$.content"), get(v, "$.content")))
    parsed = once(parsed, "_content", spoken_of)
    parsed = once(parsed, "_blocks", F.try_variant_get("_content", "$", "array<variant>"))
    parsed = once(parsed, "_type", string(v, "$.type"))
    blocks, kind = F.col("_blocks"), F.col("_type")

    tools = blocks.isNotNull() & (F.size(blocks) > 0) & F.forall(blocks, lambda b: F.coalesce(string(b, "$.type") == "tool_result", F.lit(False)))
    hidden = boolean(F.coalesce(get(v, "$.isMeta"), get(v, "$.is_meta")), "$")
    claude = kind.isin("user", "assistant") & ~hidden & ~((kind == "user") & tools)

    role = string(F.coalesce(get(v, "$.role"), get(payload, "$.role")))
    spoken = ((kind == "response_item") & (string(payload, "$.type") == "message")) | (kind == "message")
    channel = string(F.coalesce(get(payload, "$.channel"), get(v, "$.channel")))
    recipient = string(F.coalesce(get(payload, "$.recipient"), get(v, "$.recipient")))
    shown = F.coalesce(channel.isin("final", "commentary"), F.lit(True)) & F.coalesce(recipient == "all", F.lit(True))
    codex = spoken & role.isin("user", "assistant") & ((role == "user") | shown)

    speaker = F.when(is_claude, F.when(claude, kind)).when((F.col("agent") == CODEX) & codex, role)
    return once(parsed, "_speaker", speaker)


def _event() -> list[Column]:
    """`kind`, `text` and `timestamp` of a record with speech."""
    return [
        F.when(F.col("_speaker") == "user", 0).when(F.col("_speaker").isNotNull(), 1).alias("kind"),
        F.when(F.col("_speaker").isNotNull(), non_blank(text_of(F.col("_content"), F.col("_blocks")))).alias("text"),
        instant(string(F.col("v"), "$.timestamp")).alias("timestamp"),
    ]


def events(records: DataFrame) -> DataFrame:
    """User and assistant events: the columns of `records` and `kind` (0, 1), `text`, `timestamp`.

    Of the one format, meta records, other types, and user records of tool results only are left
    out; of the other, mirrors, tool output, other roles, and assistant messages that are not
    meant for the user. Blank texts are no events. Malformed lines and null agents give none.
    """
    spoken = _with_speech(parse(records).filter("v is not null")).filter("_speaker is not null")
    return spoken.select(*records.columns, *_event()).filter("text is not null")


def observed(records: DataFrame) -> DataFrame:
    """A narrow row per record: its event, if it is one, and its session facts, without the line.

    The columns of `records` but `line`, then `kind, text` (null unless it is an event),
    `timestamp`, the columns of `facts`, and `is_malformed` (no complete JSON object, or too large).
    """
    found = facts(_with_speech(parse(records)))
    return found.select(
        *(c for c in records.columns if c != "line"), *_event(), *FACTS,
        F.col("v").isNull().alias("is_malformed"),
    )


def session_facts(records: DataFrame) -> DataFrame:
    """A row per file: last id and folder, first time, first of each recorded Git fact, counts.

    Order is the order of bytes; a line read twice changes nothing. `n_malformed` counts lines
    that are no complete JSON object or too large.
    """
    rows = facts(parse(records))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("byte_start"))).alias(c)
    first = lambda c, name: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("byte_start"))).alias(name)
    return rows.groupBy("file_id", "agent").agg(
        last("native_id"),
        last("cwd"),
        first("at", "started_at"),
        *(first(c, c) for c in ("branch", "commit_hash", "repository_url", "repository")),
        F.count(F.lit(1)).alias("n_records"),
        F.sum(F.when(F.col("v").isNull(), 1).otherwise(0)).alias("n_malformed"),
    )
