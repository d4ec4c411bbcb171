"""A bounded look back into the source of a result: verified, aligned to records, in plain text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from scrollmill.functions.tokens import CONTROLS
from scrollmill.operators import adapters
from scrollmill.sources import jsonl

#: Bytes of context on either side and of the whole window, at most.
CONTEXT, WINDOW = 1 << 20, 8 << 20
ROLES = ("User", "Assistant")


class Stale(RuntimeError):
    """The source is no longer what was indexed."""


@dataclass
class Preview:
    """Text of the records around a range, and whether more stands before and after them."""

    text: str
    cut_before: bool
    cut_after: bool


def window(path: str, start: int, end: int, committed: int, context: int = 4096) -> tuple[list[tuple[int, int, bytes]], bool, bool]:
    """(Complete records around a byte range, cut before, cut after): `context` bytes either side, within the committed bytes."""
    context = min(max(0, context), CONTEXT)
    lo = max(0, start - context)
    hi = min(committed, end + context + 1, lo + WINDOW)
    parts = [(a, b, d) for a, b, d in jsonl.records(path, lo, hi, committed) if d is not None and b < hi]
    return parts, bool(parts) and parts[0][0] > 0, bool(parts) and parts[-1][1] + 1 < committed


def preview(manifest: DataFrame, path: str, file_id: int, generation: int, start: int, end: int, context: int = 4096) -> Preview:
    """The conversation around a result's source, as `User: ` and `Assistant: ` blocks.

    `manifest` is a store's. Raises `Stale` unless the file is the one that was indexed: the same
    id and generation in the manifest, the range within the committed bytes, the same identity, size
    and times on disk, and the same hashes of both ends. Control characters but line feed and tab become U+FFFD. One file is
    read, on the driver, as one reader asks.
    """
    known = manifest.filter((F.col("path") == path) & (F.col("file_id") == file_id)).limit(1).collect()
    if not known or known[0]["generation"] != generation or end > known[0]["committed_offset"]:
        raise Stale("the source was indexed anew")
    row = known[0]
    stat, found = jsonl.json_stat(path), jsonl.fingerprint(path)
    try:
        if found != {n: row[n] for n in found or ()} or jsonl.sample(path, row["sampled_size"]) != row["hashes"]:
            raise Stale("the source is not the file that was indexed")
        parts, before, after = window(path, start, end, row["committed_offset"], context)
    except OSError as e:
        raise Stale(str(e)) from None
    if jsonl.json_stat(path) != stat:
        raise Stale(jsonl.CHANGED)
    lines = manifest.sparkSession.createDataFrame([(row["agent"], a, d.decode("utf-8", "replace")) for a, _, d in parts], "agent int, byte_start bigint, line string")
    spoken = adapters.events(lines).select("byte_start", "kind", "text").collect()  # as many as fit the window
    blocks = [f"{ROLES[r['kind']]}: {r['text']}" for r in sorted(spoken, key=lambda r: r["byte_start"])]
    return Preview(CONTROLS.sub("�", "\n\n".join(blocks)), before, after)


def session_for_source(sessions: DataFrame, path: str, file_id: int, generation: int) -> DataFrame:
    """The session rows of this source: another file with the same native id does not count."""
    return sessions.filter((F.col("source_path") == path) & (F.col("source_file_id") == file_id) & (F.col("source_generation") == generation))


def messages(text: Column) -> Column:
    """The (role, body) blocks of a preview's text; a role counts at its start or after an empty line.

    Line ends at the end of a body are dropped; text before the first role has a null role.
    """
    blocks = F.filter(F.split(text, r"(?<=\n\n)(?=(?:User|Assistant): )"), lambda b: b != "")
    role = lambda b: F.nullif(F.regexp_extract(b, r"^(User|Assistant): ", 1), F.lit(""))
    return F.transform(blocks, lambda b: F.struct(role(b).alias("role"), F.regexp_replace(F.regexp_replace(b, r"^(?:User|Assistant): ", ""), r"\n+$", "").alias("body")))
