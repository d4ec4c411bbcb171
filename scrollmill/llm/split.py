"""Splitting oversized items at natural boundaries, by agglomerative merging.

A text begins as atomic segments: paragraphs, and where one is too large its lines, then its
sentences, clauses, words and at last its characters. Adjacent segments are held in a heap by
the strength of the boundary between them, and the weakest boundary is merged first while the
two sides and the overlap fit the limit; what cannot merge any more are the pieces. So a piece
ends at the strongest boundaries that the limit allows. Every piece but the first is led by the
last `overlap_bytes` of the text before it.

Items within the limit never leave the JVM; an oversized item is split in the task that read it.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Boundaries from strong to weak: the segment ends after the match.
LEVELS = (
    ("paragraph", re.compile(r"\n[ \t]*\n\s*")),
    ("line", re.compile(r"\n")),
    ("sentence", re.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？]+|\\n")),
    ("clause", re.compile(r"[,;:][ \t]+|[}\]],|\\t|[，；、]")),
    ("word", re.compile(r"\s+|(?<=[_/-])")),
)
_NAMES = (*[n for n, _ in LEVELS], "character")


def _ends(text: str, start: int, end: int, pattern: re.Pattern) -> list[int]:
    out = [m.end() for m in pattern.finditer(text, start, end) if start < m.end() < end]
    return [*out, end]


def _size(text: str, start: int, end: int) -> int:
    return len(text[start:end].encode("utf-8", "surrogatepass"))


def atoms(text: str, room: int) -> list[tuple[int, int, int]]:
    """(end, bytes, level of the boundary at its end) of the atomic segments, none above `room`.

    Level 0 is the strongest boundary. A segment is divided at the next weaker level only where
    it is larger than a quarter of the room, so that pieces can fill up without far too many
    atoms; a word larger than the room is cut between characters.
    """
    out: list[tuple[int, int, int]] = []
    stack = [(0, len(text), 0, 0)]
    while stack:
        start, end, level, after = stack.pop()
        n = _size(text, start, end)
        if n <= max(1, room // 4) or (level >= len(LEVELS) and n <= room):
            out.append((end, n, after))
        elif level < len(LEVELS):
            ends = _ends(text, start, end, LEVELS[level][1])
            parts = []
            for e in ends:
                parts.append((start, e, level + 1, level if e != end else after))
                start = e
            stack.extend(reversed(parts))
        else:
            data = text[start:end].encode("utf-8", "surrogatepass")
            at, pos = 0, start
            while at < len(data):
                stop = min(at + room, len(data))
                while stop > at and stop < len(data) and data[stop] & 0xC0 == 0x80:
                    stop -= 1
                if stop == at:  # a character larger than the room stands alone
                    stop += 1
                    while stop < len(data) and data[stop] & 0xC0 == 0x80:
                        stop += 1
                pos += len(data[at:stop].decode("utf-8", "surrogatepass"))
                out.append((pos, stop - at, len(LEVELS) if stop < len(data) else after))
                at = stop
    return out


def merge(segments: list[tuple[int, int, int]], room: int) -> list[tuple[int, int]]:
    """(end, level at its end) of the pieces after merging weakest boundaries first within `room`.

    Of equally weak boundaries the earlier goes first, so that pieces fill up from the start.
    """
    n = len(segments)
    size = [s for _, s, _ in segments]
    right = [*range(1, n), -1]
    left = [-1, *range(n - 1)]
    alive = [True] * n
    heap = [(-segments[i][2], i, size[i] + size[i + 1]) for i in range(n - 1)]
    heapq.heapify(heap)
    end = [e for e, _, _ in segments]
    level = [v for _, _, v in segments]
    while heap:
        _, i, total = heapq.heappop(heap)
        j = right[i] if alive[i] else -1
        if j < 0 or size[i] + size[j] != total or total > room:
            continue
        size[i], end[i], level[i], alive[j] = total, end[j], level[j], False
        right[i] = right[j]
        if right[i] >= 0:
            left[right[i]] = i
            heapq.heappush(heap, (-level[i], i, total + size[right[i]]))
        if left[i] >= 0:
            k = left[i]
            heapq.heappush(heap, (-level[k], k, size[k] + total))
    return [(end[i], level[i]) for i in range(n) if alive[i]]


def _back(text: str, at: int, n_bytes: int) -> int:
    """The least start so that text[start:at] has at most `n_bytes`."""
    data = text[max(0, at - n_bytes) : at].encode("utf-8", "surrogatepass")
    tail = data[max(0, len(data) - n_bytes) :]
    skip = 0
    while skip < len(tail) and tail[skip] & 0xC0 == 0x80 and len(data) > n_bytes:
        skip += 1
    return at - len(tail[skip:].decode("utf-8", "surrogatepass"))


def pieces(text: str, max_bytes: int, overlap_bytes: int) -> list[tuple[int, int, int, str]]:
    """(start, overlap end, end, boundary at the end) of the pieces of `text`, in characters.

    One piece if the text fits. The overlap is at most `overlap_bytes`, less where a character
    would be cut, and is lowered to half the limit if that is less. No piece is over the limit,
    unless the limit is too small for one character.
    """
    if _size(text, 0, len(text)) <= max_bytes:
        return [(0, 0, len(text), "end")]
    overlap = min(max(0, overlap_bytes), max_bytes // 2)
    room = max(1, max_bytes - overlap)
    out, start = [], 0
    for end, level in merge(atoms(text, room), room):
        out.append((_back(text, start, overlap) if start else 0, start, end, _NAMES[level] if end < len(text) else "end"))
        start = end
    return out


_FIELDS = [
    ("item_table", pa.string()), ("item_id", pa.int64()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()),
    ("start_char", pa.int64()), ("overlap_chars", pa.int64()), ("end_char", pa.int64()), ("n_bytes", pa.int64()),
    ("boundary", pa.string()), ("is_overlap_lowered", pa.bool_()), ("text", pa.string()),
]
_DDL = (
    "item_table string, item_id bigint, piece_no int, n_pieces int, start_char bigint, overlap_chars bigint,"
    " end_char bigint, n_bytes bigint, boundary string, is_overlap_lowered boolean, text string"
)


def split_oversized(items: DataFrame, with_text: bool = True) -> DataFrame:
    """The pieces of every oversized item of `items`.

    `items` has `item_table, item_id, text, max_bytes, overlap_bytes`. Null texts, null limits and
    texts within the limit give no row: they stay as they are. Joining `text` from `overlap_chars`
    on in the order of `piece_no` gives the item back. `is_overlap_lowered` tells that the stated
    overlap is over half the limit, to which it was lowered. Repeated items are split each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table, item, text, most, overlap in zip(*(batch.column(i).to_pylist() for i in range(5))):
                cuts = pieces(text, most, overlap)
                rows = []
                for k, (start, core, end, name) in enumerate(cuts):
                    part = text[start:end]
                    rows.append((table, item, k, len(cuts), start, core - start, end, len(part.encode()), name, overlap > most // 2, part if with_text else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _FIELDS)], [n for n, _ in _FIELDS])

    large = items.filter(F.octet_length("text") > F.col("max_bytes")).select(
        "item_table", F.col("item_id").cast("bigint"), "text", F.col("max_bytes").cast("int"), F.coalesce("overlap_bytes", F.lit(0)).cast("int")
    )
    return large.mapInArrow(run, _DDL)


def rejoined(pieces_: DataFrame) -> DataFrame:
    """`item_table, item_id, digest, n_pieces, n_most, n_overlap`: items put together again from their pieces.

    `digest` is of the text without overlaps, `n_most` the bytes of the largest piece, `n_overlap`
    the least overlap in characters between neighbours. The pieces of one item are as many as one
    text has. Items repeated under one id are not told apart.
    """
    core = F.substring(F.col("text"), F.col("overlap_chars").cast("int") + 1, F.length("text"))
    whole = F.array_sort(F.collect_list(F.struct("piece_no", core.alias("core"))))
    return pieces_.groupBy("item_table", "item_id").agg(
        F.md5(F.array_join(F.transform(whole, lambda x: x["core"]), "").cast("binary")).alias("digest"), F.count(F.lit(1)).alias("n_pieces"),
        F.max("n_bytes").alias("n_most"), F.min(F.when(F.col("piece_no") > 0, F.col("overlap_chars"))).alias("n_overlap"),
    )


def items_of(chunks: DataFrame, files: DataFrame, records: DataFrame, limits: DataFrame) -> DataFrame:
    """The texts under a size limit of the three tables, each with its limit (`limits` is a few rows)."""
    pending = F.get_json_object("open_turn_state", "$.pending.text")
    texts = (
        chunks.select(F.lit("search_chunks").alias("item_table"), F.lit("text").alias("field_name"), F.col("chunk_id").alias("item_id"), "text")
        .unionByName(files.select(F.lit("indexed_files").alias("item_table"), F.lit("open_turn_state.pending.text").alias("field_name"), F.col("file_id").alias("item_id"), pending.alias("text")))
        .unionByName(records.select(F.lit("raw_records").alias("item_table"), F.lit("line").alias("field_name"), F.col("record_id").alias("item_id"), F.col("line").alias("text")))
    )
    few = F.broadcast(limits.select("item_table", "field_name", "max_bytes", "overlap_bytes"))
    return texts.join(few, ["item_table", "field_name"]).drop("field_name")
