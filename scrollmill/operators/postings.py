"""A stored inverted index over chunks: a row per term and chunk, laid out by term.

Postings are range-partitioned and sorted by term, so that a search for a word or a prefix reads
the row groups of that stretch of terms and nothing else; texts are read only for the rows that a
limit keeps. A row carries what ranking needs (tokens of the chunk, its order among equals), so a
search joins nothing: it groups the postings of its terms by chunk, counts phrases by shifting
positions, and scores, in one job.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from scrollmill.functions.tokens import tokens
from scrollmill.operators.ranking import counted, matches, score
from scrollmill.plans.query_language import Phrase, parse, phrases
from scrollmill.session import once, spread

#: What ranking needs of a chunk, and what tells whether a row still counts in a store.
KEYS = ["chunk_id", "agent", "native_id", "ordinal", "kind", "n_tokens"]
_VALID = ["source_file_id", "source_generation", "is_open", "version"]
#: Rows of a row group: few enough that a stretch of terms is a small part of a file.
GROUP_BYTES = 4 << 20


@dataclass
class Index:
    """Postings, the chunks they are of, and how many rows and tokens these have; `terms` where a table of them is kept."""

    postings: DataFrame
    terms: DataFrame | None
    chunks: DataFrame
    n_rows: int
    n_tokens: int

    def vocabulary(self) -> DataFrame:
        """`term, n_chunks, n_occurrences` of every token."""
        if self.terms is not None:
            return self.terms
        return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.size("positions")).alias("n_occurrences"))

    def with_chunks(self, results: DataFrame) -> DataFrame:
        """Results (as many as a limit keeps) with the rest of their chunks' columns."""
        rest = [c for c in self.chunks.columns if c not in results.columns]
        return self.chunks.select("chunk_id", *rest).join(F.broadcast(results), "chunk_id")


def tokenized(chunks: DataFrame) -> DataFrame:
    """`chunks` with `n_tokens` of the text; 0 for null."""
    return chunks.withColumn("n_tokens", F.size(tokens(F.col("text"))))


def postings(chunks: DataFrame) -> DataFrame:
    """`term`, the `KEYS` of its chunk and the `positions` at which it stands there; a row per term and chunk, unordered.

    A chunk's tokens are gathered by term in the task that holds the chunk. Null texts have no rows.
    """
    columns = [c for c in [*KEYS, *_VALID] if c in chunks.columns and c != "n_tokens"]
    source = once(spread(chunks), "_tokens", tokens(F.col("text"))).select(*columns, "_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, terms, places, sizes = [], [], [], []
            for row, found in enumerate(batch.column(len(columns)).to_pylist()):
                of: dict[str, list[int]] = {}
                for i, t in enumerate(found):
                    of.setdefault(t, []).append(i)
                at += [row] * len(of)
                terms += of.keys()
                places += of.values()
                sizes += [len(found)] * len(of)
            if at:
                kept = pa.RecordBatch.from_arrays([*batch.columns[:-1]], columns).take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms, pa.string()), *kept.columns, pa.array(sizes, pa.int32()), pa.array(places, pa.list_(pa.int32()))],
                    ["term", *columns, "n_tokens", "positions"],
                )

    kinds = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in columns)
    return source.mapInArrow(run, f"term string, {kinds}, n_tokens int, positions array<int>")


def in_order(rows: DataFrame, files: int | None = None) -> DataFrame:
    """Postings laid out by term, ready to be written."""
    dealt = rows.repartitionByRange("term") if files is None else rows.repartitionByRange(files, "term")
    return dealt.sortWithinPartitions("term", "chunk_id")


def build(chunks: DataFrame, folder: str) -> Index:
    """Write the index of `chunks` to `folder`, which all executors share, and open it."""
    spark = chunks.sparkSession
    made = in_order(postings(chunks))
    made.write.option("parquet.block.size", GROUP_BYTES).parquet(f"{folder}/postings")
    rows = spark.read.parquet(f"{folder}/postings")
    index = Index(rows, None, chunks, chunks.count(), 0)
    index.vocabulary().sort("term").write.parquet(f"{folder}/terms")
    index.terms = spark.read.parquet(f"{folder}/terms")
    index.n_tokens = index.terms.agg(F.coalesce(F.sum("n_occurrences"), F.lit(0))).first()[0]
    return index


def _is(term: str, prefix: bool) -> Column:
    return F.col("term").startswith(term) if prefix else F.col("term") == term


def _back_by(k: int):
    return lambda x: x - k


def hits(index: Index, text: str, kind: int | None = None) -> DataFrame:
    """`KEYS` and `score` of all chunks that satisfy the expression `text`; no job is run for it.

    As `search.hits` over the chunks themselves: `kind` filters rows after the statistics, which
    come from the same grouped postings; an expression without a token has no hits.
    """
    tree = parse(text)
    unique = list(dict.fromkeys(phrases(tree) if tree else []))
    if not unique:
        return index.postings.select(*KEYS, F.lit(0.0).alias("score")).filter(F.lit(False))
    slots: dict[tuple[str, bool], bool] = {}  # term, prefix: are positions needed
    for p in unique:
        for k, t in enumerate(p.tokens):
            at = (t, p.prefix and k == len(p.tokens) - 1)
            slots[at] = slots.get(at, False) or len(p.tokens) > 1
    name = {s: f"_s{i}" for i, s in enumerate(slots)}
    rows = index.postings.filter(reduce(lambda a, b: a | b, (_is(*s) for s in slots)))
    if len(slots) == 1 and not next(iter(slots))[1]:
        # of one whole term a chunk has one row
        (slot, places), = slots.items()
        per = rows.select(*KEYS, (F.col("positions") if places else F.size("positions")).alias(name[slot]))
    else:
        parts = []
        for s, places in slots.items():
            own = F.when(_is(*s), F.col("positions"))
            parts.append((F.flatten(F.collect_list(own)) if places else F.coalesce(F.sum(F.when(own.isNotNull(), F.size(own))), F.lit(0))).alias(name[s]))
        per = rows.groupBy(*KEYS).agg(*parts)

    def frequency(p: Phrase) -> Column:
        keys = [(t, p.prefix and k == len(p.tokens) - 1) for k, t in enumerate(p.tokens)]
        if len(keys) == 1:
            return F.size(name[keys[0]]) if slots[keys[0]] else F.col(name[keys[0]])
        shifted = [F.transform(name[s], _back_by(k)) for k, s in enumerate(keys)]
        return F.size(reduce(F.array_intersect, shifted))

    tf = {p: F.col(f"_tf{i}") for i, p in enumerate(unique)}
    table = per.select(*KEYS, *(frequency(p).alias(f"_tf{i}") for i, p in enumerate(unique)))
    having = table.agg(*(F.coalesce(F.sum((F.col(f"_tf{i}") > 0).cast("bigint")), F.lit(0)).alias(f"_h{i}") for i in range(len(unique))))
    kept = table.filter(matches(tree, tf))
    if kind is not None:
        kept = kept.filter(F.col("kind") == kind)
    known = {p: F.col(f"_h{i}") for i, p in enumerate(unique)}
    value = score(F.lit(index.n_rows), F.lit(index.n_tokens), F.col("n_tokens"), known, counted(tree, tf))
    return kept.crossJoin(F.broadcast(having)).select(*KEYS, value.alias("score"))  # one row is sent
