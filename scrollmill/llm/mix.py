"""Mixing sources to target weights by min-cost flow over membership patterns.

A text may belong to several sources. Texts are aggregated by their membership pattern (the set
of sources that hold them), so the flow problem has as many nodes as there are patterns and
sources, whatever the number of documents: tokens flow from patterns to the quotas of their
sources, a first use costs nothing and each further use more than the one before (convex cost),
so repetition is spread evenly and only used where it must be. Documents are then chosen by a
seeded hash of the text: a pattern's flow to a source is a number of uses per text, whose whole
part every text gets and whose fraction the texts get whose hash lies in a stretch of a ring.

Which targets cannot be met is read off the same flow, there over documents rather than distinct
texts: a target is unmet where less than its quota arrives. Only sums by pattern come to the
driver, at most one for each set of target sources that occurs.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from scrollmill.functions.blank import trimmed
from scrollmill.session import cut, small, spread

#: Where the vocabulary file of the tokenizer lies, by default.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which this public vocabulary divides text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Parts of the ring of hashes: a fraction of uses is met to within half a part.
BUCKETS = 4096


@lru_cache(maxsize=4)
def encoder(vocabulary: bytes):
    """The tokenizer of a `.tiktoken` vocabulary (the file's bytes), made once a worker."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(docs: DataFrame, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """`docs` without the text but with `n_tokens` and `digest` of it; null counts as no token.

    The vocabulary file is read where the driver runs and sent to the workers.
    """
    with open(path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    others = [c for c in docs.columns if c != text]
    slim = spread(docs.select(*others, F.col(text).alias("_text"), F.md5(F.col(text).cast("binary")).alias("digest")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(vocabulary.value)
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            # of long texts a few at a time: the ids of a whole batch would be many times its size
            n = [len(count.encode_ordinary(t)) if t else 0 for t in batch.column(at).to_pylist()]
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in rest), pa.array(n, pa.int64())], [*(batch.schema.names[i] for i in rest), "n_tokens"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "_text")
    return slim.mapInArrow(run, f"{schema}, n_tokens bigint")


class Flow:
    """Min-cost flow with real capacities by successive shortest paths, for small graphs."""

    def __init__(self) -> None:
        self.arcs: list[list] = []  # to, room, cost
        self.out: dict = {}

    def add(self, a, b, room: float, cost: float) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0.0, -cost)):
            self.out.setdefault(x, []).append(len(self.arcs))
            self.arcs.append([y, r, c])
        return len(self.arcs) - 2

    def run(self, source, sink, least: float = 0.5) -> float:
        """Send all that can flow, cheapest first; amounts under `least` are left."""
        total = 0.0
        while True:
            cost, via = {source: 0.0}, {}
            todo, queued = [source], {source}
            while todo:
                x = todo.pop(0)
                queued.discard(x)
                for i in self.out.get(x, []):
                    y, room, c = self.arcs[i]
                    if room > least and cost[x] + c < cost.get(y, float("inf")) - 1e-9:
                        cost[y], via[y] = cost[x] + c, i
                        if y not in queued:
                            todo.append(y)
                            queued.add(y)
            if sink not in via:
                return total
            way, y = [], sink
            while y != source:
                way.append(via[y])
                y = self.arcs[via[y] ^ 1][0]
            amount = min(self.arcs[i][1] for i in way)
            for i in way:
                self.arcs[i][1] -= amount
                self.arcs[i ^ 1][1] += amount
            total += amount

    def sent(self, arc: int) -> float:
        return self.arcs[arc ^ 1][1]


def route(patterns: dict[tuple[str, ...], int], quotas: dict[str, float], repeats: dict[str, int], least: float = 0.5) -> dict:
    """Tokens from each pattern to each of its sources: {(pattern, source): tokens}.

    A pattern's k-th use of its tokens costs k * k; a source takes at most its quota, and of one
    pattern at most its own cap of uses; of one text all its sources together take at most the
    largest of their caps. Infeasible quotas are filled as far as they go.
    """
    flow = Flow()
    arcs = {}
    for p, tokens in patterns.items():
        for k in range(max([repeats[s] for s in p], default=0)):
            flow.add("source", p, float(tokens), float(k * k))
        for s in p:
            arcs[p, s] = flow.add(p, ("to", s), float(tokens) * repeats[s], 0.0)
    for s, q in quotas.items():
        flow.add(("to", s), "sink", float(q), 0.0)
    flow.run("source", "sink", least)
    return {key: flow.sent(i) for key, i in arcs.items()}


class Mix:
    """A plan for mixing `documents` (doc_id, source, text) to `targets` (source, target_share, max_repeats).

    Sources are compared without letter case and outer space; a target whose source is null or
    repeated under one spelling counts as written, the first of equal spellings is filled. A null
    text has no tokens, documents of a null or unknown source count in the total only. A null
    share is 0, a null cap 1.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, seed: int = 0, path: str = VOCABULARY) -> None:
        spark = documents.sparkSession
        self.targets = [
            (r["source"], r["key"], r["target_share"] or 0.0, 1 if r["max_repeats"] is None else max(0, r["max_repeats"]))
            for r in targets.select("source", F.lower(trimmed(F.col("source"))).alias("key"), "target_share", "max_repeats").collect()
        ]  # mix_targets is a list of sources: small by its nature
        docs = documents.select(F.col("doc_id").cast("bigint"), F.lower(trimmed(F.col("source"))).alias("source"), "text")
        counted = with_tokens(docs, path=path)
        # one row per text and source; copies are counted but stand for one text
        self.texts = cut(
            counted.groupBy("digest", "source").agg(
                F.max("n_tokens").alias("n_tokens"), F.sum("n_tokens").alias("all_tokens"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")
            )
        )
        self.sums = {r["source"]: (r["t"] or 0, r["n"]) for r in self._of_targets(self.texts, True).collect()}
        self.total = self.texts.agg(F.sum("all_tokens")).first()[0] or 0
        self.seed = seed
        self.spark = spark

    def _keys(self) -> list[str]:
        return list(dict.fromkeys(k for _, k, _, _ in self.targets if k is not None))

    def _of_targets(self, texts: DataFrame, by_source: bool) -> DataFrame:
        own = texts.filter(F.col("source").isin(self._keys()))
        return own.groupBy("source").agg(F.sum("all_tokens").alias("t"), F.sum("copies").alias("n")) if by_source else own

    def quota(self, share: float) -> float:
        return share * self.total

    def unmet(self) -> list[str]:
        """Targets at which less than the quota arrives, in their order.

        Every document belongs to one source and may be used as often as that one allows, so each
        target has a pattern of its own here: repeated texts count under each id, and a source
        written twice is judged twice.
        """
        patterns = {(str(i),): self.sums.get(key, (0, 0))[0] for i, (_, key, _, _) in enumerate(self.targets)}
        quotas = {str(i): self.quota(share) for i, (_, _, share, _) in enumerate(self.targets)}
        sent = route(patterns, quotas, {str(i): cap for i, (_, _, _, cap) in enumerate(self.targets)}, least=1e-6)
        short = lambda i: sent.get(((str(i),), str(i)), 0.0) < quotas[str(i)] - max(1e-5, 1e-12 * self.total)
        return [name for i, (name, _, _, _) in enumerate(self.targets) if short(i)]

    def selection(self) -> DataFrame:
        """The mixture: `source, doc_id, n_tokens, repeats`, a row per text and source that uses it."""
        keys = self._keys()
        quotas: dict[str, float] = {}
        caps: dict[str, int] = {}
        for _, key, share, cap in self.targets:
            if key is not None and key not in quotas:
                quotas[key], caps[key] = self.quota(share), cap
        bucket = F.pmod(F.xxhash64("digest", F.lit(self.seed)), F.lit(BUCKETS)).cast("int")
        own = self._of_targets(self.texts, False)
        member = own.groupBy("digest").agg(
            F.concat_ws("\x1f", F.array_sort(F.collect_set("source"))).alias("pattern"), F.max("n_tokens").alias("n_tokens")
        )
        ring = cut(member.groupBy("pattern", bucket.alias("bucket")).agg(F.sum("n_tokens").alias("t")))
        tokens = {tuple(r["pattern"].split("\x1f")): r["t"] for r in ring.groupBy("pattern").agg(F.sum("t").alias("t")).collect()}
        flows = route(tokens, quotas, caps)
        rows = []
        for p, total in tokens.items():
            start = 0.0
            for s in p:
                uses = flows[p, s] / total if total else 0.0
                # the fractions of a pattern's sources take turns around the ring
                rows.append(("\x1f".join(p), s, int(uses), start % 1.0 * total, (uses - int(uses)) * total, float(total or 1)))
                start += uses - int(uses)
        plan = self.spark.createDataFrame(rows, "pattern string, source string, whole int, lo double, run double, total double")
        # a pattern has at most BUCKETS rows here
        middle = F.sum("t").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("t") / 2
        placed = ring.select("pattern", "bucket", middle.alias("middle")).join(plan, "pattern")
        extra = F.when(F.pmod(F.col("middle") - F.col("lo"), F.col("total")) < F.col("run"), 1).otherwise(0)
        uses = cut(placed.select("pattern", "source", "bucket", (F.col("whole") + extra).alias("repeats")).filter("repeats > 0"))
        chosen = own.join(member.select("digest", "pattern"), "digest").withColumn("bucket", bucket)
        return chosen.join(F.broadcast(uses) if small(uses) else uses, ["pattern", "source", "bucket"]).select("source", "doc_id", "n_tokens", "repeats")

    def shares(self) -> DataFrame:
        """`source, target_share, quota, tokens, n_texts, actual_share, error, can_be_met, is_met` of each target.

        `tokens` is what the selection uses, `error` the actual share less the target. `can_be_met`
        counts repeated texts under each id, as `unmet` does; the selection uses each distinct text
        at most `max_repeats` times, so it `is_met` (within half a percent of the quota, or one ring
        part) only if distinct texts suffice.
        """
        uses = self.selection().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("t"), F.count(F.lit(1)).alias("n"))
        got = {r["source"]: r for r in uses.collect()}
        whole = sum(r["t"] or 0 for r in got.values())
        unmet = set(self.unmet())
        rows = []
        for name, key, share, _ in self.targets:
            t, n = (got[key]["t"] or 0, got[key]["n"]) if key in got else (0, 0)
            actual, quota = t / whole if whole else 0.0, self.quota(share)
            rows.append((name, share, quota, t, n, actual, actual - share, name not in unmet, t >= quota * (1 - max(0.005, 1 / BUCKETS))))
        ddl = "source string, target_share double, quota double, tokens bigint, n_texts bigint, actual_share double, error double, can_be_met boolean, is_met boolean"
        return self.spark.createDataFrame(rows, ddl)
