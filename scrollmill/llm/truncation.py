"""Texts cut off by field limits or in transfer, and how often each source cuts.

Two signs tell that a text was cut.

Near-copies: a cut copy is like the first part of its original, however much is missing. So a
text's min-hash signature over five-word shingles is read off at a ladder of lengths (running
minima, so one pass gives all of them), and a text that ends without a stop is looked up, banded,
by its whole signature among the signatures of others at the step of its own length. Every copy of
a bucket is compared with every other text of it, block by block. Pairs of which the copy's shingles
are in the other one by 0.8 or more are aligned over their whole length, and a copy whose alignment
ends early, inside a word or sentence of the other one, is cut.

Closing-word terminality, for texts without such a copy: from all lines of all texts the corpus
learns how often a closing word ends a line of that kind rather than stand inside one. A text
whose last word hardly ever ends a line, or is no whole word of the corpus, or that leaves a code
block open, stops inside something. Texts that by nature end without a full stop (a log's last
line, a list, a greeting) close with words that end lines, so they pass; the length of a text is
no sign by itself.

One pass over the texts folds line statistics within each batch and yields a narrow row per
text; texts are read again only for candidate pairs.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import cached_property
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scrollmill.functions.blank import trimmed
from scrollmill.llm.words import codes
from scrollmill.session import attach, cut, small, spread

#: A closing word that ends fewer of its lines than this stops inside a sentence.
LEAST_TERMINAL = 0.1
#: Weight of the kind of line against the word's own counts, in occurrences.
SMOOTHING = 3.0
#: Words in a shingle, least similarity of near-copies, bands and hashes in a band.
SHINGLE, LEAST_SIMILAR, BANDS, ROWS = 5, 0.8, 4, 3
#: Least shingles of a text that is looked up, first step of the ladder, and from step to step.
LEAST_SHINGLES, FIRST_STEP, STEP = 12, 16, 1.3
#: Copies, and other texts, of a bucket that are compared in one go, and their shingles; a larger bucket has several such blocks.
BUCKET, BLOCK_SHINGLES = 2048, 1 << 19
#: Only a bound that the tests set: no text stands for others.
STAND_FOR = 8
#: Shingles of other texts that are looked through in one go.
_MOST_AT_ONCE = 1 << 20
#: Signs after which a text is not inside a sentence.
STOPS = ".?!。？！)\"'”»`|"

# Marks that say themselves that text was left out after them.
_ELLIPSIS = re.compile(r"\s*(?:…|\.{3,}|[\[(<](?:…|\.\.\.|(?:\w+ )?(?:truncated|clipped|cut|snipped|shortened|omitted|continued))[\])>])+$", re.I)
#: Characters at the end of a text in which such marks are looked for.
_MARKS = 200
_TAIL = re.compile(r"[^\W_]+$")
_WIDE = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힯]")
_FENCE = re.compile(r"^[ \t]*(?:```|~~~)", re.M)
_WORDS = re.compile(r"[^\W_]+")

# A stop before a space, an empty line, or a line that does not go on in small letters.
_BREAK = re.compile(r"[.?!。？！][\"'”’)\]*_`]*\s|\n\s*\n|\n[ \t]*(?![ \ta-zà-ÿ])")

_shapes: dict[str, str] = {}


def unmarked(text: str) -> str:
    """`text` without outer space at its end and without the marks there that say it was cut."""
    text = text.rstrip()
    return text[:-_MARKS] + _ELLIPSIS.sub("", text[-_MARKS:]) if text else text


def closing(chunk: str) -> str:
    """What a run without spaces closes with: a word, a class of words, or its last signs."""
    last = chunk[-1]
    if last.isalnum():
        if _WIDE.match(last):
            return "C"
        word = _TAIL.search(chunk)[0].lower()
        joined = len(word) < len(chunk) and chunk[-len(word) - 1] in "_-/.@#"
        return ("id" if joined else "") + ("0" if word.isdigit() else "" if joined else word)
    before = chunk[-2:-1]
    sign = "" if not before else "C" if _WIDE.match(before) else "a" if before.isalpha() else "0" if before.isdigit() else before
    return sign + last


class _Closings(dict):
    def __missing__(self, chunk: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[chunk] = out = closing(chunk)
        return out


_closings = _Closings()


def _shape(chunk: str) -> str:
    if (known := _shapes.get(chunk)) is not None:
        return known
    if chunk.endswith(":") and len(chunk) < 24:
        out = re.sub(r"\d+", "0", chunk.lower())
    elif _WIDE.match(chunk):
        out = "C"
    else:
        s = re.sub(r"\d+", "0", chunk)
        if s[:1].isalpha():
            out = ("X" if s[0].isupper() else "x") + ("(" if "(" in s else "")
        else:
            out = re.sub(r"[^\W\d_]+", "a", s)[:10]
    if len(_shapes) > 500_000:
        _shapes.clear()
    _shapes[chunk] = out
    return out


def kind(chunks: list[str]) -> str:
    """The kind of a line: the form of its first word, after a list mark of the next one too."""
    first = chunks[0]
    out = _shape(first)
    if len(chunks) > 1 and not first[0].isalpha() and len(out) <= 2:
        out += _shape(chunks[1])
    return f"{first.lower()[:16]}/{len(chunks)}" if len(chunks) < 4 and first[0].isalpha() and "_" not in first and "-" not in first else out


def ladder(n: int) -> list[int]:
    """The steps below `n` shingles, and the first one that is not below."""
    out = [FIRST_STEP]
    while out[-1] < n:
        out.append(math.ceil(out[-1] * STEP))
    return out


def signatures(texts: list[list[str]], salts: np.ndarray) -> list[list[int] | None]:
    """For each text (its words) and step of its ladder the class of the words so far and `BANDS` bucket keys, flat.

    The last step has the whole text. None for texts of fewer than `LEAST_SHINGLES`. Texts are
    hashed one after the other in one array, a few thousand words at a time.
    """
    out: list[list[int] | None] = []
    group: list[list[str]] = []
    size = 0
    for words in texts:
        if len(words) - SHINGLE + 1 < LEAST_SHINGLES:
            group.append([])
        else:
            group.append(words)
            size += len(words)
        if size >= 8192:
            out += _signatures(group, salts)
            group, size = [], 0
    return out + _signatures(group, salts)


def _signatures(texts: list[list[str]], salts: np.ndarray) -> list[list[int] | None]:
    rows = [t for t in texts if t]
    if not rows:
        return [None] * len(texts)
    n = np.array([len(t) - SHINGLE + 1 for t in rows])
    begin = np.cumsum([0, *(len(t) for t in rows[:-1])])
    code = codes([w for t in rows for w in t])
    steps = [ladder(x) for x in n.tolist()]
    count = np.array([len(x) for x in steps])
    step = np.concatenate(steps)
    of = np.repeat(np.arange(len(rows)), count)
    ends = np.minimum(step, n[of]) - 1  # the last shingle of each step, counted from the text's first
    first = np.cumsum(count) - count
    starts = np.concatenate([[0], ends[:-1] + 1])
    starts[first] = 0
    with np.errstate(over="ignore"):
        m = len(code) - SHINGLE + 1
        h = np.zeros(m, np.uint64)
        for k in range(SHINGLE):
            h = h * np.uint64(0x9E3779B97F4A7C15) + code[k : m + k]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        local = np.arange(m, dtype=np.uint64) - np.repeat(begin, [len(t) for t in rows])[:m].astype(np.uint64)
        folded = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(h * (np.uint64(2) * local + np.uint64(1)))])
        made = np.empty((len(step), 1 + BANDS), np.uint64)
        made[:, 0] = folded[begin[of] + ends + 1] ^ folded[begin[of]]
        # least values of the stretch that each step adds, then the running minima of each text;
        # between two texts lie shingles of both, a stretch of their own that is left out
        at = np.stack([begin[of] + starts, begin[of] + ends + 1], axis=1).ravel()
        drop = np.ones(len(at), bool)
        drop[1::2] = np.append(of[:-1] != of[1:], True)
        at = at[drop]
        own = np.flatnonzero(drop)
        h = np.append(h, np.uint64(0))
        least = np.stack([np.minimum.reduceat(salt * h, at)[own % 2 == 0] for salt in salts])
        for a, c in zip(first.tolist(), count.tolist()):
            np.minimum.accumulate(least[:, a : a + c], axis=1, out=least[:, a : a + c])
        keys = (np.arange(BANDS, dtype=np.uint64)[:, None] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (step.astype(np.uint64) << np.uint64(20))[None, :]
        for r in range(ROWS):
            keys = (keys ^ least.reshape(BANDS, ROWS, -1)[:, r]) * np.uint64(0xFF51AFD7ED558CCD)
            keys ^= keys >> np.uint64(32)
        made[:, 1:] = keys.T
    flat = made.view(np.int64).ravel().tolist()
    width = 1 + BANDS
    found = iter([flat[a * width : (a + c) * width] for a, c in zip(first.tolist(), count.tolist())])
    return [next(found) if t else None for t in texts]


_FIELDS = [
    ("what", pa.string()), ("doc_id", pa.int64()), ("source", pa.string()), ("digest", pa.string()), ("n_shingles", pa.int64()),
    ("kind", pa.string()), ("closing", pa.string()), ("word", pa.string()), ("is_open", pa.bool_()), ("is_stopped", pa.bool_()),
    ("steps", pa.list_(pa.int64())), ("n", pa.int64()), ("n_ends", pa.int64()),
]
_DDL = (
    "what string, doc_id bigint, source string, digest string, n_shingles bigint, kind string, closing string, word string,"
    " is_open boolean, is_stopped boolean, steps array<bigint>, n bigint, n_ends bigint"
)


def scan(documents: DataFrame) -> DataFrame:
    """One pass: a row per text ('doc'), and folded counts of closings ('line') and words ('word').

    Counts leave out the last word of each text. Null and blank texts give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, BANDS * ROWS, dtype=np.int64).view(np.uint64) | np.uint64(1)

        def sign(held: list[list[str]], out: list) -> None:
            for row, steps in zip(out[len(out) - len(held) :], signatures(held, salts)):
                row[10] = steps

        for batch in batches:
            out: list = []
            held: list[list[str]] = []
            seen: defaultdict[str, list[str]] = defaultdict(list)
            ends, vocabulary = Counter(), Counter()
            for doc, source, digest, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                body = unmarked(text)
                lines = [c for line in body.split("\n") if (c := line.split())]
                if not lines:
                    continue
                final, plain = len(lines) - 1, body.isascii()
                for i, chunks in enumerate(lines):
                    of = kind(chunks)
                    # a list mark or time stamp before a line is no word of it
                    first = int(len(chunks) > 1 and not chunks[0][0].isalpha())
                    seen[of] += map(_closings.__getitem__, chunks[first : None if i < final else -1])
                    if i < final:
                        ends[of, _closings[chunks[-1]]] += 1
                    if not plain:  # wide letters are words of their own: count those inside a run
                        seen[of] += ["C"] * sum(len(_WIDE.findall(c)) for c in chunks if not c.isascii())
                last = lines[-1][-1]
                tokens = _WORDS.findall(body.lower())
                tail = _TAIL.search(last)
                word = tail[0].lower() if tail and tail[0].isalpha() and not _WIDE.search(tail[0]) else None
                vocabulary.update(filter(str.isalpha, tokens))
                if word is not None and tokens[-1] == word:
                    vocabulary[word] -= 1
                fences = len(_FENCE.findall(text)) if "```" in text or "~~~" in text else 0
                ticks = body.rpartition("\n")[2].count("`")
                is_open = fences % 2 == 1 or (fences == 0 and ticks % 2 == 1)
                held.append(tokens)
                out.append(["doc", doc, source, digest, max(0, len(tokens) - SHINGLE + 1), kind(lines[-1]), closing(last), word, is_open, body[-1] in STOPS, None, None, None])
                if len(held) >= 256:
                    sign(held, out)
                    held = []
            sign(held, out)
            out.extend(("line", None, None, None, None, k, c, None, None, None, None, n, ends[k, c]) for k, per in seen.items() for c, n in Counter(per).items())
            out.extend(("word", None, None, None, None, None, None, w, None, None, None, n, None) for w, n in vocabulary.items() if n > 0)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), _FIELDS)], [n for n, _ in _FIELDS])

    source = spread(
        documents.filter("text is not null").select(
            F.col("doc_id").cast("bigint"), F.lower(trimmed(F.col("source"))).alias("source"), F.md5(F.col("text").cast("binary")).alias("digest"), "text"
        )
    )
    return source.mapInArrow(run, _DDL)


def texts_of(scanned: DataFrame) -> DataFrame:
    """A row per distinct text, under the least of its ids."""
    first = [F.first(c).alias(c) for c in ("kind", "closing", "word", "is_open")]
    return scanned.filter("what = 'doc'").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *first)


def partial_words(scanned: DataFrame, texts: DataFrame) -> DataFrame:
    """`word`: last words of texts that only begin longer words and hardly stand anywhere else.

    The beginnings of longer words are looked up only at the lengths that candidates have, and as
    hashes, so a run of very many letters makes no row of more than its own size.
    """
    known = cut(scanned.filter("what = 'word'").groupBy("word").agg(F.sum("n").alias("known")))
    same_word = texts.filter("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("same_word"))
    rare = cut(same_word.join(known, "word", "left").na.fill(0, ["known"]).filter("known <= 3 * same_word"))
    # as many numbers as there are different lengths of words
    lengths = sorted(r[0] for r in rare.select(F.length("word")).distinct().collect())
    at = lambda n: F.struct(n.alias("size"), F.xxhash64(F.substring(F.col("word"), F.lit(1), n)).alias("start"))
    shorter = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n < F.length("word"))
    begun = known.select(F.explode(F.transform(shorter, at)).alias("x"), "known").groupBy("x").agg(F.sum("known").alias("longer"))
    return (
        rare.withColumn("x", at(F.length("word")))
        .join(begun, "x")
        .filter(F.col("longer") >= F.when(F.col("known") == 0, 3).otherwise(20 * F.col("known")))
        .select("word")
    )


def terminality(scanned: DataFrame, texts: DataFrame) -> DataFrame:
    """`digest, doc_id, is_open, terminal, is_word`: how well each distinct text's close ends a line of its kind.

    `terminal` is the share of the closing's occurrences in lines of the kind that end one, other
    texts' ends among them and the text's own left out, smoothed by how lines of the kind end: a
    property of kind and closing, so texts are not grouped for it, only looked up. `is_word` is
    false where the text ends in letters that only begin longer words.
    """
    partial = cut(partial_words(scanned, texts).withColumn("partial", F.lit(True)))
    texts = attach(texts, partial, ["word"], by="digest").withColumn("partial", F.coalesce("partial", F.lit(False)))
    inner = scanned.filter("what = 'line'").groupBy("kind", "closing").agg(F.sum("n").alias("n"), F.sum("n_ends").alias("n_ends"))
    finals = texts.groupBy("kind", "closing").agg(F.sum(F.when(F.col("partial"), 0).otherwise(1)).alias("finals"))
    closes = cut(finals.join(inner, ["kind", "closing"], "full").na.fill(0, ["finals", "n", "n_ends"]))
    signed = F.col("closing").rlike(r"[^\p{L}\p{N}]$")
    of_kind = closes.groupBy("kind").agg(
        F.sum(F.when(signed, 0).otherwise(F.col("n_ends") + F.col("finals"))).alias("bare"), F.sum(F.col("n_ends") + F.col("finals")).alias("all_ends")
    )
    of_closing = closes.groupBy("closing").agg(F.sum(F.col("n_ends") + F.col("finals")).alias("any_ends"), F.sum(F.col("n") + F.col("finals")).alias("any"))
    others = F.col("finals") - 1
    # what a closing does in lines of any kind tells of a kind that seldom has it; of a closing
    # that is nowhere else, how lines of the kind end: with a sign or with a bare word
    alone = F.when(signed, 0.5).otherwise((F.col("bare") - 1) / F.greatest(F.col("all_ends") - 1, F.lit(1)))
    prior = (F.col("any_ends") - 1 + alone) / F.col("any")
    terminal = (F.col("n_ends") + others + SMOOTHING * prior) / (F.col("n") + others + SMOOTHING)
    judged = cut(closes.filter("finals > 0").join(of_kind, "kind").join(of_closing, "closing").select("kind", "closing", terminal.alias("terminal")))
    return attach(texts, judged, ["kind", "closing"], by="digest").select(
        "digest", "doc_id", "is_open", F.when(~F.col("partial"), F.col("terminal")).alias("terminal"), (~F.col("partial")).alias("is_word")
    )


def candidates(scanned: DataFrame) -> DataFrame:
    """Rows `key, unit, id, as_copy, as_other, band, k0 ...`: all texts to be compared, bucket by bucket.

    A bucket (`key`) has the texts without a stop at their end (copies) that are looked up there, and
    all texts whose first part is like them. Its copies and its texts are dealt over blocks of about
    `BUCKET` or `BLOCK_SHINGLES`, and a `unit` is one block of copies (number `as_copy`, null for other texts) and one of
    texts (`as_other`): `as_copy << 32 | as_other`. Every copy meets every text of its bucket in one
    unit. `k0 ...` are the text's keys of all bands at this step, so that a pair that shares several
    buckets is told apart. Exact copies go by the least id.
    """
    rows = scanned.filter("what = 'doc' and steps is not null")
    width = 1 + BANDS
    asked = cut(rows.filter("not is_stopped").select(F.explode(F.slice("steps", -BANDS, BANDS)).alias("key")).distinct())
    n_steps = (F.size("steps") / width).cast("int")
    entry = lambda k: F.slice("steps", k * width + 2, F.lit(BANDS))
    each = rows.select(
        "doc_id", "digest", "n_shingles", "is_stopped", n_steps.alias("n_steps"), F.posexplode(F.transform(F.sequence(F.lit(0), n_steps - 1), entry)).alias("step", "keys")
    ).select("doc_id", "digest", "n_shingles", (~F.col("is_stopped") & (F.col("step") == F.col("n_steps") - 1)).alias("is_copy"), "keys", F.posexplode("keys").alias("band", "key"))
    near = each.join(F.broadcast(asked) if small(asked) else asked, "key", "left_semi")
    near = near.select("key", "digest", "doc_id", "n_shingles", "is_copy", "band", *(F.col("keys")[k].alias(f"k{k}") for k in range(BANDS)))
    kept = [F.min(c).alias(c) for c in near.columns[3:]]  # alike in all of them
    members = cut(near.groupBy("key", "digest").agg(F.min("doc_id").alias("id"), *kept).drop("digest"))
    of_copies = lambda c: F.sum(F.when(F.col("is_copy"), c))
    blocks = lambda n, shingles: F.ceil(F.greatest(n / BUCKET, shingles / BLOCK_SHINGLES)).cast("bigint")
    n = F.count(F.lit(1))
    sizes = members.groupBy("key").agg(
        n.alias("n"), blocks(n, F.sum("n_shingles")).alias("n_others"), blocks(of_copies(F.lit(1)), of_copies(F.col("n_shingles"))).alias("n_copies")
    )
    # a copy alone in its bucket has nothing to be compared with
    placed = attach(members, cut(sizes.filter("n > 1").drop("n")), ["key"], by="id").filter("n_others is not null")
    placed = placed.withColumns({
        "as_copy": F.when(F.col("is_copy"), F.pmod(F.xxhash64("id"), F.col("n_copies"))), "as_other": F.pmod(F.xxhash64("id"), F.col("n_others")),
    })
    unit = lambda i, j: F.shiftleft(i, 32).bitwiseOR(j)
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    with_copies = F.transform(upto("n_copies"), lambda i: unit(i, F.col("as_other")))
    with_others = F.when(F.col("is_copy"), F.transform(upto("n_others"), lambda j: unit(F.col("as_copy"), j))).otherwise(F.array().cast("array<bigint>"))
    return placed.select(
        "key", F.explode(F.array_union(with_copies, with_others)).alias("unit"), "id", "as_copy", "as_other", "band", *(f"k{k}" for k in range(BANDS))
    )


class _Text:
    """A text without marks of a cut, its words, and hashes of their shingles: in order, and of each the places."""

    def __init__(self, text: str) -> None:
        self.text = unmarked(text)
        self.words = [w.lower() for w in _WORDS.findall(self.text)]
        code = codes(self.words)
        n = max(0, len(code) - SHINGLE + 1)
        self.hashes = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(SHINGLE):
                self.hashes = (self.hashes ^ (self.hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + code[k : n + k]
        self.distinct = np.unique(self.hashes)

    @cached_property
    def shingles(self) -> list[int]:
        return self.hashes.tolist()

    @cached_property
    def places(self) -> dict[int, list[int]]:
        at: dict[int, list[int]] = defaultdict(list)
        for j, s in enumerate(self.shingles):
            at[s].append(j)
        return at

    @cached_property
    def spans(self) -> list[re.Match]:
        return list(_WORDS.finditer(self.text))


class _Member(_Text):
    """A text of a unit of `candidates`."""

    def __init__(self, row: tuple) -> None:
        self.key, self.unit, self.id, text, self.as_copy, self.as_other, self.band, *self.keys = row
        super().__init__(text)


def _alike(copies: list[_Member], others: list[_Member], cut_only: bool) -> Iterator[tuple[_Member, list[tuple[_Member, float]]]]:
    """Each of `copies` and those of `others` that have `LEAST_SIMILAR` of its distinct shingles, with the share.

    All pairs are counted, over the shingles that they share, a block of others at a time. A pair is
    given in the first bucket that it shares. With `cut_only` pairs are left out where no alignment can
    end inside a sentence: where one does, the copy's last word has a word after it in the other text, or
    the one before its last is followed there by a longer word that begins like the last.
    """
    asked = {w for c in copies for w in c.words[-2:]}
    begin = 0
    while begin < len(others):
        end, size = begin, 0
        while end < len(others) and size < _MOST_AT_ONCE:
            size += len(others[end].distinct)
            end += 1
        block = others[begin:end]
        begin = end
        ids, keys = np.array([o.id for o in block]), np.array([o.keys for o in block])
        # of each asked word the words that follow it, and the texts where they do
        followed: defaultdict[str, defaultdict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, o in enumerate(block if cut_only else ()):
            for w, after in set(pairwise(o.words)):
                if w in asked:
                    followed[w][after].append(k)
        hashes = np.concatenate([o.distinct for o in block])
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], np.repeat(np.arange(len(block)), [len(o.distinct) for o in block])[order]
        for copy in copies:
            low = np.searchsorted(hashes, copy.distinct, "left")
            count = np.searchsorted(hashes, copy.distinct, "right") - low
            at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            share = np.bincount(owner[at], minlength=len(block)) / max(1, len(copy.distinct))
            near = (share >= LEAST_SIMILAR) & (ids != copy.id) & ~(keys[:, : copy.band] == np.array(copy.keys[: copy.band], np.int64)).any(axis=1)
            if cut_only and near.any():
                before, last = copy.words[-2:]
                goes_on = np.zeros(len(block), bool)
                for owners in followed.get(last, {}).values():
                    goes_on[owners] = True
                for after, owners in followed.get(before, {}).items():
                    if after.startswith(last):
                        goes_on[owners] = True
                near &= goes_on
            if near.any():
                yield copy, [(block[k], share[k].item()) for k in np.flatnonzero(near).tolist()]


def _compared(members: list[_Member], cut_only: bool) -> Iterator[tuple[int, int, float, bool]]:
    """The near-copies of one unit; with `cut_only` of each copy the first found that tells it is cut."""
    copies = [m for m in members if m.as_copy == m.unit >> 32]
    others = [m for m in members if m.as_other == m.unit & 0xFFFFFFFF]
    told = set()
    for copy, near in _alike(copies, others, cut_only):
        for other, like in near:
            if copy.id in told:
                break
            early = _ends_early(copy, other)
            if early or not cut_only:
                yield copy.id, other.id, like, early
            if early and cut_only:
                told.add(copy.id)


def near_copies(documents: DataFrame, scanned: DataFrame, cut_only: bool = False) -> DataFrame:
    """`doc_id, longer_id, similarity, is_cut`: texts without a stop at the end and what they are near-copies of.

    Exact copies are one text and go by the least of their ids. All pairs of a bucket are there, however
    large it is; with `cut_only` only pairs that tell of a cut, one or more for every `doc_id` that has any.
    `similarity` is the share of the copy's shingles that `longer_id` has, 0.8 at least. `is_cut` tells that
    `doc_id` ends inside a word or sentence of `longer_id`, marks of a cut left out. Texts of fewer than
    `LEAST_SHINGLES` shingles have no pairs, nor have copies that lack the beginning of the other text.
    """
    units = cut(candidates(scanned))
    text_of = documents.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    if small(units):
        units = F.broadcast(units)
    else:
        wanted = units.select("id").distinct()
        text_of = text_of.join(F.broadcast(wanted) if small(wanted) else wanted, "id", "left_semi")
    order = ["key", "unit", "id", "text", "as_copy", "as_other", "band", *(f"k{k}" for k in range(BANDS))]
    members = text_of.join(units, "id").select(*order).repartition("key", "unit").sortWithinPartitions("key", "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for _, unit in groupby(rows, lambda row: row[:2]):
            if found := list(_compared([_Member(row) for row in unit], cut_only)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], ["doc_id", "longer_id", "similarity", "is_cut"])

    return members.mapInArrow(run, "doc_id bigint, longer_id bigint, similarity double, is_cut boolean")


def aligned(text: str, longer: str) -> tuple[float, bool]:
    """(Share of the shingles of `text` that `longer` has, whether `text` ends inside a sentence of it)."""
    a, b = _Text(text), _Text(longer)
    like = len(np.intersect1d(a.distinct, b.distinct, assume_unique=True)) / max(1, len(a.distinct))
    return like, like >= LEAST_SIMILAR and _ends_early(a, b)


def _ends_early(copy: _Text, other: _Text) -> bool:
    """Whether `copy`, of which `other` has most shingles, ends inside a sentence of `other`."""
    a, b = copy.words, other.words
    if not a or copy.text[-1] in STOPS:
        return False

    def inside(j: int) -> bool:
        # the sentence of the word before `j` goes on with the word at `j`
        return j < len(b) and (j == 0 or not _BREAK.search(other.text, other.spans[j - 1].end(), other.spans[j].start() + 1))

    return _goes_on(a, b, *_last_block(copy, other), inside)


def _last_block(copy: _Text, other: _Text) -> tuple[int, int]:
    """Where the last matching block of two texts' words ends in each of them.

    Shared shingles (of a repeated one, the same occurrence in both) are the anchors; the longest
    chain of them that ascends in both sequences is the alignment.
    """
    a, b, at = copy.words, other.words, other.places
    seen: Counter = Counter()
    tops: list[int] = []  # least end in `b` of a chain of each length
    ends: list[tuple[int, int]] = []
    for i, s in enumerate(copy.shingles):
        if not (places := at.get(s, ())):
            continue
        n = seen[s]
        seen[s] = n + 1
        if n < len(places):
            k = bisect_left(tops, places[n])
            tops[k : k + 1] = [places[n]]
            ends[k : k + 1] = [(i, places[n])]
    if not ends:
        return 0, 0
    # the last entry is the end of a longest chain
    i, j = (x + SHINGLE for x in ends[-1])
    while i < len(a) and j < len(b) and a[i] == b[j]:
        i, j = i + 1, j + 1
    return i, j


def _goes_on(a: list[str], b: list[str], i: int, j: int, inside: Callable[[int], bool]) -> bool:
    """Whether the sentence of `b` goes on where `a` ends, the last anchored block ending at `i` and `j`."""

    def ends_at(i: int, j: int) -> bool:
        # all words of `a` are in the block, or all but the beginning of the next word of `b`
        return j < len(b) and (i == len(a) and inside(j) or i == len(a) - 1 and b[j] != a[i] and b[j].startswith(a[i]))

    if ends_at(i, j):
        return True
    # a last stretch without a shared shingle: words altered there, most of them still equal
    left = len(a) - i
    equal = 0
    window = b[j : j + 2 * left + SHINGLE]
    # the last word, or the one before it, must stand there
    blocks = SequenceMatcher(None, a[i:], window, autojunk=False).get_matching_blocks() if not {*a[i:][-2:]}.isdisjoint(window) else ()
    for x, y, size in blocks:
        equal += size
        if size and ends_at(i + x + size, j + y + size) and 2 * (equal + (i + x + size < len(a))) >= left:
            return True
    # or words left out before the last ones: these stand further on
    tail = a[-4:-1]
    return len(tail) == 3 and any(
        b[y - 2 : y + 1] == tail and (ends_at(len(a) - 1, y + 1) or b[y + 1] == a[-1] and ends_at(len(a), y + 2)) for y in _found(b, tail[2], j + 2, len(b) - 1)
    )


def _found(words: list[str], word: str, begin: int, end: int) -> Iterator[int]:
    """Where `word` stands from `begin` on, before `end`."""
    try:
        while True:
            yield (begin := words.index(word, begin, end))
            begin += 1
    except ValueError:
        return


def truncated(documents: DataFrame) -> DataFrame:
    """`doc_id, source, is_cut, sign, terminal`: a row per document with text.

    `sign` is `copy` (a near-copy goes on), `open` (a code block or span is left open), `word` (it
    ends inside a word), `sentence` (its last word ends no line) or null. Repeated texts are
    judged alike. Documents of null or blank text give no row.
    """
    scanned = cut(scan(documents))
    texts = cut(texts_of(scanned))
    judged = terminality(scanned, texts)
    copies = cut(near_copies(documents, scanned, cut_only=True).select("doc_id", F.lit(True).alias("by_copy")).distinct())
    sign = (
        F.when(F.col("by_copy"), "copy")
        .when(F.col("is_open"), "open")
        .when(~F.col("is_word"), "word")
        .when(F.col("terminal") < LEAST_TERMINAL, "sentence")
    )
    per_text = attach(judged, copies, ["doc_id"], by="digest").select("digest", sign.alias("sign"), "terminal")
    return (
        scanned.filter("what = 'doc'")
        .select("doc_id", "source", "digest")
        .join(per_text, "digest")
        .select("doc_id", "source", F.col("sign").isNotNull().alias("is_cut"), "sign", "terminal")
    )


def rates(found: DataFrame) -> DataFrame:
    """`source, n_documents, n_cut, share` of the result of `truncated`; sources as compared."""
    per = found.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.col("is_cut").cast("int")).alias("n_cut"))
    return per.withColumn("share", F.col("n_cut") / F.col("n_documents"))
