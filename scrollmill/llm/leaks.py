"""Evaluation items that leaked into training text, found by spaced-seed hashing.

A spaced seed is a mask over consecutive words: some positions count, the others may be anything,
so a text with words replaced still meets the item at seeds whose ignored positions hold the
replacements. All seeds of the test items are hashed under every mask; a training document is
hashed in the same way and its hashes are joined with those of the items. Hits that lie near one
diagonal (the same offset between document and item) and close together are chained, the passage
around a chain is aligned with the item, and the words of the item that it holds are counted:
equal words and single replaced ones between them. A document holds an item if these are a third
of the item's own words or more.

Items may be built from few patterns, and so may texts that leak nothing. A word of an item that
stands in no pair of neighbours common among items is one of its telling words (in items without
patterns every word is); words count as held only where most telling words around them are equal.
Every seed of own words may start a chain, however many items share it: what a pair of document and
item can hold at most is counted for all pairs of a batch at once, and only pairs that can reach
the share are aligned. A sentence that many items have is no item's own words. Items of fewer words
than a seed are held where they stand word for word.

Items of equal words are one class, reported under each of its ids; near-equal classes are one
family, and what items share is counted by families, so variants of one item don't count as many.

The items are a stated query set against all rows: their hash table goes to every task in blocks
of bounded size (`BLOCK_WORDS`), so one pass over the documents is made for each block, and
nothing of the documents is shuffled.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from scrollmill.llm.words import codes, words
from scrollmill.session import spread

#: Offsets of the words that count, mask by mask: four words within at most six.
MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4), (0, 1, 3, 5), (0, 2, 3, 5), (0, 2, 4, 5), (0, 1, 4, 5))
#: Share of an item's own words that a document must hold.
LEAST_SHARE = 1 / 3
#: Families that may share a sentence, as a share of all, before it is nobody's own.
SHARED = 0.01
#: Most words between two hits of one chain, and by how much their diagonals may differ.
GAP, DRIFT = 8, 2
#: Words from a hit to the end of the one that a chain may put next to it.
REACH = GAP + 2 * MASKS[-1][-1]
#: Families that may share a pair of neighbours, as a share of all, before it is a pattern's.
PATTERN = 0.05
#: Similarity of the four-word runs of two items from which they are variants of one.
ALIKE = 0.8
#: Telling words nearest to a word of which most must be equal.
AROUND = 6
#: Words by which an aligned passage may be longer than the item at either end.
SLACK = 10
#: Words of items in one block: about 150 bytes a word, so at most 75 MB a task.
BLOCK_WORDS = 500_000

_SENTENCE = re.compile(r"(?<=[.?!。？！])[\"'”’)\]]*\s+")
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_SHIFT = np.uint64(32)


def seeds(code: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hash of the words under `mask` at each position where it fits."""
    n = len(code) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for o, k in zip(mask, _ODD):
            h = (h ^ code[o : o + n]) * k
            h ^= h >> _SHIFT
        return h * _MIX


class Index:
    """The seeds of a block of items (ids, sentences), their own and their telling words."""

    def __init__(self, items: list[tuple[list[int], list[list[str]]]], common: set, patterns: set) -> None:
        self.ids = [i for i, _ in items]
        self.code, self.own, self.telling, self.bounds = [], [], [], []
        entries: list[list[tuple[int, int, int]]] = [[] for _ in MASKS]
        for k, (_, sentences) in enumerate(items):
            tokens, own, telling, bounds = [], [], [], []
            for s in sentences:
                bounds.append(len(tokens))
                tokens += s
                own += [tuple(s) not in common] * len(s)
                pairs = [False, *((x in patterns) for x in zip(s, s[1:])), False]
                telling += [not a and not b for a, b in zip(pairs, pairs[1:])]
            self.bounds.append(bounds)
            self.code.append(codes(tokens))
            self.own.append(np.array(own, bool))
            self.telling.append(np.array(telling, bool) & self.own[-1])
            for m, mask in enumerate(MASKS):
                for pos, h in enumerate(seeds(self.code[-1], mask).tolist()):
                    if self.own[-1][[pos + o for o in mask]].all():
                        entries[m].append((h, k, pos))
        self.tables = []
        for kept in map(sorted, entries):
            self.tables.append(
                (np.array([r[0] for r in kept], np.uint64), np.array([r[1] for r in kept], np.int32), np.array([r[2] for r in kept], np.int32))
            )
        # of each sentence its words and the places of its telling ones
        spans = [list(zip(b, [*b[1:], len(c)])) for b, c in zip(self.bounds, self.code)]
        self.words = [[c[lo:hi].tolist() for lo, hi in x] for c, x in zip(self.code, spans)]
        self.tell_places = [[np.flatnonzero(t[lo:hi]) for lo, hi in x] for t, x in zip(self.telling, spans)]
        self.needed = [[int(_least_telling(len(t))) for t in x] for x in self.tell_places]
        self.kept: dict[tuple[int, int], tuple] = {}
        # all items in a row: where each begins, the sentence of each word, and a sentence's own words
        self.offset = np.cumsum([0, *(len(c) for c in self.code)])
        starts = [np.array(b, np.int64) + o for b, o in zip(self.bounds, self.offset)]
        starts = np.concatenate(starts) if starts else np.empty(0, np.int64)
        self.sentence = np.repeat(np.arange(len(starts)), np.diff([*starts, self.offset[-1]])) if len(starts) else np.empty(0, np.int64)
        own_at = np.concatenate(self.own) if self.own else np.empty(0, bool)
        self.is_own, self.own_words = own_at, np.bincount(self.sentence, own_at, len(starts))
        self.n_own = np.array([int(o.sum()) for o in self.own])
        # the telling words of each sentence, as places in the list of all of them
        tells = np.concatenate(self.telling) if self.telling else np.empty(0, bool)
        all_code = np.concatenate(self.code) if self.code else np.empty(0, np.uint64)
        self.tell_words, self.tells = np.unique(all_code[tells], return_inverse=True)
        self.n_tells = np.bincount(self.sentence[tells], minlength=len(starts)).astype(np.int64)
        self.tell_at = np.cumsum([0, *self.n_tells])
        # of each word where among its sentence's telling words the nearest begin and end
        near = [self.around(k, x)[1:3] for k, xs in enumerate(self.words) for x in range(len(xs))]
        self.near = tuple(np.array([i for pair in near for i in pair[side]], np.int64) for side in (0, 1))
        self.first_word = np.cumsum([0, *np.bincount(self.sentence, minlength=len(starts))]).astype(np.int64)
        # of each mask a table of bits by which most seeds of a document are known to be no item's
        self.shift, self.bits = [], []
        for hashes, _, _ in self.tables:
            size = min(26, max(16, (16 * len(hashes)).bit_length()))
            bits = np.zeros(1 << size, bool)
            bits[(hashes >> np.uint64(64 - size)).astype(np.int64)] = True
            self.shift.append(np.uint64(64 - size))
            self.bits.append(bits)

    def around(self, k: int, x: int) -> tuple:
        """Of sentence `x` of item `k`: places of its telling words, which of them are nearest to each word, a matcher."""
        if (out := self.kept.get((k, x))) is None:
            tells = self.tell_places[k][x]
            width = min(AROUND, len(tells))
            left = np.clip(np.searchsorted(tells, np.arange(len(self.words[k][x]))) - width // 2, 0, len(tells) - width)
            out = self.kept[k, x] = tells.tolist(), left.tolist(), (left + width).tolist(), SequenceMatcher(None, [], self.words[k][x], autojunk=False)
        return out

    def whole(self, code: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, int]]:
        """(document, item) of items too short for a seed that a document has word for word."""
        for n in range(1, min(map(len, MASKS))):
            short = [i for i, c in enumerate(self.code) if len(c) == n and self.own[i].all()]
            if short:
                h = seeds(code, tuple(range(n)))
                for i in short:
                    at = np.flatnonzero(h == seeds(self.code[i], tuple(range(n)))[0])
                    for x in np.unique(np.searchsorted(begin, at, "right") - 1).tolist():
                        yield x, i

    def hits(self, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(document positions, items, item positions, mask) of the seeds that `code` shares with items."""
        for m, mask in enumerate(MASKS):
            hashes, item, pos = self.tables[m]
            h = seeds(code, mask)
            at = np.flatnonzero(self.bits[m][(h >> self.shift[m]).astype(np.int64)])
            if not len(at) or not len(hashes):
                continue
            lo, hi = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            n = hi - lo
            if not n.any():
                continue
            where = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(at, n), item[where], pos[where], m


def _least_telling(n: np.ndarray | int) -> np.ndarray:
    """How many of the telling words of a sentence that has `n` must be where it is held."""
    return np.minimum(n, np.maximum(2, np.minimum(AROUND, n) // 2 + 1))


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as `n` says, one range after the other."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def grouped(index: Index, code: np.ndarray, begin: np.ndarray, least_share: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(document, item, hits) of the pairs that can hold the share: `code` has all documents, `begin` their starts.

    A chain of hits meets sentences that lie within its reach of a hit, and of these only such
    count as have enough of their telling words anywhere in the document, and of their words such as
    are near these; a pair is left out if all that count are fewer own words than the share.
    """
    found = [(np.searchsorted(begin, d, "right") - 1, k, d, p, np.full(len(d), m)) for d, k, p, m in index.hits(code)]
    if not found:
        return
    doc, item, at, pos, mask = (np.concatenate(c).astype(np.int64) for c in zip(*found))
    pair, of = np.unique(doc * len(index.ids) + item, return_inverse=True)
    lo = index.sentence[index.offset[item] + pos]
    hi = index.sentence[np.minimum(index.offset[item] + pos + REACH, index.offset[item + 1] - 1)]
    n = hi - lo + 1
    met = np.unique(np.repeat(of, n) * len(index.own_words) + _ranges(lo, n))
    met_pair, sentence = met // len(index.own_words), met % len(index.own_words)
    if len(index.tell_words):
        # (document, telling word) as one number, of all that are there
        place = np.minimum(np.searchsorted(index.tell_words, code), len(index.tell_words) - 1)
        there = np.flatnonzero(index.tell_words[place] == code)
        present = np.unique((np.searchsorted(begin, there, "right") - 1) * len(index.tell_words) + place[there])
        n = index.n_tells[sentence]
        asked = np.repeat(pair[met_pair] // len(index.ids), n) * len(index.tell_words) + index.tells[_ranges(index.tell_at[sentence], n)]
        known = np.minimum(np.searchsorted(present, asked), max(0, len(present) - 1))
        held = np.concatenate([[0], np.cumsum(present[known] == asked)]) if len(present) else np.zeros(len(asked) + 1, np.int64)
        ends = np.cumsum(n)
        enough = held[ends] - held[ends - n] >= _least_telling(n)
        met_pair, sentence, base = met_pair[enough], sentence[enough], (ends - n)[enough]
        # words of these near enough telling words, were all equal that are in the document
        n = index.first_word[sentence + 1] - index.first_word[sentence]
        word = _ranges(index.first_word[sentence], n)
        left, right, base = index.near[0][word], index.near[1][word], np.repeat(base, n)
        same, width = held[base + right] - held[base + left], right - left
        can = (same >= np.minimum(2, width)) & ((2 * same > width) | (width == 0)) & index.is_own[word]
        most = np.bincount(np.repeat(met_pair, n), can, len(pair))
    else:
        most = np.bincount(met_pair, index.own_words[sentence], len(pair))
    kept = most >= least_share * index.n_own[pair % len(index.ids)]
    some = np.flatnonzero(kept[of])
    some = some[np.argsort(of[some], kind="stable")]
    ends = np.flatnonzero(np.diff(of[some], append=-1)) + 1
    for a, b in zip([0, *ends[:-1]], ends):
        rows = some[a:b]
        x = int(doc[rows[0]])
        yield x, int(item[rows[0]]), list(zip((at[rows] - begin[x]).tolist(), pos[rows].tolist(), mask[rows].tolist()))


def chains(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Hits (document position, item position, mask) chained: (first and last document position, same of the item)."""
    open_: list[list[int]] = []
    for d, p in sorted({(d, p) for d, p, _ in hits}):
        for c in reversed(open_):
            if d - c[1] > GAP + MASKS[-1][-1]:
                continue
            if 0 <= p - c[3] <= GAP + MASKS[-1][-1] and abs((d - p) - (c[1] - c[3])) <= DRIFT:
                c[1], c[3] = d, p
                break
        else:
            open_.append([d, d, p, p])
    return [tuple(c) for c in open_]


def verify(code: np.ndarray, index: Index, k: int, hits: list[tuple[int, int, int]], least: float = 0) -> int:
    """Own words of item `k` that the passages around the chains of `hits` hold; 0 if under `least`.

    Each sentence that a chain meets is aligned by itself with the stretch of the document where
    the chain puts it, so sentences may come in any order. Nothing is aligned if the sentences met
    have fewer own words than `least`.
    """
    item, own, bounds = index.code[k], index.own[k], index.bounds[k]
    done, met_, most = set(), [], Counter()
    chained = [(c, range(bisect_right(bounds, c[2]) - 1, bisect_right(bounds, c[3] + MASKS[-1][-1]))) for c in chains(hits)]
    met = {x for _, xs in chained for x in xs}
    if sum((bounds[x + 1] if x + 1 < len(bounds) else len(item)) - bounds[x] for x in met if own[bounds[x]]) < least:
        return 0
    for (first, last, p, q), xs in chained:
        for x in xs:
            lo, hi = bounds[x], bounds[x + 1] if x + 1 < len(bounds) else len(item)
            start, end = max(0, first - (p - lo) - SLACK), min(len(code), last + (hi - q) + SLACK)
            if not own[lo] or start >= end or (x, start // SLACK) in done:
                continue
            done.add((x, start // SLACK))
            tells, left, right, matcher = index.around(k, x)
            words_, passage = index.words[k][x], code[start:end].tolist()
            there = set(passage)
            known = [words_[i] in there for i in tells]
            if sum(known) < index.needed[k][x]:
                continue
            # words near enough telling words, were all that are in the passage equal
            upto, width = [0, *accumulate(known)], right[0] - left[0]
            can = sum([2 * (n := upto[b] - upto[a]) > width and n >= min(2, width) for a, b in zip(left, right)]) if tells else hi - lo
            if can:
                most[lo, hi] += can
                met_.append((lo, hi, tells, left, right, matcher, passage))
    if sum(min(n, hi - lo) for (lo, hi), n in most.items()) < least:
        return 0
    held = np.zeros(len(item), bool)
    for lo, hi, tells, left, right, matcher, passage in met_:
        matcher.set_seq1(passage)
        equal, joined, before = bytearray(hi - lo), bytearray(hi - lo), None
        for j, i, size in matcher.get_matching_blocks():
            if before is not None and size and 0 < i - before[0] <= 2 and j - before[1] <= 3:
                joined[before[0] : i] = b"\1" * (i - before[0])
            equal[i : i + size] = b"\1" * size
            before = (i + size, j + size)
        equal, joined = np.frombuffer(equal, bool), np.frombuffer(joined, bool)
        if tells:
            # of the telling words nearest to each word: how many are equal
            upto = np.concatenate([[0], np.cumsum(equal[tells])])
            same, width = upto[right] - upto[left], right[0] - left[0]
            held[lo:hi] |= (equal | joined) & (same >= min(2, width)) & (2 * same > width)
        else:  # a sentence of patterns alone tells nothing unless it is there as it is
            held[lo:hi] |= equal.all()
    n_held = int((held & own).sum())
    return n_held if n_held >= least else 0


def families(texts: list[list[str]]) -> list[int]:
    """For each text (its words) the number of its family: texts alike by `ALIKE`, over any steps.

    Exact: two sets so similar share one of the rarest of either, as many as they may differ by.
    """
    runs = [np.unique(seeds(codes(t), MASKS[0])) if len(t) >= 4 else np.array([xxhash.xxh64_intdigest(" ".join(t))], np.uint64) for t in texts]
    known, count = np.unique(np.concatenate(runs), return_counts=True) if runs else (np.empty(0, np.uint64), np.empty(0, np.int64))
    parent = list(range(len(texts)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    having: defaultdict[int, list[int]] = defaultdict(list)
    for x, r in enumerate(runs):
        n = count[np.searchsorted(known, r)]
        order = np.lexsort((r, n))[: len(r) - math.ceil(ALIKE * len(r) - 1e-9) + 1]
        tried = set()
        for h in r[order[n[order] > 1]].tolist():
            for y in having[h]:
                if y not in tried and top(x) != top(y):
                    both = len(np.intersect1d(r, runs[y], assume_unique=True))
                    if both >= ALIKE * (len(r) + len(runs[y]) - both):
                        parent[top(x)] = top(y)
                tried.add(y)
            having[h].append(x)
    return [top(x) for x in range(len(texts))]


def blocks(items: DataFrame) -> Iterator[Index]:
    """The indexes of `items` (`item_id, item_text`), each over at most `BLOCK_WORDS` words.

    Items are read as a stream of a partition at a time and folded into classes of equal words;
    sentences are counted over all of them, by family.
    """
    texts = ((r["item_id"], r["item_text"]) for r in items.select("item_id", "item_text").filter("item_id is not null").distinct().toLocalIterator())
    classes: dict[tuple, set[int]] = {}
    for i, t in texts:
        classes.setdefault(tuple(tuple(w) for s in _SENTENCE.split(t or "") if (w := words(s))), set()).add(i)
    family = families([[w for s in ss for w in s] for ss in classes])
    sentences: defaultdict[int, set[tuple]] = defaultdict(set)
    for f, ss in zip(family, classes):
        sentences[f].update(ss)
    shared = Counter(s for ss in sentences.values() for s in ss)
    least = max(2, round(SHARED * len(sentences)))
    common = {s for s, n in shared.items() if n > 2 * least}
    pairs = Counter(x for ss in sentences.values() for x in {x for s in ss if s not in common for x in zip(s, s[1:])})
    patterns = {x for x, n in pairs.items() if n > max(2 * least, PATTERN * len(sentences))}
    block, size = [], 0
    for ss, ids in classes.items():
        block.append((sorted(ids), [list(s) for s in ss]))
        size += sum(map(len, ss))
        if size >= BLOCK_WORDS:
            yield Index(block, common, patterns)
            block, size = [], 0
    if block:
        yield Index(block, common, patterns)


def leaks(documents: DataFrame, items: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """`doc_id, item_id, held_words, own_words, share`: the items that each document holds.

    Null and empty texts hold nothing; an item without own words is held by nothing; repeated
    documents count each; a document may hold many items. Whole texts are searched.
    """
    docs = spread(documents.select(F.col("doc_id").cast("bigint"), "text").filter("text is not null"))
    ddl = "doc_id bigint, item_id bigint, held_words int, own_words int, share double"
    found = None
    for index in blocks(items):
        handle = documents.sparkSession.sparkContext.broadcast(index)
        part = docs.mapInArrow(_search(handle, least_share), ddl)
        found = part if found is None else found.unionByName(part)
    return documents.sparkSession.createDataFrame([], ddl) if found is None else found


def _search(handle, least_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = handle.value
        apart = np.array([0] * 6, np.uint64)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first in range(0, len(ids), 256):
                code = [codes(words(t.as_py())) for t in batch.column(1)[first : first + 256]]
                # one array for all texts, with a stretch between them that is part of no seed
                starts, parts, at = [], [], 0
                for c in code:
                    starts.append(at)
                    parts += [c, apart]
                    at += len(c) + len(apart)
                begin = np.array(starts)
                flat = np.concatenate(parts)
                rows = []
                for x, i, hits in grouped(index, flat, begin, least_share):
                    own = int(index.n_own[i])
                    held = verify(code[x], index, i, hits, least_share * own)
                    if own and held >= least_share * own:
                        rows.extend((ids[first + x], item, held, own, held / own) for item in index.ids[i])
                for x, i in index.whole(flat, begin):
                    n = len(index.code[i])
                    rows.extend((ids[first + x], item, n, n, 1.0) for item in index.ids[i])
                if rows:
                    c = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.float64())],
                        ["doc_id", "item_id", "held_words", "own_words", "share"],
                    )

    return run
