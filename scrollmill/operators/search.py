"""Ranked full-text search over chunks: expressions as columns, BM25, retry, priorities, snippets.

A search is two aggregating passes at most over the tokens: one row of corpus statistics, then
scores and the top rows. Only the rows that are kept get a snippet and their session's columns,
so text is read for as many rows as the limit allows. Statistics come from all chunks, whatever
role is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from scrollmill.functions.tokens import edits, spans, tokens
from scrollmill.operators import postings
from scrollmill.operators.postings import Index
from scrollmill.operators.ranking import counted, matches, score
from scrollmill.plans.query_language import MOST_NEAR, Phrase, Widening, expression, lenient, parse, phrases, widenable
from scrollmill.session import once, spread

MOST_RESULTS = 1000
#: Tokens in a snippet, and the sign where text is left out.
SNIPPET, LEFT_OUT = 24, " … "
_SOURCE = ["source_path", "source_file_id", "source_generation", "source_start", "source_end"]


def with_tokens(chunks: DataFrame) -> DataFrame:
    """`chunks` with `tokens` of the text; the form in which a store keeps them."""
    return chunks if "tokens" in chunks.columns else once(spread(chunks), "tokens", tokens(F.col("text")))


def frequency(phrase: Phrase, toks: Column) -> Column:
    """How often `phrase` occurs among the tokens of a row, overlapping occurrences each."""
    *head, last = phrase.tokens
    if not head:
        return F.size(F.filter(toks, (lambda x: x.startswith(last)) if phrase.prefix else (lambda x: x == last)))
    # consecutive tokens as one string: a lambda over positions would compute the tokens anew at each
    wanted = "\x1f".join(rf"\Q{t}\E" for t in phrase.tokens) + ("" if phrase.prefix else "\x1f")
    return F.regexp_count(F.concat(F.lit("\x1f"), F.array_join(toks, "\x1f"), F.lit("\x1f")), F.lit(f"(?<=\x1f)(?={wanted})"))


@dataclass
class Statistics:
    """Rows, tokens, and rows with each phrase of an expression."""

    rows: int
    tokens: int
    having: dict[Phrase, int]


def statistics(chunks: DataFrame, found: list[Phrase]) -> Statistics:
    """One pass over all chunks, folded to one row."""
    unique = list(dict.fromkeys(found))
    row = chunks.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("t"),
        *(F.coalesce(F.sum((frequency(p, F.col("tokens")) > 0).cast("int")), F.lit(0)).alias(f"p{i}") for i, p in enumerate(unique)),
    ).first()
    return Statistics(row["n"], row["t"], {p: row[f"p{i}"] for i, p in enumerate(unique)})


def hits(chunks: DataFrame | Index, text: str, kind: int | None = None) -> DataFrame:
    """All rows of `chunks` that satisfy the expression `text`, with `score`; of an index, of its narrow rows.

    `kind` (0 user, 1 assistant) filters rows after the statistics. An empty expression, or one
    without any token, has no hits. Null texts have no tokens and match nothing.
    """
    if isinstance(chunks, Index):
        return postings.hits(chunks, text, kind)
    tree = parse(text)
    found = phrases(tree) if tree else []
    source = with_tokens(chunks)
    if not found:
        return source.withColumn("score", F.lit(0.0)).filter(F.lit(False))
    stats = statistics(source, found)
    tf = {p: F.col(f"_tf{i}") for i, p in enumerate(dict.fromkeys(found))}
    rows = source.select("*", *(frequency(p, F.col("tokens")).alias(f"_tf{i}") for i, p in enumerate(tf)))
    kept = rows.filter(matches(tree, tf))
    if kind is not None:
        kept = kept.filter(F.col("kind") == kind)
    value = score(F.lit(stats.rows), F.lit(stats.tokens), F.size("tokens"), {p: F.lit(n) for p, n in stats.having.items()}, counted(tree, tf))
    return kept.withColumn("score", value).drop(*(f"_tf{i}" for i in range(len(tf))))


_ORDER = ["score", "agent", "native_id", "ordinal", "chunk_id"]


def ranked(found: DataFrame, limit: int) -> DataFrame:
    """The best rows in order; the limit is a part of search and at most `MOST_RESULTS`."""
    return found.orderBy(*_ORDER).limit(max(0, min(limit, MOST_RESULTS)))


def vocabulary(chunks: DataFrame | Index) -> DataFrame:
    """`term, n_chunks, n_occurrences` of every token."""
    if isinstance(chunks, Index):
        return chunks.vocabulary()
    terms = with_tokens(chunks).select(F.explode("tokens").alias("term"), "chunk_id")
    per = terms.groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("term").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n").alias("n_occurrences"))


def near_words(terms: DataFrame, word: str) -> list[str] | None:
    """Indexed words close to `word`, best first, or None if it is itself indexed.

    `terms` is a `vocabulary`. Candidates begin with the word's first letter or with its first two
    swapped, and do not begin with the word; one edit is allowed below eight letters, two from
    there on; closest first, then the most widespread, then by the alphabet.
    """
    most = 2 if len(word) >= 8 else 1
    starts = F.col("term").startswith(word[:1])
    if len(word) > 1:
        starts = starts | F.col("term").startswith(word[1] + word[0])

    @F.pandas_udf("int")
    def distance(candidates: pd.Series) -> pd.Series:
        return candidates.map(lambda c: edits(word, c, most)).astype("Int32")

    # an edit of this measure is two of Levenshtein's at most, so this filter loses none
    close = terms.filter(starts).filter((F.col("term") == word) | (F.levenshtein("term", F.lit(word)) <= 2 * most))
    # longer forms of the word are no candidates; the word itself comes first, as nothing is closer
    near = close.filter((F.col("term") == word) | ~F.col("term").startswith(word))
    measured = near.withColumn("d", distance("term")).filter("d is not null")
    found = [r["term"] for r in measured.orderBy(F.col("d"), F.col("n_chunks").desc(), "term").select("term").limit(MOST_NEAR).collect()]
    return None if word in found else found


@dataclass
class Outcome:
    """Results in order, and what was widened to get them."""

    results: DataFrame
    widened: list[Widening] = field(default_factory=list)

    @property
    def prioritized(self) -> int:
        """How many lead by priority; counted when asked."""
        return self.results.filter("grp is not null").count() if "grp" in self.results.columns else 0

    def per_group(self) -> list[tuple[int, int]]:
        """(group, how many results it leads with), in the order of the list."""
        if "grp" not in self.results.columns:
            return []
        counted_ = self.results.filter("grp is not null").groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
        return [(r["grp"], r["n"]) for r in counted_.orderBy("grp").collect()]  # at most as many as results

    def approximation(self) -> str | None:
        return "; ".join(map(str, self.widened)) or None


def search(chunks: DataFrame | Index, query: str, limit: int = 50, kind: int | None = None, fallback: bool = True, priorities: DataFrame | None = None) -> Outcome:
    """Ranked search for what a user typed.

    Only if the exact expression has no row (after the role filter) is it tried again with words
    that are not indexed widened to near ones. `priorities` (`agent, native_id, grp`) lifts the
    best chunk of each listed session to the front, lowest group first.
    """
    source = chunks if isinstance(chunks, Index) else with_tokens(chunks)
    text = expression(query)
    widened: list[Widening] = []
    if not query.strip() or limit <= 0:
        return Outcome(hits(source, "", kind))
    found = hits(source, text, kind)
    if fallback and widenable(query) and found.isEmpty():
        terms = vocabulary(source)
        if not isinstance(source, Index):
            terms = terms.persist()
        retry = lenient(query, lambda w: near_words(terms, w))
        if not isinstance(source, Index):
            terms.unpersist()
        if retry is not None:
            found, widened = hits(source, retry[0], kind), retry[1]
            if found.isEmpty():
                return Outcome(found)
    if priorities is None:
        return Outcome(ranked(found, limit), widened)
    return Outcome(lifted(found, priorities, limit, source.chunks if isinstance(source, Index) else None), widened)


def lifted(found: DataFrame, priorities: DataFrame, limit: int, chunks: DataFrame | None = None) -> DataFrame:
    """Hits with the best chunk of each prioritized session first, then the rest, `limit` in all.

    The rest leaves out rows of the same source range as a lifted one: the parts of one long turn
    share it. Of several groups for a session the lowest counts; the first 1000 by group and
    session are taken. Columns of `found` and `grp`, null for the rest, and `place` from 0.
    Narrow hits need `chunks`, which tells the source ranges of theirs.
    """
    cap = max(0, min(limit, MOST_RESULTS))
    groups = priorities.groupBy("agent", "native_id").agg(F.min("grp").alias("grp")).orderBy("grp", "agent", "native_id").limit(MOST_RESULTS)
    row = F.struct(*[F.col(c) for c in found.columns])
    best = found.join(F.broadcast(groups), ["agent", "native_id"]).groupBy("agent", "native_id", "grp").agg(F.min_by(row, F.struct("score", "ordinal", "chunk_id")).alias("r"))
    first = best.select("r.*", "grp").orderBy("grp", "score", "agent", "native_id").limit(cap)
    # at most `cap` rows are lifted, so as many again are enough for the rest
    same = lambda c: F.col(f"x.{c}").eqNullSafe(F.col(f"l.{c}"))
    if chunks is None:
        left = found.alias("x").join(F.broadcast(first.select(*_SOURCE).distinct().alias("l")), [same(c) for c in _SOURCE], "left_anti")
    else:
        # the ids of all parts of the lifted turns: a scan of narrow columns against `cap` rows
        where = chunks.select("chunk_id", *_SOURCE)
        own = where.join(F.broadcast(first.select("chunk_id")), "chunk_id").select(*_SOURCE).distinct()
        parts = where.alias("x").join(F.broadcast(own.alias("l")), [same(c) for c in _SOURCE], "left_semi").select("chunk_id")
        left = found.join(parts, "chunk_id", "left_anti")
    rest = left.orderBy(*_ORDER).limit(cap)
    both = first.unionByName(rest.withColumn("grp", F.lit(None).cast(first.schema["grp"].dataType)))
    order = Window.orderBy(F.col("grp").isNull(), F.col("grp"), *_ORDER)
    # at most two thousand rows are left here, so one task may number them
    return both.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < cap)


def with_sessions(results: DataFrame, sessions: DataFrame) -> DataFrame:
    """Results with their session's provenance; a chunk whose session has no row is dropped.

    Only the rows of the results' sessions are compared; results are as many as a limit allows.
    """
    sessions = sessions.join(F.broadcast(results.select("agent", "native_id").distinct()), ["agent", "native_id"], "left_semi")
    wanted = ["agent", "native_id", "cwd", "repository", "repository_root", "worktree", "branch", "commit_hash", "started_at", "ended_at", "git_observed_at", "git_origin", "repository_url"]
    newest = sessions.groupBy("agent", "native_id").agg(F.max_by(F.struct(*wanted[2:]), F.struct(F.coalesce("source_generation", F.lit(-1)), F.coalesce("source_end", F.lit(-1)))).alias("s"))
    return results.join(newest, ["agent", "native_id"]).select(results["*"], "s.*")


def _windows(words: list[str], found: list[Phrase]) -> list[tuple[int, int, int]]:
    out = []
    for k, p in enumerate(found):
        n = len(p.tokens)
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n - 1]) == p.tokens[:-1] and (words[i + n - 1].startswith(p.tokens[-1]) if p.prefix else words[i + n - 1] == p.tokens[-1]):
                out.append((i, n, k))
    return sorted(out)


def snippet(text: str, found: list[Phrase], size: int = SNIPPET) -> str:
    """The stretch of `size` tokens that shows most different phrases, sentence starts preferred."""
    toks = spans(text)
    if not toks:
        return text
    places = _windows([t for _, _, t in toks], found)

    def worth(start: int) -> tuple[int, int]:
        seen, value, first, last = set(), 0, None, start
        for i, n, k in places:
            if start <= i < start + size:
                value += 1 if k in seen else 1000
                seen.add(k)
                first = i if first is None else first
                last = max(last, i + n)
        first = start if first is None else first
        return value, max(0, min(first - (size - (last - first)) // 2, len(toks) - size))

    heads = [0]
    for i in range(1, len(toks)):
        gap = text[toks[i - 1][1] : toks[i][0]].rstrip()
        if gap[-1:] in (".", ":") and text[toks[i][0] - 1].isspace():
            heads.append(i)
    best, start = 0, 0
    for i, _, _ in places:
        value, centred = worth(i)
        if value > best:
            best, start = value, centred
        head = max(h for h in heads if h <= i)
        if head < i:
            value, _ = worth(head)
            value += 120 if head == 0 else 100
            if value > best:
                best, start = value, head
    end = start + size
    left = text[toks[start][0] :] if start else text
    right = len(text) if end >= len(toks) else toks[end - 1][1]
    cut = text[len(text) - len(left) : right]
    return (LEFT_OUT if start else "") + cut + (LEFT_OUT if end < len(toks) else "")


def with_snippets(results: DataFrame, text: str) -> DataFrame:
    """`results` (at most as many as a limit allows) with a `snippet` for the expression `text`."""
    tree = parse(text)
    found = phrases(tree) if tree else []

    @F.pandas_udf("string")
    def make(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else snippet(t, found))

    return results.withColumn("snippet", make("text"))


def ranges(line: str, terms: list[str]) -> list[tuple[int, int]]:
    """Byte ranges of whole words of `line` that equal a term, or begin with it if it ends in `*`; no folding of accents."""
    whole = {t.lower() for t in terms if not t.endswith("*")}
    begins = tuple(t[:-1].lower() for t in terms if len(t) > 1 and t.endswith("*"))
    out, at, i = [], 0, 0
    while i < len(line):
        j = i
        while j < len(line) and line[j].isalnum():
            j += 1
        word = line[i : max(j, i + 1)]
        size = len(word.encode())
        if j > i and (word.lower() in whole or (begins and word.lower().startswith(begins))):
            out.append((at, at + size))
        at += size
        i = max(j, i + 1)
    return out


def with_ranges(results: DataFrame, terms: list[str]) -> DataFrame:
    """`results` with `marks`: the byte ranges of `snippet` to mark."""

    @F.pandas_udf("array<struct<first:int,last:int>>")
    def make(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"first": a, "last": b} for a, b in ranges(t or "", terms)])

    return results.withColumn("marks", make("snippet"))


def output_lines(results: DataFrame) -> DataFrame:
    """A TAB-separated line per result: rank, agent, role, repo / branch, session, time, source, snippet."""
    rank = F.row_number().over(Window.orderBy(*_ORDER))  # over as many rows as a limit allows
    where = F.concat_ws(" / ", F.coalesce("repository", F.lit("-")), F.coalesce("branch", F.lit("-")))
    fraction = F.date_format("timestamp", "SSS")
    time = F.concat(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction != "000", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("+00:00")
    )
    return results.select(
        F.concat_ws(
            "\t",
            rank,
            F.when(F.col("agent") == 0, "claude").otherwise("codex"),
            F.when(F.col("kind") == 0, "user").otherwise("assistant"),
            where,
            "native_id",
            F.coalesce(time, F.lit("-")),
            F.concat(F.coalesce("source_path", F.lit("")), F.lit(":"), F.col("source_start"), F.lit("-"), F.col("source_end")),
            F.regexp_replace(F.coalesce("snippet", F.lit("")), r"[\p{Cc}]", " "),
        ).alias("line")
    )


def percentiles(times: DataFrame, value: str, at: list[int]) -> DataFrame:
    """`p, value` for each percent of `at`: the value at place n * p / 100 of the sorted ones, at most the last."""
    kept = times.select(F.col(value).alias("value")).filter("value is not null")
    n = kept.agg(F.count(F.lit(1)).alias("n"))
    wanted = n.select(F.explode(F.array(*map(F.lit, at))).alias("p"), F.least(F.floor(F.col("n") * F.col("p") / 100), F.col("n") - 1).cast("bigint").alias("place"))
    # values counted by how often they occur: what is put in one order is the different values
    counted_ = kept.groupBy("value").agg(F.count(F.lit(1)).alias("c"))
    upto = counted_.withColumn("upto", F.sum("c").over(Window.orderBy("value")))
    hit = upto.join(F.broadcast(wanted), (F.col("place") >= F.col("upto") - F.col("c")) & (F.col("place") < F.col("upto")))
    return hit.select("p", "value")
