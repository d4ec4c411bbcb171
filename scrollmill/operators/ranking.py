"""Matching and BM25 of an expression's tree, over the frequencies of its phrases in a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from scrollmill.plans.query_language import Phrase

K1, B = 1.2, 0.75


def matches(tree, tf: dict[Phrase, Column]) -> Column:
    """Whether a row satisfies the tree, given the frequency of each phrase."""
    if isinstance(tree, Phrase):
        return tf[tree] > 0 if tree.tokens else F.lit(False)
    parts = [matches(p, tf) for p in tree.parts]
    if tree.op == "NOT":
        return parts[0] & ~reduce(lambda a, b: a | b, parts[1:])
    return reduce((lambda a, b: a & b) if tree.op == "AND" else (lambda a, b: a | b), parts)


def counted(tree, tf: dict[Phrase, Column], gate: Column | None = None) -> list[tuple[Phrase, Column]]:
    """Each phrase with the frequency by which it counts in a row that matches the tree.

    A phrase below an AND or NOT that the row does not satisfy (the row matched by another branch
    of an OR) counts as absent.
    """
    if isinstance(tree, Phrase):
        return [(tree, tf[tree] if gate is None else F.when(gate, tf[tree]).otherwise(0))] if tree.tokens else []
    if tree.op != "OR":
        own = matches(tree, tf)
        gate = own if gate is None else gate & own
    return [x for p in tree.parts for x in counted(p, tf, gate)]


def idf(rows: Column, having: Column) -> Column:
    """Weight of a phrase that `having` of `rows` have; a phrase of half of all or more weighs next to nothing."""
    value = F.when((rows > having) | (having == 0), F.ln((rows - having + 0.5) / (having + 0.5)))
    return F.when(value > 0, value).otherwise(1e-6)


def score(rows: Column, tokens: Column, own: Column, having: dict[Phrase, Column], found: list[tuple[Phrase, Column]]) -> Column:
    """BM25, negative: the least is best. Each phrase counts as often as it is in the expression.

    `rows` and `tokens` are of the whole corpus, `own` the tokens of the row.
    """
    norm = K1 * (1 - B) + own * (K1 * B * rows / F.greatest(tokens, F.lit(1)))
    terms = [tf * (idf(rows, having[p]) * (K1 + 1)) / (tf + norm) for p, tf in found]
    return -reduce(lambda a, b: a + b, terms)
