"""The search mini-language: text typed by a user into an expression, and the expression into a tree.

Every character is literal but for double-quoted phrases, a trailing `*` for a prefix, and the
upper-case operators AND, OR and NOT between two terms. An expression binds, from tight to loose:
terms side by side, NOT, AND, OR.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from scrollmill.functions.tokens import token_list

OPERATORS = ("AND", "OR", "NOT")
#: A bare word of fewer characters is never widened; so many words are widened in one query, and
#: so many near words are searched for each.
LEAST_WIDENED, MOST_WIDENED, MOST_NEAR = 4, 8, 5

_QUOTED = re.compile(r'"((?:[^"]|"")*)(?:"(\**)|\Z)', re.S)


@dataclass
class Item:
    """A term (`text`, `prefix`, and `word` where it may be widened) or, with `op`, an operator."""

    text: str
    prefix: bool = False
    word: str | None = None
    op: bool = False
    near: list[str] | None = None

    def __str__(self) -> str:
        if self.op:
            return self.text
        if self.near is not None:
            return "(" + " OR ".join([_quote(self.word or "", True), *(_quote(w) for w in self.near)]) + ")"
        return _quote(self.text, self.prefix)


def _quote(text: str, prefix: bool = False) -> str:
    return '"' + text.replace('"', '""') + '"' + "*" * prefix


def split(query: str) -> list[str]:
    """Raw tokens: cut at white space outside double quotes."""
    out, run, quoted = [], [], False
    for c in query:
        quoted ^= c == '"'
        if c.isspace() and not quoted:
            out.append("".join(run))
            run = []
        else:
            run.append(c)
    return [t for t in [*out, "".join(run)] if t]


def classify(raw: str) -> Item:
    """What a raw token is: an operator, a quoted phrase, a prefix or a literal term."""
    if raw in OPERATORS:
        return Item(raw, op=True)
    if (m := _QUOTED.match(raw)) and m.end() == len(raw):
        return Item(m[1].replace('""', '"'), prefix=bool(m[2]))
    body = raw.rstrip("*")
    if not body:
        return Item(raw)
    bare = body == raw and len(body) >= LEAST_WIDENED and body.isalnum() and any(c.isalpha() for c in body)
    return Item(body, prefix=body != raw, word=body.lower() if bare else None)


def items(query: str) -> list[Item]:
    """The query's terms, with operators where they stand between two terms and words where not."""
    raw = [classify(t) for t in split(query)]
    out: list[Item] = []
    for i, item in enumerate(raw):
        after = raw[i + 1] if i + 1 < len(raw) else None
        follows = bool(out) and not out[-1].op
        if not item.op:
            out.append(item)
        elif item.text == "AND" and follows and after is not None and after.op and after.text == "NOT":
            continue
        elif follows and after is not None and not after.op:
            out.append(item)
        else:
            out.append(Item(item.text))
    return out


def render(found: list[Item]) -> str:
    """The expression of `found`; a widened group takes an explicit AND beside a term."""
    out: list[str] = []
    for before, item in zip([None, *found], found):
        if before is not None and not before.op and not item.op and (before.near is not None or item.near is not None):
            out.append("AND")
        out.append(str(item))
    return " ".join(out)


def expression(query: str) -> str:
    """The exact expression of a query."""
    return render(items(query))


@dataclass
class Widening:
    """A typed word and the indexed words searched in its place."""

    typed: str
    near: list[str] = field(default_factory=list)

    def __str__(self) -> str:
        return f"{self.typed} → {', '.join([*self.near, self.typed + '*'])}"


def widenable(query: str) -> list[str]:
    """The words that a lenient retry may ask about, each once, in order."""
    found = items(query)
    words = [i.word for before, i in zip([None, *found], found) if i.word and not (before is not None and before.op and before.text == "NOT")]
    return list(dict.fromkeys(words))


def lenient(query: str, near: Callable[[str], list[str] | None]) -> tuple[str, list[Widening]] | None:
    """The expression of the retry and what was widened, or None if no word can be.

    `near` tells for a word the indexed words close to it, or None to keep it as it is.
    """
    found = items(query)
    asked: dict[str, list[str] | None] = {}
    for before, item in zip([None, *found], found):
        if item.word is None or (before is not None and before.op and before.text == "NOT"):
            continue
        if item.word not in asked:
            if sum(v is not None for v in asked.values()) >= MOST_WIDENED:
                continue
            asked[item.word] = near(item.word)
        item.near = asked[item.word]
    widened = [Widening(w, n) for w, n in asked.items() if n is not None]
    return (render(found), widened) if widened else None


@dataclass(frozen=True)
class Phrase:
    """Consecutive tokens, the last perhaps a prefix; without tokens it matches nothing."""

    tokens: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Node:
    """`op` of AND, OR, NOT over `parts`."""

    op: str
    parts: tuple


_LEXEME = re.compile(r'"((?:[^"]|"")*)"(\*?)|(AND|OR|NOT)\b|([()])|\s+')


def parse(text: str) -> Phrase | Node | None:
    """The tree of an expression; None for an empty one.

    A phrase without tokens is dropped among terms side by side; elsewhere it matches nothing.
    """
    lexemes = [m for m in _LEXEME.finditer(text) if m[0].strip()]
    at = 0

    def peek() -> str | None:
        if at >= len(lexemes):
            return None
        m = lexemes[at]
        return m[3] or m[4] or "phrase"

    def chain(op: str, part):
        nonlocal at
        parts = [part()]
        while peek() == op:
            at += 1
            parts.append(part())
        return parts[0] if len(parts) == 1 else Node(op, tuple(parts))

    def side_by_side():
        nonlocal at
        parts = []
        while peek() in ("phrase", "("):
            m = lexemes[at]
            at += 1
            if m[4]:
                parts.append(chain("OR", lambda: chain("AND", lambda: chain("NOT", side_by_side))))
                at += 1  # the closing one
            else:
                parts.append(Phrase(tuple(token_list(m[1].replace('""', '"'))), bool(m[2])))
        full = [p for p in parts if not isinstance(p, Phrase) or p.tokens] or parts[:1]
        return full[0] if len(full) == 1 else Node("AND", tuple(full))

    if not lexemes:
        return None
    return chain("OR", lambda: chain("AND", lambda: chain("NOT", side_by_side)))


def phrases(tree) -> list[Phrase]:
    """The phrases of a tree that have tokens, in order, repeated ones each."""
    if isinstance(tree, Phrase):
        return [tree] if tree.tokens else []
    return [p for part in tree.parts for p in phrases(part)] if tree else []


def highlight_terms(query: str, widened: list[Widening] = ()) -> list[str]:
    """Words to mark in a result: those of the query, near words, and prefixes as `word*`."""
    out = []
    for item in items(query):
        if item.op or item.text in (*OPERATORS, "NEAR"):
            continue
        found = token_list(item.text)
        out += [*found[:-1], found[-1] + "*" * item.prefix] if found else []
    for w in widened:
        out += [*w.near, w.typed + "*"]
    return list(dict.fromkeys(out))
