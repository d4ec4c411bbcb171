"""The tokenizer of the full-text index, as column expressions and as Python for the few kept rows.

A token is a maximal run of letters, digits, marks and private-use characters, in lower case and
without the diacritics of Latin letters. Everything stays in the JVM: folding is one `translate`.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

_RUN = r"([\p{L}\p{N}\p{M}\p{Co}]+)"


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, str]:
    """Accented Latin letters, their base letters, and combining marks, made from Unicode's own data."""
    accented, base = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code).lower())
        if len(parts) > 1 and parts[0].isascii() and all(map(unicodedata.combining, parts[1:])):
            accented.append(chr(code))
            base.append(parts[0])
    marks = "".join(chr(c) for c in range(0x300, 0x370))
    return "".join(accented), "".join(base), marks


def fold(text: Column) -> Column:
    """`text` in lower case without Latin diacritics."""
    accented, base, marks = _folding()
    return F.translate(F.lower(text), accented + marks, base)


def tokens(text: Column) -> Column:
    """The tokens of `text` in order; none for null."""
    return F.coalesce(F.regexp_extract_all(fold(text), F.lit(_RUN), F.lit(1)), F.expr("cast(array() as array<string>)"))


@lru_cache(maxsize=1)
def _table() -> dict[int, str | None]:
    accented, base, marks = _folding()
    return {**{ord(a): b for a, b in zip(accented, base)}, **{ord(m): None for m in marks}}


def _inside(c: str) -> bool:
    return unicodedata.category(c)[0] in "LNM" or unicodedata.category(c) == "Co"


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, token) of the tokens of one text."""
    out, start = [], None
    for i, c in enumerate(text):
        if c.isascii() and c.isalnum() or (not c.isascii() and _inside(c)):
            start = i if start is None else start
        elif start is not None:
            out.append((start, i, text[start:i].lower().translate(_table())))
            start = None
    if start is not None:
        out.append((start, len(text), text[start:].lower().translate(_table())))
    return out


def token_list(text: str) -> list[str]:
    return [t for _, _, t in spans(text)]


def edits(a: str, b: str, most: int) -> int | None:
    """Insertions, deletions, substitutions and swaps of neighbours from `a` to `b`, None above `most`.

    A swapped pair is not edited again (optimal string alignment).
    """
    if abs(len(a) - len(b)) > most:
        return None
    rows: list[list[int]] = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(rows[i - 1][j] + 1, row[j - 1] + 1, rows[i - 1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, rows[i - 2][j - 2] + 1)
            row.append(cost)
        rows.append(row)
    return d if (d := rows[-1][-1]) <= most else None


#: Control characters but line feed and tab.
CONTROLS = re.compile(r"[\x00-\x08\x0b-\x1f\x7f-\x9f]")


def clean_controls(text: Column) -> Column:
    """Control characters but line feed and tab as U+FFFD, for reports and previews."""
    return F.regexp_replace(text, r"[\p{Cc}&&[^\n\t]]", "�")


def clean_terminal(text: Column) -> Column:
    """Control characters and changes of writing direction as spaces, for one-line output."""
    return F.regexp_replace(text, "[\\p{Cc}‎‏‪-‮⁦-⁩؜]", " ")


def prefix_end(prefix: str) -> str:
    """The least text above all texts that begin with `prefix`, by code points; surrogates are none.

    A prefix of the last code point alone has no such bound: one a character longer is given.
    """
    kept = prefix
    while kept:
        kept, last = kept[:-1], ord(kept[-1]) + 1
        if last <= sys.maxunicode:
            return kept + chr(0xE000 if 0xD800 <= last < 0xE000 else last)
    return chr(sys.maxunicode) * (len(prefix) + 1)


_WIDTHS = re.compile(r"\s+")


def display_width(text: str) -> int:
    """Columns that `text` takes in a terminal: wide characters two, combining marks none."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def cut_to_width(text: str, width: int) -> str:
    """`text` on one line within `width` columns, an ellipsis where it is cut."""
    line = _WIDTHS.sub(" ", text).strip()
    if display_width(line) <= width:
        return line
    out, used = [], 0
    for c in line:
        used += display_width(c)
        if used > width - 1:
            break
        out.append(c)
    return "".join(out) + "…" if width > 0 else ""
