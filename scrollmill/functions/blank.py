"""Columns for outer space and blankness, after Unicode rather than ASCII."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Unicode white space.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
#: A character that one can see: no space, control or format character, filler or variation selector.
_SEEN = r"[^\s\p{Z}\p{Cc}\p{Cf}͏ᅟᅠ឴឵᠋-᠏⠀ㅤ︀-️ﾠ]"


def trimmed(text: Column) -> Column:
    """`text` without outer white space; null stays null."""
    return F.btrim(text, F.lit(SPACES))


def has_text(text: Column) -> Column:
    """Whether `text` has a character that one can see; false for null."""
    return F.coalesce(text.rlike(_SEEN), F.lit(False))
