"""The words of a text behind markup, wrapping, case and look-alike letters."""

from __future__ import annotations

import html
import re
import sys
import unicodedata

import numpy as np
import xxhash

_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤︀-️﻿͏]")
_TAG = re.compile(r"</?(?:em|b|i|u|s|a|q|tt|code|strong|span|mark|small|sub|sup|del|ins|kbd|font)\b[^<>]{0,200}>|<!--.{0,200}?-->", re.I | re.S)
_BLOCK = re.compile(r"</?[a-z][a-z0-9]*\b[^<>]{0,200}>", re.I)
_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*\)")
_WRAP = re.compile(r"(?<=[^\W\d_])[-‐]\r?\n[>#*/ \t|]*(?=[^\W\d_])")
_ESCAPE = re.compile(r"\\(?:[nrtbf]|u([0-9a-fA-F]{4})|([\"/\\]))")
_WORD = re.compile(r"[^\W_]+")
# Letters of other alphabets that look like Latin ones.
_ALIKE = str.maketrans("абвгеикмнорстухѕіјԁһѵԛԝαβεικνορτυχγ", "abbreukmhopctyxsijdhvqwabeiknoptuxy")
# Combining marks, and the alphabets of the letters that look alike.
_MARKS = re.compile("[" + "".join(chr(c) for c in range(0x300, sys.maxunicode) if unicodedata.combining(chr(c))) + "]")
_OTHER = re.compile("[Ͱ-ԯ]")


def plain(text: str) -> str:
    """`text` in lower case without markup, hyphenation, escapes, marks and invisible characters."""
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else m[2] or " ", text)
    if "<" in text:
        text = _BLOCK.sub(" ", _TAG.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    if "-\n" in text or "‐\n" in text or "-\r\n" in text:
        text = _WRAP.sub("", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower()
        if _OTHER.search(text):
            text = text.translate(_ALIKE)
    return text.lower()


def words(text: str | None) -> list[str]:
    """The words of `plain(text)`: runs of letters and digits."""
    return _WORD.findall(plain(text)) if text else []


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


_codes = _Codes()


def codes(tokens: list[str]) -> np.ndarray:
    """A 64-bit code for each word, the same in every process."""
    return np.fromiter(map(_codes.__getitem__, tokens), np.uint64, len(tokens))
