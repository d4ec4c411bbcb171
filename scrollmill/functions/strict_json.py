"""Strict parsing of one JSON text, for any depth of nesting and any length of number."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|true|false|null", re.ASCII)
_WORDS = {"true": True, "false": False, "null": None}


def _refuse(word: str) -> None:
    raise ValueError(f"{word} is no JSON")


_decode = json.JSONDecoder(parse_constant=_refuse).decode


def loads(text: str):
    """The value of a complete JSON text; ValueError for anything else.

    NaN and Infinity are refused. Nesting deeper than the fast parser's stack and integers of
    thousands of digits go to a parser without recursion, which keeps numbers as floats.
    """
    try:
        return _decode(text)
    except RecursionError:
        return _loads_deep(text)
    except ValueError as e:
        if "digits" not in str(e):
            raise
        return _loads_deep(text)


def _loads_deep(text: str):
    skip = lambda at: _SPACE.match(text, at).end()
    root: list = []
    stack: list = [root]
    keys: list = [None]

    def put(value) -> None:
        top = stack[-1]
        if isinstance(top, dict):
            top[keys[-1]] = value
        else:
            top.append(value)

    at, want = skip(0), "value"
    while True:
        ch = text[at : at + 1]
        if want == "key":
            if ch != '"':
                raise ValueError("key expected")
            keys[-1], at = scanstring(text, at + 1, True)
            at = skip(at)
            if text[at : at + 1] != ":":
                raise ValueError("colon expected")
            at, want = skip(at + 1), "value"
        elif want == "value":
            if ch == "{" or ch == "[":
                new: dict | list = {} if ch == "{" else []
                put(new)
                stack.append(new)
                keys.append(None)
                at = skip(at + 1)
                if text[at : at + 1] == ("}" if ch == "{" else "]"):
                    want = "after"
                else:
                    want = "key" if ch == "{" else "value"
                continue
            if ch == '"':
                value, at = scanstring(text, at + 1, True)
            else:
                m = _SCALAR.match(text, at)
                if not m:
                    raise ValueError("value expected")
                value, at = (float(m[1]) if m[1] else _WORDS[m[0]]), m.end()
            put(value)
            at, want = skip(at), "after"
        else:
            if len(stack) == 1:
                if at != len(text):
                    raise ValueError("extra data")
                return root[0]
            close = "}" if isinstance(stack[-1], dict) else "]"
            if ch == ",":
                at, want = skip(at + 1), "key" if close == "}" else "value"
            elif ch == close:
                stack.pop()
                keys.pop()
                at = skip(at + 1)
            else:
                raise ValueError("comma or close expected")


def loads_object(text: str | None) -> dict | None:
    """The object that `text` is, or None where it is null or no complete JSON object."""
    if not text:
        return None
    try:
        value = loads(text)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def clean(text: str) -> str:
    """`text` with lone surrogates, which no UTF-8 column can hold, replaced by U+FFFD."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
