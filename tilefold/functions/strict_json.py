"""Strict JSON for Python workers: no NaN, any depth, any length of number."""

from __future__ import annotations

import json
import re


def _no_constant(name: str):
    raise ValueError(name)


def _integer(digits: str):
    return int(digits) if len(digits) < 400 else float(digits)


_DECODER = json.JSONDecoder(parse_constant=_no_constant, parse_int=_integer)
_TOKEN = re.compile(
    r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))'
)
_BLANK = re.compile(r"[ \t\n\r]*")
_WORDS = {"true": True, "false": False, "null": None}


def parse(text: str):
    """The value of ``text``, which must be one whole valid JSON text; else ValueError.

    Of a repeated key the last value counts. Very deep values are read without recursion.
    """
    try:
        value, end = _DECODER.raw_decode(text, _BLANK.match(text).end())
    except RecursionError:
        return _parse_deep(text)
    if _BLANK.match(text, end).end() != len(text):
        raise ValueError("text after the value")
    return value


def _parse_deep(text: str):
    pos, stack, done, root = 0, [], False, None
    expect, key = "value", None  # value, first (value or close), key, firstkey, colon, next
    while True:
        m = _TOKEN.match(text, pos)
        if not m:
            if done and _BLANK.match(text, pos).end() == len(text):
                return root
            raise ValueError("no JSON")
        if done:
            raise ValueError("text after the value")
        pos = m.end()
        mark, string, number, word = m.groups()
        if expect == "colon":
            if mark != ":":
                raise ValueError("no colon")
            expect = "value"
            continue
        if expect == "next":
            top = stack[-1][0]
            if mark == ",":
                expect = "key" if isinstance(top, dict) else "value"
                continue
            if mark != ("}" if isinstance(top, dict) else "]"):
                raise ValueError("no comma")
            value = top
            key = stack.pop()[1]
        elif expect in ("key", "firstkey"):
            if string is not None:
                key, expect = _DECODER.decode(string), "colon"
                continue
            if mark != "}" or expect == "key":
                raise ValueError("no key")
            value, key = stack.pop()
        elif mark in ("{", "["):
            stack.append(({} if mark == "{" else [], key))
            expect = "firstkey" if mark == "{" else "first"
            continue
        elif mark == "]" and expect == "first":
            value, key = stack.pop()
        elif mark is not None:
            raise ValueError("no value")
        else:
            value = _WORDS[word] if word else _DECODER.decode(string if string is not None else number)
        if not stack:
            root, done = value, True
            continue
        top = stack[-1][0]
        if isinstance(top, dict):
            top[key] = value
        else:
            top.append(value)
        expect = "next"


def dump(value) -> str:
    """Canonical text: sorted keys, no blanks, whole floats as integers; any depth."""
    try:
        return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    except RecursionError:
        return _dump_deep(value)


def _plain(value):
    if isinstance(value, float):
        return int(value) if value == value // 1 and abs(value) < 1e300 else value
    if isinstance(value, list):
        return [_plain(x) for x in value]
    if isinstance(value, dict):
        return {k: _plain(x) for k, x in value.items()}
    return value


def _dump_deep(value) -> str:
    out: list[str] = []
    todo: list = [("value", value)]
    while todo:
        kind, x = todo.pop()
        if kind == "text":
            out.append(x)
        elif isinstance(x, list):
            out.append("[")
            todo.append(("text", "]"))
            for i in range(len(x) - 1, -1, -1):
                todo.append(("value", x[i]))
                if i:
                    todo.append(("text", ","))
        elif isinstance(x, dict):
            out.append("{")
            todo.append(("text", "}"))
            for i, k in reversed(list(enumerate(sorted(x)))):
                todo.append(("value", x[k]))
                todo.append(("text", ("," if i else "") + json.dumps(k) + ":"))
        else:
            out.append(json.dumps(_plain(x)))
    return "".join(out)
