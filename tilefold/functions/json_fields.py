"""Fields of raw JSON records: reading by type, replacing one, and the tolerant reading of a log line.

A tolerant reading takes the first value of a text, whatever follows it, and of a repeated key the first value; a value
nested deeper than ``MAX_DEPTH`` is none. Built-in parsing does all lines but those with repeated keys or text behind
their value, which alone reach an Arrow function.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_DEPTH = 256


def _no_constant(name: str):
    raise ValueError(name)


_PAIRS = json.JSONDecoder(parse_constant=_no_constant, object_pairs_hook=lambda pairs: _Pairs(pairs))


class _Pairs(list):
    """An object as its pairs in order, repeats included."""


def _plain(value, depth: int = 1):
    """Objects as dicts with the first value of each key; ValueError if too deep."""
    if isinstance(value, list):
        if depth > MAX_DEPTH:
            raise ValueError("too deep")
        if isinstance(value, _Pairs):
            out: dict = {}
            for k, x in value:
                out.setdefault(k, _plain(x, depth + 1))
            return out
        return [_plain(x, depth + 1) for x in value]
    return value


def first_value(text: str) -> str | None:
    """The first JSON value of a text, in one spelling; None if there is none."""
    try:
        value, _ = _PAIRS.raw_decode(text, len(text) - len(text.lstrip(" \t\r\n")))
        return json.dumps(_plain(value), separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


def with_key(text: str, key: str, value: str) -> str | None:
    """An object's text with ``key`` set to the JSON text ``value``: its first place is kept, a new key goes to the end."""
    try:
        pairs, _ = _PAIRS.raw_decode(text, len(text) - len(text.lstrip(" \t\r\n")))
        new = json.loads(value)
        if not isinstance(pairs, _Pairs):
            return None
        out = {k: _plain(x) for k, x in reversed(pairs)}
        order = list(dict.fromkeys(k for k, _ in pairs))
    except (ValueError, RecursionError):
        return None
    return json.dumps({k: out[k] for k in order} | {key: new}, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(StringType())
def _first_values(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([None if t is None else first_value(t) for t in batch], dtype=object)


@F.pandas_udf(StringType())
def _with_keys(texts: pd.Series, values: pd.Series, keys: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or v is None else with_key(t, k, v) for t, v, k in zip(texts, values, keys)], dtype=object)


def tolerant(line: Column) -> Column:
    """The record of a log line as a variant; null if it has none. Not for use inside a lambda."""
    plain = F.try_parse_json(line)
    return F.coalesce(plain, F.try_parse_json(_first_values(F.when(plain.isNull() & line.rlike(r"\A[ \t\r\n]*+[{\[\"0-9tfn-]"), line))))


def set_key(record: Column, key: str, value: Column) -> Column:
    """A record (JSON text) with ``key`` replaced or appended; null if it is no object. ``value`` is JSON text."""
    return _with_keys(record, value, F.lit(key))


def _member(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def string_of(v: Column, key: str) -> Column:
    """A member that is a string; null for any other type."""
    x = _member(v, key)
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))


def number_of(v: Column, key: str) -> Column:
    """A member that is a number, cut toward zero; null for any other type."""
    x = _member(v, key)
    kind = F.schema_of_variant(x)
    return F.when((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(x, "$", "double").try_cast("bigint"))


def boolean_of(v: Column, key: str) -> Column:
    x = _member(v, key)
    return F.when(F.schema_of_variant(x) == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))
