"""Stateless views: what stays visible of a blob, and the exact bytes that each marker stands for.

Views of logs and code are built-in expressions over the row's own lines; only JSON needs an Arrow function.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tilefold.config import HANDLE_PREFIX, LABEL
from tilefold.functions.handles import handle
from tilefold.functions.predicates import STRUCTURAL_AT, body_hint, important, may_hold_important
from tilefold.functions.text import LINE, W_ALPHA, W_DIGIT, W_SPACE, W_SYMBOL, let, line_text, tile_lines, tokens
from tilefold.operators.tiles import split_json

# Lines kept of a log, the shortest run of code lines and the largest JSON member that is kept.
LOG_HEAD, LOG_TAIL, LOG_SLACK, LOG_KEYS, MIN_RUN, KEEP_BYTES = 10, 6, 8, 12, 4, 240

CODE_PART = rf"(?={STRUCTURAL_AT}){LINE}|(?:(?!{STRUCTURAL_AT}){LINE})++"


GONE = "array<struct<handle:string,text:string>>"  # what markers stand for


def log_view(t: Column) -> Column:
    """Struct (view, elided): head, key lines of the middle, one marker, tail; short logs stay whole.

    ``elided`` is an array of at most one (handle, text).
    """

    def whole(ls: Column) -> Column:
        return F.struct(F.array_join(F.transform(ls, line_text), "\n").alias("view"), F.array().cast(GONE).alias("elided"))

    def cut(ls: Column, middle: Column, body: Column, keys: Column) -> Column:
        label = F.when(F.size(keys) > 0, F.array(F.lit(f"[{LABEL}: key lines from the elided middle]"))).otherwise(F.array())
        marker = F.format_string(f"[{LABEL}: %d lines elided · ~%d tok · recall %s]", F.size(middle), tokens(body), handle(body))
        head, tail = F.slice(ls, 1, LOG_HEAD), F.slice(ls, -LOG_TAIL, LOG_TAIL)
        shown = F.concat(F.transform(head, line_text), label, keys, F.array(marker), F.transform(tail, line_text))
        gone = F.array(F.struct(handle(body).alias("handle"), body.alias("text")))
        return F.struct(F.array_join(shown, "\n").alias("view"), gone.alias("elided"))

    def build(ls: Column) -> Column:
        middle = F.slice(ls, LOG_HEAD + 1, F.size(ls) - LOG_HEAD - LOG_TAIL)

        def found(m: Column, body: Column) -> Column:
            return F.when(may_hold_important(body), F.slice(F.filter(F.transform(m, line_text), important), 1, LOG_KEYS)).otherwise(F.array())

        return let(middle, lambda m: let(F.array_join(m, ""), lambda body: let(found(m, body), lambda keys: cut(ls, m, body, keys))))

    return let(tile_lines(t), lambda ls: F.when(F.size(ls) > LOG_HEAD + LOG_TAIL + LOG_SLACK, build(ls)).otherwise(whole(ls)))


def _code_part(part: Column) -> Column:
    """Struct (view, handle, text) of a structural line or a run of others; handle and text are null if it stays."""
    lines = F.char_length(part) - F.char_length(F.translate(part, "\n", "")) + F.when(part.endswith("\n"), 0).otherwise(1)
    kept = F.regexp_replace(F.regexp_replace(part, r"\r++(?=\n|\z)", ""), r"\n\z", "")
    none = F.lit(None).cast("string")
    stays = F.struct(kept.alias("view"), none.alias("handle"), none.alias("text"))

    def weigh(n: Column, h: Column) -> Column:
        marker = F.concat(F.format_string(f"[{LABEL}: %d-line body", n), body_hint(part), F.lit(" · recall "), h, F.lit("]"))
        goes = lambda m: F.struct(m.alias("view"), h.alias("handle"), part.alias("text"))
        return let(marker, lambda m: F.when(tokens(part) > tokens(m), goes(m)).otherwise(stays))

    run = ~part.rlike(rf"\A{STRUCTURAL_AT}")
    return let(lines, lambda n: F.when((n >= MIN_RUN) & run, let(handle(part), lambda h: weigh(n, h))).otherwise(stays))


def code_view(t: Column) -> Column:
    """Struct (view, elided): structural lines stay, a longer run of others becomes a marker if that is smaller."""
    parts = F.transform(F.regexp_extract_all(t, F.lit(CODE_PART), F.lit(0)), _code_part)

    def both(ps: Column) -> Column:
        gone = F.transform(F.filter(ps, lambda p: p["handle"].isNotNull()), lambda p: F.struct(p["handle"].alias("handle"), p["text"].alias("text")))
        return F.struct(F.array_join(F.transform(ps, lambda p: p["view"]), "\n").alias("view"), gone.alias("elided"))

    return let(parts, both)


def line_view(t: Column, content_type: Column) -> Column:
    """The stateless view of code and logs, which may stand inside a lambda."""
    return F.when(content_type == "code", code_view(t)).otherwise(log_view(t))


def view(t: Column, content_type: Column) -> Column:
    """The stateless view by content type. Not for use inside a lambda; rows of other types reach the Arrow function as nulls."""
    json = content_type == "json"
    return F.when(json, json_view(F.when(json, t))).otherwise(line_view(t, content_type))


def estimate(s: str) -> int:
    """The token estimate of ``functions.text.tokens`` in Python."""
    import math

    a = d = sp = 0
    for c in s:
        if c in " \t\n\r":
            sp += 1
        elif "0" <= c <= "9":
            d += 1
        elif "A" <= c <= "Z" or "a" <= c <= "z":
            a += 1
    units = len(s) + sum(c > "￿" for c in s)
    return math.ceil(a * W_ALPHA + d * W_DIGIT + (units - a - d - sp) * W_SYMBOL + sp * W_SPACE)


def member_key(body: bytes) -> str | None:
    """The raw first key of a member that begins with a string."""
    import re

    m = re.match(rb'"((?:[^"\\]|\\[\s\S])*)"', body)
    try:
        return m and m.group(1).decode()
    except UnicodeDecodeError:
        return None


def json_parts(b: bytes) -> list[tuple[str, bytes | None]]:
    """(view, elided bytes) of each tile of a JSON text; the opening, the closing and the last tile always stay."""
    from hashlib import sha256

    tiles = split_json(b)
    if len(tiles) < 2:
        return [(b.decode("utf-8", "replace"), None)] if b else []
    out: list[tuple[str, bytes | None]] = []
    for i, (s, e) in enumerate(tiles):
        tile = b[s:e]
        body = tile.lstrip(b" \t\r\n")
        closing = i == len(tiles) - 1 or (i == len(tiles) - 2 and tile in (b"}", b"]"))
        if i == 0 or closing or len(body) <= KEEP_BYTES:
            out.append((tile.decode("utf-8", "replace"), None))
            continue
        key, text = member_key(body), tile.decode("utf-8", "replace")
        marker = f"[{LABEL}: section omitted · ~{estimate(text)} tokens · recall {HANDLE_PREFIX}{sha256(tile).hexdigest()[:32]}]"
        lead = tile[: len(tile) - len(body)].decode()
        out.append((lead + (f'"{key}": ' if key is not None else "") + marker + ("," if tile.endswith(b",") else ""), tile))
    return out


_ELIDED = StructType([StructField("handle", StringType()), StructField("text", StringType())])
_VIEW = StructType([StructField("view", StringType()), StructField("elided", ArrayType(_ELIDED))])


@F.pandas_udf(_VIEW)
def json_view(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    from hashlib import sha256

    for batch in texts:
        views, gone = [], []
        for t in batch:
            parts = json_parts(t.encode("utf-8", "surrogatepass")) if t is not None else []
            views.append(None if t is None else "".join(v for v, _ in parts))
            gone.append([{"handle": HANDLE_PREFIX + sha256(x).hexdigest()[:32], "text": x.decode("utf-8", "replace")} for _, x in parts if x is not None])
        yield pd.DataFrame({"view": views, "elided": gone})


@F.pandas_udf(ArrayType(_VIEW))
def json_views(runs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """View and elided parts of each text of an array; null texts stay null."""
    from hashlib import sha256

    def one(t: str | None) -> dict | None:
        if t is None:
            return None
        parts = json_parts(t.encode("utf-8", "surrogatepass"))
        gone = [{"handle": HANDLE_PREFIX + sha256(x).hexdigest()[:32], "text": x.decode("utf-8", "replace")} for _, x in parts if x is not None]
        return {"view": "".join(v for v, _ in parts), "elided": gone}

    for batch in runs:
        yield pd.Series([None if ts is None else [one(t) for t in ts] for ts in batch], dtype=object)
