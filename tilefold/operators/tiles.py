"""Exact tilings of a blob: lines, log blocks, code blocks, JSON members, document sections.

A tile is found where the one before it ends, so each tiling is one anchored pattern applied over and over by a built-in
expression: linear, inside the row, no shuffle, no Python. The tiles of a text concatenated are the text. JSON members
need a count of open brackets, which no pattern has; they alone use an Arrow function.

An empty text has no tile, a null one null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from tilefold.functions.predicates import ANCHOR_AT, BLANK_AT, DEFINITION_AT, FENCE_AT, MARK_AT
from tilefold.functions.text import LINE, WS_IN_LINE, tile_lines

LOG_CHUNK = 6

LOG_BLOCK = rf"{BLANK_AT}|{LINE}(?:(?!{BLANK_AT}|{ANCHOR_AT}){LINE}){{0,{LOG_CHUNK - 1}}}+"
DEFINITION_BLOCK = rf"{LINE}(?:(?!{DEFINITION_AT}){LINE})*+"
PARAGRAPH_BLOCK = rf"(?:(?!{BLANK_AT}){LINE})*+{BLANK_AT}|(?:(?!{BLANK_AT}){LINE})++"
SECTION = (
    rf"{FENCE_AT}[^\n]*+(?:\n|\z)(?:(?!{FENCE_AT}){LINE})*+(?:{FENCE_AT}[^\n]*+(?:\n|\z))?"
    rf"|(?={MARK_AT}|{WS_IN_LINE}*+(?:\n|\z)){LINE}"
    rf"|(?:(?!{MARK_AT}|{WS_IN_LINE}*+(?:\n|\z)){LINE})++"
)


def _all(t: Column, pattern: str) -> Column:
    return F.regexp_extract_all(t, F.lit(pattern), F.lit(0))


def log_blocks(t: Column) -> Column:
    """A block opens at an anchor, at and after a blank line, and when the one before has six lines."""
    return _all(t, LOG_BLOCK)


def code_blocks(t: Column) -> Column:
    """One block per definition at the left margin, one for what stands before; without any, by blank lines."""
    return F.when(t.rlike(rf"(?:\A|\n){DEFINITION_AT}"), _all(t, DEFINITION_BLOCK)).otherwise(_all(t, PARAGRAPH_BLOCK))


def sections(t: Column) -> Column:
    """Fences with what they hold, structural lines, blank lines and runs of prose."""
    return _all(t, SECTION)


def split_json(b: bytes) -> list[tuple[int, int]]:
    """Byte ranges: the opening, each top-level member with its comma, the closing, what follows; else one range."""
    n = len(b)
    if not n:
        return []
    at = 0
    while at < n and b[at] in b" \t\r\n":
        at += 1
    if at == n or b[at] not in b"{[":
        return [(0, n)]
    cuts = [0, at + 1]
    depth, quoted, i = 1, False, at + 1
    while i < n:
        c = b[i]
        if quoted:
            if c == 0x5C:
                i += 1
            elif c == 0x22:
                quoted = False
        elif c == 0x22:
            quoted = True
        elif c in b"{[":
            depth += 1
        elif c in b"}]":
            depth -= 1
            if not depth:
                cuts += [i, i + 1, n]
                return [(s, e) for s, e in zip(cuts, cuts[1:]) if e > s]
        elif c == 0x2C and depth == 1:
            cuts.append(i + 1)
        i += 1
    return [(0, n)]


@F.pandas_udf(ArrayType(StringType()))
def json_blocks(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        out = []
        for t in batch:
            b = t.encode("utf-8", "surrogatepass") if t is not None else b""
            out.append(None if t is None else [b[s:e].decode("utf-8", "replace") for s, e in split_json(b)])
        yield pd.Series(out)


def blocks(t: Column, content_type: Column) -> Column:
    """Tiles by content type. Not for use inside a lambda; rows of other types reach the Arrow function as nulls."""
    json = content_type == "json"
    return F.when(content_type == "code", code_blocks(t)).when(json, json_blocks(F.when(json, t))).otherwise(log_blocks(t))


def latin(b: Column) -> Column:
    """Bytes as a text of one character per byte, so that any bytes tile exactly."""
    return F.decode(b, "ISO-8859-1")


def byte_tiles(b: Column, tiler) -> Column:
    """Tiles of arbitrary bytes, as bytes."""
    return F.transform(tiler(latin(b)), lambda x: F.encode(x, "ISO-8859-1"))


def exploded(df: DataFrame, key: str, tiles: Column, name: str = "block") -> DataFrame:
    """One row per tile: (key, <name>_no, <name>)."""
    return df.select(key, F.posexplode(tiles).alias(f"{name}_no", name))


@F.pandas_udf(ArrayType(LongType()))
def _running(sizes: pd.Series) -> pd.Series:
    """Running sums of each array; a fold inside the row would copy the array for every element."""
    return sizes.map(lambda x: None if x is None else np.cumsum(x, dtype=np.int64))


def ranges(df: DataFrame, key: str, tiles: Column, name: str = "block") -> DataFrame:
    """(key, <name>_no, start, end) in bytes. Nothing is shuffled, and only lengths leave the row."""
    sized = df.select(key, F.transform(tiles, F.octet_length).alias("_n"))
    each = sized.select(key, F.posexplode(F.arrays_zip(F.col("_n"), _running("_n").alias("_e"))).alias(f"{name}_no", "_x"))
    return each.select(key, f"{name}_no", (F.col("_x._e") - F.col("_x._n")).alias("start"), F.col("_x._e").alias("end"))


def line_ranges(df: DataFrame, key: str, text: str) -> DataFrame:
    return ranges(df, key, tile_lines(F.col(text)), "line")
