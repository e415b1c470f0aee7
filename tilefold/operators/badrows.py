"""Rows that fail to parse: reasons in order for the failing ones, typed rows for the others.

Every field is loaded as nullable text by built-in expressions; cast and constraint rules give an array of errors, and
rows are split by whether it is empty. No Python, one scan, no shuffle but the one that counts repeats once. The
patterns are possessive, so quotes and long texts are read in linear time and without recursion.

Defined results: a null line has no field, hence ``column_count``; an empty line has one empty field, likewise. With
broken quoting or a wrong number of fields the later rules have nothing to read and add no error. A repeated
``row_id`` with the same line and reason counts once. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilefold.functions.text import let
from tilefold.plans.prefix import one_per_id

# The fields of an exported metrics line, the largest amount and the pattern of an event.
FIELDS = ("t", "event", "session", "raw", "shown", "saved", "delta_hits", "evicted")
NUMBERS = ("t", "raw", "shown", "saved", "delta_hits", "evicted")
LARGEST = "9223372036854775807"
EVENT = r"\A[a-z][a-z0-9._-]*+\z"

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_WHOLE = rf'\A(?:,(?:{_QUOTED}|[^",]*+)(?=,|\z))++\z'


def field_array(line: Column) -> Column:
    """The fields of a comma-separated record as text, unquoted; null if its quoting is broken.

    A record without quotes is only cut at its commas; the patterns are for the others.
    """

    def quoted(text: Column) -> Column:
        led = F.concat(F.lit(","), text)
        parts = F.regexp_extract_all(led, F.lit(rf',({_QUOTED}|[^",]*+)'), F.lit(1))
        inner = lambda p: F.replace(F.substring(p, 2, F.length(p) - 2), F.lit('""'), F.lit('"'))
        return F.when(led.rlike(_WHOLE), F.transform(parts, lambda p: F.when(p.startswith('"'), inner(p)).otherwise(p)))

    text = F.regexp_replace(line, r"\r\z", "")
    return F.when(line.contains('"'), quoted(text)).otherwise(F.split(text, ",", -1))


def in_range(digits: Column) -> Column:
    """Whether ASCII digits amount to at most 2^63-1."""
    core = F.regexp_replace(digits, r"\A0++", "")
    return (F.length(core) < len(LARGEST)) | ((F.length(core) == len(LARGEST)) & (core <= LARGEST))


def _bad(field: str, text: Column) -> Column:
    if field == "session":
        return F.lit(False)
    if field == "event":
        return ~text.rlike(EVENT)
    if field == "saved":
        digits = F.regexp_replace(text, r"\A-", "")
        return (text != "") & ~(digits.rlike(r"\A[0-9]++\z") & in_range(digits))
    return ~(text.rlike(r"\A[0-9]++\z") & in_range(text))


def _error(reason: str, field: str | None = None) -> Column:
    return F.struct(F.lit(reason).alias("reason"), F.lit(field).cast("string").alias("field"))


def judged(line: Column) -> Column:
    """Struct (fields, errors) of a line: array of text, and an ordered array of (reason, field).

    The fields are bound once, so the rules read them and do not cut the line again.
    """

    def rules(f: Column) -> Column:
        values = F.array_compact(F.array(*(F.when(_bad(name, f[i]), _error("bad_value", name)) for i, name in enumerate(FIELDS))))
        errors = (
            F.when(line.isNull(), F.array(_error("column_count")))
            .when(f.isNull(), F.array(_error("quoting")))
            .when(F.size(f) != len(FIELDS), F.array(_error("column_count")))
            .otherwise(values)
        )
        return F.struct(f.alias("fields"), errors.alias("errors"))

    return let(field_array(line), rules)


def _failing(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and ``errors`` of the failing rows. An empty array explodes to no row, so no rule runs in a filter too."""
    errors = judged(F.col("line"))["errors"]
    some = F.explode(let(errors, lambda e: F.when(F.size(e) > 0, F.array(e)).otherwise(F.array())))
    return rows.select(*columns, some.alias("errors"))


def rejected(rows: DataFrame) -> DataFrame:
    """(row_id, reason, errors, line) of the failing rows, repeated deliveries once."""
    bad = _failing(rows, "row_id", "line")
    return bad.select("row_id", F.col("errors")[0]["reason"].alias("reason"), "errors", "line").distinct()


def reasons(rows: DataFrame) -> DataFrame:
    """(row_id, reason): the failing rows with their first reason, without carrying the lines through the shuffle."""
    return _failing(rows, "row_id").select("row_id", F.col("errors")[0]["reason"].alias("reason")).distinct()


def loaded(rows: DataFrame) -> DataFrame:
    """Typed metrics rows (row_id, t, event, session, raw, shown, saved, delta_hits, evicted), each row_id once."""
    clean = let(judged(F.col("line")), lambda j: F.when(F.size(j["errors"]) == 0, F.array(j["fields"])).otherwise(F.array()))
    kept = rows.select("row_id", "arrived_at", F.explode(clean).alias("fields"))
    typed = [
        (F.nullif(F.col("fields")[i], F.lit("")).cast("bigint") if f in NUMBERS else F.col("fields")[i]).alias(f) for i, f in enumerate(FIELDS)
    ]
    return one_per_id(kept.select("row_id", "arrived_at", *typed), "row_id", "arrived_at").drop("arrived_at")
