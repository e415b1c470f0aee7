"""Transcripts: the last boundary of a session and the handles shown after it.

Defined results: a session all of whose lines are null or blank is not ok and has no handle. A repeated line counts
once. Lines with a null number stand before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilefold.functions.handles import handles_in
from tilefold.session import written

# Labels of the boundaries.
COMPACTIONS = ("compact", "compaction", "compact_complete", "compacted")
RESTARTS = ("session_start", "session_restart", "session_reset", "restart")
KEYS = ("type", "event", "kind", "subtype")


def boundary_of_label(label: Column) -> Column:
    low = F.lower(label)
    return (
        F.when(low == "clear", F.lit("/clear")).when(low.isin(*COMPACTIONS), F.lit("compaction")).when(low.isin(*RESTARTS), F.lit("session restart"))
    )


def _text(v: Column, path: str) -> Column:
    """A member that is a string; null for any other type."""
    x = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(v, path, "string"))


def boundary(line: Column) -> Column:
    """The boundary that a raw JSON line marks, if any: ``/clear``, ``compaction`` or ``session restart``.

    Only lines in which a label stands, or an escape that could spell one, are parsed.
    """
    v = F.try_parse_json(line)
    labels = [boundary_of_label(_text(v, f"$.{k}")) for k in KEYS]
    cleared = [F.when(F.regexp_replace(_text(v, p), r"\A[\t-\r \x{85}\p{Z}]++|[\t-\r \x{85}\p{Z}]++\z", "") == "/clear", F.lit("/clear")) for p in ("$.message.content", "$.content")]
    stems = sorted({w[:7] for w in ("clear", *COMPACTIONS, *RESTARTS)})  # what every label begins with
    may = line.rlike(rf"(?i){'|'.join(stems)}|\\u")
    return F.when(line.contains('"/clear"'), F.lit("/clear")).when(may, F.coalesce(*labels, *cleared))


def raw_line(df: DataFrame) -> Column:
    """A transcript row as the JSON line it stands for."""
    quoted = F.to_json(F.struct("kind", "role"))
    part = lambda c: F.when(F.col(c).isNull(), F.lit("")).when(F.try_parse_json(F.col(c)).isNotNull(), F.concat(F.lit(f',"{c}":'), F.col(c))).otherwise(
        F.concat(F.lit(f',"{c}":'), F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r'\A\{"x":([\s\S]*)\}\z', 1))
    )
    return F.concat(F.regexp_replace(quoted, r"\}\z", ""), F.when(quoted == "{}", F.lit('"_":0')).otherwise(F.lit("")), part("message"), part("content"), F.lit("}"))


def narrow(line: Column) -> dict[str, Column]:
    """What a scan needs of a raw line: the boundary it marks, whether it is not blank, and its distinct handles."""
    full = ~F.coalesce(line, F.lit("")).rlike(r"\A[\t-\r \x{85}\p{Z}]*+\z")
    return {"b": boundary(line), "full": full, "hs": F.array_distinct(handles_in(line))}


def _narrowed(lines: DataFrame) -> DataFrame:
    return lines if "hs" in lines.columns else lines.select("session", "line_no", *(v.alias(k) for k, v in narrow(F.col("line")).items()))


def boundaries(lines: DataFrame) -> DataFrame:
    """Per session: ok, n_lines, last_boundary, boundary_line; a maximum with partial results before the shuffle."""
    return _narrowed(lines).groupBy("session").agg(
        F.bool_or("full").alias("ok"),
        F.count("*").alias("n_lines"),
        F.max(F.when(F.col("b").isNotNull(), F.struct("line_no", "b"))).alias("m"),
    ).select("session", "ok", "n_lines", F.col("m.b").alias("last_boundary"), F.col("m.line_no").alias("boundary_line"))


def scan(lines: DataFrame) -> DataFrame:
    """Per session of (session, line_no, line): ok, lines, last_boundary, boundary_line, n_resident, first five handles.

    Lines are reduced to what ``narrow`` finds (or come so: session, line_no, b, full, hs) and written, so each is parsed
    once. The lines after the boundary are found by a join on the session, one row each, so a hot session is split by the
    join's own means; the handles are counted as distinct pairs.
    """
    lines = written(_narrowed(lines), "lines")
    last = boundaries(lines)
    held = resident(lines, last)
    five = held.groupBy("session").agg(F.count("*").alias("n_resident"), F.slice(F.array_sort(F.collect_set(F.when(F.col("k") <= 5, F.col("handle")))), 1, 5).alias("sample"))
    return last.join(five, "session", "left").withColumns({"n_resident": F.coalesce("n_resident", F.lit(0)), "sample": F.coalesce(F.array_join("sample", " "), F.lit(""))})


def resident(lines: DataFrame, last: DataFrame) -> DataFrame:
    """(session, handle, k): distinct handles on lines after the last boundary; k numbers the first ones in order."""
    found = _narrowed(lines).select("session", "line_no", F.explode("hs").alias("handle"))
    after = found.join(last.filter("ok").select("session", "boundary_line"), "session").filter("boundary_line is null or line_no > boundary_line")
    pairs = after.select("session", "handle").distinct()
    # five smallest of each bucket first, then of the session: no window holds all handles of a session
    bucket = F.pmod(F.xxhash64("handle"), F.lit(64))
    near = pairs.withColumn("k", F.row_number().over(Window.partitionBy("session", bucket).orderBy("handle")))
    few = near.filter("k <= 5").withColumn("k", F.row_number().over(Window.partitionBy("session").orderBy("handle")))
    return near.filter("k > 5").unionByName(few)


def proof(lines: DataFrame) -> DataFrame:
    """(session, ok, handle) for ``conditional.residency``: what each transcript still shows after its last boundary.

    Each session has a row with a null handle, so one that shows nothing proves nothing.
    """
    last = boundaries(lines)
    held = resident(lines, last).select("session", F.lit(True).alias("ok"), "handle")
    return last.select("session", "ok", F.lit(None).cast("string").alias("handle")).unionByName(held)
