"""Savings out of the metrics log: per session and in total, two accounting rules, latest session, verdict.

Sums are partial before the shuffle, so a session with a tenth or a third of all lines is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilefold.functions.text import reduction_pct

NO_SESSION = "(no session)"


def _sum(when: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, value)), F.lit(0)).cast("bigint")


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def verdict(events: Column, net: Column) -> Column:
    return F.when(events == 0, "none").when(net > 0, "positive").otherwise("negative")


def sessions(lines: DataFrame, total: bool = False) -> DataFrame:
    """One row per session: events, expands, failures, raw, shown, saved, refetched, delta hits, evicted, net, verdict.

    A missing ``saved`` is raw - shown, a missing ``ok`` is true, a missing session has one row of its own; a line of
    another event only gives its session a row. With ``total`` one more row has the null session: the grand total, out of
    the same pass.
    """
    c, e = F.col("event").eqNullSafe("compress"), F.col("event").eqNullSafe("expand")
    ok = F.coalesce(F.col("ok"), F.lit(True))
    named = lines.withColumn("session", F.coalesce("session", F.lit(NO_SESSION)))
    out = (named.rollup("session") if total else named.groupBy("session")).agg(
        F.count_if(c).alias("compress_events"),
        F.count_if(e).alias("expand_calls"),
        F.count_if(e & ~ok).alias("failed_expands"),
        _sum(c, _zero("raw")).alias("raw"),
        _sum(c, _zero("shown")).alias("shown"),
        _sum(c, F.coalesce("saved", _zero("raw") - _zero("shown"))).alias("saved"),
        _sum(e & ok, _zero("tokens")).alias("refetched"),
        _sum(c, _zero("delta_hits")).alias("delta_hits"),
        _sum(c, _zero("evicted")).alias("evicted"),
    )
    out = out.withColumn("net", F.col("saved") - F.col("refetched"))
    return out.withColumns({"reduction_pct": reduction_pct(F.col("net"), F.col("raw")), "verdict": verdict(F.col("compress_events"), F.col("net"))})


def ranked(report: DataFrame) -> DataFrame:
    """Best net first; ties by name."""
    return report.orderBy(F.desc("net"), "session")


def summary(lines: DataFrame, session: str | None = None) -> DataFrame:
    """Totals by the other rule: a missing ``saved`` counts 0, and negative counts are 0."""
    rows = lines if session is None else lines.filter(F.col("session") == session)
    c, e = F.col("event").eqNullSafe("compress"), F.col("event").eqNullSafe("expand")
    failed = F.col("ok").eqNullSafe(False)

    def unsigned(name: str) -> Column:
        return F.greatest(_zero(name), F.lit(0))

    out = rows.agg(
        F.count_if(c).alias("compress_events"),
        _sum(c, unsigned("raw")).alias("raw"),
        _sum(c, unsigned("shown")).alias("shown"),
        _sum(c, _zero("saved")).alias("saved"),
        _sum(c, unsigned("delta_hits")).alias("delta_hits"),
        _sum(c, unsigned("evicted")).alias("evicted"),
        F.count_if(e).alias("expand_calls"),
        F.count_if(e & failed).alias("failed_expands"),
        _sum(e & ~failed, unsigned("tokens")).alias("refetched"),
    )
    return out.withColumn("net", F.col("saved") - F.col("refetched"))


def latest_session(lines: DataFrame) -> DataFrame:
    """(session, t): the compress line with the greatest ``t`` (missing: 0) and a session name; the last line of equals."""
    rows = lines.filter("event = 'compress' and session <> ''")
    best = rows.agg(F.max(F.struct(F.coalesce("t", F.lit(0)).alias("t"), F.col("line_id"), F.col("session"))).alias("m"))
    return best.select("m.session", "m.t").filter("session is not null")


def status(lines: DataFrame, store_size: DataFrame) -> DataFrame:
    """One row: totals, number of sessions, latest session, and the size of the store."""
    per = sessions(lines, total=True)
    whole = per.filter("session is null").select("compress_events", "expand_calls", "raw", "saved", "refetched", "net", "reduction_pct", "verdict")
    count = per.filter("session is not null").agg(F.count("*").alias("n_sessions"))
    latest = latest_session(lines).select(F.col("session").alias("latest_session"))
    one = F.lit(1).alias("_k")
    out = whole.select("*", one).join(count.select("*", one), "_k").join(latest.select("*", one), "_k", "left").join(store_size.select("*", one), "_k", "left")
    return out.drop("_k")
