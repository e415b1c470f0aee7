"""The residency ledger: last line per session and handle, eviction flags, and the token budget.

Defined results: a null ``code`` or ``tokens`` makes a line unreadable, and it is skipped; so is one with a null handle,
step, code outside 0..255 or negative numbers. Of equal (session, handle) the last ``line_id`` counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilefold.config import DEFAULT_BUDGET
from tilefold.plans.prefix import running_sums
from tilefold.session import written

RESIDENT, EVICTED = 0, 1
ROWS_PER_PART = 500_000


def residency(code: Column) -> Column:
    return F.when(code == RESIDENT, F.lit("resident")).when(code == EVICTED, F.lit("evicted")).otherwise(F.lit("unknown"))


def state(lines: DataFrame) -> DataFrame:
    """The ledger as loaded: (session, handle, code, step, tokens), the last readable line of each handle.

    Partial maxima are taken before the shuffle, so a session that holds a third of the lines is no hot task.
    """
    good = lines.filter("handle is not null and code >= 0 and step >= 0 and tokens >= 0")
    last = good.groupBy("session", "handle").agg(F.max(F.struct("line_id", "code", "step", "tokens")).alias("l"))
    return last.select("session", "handle", F.col("l.code").cast("int").alias("code"), "l.step", "l.tokens")


def note(ledger: DataFrame, shown: DataFrame) -> DataFrame:
    """The ledger with ``shown`` (session, handle, step, tokens) resident; of one handle noted often the last step."""
    new = shown.groupBy("session", "handle").agg(F.max(F.struct("step", "tokens")).alias("l"))
    new = new.select("session", "handle", F.lit(RESIDENT).alias("code"), "l.step", "l.tokens")
    return ledger.join(new, ["session", "handle"], "left_anti").select(*new.columns).unionByName(new)


def record_residency(ledger: DataFrame, marked: DataFrame) -> DataFrame:
    """``note`` for handles marked from outside, (session, handle, step): their token weight is not known, hence 0."""
    return note(ledger, marked.select("session", "handle", "step", F.lit(0).cast("bigint").alias("tokens")))


def evict(ledger: DataFrame, gone: DataFrame) -> DataFrame:
    """The ledger with the handles of ``gone`` (session, handle) flagged, where they are in it."""
    flag = gone.select("session", "handle").distinct().withColumn("_gone", F.lit(True))
    out = ledger.join(flag, ["session", "handle"], "left")
    return out.withColumn("code", F.when(F.col("_gone"), EVICTED).otherwise(F.col("code"))).drop("_gone")


def resident_tokens(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("session").agg(
        F.coalesce(F.sum(F.when(F.col("code") == RESIDENT, F.col("tokens"))), F.lit(0)).alias("resident_tokens"), F.count("*").alias("handles")
    )


def enforce_budget(ledger: DataFrame, budget: int = DEFAULT_BUDGET) -> DataFrame:
    """The ledger after eviction of the oldest steps, until what is left is within the budget.

    A row is evicted if the rows before it in (step, handle) do not yet cover the excess. The rows are put in that order
    over parts of a bounded number of rows, and running sums are made in two levels, so no task holds a session.
    """
    ledger = written(ledger, "ledger")
    live = ledger.filter(F.col("code") == RESIDENT).select("session", "step", "handle", "tokens")
    parts = max(int(ledger.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(live.count() / ROWS_PER_PART))
    live = written(live.repartitionByRange(parts, "session", "step", "handle").withColumn("part", F.spark_partition_id()), "ordered")
    summed = running_sums(live, ["session"], "part", ["step", "handle"], {"upto": "tokens"})
    over = resident_tokens(ledger).select("session", (F.col("resident_tokens") - budget).alias("over"))
    gone = summed.join(over, "session").filter(F.col("upto") - F.col("tokens") < F.col("over"))
    return evict(ledger, gone)
