"""Decisions on whether a read is redirected to a cached view, and their log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilefold.functions.handles import cache_key

# Sizes and percentage of the decision, and the reasons of the log.
MIN_BYTES, MAX_BYTES, MIN_PERCENT = 8 * 1024, 4 * 1024 * 1024, 25
REASONS = (
    "gate-disabled", "bad-input", "slicing-requested", "file-unreadable", "too-small", "too-large", "file-changed",
    "worse-than-raw", "redirect-emitted", "cache-hit", "not-resident", "no-transcript-proof", "updated-input-rejected",
)


def reason(gate: Column, path: Column, sliced: Column, n_bytes: Column, raw: Column, view: Column, cached: Column, healthy: Column) -> Column:
    """The first reason that holds; ``n_bytes`` is null for a file that cannot be read, ``raw`` and ``view`` are tokens."""
    pct = F.when(raw > 0, F.floor(F.abs(raw - view) * 100 / raw) * F.sign(raw - view)).otherwise(F.lit(0))
    return (
        F.when(~gate, "gate-disabled")
        .when(path.isNull() | path.rlike(r"\A[\t-\r \x{85}\p{Z}]*+\z"), "bad-input")
        .when(sliced, "slicing-requested")
        .when(n_bytes.isNull(), "file-unreadable")
        .when(n_bytes < MIN_BYTES, "too-small")
        .when(n_bytes > MAX_BYTES, "too-large")
        .when(pct < MIN_PERCENT, "worse-than-raw")
        .when(cached & healthy, "cache-hit")
        .otherwise("redirect-emitted")
    )


def decide(reads: DataFrame) -> DataFrame:
    """Log rows of reads (gate, path, sliced, n_bytes, digest, raw_tokens, view_tokens, cached, healthy)."""
    c = F.col
    why = reason(c("gate"), c("path"), c("sliced"), c("n_bytes"), c("raw_tokens"), c("view_tokens"), c("cached"), c("healthy"))
    out = reads.withColumn("reason", why)
    measured = out["reason"].isin("worse-than-raw", "cache-hit", "redirect-emitted")
    redirected = out["reason"].isin("cache-hit", "redirect-emitted")
    sized = measured | out["reason"].isin("too-small", "too-large")
    return out.withColumns(
        {
            "bytes": F.when(sized, c("n_bytes")),
            "raw_tokens": F.when(measured, c("raw_tokens")),
            "view_tokens": F.when(measured, c("view_tokens")),
            "redirect_to": F.when(redirected, cache_key(c("digest"), c("path"))),
            "note": F.when(redirected & c("cached") & ~c("healthy"), "regenerated"),
        }
    )


def readable(log: DataFrame) -> DataFrame:
    """Log rows with a time and a known reason."""
    return log.filter(F.col("t").isNotNull() & F.col("reason").isin(*REASONS))


def tail(log: DataFrame, n: int) -> DataFrame:
    """The last ``n`` readable rows in log order."""
    return readable(log).orderBy(F.desc("entry_id")).limit(n).orderBy("entry_id")
