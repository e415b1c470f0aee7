"""Age-based retention of stored blocks and cached views.

A block was last active when it was accessed, else created, else when its file was written; it is deleted at an age
of at least the threshold. A block of the current form without metadata is kept for a minute at least, as its writer
may still be at work. A block without any time is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilefold.config import HANDLE_PREFIX

MIN_AGE_WITHOUT_META = 60


def last_active() -> Column:
    when = F.when(F.col("accessed") > 0, F.col("accessed")).otherwise(F.col("created"))
    return F.coalesce(F.when(F.col("has_meta") & (when > 0), when), F.col("mtime"))


def judged(blocks: DataFrame, now: int, older_than: int) -> DataFrame:
    """``blocks`` (handle, len, has_meta, accessed, created, mtime) with ``kind`` block, ``covered`` and ``stale``."""
    at = last_active()
    young = ~F.col("has_meta") & F.col("handle").startswith(HANDLE_PREFIX)
    limit = F.when(young, max(older_than, MIN_AGE_WITHOUT_META)).otherwise(older_than)
    stale = F.coalesce(F.greatest(F.lit(now) - at, F.lit(0)) >= limit, F.lit(False))
    return blocks.withColumns({"kind": F.lit("block"), "covered": F.col("has_meta") & at.isNotNull(), "stale": stale})


def judged_cache(views: DataFrame, now: int, older_than: int) -> DataFrame:
    """Cached views (len, mtime); they have no metadata."""
    stale = F.coalesce(F.greatest(F.lit(now) - F.col("mtime"), F.lit(0)) >= older_than, F.lit(False))
    return views.select("len", F.lit("cache").alias("kind"), F.lit(False).alias("covered"), stale.alias("stale"))


def report(judged_rows: DataFrame, dry_run: bool = True) -> DataFrame:
    """The counts of a collection; they are the same for a dry run, which deletes nothing."""
    cache = F.col("kind") == "cache"
    return judged_rows.agg(
        F.count("*").alias("scanned"),
        F.count_if("stale").alias("deleted"),
        F.count_if(~F.col("stale")).alias("kept"),
        F.coalesce(F.sum(F.when(F.col("stale"), F.coalesce("len", F.lit(0)))), F.lit(0)).cast("bigint").alias("bytes_freed"),
        F.count_if("covered").alias("meta_present"),
        F.count_if(~F.col("covered")).alias("meta_missing"),
        F.count_if(cache).alias("read_cache_scanned"),
        F.count_if(cache & F.col("stale")).alias("read_cache_deleted"),
        F.lit(dry_run).alias("dry_run"),
    )


def survivors(judged_rows: DataFrame) -> DataFrame:
    """The next snapshot after a live collection."""
    return judged_rows.filter("not stale")


def coverage(blocks: DataFrame, meta: DataFrame) -> DataFrame:
    """(blocks, with_meta)."""
    named = meta.select("handle").distinct().withColumn("_m", F.lit(True))
    return blocks.join(named, "handle", "left").agg(F.count("*").alias("blocks"), F.count("_m").alias("with_meta"))
