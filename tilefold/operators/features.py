"""One row per entity with count, recency and total of every event type.

Event types are partitioned into blocks by hash. All lines are reduced once to cells (entity, event), with partial
sums before the shuffle, so an entity that holds a third of the rows sends one row per event type and map task.
The cells are written bucketed by entity and partitioned by block; each block is aggregated by entity and joined
onto the complete entity table. All of these share the buckets, so nothing after the write is shuffled.

A block is a map from event type to (n, last_t, total_saved): types need not be known or collected before, and their
number has no limit. ``wide`` projects chosen types to plain columns.

Defined results: entity and event are freed of spaces and tabs at both ends, the event is lower case; a line whose
entity is then null or empty does not count; a line whose event is null or empty counts for no cell, but its entity
gets a row. A repeated ``line_id`` counts once (the first by ``received_at``); lines with a null id all count. Null
``t`` or ``saved`` add nothing: ``last_t`` of a cell without any ``t`` is null, ``total_saved`` then is 0. Clocks in
seconds or microseconds are brought to milliseconds. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilefold.plans.prefix import one_per_id
from tilefold.session import new_path

LINES_PER_BUCKET = 1_000_000
MAX_BUCKETS = 100_000  # what spark.sql.sources.bucketing.maxBuckets allows by default

# The clock of a line is in seconds below the first bound, in microseconds above the second.
SECONDS_BELOW, MICROS_ABOVE = 100_000_000_000, 100_000_000_000_000


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t"))


def clean_lines(lines: DataFrame) -> DataFrame:
    """(line_id, session, event, t, saved) with each line once and its keys in one spelling."""
    t = F.when(F.abs("t") < SECONDS_BELOW, F.col("t") * 1000).when(F.abs("t") > MICROS_ABOVE, F.floor(F.col("t") / 1000).cast("bigint")).otherwise(F.col("t"))
    once = one_per_id(lines.select("line_id", "received_at", "session", "event", "t", "saved"), "line_id", "received_at")
    return once.select(
        "line_id",
        F.nullif(trimmed(F.col("session")), F.lit("")).alias("session"),
        F.nullif(F.lower(trimmed(F.col("event"))), F.lit("")).alias("event"),
        t.alias("t"),
        "saved",
    ).filter("session is not null")


def cells(lines: DataFrame) -> DataFrame:
    """(session, event, n, last_t, total_saved); event is null for lines that only name their entity."""
    return clean_lines(lines).groupBy("session", "event").agg(
        F.count("*").alias("n"), F.max("t").alias("last_t"), F.coalesce(F.sum("saved"), F.lit(0)).alias("total_saved")
    )


def _buckets(lines: DataFrame) -> int:
    return min(MAX_BUCKETS, max(lines.sparkSession.sparkContext.defaultParallelism, math.ceil(lines.count() / LINES_PER_BUCKET)))


def _bucketed(found: DataFrame, n_blocks: int, n_buckets: int) -> DataFrame:
    """Cells with their ``block`` (-1 without an event), written partitioned by block and bucketed by session."""
    spark, conf = found.sparkSession, "spark.sql.hive.manageFilesourcePartitions"
    name = f"tilefold_cells_{uuid.uuid4().hex[:12]}"
    block = F.when(F.col("event").isNotNull(), F.pmod(F.xxhash64("event"), F.lit(n_blocks)).cast("int")).otherwise(-1)
    placed = found.withColumn("block", block).repartition(n_buckets, "session")
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")  # partitions are found by their folders, so the table can leave the catalog
    try:
        placed.write.partitionBy("block").bucketBy(n_buckets, "session").sortBy("session").option("path", new_path(spark, "cells")).saveAsTable(name)
        return spark.table(name)
    finally:
        spark.sql(f"drop table if exists {name}")
        spark.conf.set(conf, before)


def feature_blocks(lines: DataFrame, n_blocks: int = 8, n_buckets: int | None = None) -> DataFrame:
    """One row per session: ``session`` and maps ``block_0`` .. ``block_{n-1}`` of event to (n, last_t, total_saved).

    A map is null where the session has no event of that block.
    """
    stored = _bucketed(cells(lines), n_blocks, n_buckets or _buckets(lines))
    out = stored.select("session").distinct()
    for b in range(n_blocks):
        entry = F.struct("event", F.struct("n", "last_t", "total_saved"))
        part = stored.filter(F.col("block") == b).groupBy("session").agg(F.map_from_entries(F.collect_list(entry)).alias(f"block_{b}"))
        out = out.join(part, "session", "left")
    return out


def filled(features: DataFrame) -> DataFrame:
    """The filled cells (session, event, n, last_t, total_saved) of a feature table."""
    blocks = [c for c in features.columns if c.startswith("block_")]
    entries = F.flatten(F.array(*(F.coalesce(F.map_entries(b), F.expr(f"map_entries(map_filter({b}, (k, v) -> false))"), F.array()) for b in blocks)))
    return features.select("session", F.explode(entries).alias("e")).select("session", F.col("e.key").alias("event"), "e.value.*")


def wide(features: DataFrame, events: list[str]) -> DataFrame:
    """Plain columns n_<event>, last_<event>, saved_<event> of chosen event types; absent counts and totals are 0."""
    blocks = [c for c in features.columns if c.startswith("block_")]
    cols = [F.col("session")]
    for event in events:
        cell = F.coalesce(*(F.try_element_at(b, F.lit(event)) for b in blocks))
        cols += [
            F.coalesce(cell["n"], F.lit(0)).alias(f"n_{event}"),
            cell["last_t"].alias(f"last_{event}"),
            F.coalesce(cell["total_saved"], F.lit(0)).alias(f"saved_{event}"),
        ]
    return features.select(*cols)
