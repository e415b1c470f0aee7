"""The block store: content-addressed rows (handle, shard, bytes) beside their metadata, verified on read.

``shard`` is the partition column; Catalyst does not derive it from a handle, so reads by handle add it themselves.
Stores and metadata are snapshots: a change gives a new table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilefold.config import HANDLE_PREFIX
from tilefold.functions import handles as H
from tilefold.functions.text import as_text, count_lines, log_lines, tokens, tokens_bytes
from tilefold.operators import recall

TOUCH_SECONDS = 60


def put(blocks: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """Rows to append for (seq, session, bytes): (handle, shard, bytes, first_session), each content once.

    The first writer names the session: the least ``seq`` (of any type that has an order), of equal ones the least
    session. Content that ``store`` has already is left out. Bytes are shuffled once, repeats are dropped before it.
    """
    rows = blocks.filter("bytes is not null").select("seq", "session", "bytes", H.handle(F.col("bytes")).alias("handle"))
    new = rows.groupBy("handle").agg(F.min(F.struct("seq", F.col("session").isNull(), "session")).alias("_w"), F.first("bytes").alias("bytes"))
    if store is not None:
        new = new.join(store.select("handle"), "handle", "left_anti")
    return new.select("handle", H.shard(F.col("handle")).alias("shard"), "bytes", F.col("_w.session").alias("first_session"))


def write(rows: DataFrame, path: str) -> None:
    """Append to a store folder, partitioned by shard; each task writes whole shards."""
    rows.repartition("shard").write.mode("append").partitionBy("shard").parquet(path)


def meta_of(rows: DataFrame, now: int) -> DataFrame:
    """Metadata rows of new blocks; only handles of the current form have any."""
    return rows.filter(F.col("handle").startswith(HANDLE_PREFIX)).select(
        "handle",
        H.sha256_hex(F.col("bytes")).alias("sha256"),
        F.octet_length("bytes").cast("bigint").alias("len"),
        F.lit(now).cast("bigint").alias("created"),
        F.lit(now).cast("bigint").alias("accessed"),
        F.col("first_session").alias("session"),
    )


def touch(meta: DataFrame, now: int) -> DataFrame:
    """Metadata with the access time moved on, unless it is less than a minute old."""
    old = F.coalesce(F.col("accessed"), F.lit(0))
    return meta.withColumn("accessed", F.when(F.greatest(F.lit(now) - old, F.lit(0)) >= TOUCH_SECONDS, F.lit(now).cast("bigint")).otherwise(old))


def matches(sha: Column, length: Column, b: Column) -> Column:
    """Whether metadata describes these bytes; the digest is computed only where the length agrees."""
    return F.when(F.octet_length(b) != length, False).when(~sha.rlike(r"\A[0-9a-fA-F]{64}\z"), False).otherwise(F.sha2(b, 256) == sha)


def get(store: DataFrame, wanted: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """(handle, bytes) of each wanted handle; null bytes if no copy verifies.

    ``store`` may have a column ``priority`` (0 sharded, 1 flat copies); the first copy wins that fits its handle and,
    where there is readable metadata, that too.
    """
    keys = wanted.select("handle").distinct()
    copies = store if "priority" in store.columns else store.withColumn("priority", F.lit(0))
    # joined by the handle alone, so the bytes need no second shuffle to be grouped by it
    found = keys.join(copies.select("handle", F.col("shard").alias("_shard"), "bytes", "priority"), "handle").filter(F.col("_shard") == H.shard(F.col("handle")))
    good = H.verify(F.col("handle"), F.col("bytes"))
    if meta is not None:
        found = found.join(meta.select("handle", "sha256", "len"), "handle", "left")
        good = good & F.when(F.col("sha256").isNull() | F.col("len").isNull(), True).otherwise(matches(F.col("sha256"), F.col("len"), F.col("bytes")))
    best = found.filter(good).groupBy("handle").agg(F.min_by("bytes", "priority").alias("bytes"))
    return keys.join(best, "handle", "left")


def block_session(wanted: DataFrame, meta: DataFrame) -> DataFrame:
    """(handle, session): who stored a block first; null for legacy handles and blocks without metadata."""
    named = meta.filter(F.col("handle").startswith(HANDLE_PREFIX)).select("handle", "session")
    return wanted.select("handle").distinct().join(named, "handle", "left")


def delete(store: DataFrame, gone: DataFrame) -> DataFrame:
    return store.join(gone.select("handle"), "handle", "left_anti")


def size(store: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """(blocks, bytes) of the store folder; metadata files count where they are given."""
    blocks = store.agg(F.count("*").alias("blocks"), F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0)).alias("bytes"))
    if meta is None:
        return blocks
    side = meta.agg(F.count("*").alias("m"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*meta.columns)))), F.lit(0)).alias("mb"))
    return blocks.crossJoin(side).select((F.col("blocks") + F.col("m")).alias("blocks"), (F.col("bytes") + F.col("mb")).alias("bytes"))


def expand(
    store: DataFrame, requests: DataFrame, meta: DataFrame, lines: tuple[int, int] | None = None, pattern: str | None = None, context: int = 0, caller: str = "api"
) -> DataFrame:
    """Metrics rows of recalls, (handle, session): tokens charged to who stored the block, else to who asked.

    The tokens are those of what comes back: all bytes, the lines, or the lines that match. ``mode`` is grep with a
    pattern, else lines with a range, else whole. A handle that is not stored gives ``ok`` = false and no tokens.
    ``out`` has what came back.
    """
    got = get(store, requests, meta)
    who = block_session(requests, meta).withColumnRenamed("session", "_stored")
    out = requests.join(got, "handle", "left").join(who, "handle", "left").withColumn("out", recall.expand(F.col("bytes"), lines, pattern, context))
    return out.select(
        "handle",
        F.coalesce("_stored", "session").alias("session"),
        F.when(F.col("out").isNull(), F.lit(0)).otherwise(tokens_bytes(F.col("out"))).alias("tokens"),
        F.col("out").isNotNull().alias("ok"),
        F.lit("grep" if pattern is not None else "lines" if lines is not None else "whole").alias("mode"),
        F.lit(caller).alias("caller"),
        "out",
    )


def inspect(blocks: DataFrame) -> DataFrame:
    """(handle, n_bytes, n_lines, n_tokens, utf8, preview) of (handle, bytes); preview: the first three lines."""
    text = as_text(F.col("bytes"))
    utf8 = F.is_valid_utf8(F.col("bytes").cast("string"))
    return blocks.select(
        "handle",
        F.octet_length("bytes").cast("bigint").alias("n_bytes"),
        count_lines(text).alias("n_lines"),
        tokens(text).alias("n_tokens"),
        utf8.alias("utf8"),
        F.when(utf8, F.array_join(F.slice(log_lines(text), 1, 3), "\n")).alias("preview"),
    )
