"""Filling containers with items: vector bin packing by the dot-product heuristic.

An item has a vector (tokens, segments, loss-bearing tokens), a container a limit for each. A container is opened and
filled with the item, of all that still fit, whose vector has the largest dot product with the room left, each
dimension as its share of the limit and weighted by how much the items not yet placed ask of it; when none fits, the next
container is opened.

Items meet in shards of a bounded number of items, drawn by a hash of the id and the place of the row, so every shard
has the same mix of sizes, whatever ids repeat, and ends with about one container that is not full. The number of shards
follows the number of items, and the planner may not merge them into few tasks, as it would for their few bytes. Inside a shard
equal vectors are one kind with a queue of ids, so a choice costs the number of kinds, not of items.

Defined results: an item over the token limit is split into pieces of exactly the limit and a rest, given as ranges of
tokens; its loss-bearing tokens and segments are spread in proportion. No other item is split. Null sizes count as 0;
an item of size 0 takes a segment and no room. An item within the token limit but over another limit is split by that
limit likewise. Repeats of one id are all placed. Empty input gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEMS_PER_SHARD = 20_000
TASKS_PER_PARTITION = 8  # of spark.sql.shuffle.partitions; beyond it a task packs several shards in turn
_OUT = "item_id bigint, piece bigint, n_pieces bigint, from_token bigint, to_token bigint, segments bigint, loss_tokens bigint, shard bigint, container bigint"


def pieces_of(size: int, segments: int, loss: int, limits: tuple[int, int, int]) -> list[tuple[int, int, int, int]]:
    """(from, to, segments, loss) of each piece: full pieces first, so that only the last one leaves room."""
    cap_t, cap_s, cap_l = limits
    k = max(1, -(-size // cap_t), -(-segments // cap_s), -(-loss // cap_l))
    if k == 1:
        return [(0, size, segments, loss)]
    step = cap_t if -(-size // cap_t) == k else -(-size // k)
    cuts = [min(size, i * step) for i in range(k + 1)]

    def spread(total: int, cap: int) -> list[int]:
        if not size:
            return [min(cap, total - i * cap) if total > i * cap else 0 for i in range(k)]
        upto, out = 0, []
        for i in range(k):
            x = total * cuts[i + 1] // size - upto
            x = min(cap, max(x, total - upto - cap * (k - 1 - i)))
            out.append(x)
            upto += x
        return out

    return list(zip(cuts, cuts[1:], spread(segments, cap_s), spread(loss, cap_l)))


def pack_vectors(vectors: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The container number of each vector; every vector must be within the limits."""
    n = len(vectors)
    bins = np.full(n, -1, dtype=np.int64)
    if not n:
        return bins
    kinds, which = np.unique(vectors, axis=0, return_inverse=True)
    which = which.reshape(-1)
    order = np.argsort(which, kind="stable")
    left = np.bincount(which, minlength=len(kinds))
    first = np.concatenate(([0], np.cumsum(left)))
    taken = np.zeros(len(kinds), dtype=np.int64)
    scale = kinds / limits  # each dimension as its share of the limit
    container, placed = 0, 0
    alive = np.arange(len(kinds))
    while placed < n:
        room = limits.astype(np.int64).copy()
        alive = alive[left[alive] > 0]
        fits = alive
        # what is left to place asks most of one dimension; that one counts most
        weight = left[alive] @ scale[alive]
        weight = weight / max(weight.max(), 1e-12) / limits
        while True:
            fits = fits[(kinds[fits] <= room).all(axis=1) & (left[fits] > 0)]
            if not len(fits):
                break
            k = fits[np.argmax(scale[fits] @ (room * weight))]
            # as many of this kind as stay the best choice cannot be told without asking again: one at a time
            bins[order[first[k] + taken[k]]] = container
            taken[k] += 1
            left[k] -= 1
            placed += 1
            room -= kinds[k]
        container += 1
    return bins


def pack(
    items: DataFrame,
    id_col: str = "item_id",
    size_col: str = "n_tokens",
    limits: tuple[int, int, int] = (2048, 256, 2048),
    segments_col: str | None = None,
    loss_col: str | None = None,
    items_per_shard: int = ITEMS_PER_SHARD,
) -> DataFrame:
    """One row per piece with its container (shard, container). ``items`` must be stable between uses.

    Without ``segments_col`` an item is one segment; without ``loss_col`` all its tokens bear loss.
    """
    size = F.coalesce(F.greatest(F.col(size_col), F.lit(0)), F.lit(0)).cast("bigint")
    src = items.select(
        F.col(id_col).cast("bigint").alias("item_id"),
        size.alias("size"),
        (F.coalesce(F.col(segments_col), F.lit(1)) if segments_col else F.lit(1)).cast("bigint").alias("segments"),
        (F.coalesce(F.col(loss_col), F.lit(0)) if loss_col else size).cast("bigint").alias("loss"),
    )
    shards = max(1, math.ceil(src.count() / items_per_shard))
    tasks = min(shards, TASKS_PER_PARTITION * int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    draw = F.xxhash64("item_id", F.monotonically_increasing_id())
    sharded = src.withColumn("shard", F.pmod(draw, F.lit(shards)).cast("bigint")).repartition(tasks, "shard")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item_id"], kind="stable")
        rows = []
        for item, size, segments, loss in zip(pdf["item_id"].astype("Int64"), pdf["size"], pdf["segments"], pdf["loss"]):
            cut = pieces_of(int(size), int(segments), int(loss), limits)
            rows += [(item, i, len(cut), *p) for i, p in enumerate(cut)]
        out = pd.DataFrame(rows, columns=["item_id", "piece", "n_pieces", "from_token", "to_token", "segments", "loss_tokens"])
        vectors = np.stack([out["to_token"] - out["from_token"], out["segments"], out["loss_tokens"]], axis=1).astype(np.int64)
        out["shard"] = int(pdf["shard"].iloc[0])
        out["container"] = pack_vectors(vectors, np.array(limits, dtype=np.int64))
        return out

    return sharded.groupBy("shard").applyInPandas(place, _OUT)


def containers(placed: DataFrame, limit: int = 2048) -> DataFrame:
    """Per container its pieces, tokens, segments, loss-bearing tokens and room left."""
    return placed.groupBy("shard", "container").agg(
        F.count("*").alias("pieces"),
        F.sum(F.col("to_token") - F.col("from_token")).alias("tokens"),
        F.sum("segments").alias("segments"),
        F.sum("loss_tokens").alias("loss_tokens"),
    ).withColumn("room", F.lit(limit) - F.col("tokens"))
