"""Building blocks that keep ordered work distributed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per_id(df: DataFrame, id_col: str, *order: str | Column) -> DataFrame:
    """The first row of each id in ``order``; rows with a null id are kept, each is its own.

    Ties on ``order`` are broken by a hash of the other columns, so that equal rows and no others tie.
    """
    lone = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    hashable = [c for c, kind in df.dtypes if "map<" not in kind and kind != "variant"]
    w = Window.partitionBy(F.col(id_col), lone).orderBy(*order, F.xxhash64(*hashable))
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def running_sums(
    df: DataFrame, groups: Sequence[str], chunk: str, order: Sequence[str | Column], sums: dict[str, str]
) -> DataFrame:
    """Inclusive running sums inside ``groups`` in the order (chunk, *order), in two levels.

    ``chunk`` cuts each group into bounded parts and must rise with the wanted order. The parts are summed
    first; only their totals, one row for each chunk, meet in one window per group, so no task holds a group.
    ``sums`` maps new column to summed column. ``df`` must be stable between uses (a table or written).
    """
    keys = [*groups, chunk]
    totals = df.groupBy(*keys).agg(*(F.sum(v).alias(f"_t_{k}") for k, v in sums.items()))
    before = Window.partitionBy(*groups).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        *keys, *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums)
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = df.withColumns({k: F.sum(v).over(inside) for k, v in sums.items()})
    joined = here.join(base, keys, "left")
    return joined.withColumns({k: F.col(k) + F.col(f"_b_{k}") for k in sums}).drop(*(f"_b_{k}" for k in sums))
