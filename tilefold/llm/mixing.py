"""Mixing sources to target weights by systematic sampling.

Every page of a source is expected ``f`` times in the mix, with f = target share x total / size of the source, at most
``max_repeats``. Expected copies are summed up in order inside the source, one random offset is added, and a page is
emitted once for every whole number that its sum crosses. The order is by size class and hash, so the sample has each
size in proportion and the share comes out close to its target.

The prefix sums are of counts, hence exact in any order of execution, and are made in two levels: a source is cut into
parts by size class and hash, and only the totals of parts meet in one window. A source with a third of all rows is
spread over as many tasks as it has parts.

Defined results: ``source`` is compared in lower case without spaces at both ends. Pages whose source has no target,
or is null, are in no mix. A null text has size 0 and takes part in the sampling like an empty one. A target without
pages, without share or with ``max_repeats`` < 1 gets none and is reported. Sources repeated in the targets count once
(the largest share). Empty tables give no copies; the report still has a row for each target.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilefold.plans.prefix import running_sums

ROWS_PER_PART = 200_000
BROADCAST_TARGETS = 10_000


def source_key(c: Column) -> Column:
    return F.lower(F.btrim(c, F.lit(" ")))


def _small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``BROADCAST_TARGETS`` rows; else the planner joins by shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_TARGETS + 1).count() <= BROADCAST_TARGETS else df


def demand(sized: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """Per target: pages, size, wanted size and expected copies ``f`` of each page.

    ``sized`` has (doc_id, source, n_tokens); ``total`` is the size of the mix, by default that of all pages with a target.
    """
    want = targets.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")
    size = sized.groupBy(source_key(F.col("source")).alias("source")).agg(
        F.count("*").alias("pages"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("size")
    )
    joined = want.join(size, "source", "left").withColumns(
        {"pages": F.coalesce("pages", F.lit(0)), "size": F.coalesce("size", F.lit(0)), "max_repeats": F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))}
    )
    if total is None:
        total = joined.agg(F.sum("size")).first()[0] or 0
    wanted = F.coalesce(F.col("target_share"), F.lit(0.0)) * float(total)
    f = F.when(F.col("size") > 0, F.least(wanted / F.col("size"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return joined.withColumns({"wanted": wanted, "f": f})


def mix(sized: DataFrame, demanded: DataFrame, seed: int = 17, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the pages in the mix. Both inputs must be stable between uses."""
    offset = random.Random(seed).random()
    rates = _small(demanded.filter("f > 0").select("source", "f"))
    rows = sized.select("doc_id", source_key(F.col("source")).alias("source"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")).join(rates, "source")
    most = demanded.agg(F.max("pages")).first()[0] or 1
    subs = max(1, math.ceil(most / rows_per_part))
    draw = F.xxhash64("doc_id", F.lit(seed))
    size_class = F.floor(F.log2(F.col("n_tokens") + 1) * 2)
    rows = rows.withColumns({"part": (size_class * subs + F.pmod(draw, F.lit(subs))).cast("bigint"), "draw": draw, "one": F.lit(1)})
    ranked = running_sums(rows, ["source"], "part", ["n_tokens", "draw", "doc_id"], {"rank": "one"})
    crossed = F.floor(F.col("rank") * F.col("f") + offset) - F.floor((F.col("rank") - 1) * F.col("f") + offset)
    return ranked.withColumn("copies", crossed).filter("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def shares(demanded: DataFrame, mixed: DataFrame) -> DataFrame:
    """Per target the size and share wanted and reached, the most copies of one page, and whether it can be reached.

    The verdict is read off the mix: a target cannot be reached if every page is used to its cap and the size is still
    short of the wanted one. The expected copies are then the cap, a whole number, so the mix holds exactly that many.
    ``mixed`` must be stable between uses.
    """
    got = mixed.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_size"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies")
    )
    out = demanded.join(got, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("mixed_size", "copies", "most_copies")})
    total = mixed.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0] or 0
    share = F.col("mixed_size") / total if total else F.lit(0.0)
    used_up = F.col("mixed_size") >= F.col("max_repeats") * F.col("size")
    out = out.withColumn("reachable", ~((F.col("wanted") > F.col("mixed_size")) & used_up))
    return out.select("source", "target_share", share.alias("share"), "pages", "size", "wanted", "mixed_size", "copies", "most_copies", "max_repeats", "reachable")
