"""Far too many small files: a plan that packs their records into few files of about equal size, exactly once each.

The manifest (one row per small file) is frozen first: reduced to records, range-partitioned in the wanted order and
written to the shared folder with the number of its part. On the frozen manifest the plan is SQL only: bytes are
summed by window inside each part, parts are put behind each other by the sum of the part totals, and a record goes
to the group in whose target-sized interval it begins. The plan is written once; ``rewrite`` writes one file per group,
all in one folder, and ``reconcile`` compares what was written with the plan.

Full rows are shuffled once, to their group: a group is an interval of file ids, found by binary search among the first
ids of all groups, and meets the narrow rows of its plan there. Digests of 64 hex digits travel as 32 bytes
(``record_key``), and after the manifest only those of records in several files travel at all.

Defined results: ``sha256`` is compared without letter case and spaces at both ends. Files with null ``sha256``, null
``len`` or ``len`` 0 hold no record and are in no group. Of files that hold the same record the least ``file_id``
stands for it; a null ``file_id`` stands only if no other file holds the record. A record larger than the target
begins in its interval like any other. ``file_id`` is unique; the same row listed twice is written once, and what else
ids that repeat would do shows in ``reconcile``. An empty manifest gives no groups. The rewrite carries every column under its
own name, whatever it is.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilefold.session import new_path, written

TARGET_BYTES = 128 << 20
MOST_BOUNDS = 2_000_000  # groups whose first ids are sent to the executors, 16 MB; beyond that rows find their group by a join
RECORDS_PER_PART = 500_000  # of the frozen manifest: what one window of the plan holds
COPIES_PER_SALT = 1_000  # of one record: its pairs are made in so many slices of about this many files


def record_key(sha: Column) -> Column:
    """Equal bytes for equal ``sha256``: a digest in half the length, any other text behind so many bytes that it is longer."""
    text = F.lower(F.btrim(sha, F.lit(" ")))
    hexed = text.rlike(r"\A[0-9a-f]{64}\z")
    return F.when(hexed, F.unhex(text)).otherwise(F.concat(F.lit(bytes(33)), F.encode(text, "UTF-8")))


def valid_files(files: DataFrame) -> DataFrame:
    """(file_id, key, len) of the files that hold a record."""
    return files.select("file_id", record_key(F.col("sha256")).alias("key"), "len").filter("key is not null and len is not null and len <> 0")


def frozen_manifest(files: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per record (file_id, len, copies, key, part), ordered over ``part`` by file_id, written once.

    ``key`` is kept where a later step asks for it: of records in several files or without an id. The number of parts
    follows the number of files, so no window of the plan grows with the data.
    """
    least = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or max(least, math.ceil(files.count() / RECORDS_PER_PART))
    records = valid_files(files).groupBy("key", "len").agg(F.min("file_id").alias("file_id"), F.count("*").alias("copies"))
    kept = F.when((F.col("copies") > 1) | F.col("file_id").isNull(), F.col("key")).alias("key")
    ranged = records.select("file_id", "len", "copies", kept).repartitionByRange(parts, "file_id", "len", "key")
    return written(ranged.withColumn("part", F.spark_partition_id()), "manifest")


def plan(manifest: DataFrame, target: int = TARGET_BYTES) -> DataFrame:
    """The manifest with ``group_no`` and ``start``, the bytes before the record in the whole order; written once."""
    planned = manifest.sparkSession.sql(
        """
        with totals as (select part, sum(greatest(len, 0)) as bytes from {manifest} group by part),
        base as (
          select part, coalesce(sum(bytes) over (order by part rows between unbounded preceding and 1 preceding), 0) as before
          from totals),
        inside as (
          select *, sum(greatest(len, 0)) over (partition by part order by file_id, len, key rows between unbounded preceding and current row) as upto
          from {manifest})
        select file_id, len, copies, key, part, before + upto - greatest(len, 0) as start,
               (before + upto - greatest(len, 0)) div cast({target} as bigint) as group_no
        from inside join base using (part)
        """,
        manifest=manifest,
        target=target,
    )
    return written(planned, "plan")


def members(files: DataFrame, planned: DataFrame) -> DataFrame:
    """Which record, by its standing file, each file holds: (file_id, record_file, group_no, copies).

    A record in one file is its own row of the plan; only files of repeated records are joined, by their keys.
    """
    lone = planned.filter("copies = 1").select("file_id", F.col("file_id").alias("record_file"), "group_no", "copies")
    keys = planned.filter("copies > 1").select("key", "len", F.col("file_id").alias("record_file"), "group_no", "copies")
    return valid_files(files).join(keys, ["key", "len"]).select("file_id", "record_file", "group_no", "copies").unionByName(lone)


def same_record_pairs(files: DataFrame, planned: DataFrame) -> DataFrame:
    """Pairs of files that hold the same record, smaller id first; files that stand alone are left out before the join.

    The pairs are demanded one by one, so a record in k files has k(k-1)/2 of them; they are made in slices, one for each
    ``COPIES_PER_SALT`` copies, so that no task has more than about k times that many.
    """
    held = members(files, planned.filter("copies > 1")).filter("file_id is not null").select("record_file", "file_id", "copies").distinct()
    slices = F.ceil(F.col("copies") / COPIES_PER_SALT).cast("int")
    a = held.select("record_file", F.col("file_id").alias("file_id_a"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("salt"))
    b = held.select("record_file", F.col("file_id").alias("file_id_b"), F.pmod(F.xxhash64("file_id"), slices).cast("int").alias("salt"))
    return a.join(b, ["record_file", "salt"]).filter("file_id_a < file_id_b").select("file_id_a", "file_id_b").distinct()


def _group_of(planned: DataFrame, n_groups: int):
    """Column function from file id to its group: the last one whose first id is not greater, else the first.

    Files that stand for no record get a group too; they meet no row of the plan there.
    """
    first = planned.filter("file_id is not null").groupBy("group_no").agg(F.min("file_id").alias("f")).orderBy("f").toPandas() if n_groups else pd.DataFrame({"group_no": [], "f": []})
    bounds = planned.sparkSession.sparkContext.broadcast((first["f"].to_numpy(np.int64), first["group_no"].to_numpy(np.int64)))

    @F.pandas_udf("bigint")
    def group_of(ids: pd.Series) -> pd.Series:
        lows, groups = bounds.value
        if not len(groups):
            return pd.Series(0, ids.index)
        return pd.Series(groups[np.maximum(np.searchsorted(lows, ids.to_numpy(np.int64), side="right") - 1, 0)], ids.index)

    return group_of


def rewrite(files: DataFrame, planned: DataFrame, path: str | None = None, most_bounds: int = MOST_BOUNDS) -> str:
    """Write the standing file's row of every record into one Parquet file per group; gives the folder.

    Each group is a task of its own, its rows in the order of the plan. The columns are ``group_no``, ``start`` and
    ``row`` with all columns of the small files.
    """
    path = path or new_path(files.sparkSession, "compacted")
    counts = planned.agg(F.coalesce(F.max("group_no") + 1, F.lit(0)).alias("upto"), F.count_distinct("group_no").alias("n"), F.count_if(F.col("file_id").isNull()).alias("nameless")).first()
    rows = files.select("file_id", F.struct(*files.columns).alias("row"))
    named = rows.filter("file_id is not null")
    wanted = planned.filter("file_id is not null").select("group_no", "start", "file_id")
    if counts["n"] <= most_bounds:
        placed = named.select(_group_of(planned, counts["n"])(F.col("file_id")).alias("group_no"), "file_id", "row")
    else:
        placed = named.join(wanted.select("file_id", "group_no"), "file_id").select("group_no", "file_id", "row")
    none = F.lit(None)
    both = placed.select("group_no", "file_id", none.cast("bigint").alias("start"), "row").unionByName(wanted.select("group_no", "file_id", "start", none.cast(rows.schema["row"].dataType).alias("row")))
    if counts["nameless"]:  # records that only files without an id hold
        keep = planned.filter("file_id is null").select("key", "len", "group_no", "start")
        lone = rows.filter("file_id is null").join(keep, (record_key(F.col("row.sha256")) == F.col("key")) & (F.col("row.len") == keep["len"]))
        both = both.unionByName(lone.select("group_no", "file_id", "start", "row").dropDuplicates(["start", "group_no"]))
    if counts["upto"] <= 2 * counts["n"] + 100:
        out, n = both.withColumn("_task", F.col("group_no").cast("int")), counts["upto"]
    else:  # records far larger than the target leave most numbers without a group
        used = planned.select("group_no").distinct()
        used = used.withColumn("_task", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("group_no")) - 1)  # one row per file to be written
        out, n = both.join(used, "group_no"), counts["n"]
    out = out.repartitionById(max(n, 1), F.col("_task"))
    # the plan's row and the file's row of one id meet; a row without an id has both already
    own = F.when(F.col("file_id").isNull(), F.col("start"))
    met = out.groupBy("_task", "file_id", own.alias("_own")).agg(F.first("group_no").alias("group_no"), F.first("start", True).alias("start"), F.first("row", True).alias("row"))
    met.filter("start is not null and row is not null").sortWithinPartitions("start").select("group_no", "start", "row").write.parquet(path)
    return path


def reconcile(planned: DataFrame, path: str) -> DataFrame:
    """Per group: records and bytes planned and written, the number of files, and whether all agree."""
    want = planned.groupBy("group_no").agg(F.count("*").alias("planned_records"), F.sum("len").alias("planned_bytes"))
    got = (
        planned.sparkSession.read.parquet(path)
        .select("group_no", F.col("row.len").alias("len"), F.input_file_name().alias("f"))
        .groupBy("group_no", "f")
        .agg(F.count("*").alias("r"), F.sum("len").alias("b"))
        .groupBy("group_no")
        .agg(F.sum("r").alias("written_records"), F.sum("b").alias("written_bytes"), F.count("*").alias("files"))
    )
    agree = F.col("planned_records").eqNullSafe(F.col("written_records")) & F.col("planned_bytes").eqNullSafe(F.col("written_bytes"))
    return want.join(got, "group_no", "full").withColumn("agree", agree & (F.col("files") == 1))
