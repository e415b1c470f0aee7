"""Readers and writers of the record formats: blobs, metrics and decision lines, ledgers, transcripts, side-cars.

Readers never fail on a bad line; what a format calls unreadable is left out, missing folders give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tilefold.functions.handles import sidecar_path
from tilefold.functions.json_fields import boolean_of, number_of, string_of, tolerant
from tilefold.operators.decisions import REASONS
from tilefold.operators.documents import pack_document
from tilefold.session import written

METRICS = {
    "number": ("t", "raw", "shown", "saved", "delta_hits", "evicted", "tokens"), "string": ("event", "session", "handle", "mode", "caller"), "boolean": ("ok",),
}
DECISIONS = {"number": ("t", "bytes", "raw_tokens", "view_tokens"), "string": ("reason", "path", "redirect_to", "note")}
META = {"number": ("len", "created", "accessed"), "string": ("sha256", "ct", "source", "session", "project")}
_READERS = {"number": number_of, "string": string_of, "boolean": boolean_of}
MOST_BLOCKS = 100_000  # of files, whose places are sent to all tasks; beyond that they are joined by shuffle


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, numbered from 0 inside each file, feeds and carriage returns dropped.

    Files are read in splits. The number of a line is its place in its split behind the lines of the splits before it;
    only the counts of splits are shuffled. A file with a byte that is no UTF-8 is left out as a whole.
    """
    try:
        text = spark.read.option("lineSep", "\n").text(path)
    except AnalysisException:
        return spark.createDataFrame([], "file string, line_no bigint, line string")
    at = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    rows = text.select(at[0].alias("file"), at[1].alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    rows = rows.withColumn("line", F.when(F.col("value").endswith("\r"), F.expr("substr(value, 1, char_length(value) - 1)")).otherwise(F.col("value")))
    blocks = rows.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"), F.bool_and(F.is_valid_utf8("value")).alias("_ok"))
    by_file = Window.partitionBy("file")
    before = F.coalesce(F.sum("_n").over(by_file.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = written(blocks.withColumns({"_before": before, "_good": F.bool_and("_ok").over(by_file)}).filter("_good").select("file", "_block", "_first", "_before"), "splits")
    if blocks.count() <= MOST_BLOCKS:
        blocks = F.broadcast(blocks)
    numbered = rows.select("file", "_block", "_at", "line").join(blocks, ["file", "_block"])
    return numbered.select("file", (F.col("_before") + F.col("_at") - F.col("_first")).alias("line_no"), "line")


def _record(lines: DataFrame, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """The fields of each line that begins with a JSON value; a field of another type is null."""
    rows = lines.select("file", "line_no", tolerant(F.col("line")).alias("_v")).filter("_v is not null")
    return rows.select("file", "line_no", *(_READERS[kind](F.col("_v"), name).alias(name) for kind, names in fields.items() for name in names))


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: (path, bytes, mtime)."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("bytes"), F.unix_timestamp("modificationTime").alias("mtime"))


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics lines; a line that is no JSON is left out, numbers are cut to integers, a file that is no UTF-8 is empty."""
    return _record(_lines(spark, path), METRICS).withColumn("line_id", F.col("line_no"))


def decisions(spark: SparkSession, path: str) -> DataFrame:
    rows = _record(_lines(spark, path), DECISIONS).withColumn("entry_id", F.col("line_no"))
    return rows.filter(F.col("t").isNotNull() & F.col("reason").isin(*REASONS))


def meta(spark: SparkSession, path: str) -> DataFrame:
    """Sidecar records: sha256 and len are required, times default to 0."""
    rows = _record(_lines(spark, path), META).filter("sha256 is not null and len is not null")
    return rows.withColumnRenamed("ct", "content_type").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("created", "accessed")})


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger lines: four tab-separated fields or more, of which code, step and tokens are unsigned numbers."""
    f = F.split("line", "\t", -1)
    number = lambda i: F.when(F.get(f, F.lit(i)).rlike(r"\A\+?[0-9]++\z"), F.get(f, F.lit(i)).try_cast("bigint"))
    rows = _lines(spark, path).select(
        F.regexp_extract("file", r"([^/]*?)(?:\.tsv)?\z", 1).alias("session"), F.col("line_no").alias("line_id"),
        f[0].alias("handle"), number(1).alias("code"), number(2).alias("step"), number(3).alias("tokens"),
    )
    return rows.filter("code <= 255 and step is not null and tokens is not null")


def transcript(spark: SparkSession, path: str) -> DataFrame:
    """(session, line_no, line) of transcript files, one session per file."""
    return _lines(spark, path).select(F.regexp_extract("file", r"([^/]*?)(?:\.jsonl)?\z", 1).alias("session"), "line_no", "line")


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Append records as JSON lines, absent fields left out."""
    rows.write.mode("append").json(path)


def save_ledger(state: DataFrame, path: str) -> None:
    """Write a ledger as tab-separated lines, a folder per session."""
    state.select("session", F.concat_ws("\t", "handle", "code", "step", "tokens").alias("value")).write.mode("overwrite").partitionBy("session").text(path)


def sidecars(docs: DataFrame, force: bool = False) -> DataFrame:
    """(path, out_path, view, raw_tokens, packed_tokens, written) of (path, bytes); a view that is not smaller is not
    written, unless forced. The source is never a target, as the side-car's name differs from it."""
    p = pack_document(F.col("path"), F.col("bytes"))
    out = docs.withColumn("_p", p).select("path", sidecar_path(F.col("path")).alias("out_path"), "_p.*")
    return out.withColumn("written", F.lit(force) | (F.col("packed_tokens") < F.col("raw_tokens")))


def write_sidecars(docs: DataFrame, folder: str, force: bool = False) -> None:
    """Write the views that may be written as text, one file per document."""
    kept = sidecars(docs, force).filter("written").select(F.regexp_replace("out_path", r"[/:]", "_").alias("name"), F.col("view").alias("value"))
    kept.repartition("name").write.mode("overwrite").option("lineSep", "\n").partitionBy("name").text(folder)
