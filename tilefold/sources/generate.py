"""Generated files and logs of an edit and test loop, row by row on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FUNCTIONS = 40

# The lines of one handler; %1$d is its number, %2$d its weight.
HANDLER = (
    "/** Handler %1$d: validate the request, run the pipeline, return a result. */",
    "function handler%1$d(input, options) {",
    "  const ctx = prepare(input, options);",
    "  const items = ctx.items || [];",
    "  let acc = 0, skipped = 0;",
    "  for (let j = 0; j < items.length; j++) {",
    "    const it = items[j];",
    "    if (!it || it.disabled) { skipped++; continue; }",
    "    const w = typeof it.weight === 'number' ? it.weight : 1;",
    "    acc += w * %2$d * (it.factor || 1);",
    "    if (it.bonus) acc += it.bonus;",
    "  }",
    "  const score = normalize(acc, items.length - skipped);",
    "  if (score < 0) throw new RangeError('negative score in handler %1$d');",
    "  return finalize(score, ctx, %1$d);",
    "}",
    "",
)


def code_file(edited: Column, functions: int = FUNCTIONS) -> Column:
    """A module of handlers of which the first ``edited`` carry another constant."""

    def one(i: Column) -> Column:
        return F.format_string("\n".join(HANDLER), i, i + F.when(i < edited, 100).otherwise(0))

    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(functions - 1)), one), "\n")
    return F.concat(F.lit("// service.js — request handlers\n\n"), body)


def test_log(fixed: Column, functions: int = FUNCTIONS) -> Column:
    """A test run with four failures, of which ``fixed`` are mended."""
    failing = F.greatest(F.lit(4) - fixed, F.lit(0))
    line = lambda i: F.concat(F.when(i < failing, "FAIL").otherwise("PASS"), F.lit("  src/handler"), i.cast("string"), F.lit(".test.js"))
    return F.concat(
        F.lit("> service@1.0.0 test\n> jest --runInBand\n\n"),
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(functions - 1)), line), "\n"),
        F.lit("\n\nTests: "), (functions - failing).cast("string"), F.lit(" passed, "), failing.cast("string"),
        F.lit(f" failed, {functions} total\nTime: 3.2 s"),
    )


def edit_loop(spark: SparkSession, iterations: int = 6) -> DataFrame:
    """(id, session, step, text, content_type): each iteration reads the file, then the test run."""
    k = spark.range(iterations).select(F.col("id").alias("k"))
    file = k.select((F.col("k") * 2).alias("id"), F.lit("loop").alias("session"), (F.col("k") * 2).alias("step"), code_file(F.col("k")).alias("text"), F.lit("code").alias("content_type"))
    log = k.select((F.col("k") * 2 + 1).alias("id"), F.lit("loop").alias("session"), (F.col("k") * 2 + 1).alias("step"), test_log(F.col("k")).alias("text"), F.lit("log").alias("content_type"))
    return file.unionByName(log)
