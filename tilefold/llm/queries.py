"""The p6 to p8 queries with their production parameters. SQL has no tokenizer; it checks what needs none, tests do the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilefold.llm import mixing, packing, splitting, tokenizer
from tilefold.plans.prefix import one_per_id
from tilefold.session import written
from tilefold.sources.tables import spread, table

CAPACITY, PIECE, OVERLAP = 2048, 512, 32
EXAMPLE_LIMITS = (2048, 10, 1024)  # tokens, segments and loss-bearing tokens of a container of transcript lines


def _placed(spark: SparkSession, d: str) -> DataFrame:
    sized = written(tokenizer.sizes(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text"), "sizes")
    return packing.pack(sized, "doc_id", limits=(CAPACITY, 256, CAPACITY))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages that had to be split to fit containers."""
    return _placed(spark, d).filter("n_pieces > 1").select(F.col("item_id").alias("doc_id")).distinct()


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every container with what it holds and the room left."""
    return packing.containers(_placed(spark, d), CAPACITY)


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Per page whether its pieces tile it, and whether all their containers are within the capacity."""
    placed = written(_placed(spark, d), "placed")
    over = packing.containers(placed, CAPACITY).filter(F.col("tokens") > CAPACITY).select("shard", "container", F.lit(True).alias("_over"))
    rows = placed.join(over, ["shard", "container"], "left").groupBy(F.col("item_id").alias("doc_id")).agg(
        F.count("*").alias("n"), F.max("n_pieces").alias("k"), F.min("from_token").alias("a"), F.max("to_token").alias("z"),
        F.sum(F.col("to_token") - F.col("from_token")).alias("covered"), F.bool_or(F.coalesce("_over", F.lit(False))).alias("over"),
    )
    tiled = (F.col("n") == F.col("k")) & (F.col("a") == 0) & (F.col("covered") == F.col("z"))
    return rows.select("doc_id", tiled.alias("tiled"), (~F.col("over")).alias("within"))


def _examples(spark: SparkSession, d: str) -> DataFrame:
    """Transcript lines as training examples: one segment each, whose tokens bear loss where the assistant speaks."""
    rows = one_per_id(table(spark, d, "transcript"), "line_id", "logged_at")
    role = F.lower(F.coalesce("role", F.get_json_object("message", "$.role"), "kind", F.lit("")))
    texts = rows.select("line_id", (role == "assistant").alias("loss"), F.concat_ws("\n", "message", "content").alias("text"))
    sized = written(tokenizer.sizes(spread(texts), "line_id", "text", keep=("loss",)), "sizes")
    sized = sized.select("line_id", "n_tokens", F.lit(1).alias("segments"), F.when(F.col("loss"), F.col("n_tokens")).otherwise(0).alias("loss"))
    return packing.pack(sized, "line_id", limits=EXAMPLE_LIMITS, segments_col="segments", loss_col="loss")


def p6_examples(spark: SparkSession, d: str) -> DataFrame:
    """Containers of transcript lines under all three limits, and the limit that each is nearest to."""
    full = [F.col(c) / limit for c, limit in zip(("tokens", "segments", "loss_tokens"), EXAMPLE_LIMITS)]
    names = F.when(full[1] >= F.greatest(full[0], full[2]), "segments").when(full[2] >= full[0], "loss").otherwise("tokens")
    return packing.containers(_examples(spark, d), CAPACITY).withColumns({"fullest": names, "filled": F.greatest(*full)})


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs, targets = spread(table(spark, d, "documents").select("doc_id", "source", "text")), table(spark, d, "mix_targets")
    names = targets.select(F.col("source").alias("_s")).distinct()
    wanted = docs.join(mixing._small(names), mixing.source_key(docs["source"]) == F.col("_s"), "left_semi")
    sized = written(tokenizer.sizes(wanted, "doc_id", "text", keep=("source",)), "sizes")
    demanded = written(mixing.demand(sized, targets), "demand")
    return demanded, written(mixing.mix(sized, demanded), "mix")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets whose share the drawn mix does not reach though every page is at its cap."""
    return mixing.shares(*_mixed(spark, d)).filter("not reachable").select("source")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_mixed(spark, d))


def p7_copies(spark: SparkSession, d: str) -> DataFrame:
    """Per target its pages in the corpus, and how many of them have copies beside the floor and ceiling of what is expected, or over the cap."""
    demanded, mixed = _mixed(spark, d)
    rates = demanded.select("source", "pages", "f", "max_repeats")
    rows = mixed.join(mixing._small(rates), "source")
    off = (F.col("copies") < F.floor("f")) | (F.col("copies") > F.ceil("f"))
    bad = rows.groupBy("source").agg(F.count_if(off).alias("off"), F.count_if(F.col("copies") > F.col("max_repeats")).alias("over"), F.count("*").alias("used"))
    # a page left out has no copies, which is right below one expected copy only
    out = rates.join(bad, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("off", "over", "used")})
    left_out = F.when(F.col("f") >= 1, F.col("pages") - F.col("used")).otherwise(0)
    return out.select("source", "pages", (F.col("off") + left_out).alias("off"), "over")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every page of the mix with its copies."""
    return _mixed(spark, d)[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that came out as more than one piece."""
    pieces = splitting.split(spread(table(spark, d, "documents").select("doc_id", "text")), PIECE, OVERLAP, only_split=True, with_text=False)
    return pieces.filter("n_pieces > 1").select("doc_id", "block_no").distinct()


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every block with its text."""
    return splitting.split(spread(table(spark, d, "documents").select("doc_id", "text")), PIECE, OVERLAP)


def p8_tiled(spark: SparkSession, d: str) -> DataFrame:
    """Per block its length, and whether its pieces are within the limit, in order, and cover it without a gap."""
    pieces = splitting.split(spread(table(spark, d, "documents").select("doc_id", "text")), PIECE, OVERLAP, with_text=False)
    cuts = F.array_sort(F.collect_list(F.struct("piece_no", "start", "end")))
    rows = pieces.groupBy("doc_id", "block_no").agg(cuts.alias("p"), F.max("n_pieces").alias("k"), F.max("n_tokens").alias("most"), F.max("end").alias("n_chars"))
    gaps = F.exists(F.sequence(F.lit(1), F.size("p") - 1), lambda i: (F.get("p", i)["start"] > F.get("p", i - 1)["end"]) | (F.get("p", i)["end"] <= F.get("p", i - 1)["end"]))
    tiled = (F.size("p") == F.col("k")) & (F.get("p", F.lit(0))["start"] == 0) & (F.col("most") <= PIECE) & F.when(F.size("p") > 1, ~gaps).otherwise(True)
    return rows.select("doc_id", "block_no", "n_chars", tiled.alias("tiled"))


QUERIES = {f.__name__: f for f in (p6_found, p6_containers, p6_items, p6_examples, p7_found, p7_shares, p7_copies, p7_mix, p8_found, p8_pieces, p8_tiled)}
ORACLE: dict[str, str] = {
    "p6_items": "select doc_id, true as tiled, true as within from documents",
    "p7_copies": """
        select t.source, count(d.doc_id) as pages, 0 as off, 0 as over from (select distinct source from mix_targets) t left join documents d on lower(trim(d.source, ' ')) = t.source group by 1""",
    "p8_tiled": r"""
        with p as (select doc_id, string_split(text, chr(10)) as p from documents where text is not null),
        x as (select doc_id, i, p[i] as x, regexp_matches(p[i], '[\p{L}\p{N}]') as has from p, unnest(range(1, len(p) + 1)) as u(i)),
        g as (select *, i - row_number() over (partition by doc_id order by i) as g from x where has),
        b as (select doc_id, min(i) as first, sum(length(x) + 1) - 1 as n_chars from g group by doc_id, g)
        select doc_id, row_number() over (partition by doc_id order by first) - 1 as block_no, n_chars::bigint as n_chars, true as tiled from b""",
}
