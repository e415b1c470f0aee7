"""Schemas that drift between files: one table with one set of columns, and a log of every change.

Each record is read once, in parallel, to its shape, the names and types of its fields; shapes are few, so what is shuffled
is a record's id and a short text. The header of a file is its fields with their commonest type. Headers are folded through
a lattice of types (``promote``), renamed fields are followed to one name, and records are cast to the union schema by one
built-in parse. The change log compares each file with the one before it, in order of streams and files.

Names of a rename chain are one column in every stream but those in which two of them stand in one file: there they are
fields of their own, and each keeps its own column.

A renamed field needs a shared value: only files with fields that ended or began are read again, and only the values of
these fields are joined, on stream, file, type and value, each distinct value once, so a common value or a large file does
not multiply rows.

Defined results: a record that is null, empty, no complete JSON or no object has no fields, but its file exists. Null
values are no presence. A repeated ``record_id`` in a file counts once (the first by ``written_at``); null ids all count.
Of equally common types the first of string, number, boolean, list, object is taken. A column of numbers that are all
whole and within 64 bits is one of integers, any other one of doubles; a number that a double cannot hold to the last digit
is kept as text (``_misfits``). Numbers are equal by value (1 and
1.0), lists and objects by content without key order. A key repeated in a record has its last value. Rows with null
``stream`` or ``file_no`` stand in no sequence: they are in the table, not in the log. A file whose number has no
predecessor is compared with nothing. Extra columns are ignored.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilefold.functions.strict_json import dump, parse
from tilefold.plans.prefix import one_per_id
from tilefold.session import written

# The types of fields, in the order that decides between equally common ones.
TYPES = ("string", "number", "boolean", "list", "object")
WHOLE = "integer"  # in shapes: a number that is whole and within 64 bits
MAX_FIELDS = 20_000  # of a union schema; a wider one is no table of columns, and is refused

_SHAPE = "record_id bigint, stream string, file_no bigint, written_at timestamp, shape string"
_VALUE = "stream string, file_no bigint, field string, value string"


def json_type(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (int, float)):
        return "number"
    return "list" if isinstance(value, list) else "object"


def _shape_type(value) -> str | None:
    kind = json_type(value)
    return WHOLE if kind == "number" and isinstance(value, int) and -(1 << 63) <= value < 1 << 63 else kind


def _clean(text: str) -> str:
    return text.encode("utf-8", "replace").decode()


def _record(text: str | None) -> dict:
    """The fields with a value of a record; none if it is no object."""
    try:
        record = parse(text) if text else None
    except ValueError:
        record = None
    return {_clean(k): v for k, v in record.items() if v is not None} if isinstance(record, dict) else {}


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shape = [json.dumps({k: _shape_type(v) for k, v in _record(r).items()}, sort_keys=True) for r in batch.column("record").to_pylist()]
        kept = [batch.column(c) for c in ("record_id", "stream", "file_no", "written_at")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(shape, pa.string())], names=["record_id", "stream", "file_no", "written_at", "shape"])


def shapes(records: DataFrame) -> DataFrame:
    """(stream, file_no, shape, n): how many records of each file have which fields of which types, written once."""
    rows = records.select("record_id", "stream", F.col("file_no").cast("bigint").alias("file_no"), "written_at", "record")
    rows = rows.mapInArrow(_shapes, _SHAPE)
    rows = rows.withColumn("_own", F.when(F.col("record_id").isNotNull(), F.struct("stream", "file_no", "record_id")))
    once = one_per_id(rows, "_own", "written_at")
    return written(once.groupBy("stream", "file_no", "shape").agg(F.count("*").alias("n")), "shapes")


def headers(found: DataFrame) -> DataFrame:
    """(stream, file_no, field, type, n, n_broken) of ``shapes``: the fields of each file with their commonest type.

    ``n_broken`` are the values that are numbers, but no whole ones of 64 bits.
    """
    rank = F.array_position(F.array(*map(F.lit, TYPES)), F.col("type"))
    each = found.select("stream", "file_no", "n", F.explode(F.from_json("shape", "map<string,string>")).alias("field", "kind"))
    each = each.withColumn("type", F.when(F.col("kind") == WHOLE, F.lit("number")).otherwise(F.col("kind")))
    broken = F.sum(F.when(F.col("kind") == "number", F.col("n")).otherwise(0))
    counts = each.groupBy("stream", "file_no", "field", "type").agg(F.sum("n").alias("n"), broken.alias("n_broken"))
    return counts.groupBy("stream", "file_no", "field").agg(
        F.max_by("type", F.struct("n", -rank)).alias("type"), F.sum("n").alias("n"), F.sum("n_broken").alias("n_broken")
    )


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = set()
        for row in batch.to_pylist():
            record = _record(row["record"])
            for field in row["fields"]:
                if field in record:
                    text = dump(record[field])
                    # equal values stay equal; long ones travel as their digest
                    seen.add((row["stream"], row["file_no"], field, text if len(text) <= 80 else sha256(text.encode()).hexdigest()))
        columns = list(zip(*seen)) or [()] * 4
        types = [pa.string(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["stream", "file_no", "field", "value"])


def values_of(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """(stream, file_no, field, value): the distinct values of the fields ``wanted`` (stream, file_no, field)."""
    fields = wanted.groupBy("stream", "file_no").agg(F.collect_set("field").alias("fields"))
    rows = records.select("stream", F.col("file_no").cast("bigint").alias("file_no"), "record").join(fields, ["stream", "file_no"])
    return rows.mapInArrow(_values, _VALUE).distinct()


def changes(records: DataFrame, found: DataFrame) -> DataFrame:
    """(stream, file_no, old_name, new_name, change_kind, old_type, new_type) of each file against the one before it.

    ``found`` are the ``shapes`` of ``records``.
    """
    heads = headers(found)
    files = found.select("stream", "file_no").distinct()
    later = files.join(files.select("stream", (F.col("file_no") + 1).alias("file_no")), ["stream", "file_no"], "left_semi")
    none = F.lit(None).cast("string")
    # each field of a file stands once as its own and once as the past of the next file
    sides = F.array(
        F.struct(F.col("file_no").alias("file_no"), none.alias("old"), F.col("type").alias("new")), F.struct((F.col("file_no") + 1).alias("file_no"), F.col("type").alias("old"), none.alias("new"))
    )
    both = heads.select("stream", "field", F.explode(sides).alias("s")).select("stream", "field", "s.*")
    diff = both.groupBy("stream", "file_no", "field").agg(F.max("old").alias("old"), F.max("new").alias("new"))
    diff = written(diff.filter("not (old <=> new)").join(later, ["stream", "file_no"], "left_semi"), "diff")

    # a field that ended is looked for under the type of one that began; files that have only one of both rename nothing
    at = ["stream", "file_no", "field"]
    ended, began = diff.filter("new is null"), diff.filter("old is null")
    pairs = ended.select("stream", "file_no", F.col("field").alias("old_name"), F.col("old").alias("type")).join(
        began.select("stream", "file_no", F.col("field").alias("new_name"), F.col("new").alias("type")), ["stream", "file_no", "type"]
    )
    before = F.col("file_no") - 1
    sides = pairs.select("stream", before.alias("file_no"), F.col("old_name").alias("field"), F.lit(True).alias("was"), "type").unionByName(
        pairs.select("stream", "file_no", F.col("new_name").alias("field"), F.lit(False).alias("was"), "type")
    )
    sides = written(sides.distinct(), "sides")
    values = written(values_of(records, sides).join(sides, at), "values")
    was = values.filter("was").select("stream", (F.col("file_no") + 1).alias("file_no"), "type", "value", F.col("field").alias("old_name"))
    now = values.filter("not was").select("stream", "file_no", "type", "value", F.col("field").alias("new_name"))
    renamed = was.join(now, ["stream", "file_no", "type", "value"]).select("stream", "file_no", "old_name", "new_name", "type").distinct()
    renamed = written(renamed, "renamed")

    def as_log(df: DataFrame, old, new, kind: str, old_type, new_type) -> DataFrame:
        return df.select(
            "stream", "file_no", old.alias("old_name"), new.alias("new_name"), F.lit(kind).alias("change_kind"), old_type.alias("old_type"), new_type.alias("new_type")
        )

    field, empty = F.col("field"), F.lit("")
    gone = ended.join(renamed.select("stream", "file_no", F.col("old_name").alias("field")), at, "left_anti")
    fresh = began.join(renamed.select("stream", "file_no", F.col("new_name").alias("field")), at, "left_anti")
    return (
        as_log(renamed, F.col("old_name"), F.col("new_name"), "renamed", F.col("type"), F.col("type"))
        .unionByName(as_log(gone, field, empty, "removed", F.col("old"), none))
        .unionByName(as_log(fresh, empty, field, "added", none, F.col("new")))
        .unionByName(as_log(diff.filter("old is not null and new is not null"), field, field, "retyped", F.col("old"), F.col("new")))
    )


def ordered_log(records: DataFrame, log: DataFrame) -> DataFrame:
    """``changes`` with the name of the file where each began and its number in the stream, in order of both."""
    files = records.groupBy("stream", F.col("file_no").cast("bigint").alias("file_no")).agg(F.min("file_name").alias("file_name"))
    once = log.distinct().join(files, ["stream", "file_no"], "left")
    order = ["file_no", "change_kind", "old_name", "new_name"]
    numbered = once.withColumn("change_no", F.row_number().over(Window.partitionBy("stream").orderBy(*order)))
    return numbered.select("stream", "change_no", "file_no", "file_name", "change_kind", "old_name", "new_name", "old_type", "new_type").orderBy("stream", "change_no")


def promote(a: str | None, b: str | None) -> str | None:
    """Least type of the lattice that holds both.

    Integers are numbers; unlike scalars meet in string, and anything with a list or object in json.
    """
    if a is None or b is None or a == b:
        return a or b
    if {a, b} == {WHOLE, "number"}:
        return "number"
    return "json" if {a, b} & {"list", "object", "json"} else "string"


def canonical_names(renames: Iterable[tuple[str, str]], uses: dict[str, int]) -> dict[str, str]:
    """Each field name to one name of its rename chain: the one never renamed away, most used, then first.

    The pairs are folded one by one, so only names are held, of which pairs can have the square.
    """
    parent: dict[str, str] = {x: x for x in uses}
    left: set[str] = set()

    def root(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for old, new in renames:
        parent.setdefault(old, old)
        parent.setdefault(new, new)
        parent[root(old)] = root(new)
        left.add(old)
    best: dict[str, str] = {}
    for x in sorted(parent, key=lambda x: (x in left, -uses.get(x, 0), x)):
        best.setdefault(root(x), x)
    return {x: best[root(x)] for x in parent}


def union_schema(found: DataFrame, log: DataFrame) -> tuple[dict[str, list[str]], dict[str, str], DataFrame | None]:
    """(column to its field names, column to its type, (stream, column) of chains whose names stay apart there).

    The first two are collected, as names and types are a schema, not data; the last is null if there are none.
    """
    spark = found.sparkSession
    heads = written(headers(found), "headers")
    kinds = heads.groupBy("field").agg(F.sum("n").alias("n")).limit(MAX_FIELDS + 1).collect()
    if len(kinds) > MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} fields: no table of columns")
    uses = {r["field"]: r["n"] for r in kinds}
    pairs = log.filter("change_kind = 'renamed'").select("old_name", "new_name").distinct()
    name = canonical_names(((r[0], r[1]) for r in pairs.toLocalIterator()), uses)
    chains = spark.createDataFrame([(x, name[x]) for x in uses], "field string, chain string")
    named = heads.join(chains, "field")
    split = named.groupBy("stream", "file_no", "chain").agg(F.count("*").alias("k")).filter("k > 1").select("stream", "chain").distinct()
    split = None if split.isEmpty() else written(split, "split")
    column = F.col("chain")
    if split is not None:
        named = named.join(split.select(F.col("stream").alias("_s"), F.col("chain").alias("_c"), F.lit(True).alias("_split")), F.col("stream").eqNullSafe(F.col("_s")) & (F.col("chain") == F.col("_c")), "left")
        column = F.when(F.col("_split"), F.col("field")).otherwise(F.col("chain"))
    rows = named.groupBy(column.alias("column")).agg(F.collect_set("type").alias("types"), F.collect_set("field").alias("fields"), F.sum("n_broken").alias("broken")).collect()
    aliases: dict[str, list[str]] = {}
    types: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: r["column"]):
        aliases[r["column"]] = sorted(r["fields"])
        kind = None
        for t in r["types"]:
            kind = promote(kind, WHOLE if t == "number" and not r["broken"] else t)
        types[r["column"]] = kind
    return aliases, types, split


def unified(records: DataFrame, aliases: dict[str, list[str]], types: dict[str, str], split: DataFrame | None = None) -> DataFrame:
    """All records, each record_id of a file once, cast to the union schema; one parse per record.

    Keys of the row are (record_id, stream, file_no). A column whose name is taken, also in another letter case, gets a
    ``_`` behind it. A value that its column's type cannot hold is kept as text in the map ``_misfits``. Of several names
    of a rename chain in one record, the column has the value of its own name, else of the first; the others are kept in
    ``_misfits`` under their names, with a ``_`` behind one that is taken. In the streams of ``split`` (stream, chain) the
    names of a chain are columns of their own.
    """
    names = sorted({x for xs in aliases.values() for x in xs})
    spellings = Counter(x.lower() for x in names)
    plain = [x for x in names if spellings[x.lower()] == 1]
    schema = "struct<" + ",".join(f"`{x.replace('`', '``')}`:string" for x in plain) + ">"
    base = records.select("record_id", "stream", F.col("file_no").cast("bigint").alias("file_no"), "written_at", "record")
    base = base.withColumn("_own", F.when(F.col("record_id").isNotNull(), F.struct("stream", "file_no", "record_id")))
    rows = one_per_id(base, "_own", "written_at")
    if split is not None:
        apart = split.groupBy(F.col("stream").alias("_s")).agg(F.collect_set("chain").alias("_split"))
        rows = rows.join(apart, F.col("stream").eqNullSafe(F.col("_s")), "left")
    if plain:
        rows = rows.withColumn("_r", F.from_json("record", schema))
    if len(plain) < len(names):  # names that differ only in case are no columns of one struct
        rows = rows.withColumn("_m", F.from_json("record", "map<string,string>"))

    def text(name: str):
        return F.col("_r").getField(name) if spellings[name.lower()] == 1 else F.try_element_at("_m", F.lit(name))

    def apart_in(chain: str):
        return F.coalesce(F.array_contains("_split", chain), F.lit(False))

    chain_of = {x: column for column, xs in aliases.items() if xs != [column] for x in xs}
    sql = {WHOLE: "bigint", "number": "double", "boolean": "boolean"}
    taken, cols, misfits, further = {"record_id", "stream", "file_no", "_misfits"}, [], [], []
    for column in sorted(aliases):
        label = column
        while label.lower() in taken:
            label += "_"
        taken.add(label.lower())
        chain = sorted(aliases[column], key=lambda x: (x != column, x))
        value = F.coalesce(*map(text, chain))
        if split is not None:
            whole = chain_of.get(column, column)
            if whole != column:  # a name of a longer chain, a column only where that chain is split
                value = F.when(apart_in(whole), text(column))
            elif chain != [column]:
                value = F.when(apart_in(column), text(column) if column in names else F.lit(None)).otherwise(value)
        further += [(x, F.when(F.coalesce(*map(text, chain[:i])).isNotNull(), text(x))) for i, x in enumerate(chain) if i]
        # the parser reads a number or truth value for a column of text as it is written
        cast = value.try_cast(sql[types[column]]) if types[column] in sql else value
        if types[column] in (WHOLE, "number"):
            cast = F.when(~value.isin("true", "false"), cast)
        if types[column] == "number":  # digits that a double does not hold
            cast = F.when(~value.rlike(r"[0-9][0-9.]{15}") | (cast.try_cast("decimal(38,18)") == value.try_cast("decimal(38,18)")), cast)
        cols.append(cast.alias(label))
        if types[column] in sql:
            misfits.append(F.when(value.isNotNull() & cast.isNull(), F.struct(F.lit(label).alias("k"), value.alias("v"))))
    if split is not None:
        further = [(x, F.when(~apart_in(chain_of[x]), value)) for x, value in further]
    for name, value in further:  # taken holds every key so far in lower case
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        misfits.append(F.when(value.isNotNull(), F.struct(F.lit(name).alias("k"), value.alias("v"))))
    odd = F.map_from_entries(F.array_compact(F.array(*misfits))) if misfits else F.lit(None).cast("map<string,string>")
    return rows.select("record_id", "stream", "file_no", *cols, odd.alias("_misfits"))
