"""Deeply nested records to related flat tables, in one pass of tagged emission.

One depth-first visitor reads each record once and emits rows (tag, primary key, parent key, payload). The rows
are written partitioned by tag, and each tag is read with its own schema. Every node is visited with a stack of
its own, so depth is bounded by memory, not by recursion.

Tables, each row with ``node_no`` (its number in its line, the primary key together with ``line_id``), ``parent_no`` and
the paths of both:

- ``line``: one per line, number 0.
- ``message``: the object in the line's ``message``, and the object ``message`` of a content object.
- ``content``: a content value, its shape (list, object, text or scalar) and whether it was wrapped in a JSON string.
- ``object``: a content object; fields that every kind of record has are columns.
- ``text``: a text among content.
- ``detail``: everything else that is nested, object by object and list by list, each naming its parent; ``place`` is the
  key or the position in it. A ``message`` that is no object is a detail of its line.

Scalar fields that are no column of their own are in the map ``fields`` of their node, as JSON texts, so no field is
lost, whatever its name or type; a column is null where its field is missing or of another type (which is then in
``fields``). A record can be put together again from its rows (``tests/test_nested.py``).

Defined results: a null, empty or incomplete text yields no object; a line without content still yields its row of
``line``; of a repeated key in an object the last value counts. A repeated ``line_id`` counts once: of repeats that
differ, ``read_table`` keeps all nodes of one (least digest) and none of the others, and ``object_keys`` has the keys of
all. Rows with a null ``line_id`` are all kept; columns of the input other than those read are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilefold.functions.strict_json import parse
from tilefold.session import new_path

TAGGED = "line_id bigint, node_no bigint, parent_no bigint, parent_path string, node_path string, via string, payload string, delivery bigint, tag string"
SCHEMAS = {
    "line": "session string, line_no bigint, kind string, role string",
    "message": "role string, id string, n_fields bigint, fields map<string,string>",
    "content": "shape string, wrapped boolean, value string",
    "object": "type string, role string, id string, name string, tool_use_id string, text string, is_error boolean, n_fields bigint, fields map<string,string>",
    "text": "text string",
    "detail": "place string, kind string, value string, n_fields bigint, fields map<string,string>",
}
KEYS = ["line_id", "node_no", "parent_no", "parent_path", "node_path", "via"]
_ARROW = pa.schema([(c.split()[0], pa.int64() if c.split()[1] == "bigint" else pa.string()) for c in TAGGED.split(", ")])
_COLUMNS = {tag: {c.split()[0]: bool if c.split()[1] == "boolean" else str for c in s.split(", ") if c.split()[1] in ("string", "boolean")} for tag, s in SCHEMAS.items() if tag in ("message", "object")}
_FLUSH = 20_000
_quote = json.encoder.encode_basestring_ascii
_make = json.encoder.c_make_encoder
# the encoder of the standard library builds its C part anew for every call; payloads are small and many
_parts = _make(None, None, _quote, None, ":", ",", False, False, True) if _make else None


def _encode(value) -> str:
    if type(value) is str:
        return _quote(value)
    return "".join(_parts(value, 0)) if _parts and isinstance(value, (dict, list)) else json.dumps(value, separators=(",", ":"))


def _unwrapped(value):
    """(list, object or scalar, was wrapped): a string is unwrapped while it is whole JSON for a list or an object."""
    wrapped, inner = False, value
    while isinstance(inner, str):
        try:
            inner = parse(inner)
        except ValueError:
            return value, False
        wrapped = True
    return (inner, wrapped) if isinstance(inner, (list, dict)) else (value, False)


def _key(name: str) -> str:
    return name if name.isascii() else name.encode("utf-8", "replace").decode()  # a lone surrogate is no text for Arrow


class _Visitor:
    """Walks one line after another; rows of ``TAGGED`` gather in ``out``."""

    def __init__(self) -> None:
        self.out: list[tuple] = []

    def begin(self, line_id, delivery) -> None:
        self.line_id, self.delivery, self.n = line_id, delivery, 0

    def emit(self, tag: str, parent_no, parent: str | None, node: str, via: str | None, payload: dict) -> int:
        no = self.n
        self.out.append((self.line_id, no, parent_no, parent, node, via, _encode(payload), self.delivery, tag))
        self.n = no + 1
        return no

    def flat(self, tag: str, value: dict) -> tuple[dict, list[tuple[str, object]]]:
        """Payload of an object's own scalars, and its nested fields in order."""
        typed = _COLUMNS.get(tag, {})
        payload: dict = {"n_fields": len(value)}
        fields: dict[str, str] = {}
        nested = []
        for key, x in value.items():
            if isinstance(x, (list, dict)):
                nested.append((key, x))
            elif key in typed and type(x) is typed[key]:
                payload[key] = x
            elif key == "content" and tag != "detail":
                nested.append((key, x))
            else:
                name = _key(key)
                while name in fields:
                    name += "_"
                fields[name] = _encode(x)
        if fields:
            payload["fields"] = fields
        return payload, nested

    def walk(self, todo: list[tuple]) -> None:
        """Depth first; ``todo`` is a stack of (kind, parent number, parent path, path or place, via, value)."""
        while todo:
            kind, up, parent, at, via, value = todo.pop()
            if kind == "content":
                todo.extend(reversed(self.content(up, parent, at, via, value)))
            elif kind == "object":
                payload, nested = self.flat("object", value)
                no = self.emit("object", up, parent, at, via, payload)
                todo.extend(reversed([self.below(no, at, key, x) for key, x in nested]))
            elif kind == "message":
                payload, nested = self.flat("message", value)
                path = f"{parent}/message"
                no = self.emit("message", up, parent, path, via, payload)
                todo.extend(reversed([("content", no, path, at, "message", x) if key == "content" else ("detail", no, path, key, None, x) for key, x in nested]))
            elif kind == "text":
                self.emit("text", up, parent, at, via, {"text": value})
            else:
                todo.extend(reversed(self.detail(up, parent, at, value)))

    def below(self, no: int, path: str, key: str, value) -> tuple:
        if key == "content":
            return ("content", no, path, path, "content", value)
        if key == "message" and isinstance(value, dict):
            return ("message", no, path, path, None, value)
        return ("detail", no, path, key, None, value)

    def content(self, up: int, parent: str, path: str, via: str, value) -> list[tuple]:
        inner, wrapped = _unwrapped(value)
        shape = "list" if isinstance(inner, list) else "object" if isinstance(inner, dict) else "text" if isinstance(inner, str) else "scalar"
        payload = {"shape": shape, "wrapped": wrapped}
        if shape == "scalar":
            payload["value"] = _encode(inner)
        no = self.emit("content", up, parent, path, via, payload)
        if shape == "text":
            return [("text", no, path, path, via, inner)]
        later = []
        for i, x in enumerate(inner if shape == "list" else [inner] if shape == "object" else []):
            if isinstance(x, dict):
                later.append(("object", no, path, f"{path}.{i}", via, x))
            elif isinstance(x, str):
                later.append(("text", no, path, f"{path}.{i}", via, x))
            else:
                later.append(("detail", no, path, i, via, x))
        return later

    def detail(self, up: int, owner: str, place, value) -> list[tuple]:
        """A value that is no content: its path is that of the node it belongs to and its own number, however deep it is."""
        payload: dict = {"place": _key(place) if isinstance(place, str) else str(place)}
        nested: list[tuple] = []
        if isinstance(value, dict):
            body, nested = self.flat("detail", value)
            payload |= {"kind": "object"} | body
        elif isinstance(value, list):
            payload["kind"], nested = "list", list(enumerate(value))
        else:
            payload |= {"kind": "scalar", "value": _encode(value)}
        no = self.emit("detail", up, owner, f"{owner}#{self.n}", None, payload)
        return [("detail", no, owner, key, None, x) for key, x in nested]

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.out)) or [()] * len(_ARROW)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types)], schema=_ARROW)


def _emitter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    v = _Visitor()
    for batch in batches:
        for row in batch.to_pylist():
            v.begin(row["line_id"], row["delivery"])
            v.emit("line", None, None, "", None, {k: row[k] for k in ("session", "line_no", "kind", "role") if row[k] is not None})
            roots: list[tuple] = []
            if row["content"] is not None:
                roots.append(("content", 0, "", "c", "content", row["content"]))
            if row["message"] is not None:
                message, _ = _unwrapped(row["message"])
                roots.append(("message", 0, "", "m", None, message) if isinstance(message, dict) else ("detail", 0, "", "message", None, message))
            v.walk(roots[::-1])
            if len(v.out) >= _FLUSH:
                yield v.batch()
        yield v.batch()


def flatten(lines: DataFrame) -> DataFrame:
    """Tagged rows of all transcript lines: keys, payload, the digest of the delivery, tag.

    Repeats are still in: they are dropped by key where a table is read, after the text has become rows.
    """
    types = {"line_id": "bigint", "session": "string", "line_no": "bigint", "kind": "string", "role": "string", "message": "string", "content": "string"}
    have = set(lines.columns)
    picked = lines.select(*((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in types.items()))
    return picked.withColumn("delivery", F.xxhash64(*list(types)[1:])).mapInArrow(_emitter, TAGGED)


def write_tagged(lines: DataFrame, path: str | None = None) -> str:
    """Run the pass once and write its rows partitioned by tag; gives the folder."""
    path = path or new_path(lines.sparkSession, "nested")
    flatten(lines).write.partitionBy("tag").parquet(path)
    return path


def read_table(spark, path: str, tag: str) -> DataFrame:
    """One flat table: keys, and the payload under the tag's schema; each node of one delivery of each line once."""
    rows = spark.read.schema(TAGGED).parquet(path).filter(F.col("tag") == tag).drop("tag")
    least = F.min("delivery").over(Window.partitionBy("line_id"))  # a line's nodes, not a group that grows
    named = rows.filter("line_id is not null").withColumn("_least", least).filter("delivery = _least").drop("_least").dropDuplicates(["line_id", "node_no"])
    body = F.from_json("payload", SCHEMAS[tag])
    out = rows.filter("line_id is null").unionByName(named).withColumn("_b", body)
    return out.select(*KEYS, "_b.*") if tag != "line" else out.select("line_id", "_b.*")


def object_keys(spark, path: str) -> DataFrame:
    """The parent-child links of content objects, each once: (line_id, parent_path, node_path)."""
    rows = spark.read.schema(TAGGED).parquet(path).filter(F.col("tag") == "object")
    return rows.select("line_id", "parent_path", "node_path").distinct()
