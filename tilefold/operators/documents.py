"""Packed documents: long prose behind markers that name lines of the whole document, and their manifest read back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilefold.config import LABEL
from tilefold.functions.handles import handle, sha256_hex
from tilefold.functions.predicates import detect, is_markdown_mark, is_markdown_path, should_elide
from tilefold.functions.text import as_text, count_lines, let, tokens
from tilefold.operators.structural import GONE
from tilefold.operators.structural import view as stateless_view
from tilefold.operators.tiles import sections

#: Tags of the two comments that carry the recall data, and this engine's command name in the hint.
PACK_TAG, RECALL_TAG, COMMAND = "tf-pack", "tf-recall", LABEL.lower()


def section_rows(t: Column) -> Column:
    """Sections as array of (text, first_line, n_lines, elide), lines counted from 1."""

    def first_lines(counts: Column) -> Column:
        one = F.array(F.lit(1).cast("bigint"))
        return F.aggregate(counts, one, lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def row(s: Column, first: Column, n: Column) -> Column:
        prose = ~is_markdown_mark(s) & ~s.rlike(r"\A[\t-\r \x{85}\p{Z}]*+\z")

        def made(body: Column) -> Column:
            elide = prose & should_elide(n, F.char_length(body) + 1)
            return F.struct(body.alias("text"), first.alias("first_line"), n.alias("n_lines"), elide.alias("elide"))

        return let(F.regexp_replace(s, r"\n\z", ""), made)

    def rows(parts: Column, counts: Column) -> Column:
        return let(first_lines(counts), lambda firsts: F.transform(parts, lambda s, i: row(s, F.get(firsts, i), F.get(counts, i))))

    return let(sections(t), lambda parts: let(F.transform(parts, count_lines), lambda counts: rows(parts, counts)))


def document_body(t: Column, whole: Column) -> Column:
    """Struct (view, elisions): the view without header of a document whose handle is ``whole``, and its elided sections."""

    def shown(r: Column, h: Column) -> Column:
        def marker(tok: Column) -> Column:
            return F.format_string(
                f"[{LABEL}: section omitted · ~%d tokens · exact recall available] <!-- {RECALL_TAG} handle=%s lines=%d-%d tokens=%d -->",
                tok, h, r["first_line"], r["first_line"] + r["n_lines"] - 1, tok,
            )

        return F.concat(F.when(r["elide"], let(let(r["text"], tokens), marker)).otherwise(r["text"]), F.lit("\n"))

    def both(rows: Column, h: Column) -> Column:
        return F.struct(
            F.array_join(F.transform(rows, lambda r: shown(r, h)), "").alias("view"), F.size(F.filter(rows, lambda r: r["elide"])).cast("bigint").alias("elisions")
        )

    return let(whole, lambda h: let(section_rows(t), lambda rows: both(rows, h)))


def pack_document(label: Column, b: Column) -> Column:
    """Struct (view, handle, raw_tokens, packed_tokens, elisions) of a markdown or plain text."""

    def made(t: Column, h: Column, body: Column) -> Column:
        header = F.concat(
            F.format_string(f"<!-- {PACK_TAG} source=%s handle=%s -->\n", label, h),
            F.format_string(f"<!-- {COMMAND} inspect <this-file>  ·  {COMMAND} expand %s  (full original) -->\n\n", h),
        )
        return let(
            F.concat(header, body["view"]),
            lambda v: F.struct(v.alias("view"), h.alias("handle"), tokens(t).alias("raw_tokens"), tokens(v).alias("packed_tokens"), body["elisions"].alias("elisions")),
        )

    return let(as_text(b), lambda t: let(handle(b), lambda h: let(document_body(t, h), lambda body: made(t, h, body))))


def strip_header(shown: Column) -> Column:
    return F.when(shown.startswith(f"<!-- {PACK_TAG} source="), F.regexp_replace(shown, r"\A[^\n]*\n[^\n]*\n[^\n]*\n", "")).otherwise(shown)


def cache_entry(path: Column, t: Column, b: Column | None = None) -> Column:
    """Struct (view, stored): the view that a redirected read gets, and the ranges its markers stand for beside the whole.

    The view is a header, a label, and the document or stateless view of the source; its digest and handle are those of the
    source's bytes ``b``, by default of its text. Not for use inside a lambda.
    """
    source = F.encode(t, "UTF-8") if b is None else b
    whole, stateless = handle(source), stateless_view(t, detect(t, path))
    markdown = is_markdown_path(path)
    body = F.when(markdown, document_body(t, whole)["view"]).otherwise(stateless["view"])
    header = F.format_string(
        f"<!-- {LABEL} cached view of %s -->\n<!-- made from bytes with sha256 %s; nothing but the view below was shortened -->\n"
        f"<!-- whole source again: read the file itself, or {COMMAND} expand %s -->\n\n",
        path, sha256_hex(source), whole,
    )
    view = F.concat(header, F.lit(f"[{LABEL}: view from the read cache · source unchanged on disk]\n\n"), body)
    return F.struct(view.alias("view"), F.when(~markdown, stateless["elided"]).otherwise(F.array().cast(GONE)).alias("stored"))


def cache_view(path: Column, t: Column) -> Column:
    """The view of ``cache_entry``."""
    return cache_entry(path, t)["view"]


def manifest(shown: Column) -> Column:
    """Struct (source, handle, markers) read back from a packed view; the last header wins, bad numbers are 0.

    ``markers`` is an array of (handle, first_line, last_line, tokens). Null handle: not a packed view.
    """
    return let(F.split(shown, r"\r?\n", -1), _manifest_of)


def _manifest_of(lines: Column) -> Column:
    headers = F.filter(lines, lambda x: x.rlike(rf"\A[\t-\r \x{{85}}\p{{Z}}]*+<!-- {PACK_TAG} [\s\S]* -->\z"))
    words = F.flatten(F.transform(headers, lambda x: F.split(F.regexp_replace(x, r"\A[\s\S]*?<!-- \S+ | -->\z", ""), r"\s+")))

    def last(key: str) -> Column:
        return F.regexp_replace(F.try_element_at(F.filter(words, lambda w: w.startswith(f"{key}=")), F.lit(-1)), r"\A[^=]*=", "")

    def value(body: Column, key: str, pattern: str, group: int = 1) -> Column:
        return F.regexp_extract(body, rf"(?:\A|\s){key}={pattern}(?=\s|\z)", group)

    marked = F.filter(lines, lambda x: x.contains(f"<!-- {RECALL_TAG} ") & ~x.rlike(rf"\A[\t-\r \x{{85}}\p{{Z}}]*+<!-- {PACK_TAG} "))
    bodies = F.transform(marked, lambda x: F.regexp_extract(x, rf"<!-- {RECALL_TAG} ([\s\S]*?) -->", 1))

    def marker(body: Column) -> Column:
        def number(c: Column) -> Column:
            return F.coalesce(c.try_cast("bigint"), F.lit(0))

        return F.struct(
            value(body, "handle", r"(\S*)").alias("handle"),
            number(value(body, "lines", r"([0-9]+)-\S*")).alias("first_line"),
            number(value(body, "lines", r"[^\s-]*-([0-9]+)")).alias("last_line"),
            number(value(body, "tokens", r"([0-9]+)")).alias("tokens"),
        )

    found = F.filter(F.transform(bodies, marker), lambda m: m["handle"] != "")
    return F.struct(last("source").alias("source"), last("handle").alias("handle"), found.alias("markers"))
