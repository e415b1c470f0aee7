"""Recall of parts: a range of lines, then lines that match a pattern, with context inside the range.

Patterns are a small regular language, translated once to the pattern dialect of the JVM; a pattern outside it is
searched as text. Everything works on the array of lines inside the row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilefold.functions.text import let, recall_lines

# Shorthand classes, and the characters that the language does not have.
SHORTHAND = {"d": "0-9", "w": "A-Za-z0-9_", "s": r" \t\n\r\x0B\f"}
REFUSED = "(){}|"


class PatternError(ValueError):
    pass


def _literal(c: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|&~#\-])", r"\\\1", c) if c.isprintable() and c != " " else f"\\x{{{ord(c):X}}}"


def _in_class(c: str) -> str:
    return f"\\x{{{ord(c):X}}}"


def _class(p: str, i: int) -> tuple[str, int]:
    """The class that opens before ``i``, as a JVM class; an empty one matches nothing, its negation anything."""
    negated = p[i : i + 1] == "^"
    i += negated
    parts: list[str] = []
    while i < len(p) and p[i] != "]":
        if p[i] == "\\":
            if i + 1 >= len(p):
                raise PatternError("backslash at the end")
            if p[i + 1] in "DWS":
                raise PatternError("negated shorthand in a class")
            parts.append(SHORTHAND.get(p[i + 1]) or _in_class(p[i + 1]))
            i += 2
        elif i + 2 < len(p) and p[i + 1] == "-" and p[i + 2] != "]":
            if p[i] <= p[i + 2]:
                parts.append(f"{_in_class(p[i])}-{_in_class(p[i + 2])}")
            i += 3
        else:
            parts.append(_in_class(p[i]))
            i += 1
    if i >= len(p):
        raise PatternError("class without end")
    if not parts:
        return (r"[\s\S]" if negated else r"[^\s\S]"), i + 1
    return f"[{'^' if negated else ''}{''.join(parts)}]", i + 1


def lower_pattern(p: str) -> str:
    """Lower case, but for escaped characters."""
    return re.sub(r"\\[\s\S]|[\s\S]", lambda m: m.group() if len(m.group()) > 1 and m.group()[0] == "\\" else m.group().lower(), p)


def translate(p: str) -> str:
    """The JVM pattern that finds what ``p`` finds; PatternError if ``p`` is not in the language."""
    out, i = "(?d)", 0
    if p.startswith("^"):
        out, i = out + r"\A", 1
    while i < len(p):
        c = p[i]
        if c == "$" and i == len(p) - 1:
            out += r"\z"
            break
        if c in REFUSED:
            raise PatternError(f"character {c}")
        if c == "\\":
            if i + 1 >= len(p):
                raise PatternError("backslash at the end")
            e = p[i + 1]
            kind = SHORTHAND.get(e.lower()) if e.lower() in SHORTHAND and e in "dwsDWS" else None
            atom = f"[{'^' if e.isupper() else ''}{kind}]" if kind else _literal(e)
            i += 2
        elif c == ".":
            atom, i = r"[^\n]", i + 1
        elif c == "[":
            atom, i = _class(p, i + 1)
        else:
            atom, i = _literal(c), i + 1
        out += atom
        if p[i : i + 1] in ("*", "+", "?"):
            out, i = out + p[i], i + 1
    return out


def line_matches(line: Column, pattern: str) -> Column:
    """Whether a line matches without regard to case; a pattern that cannot be compiled is searched as text."""
    low = F.lower(line)
    try:
        return low.rlike(translate(lower_pattern(pattern)))
    except PatternError:
        return F.contains(low, F.lit(pattern.lower()))


def slice_lines(lines: Column, first: int, last: int) -> Column:
    """Lines first..last, counted from 1; 0 counts as 1, the end is clamped, a reversed range is empty."""
    first = max(first, 1)
    return F.slice(lines, first, last - first + 1) if last >= first else F.array().cast("array<string>")


def grep(lines: Column, pattern: str, context: int = 0) -> Column:
    """The lines that match, and up to ``context`` lines around each, inside ``lines``."""
    if context == 0:
        return F.filter(lines, lambda x: line_matches(x, pattern))

    def near(hits: Column, i: Column) -> Column:
        from_, upto = F.greatest(i - context, F.lit(0)), F.least(i + context, F.size(hits) - 1)
        return F.exists(F.slice(hits, from_ + 1, upto - from_ + 1), lambda h: h)

    hits = F.transform(lines, lambda x: line_matches(x, pattern))
    return let(lines, lambda ls: let(hits, lambda hs: F.filter(ls, lambda x, i: near(hs, i))))


def expand(b: Column, lines: tuple[int, int] | None = None, pattern: str | None = None, context: int = 0) -> Column:
    """Exact bytes, or of a valid text the chosen lines, joined; other bytes come whole whatever is asked."""
    if lines is None and pattern is None:
        return b.cast("binary")
    part = recall_lines(b.cast("string"))
    if lines is not None:
        part = slice_lines(part, *lines)
    if pattern is not None:
        part = grep(part, pattern, context)
    return F.when(F.is_valid_utf8(b.cast("string")), F.encode(F.array_join(part, "\n"), "UTF-8")).otherwise(b.cast("binary"))
