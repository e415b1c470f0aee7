"""Text measures: the three meanings of a line, blank lines, and the token estimate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the token estimate per character class.
W_ALPHA, W_DIGIT, W_SYMBOL, W_SPACE = 0.196, 0.699, 0.65, 0.433

#: Unicode white space, and the same without the line feed; both pattern dialects read these.
WS = r"[\t-\r \x{85}\p{Z}]"
WS_IN_LINE = r"[\t\x0B-\r \x{85}\p{Z}]"
LINE = r"(?:[^\n]*+\n|[^\n]++\z)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used; lambdas share no subexpressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def as_text(b: Column) -> Column:
    """Bytes as text for views: invalid sequences become U+FFFD."""
    return F.make_valid_utf8(b.cast("string"))


def tokens(t: Column) -> Column:
    """Estimated tokens of a text, from the classes of its UTF-16 units; null for null.

    Letters go first, then blanks, then digits: each later pass reads only what the ones before it left.
    """

    def estimate(no_alpha: Column, no_space: Column, symbols: Column) -> Column:
        n, a, s, d = F.char_length(t), F.char_length(no_alpha), F.char_length(no_space), F.char_length(symbols)
        units = F.octet_length(F.encode(symbols, "UTF-16BE")) / 2
        return F.ceil((n - a) * W_ALPHA + (s - d) * W_DIGIT + units * W_SYMBOL + (a - s) * W_SPACE).cast("bigint")

    return let(
        F.regexp_replace(t, "[A-Za-z]++", ""),
        lambda a: let(F.regexp_replace(a, r"[ \t\n\r]++", ""), lambda s: let(F.regexp_replace(s, "[0-9]++", ""), lambda d: estimate(a, s, d))),
    )


def tokens_bytes(b: Column) -> Column:
    return tokens(as_text(b))


def tile_lines(t: Column) -> Column:
    """Lines with their line feed; they tile the text, an empty text has none."""
    return F.regexp_extract_all(t, F.lit(LINE), F.lit(0))


def recall_lines(t: Column) -> Column:
    """Pieces between line feeds; a text that ends with one has an empty last piece."""
    return F.split(t, "\n", -1)


def log_lines(t: Column) -> Column:
    """Lines without line feed or carriage return before it, no phantom last line."""
    return F.transform(tile_lines(t), lambda x: F.when(x.endswith("\r\n"), F.substr(x, F.lit(1), F.char_length(x) - 2)).otherwise(F.rtrim(x, F.lit("\n"))))


def count_lines(t: Column) -> Column:
    feeds = F.char_length(t) - F.char_length(F.replace(t, F.lit("\n")))
    return (feeds + F.when((t != "") & ~t.endswith("\n"), 1).otherwise(0)).cast("bigint")


def is_blank(line: Column) -> Column:
    return line.rlike(r"\A[ \t\r\n]*+\z")


def line_text(line: Column) -> Column:
    """A line tile without its line feed and the carriage returns before it."""
    return F.rtrim(line, F.lit("\r\n"))


def short(t: Column, n: int) -> Column:
    """At most ``n`` characters, the last one an ellipsis if any were cut."""
    return F.when(F.char_length(t) > n, F.concat(F.substring(t, 1, n - 1), F.lit("…"))).otherwise(t)


def commafy(n: Column) -> Column:
    return F.format_number(n, 0)


def human_bytes(n: Column) -> Column:
    gb, mb, kb = 1 << 30, 1 << 20, 1 << 10
    return (
        F.when(n >= gb, F.format_string("%.1f GB", n / gb))
        .when(n >= mb, F.format_string("%.1f MB", n / mb))
        .when(n >= kb, F.format_string("%d KB", F.floor(n / kb)))
        .otherwise(F.format_string("%d B", n))
    )


def reduction_pct(net: Column, raw: Column) -> Column:
    """Whole percent of ``net`` in ``raw``, toward zero; null where nothing was read."""
    return F.when(raw > 0, F.try_divide(net * 100 - (net * 100) % raw, raw).cast("bigint"))


def parse_range(t: Column) -> Column:
    """``A-B`` as (first, last), null if either is no number; split at the first hyphen."""
    at = F.instr(t, "-")

    def number(c: Column) -> Column:
        digits = F.regexp_replace(c, rf"\A{WS}++|{WS}++\z", "")
        return F.when(digits.rlike(r"\A\+?[0-9]++\z"), digits.try_cast("bigint"))

    a, b = number(F.substr(t, F.lit(1), at - 1)), number(F.substr(t, at + 1))
    return F.when((at > 0) & a.isNotNull() & b.isNotNull(), F.struct(a.alias("first"), b.alias("last")))
