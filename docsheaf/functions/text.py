"""Column functions on text: Unicode strip, overlaps, diacritics, line parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and combining Arabic marks as code points (first, last).
SPACES = ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
MARKS = ((0x064B, 0x065F), (0x0670, 0x0670))


def char_class(ranges: tuple) -> str:
    """The ranges as a character class that Java's and DuckDB's expressions both read."""
    return "[" + "".join(rf"\x{{{a:x}}}" if a == b else rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"


WS = char_class(SPACES)
STRIP = f"^{WS}+|{WS}+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, STRIP, "")


def without_marks(text: Column) -> Column:
    return F.regexp_replace(text, char_class(MARKS), "")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once; inside lambdas nothing else shares it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def exact_overlap(before: Column, after: Column, least: int = 10, most: int = 500) -> Column:
    """Length of the longest end of ``before`` that starts ``after``, 0 if under ``least``. The
    first place of the shortest admissible start gives the longest candidate; only if that one
    fails are all lengths tried."""

    def search(s):
        a, b = s["a"], s["b"]
        n = F.least(F.char_length(a), F.char_length(b))
        hits = F.filter(F.sequence(F.lit(least), n), lambda k: F.right(a, k) == F.left(b, k))
        every = F.coalesce(F.array_max(hits), F.lit(0))

        def from_first(at):
            size = F.char_length(a) - at + 1
            return F.when(at == 0, F.lit(0)).when((size <= n) & (F.right(a, size) == F.left(b, size)), size).otherwise(every)

        return F.when(n >= least, let(F.instr(a, F.left(b, F.lit(least))), from_first)).otherwise(0)

    return let(F.struct(F.right(before, F.lit(most)).alias("a"), F.left(after, F.lit(most)).alias("b")), search)


def position_of_base_char(text: Column, n: Column) -> Column:
    """How many code points of ``text`` hold its first ``n`` characters that are no marks."""
    chars = F.filter(F.transform(F.split(text, ""), lambda c, i: F.struct(c.alias("c"), (i + 1).alias("i"))), lambda x: ~x["c"].rlike(char_class(MARKS)))
    return F.coalesce(F.get(chars, n - 1)["i"], F.lit(0))


def model_output_text(stdout: Column) -> Column:
    """The text section of a model's console output: after the second marker line, up to the stop line."""
    lines = F.transform(F.split(stdout, "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    is_marker = lambda s: F.contains(s["x"], F.lit("=" * 21)) & ~F.contains(F.lower(s["x"]), F.lit("save"))
    is_stop = lambda s: ~is_marker(s) & (F.contains(F.lower(s["x"]), F.lit("save results")) | F.contains(s["x"], F.lit("=" * 15)))
    start = F.get(F.filter(lines, is_marker), F.lit(1))["i"]
    stop = F.coalesce(F.get(F.filter(lines, is_stop), F.lit(0))["i"], F.size(lines))
    debug = lambda s: F.startswith(strip(s["x"]), F.lit("BASE:")) | F.startswith(strip(s["x"]), F.lit("PATCHES:"))
    body = F.filter(lines, lambda s: (s["i"] > start) & (s["i"] < stop) & ~is_marker(s) & ~debug(s))
    return F.when(start.isNull(), F.lit("")).otherwise(strip(F.array_join(F.transform(body, lambda s: s["x"]), "\n")))
