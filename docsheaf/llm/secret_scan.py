"""Operator 3, secret scans: rule matches plus high-entropy strings. DataFrame functions only.

Rule kinds are matched leftmost and non-overlapping; failing matches are dropped and not
retried. Candidate strings are runs of token characters. A candidate belongs to each character
class it fits: base64-like as a whole, or with a part between separators that is hex, lower-case or
upper-case alphanumeric (the span may then take in characters beside that part); a window of fixed
width slides over it with the counts of its characters, twelve counters in each of a few integers.
A character that leaves or enters changes one counter and, with it, S = sum of c*log2(c), from which
the Shannon entropy follows; a step costs the same whatever the width. A candidate with a window at or over
the threshold of its class is a span, from its first to its last such window, unless an
allow-list pattern fits the whole candidate.

Offsets are code points, end exclusive. Null and empty texts have no spans. Repeated rows give
repeated results; other columns of the input are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsheaf.functions.text import let

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# (kind, pattern, group-1 rule): a run of 20 or 24 characters is a maximal run of that length or more
BASE = (("assign", ASSIGN), ("access", r"AKIA[A-Z0-9]{16,}"), ("hex", r"[0-9a-f]{24,}"))
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WIDTH = 20
_PART = r"^(?:.*[+/_=-])?(?:{})(?:[+/_=-].*)?$"  # a part between separators that is all of one kind
#: class -> (pattern of the whole candidate, least entropy in bits of a window of WIDTH characters)
CLASSES = {
    "entropy_hex": (_PART.format(r"(?=[0-9]*[a-fA-F])(?=[a-fA-F]*[0-9])(?:[0-9a-f]{20,}|[0-9A-F]{20,})"), 2.9),
    "entropy_base64": (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_=-]+$", 3.6),
    "entropy_lower": (_PART.format(r"(?=[a-z]*[0-9])(?=[0-9a-f]*[g-z])[0-9a-z]{20,}"), 3.6),
    "entropy_upper": (_PART.format(r"(?=[A-Z]*[0-9])(?=[0-9A-F]*[G-Z])[0-9A-Z]{20,}"), 3.3),
}
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)^[0-9+/_=-]*+(?:(?:example|placeholder|changeme|dummy|sample)[0-9+/_=-]*+){1,64}$",
    r"(?i)^(?:0123456789(?:abcdef)?|abcdefghij(?:klmnopqrstuvwxyz)?|[+/_=-]){1,64}$",
)
_SPAN = "struct<kind:string,rank:int,first:int,last:int>"
#: characters of a candidate; counts up to WIDTH take _BITS bits, _PACKED of them share one integer
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
_BITS, _PACKED = 5, 12
_TOGETHER = 256


def _located(text: Column, pattern: str) -> Column:
    """array<struct<value, first, last>> of all matches: the pieces between them give the offsets.
    Running ends are summed in blocks, so the work is in proportion to the matches."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    sizes = F.transform(values, F.char_length)
    steps = F.zip_with(F.slice(gaps, 1, F.size(values)), sizes, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    empty = F.array().cast("array<struct<first:int,last:int>>")

    def grow(acc, s):
        first = acc["at"] + s["g"]
        return F.struct((first + s["m"]).alias("at"), F.concat(acc["out"], F.array(F.struct(first.alias("first"), (first + s["m"]).alias("last")))).alias("out"))

    def summed(all_steps):
        return F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(all_steps) - 1, F.lit(0)), F.lit(_TOGETHER)),
            lambda at: F.aggregate(F.slice(all_steps, at + 1, _TOGETHER), F.struct(F.lit(0).alias("at"), empty.alias("out")), grow),
        )

    def placed(blocks):
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(blocks, none, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, starts, lambda x, at: F.transform(x["out"], lambda p: F.struct((p["first"] + at).alias("first"), (p["last"] + at).alias("last")))))

    return F.zip_with(values, let(let(steps, summed), placed), lambda v, p: F.struct(v.alias("value"), p["first"].alias("first"), p["last"].alias("last")))


def _spans(located: Column, kind: str, rank: int) -> Column:
    return F.transform(located, lambda m: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), m["first"].alias("first"), m["last"].alias("last")))


def _windows(value: Column, least: float, width: int = WIDTH) -> Column:
    """struct<first, last>: code points of the first hot window's start and the last one's end (0: none)."""
    if width >= 1 << _BITS:
        raise ValueError(f"a window has fewer than {1 << _BITS} characters")
    plogp = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 1)])
    counters = -(-len(ALPHABET) // _PACKED)
    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), counters).alias("counts"), F.lit(0.0).alias("s"), F.lit(0).alias("first"), F.lit(0).alias("last"))

    def code(c):
        at = F.instr(F.lit(ALPHABET), c) - 1
        bits = F.pmod(at, F.lit(_PACKED)) * _BITS
        return F.struct(F.floor(at / _PACKED).cast("int").alias("word"), bits.alias("bits"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bits).alias("one"))

    def over(codes):
        def slide(acc, i):
            enters, leaves = F.get(codes, i), F.get(codes, i - width)  # nothing leaves the first windows
            held = lambda c: F.call_function("shiftrightunsigned", F.get(acc["counts"], c["word"]), c["bits"]).bitwiseAND((1 << _BITS) - 1).cast("int")
            same = F.coalesce((enters["word"] == leaves["word"]) & (enters["bits"] == leaves["bits"]), F.lit(False)).cast("int")
            fall = F.coalesce(let(held(leaves), lambda n: F.get(plogp, n) - F.get(plogp, n - 1)), F.lit(0.0))
            rise = let(held(enters) - same, lambda n: F.get(plogp, n + 1) - F.get(plogp, n))
            counts = F.transform(acc["counts"], lambda x, j: x + F.when(j == enters["word"], enters["one"]).otherwise(0) - F.when(j == leaves["word"], leaves["one"]).otherwise(0))

            def moved(s):
                hot = (i >= width - 1) & (math.log2(width) - s / width >= least - 1e-9)
                return F.struct(
                    counts.alias("counts"), s.alias("s"), F.when((acc["first"] == 0) & hot, i - width + 2).otherwise(acc["first"]).alias("first"),
                    F.when(hot, i + 1).otherwise(acc["last"]).alias("last"),
                )

            return let(acc["s"] - fall + rise, moved)

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, slide, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))

    return let(F.transform(F.split(value, ""), code), over)


def secret_spans(text: Column, classes: dict = CLASSES, allow: tuple = ALLOW, width: int = WIDTH) -> Column:
    """array<struct<kind, rank, first, last>> sorted by start, then kind as listed."""
    none = F.array().cast(f"array<{_SPAN}>")
    parts = []
    for rank, (kind, pattern) in enumerate(BASE):
        found = _located(text, pattern)
        if kind == "assign":
            found = F.filter(found, lambda m: F.char_length(F.regexp_extract(m["value"], ASSIGN, 1)) >= 6)
        parts.append(F.when(text.rlike(pattern), _spans(found, kind, rank)).otherwise(none))
    allowed = "|".join(f"(?:{a})" for a in allow)

    def classed(candidates):
        out = [none]
        free = F.filter(candidates, lambda m: ~m["value"].rlike(allowed)) if allow else candidates
        for rank, (kind, (shape, least)) in enumerate(classes.items(), len(BASE)):
            fits = F.filter(free, lambda m: m["value"].rlike(shape))  # noqa: B023  built at once
            hot = F.transform(fits, lambda m: F.struct(m["first"].alias("at"), _windows(m["value"], least, width).alias("w")))  # noqa: B023
            spans = F.transform(
                F.filter(hot, lambda h: h["w"]["first"] > 0),
                lambda h: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), (h["at"] + h["w"]["first"] - 1).alias("first"), (h["at"] + h["w"]["last"]).alias("last")),  # noqa: B023
            )
            out.append(spans)
        return F.concat(*out)

    parts.append(F.when(text.rlike(CANDIDATE), let(_located(text, CANDIDATE), classed)).otherwise(none))
    order = lambda a, b: F.when(a["first"] != b["first"], F.signum(a["first"] - b["first"]).cast("int")).otherwise(a["rank"] - b["rank"])
    return F.array_sort(F.concat(*parts), order)


def scan(df: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """(key, spans): every span of every row's text."""
    return df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__t")).select(F.col(key), secret_spans(F.col("__t"), **how).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"], s["last"])), ",")
