"""Chunk texts back into document texts: reading order, overlap removal, page and section joins."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from docsheaf.functions.text import MARKS, SPACES, strip

# Least overlap and the stretch of text that is compared.
LEAST, MOST = 10, 500
_NO_MARKS = {i: None for a, b in MARKS for i in range(a, b + 1)}
_SPACES = "".join(chr(i) for a, b in SPACES for i in range(a, b + 1))


def stripped(text: str) -> str:
    """As ``strip`` on columns."""
    return text.strip(_SPACES)


def _in_order(rtl: bool, *more: str) -> Column:
    """array<struct> of a document's chunks in reading order."""
    return F.array_sort(F.collect_list(F.struct(F.col("row"), (-F.col("col") if rtl else F.col("col")).alias("ord"), F.col("index"), F.col("col"), *more)))


def adjacent(row: Column, col: Column, row0: Column, col0: Column) -> Column:
    dr, dc = F.abs(row - row0), F.abs(col - col0)
    return ((dr == 0) & (dc == 1)) | ((dr == 1) & (dc == 0))


def adjacency(chunks: DataFrame, rtl: bool = False) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("row", -F.col("col") if rtl else F.col("col"))
    before = lambda c: F.lag(c).over(w)
    return chunks.select("doc_id", "index", before("index").alias("previous"), F.coalesce(adjacent(F.col("row"), F.col("col"), before("row"), before("col")), F.lit(False)).alias("is_adjacent"))


def exact_length(before: str, after: str) -> int:
    """Length of the longest end of ``before`` that starts ``after``, 0 if under ``LEAST``."""
    n = min(len(before), len(after))
    head, at = after[:LEAST], max(0, len(before) - n)
    while len(head) == LEAST and (at := before.find(head, at)) >= 0:  # the first place is the longest
        if after.startswith(before[at:]):
            return len(before) - at
        at += 1
    return 0


def rest_of(before: str, after: str, rtl: bool = False) -> str:
    """``after`` without the start that repeats the end of ``before``: an exact overlap, else a
    nearly equal one in words. Right to left, marks do not count for either."""
    a, b = before[-MOST:], after[:MOST]
    if rtl:
        a, b = a.translate(_NO_MARKS), b.translate(_NO_MARKS)
    n = exact_length(a, b) or fuzzy_length(a, b)
    if not n:
        return after
    if rtl:
        places = [i for i, c in enumerate(after[:MOST]) if ord(c) not in _NO_MARKS]
        n = places[n - 1] + 1 if n <= len(places) else 0
    return stripped(after[n:])


def merged_text(chunks: list, rtl: bool = False) -> str:
    """The text of (row, col, text) chunks in reading order. The previous text is the last one
    kept; adjacency looks at the previous chunk, blank or not."""
    out, prev, place = [], "", None
    for row, col, raw in chunks:
        t = stripped(raw or "")
        near = place is not None and abs(row - place[0]) + abs(col - place[1]) == 1
        place = (row, col)
        if t:
            rest = rest_of(prev, t, rtl) if prev and near else t
            if rest:
                out.append(rest)
                prev = t
    return stripped("\n\n".join(out))


def merge_exact(chunks: DataFrame, rtl: bool = False) -> DataFrame:
    """(doc_id, merged): a fold over each document's chunks in reading order. The nearly equal
    overlap has no built-in form, so the fold is one Arrow pass over the grouped chunks."""
    parts = chunks.groupBy("doc_id").agg(_in_order(rtl, "text").alias("c"))
    key = chunks.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", key), T.StructField("merged", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            docs, rows, cols, texts = (batch.column(i).to_pylist() for i in range(4))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([merged_text(zip(r, c, t), rtl) for _, r, c, t in zip(docs, rows, cols, texts)], pa.string())], schema=arrow)

    return parts.select("doc_id", "c.row", "c.col", "c.text").mapInArrow(run, schema)


def formatted(chunks: DataFrame, rtl: bool = False) -> DataFrame:
    """(doc_id, text): chunks with position marks in reading order, blank ones dropped."""
    parts = chunks.withColumn("s", strip(F.col("text"))).where("s != ''").groupBy("doc_id").agg(_in_order(rtl, "s").alias("c"))
    mark = lambda x: F.concat(F.lit("[Chunk "), x["index"], F.lit(": Row "), x["row"], F.lit(", Col "), x["col"], F.lit("]\n"), x["s"])
    return parts.select("doc_id", F.array_join(F.transform("c", mark), "\n\n").alias("text"))


def concat(chunks: DataFrame) -> DataFrame:
    """(doc_id, text): all chunks in index order, blank ones kept, nothing removed."""
    c = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("index", "text"))).alias("c"))
    return c.select("doc_id", F.array_join(F.transform("c", lambda x: x["text"]), "\n\n").alias("text"))


def sections(chunks: DataFrame, columns: int | None = None) -> DataFrame:
    """(doc_id, text): the older merge. Blank chunks go first, then, if ``columns`` is given, each
    run of that many is reversed (right to left); one text alone has no mark."""
    c = chunks.withColumn("s", strip(F.col("text"))).where("s != ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("index", "s"))).alias("c"))
    texts = F.transform("c", lambda x: x["s"])
    if columns:
        run = lambda i: F.floor(i / columns).cast("int") * columns
        # position i takes the mirrored place of its run
        texts = F.transform("c", lambda x, i: F.get("c", run(i) + F.least(F.lit(columns), F.size("c") - run(i)) - 1 - (i - run(i)))["s"])
    marked = F.transform("t", lambda x, i: F.concat(F.lit("--- Section "), i + 1, F.lit(" ---\n"), x))
    return c.select("doc_id", texts.alias("t")).select("doc_id", F.when(F.size("t") == 1, F.get("t", F.lit(0))).otherwise(F.array_join(marked, "\n\n")).alias("text"))


def pages(df: DataFrame) -> DataFrame:
    """(job_id, text, formatted_text, confidence, total_pages, metadata): ordered page merge."""
    c = df.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "text", "formatted_text", "confidence"))).alias("p"), F.max("total_pages").alias("total_pages"), F.sum(F.round(F.col("confidence") * 100).cast("long")).alias("s"))
    mark = lambda x: F.concat(F.lit("=== Page "), x["page_number"], F.lit(" of "), F.col("total_pages"), F.lit(" ===\n"))
    text = F.array_join(F.transform("p", lambda x: F.concat(mark(x), x["text"])), "\n\n")
    formatted_text = F.array_join(F.transform(F.filter("p", lambda x: x["formatted_text"] != ""), lambda x: F.concat(mark(x), x["formatted_text"])), "\n\n")
    meta = F.array_join(F.transform("p", lambda x: F.concat(x["page_number"].cast("string"), F.lit(":"), F.round(x["confidence"] * 100).cast("long").cast("string"))), ",")
    return c.select("job_id", text.alias("text"), formatted_text.alias("formatted_text"), F.round(F.col("s") / 100.0 / F.col("total_pages"), 6).alias("confidence"), "total_pages", meta.alias("metadata"))


def fuzzy_length(before: str, after: str) -> int:
    """Length of a nearly equal overlap in words: 10 down to 3 words, similarity 0.95 or more and
    four fifths of the words equal; 0 if there is none."""
    w1, w2 = before.split(), after.split()
    if len(w1) < 3 or len(w2) < 3:
        return 0
    for n in range(min(len(w1), len(w2), 10), 2, -1):
        a, b = w1[-n:], w2[:n]
        if sum(x == y for x, y in zip(a, b)) < 0.8 * n:  # the cheap test first; both must hold
            continue
        if SequenceMatcher(None, " ".join(a), " ".join(b)).ratio() >= 0.95:
            return len(" ".join(b))
    return 0


@F.pandas_udf(T.LongType())
def fuzzy_overlap(before: pd.Series, after: pd.Series) -> pd.Series:
    """Arrow batches; only the last and first 500 characters matter."""
    return pd.Series([fuzzy_length((a or "")[-MOST:], (b or "")[:MOST]) for a, b in zip(before, after)], dtype="int64")
