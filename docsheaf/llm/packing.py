"""Operator 5, packing: token windows of near-equal size by Karmarkar-Karp multiway differencing.

A document's ids are those of a public tokenizer plus one end id. Whole windows of ``window``
ids are cut off its front; what is left is cut into falling powers of two down to ``least``
ids and a rest, since few large and many small pieces balance best. The left-over pieces of a block of rows are spread over k windows by multiway differencing: every
piece starts as a partition of its own, the two partitions with the widest spread are merged
again and again so that the largest sum of one meets the smallest of the other, until one
partition of k near-equal windows is left. If a window exceeds the capacity, k rises by one.

Blocks are consecutive rows of one input partition, at most ``block`` of them, so memory is
bounded, nothing is shuffled and no key can make a task large. Sequence ids hold the partition
number and a counter, as ``monotonically_increasing_id`` does; a task that runs again on the
same input split gives the same ids.

Defined results: a null or empty text is one piece that holds the end id alone; repeated rows
are packed each for itself.
"""

from __future__ import annotations

import heapq
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import id_type, map_small

WINDOW, LEAST, BLOCK, END_ID = 2048, 64, 512, 1


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k groups of indices with near-equal sums (largest differencing method)."""
    if k == 1:
        return [list(range(len(sizes)))]
    tick = itertools.count()
    heap = []
    for i, size in enumerate(sizes):
        # a partition lists only its non-empty groups, by falling sum; the other sums are 0
        heap.append((-size, next(tick), [(size, (i,))]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = k - len(a)
        if len(b) <= free:
            merged = a + b
        else:
            # the j-th largest of b meets the j-th smallest of a
            merged = a[: k - len(b)] if len(b) < k else []
            rest = a[k - len(b) :]
            pairs = rest + [(0, ())] * (len(b) - len(rest))
            merged = merged + [(x + y, (p, q) if p else (q,)) for (x, p), (y, q) in zip(reversed(pairs), b)]
        merged.sort(key=lambda g: -g[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, next(tick), merged))
    groups = heap[0][2] if heap else []
    return [_flat(g) for _, g in groups] + [[] for _ in range(k - len(groups))]


def _flat(group: tuple) -> list[int]:
    out, stack = [], [group]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack.extend(x)
        else:
            out.append(x)
    return sorted(out)


def pack(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Windows of at most ``capacity``; the count rises whenever a window exceeds it."""
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = differencing(sizes, k)
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return [g for g in groups if g]
        k += 1


def cuts(n: int, window: int = WINDOW, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, falling powers of two, a rest."""
    at = n // window * window
    out = [(x, window) for x in range(0, at, window)]
    size = 1 << (window - 1).bit_length() - 1
    while at < n:
        take = size if size >= least else n - at
        if take <= n - at:
            out.append((at, take))
            at += take
        size //= 2
    return out


def load_encoder(path: str, ranks_path: str | None = None, pattern: str | None = None):
    """texts -> lists of ids, as the tokenizers file at ``path`` gives them without added special
    tokens; the string of a special token that stands in a text is that token. Where the same
    vocabulary is at hand as ranks, the ids come from that faster coder; both give the same ids (tests)."""
    if ranks_path:
        import base64
        import json

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        return lambda texts: [coder.encode(t, allowed_special="all") for t in texts]
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path)
    return lambda texts: [e.ids for e in coder.encode_batch_fast(texts, add_special_tokens=False)]


def pack_documents(df: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, text: str = "text", key: str = "doc_id",
                   window: int = WINDOW, least: int = LEAST, block: int = BLOCK, end_id: int = END_ID) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence."""
    schema = T.StructType([
        T.StructField(key, id_type(df, key)), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    ])
    arrow, names = to_arrow_schema(schema), [f.name for f in schema.fields]

    def run(batches):
        encode = load_encoder(tokenizer, ranks, pattern)
        context = TaskContext.get()
        numbers = itertools.count((context.partitionId() if context else 0) << 33)
        pieces: list[tuple] = []
        rows = 0

        def placed():
            full = [p for p in pieces if p[2] == window]
            rest = [p for p in pieces if p[2] < window]
            out = [(*p, next(numbers), 0) for p in full]
            for group in pack([p[2] for p in rest], window):
                number, offset = next(numbers), 0
                for i in group:
                    out.append((*rest[i], number, offset))
                    offset += rest[i][2]
            return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))), schema=arrow)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(keys), 256):
                for k, ids in zip(keys[at : at + 256], encode([t or "" for t in texts[at : at + 256]])):
                    ids = np.array([*ids, end_id], dtype="<u4")
                    for start, length in cuts(len(ids), window, least):
                        pieces.append((k, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids)))
                    rows += 1
                    if rows == block:
                        yield placed()
                        pieces, rows = [], 0
        if pieces:
            yield placed()

    return map_small(df.select(key, text), run, schema)
