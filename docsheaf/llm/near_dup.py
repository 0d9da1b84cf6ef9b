"""Operator 10, near duplicates: Order MinHash candidates, banded alignment, connected classes.

Words are white-space separated, lower-cased. A k-mer is ``K`` = 5 words (a shorter text is one
k-mer). For each of ``FUNCTIONS`` hash functions the sketch holds the ``PICKS`` k-mers with the
smallest hash of (k-mer, occurrence number), in text order; two texts with the same sketch under
one function are candidates. Candidates are linked if a banded alignment of their words finds an
edit similarity (1 - distance / longer length) of at least ``SIMILARITY`` = 0.8; nothing else
decides. Classes are the connected components of the links.

How it scales. Texts with equal words are one node. All nodes of a sketch's bucket are aligned
with the bucket's least node, its hub, as a stream that holds one hub at a time; a hub's partners
are dealt to up to ``DEALS`` tasks. So a group of near copies, however large, costs
one alignment a member. Only buckets whose members are then still in different components go on:
there every pair of different components is decided, under the first function that it shares, in units of at most ``BLOCK`` nodes and
``WORDS`` words a side; a larger bucket is dealt into blocks by size class (linked texts differ
by a quarter in size at most) and hash, and each pair of blocks that can hold links is a unit. A
unit rejects most pairs by the words that they share (an exact bound on the distance) and aligns
the others. No list of pairs is built and nothing is capped. What stays quadratic is a bucket of
texts of one size that share a sketch and are not alike; its tests are spread over its units.

Defined results: a null text counts as empty; texts without words are equal to each other and
to nothing else. Repeated rows are in one class; the class id is its least doc_id (null if all
are null). Node keys are 64-bit hashes of the words, word keys 32-bit ones. Other columns are not
read, and inner names are chosen apart from theirs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import drop, fresh, id_type, map_batches, map_small, table

K, SIMILARITY, FUNCTIONS, PICKS = 5, 0.8, 24, 2
BLOCK, WORDS, DEALS = 256, 200_000, 1024
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def node_of(words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")) - (1 << 63)


def word_hashes(words: list[str], memo: dict | None = None) -> np.ndarray:
    """32-bit keys of words; ``memo`` holds those seen before, a bounded number of them."""
    memo = {} if memo is None else memo
    out = list(map(memo.get, words))
    if None in out:
        if len(memo) > 300_000:
            memo.clear()
        for i, v in enumerate(out):
            if v is None:
                out[i] = memo[words[i]] = xxhash.xxh32_intdigest(words[i].encode("utf-8", "surrogatepass"))
    return np.array(out, np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def kmers(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """Ordered 64-bit k-mer hashes."""
    x = _mixed(hashes.astype(np.uint64) + _ODD)
    n = max(1, len(x) - k + 1) if len(x) else 0
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(x))):
        out = out * _ODD + x[i : i + n]
    return _mixed(out)


def _occurrences(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x, kind="stable")
    new = np.empty(len(x), bool)
    new[:1] = True
    new[1:] = x[order][1:] != x[order][:-1]
    at = np.arange(len(x))
    out = np.empty(len(x), np.uint64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def sketch(mers: np.ndarray, functions: int = FUNCTIONS, picks: int = PICKS) -> np.ndarray:
    """One int64 key for each hash function: its minimum occurrence-labelled k-mers in text order."""
    if not len(mers):
        return np.zeros(0, np.int64)
    seeds = _mixed(np.arange(1, functions + 1, dtype=np.uint64) * _ODD)
    labelled = _mixed(mers + _occurrences(mers) * _ODD)
    ranks = (labelled[None, :] ^ seeds[:, None]) * _MIX
    ranks ^= ranks >> np.uint64(31)
    if len(mers) > picks:
        at, rows = np.empty((functions, picks), np.int64), np.arange(functions)
        for i in range(picks):
            at[:, i] = ranks.argmin(axis=1)
            ranks[rows, at[:, i]] = np.iinfo(np.uint64).max
        chosen = mers[np.sort(at, axis=1)]
    else:
        chosen = np.broadcast_to(mers, (functions, len(mers)))
    key = seeds.copy()
    for i in range(chosen.shape[1]):
        key = key * _ODD + chosen[:, i]
    return _mixed(key).view(np.int64)


def _run(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common start."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n:
        differ = a[at : min(n, at + step)] != b[at : min(n, at + step)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 4
    return n


def _banded(places: dict, n: int, words: list, k: int) -> int:
    """Levenshtein distance of a text of ``n`` words, given by the bits of its places, and ``words``, by
    bit vectors of the band of diagonals -k to k (Hyyro's recurrence, the window moves down one row a
    column); any value over k means more than k."""
    mask, goal = (1 << (2 * k + 1)) - 1, n - len(words)
    up, down = mask & ~((1 << k) - 1), 0  # vertical differences of +1 and -1
    own, d = 1 << (k + goal), max(goal, 0)
    for at, w in enumerate(words, -k):
        x = places.get(w, 0)
        x = (x >> at if at >= 0 else x << -at) & mask
        same = ((((x & up) + up) ^ up) | x | down) & mask
        right, left = down | (mask & ~(same | up)), same & up
        if not same & own:
            d += 1  # values never fall along a diagonal
            if d > k:
                return d
        same >>= 1
        up, down = left | (mask & ~(same | right)), same & right
    return d


def edit_distance(a, b, limit: int) -> int | None:
    """Levenshtein distance if it is at most ``limit``. Common ends go first; the band is narrow at
    first and as wide as ``limit`` if that does not do."""
    a, b = np.asarray(a), np.asarray(b)
    lo = _run(a, b)
    a, b = a[lo:], b[lo:]
    hi = _run(a[::-1], b[::-1])
    a, b = a[: len(a) - hi].tolist(), b[: len(b) - hi].tolist()
    if abs(len(a) - len(b)) > limit:
        return None
    if not a or not b:
        return max(len(a), len(b))
    places = _places(a)
    k = max(abs(len(a) - len(b)), 100)
    while True:
        k = min(k, limit)
        d = _banded(places, len(a), b, k)
        if d <= k:
            return d
        if k == limit:
            return None
        k *= 8


def _places(words: list) -> dict:
    """word -> the number whose bits are its places."""
    out: dict = {}
    if len(words) < 4096:
        for i, w in enumerate(words):
            out[w] = out.get(w, 0) | 1 << i
        return out
    for i, w in enumerate(words):
        out.setdefault(w, []).append(i)
    for w, at in out.items():
        x = np.zeros(at[-1] // 8 + 1, np.uint8)
        np.bitwise_or.at(x, np.array(at) // 8, (1 << (np.array(at) % 8)).astype(np.uint8))
        out[w] = int.from_bytes(x.tobytes(), "little")
    return out


def most_edits(longer, least: float = SIMILARITY):
    """Edits that leave a similarity of ``least``."""
    return np.floor(np.asarray(longer) * (1 - least) + 1e-9).astype(np.int64)


def aligned(a, b, least: float = SIMILARITY) -> bool:
    """Edit similarity 1 - distance / longer length of at least ``least``."""
    longer = max(len(a), len(b))
    return longer == 0 or edit_distance(a, b, int(most_edits(longer, least))) is not None


def bag(words: np.ndarray) -> np.ndarray:
    """Sorted keys of the words with their occurrence numbers: each edit changes one at most."""
    return np.sort(_mixed(words.astype(np.uint64) * _ODD + _occurrences(words)))


def alike(a: np.ndarray, b: np.ndarray, bag_a: np.ndarray, bag_b: np.ndarray, least: float = SIMILARITY) -> bool:
    """``aligned``, after the bounds by length and by shared words."""
    longer = max(len(a), len(b))
    limit = int(most_edits(longer, least))
    if longer - min(len(a), len(b)) > limit:
        return False
    shared = np.concatenate([bag_a, bag_b])
    shared.sort(kind="stable")
    if longer - int((shared[1:] == shared[:-1]).sum()) > limit:
        return False
    return aligned(a, b, least)


def link_unit(seqs: list[np.ndarray], sides: np.ndarray, labels: np.ndarray | None = None, before: np.ndarray | None = None, least: float = SIMILARITY) -> np.ndarray:
    """Component label (an index) of each member. Members with equal ``labels`` are linked already;
    only pairs of different sides are compared if there are two sides, and no pair that agrees in a
    column of ``before`` (sketches under earlier functions, whose buckets decide it)."""
    s = len(seqs)
    before = np.zeros((s, 0), np.int64) if before is None else before
    label = np.arange(s) if labels is None else np.unique(labels, return_inverse=True)[1]
    size = np.array([len(x) for x in seqs])
    order = np.argsort(size, kind="stable")
    bags = [bag(seqs[i]) for i in order]
    _, inverse, count = np.unique(np.concatenate(bags), return_inverse=True, return_counts=True)
    column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[inverse]
    width = int((count > 1).sum())
    bits = np.zeros((s, -(-width // 64) * 8 or 8), np.uint8)
    scratch, at = np.zeros(bits.shape[1] * 8, bool), 0
    for r, x in enumerate(bags):
        own = column[at : at + len(x)]
        own = own[own >= 0]
        scratch[own] = True
        bits[r] = np.packbits(scratch)
        scratch[own] = False
        at += len(x)
    bits = bits.view(np.uint64)
    label, size, side, before, two = label[order], size[order], sides[order], before[order], len(set(sides.tolist())) > 1
    limits = most_edits(size, least)
    for r in range(s - 1):
        hi = int(np.searchsorted(size, size[r] / least + 1, "right"))  # a little too far; the limit decides
        for lo in range(r + 1, hi, 512):
            other = slice(lo, min(hi, lo + 512))
            ok = label[other] != label[r]
            if two:
                ok &= side[other] != side[r]
            at = np.flatnonzero(ok) + lo
            if before.shape[1] and len(at):
                at = at[~(before[at] == before[r]).any(axis=1)]
            if len(at):
                room = limits[at] - size[at] + np.bitwise_count(bits[at] & bits[r]).sum(axis=1, dtype=np.int64)
                for c in at[np.argsort(-room, kind="stable")][: int((room >= 0).sum())].tolist():  # the likeliest first
                    if label[r] != label[c] and aligned(seqs[order[r]], seqs[order[c]], least):
                        label[label == label[c]] = label[r]
    out = np.empty(s, np.int64)
    out[order] = label
    return out


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has an edge, root the least node of its component.
    Large-star and small-star rounds; each is written to the shared folder."""
    now = table(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    while True:
        # done when each node points to one root and no root points on
        ends = now.select("u", F.lit(1).alias("out")).unionByName(now.select(F.col("v").alias("u"), F.lit(0).alias("out")))
        open_ = ends.groupBy("u").agg(F.sum("out").alias("outs"), F.min("out").alias("least")).where("outs > 1 or (outs = 1 and least = 0)")
        if not open_.take(1):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join has exchanges of its own and a hub's rows can be split
        least = table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = table(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        down = table(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, table(small)
        drop(before, least, large, down)
    out = table(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
    drop(now)
    return out


def _sketched(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, text_key, node, size in words, sketch) of every row."""
    names = fresh(df, "text_key", "node", "size", "sketch")
    kinds = (T.LongType(), T.LongType(), T.LongType(), T.ArrayType(T.LongType()))
    schema = T.StructType([T.StructField(key, id_type(df, key)), *[T.StructField(n, t) for n, t in zip(names, kinds)]])

    def make():
        memo: dict = {}

        def step(cols):
            nodes, sizes, sketches = [], [], []
            for t in cols[text]:
                words = words_of(t)
                nodes.append(node_of(words))
                sizes.append(len(words))
                sketches.append(sketch(kmers(word_hashes(words, memo))))
            return {key: cols[key]} | dict(zip(names, (cols[names[0]], nodes, sizes, sketches)))

        return step

    keyed = df.select(key, *([text] if text != key else []), text_key(text).alias(names[0]))
    found = map_batches(keyed, keyed.columns, schema, make)
    return found.select(F.col(key).alias("key"), *[F.col(n).alias(o) for n, o in zip(names, ("text_key", "node", "size", "sketch"))])


def text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _word_rows(df: DataFrame) -> DataFrame:
    """(node, words) from (node, text)."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("words", T.BinaryType())])

    def make():
        memo: dict = {}
        return lambda cols: {"node": cols["node"], "words": [word_hashes(words_of(t), memo).tobytes() for t in cols["text"]]}

    return map_batches(df, ["node", "text"], schema, make)


_EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _edges(pairs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}, schema=to_arrow_schema(_EDGE))


def _hub_links(stars: DataFrame, words: DataFrame) -> DataFrame:
    """Links (a, b) among (node, hub): a hub's rows stream past its words, in up to ``DEALS`` parts."""
    dealt = stars.withColumn("deal", F.pmod(F.xxhash64("node"), F.lit(DEALS)).cast("int"))
    spokes = dealt.join(words.drop("sketch"), "node").select("hub", "deal", F.lit(1).alias("role"), "node", "words")
    hubs = dealt.select("hub", "deal").distinct().join(words.select(F.col("node").alias("hub"), "words"), "hub").select("hub", "deal", F.lit(0).alias("role"), F.col("hub").alias("node"), "words")
    rows = spokes.unionByName(hubs).repartition("hub", "deal").sortWithinPartitions("hub", "deal", "role", "node")

    def run(batches):
        mine = None
        for batch in batches:
            pairs = []
            for hub, role, node, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x = np.frombuffer(data, np.uint32)
                if not role:
                    mine = (hub, x, bag(x))
                elif alike(mine[1], x, mine[2], bag(x)):
                    pairs.append((node, hub))
            yield _edges(pairs)

    return table(map_small(rows.select("hub", "role", "node", "words"), run, _EDGE))


def _units(members: DataFrame, block: int, most_words: int) -> DataFrame:
    """(node, label, f, unit, side): the units of work of each (bucket, f, node, size, label)."""
    step = -np.log(SIMILARITY) * 1.001  # linked sizes lie in the same or in neighbouring size classes
    m = members.withColumn("g", F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / float(step)).cast("int"))
    part = m.groupBy("bucket", "g").agg(F.count("*").alias("c"), F.sum("size").alias("w"))
    sizes = part.groupBy("bucket").agg(F.sum("c").alias("c"), F.sum("w").alias("w"), F.collect_list(F.struct("g", F.ceil(F.greatest(F.col("c") / block, F.col("w") / most_words)).cast("int").alias("b"))).alias("classes"))
    # a few dozen classes a bucket at most; apart from m's own exchange, so that a large bucket can be split in the join
    sized = table(sizes.where((F.col("c") > block) | (F.col("w") > most_words)).select("bucket", "classes"))
    blocks = lambda g: F.get(F.filter("classes", lambda x: x["g"] == g), F.lit(0))["b"]
    big = m.join(sized, "bucket", "left").withColumns({"b": blocks(F.col("g")), "b_up": blocks(F.col("g") + 1), "b_down": blocks(F.col("g") - 1)})
    big = big.withColumn("own", F.pmod(F.xxhash64("node"), F.coalesce("b", F.lit(1))).cast("int"))
    unit = lambda *x: F.xxhash64("bucket", *x)
    none = F.array().cast("array<struct<unit:bigint,side:int>>")

    def each(count, make):
        return F.when(F.coalesce(count, F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), F.coalesce(count, F.lit(1)) - 1), make)).otherwise(none)

    same = each(F.col("b"), lambda i: F.struct(unit(F.col("g"), F.least(i, F.col("own")), F.col("g"), F.greatest(i, F.col("own"))).alias("unit"), F.when(F.col("own") > i, 1).otherwise(0).alias("side")))
    above = each(F.col("b_up"), lambda i: F.struct(unit(F.col("g"), F.col("own"), F.col("g") + 1, i).alias("unit"), F.lit(0).alias("side")))
    below = each(F.col("b_down"), lambda i: F.struct(unit(F.col("g") - 1, i, F.col("g"), F.col("own")).alias("unit"), F.lit(1).alias("side")))
    one = F.array(F.struct(unit().alias("unit"), F.lit(0).alias("side")))
    return big.select("node", "label", "f", F.explode(F.when(F.col("b").isNull(), one).otherwise(F.concat(same, above, below))).alias("e")).select("node", "label", "f", "e.unit", "e.side")


def _unit_links(rows: DataFrame) -> DataFrame:
    """Spanning edges (a, b) between the labels that new links join, from
    (unit, side, node, label, f, words, sketch)."""

    def run(batches):
        unit, held = None, {}

        def close():
            nodes = list(held)
            if len(nodes) < 2:
                return _edges([])
            sides, labels = np.array([held[x][0] for x in nodes]), np.array([held[x][1] for x in nodes])
            before = np.array([held[x][3] for x in nodes], np.int64).reshape(len(nodes), -1)
            label = link_unit([np.frombuffer(held[x][2], np.uint32) for x in nodes], sides, labels, before)
            root: dict = {}
            for was, c in zip(labels.tolist(), label.tolist()):
                root[c] = min(was, root.get(c, was))
            return _edges(sorted({(was, root[c]) for was, c in zip(labels.tolist(), label.tolist()) if was != root[c]}))

        for batch in batches:
            for u, side, node, label, words, before in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if u != unit:
                    if held:
                        yield close()
                    unit, held = u, {}
                held[node] = (side, label, words, before)
        if held:
            yield close()

    ordered = rows.repartition("unit").sortWithinPartitions("unit", "node")
    return map_small(ordered.select("unit", "side", "node", "label", "words", F.slice("sketch", F.lit(1), F.col("f")).alias("before")), run, _EDGE)


def _labelled(df: DataFrame, text: str, key: str, block: int, most_words: int) -> DataFrame:
    """(key, text_key, class) of every row, written to the shared folder."""
    base = table(_sketched(df, text, key))
    nodes = table(base.groupBy("node").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.min(F.struct("text_key", "key")).alias("pick")))
    held = nodes.select("node", "size", F.posexplode("sketch").alias("f", "bucket"))
    # members: which texts hold a bucket, told by sums of their hashes, so that equal buckets count once
    shared = held.groupBy("bucket").agg(F.min("node").alias("hub"), F.min_by("size", "node").alias("hub_size"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 40))).alias("s")).where("c > 1")
    shared = shared.select("bucket", "hub", "hub_size", F.struct("c", "x", "s").alias("members"))
    held = table(held.join(shared, "bucket").groupBy("node", "size", "hub", "hub_size", "members").agg(F.min("f").alias("f")))
    within = F.greatest("size", "hub_size") - F.least("size", "hub_size") <= F.floor(F.greatest("size", "hub_size") * (1 - SIMILARITY) + 1e-9)
    stars = table(held.where((F.col("node") != F.col("hub")) & within).select("node", "hub").distinct())
    picks = held.select("node").distinct().join(nodes.select("node", "pick"), "node").select("node", F.col("pick.text_key").alias("pick_text"), F.col("pick.key").alias("pick_key"))
    keyed = df.select(F.col(key).alias("key"), F.col(text).alias("text"), text_key(text).alias("text_key"))
    texts = keyed.join(picks.hint("merge"), (F.col("text_key") == F.col("pick_text")) & F.col("key").eqNullSafe(F.col("pick_key"))).select("node", "text")
    words = _word_rows(texts).groupBy("node").agg(F.first("words").alias("words"))
    words = table(words.join(nodes.select("node", "sketch"), "node"))
    links = _hub_links(stars, words)
    found = components(links, "a", "b")
    # buckets that still hold several components; in one of two members the hub has decided
    told = held.where("members.c > 2").select("node", "size", "members", "f").join(found, "node", "left").select("members", "f", "node", "size", F.coalesce("root", "node").alias("label"))
    told = table(told)
    mixed = table(told.groupBy("members").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a != b").select("members", F.xxhash64("members").alias("bucket")))
    rest = table(told.join(mixed, "members").select("bucket", "f", "node", "size", "label"))
    more = table(_unit_links(_units(rest, block, most_words).join(words, "node")))
    moved = components(more, "a", "b")
    last = base.select("key", "text_key", "node").join(found, "node", "left").select("key", "text_key", F.coalesce("root", "node").alias("label"))
    last = last.join(moved.select(F.col("node").alias("label"), "root"), "label", "left").select("key", "text_key", F.coalesce("root", "label").alias("class"))
    labelled = table(last)
    drop(base, nodes, held, stars, words, links, found, told, mixed, rest, more, moved)
    return labelled


def classes(df: DataFrame, text: str = "text", key: str = "doc_id", block: int = BLOCK, most_words: int = WORDS) -> DataFrame:
    """(key, class_id, class_rows) of every row."""
    labelled = _labelled(df, text, key, block, most_words)
    several = labelled.groupBy("class").agg(F.min("key").alias("class_id"), F.count("*").alias("class_rows")).where("class_rows > 1")
    several = table(several)  # an exchange of its own, so that a hot class can be split in the join
    return labelled.join(several, "class", "left").select(
        F.col("key").alias(key), F.when(F.col("class_rows").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_rows", F.lit(1)).cast("long").alias("class_rows")
    )


def representatives(df: DataFrame, text: str = "text", key: str = "doc_id", block: int = BLOCK, most_words: int = WORDS) -> DataFrame:
    """The rows of ``df``, all columns, that stay: of each class the one with the least key,
    a null key last. Of rows that agree in key and text one stays."""
    labelled = _labelled(df, text, key, block, most_words)
    picks = labelled.groupBy("class").agg(F.min(F.struct(F.col("key").isNull().alias("n"), F.col("key").alias("k"), F.col("text_key").alias("t"))).alias("p"), F.count("*").alias("c")).where("c > 1").select("class", F.col("p.k").alias("pk"), F.col("p.t").alias("pt"))
    picks = table(picks)  # as in classes()
    mine, gone_key, gone_text = fresh(df, "text_key", "gone_key", "gone_text")
    gone = labelled.join(picks, "class").where(~(F.col("key").eqNullSafe(F.col("pk")) & (F.col("text_key") == F.col("pt")))).select(F.col("key").alias(gone_key), F.col("text_key").alias(gone_text)).distinct()
    keyed = df.withColumn(mine, text_key(text))
    left = keyed.join(gone.hint("merge"), F.col(key).eqNullSafe(F.col(gone_key)) & (F.col(mine) == F.col(gone_text)), "left_anti")
    if labelled.groupBy("key", "text_key").agg(F.count("*").alias("c")).where("c > 1").take(1):
        left = left.dropDuplicates([key, mine])
    return left.select(*df.columns)
