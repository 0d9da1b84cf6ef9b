"""Operator 4, toxicity: a linear-chain conditional random field over words.

Training uses at most ``MAX_LABELLED`` labelled keys outside the held-out fold (picked by hash), one
row of each. Their words are counted, cut into short windows and, once the field is fitted, summed
up by tasks; the driver gets words that pass the thresholds, windows and three numbers a row, never
whole texts. Token labels follow from document labels: a word is a toxic token of a toxic
document if it is far more frequent in toxic than in other documents (add-half log-odds over
``LEAST_ODDS``, in ``SUPPORT`` toxic documents at least). The field has two states, emissions from
hashed word, prefix and suffix features, and transitions; it is fitted by the gradient of its
log-likelihood (gold minus forward-backward marginals) on windows of those rows. A document's
score is a logistic function of its marginals (the largest, the expected number of toxic tokens
and their density), fitted on the same rows' document labels.

Scoring reads whole texts. Forward and backward messages are ratios of the two states, so one
step of a recursion serves all documents of a batch at once.

Defined results: a null text counts as empty, and a text without words has the score of zero
features. Without labelled rows of both kinds every score is 0.0. Repeated rows score alike. Of rows
with one key the least text is learned from; of its labels the greatest holds.
Scores depend on the text alone; other columns are not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import drop, id_type, map_batches, map_small, table

MAX_LABELLED, LEAST_ODDS, SUPPORT, WIDTH, SPAN, LONG = 6_000, 2.0, 4, 1 << 16, 24, 20_000
_TOKEN = re.compile(r"\w+")


def held_out(key: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def features(word: str, width: int = WIDTH) -> tuple[int, int, int]:
    w = word.lower()
    h = xxhash.xxh32_intdigest
    return h(f"w{w}".encode("utf-8", "surrogatepass")) % width, h(f"p{w[:4]}".encode("utf-8", "surrogatepass")) % width, h(f"s{w[-4:]}".encode("utf-8", "surrogatepass")) % width


def _chain(steps: np.ndarray, first: float) -> np.ndarray:
    """Ratios r(t) = (m00 r(t-1) + m01) / (m10 r(t-1) + m11) of 2 x 2 ``steps`` from ``first`` on. Blocks
    of about the root of their number: all blocks' products at once, then their starts, then all
    blocks' ratios at once."""
    n = len(steps)
    width = math.isqrt(n) + 1
    m = np.concatenate([steps, np.broadcast_to(np.eye(2), (-n % width, 2, 2))]).reshape(-1, width, 2, 2)
    whole = np.broadcast_to(np.eye(2), (len(m), 2, 2))
    for t in range(width):
        whole = m[:, t] @ whole
        whole = whole / whole.max(axis=(1, 2), keepdims=True)
    start, r = np.empty(len(m)), first
    for i, w in enumerate(whole):
        start[i], r = r, (w[0, 0] * r + w[0, 1]) / (w[1, 0] * r + w[1, 1])
    out, r = np.empty((len(m), width)), start
    for t in range(width):
        x = m[:, t]
        r = out[:, t] = (x[:, 0, 0] * r + x[:, 0, 1]) / (x[:, 1, 0] * r + x[:, 1, 1])
    return out.ravel()[:n]


def _steps(left: np.ndarray, right: np.ndarray, low_left: np.ndarray, low_right: np.ndarray) -> np.ndarray:
    out = np.empty((max(len(left), len(low_left)), 2, 2))
    out[:, 0, 0], out[:, 0, 1], out[:, 1, 0], out[:, 1, 1] = left, right, low_left, low_right
    return out


def _messages(emission: np.ndarray, lengths: np.ndarray, field: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emission odds, forward and backward ratios of every token of concatenated sequences; one
    step of a recursion serves all sequences but those over ``LONG``, which go in blocks."""
    total = int(lengths.sum())
    a = np.exp(field["transition"])
    e = np.exp(np.clip(emission, -30, 30))
    forward, backward = np.empty(total), np.empty(total)
    begins = np.cumsum(lengths) - lengths
    for i in np.flatnonzero(lengths > LONG):
        at = slice(begins[i], begins[i] + lengths[i])
        x, back = e[at], e[at][:0:-1]
        first, one = x[0] * math.exp(field["start"]), np.ones(len(back))
        forward[at] = np.concatenate([[first], _chain(_steps(x[1:] * a[1, 1], x[1:] * a[0, 1], one * a[1, 0], one * a[0, 0]), first)])
        backward[at] = np.concatenate([[1.0], _chain(_steps(back * a[1, 1], one * a[1, 0], back * a[0, 1], one * a[0, 0]), 1.0)])[::-1]
    lengths = np.where(lengths > LONG, 0, lengths)
    order = np.argsort(-lengths, kind="stable")
    start = begins[order]
    size = lengths[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), "left")  # sequences longer than t
    r = np.zeros(0)
    for t in range(longest):
        at = start[: active[t]] + t
        r = e[at] * (math.exp(field["start"]) if t == 0 else (a[0, 1] + r[: active[t]] * a[1, 1]) / (a[0, 0] + r[: active[t]] * a[1, 0]))
        forward[at] = r
    q = np.ones(len(size))
    ends = start + size - 1
    for t in range(longest):  # t steps before each sequence's end
        at = ends[: active[t]] - t
        if t:
            x = e[at + 1] * q[: active[t]]
            q = (a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x)
        backward[at] = q[: active[t]]
    return e, forward, backward


def marginals(emission: np.ndarray, lengths: np.ndarray, field: dict) -> np.ndarray:
    """P(toxic) of every token of concatenated sequences, by forward and backward ratios."""
    _, forward, backward = _messages(emission, lengths, field)
    odds = forward * backward
    return odds / (1 + odds)


def _fit_field(sequences: list[tuple[list, list]], width: int = WIDTH, epochs: int = 10, rate: float = 0.3, l2: float = 1e-5) -> dict:
    """Adagrad on the conditional log-likelihood; sequences are (feature triples, 0/1 labels)."""
    field = {"weights": np.zeros(width), "transition": np.zeros((2, 2)), "start": 0.0}
    g_w, g_t, g_s = np.full(width, 1e-2), np.full((2, 2), 1e-2), 1e-2
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(sequences)), max(1, len(sequences) // 128)):
            chosen = [sequences[i] for i in part]
            lengths = np.array([len(y) for _, y in chosen])
            f = np.array([x for s, _ in chosen for x in s])
            y = np.array([v for _, s in chosen for v in s], float)
            e, forward, backward = _messages(field["weights"][f].sum(axis=1), lengths, field)
            m = forward * backward / (1 + forward * backward)
            inside = np.ones(len(y), bool)
            inside[np.cumsum(lengths)[:-1]] = False
            inside[0] = False
            firsts = ~inside
            n = len(chosen)
            grad = np.zeros(width)
            for j in range(3):
                np.add.at(grad, f[:, j], (y - m))
            grad = grad / n - l2 * field["weights"]
            # pair marginals from neighbouring token marginals under the current field
            pair = _pair_marginals(field, e, forward, backward, inside)
            gold = np.zeros((2, 2))
            prev, now = y[:-1][inside[1:]].astype(int), y[1:][inside[1:]].astype(int)
            np.add.at(gold, (prev, now), 1.0)
            t_grad = (gold - pair) / n
            s_grad = float((y[firsts] - m[firsts]).mean())
            g_w += grad**2
            g_t += t_grad**2
            g_s += s_grad**2
            field["weights"] += rate * grad / np.sqrt(g_w)
            field["transition"] += rate * t_grad / np.sqrt(g_t)
            field["start"] += rate * s_grad / math.sqrt(g_s)
    return field


def _pair_marginals(field: dict, e: np.ndarray, forward: np.ndarray, backward: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Expected counts of the four transitions: forward message x transition x emission x backward.
    ``inside`` marks tokens that follow one of their own sequence."""
    a = np.exp(field["transition"])
    left, right = forward[:-1][inside[1:]], (e * backward)[1:][inside[1:]]
    joint = np.stack([a[0, 0] + 0 * left, a[0, 1] * right, a[1, 0] * left, a[1, 1] * left * right])
    return (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)


def summary(m: np.ndarray) -> tuple[float, float, float]:
    """Features of one document's marginals."""
    if not len(m):
        return 0.0, 0.0, 0.0
    expected = float(m.sum())
    return float(m.max()), math.log1p(expected), min(1.0, 10 * expected / len(m))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - l2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def words_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def windows(words: list[str], toxic: bool, listed: frozenset) -> list[tuple[list, list]]:
    """Short stretches of a text with their token labels: around listed words (some in a toxic text,
    the first in another), and plain text of a third of those without one."""
    hits = [i for i, w in enumerate(words) if w in listed]
    if hits:
        starts = {max(0, j - SPAN // 2) for j in (hits[:: max(1, len(hits) // 4)] if toxic else hits[:1])}
    else:
        h = xxhash.xxh32_intdigest(" ".join(words[:SPAN]).encode("utf-8", "surrogatepass"))
        starts = {h % max(1, len(words) - SPAN)} if words and h % 3 == 0 else set()
    return [(words[s : s + SPAN], [int(toxic and w in listed) for w in words[s : s + SPAN]]) for s in sorted(starts)]


def fit_field(found: list[tuple[list, list]], width: int = WIDTH) -> dict:
    """The field from (words, labels) windows."""
    memo: dict = {}
    triple = lambda w: memo.get(w) or memo.setdefault(w, features(w, width))
    return _fit_field([([triple(w) for w in words], labels) for words, labels in found], width)


def _emitter(field: dict):
    """words -> their emissions; a bounded number of words is remembered."""
    memo: dict = {}
    w = field["weights"]

    def emissions(words: list[str]) -> np.ndarray:
        found = list(map(memo.get, words))
        if None in found:
            for i, v in enumerate(found):
                if v is None:
                    a, b, c = features(words[i], len(w))
                    memo[words[i]] = found[i] = float(w[a] + w[b] + w[c])
        if len(memo) > 400_000:
            memo.clear()
        return np.array(found, np.float32)

    return emissions


def train(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", limit: int = MAX_LABELLED) -> dict | None:
    """The field and the document-level weights."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    picked = known.withColumn("h", F.xxhash64("k")).sort("h", "k").limit(limit)
    texts = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = table(texts.join(F.broadcast(picked), "k").groupBy("k", "h").agg(F.min("t").alias("t"), F.first("y").alias("y")))  # at most limit rows, whole texts, read again below
    kinds = {r["y"] == 1: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = kinds.get(True, 0), sum(n for y, n in kinds.items() if not y)
    if not bad or not good:
        drop(rows)
        return None

    def seen(batches):
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = sorted(set(words_of(t)))
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([int(y == 1)] * len(words), pa.int64()), pa.array([int(y != 1)] * len(words), pa.int64())], names=["w", "bad", "good"])

    counts = map_small(rows.select("t", "y"), seen, "w string, bad long, good long").groupBy("w").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    listed = frozenset(r["w"] for r in counts.where((F.col("bad") >= SUPPORT) & (odds >= LEAST_ODDS)).select("w").collect())

    def cut(batches):
        for batch in batches:
            out = [(h, i, w, y_) for h, t, y in zip(*(batch.column(c).to_pylist() for c in range(3))) for i, (w, y_) in enumerate(windows(words_of(t), y == 1, listed))]
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in out] for i, n in enumerate(("h", "i", "words", "labels"))}, schema=cut_schema)

    cut_type = T.StructType([T.StructField("h", T.LongType()), T.StructField("i", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(T.IntegerType()))])
    cut_schema = to_arrow_schema(cut_type)
    found = map_small(rows.select("h", "t", "y"), cut, cut_type).sort("h", "i").collect()  # at most 5 windows of SPAN words a row
    if not found:
        drop(rows)
        return None
    field = fit_field([(r["words"], r["labels"]) for r in found])

    def summed(batches):
        emissions = _emitter(field)
        for batch in batches:
            out = []
            for h, t, y in zip(*(batch.column(c).to_pylist() for c in range(3))):
                e = emissions(_TOKEN.findall(t)).astype(float)
                out.append((h, float(y == 1), *summary(marginals(e, np.array([len(e)]), field))))
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in out] for i, n in enumerate(("h", "y", "a", "b", "c"))}, schema=pa.schema([("h", pa.int64()), *[(n, pa.float64()) for n in "yabc"]]))

    x = np.array([tuple(r) for r in map_small(rows.select("h", "t", "y"), summed, "h long, y double, a double, b double, c double").sort("h").collect()])
    drop(rows)
    return {"field": field, "document": _logistic(x[:, 2:], x[:, 1]), "lexicon": sorted(listed)}


def score(df: DataFrame, model: dict | None, text: str = "text", key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """(key, score, n_toxic, spans): spans are the code-point offsets of tokens with a marginal of
    ``least`` or more."""
    span = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("p", T.DoubleType())])
    schema = T.StructType([T.StructField(key, id_type(df, key)), T.StructField("score", T.DoubleType()), T.StructField("n_toxic", T.LongType()), T.StructField("spans", T.ArrayType(span))])

    def make():
        emissions = _emitter(model["field"]) if model else None

        def step(cols):
            texts = [t or "" for t in cols[text]]
            if model is None:
                return {key: cols[key], "score": [0.0] * len(texts), "n_toxic": [0] * len(texts), "spans": [[] for _ in texts]}
            parts = [emissions(_TOKEN.findall(t)) for t in texts]
            lengths = np.array([len(p) for p in parts], np.int64)
            m = marginals(np.concatenate(parts).astype(float) if parts else np.zeros(0), lengths, model["field"])
            scores, counts, spans, w = [], [], [], model["document"]
            ends = np.cumsum(lengths)
            for t, e, n in zip(texts, ends, lengths):
                own = m[e - n : e]
                z = float(w[0] + np.dot(w[1:], summary(own)))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                hot = np.flatnonzero(own >= least)
                counts.append(len(hot))
                if len(hot):
                    places = [x.span() for x in _TOKEN.finditer(t)]
                    spans.append([{"first": places[i][0], "last": places[i][1], "p": float(own[i])} for i in hot])
                else:
                    spans.append([])
            return {key: cols[key], "score": scores, "n_toxic": counts, "spans": spans}

        return step

    return map_batches(df, [key, text], schema, make)
