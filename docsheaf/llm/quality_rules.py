"""Operator 7, quality rules: a decision list learned by sequential covering.

One Arrow pass computes the statistics of every whole text. From the statistics of labelled
documents (at most ``MAX_LABELLED`` keys, the first by hash, one row of each) sequential covering learns
rules: a conjunction of thresholds is grown literal by literal for the highest information gain
on two thirds of the rows, pruned from its end on the other third, kept if it is precise there,
and the rows that it covers are taken away. The ordered rules become one ``CASE`` expression.

Words are runs of characters other than space, tab, LF, VT, FF and CR. Defined results: a null
or empty text has zero statistics and fails the base rule; a table without labelled documents
gives an empty list, which keeps everything that passes the base rule. Repeated rows are judged
alike. Other columns are not read. Of rows with one key the one with the least statistics is learned
from; of its labels the least (worst) holds.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_type, map_batches

MAX_LABELLED = 20_000
SYMBOLS = "#*$%&|<>"
#: frequent function words of English, German, French and Spanish
STOP = frozenset("""
the of and to in is that for it was on are as with his they at be this from by not but or an he she we you have had which
der die das und ist nicht ein eine zu den dem mit von auf für im sich auch es an als des
le la les de des et est un une du que qui dans pour pas sur au par avec ce il elle
el los las que y en un una por con para del se no es su al lo
""".split())
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("symbol_share", "dup_line_share", "repeat_word_share", "mean_word", "upper_share", "digit_share", "mark_share", "top_word_share", "stop_share", "words_per_line")


def text_stats(text: str, stop: frozenset = STOP) -> tuple:
    """COUNTS then SHARES of one text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at exactly the six ASCII spaces
    n = len(words)
    if not n:
        return (0,) * len(COUNTS) + (0.0,) * len(SHARES)
    spaces = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    chars = len(text) - spaces
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.split()]
    dup = len(lines) - len(set(lines))
    ids: dict = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    repeat = 0
    if n >= 4:
        # a 3-word window as one integer; over 2 million distinct words it is ranked in two steps
        pair = code[:-1] * len(ids) + code[1:]
        if len(ids) > 2_000_000:
            pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        window = pair[:-1] * len(ids) + code[2:]
        order = np.argsort(window, kind="stable")
        same = window[order][1:] == window[order][:-1]
        hit = np.zeros(n - 2, bool)
        hit[order[1:]] |= same
        hit[order[:-1]] |= same
        covered = np.zeros(n, bool)
        for d in range(3):
            covered[d : n - 2 + d] |= hit
        repeat = int(covered.sum())
    letters = np.frombuffer(data, np.uint8)
    upper = int(((letters >= 65) & (letters <= 90)).sum())
    digits = int(((letters >= 48) & (letters <= 57)).sum())
    marks = sum(text.count(c) for c in "!?.,;:")
    times = np.bincount(code)
    top = int(times.max())
    common = int(sum(times[i] for w, i in ids.items() if w.lower().decode("utf-8", "replace") in stop))
    return (n, chars, symbols, dup, repeat, symbols / n, dup / len(lines), repeat / n, chars / n, upper / len(data), digits / len(data), marks / n, top / n, common / n, n / len(lines))


def stats(df: DataFrame, text: str = "text", key: str = "doc_id", extra: tuple = (), prefix: str = "") -> DataFrame:
    """(key, *extra columns carried along, COUNTS, SHARES) of every row; ``prefix`` keeps the new
    names apart from carried ones."""
    carried = [T.StructField(c, df.schema[c].dataType) for c in dict.fromkeys((key, *extra))]
    schema = T.StructType([*carried, *[T.StructField(prefix + c, T.LongType()) for c in COUNTS], *[T.StructField(prefix + c, T.DoubleType()) for c in SHARES]])

    def make():
        def step(cols):
            out = {c: cols[c] for c in (key, *extra)}
            rows = [text_stats(t or "") for t in cols[text]]
            for i, c in enumerate((*COUNTS, *SHARES)):
                out[prefix + c] = [r[i] for r in rows]
            return out

        return step

    return map_batches(df, list(dict.fromkeys([key, *extra, text])), schema, make)


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < 50) | (n_repeat * 100 > n_words * 50)


@dataclass(frozen=True)
class Rule:
    """All literals hold -> reject. A literal is (statistic, '<=' or '>', threshold)."""

    literals: tuple
    precision: float
    covered: int

    def column(self, prefix: str = "") -> Column:
        out = F.lit(True)
        for name, op, x in self.literals:
            out = out & (F.col(prefix + name) <= x if op == "<=" else F.col(prefix + name) > x)
        return out


def _holds(x: np.ndarray, literals) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, op, v in literals:
        out &= (x[:, j] <= v) if op == "<=" else (x[:, j] > v)
    return out


def learn(x: np.ndarray, bad: np.ndarray, names: tuple = SHARES, most_rules: int = 16, most_literals: int = 4, precision: float = 0.8, support: int = 4, cuts: int = 64) -> list[Rule]:
    """Ordered rules that reject rows with ``bad``: grow, prune, keep while precise, cover, repeat."""
    rules: list[Rule] = []
    left = np.arange(len(x))
    while len(rules) < most_rules and bad[left].sum() >= support:
        third = np.arange(len(left)) % 3 == len(rules) % 3
        grow, prune = left[~third], left[third]
        gx, gy = x[grow], bad[grow]
        literals: list = []
        live = np.ones(len(grow), bool)
        while len(literals) < most_literals:
            p0, n0 = int(gy[live].sum()), int((~gy[live]).sum())
            if not p0 or not n0:
                break
            best = (1e-9, None)
            was = math.log2(p0 / (p0 + n0))
            for j in range(x.shape[1]):
                v, y = gx[live, j], gy[live]
                for c in np.unique(np.quantile(v, np.linspace(0, 1, cuts))):
                    low = v <= c
                    for op, m in (("<=", low), (">", ~low)):
                        p = int(y[m].sum())
                        if p < support:
                            continue
                        gain = p * (math.log2(p / int(m.sum())) - was)
                        if gain > best[0]:
                            best = (gain, (j, op, float(c)))
            if best[1] is None:
                break
            literals.append(best[1])
            live &= _holds(gx, [best[1]])

        def worth(ls):
            m = _holds(x[prune], ls)
            return (bad[prune][m].sum() - (~bad[prune][m]).sum()) / max(1, m.sum())

        while len(literals) > 1 and worth(literals[:-1]) >= worth(literals):
            literals.pop()
        m = _holds(x[left], literals) if literals else np.zeros(len(left), bool)
        share = float(bad[left][m].mean()) if m.any() else 0.0
        if share < precision or int(bad[left][m].sum()) < support or worth(literals) < 2 * precision - 1:
            break
        rules.append(Rule(tuple((names[j], op, v) for j, op, v in literals), share, int(m.sum())))
        left = left[~m]
    return rules


def train(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", limit: int = MAX_LABELLED) -> list[Rule]:
    """Rules from labelled rows (label 0: bad). ``limit`` bounds the rows that are used; they are
    picked by the hash of their key before any text is read."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(F.col(label).cast("int")).alias("y"))
    picked = known.withColumn("h", F.xxhash64("k")).sort("h", "k").limit(limit)
    own = df.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(picked), "k")
    rows = stats(own, "t", "k", extra=("y", "h")).groupBy("k").agg(F.min(F.struct("h", *SHARES, "y")).alias("s")).select("k", "s.*").sort("h", "k").collect()
    if not rows:
        return []
    x = np.array([[r[c] for c in SHARES] for r in rows], float)
    return learn(x, np.array([r["y"] == 0 for r in rows]))


def decision(rules: list[Rule], prefix: str = "") -> Column:
    """The list as one ordered conditional expression: true keeps the row."""
    out = None
    for rule in rules:
        out = (F if out is None else out).when(rule.column(prefix), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(df: DataFrame, rules: list[Rule], text: str = "text", key: str = "doc_id", extra: tuple = (), prefix: str = "") -> DataFrame:
    """(key, *extra, COUNTS, SHARES, base_failed, kept)."""
    failed = base_failed(F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words"))
    return stats(df, text, key, extra, prefix).withColumns({f"{prefix}base_failed": failed, f"{prefix}kept": ~failed & decision(rules, prefix)})
