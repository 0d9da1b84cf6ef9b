"""Operator 6, language ID: Bayesian fusion of text, declared language, address suffix and host.

Text evidence: log-likelihoods of hashed byte n-grams under one multinomial model per language.
Models are fitted on rows with a declared language, about ``MAX_SAMPLE`` of each language (picked
by a hash of key and text; all rows of a language that has no more; equal texts once). Texts are
dealt into four folds by their hash and each fold has models of its own, fitted on the other ones:
so a row's declaration, which is evidence of its own below, never shaped the models that read
its text. Every declared language has a model, of 512 KB in each task. Neighbouring n-grams are
not independent, so their sum is tempered by ``temper`` and capped at ``most_nats``.

Declared-language evidence (for pages the lang attribute of the markup): P(declared | language).
Prior: P(language | host), smoothed towards P(language | address suffix), which is smoothed
towards P(language), each by a pseudo-count. All three come from one grouped aggregation of the
text posteriors over all rows. The posterior is the normalised product.

A row is rejected if its text has fewer than ``least_letters`` letters, if the best posterior
is under ``least_posterior``, or if its n-grams are too unlike the best language's own: their
mean log-likelihood is under the language's own mean by ``floor_drop`` nats and ``floor_spreads``
standard errors. A language whose rows have no n-grams has no such floor.

Defined results: null text counts as empty and is rejected with the prior's language; a null
declared language, host or suffix is its own category. If no row has a declared language and a
text, every row is rejected with a null language. Repeated rows are judged alike; a repeated or
null key is allowed. Other columns are not read, and inner names are chosen apart from theirs.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_batches, map_small, table

BUCKETS, MAX_SAMPLE, FOLDS = 1 << 15, 20_000, 4
TEMPER, MOST_NATS, HOST_WEIGHT, SUFFIX_WEIGHT = 0.1, 30.0, 20.0, 50.0
LEAST_LETTERS, LEAST_POSTERIOR, FLOOR_SPREADS, FLOOR_DROP = 2, 0.5, 8.0, 4.5
SMOOTH = 0.1  # pseudo-count of an n-gram; light, so that a small sample still tells unseen ones


_SPACED = bytes(i if i > 127 or chr(i).isalpha() else 32 for i in range(256))


def ngrams(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text; ASCII other than letters reads as space."""
    x = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass").translate(_SPACED), np.uint8).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64)
    code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    return (((code * np.uint32(2654435761)) >> np.uint32(11)) & np.uint32(buckets - 1)).astype(np.int64)


def fold_of(text: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit("")), F.lit(2)), F.lit(FOLDS)).cast("int")


def page_evidence(pages: DataFrame, url: str = "url", html: str = "html") -> tuple[Column, Column, Column]:
    """(text, declared language, host) of a page: the words of its article, or of its body without
    navigation and scripts; the lang attribute of its html tag; the host of its url. Null columns
    give an empty text and null evidence."""
    page = F.coalesce(F.col(html), F.lit(""))
    article = F.regexp_extract(page, r"(?is)<article\b[^>]*>(.*)</article>", 1)
    body = F.when(article != "", article).otherwise(F.regexp_replace(page, r"(?is)<head\b.*?</head>", " "))
    bare = F.regexp_replace(body, r"(?is)<(script|style|nav|header|footer|aside)\b.*?</\1>|<!--.*?-->|<[^>]*>|&[a-z]+;|&#[0-9a-fx]+;", " ")
    declared = F.nullif(F.lower(F.regexp_extract(page, r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([a-z]{2,3})""", 1)), F.lit(""))
    host = F.nullif(F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://([^/?#:]*)", 1)), F.lit(""))
    return bare, declared, host


def train(df: DataFrame, declared: str = "lang", text: str = "text", key: str = "doc_id", sample: int = MAX_SAMPLE, languages: tuple = (), buckets: int = BUCKETS) -> dict:
    """names, log-probabilities (fold x language x bucket), floors and margins (fold x language).
    Languages are those given, else all declared ones; ``sample`` is the rows of each, about."""
    known = df.where(F.col(declared).isNotNull() & F.col(text).isNotNull()).select(F.col(declared).cast("string").alias("d"), F.col(text).alias("t"), F.col(key).alias("k"))
    sizes = {r[0]: r[1] for r in known.groupBy("d").agg(F.count("*").alias("n")).collect()}  # a row per language
    names = sorted(languages or sizes)
    if not names:
        return {"names": [], "logp": np.zeros((FOLDS, 0, buckets), np.float32), "floor": np.zeros((FOLDS, 0)), "margin": np.zeros((FOLDS, 0))}
    most = F.create_map(*[F.lit(x) for n in names for x in (n, int(min(1.0, sample / max(1, sizes.get(n, 0))) * (1 << 20)))])
    few = known.where(F.pmod(F.xxhash64("k", "t", F.lit(6)), F.lit(1 << 20)) <= F.element_at(most, F.col("d")))
    once = few.groupBy("d", F.xxhash64("t").alias("h")).agg(F.first("t").alias("t")).select("d", fold_of(F.col("t")).alias("fold"), "t")

    def run(batches):
        out: dict = {}
        for batch in batches:
            for d, fold, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                c = np.bincount(ngrams(t, buckets), minlength=buckets)
                out[d, fold] = out[d, fold] + c if (d, fold) in out else c
        for (d, fold), c in out.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(at), pa.string()), pa.array([fold] * len(at), pa.int32()), pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64))], names=["d", "fold", "bucket", "n"])

    summed = map_small(once, run, "d string, fold int, bucket int, n long").groupBy("d", "fold", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((FOLDS, len(names), buckets))
    for r in summed.groupBy("d", "fold").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).collect():  # a bounded row per language and fold
        at = np.array([(x["bucket"], x["n"]) for x in r["c"]], np.int64)
        counts[r["fold"], names.index(r["d"]), at[:, 0]] = at[:, 1]
    whole = counts.sum(axis=0)
    counts = whole[None] - counts  # of the other folds
    counts = np.where(counts.any(axis=2, keepdims=True), counts, whole[None])  # a language that is all in one fold
    logp = np.log((counts + SMOOTH) / (counts.sum(axis=2, keepdims=True) + SMOOTH * buckets)).astype(np.float32)
    p = counts / np.maximum(1.0, counts.sum(axis=2, keepdims=True))
    mean = np.where(counts.any(axis=2), (p * logp).sum(axis=2), -np.inf)
    spread = np.sqrt((p * (logp - (p * logp).sum(axis=2, keepdims=True)) ** 2).sum(axis=2))
    return {"names": names, "logp": logp, "floor": mean, "margin": spread}


def _texts(df: DataFrame, model: dict, text: str, fold: str, carried: list[str], own: list[str]) -> DataFrame:
    """carried columns, n-gram count, letters and the summed log-likelihoods (named by ``own``)."""
    kinds = (T.LongType(), T.LongType(), T.ArrayType(T.DoubleType()))
    schema = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in carried], *[T.StructField(n, t) for n, t in zip(own, kinds)]])
    logp, buckets = model["logp"], model["logp"].shape[2]

    def make():
        flat = [np.ascontiguousarray(x.T) for x in logp]

        def step(cols):
            counts, letters, sums = [], [], []
            for t, f in zip(cols[text], cols[fold]):
                t = t or ""
                grams = ngrams(t, buckets) if t else np.zeros(0, np.int64)
                counts.append(len(grams))
                letters.append(sum(1 for _ in islice(filter(str.isalpha, t), 64)))  # 64 or more
                sums.append(flat[f][grams].sum(axis=0, dtype=np.float64).tolist() if len(grams) else [0.0] * flat[f].shape[1])
            return {c: cols[c] for c in carried} | dict(zip(own, (counts, letters, sums)))

        return step

    return map_batches(df, list(dict.fromkeys([*carried, text, fold])), schema, make)


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    weights = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, b: a + b)
    return F.transform(weights, lambda w: w / total)


def identify(df: DataFrame, model: dict, text: str = "text", key: str = "doc_id", declared: str | None = "lang", host: str | None = "source", temper: float = TEMPER, most_nats: float = MOST_NATS,
             least_posterior: float = LEAST_POSTERIOR, least_letters: int = LEAST_LETTERS, floor_spreads: float = FLOOR_SPREADS, floor_drop: float = FLOOR_DROP, extra: tuple = (), prefix: str = "") -> DataFrame:
    """(key, *extra, language, posterior, text_posterior, declared_language, kept); ``extra``
    columns are carried along, ``prefix`` keeps the new names apart from them."""
    names = model["names"]
    extra = tuple(c for c in dict.fromkeys(extra) if c != key)
    carried = [key, *extra]
    t_, d_, h_, s_, f_, n_, letters_, ll_, lik_, post_, prior_, say_, p_, i_ = fresh(df, "t_", "d_", "h_", "s_", "f_", "n_", "letters_", "ll_", "lik_", "post_", "prior_", "say_", "p_", "i_")
    source = text if text in carried else t_
    given = lambda c: (F.col(c) if c else F.lit(None)).cast("string")
    own = df.select(*carried, *([F.col(text).alias(t_)] if source == t_ else []), given(declared).alias(d_), given(host).alias(h_), fold_of(F.col(text)).alias(f_))
    own = own.withColumn(s_, F.regexp_extract(F.coalesce(h_, F.lit("")), r"\.([A-Za-z]{2,})$", 1))
    outputs = [prefix + c for c in ("language", "posterior", "text_posterior", "declared_language", "kept")]
    named = lambda *columns: [c.alias(n) for c, n in zip(columns, outputs)]
    if not names:
        return own.select(key, *extra, *named(F.lit(None).cast("string"), F.lit(0.0), F.lit(0.0), F.col(d_), F.lit(False)))
    n = len(names)
    zero = F.array(*[F.lit(0.0)] * n)
    scored = _texts(own, model, source, f_, [*carried, d_, h_, s_, f_], [n_, letters_, ll_])
    # tempered, and capped so that text alone cannot silence all other evidence
    low = F.array_max(ll_)
    likelihood = F.transform(ll_, lambda x: F.greatest(F.lit(-most_nats), F.lit(temper) * (x - low)))
    known = table(scored.withColumn(lik_, likelihood).withColumn(post_, F.when(F.col(letters_) >= least_letters, _softmax(F.col(lik_))).otherwise(zero)))

    # one pass over all rows; what follows reads a row per host and declaration
    told = [f"c{i}" for i in range(n)]
    sums = lambda c: [F.sum(c(i)).alias(told[i]) for i in range(n)]
    again = lambda: sums(lambda i: F.col(told[i]))
    vector = F.array(*told)
    cells = table(known.groupBy(F.col(h_).alias("host"), F.col(s_).alias("suffix"), F.col(d_).alias("declared")).agg(*sums(lambda i: F.get(post_, F.lit(i)))))
    overall = cells.agg(*again()).select(F.transform(vector, lambda x: F.coalesce(x, F.lit(0.0))).alias("v")).first()["v"]
    total = sum(overall) or 1.0
    base = F.array(*[F.lit((x + 1.0) / (total + n)) for x in overall])
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    suffixes = cells.groupBy("suffix").agg(*again()).select("suffix", vector.alias("sv"))
    hosts = cells.groupBy("host", "suffix").agg(*again()).select("host", "suffix", vector.alias("hv")).join(suffixes, "suffix")
    by_suffix = F.transform(base, lambda p, i: (F.get("sv", i) + SUFFIX_WEIGHT * p) / (size(F.col("sv")) + SUFFIX_WEIGHT))
    by_host = F.transform("sp", lambda p, i: (F.get("hv", i) + HOST_WEIGHT * p) / (size(F.col("hv")) + HOST_WEIGHT))
    # written, so that their size is known: small ones are broadcast, large ones joined by key with
    # the other side free to be split
    hosts = table(hosts.withColumn("sp", by_suffix).select("host", by_host.alias(prior_)))
    per_language = F.array(*[F.lit(x + 2.0) for x in overall])
    said = F.transform(vector, lambda x, i: F.log((x + 0.5) / F.get(per_language, i)))
    said = table(cells.groupBy("declared").agg(*again()).select("declared", said.alias(say_)))
    joined = known.join(hosts, known[h_].eqNullSafe(hosts["host"]), "left").join(said, known[d_].eqNullSafe(said["declared"]), "left").drop(hosts["host"], said["declared"])

    score = F.transform(lik_, lambda x, i: x + F.log(F.coalesce(F.get(prior_, i), F.get(base, i))) + F.coalesce(F.get(say_, i), F.lit(0.0)))
    out = joined.withColumn(p_, _softmax(score)).withColumn(i_, (F.array_position(p_, F.array_max(p_)) - 1).cast("int"))
    per_fold = lambda x: F.get(F.get(F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in x]), F.col(f_)), F.col(i_))
    mean = F.get(ll_, F.col(i_)) / F.greatest(n_, F.lit(1))
    # the mean of n draws scatters by spread / sqrt(n); real texts (names, loans) lie lower still
    near = mean >= per_fold(model["floor"]) - floor_drop - per_fold(model["margin"]) * floor_spreads / F.sqrt(F.greatest(n_, F.lit(1)).cast("double"))
    return out.select(key, *extra, *named(
        F.get(F.array(*[F.lit(x) for x in names]), F.col(i_)), F.array_max(p_), F.coalesce(F.get(post_, F.col(i_)), F.lit(0.0)), F.col(d_),
        (F.col(letters_) >= least_letters) & (F.array_max(p_) >= least_posterior) & near,
    ))
