"""Operator 8, PII: rule matches, then information-theoretic sanitisation of revealing terms.

Base kinds (email, ip, card, phone) are protected entities. Two co-occurrence counts say how much a
term reveals of them; both are held against all rows.

* Entity: terms of a text with an entity are counted over the whole text, for the entity and for its
  part shared with others (e.g. the domain). n(e,t) rows have term t and entity or part e, n(e) have
  e, n(t) have t anywhere. The pointwise mutual information is log2(n(e,t) * N / (n(e) * n(t))) and
  the share n(e,t) / n(t); the pair must be seen in ``support`` different texts.
* Context: the ``beside`` terms on either side of an entity are counted by its kind. k(t) of the o(t)
  places of term t stand beside a value of the kind, and a share P of the places of all terms does; the
  information is log2(k(t) / (o(t) * P)), the share k(t) / o(t); the term must be seen beside
  ``support`` different values, so copies of one text do not add up.

A term is over the disclosure threshold if it has ``least_bits`` of information and a share of
``least_share`` (entity) or ``least_beside`` (context). Such terms become spans wherever they occur
outside an entity, in texts with and without one, and ``sanitise`` generalises (or removes) them
there together with the entities.

Everything that grows with the corpus is counted by grouped aggregation with partial sums and
joined by key. The driver gets a bitmap of fixed size and one sum per kind. Offsets are code
points, end exclusive. Null and empty texts have no spans. Equal texts give equal spans; other
columns are not read, and inner names are chosen apart from theirs.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_batches, map_small, table

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT, LEAST_BITS, LEAST_SHARE, LEAST_BESIDE, BESIDE = 3, 8.0, 0.8, 0.5, 4
BITS = 1 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def entities(text: str) -> list[tuple]:
    """(start, rank of kind, end) of base matches, sorted. An address is found from its @, so a
    long run without one costs nothing; the results are those of the leftmost search."""
    out = []
    at, floor = text.find("@"), 0
    while at >= 0:
        first = at
        while first > floor and text[first - 1] in _LOCAL:
            first -= 1
        m = _DOMAIN.match(text, at) if first < at else None
        if m:
            out.append((first, 0, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def value_of(text: str, entity: tuple) -> tuple[str, str]:
    """(entity, what it shares with others): an address its domain, an ip its first three numbers, a
    card its first six digits, a phone number all but its last four."""
    first, rank, last = entity
    kind, value = KINDS[rank], text[first:last].lower()
    if kind == "email":
        part = value[value.index("@") :]
    elif kind == "ip":
        part = value[: value.rindex(".") + 1]
    else:
        value = "".join(c for c in value if "0" <= c <= "9")
        part = value[:6] if kind == "card" else value[:-4]
    return f"{kind}:{value}", f"{kind} part:{part}"


def terms_of(text: str, found: list[tuple]):
    """Matches of all terms of a text that touch no entity."""
    starts, ends = [], []  # disjoint covered stretches
    for a, _, b in found:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for m in _TERM.finditer(text):
        i = bisect_left(starts, m.end()) - 1
        if i < 0 or ends[i] <= m.start():
            yield m


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


_SPAN = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("rank", T.IntegerType()), T.StructField("last", T.IntegerType())])


_CONTEXT = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("entity", T.LongType()), T.StructField("term", T.LongType())])


def contexts_of(text: str, found: list[tuple], terms: list, beside: int = BESIDE) -> set[tuple]:
    """(kind, entity, term) of the terms next to each entity; ``terms`` are matches in order."""
    starts, out = [m.start() for m in terms], set()
    for e in found:
        at = bisect_left(starts, e[0])
        entity = value_of(text, e)[0]
        out |= {(e[1], entity, m[0].lower()) for m in terms[max(0, at - beside) : at + beside]}
    return out


def mentions(df: DataFrame, text: str = "text", carried: tuple = ("doc_id",), names: tuple = ("text_key", "base", "parts", "terms", "contexts")) -> DataFrame:
    """(*carried, text_key, base spans, parts of entities, terms and contexts of texts with an
    entity); ``names`` are those of the new columns."""
    hashes = T.ArrayType(T.LongType())
    schema = T.StructType([*[df.schema[c] for c in carried], *[T.StructField(n, t) for n, t in zip(names, (T.LongType(), T.ArrayType(_SPAN), hashes, hashes, T.ArrayType(_CONTEXT)))]])
    (source,) = fresh(df, "t_") if text not in carried else (text,)

    def make():
        def step(cols):
            base, parts, terms, contexts = [], [], [], []
            for t in cols[source]:
                t = t or ""
                found = entities(t)
                places = list(terms_of(t, found)) if found else []
                base.append([{"first": a, "rank": r, "last": b} for a, r, b in found])
                parts.append([_hash(p) for p in {p for e in found for p in value_of(t, e)}])
                terms.append([_hash(w) for w in {m[0].lower() for m in places}])
                contexts.append([{"kind": k, "entity": _hash(e), "term": _hash(w)} for k, e, w in contexts_of(t, found, places)])
            return {c: cols[c] for c in carried} | dict(zip(names, (cols[names[0]], base, parts, terms, contexts)))

        return step

    keyed = df.select(*carried, *([F.col(text).alias(source)] if source != text else []), text_key(text).alias(names[0]))
    return map_batches(keyed, keyed.columns, schema, make)


def text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _term_counts(df: DataFrame, text: str) -> DataFrame:
    """(term, n, places): rows that have the term and its places in them, summed within each batch
    before they leave Python."""
    schema = T.StructType([T.StructField("term", T.LongType()), T.StructField("n", T.LongType()), T.StructField("places", T.LongType())])

    def run(batches):
        def out():
            return pa.RecordBatch.from_arrays([pa.array([_hash(w) for w in places], pa.int64()), pa.array([rows[w] for w in places], pa.int64()), pa.array(list(places.values()), pa.int64())], names=["term", "n", "places"])

        rows: Counter = Counter()
        places: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    own = Counter(map(str.lower, _TERM.findall(t)))
                    rows.update(own.keys())
                    places.update(own)
                    if len(rows) > 200_000:  # bounded memory; the sums meet in the aggregation
                        yield out()
                        rows.clear()
                        places.clear()
        if rows:
            yield out()

    return map_small(df.select(text), run, schema).groupBy("term").agg(F.sum("n").alias("n"), F.sum("places").alias("places"))


def revealing(df: DataFrame, found: DataFrame, text: str = "text", support: int = SUPPORT, least_bits: float = LEAST_BITS, least_share: float = LEAST_SHARE, least_beside: float = LEAST_BESIDE) -> DataFrame:
    """(term): terms over the disclosure thresholds. ``found`` is ``mentions(df)``."""
    n = float(max(1, df.where(F.col(text).isNotNull()).count()))
    counts = table(_term_counts(df, text))
    # first by text, so that rows of one text are summed before they meet
    texts = found.where(F.size("parts") > 0).groupBy("text_key").agg(F.count("*").alias("c"), F.first("parts").alias("parts"), F.first("terms").alias("terms"), F.first("contexts").alias("contexts"))
    texts = table(texts)
    by_text = texts.select("text_key", "c", F.explode("parts").alias("entity"))
    # n(e,t) <= n(t), so an entity in more than n / 2**least_bits rows reaches the least bits with no term
    by_entity = by_text.groupBy("entity").agg(F.sum("c").alias("n_e"), F.count("*").alias("texts")).where((F.col("texts") >= support) & (F.col("n_e") <= n / 2.0**least_bits))
    some = texts.select("c", "terms", F.explode("parts").alias("entity")).join(by_entity.select("entity", "n_e"), "entity")
    joint = some.select("entity", "n_e", "c", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.sum("c").alias("n_et"), F.count("*").alias("texts"), F.first("n_e").alias("n_e")).where(F.col("texts") >= support)
    bits = F.log2(F.col("n_et") * F.lit(n) / (F.col("n_e") * F.col("n")))
    of_entities = joint.join(counts, "term").where((bits >= least_bits) & (F.col("n_et") >= least_share * F.col("n"))).select("term")

    near = texts.select("c", F.explode("contexts").alias("x")).groupBy("x.kind", "x.term", "x.entity").agg(F.sum("c").alias("c")).groupBy("kind", "term").agg(F.sum("c").alias("k"), F.count("*").alias("values"))
    near = table(near)
    places = float(counts.agg(F.sum("places")).first()[0] or 1)
    of_kind = {r["kind"]: r["k"] for r in near.groupBy("kind").agg(F.sum("k").alias("k")).collect()}  # a row per kind
    share = F.col("k") / F.col("places")
    usual = F.get(F.array(*[F.lit(max(1, of_kind.get(i, 0)) / places) for i in range(len(KINDS))]), F.col("kind"))
    of_contexts = near.where(F.col("values") >= support).join(counts, "term").where((share >= least_beside) & (F.log2(share / usual) >= least_bits)).select("term")
    return of_entities.unionByName(of_contexts).distinct()


def _bitmap(flagged: DataFrame) -> np.ndarray:
    """One bit for each low part of a flagged hash, of fixed size however many there are."""

    def run(batches):
        bits = np.zeros(BITS, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy() & (BITS - 1)] = True
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(BITS // 8, np.uint8)
    # one bitmap per task, joined by tasks before the last few come here
    def joined_up(batches):
        whole = None
        for batch in batches:
            for b in batch.column(0).to_pylist():
                x = np.frombuffer(b, np.uint8)
                whole = x if whole is None else whole | x
        if whole is not None:
            yield pa.RecordBatch.from_arrays([pa.array([whole.tobytes()], pa.binary())], names=["bits"])

    for r in flagged.mapInArrow(run, "bits binary").repartition(4).mapInArrow(joined_up, "bits binary").collect():
        out |= np.frombuffer(r["bits"], np.uint8)
    return np.unpackbits(out).astype(bool)


def _marked(texts: DataFrame, flagged: DataFrame, text: str) -> DataFrame:
    """(text_key, term spans): every place of a flagged term in ``texts`` (text_key, text). The
    bitmap only saves rows; the join decides."""
    flagged = table(flagged)  # its size is then known
    bits = _bitmap(flagged)
    schema = T.StructType([T.StructField("text_key", T.LongType()), T.StructField("term", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])

    def make():
        packed = {}  # bounded: hashes of words seen

        def hit(word):
            h = packed.get(word)
            if h is None:
                if len(packed) > 100_000:
                    packed.clear()
                h = packed[word] = _hash(word)
            return h if bits[h & (BITS - 1)] else None

        def step(cols):
            out = {f.name: [] for f in schema}
            for k, t in zip(cols["text_key"], cols[text]):
                if not t or all(hit(w.lower()) is None for w in set(_TERM.findall(t))):
                    continue
                for m in terms_of(t, entities(t)):
                    h = hit(m[0].lower())
                    if h is not None:
                        for name, v in zip(out, (k, h, m.start(), m.end())):
                            out[name].append(v)
            return out

        return step

    if not bits.any():
        texts = texts.limit(0)
    where = map_batches(texts, ["text_key", text], schema, make)
    return where.join(flagged, "term").groupBy("text_key").agg(F.collect_set(F.struct(F.col("first"), F.lit(len(KINDS) - 1).alias("rank"), F.col("last"))).alias("__terms"))


def _none() -> Column:
    return F.array().cast("array<struct<first:int,rank:int,last:int>>")


def spans(df: DataFrame, text: str = "text", key: str = "doc_id", **thresholds) -> DataFrame:
    """(key, text_key, spans): base and term spans of every row, by start, then kind as listed."""
    own = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    found = table(mentions(own, "t", ("k",)))
    marked = _marked(own.select(text_key("t").alias("text_key"), "t"), revealing(own, found, "t", **thresholds), "t")
    return found.join(marked, "text_key", "left").select(F.col("k").alias(key), "text_key", F.array_sort(F.concat("base", F.coalesce("__terms", _none()))).alias("spans"))


def joined(spans_: Column, kinds: tuple = KINDS) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["first"], s["last"])), ",")


def sanitised(text: Column, spans_: Column, remove_terms: bool = False) -> Column:
    """The text with each span generalised to its kind, e.g. ``<EMAIL>``; of spans that overlap
    the first (the longest of those with one start) is taken. Null stays null."""
    tags = F.array(*[F.lit("" if k == "term" and remove_terms else f"<{k.upper()}>") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def grow(acc, s):
        piece = F.concat(F.substring(text, acc["at"] + 1, F.greatest(s["first"] - acc["at"], F.lit(0))), F.get(tags, s["rank"]))
        return F.when(s["first"] >= acc["at"], F.struct(s["last"].alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))).otherwise(acc)

    longest = F.array_sort(spans_, lambda a, b: F.when(a["first"] != b["first"], F.signum(a["first"] - b["first"]).cast("int")).otherwise(F.signum(b["last"] - a["last"]).cast("int")))
    whole = F.aggregate(longest, start, grow, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans_) > 0, whole).otherwise(text)


def sanitise(df: DataFrame, text: str = "text", n_chars: str | None = "n_chars", **thresholds) -> DataFrame:
    """The rows of ``df``, all columns, with spans generalised in the text; ``n_chars`` follows."""
    names = tuple(fresh(df, "text_key", "base", "parts", "terms", "contexts"))
    mark_key, marks = fresh(df, "mark_key", "marks")
    rows = table(mentions(df, text, tuple(df.columns), names))
    found = rows.select(*[F.col(n).alias(o) for n, o in zip(names, ("text_key", "base", "parts", "terms", "contexts"))])
    marked = _marked(rows.select(F.col(names[0]).alias("text_key"), F.col(text).alias("t")), revealing(df, found, text, **thresholds), "t")
    marked = table(marked.select(F.col("text_key").alias(mark_key), F.col("__terms").alias(marks)))  # its size is then known
    out = rows.join(marked, F.col(names[0]) == F.col(mark_key), "left")
    spans_ = F.concat(names[1], F.coalesce(marks, _none()))
    out = out.withColumn(text, sanitised(F.col(text), spans_))
    if n_chars in df.columns:
        changed = F.size(F.concat(names[1], F.coalesce(marks, _none()))) > 0
        out = out.withColumn(n_chars, F.when(changed, F.char_length(text).cast(df.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    return out.select(*df.columns)
