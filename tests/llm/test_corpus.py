"""Media, toxicity, packing, language, quality, PII and tokens against brute force or round trips."""

import hashlib
import io
import itertools
import math
import random
import re
import struct
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pytest
from docsheaf.llm import lang_id, media, packing, pii, quality_rules, queries, sp_codec, toxicity
from pyspark.sql import functions as F


# --- 2 media ------------------------------------------------------------------------------


def test_media_round_trip(odd, empty):
    texts = [r["text"] for r in odd.select("text").collect()]
    got = media.media_columns(odd).collect()
    assert len(got) == len(texts)
    by_text = defaultdict(set)
    for r in got:
        with wave.open(io.BytesIO(bytes(r["media"]))) as w:
            assert (w.getnchannels(), w.getsampwidth()) == (1, 1)
            back = w.readframes(w.getnframes())
        data = back[: r["n_bytes"]]
        assert data.decode() in {t or "" for t in texts} and set(back[r["n_bytes"] :]) <= {255}
        assert r["payload_bytes"] == len(back) > 0 and len(back) % 576 == 0 and len(back) - r["n_bytes"] <= 576
        assert r["payload_sha256"] == hashlib.sha256(back).hexdigest() and r["tail_crc32"] == zlib.crc32(back[-32:])
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        by_text[data].add(tuple(r["landmarks"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert media.media_columns(empty).count() == 0


def plain_landmarks(data):
    """The rule by a direct Fourier sum in double precision, frame by frame."""
    w, hop, n_bins = media.WINDOW, media.HOP, media.WINDOW // 2 + 1
    t, k = np.arange(w), np.arange(n_bins)[:, None]
    wave_c, wave_s = np.cos(2 * math.pi * k * t / w), np.sin(2 * math.pi * k * t / w)
    shape = 0.5 - 0.5 * np.cos(2 * math.pi * t / (w - 1))
    peaks = []
    for at in range(0, len(data) - w + 1, hop):
        x = np.array([b - 128.0 for b in data[at : at + w]])
        x = (x - x.mean()) * shape
        mag = np.hypot(wave_c @ x, wave_s @ x)
        tops = [i for i in range(1, n_bins - 1) if mag[i] > mag[i - 1] and mag[i] >= mag[i + 1] and mag[i] > 1.0]
        peaks.append(sorted(tops, key=lambda i: -mag[i])[: media.PEAKS])
    return {(f << 20) | (a << 12) | (b << 4) | dt for f, own in enumerate(peaks) for dt in range(1, media.AHEAD + 1) if f + dt < len(peaks) for a in own for b in peaks[f + dt]}


def test_landmarks_by_direct_sums(docs):
    for t in [r[0] for r in docs.sort("doc_id").limit(12).select("text").collect()] + ["abc " * 400, "x"]:
        data = media.pad((t or "").encode())
        got = set(media.landmarks(np.frombuffer(data, np.uint8)).tolist())
        want = plain_landmarks(data)
        assert len(got ^ want) <= 0.01 * len(want), t[:40]  # single precision may swap peaks of one height


def test_media_query_returns_the_arrays(spark, sf_dir):
    got = queries.op2_media_columns(spark, sf_dir)
    assert dict(got.dtypes)["landmarks"] == "array<bigint>" and got.columns[:8] == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    r = got.sort("doc_id").first()
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("doc_id") == r["doc_id"]).first()["text"]
    assert r["landmarks"] == media.landmarks(np.frombuffer(media.pad(text.encode()), np.uint8)).tolist() and r["n_landmarks"] == len(r["landmarks"])


def test_spectrum_and_landmarks():
    t = np.arange(4000)
    tone = (128 + 60 * np.sin(2 * np.pi * 32 * t / 256)).astype(np.uint8)
    mag = media.spectrum(tone)
    assert (mag.argmax(axis=1) == 32).all()
    frame = tone[:256].astype(float) - 128
    frame = (frame - frame.mean()) * np.hanning(256)
    slow = [abs(sum(frame[i] * np.exp(-2j * np.pi * k * i / 256) for i in range(256))) for k in (0, 32, 100)]
    assert np.allclose(mag[0, [0, 32, 100]], slow, atol=0.05)
    marks = media.landmarks(tone)
    assert ((marks >> 12 & 255) == 32).any() and (np.diff(marks >> 20) >= 0).all() and set((marks & 15).tolist()) <= {1, 2, 3, 4}
    noise = np.random.default_rng(0).integers(0, 256, 700_000).astype(np.uint8)
    whole = media.landmarks(noise)  # more frames than one block
    cut = media.landmarks(noise[: 128 * 5000 + 256])
    assert set(cut[(cut >> 20) < 4900].tolist()) == set(whole[(whole >> 20) < 4900].tolist())


# --- 4 toxicity ---------------------------------------------------------------------------


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    field = {"transition": rng.normal(size=(2, 2)), "start": 0.3}
    lengths = np.array([4, 0, 1, 6])
    e = rng.normal(size=11)
    got = toxicity.marginals(e, lengths, field)
    at = 0
    for n in lengths:
        total, hit = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            s = sum(e[at + i] * y[i] for i in range(n)) + (field["start"] * y[0] if n else 0) + sum(field["transition"][y[i], y[i + 1]] for i in range(n - 1))
            total += math.exp(s)
            hit += math.exp(s) * np.array(y)
        assert np.allclose(got[at : at + n], hit / total)
        at += n


def test_long_sequences_in_blocks(monkeypatch):
    """Blocks give the ratios of the plain recursion."""
    rng = np.random.default_rng(6)
    field = {"transition": rng.normal(size=(2, 2)), "start": -0.4}
    lengths = np.array([700, 3, 0, 1201, 5])
    e = rng.normal(size=lengths.sum()) * 3
    want = toxicity._messages(e, lengths, field)
    monkeypatch.setattr(toxicity, "LONG", 2)
    for x, y in zip(toxicity._messages(e, lengths, field), want):
        assert np.allclose(x, y, rtol=1e-9)


def test_field_gradient():
    """The pair marginals are those of the enumeration, so gold minus them is the gradient."""
    rng = np.random.default_rng(2)
    f = rng.integers(0, 50, (5, 3))
    field = {"weights": rng.normal(size=50), "transition": rng.normal(size=(2, 2)), "start": -0.2}
    inside = np.array([False, True, True, False, True])
    e, want = field["weights"][f].sum(axis=1), np.zeros((2, 2))
    got = toxicity._pair_marginals(field, *toxicity._messages(e, np.array([3, 2]), field), inside)
    for lo, hi in ((0, 3), (3, 5)):
        total, part = 0.0, np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=hi - lo):
            s = sum(e[lo + i] * y[i] for i in range(hi - lo)) + field["start"] * y[0] + sum(field["transition"][y[i], y[i + 1]] for i in range(hi - lo - 1))
            total += math.exp(s)
            for i in range(hi - lo - 1):
                part[y[i], y[i + 1]] += math.exp(s)
        want += part / total
    assert np.allclose(got, want)


def test_toxicity_held_out(spark, odd, empty):
    random.seed(0)
    words = ["".join(random.choice("aeiou") + random.choice("bcdfg") for _ in range(3)) for _ in range(80)]
    bad = ["vilewurd", "nastyterm", "foulname"]
    rows = []
    for i in range(600):
        w = [random.choice(words) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w[random.randrange(40)] = random.choice(bad)
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert set(bad) <= set(model["lexicon"])
    got = toxicity.score(df.select("doc_id", "text"), model).withColumn("held_out", toxicity.held_out("doc_id")).collect()
    assert {r["doc_id"] for r in got if r["held_out"]} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    truth = {i: t for i, _, t in rows}
    held = [r for r in got if r["held_out"]]
    assert sum((r["score"] >= 0.5) == bool(truth[r["doc_id"]]) for r in held) >= 0.95 * len(held)
    texts = {i: t for i, t, _ in rows}
    tagged = [texts[r["doc_id"]][s["first"] : s["last"]] for r in got for s in r["spans"]]
    assert sum(x in bad for x in tagged) >= 0.9 * len(tagged) > 100
    # labels of the held-out fold are never used
    flipped = df.select("doc_id", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    again = toxicity.train(df.select("doc_id", "text"), flipped)
    assert np.array_equal(again["field"]["weights"], model["field"]["weights"]) and np.array_equal(again["document"], model["document"])
    s = toxicity.score(odd, model).collect()
    assert len(s) == odd.count() and all(0 <= r["score"] <= 1 for r in s)
    assert toxicity.score(empty, model).count() == 0
    assert {r["score"] for r in toxicity.score(odd, None).collect()} == {0.0}
    assert toxicity.train(empty, df.select("doc_id", "toxic").limit(0)) is None


# --- 5 packing ----------------------------------------------------------------------------


def packed(df, **how):
    return packing.pack_documents(df, public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN, **how)


#: the string of a special token in a text is that token, by the contract's call
SPECIAL = ["<|endoftext|>", "one<|endoftext|>two", " a  <|endoftext|>  b\n<|endoftext|>\n", "<|endoftext|><|endoftext|>x", "<|endoftext| >", "<|endoftext", "a <|ENDOFTEXT|> b"]


def test_packing_loses_nothing(spark, docs, odd, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    special = [(20_000 + i, t) for i, t in enumerate(SPECIAL)]
    df = docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10_000).alias("doc_id"), "text")).unionByName(spark.createDataFrame(special, "doc_id long, text string"))
    texts = defaultdict(list)
    for r in df.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    rows = packed(df).collect()
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
    assert set(by_doc) == set(texts)
    for k, pieces in by_doc.items():
        want = Counter()
        for t in texts[k]:
            ids = np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4")
            for p in {(p["start"], p["length"]) for p in pieces if p["doc_tokens"] == len(ids)}:
                want[(p[0], p[1], zlib.crc32(ids[p[0] : p[0] + p[1]].tobytes()))] += 1
            assert sum(p["length"] for p in pieces) == sum(len(tok.encode(x, add_special_tokens=False).ids) + 1 for x in texts[k])
        assert Counter((p["start"], p["length"], p["ids_crc32"]) for p in pieces) == want
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.WINDOW
    assert packed(empty).count() == 0
    assert [(r["length"], r["offset"]) for r in packed(odd.where("doc_id = 1")).collect()] == [(1, 0)]


def test_both_coders_agree(docs, odd):
    texts = [r[0] or "" for r in docs.select("text").limit(60).union(odd.select("text")).collect()]
    assert packing.load_encoder(public.path("byte_bpe_50k.json"))(texts) == packing.load_encoder(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)(texts)


def test_differencing():
    random.seed(3)
    for _ in range(60):
        sizes = [random.randint(1, 100) for _ in range(random.randint(1, 40))]
        k = random.randint(1, 8)
        groups = packing.differencing(sizes, k)
        assert len(groups) == k and sorted(i for g in groups for i in g) == list(range(len(sizes)))
    # two ways: the classic result of differencing 8 7 6 5 4 is a difference of 2
    a, b = (sum([8, 7, 6, 5, 4][i] for i in g) for g in packing.differencing([8, 7, 6, 5, 4], 2))
    assert abs(a - b) == 2
    sizes = [random.randint(1, 512) for _ in range(900)]
    groups = packing.pack(sizes, 2048)
    sums = [sum(sizes[i] for i in g) for g in groups]
    assert max(sums) <= 2048 and len(groups) <= -(-sum(sizes) // 2048) + 2
    assert packing.pack([2048, 2048, 1], 2048) and len(packing.pack([1500, 1500, 1500], 2048)) == 3


# --- 6 language ---------------------------------------------------------------------------


def test_language(spark, docs, odd, empty):
    wrong = docs.withColumn("lang", F.when(F.col("doc_id") % 17 == 3, "en").otherwise(F.col("lang")))
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = lang_id.identify(wrong, lang_id.train(wrong)).collect()
    assert len(got) == len(truth)
    assert sum(r["language"] == truth[r["doc_id"]] for r in got) >= 0.97 * len(truth)  # text beats wrong declarations
    assert sum(r["kept"] for r in got) >= 0.99 * len(truth)
    model = lang_id.train(docs)
    r = {x["doc_id"]: x for x in lang_id.identify(odd, model).collect()}
    assert not r[1]["kept"] and not r[2]["kept"] and not r[3]["kept"] and r[4]["language"] in model["names"]
    assert lang_id.identify(odd, model).count() == odd.count() and lang_id.identify(empty, model).count() == 0
    none = lang_id.train(empty)
    assert {x["kept"] for x in lang_id.identify(odd, none).collect()} == {False}
    alien = spark.createDataFrame([(1, "Съешь же ещё этих мягких французских булок, да выпей чаю " * 40, None, None)], "doc_id long, text string, lang string, source string")
    assert not lang_id.identify(alien, model).first()["kept"]


def invented(language, n, size=40):
    """Texts of one of many languages, each with words of its own."""
    rng = np.random.default_rng(language)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(30)]
    return [" ".join(rng.choice(words, size)) for _ in range(n)]


def test_all_languages_have_a_model(spark):
    rows = [(i * 10 + j, t, f"l{i:02}", "") for i in range(70) for j, t in enumerate(invented(i, 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = lang_id.identify(df, lang_id.train(df)).collect()
    assert len(got) == len(rows) and all(r["kept"] and r["language"] == r["declared_language"] for r in got)


def test_a_rare_language_is_sampled(spark):
    rows = [(i, t, "big", "") for i, t in enumerate(invented(1, 2000))] + [(5000 + i, t, "rare", "") for i, t in enumerate(invented(2, 4))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in lang_id.identify(df, lang_id.train(df, sample=8)).collect()}
    assert all(got[k]["language"] == d and got[k]["kept"] for k, _, d, _ in rows)
    none = lang_id.train(df, languages=("big", "rare", "unseen"))  # no counts, no floor
    assert np.isneginf(none["floor"][:, none["names"].index("unseen")]).all() and np.isfinite(none["margin"]).all()


def test_language_evidence(spark):
    """A bare word takes the host's language; hosts lean on their suffix, suffixes on all rows."""
    en, de = "the quick brown fox and the lazy dog with this ", "der schnelle braune fuchs und der faule hund mit dem "
    rows = [(i, en * 5, "en", "a.example.com") for i in range(40)] + [(100 + i, de * 5, "de", "b.example.de") for i in range(40)] + [(200, "xy", None, "b.example.de"), (201, "xy", None, "a.example.com"), (202, "xy", None, "new.example.de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["language"] for r in lang_id.identify(df, lang_id.train(df)).collect()}
    assert got[200] == "de" and got[201] == "en" and got[202] == "de"


def plain_posteriors(rows, model):
    """The rule by plain Python over (text, declared, host, fold): posterior lists and verdicts."""
    names, L = model["names"], len(model["names"])
    suffix = lambda h: m[1] if (m := re.search(r"\.([A-Za-z]{2,})$", h or "")) else ""
    lik, post, mean = [], [], []
    for t, _, _, fold in rows:
        g = lang_id.ngrams(t) if t else np.zeros(0, int)
        ll = [float(sum(np.float64(model["logp"][fold][i][x]) for x in g)) for i in range(L)]
        own = [max(-lang_id.MOST_NATS, lang_id.TEMPER * (v - max(ll))) for v in ll]
        w = [math.exp(v) for v in own]
        letters = sum(c.isalpha() for c in t or "")
        lik.append(own)
        post.append([x / sum(w) for x in w] if letters >= lang_id.LEAST_LETTERS else [0.0] * L)
        mean.append((ll, len(g), letters))
    total = lambda keep: [sum(p[i] for p, r in zip(post, rows) if keep(r)) for i in range(L)]
    overall = total(lambda r: True)
    base = [(x + 1) / (sum(overall) + L) for x in overall]
    out = []
    for own, (ll, n, letters), (t, d, h, fold) in zip(lik, mean, rows):
        sv, hv, dv = total(lambda r: suffix(r[2]) == suffix(h)), total(lambda r: r[2] == h), total(lambda r: r[1] == d)
        sp = [(sv[i] + lang_id.SUFFIX_WEIGHT * base[i]) / (sum(sv) + lang_id.SUFFIX_WEIGHT) for i in range(L)]
        hp = [(hv[i] + lang_id.HOST_WEIGHT * sp[i]) / (sum(hv) + lang_id.HOST_WEIGHT) for i in range(L)]
        s = [own[i] + math.log(hp[i]) + math.log((dv[i] + 0.5) / (overall[i] + 2.0)) for i in range(L)]
        w = [math.exp(x - max(s)) for x in s]
        p = [x / sum(w) for x in w]
        i = p.index(max(p))
        floor = model["floor"][fold][i] - lang_id.FLOOR_DROP - model["margin"][fold][i] * lang_id.FLOOR_SPREADS / math.sqrt(max(1, n))
        out.append((names[i], max(p), letters >= lang_id.LEAST_LETTERS and max(p) >= lang_id.LEAST_POSTERIOR and ll[i] / max(1, n) >= floor))
    return out


def test_posteriors_by_hand(spark, docs):
    """Fifty rows with all kinds of evidence: every posterior and verdict follows the rule."""
    some = [r["text"][:600] for r in docs.sort("doc_id").limit(46).select("text").collect()] + ["xy", "", "ab ñ", "Съешь же ещё этих булок"]
    declared, hosts = ("en", "de", None, "fr", "es", "xx"), ("a.example.com", "b.example.de", None, "src1", "c.example.de")
    rows = [(i, t, declared[i % 6], hosts[i % 5]) for i, t in enumerate(some)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = lang_id.train(docs)
    folds = {r["doc_id"]: r["f"] for r in df.select("doc_id", lang_id.fold_of(F.col("text")).alias("f")).collect()}
    want = plain_posteriors([(t, d, h, folds[i]) for i, t, d, h in rows], model)
    got = {r["doc_id"]: r for r in lang_id.identify(df, model).collect()}
    for i, (name, p, kept) in enumerate(want):
        assert abs(got[i]["posterior"] - p) < 1e-6 and got[i]["kept"] == kept and (got[i]["language"] == name or p < 0.5 + 1e-6), i


def test_a_declaration_is_not_read_twice(spark):
    """The models that read a text never saw its own declaration: folds hold out each other."""
    rows = [(i, t, f"l{j}", "") for j in range(3) for i, t in enumerate(invented(j, 60), 1000 * j)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = lang_id.train(df)
    parts = [df.where(lang_id.fold_of(F.col("text")) == f) for f in range(lang_id.FOLDS)]
    for f, part in enumerate(parts):
        other = [r for g, p in enumerate(parts) if g != f for r in p.collect()]
        for i, name in enumerate(model["names"]):
            counts = sum(np.bincount(lang_id.ngrams(r["text"]), minlength=lang_id.BUCKETS) for r in other if r["lang"] == name)
            assert np.allclose(model["logp"][f][i], np.log((counts + lang_id.SMOOTH) / (counts.sum() + lang_id.SMOOTH * lang_id.BUCKETS)), atol=1e-5)
        assert part.count()


def test_page_evidence(spark):
    html = '<!DOCTYPE html><HTML class="x" lang=\'FR-ca\'><head><title>t</title></head><body><nav>menu</nav><!-- no --><article><p>Un <b>texte</b> &amp; plus</p><script>var x="<p>";</script></article></body></html>'
    df = spark.createDataFrame([(1, "https://WWW.Example.fr:80/a?b", html), (2, "nothing", "<p>bare</p>"), (3, None, None)], "page_id long, url string, html string")
    text, declared, host = lang_id.page_evidence(df)
    got = [tuple(r) for r in df.sort("page_id").select(F.trim(F.regexp_replace(text, " +", " ")), declared, host).collect()]
    assert got == [("Un texte plus", "fr", "www.example.fr"), ("bare", None, None), ("", None, None)]


def test_registered_language_query(spark, sf_dir):
    got = queries.op6_language_id(spark, sf_dir)
    docs, pages = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = got.collect()
    assert len(rows) == docs.count() + pages.count() and all((r["doc_id"] is None) != (r["page_id"] is None) for r in rows)
    assert np.mean([r["kept"] for r in rows]) > 0.95
    assert {r["declared_language"] for r in rows if r["page_id"] is not None} == {"en", "de", "fr", "es"}


def plain_score(text, model):
    """Forward-backward over both states of each word, one text at a time, then the document's logistic."""
    words, field = re.findall(r"\w+", text), model["field"]
    e = [math.exp(max(-30.0, min(30.0, float(np.float32(sum(field["weights"][i] for i in toxicity.features(w))))))) for w in words]
    a = np.exp(field["transition"])
    alpha, beta = [], [None] * len(words)
    for t, x in enumerate(e):
        v = np.array([1.0, math.exp(field["start"])]) if t == 0 else alpha[-1] @ a
        v = v * np.array([1.0, x])
        alpha.append(v / v.sum())
    for t in range(len(words) - 1, -1, -1):
        v = np.ones(2) if t == len(words) - 1 else a @ (np.array([1.0, e[t + 1]]) * beta[t + 1])
        beta[t] = v / v.sum()
    m = [(x * y)[1] / (x * y).sum() for x, y in zip(alpha, beta)]
    features = (max(m), math.log1p(sum(m)), min(1.0, 10 * sum(m) / len(m))) if m else (0.0, 0.0, 0.0)
    z = model["document"][0] + sum(w * f for w, f in zip(model["document"][1:], features))
    return 1 / (1 + math.exp(-z)), sum(x >= 0.5 for x in m)


def test_document_scores_by_plain_recursion(docs, labels):
    model = toxicity.train(docs, labels)
    some = docs.sort("doc_id").limit(40)
    texts = {r["doc_id"]: r["text"] or "" for r in some.collect()}
    for r in toxicity.score(some, model).collect():
        p, n = plain_score(texts[r["doc_id"]], model)
        assert abs(r["score"] - p) < 1e-6 and r["n_toxic"] == n


def test_toxicity_with_repeated_keys(spark):
    """One row of a key is learned from, its least text; of its labels the greatest holds."""
    made = [(i, "plain words only here " * 4 + ("nasty vile " * 2 if i % 3 == 0 else "")) for i in range(60)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in made], "doc_id long, toxic int")
    noisy = docs.unionByName(docs.select("doc_id", F.concat("text", F.lit("zzz")).alias("text"))).unionByName(docs)
    a, b = toxicity.train(docs, labels), toxicity.train(noisy, labels.unionByName(labels.withColumn("toxic", F.lit(0))))
    assert np.array_equal(a["field"]["weights"], b["field"]["weights"]) and np.array_equal(a["document"], b["document"])


# --- 7 quality ----------------------------------------------------------------------------


def plain_stats(t):
    words = re.findall("[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_text_stats(docs, odd, empty):
    texts = [r[0] or "" for r in docs.select("text").union(odd.select("text")).collect()] + ["a b c a b c", "a a a a", "a\na\n\n a\na", "x\x85y\u2028z w", "a b c d", "a|b <c> #"]
    for t in texts:
        assert quality_rules.text_stats(t)[:5] == (plain_stats(t) if plain_stats(t)[0] else (0,) * 5), t[:80]
    assert quality_rules.judge(odd, []).count() == odd.count() and quality_rules.judge(empty, []).count() == 0


def test_decision_list(spark, docs, labels, odd):
    rules = quality_rules.train(docs, labels)
    got = quality_rules.judge(docs, rules).collect()
    for r in got:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        hit = any(all(r[n] <= v if op == "<=" else r[n] > v for n, op, v in rule.literals) for rule in rules)
        assert r["base_failed"] == failed and r["kept"] == (not failed and not hit)
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality_rules.SHARES)))
    bad = (x[:, 0] > 0.8) | ((x[:, 3] <= 0.3) & (x[:, 4] > 0.6))
    learned = quality_rules.learn(x, bad)
    names = list(quality_rules.SHARES)
    said = np.zeros(600, bool)
    for rule in learned:
        said |= quality_rules._holds(x, [(names.index(n), op, v) for n, op, v in rule.literals])
    assert (said == bad).mean() > 0.95 and len(learned) <= 16
    assert quality_rules.learn(x, np.zeros(600, bool)) == []
    assert quality_rules.train(odd, labels.limit(0)) == []


# --- 8 PII --------------------------------------------------------------------------------


def plain_entities(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(sum(divmod(x * 2, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


PII = ["a@b@c.com", "x@a.b@c.d", "@a.b", "a@b", "me.you+1@mail-x.co.uk.", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256 001.02.3.4", "1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (017) 555-5036 ", "+12345", "+1((((((2", "ñé a_b@c.de🎉 10.0.0.1", "00000000000000", "+49 30 1234567-89. x", "9" * 30, "...@...", "a" * 2000 + "@b.c"]


def test_entities(docs):
    for t in PII + [r[0] or "" for r in docs.select("text").collect()]:
        assert pii.entities(t) == plain_entities(t), t[:100]


def test_revealing_terms(spark, odd, empty):
    name = "zorblatt"
    rows = [(i, f"{'filler words here ' * (i % 5)}contact {name} at boss@corp.example.com today number{'x' * i}") for i in range(6)]
    rows += [(100 + i, f"contact someone today about filler words here and the boss number{'y' * i} unique{'q' * i}") for i in range(3000)]
    rows += [(9000, f"the {name} is not mentioned with data"), (9001, None), (9002, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.spans(df).collect()}
    assert len(got) == len(rows)
    texts = dict(rows)
    terms = {texts[k][s["first"] : s["last"]] for k, v in got.items() for s in v if s["rank"] == 4}
    assert terms == {name}  # common neighbours reveal nothing
    # the same numbers by hand: 6 rows of the pair, 6 of the entity, 7 of the term
    assert 6 * 3008 / (6 * 7) > 2**8 and 6 / 7 >= 0.8
    assert [s["rank"] for s in got[0]] == [4, 0]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert clean[0].startswith("contact <TERM> at <EMAIL> today") and clean[9000] == "the <TERM> is not mentioned with data" and clean[9001] is None
    wide = pii.sanitise(odd)
    assert wide.columns == odd.columns and wide.count() == odd.count() and pii.sanitise(empty).count() == 0


def test_revealing_terms_far_from_the_entity(spark):
    """Whole texts count, mailboxes of one domain count together, all places of a term are marked."""
    far = " and so on with common words" * 20
    rows = [(i, f"zorblatt wrote{far} box{i}@corp.example.com and zorblatt signed") for i in range(8)]
    rows += [(50, "ask zorblatt or other@else.example.org"), (51, "zorblatt without data")]
    rows += [(100 + i, f"wrote and signed{far} ask other or without data number{'y' * i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    got = {r["doc_id"]: [s["first"] for s in r["spans"] if s["rank"] == 4] for r in pii.spans(df).collect()}
    assert got == {k: [m.start() for m in re.finditer("zorblatt", t)] for k, t in rows}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert clean[0] == f"<TERM> wrote{far} <EMAIL> and <TERM> signed" and clean[50] == "ask <TERM> or <EMAIL>" and clean[51] == "<TERM> without data"
    assert all(clean[k] == t for k, t in rows if k >= 100)


@pytest.mark.parametrize("kind, value", [("email", "box{}@mail{}.example.com"), ("ip", "10.{}.7.{}"), ("card", None), ("phone", "+1 202 555 0{:02}{}")])
def test_terms_beside_values_of_a_kind(spark, kind, value):
    """A label that stands beside different values of one kind is revealing; copies of one text are not."""

    def card(i):
        return next(c for c in (f"4111 1111 1111 {i:03}{d}" for d in range(10)) if pii.luhn(c.replace(" ", "")))

    made = [card(i) if kind == "card" else value.format(i, i) for i in range(6)]
    plain = "some common words of all the texts come first and then"
    rows = [(i, f"{plain} Kennwert {v} " + "and more of these words follow here") for i, v in enumerate(made)]
    rows += [(50 + i, f"{plain} einmalig one@single.example.net {'z' * i} and more of these words") for i in range(6)]  # one value only, in copies
    rows += [(100 + i, f"{plain} and more of these words follow here number{'y' * i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    found = {(texts[r["doc_id"]][s["first"] : s["last"]], pii.KINDS[s["rank"]]) for r in pii.spans(df, least_share=1.1).collect() for s in r["spans"]}
    assert {t for t, k in found if k == "term"} == {"Kennwert"}
    assert {v for v, k in found if k == kind} >= set(made)
    # by hand: all 6 places of the word, 6 of them beside the kind, among all places of terms
    places = sum(len(pii._TERM.findall(t)) for _, t in rows)
    beside = sum(len(pii.contexts_of(t, f, list(pii.terms_of(t, f)))) for t in texts.values() for f in [[e for e in pii.entities(t) if pii.KINDS[e[1]] == kind]])
    assert math.log2(1.0 / (beside / places)) >= pii.LEAST_BITS


def test_term_counts_lower_case_after_matching(spark):
    df = spark.createDataFrame([("İstanbul and istanbul ISTANBUL",), ("İstanbul",)], "text string")
    got = {r["term"]: (r["n"], r["places"]) for r in pii._term_counts(df, "text").collect()}
    assert got == {pii._hash("İstanbul".lower()): (2, 2), pii._hash("and"): (1, 1), pii._hash("istanbul"): (1, 2)}


def test_sanitised_overlaps(spark):
    df = spark.createDataFrame([("mail a@b.cd or +1 202 555 0101 99 🎉 1.2.3.4",)], "text string")
    t = df.first()["text"]
    s = [{"first": a, "rank": r, "last": b} for a, r, b in pii.entities(t)]
    rows = spark.createDataFrame([(t, [(x["first"], x["rank"], x["last"]) for x in s])], "text string, spans array<struct<first:int,rank:int,last:int>>")
    assert rows.select(pii.sanitised(F.col("text"), F.col("spans")).alias("x")).first()["x"] == "mail <EMAIL> or <PHONE> 🎉 <IP>"


# --- 9 SentencePiece ----------------------------------------------------------------------

ODD_TEXTS = ["", "  a  b ", "\n\t x", "é́ 日本語 🎉", "<s> </s> <0x41> <unk>", "a" * 5000, "▁x", " ", "​", "x\r\ny", "ﬁ ｆｕｌｌ ①"]


def test_parity_with_the_library(docs):
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    lib, coder = sentencepiece.SentencePieceProcessor(model_file=path), sp_codec.load(path)
    for t in ODD_TEXTS + [r[0] for r in docs.select("text").collect()]:
        ids = coder.encode(t, add_special_tokens=False).ids
        assert ids == lib.encode(t), t[:80]
        assert coder.decode(ids, skip_special_tokens=False) == lib.decode(ids)


def message(number, value):
    if isinstance(value, int):
        return bytes([number << 3 & 127 | (128 if number > 15 else 0), *([number >> 4] if number > 15 else []), value])
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    size = len(value)
    head = []
    while size > 127:
        head.append(size & 127 | 128)
        size >>= 7
    return bytes([number << 3 | 2, *head, size]) + value


@pytest.mark.parametrize("byte_fallback,extra", [(1, 1), (0, 0), (1, 0)])
def test_unigram_models(byte_fallback, extra):
    """A small unigram model written by hand, in both libraries."""
    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if byte_fallback:
        pieces += [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [(p, s, 1) for p, s in (("▁", -2.0), ("▁the", -3.0), ("▁th", -4.1), ("e", -3.3), ("t", -3.6), ("h", -3.7), ("c", -4.0), ("a", -3.9), ("at", -4.4), ("▁cat", -5.0), ("s", -3.2), ("▁a", -3.05), ("he", -4.2))]
    data = b"".join(message(1, message(1, p.encode()) + message(2, float(s)) + message(3, k)) for p, s, k in pieces)
    data += message(2, message(3, 1) + message(35, byte_fallback)) + message(3, message(1, b"identity") + message(3, 1) + message(4, extra) + message(5, 1))
    lib = sentencepiece.SentencePieceProcessor(model_proto=data)
    model = sp_codec.parse_model(data)
    assert model["type"] == 1 and model["byte_fallback"] == bool(byte_fallback) and model["extra_spaces"] == bool(extra)
    coder = sp_codec.build(model)
    for t in ["the cats", "that hat", "a  cat ", " the", "theses the the", "cat", "sat at the hat"] + (["cät", "日本 the"] if byte_fallback else ["czt the"]):
        assert coder.encode(t, add_special_tokens=False).ids == lib.encode(t), t


def test_codec_columns(odd, empty):
    path = public.path("piece_bpe_32k.model")
    rows = sp_codec.encode_column(odd, path, parity=True).collect()
    assert len(rows) == odd.count() and all(r["parity"] and r["round_trip"] for r in rows)
    assert [r["n_ids"] for r in rows if r["doc_id"] in (1, 2)] == [0, 0]
    back = sp_codec.decode_column(sp_codec.encode_column(odd, path), path).collect()
    assert sorted(r["text"] for r in back) == sorted(r["text"] or "" for r in odd.collect())
    assert sp_codec.encode_column(empty, path).count() == 0


def test_parity_of_every_row(spark, docs, sf_dir):
    rows = queries.op9_sentencepiece(spark, sf_dir).select("parity").collect()
    assert len(rows) == docs.count() and all(r["parity"] is True for r in rows)


def test_both_decoders_agree(docs, odd):
    path = public.path("piece_bpe_32k.model")
    coder = sp_codec.load(path)
    texts = [r[0] or "" for r in docs.select("text").limit(80).union(odd.select("text")).collect()] + [" two  spaces ", "▁mark", "日本語 ☃ \u0378", "a\nb\tc", "<s> </s> <unk> <0x41>", "  "]
    ids = [e.ids for e in coder.encode_batch(texts, add_special_tokens=False)] + [[], [0, 1, 2], [1, 300, 2], [3, 300, 200, 201], [29871], [29871, 29871]]
    assert sp_codec.decoder(path, coder)(ids) == coder.decode_batch(ids, skip_special_tokens=False)


def test_byte_pieces_need_no_library(docs, odd):
    """Line ends and rare characters are byte pieces in most texts; broken runs of them are the library's."""
    path = public.path("piece_bpe_32k.model")
    coder = sp_codec.load(path)
    texts = [r[0] or "" for r in docs.select("text").limit(80).union(odd.select("text")).collect()] + ["a\nb\tc", "☃\n\u0378 🎉🎉", "\n"]
    ids = [e.ids for e in coder.encode_batch(texts, add_special_tokens=False)]
    assert sp_codec.decoder(path, None)(ids) == texts
    broken = [[3 + 0xE2, 3 + 0x96], [3 + 0x0A, 3 + 0xE2, 300], [3 + 0x20, 3 + 0xE2, 3 + 0x96, 3 + 0x81], [300, 3 + 0xFF, 3 + 0x41, 301], [3 + 0xED, 3 + 0xA0, 3 + 0x80], [3 + 0xC0, 3 + 0x80]]
    assert sp_codec.decoder(path, coder)(broken) == coder.decode_batch(broken, skip_special_tokens=False)
