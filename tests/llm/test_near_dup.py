"""Near duplicates and the pipeline against brute force."""

import os
import random
import time
import zlib
from collections import Counter, defaultdict
from itertools import takewhile

import corpus_pipeline
import numpy as np
import public_tokenizers as public
import pytest
from docsheaf.llm import lang_id, near_dup, packing, pii, quality_rules
from tokenizers import Tokenizer


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance():
    random.seed(5)
    for _ in range(400):
        a = [random.randrange(4) for _ in range(random.randrange(14))]
        b = list(a)
        for _ in range(random.randrange(6)):
            k = random.randrange(len(b) + 1)
            b[k : k + random.randrange(2)] = [random.randrange(4)] * random.randrange(2)
        d = plain_distance(a, b)
        for limit in range(8):
            assert near_dup.edit_distance(a, b, limit) == (d if d <= limit else None), (a, b, limit)


def test_edit_distance_of_long_texts():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 3000, 20_000, dtype=np.uint32)
    b = a.copy()
    at = np.sort(rng.choice(20_000, 3000, replace=False))
    b[at] = rng.integers(5000, 9000, 3000)
    began = time.time()
    assert near_dup.edit_distance(a, b, 4000) == 3000
    assert near_dup.edit_distance(a, rng.permutation(a), 4000) is None
    assert near_dup.edit_distance(a, np.concatenate([a[500:], b[:400]]), 4000) == 900
    assert time.time() - began < 20


def bound_holds(a, b):
    """Shared words (with repeats) leave room for an edit similarity of 0.8."""
    longer = max(len(a), len(b))
    return longer - sum((Counter(a) & Counter(b)).values()) <= int(longer * 0.2 + 1e-9)


def similar_pairs(words, pairs):
    """Of index pairs those with an edit similarity of 0.8 or more."""
    for i, j in pairs:
        a, b = words[i], words[j]
        longer = max(len(a), len(b))
        if a and b and min(len(a), len(b)) >= 0.8 * longer - 1e-9 and bound_holds(a, b) and near_dup.aligned(near_dup.word_hashes(a), near_dup.word_hashes(b)):
            yield i, j


def plain_classes(rows):
    """Least key of each component over all pairs that share a sketch and are similar, or are equal."""
    keys, words = [r[0] for r in rows], [near_dup.words_of(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def unite(i, j):
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)

    same, posting, pairs = {}, defaultdict(list), set()
    for i, w in enumerate(words):
        if (first := same.setdefault(tuple(w), i)) != i:
            unite(first, i)
            continue
        for x in near_dup.sketch(near_dup.kmers(near_dup.word_hashes(w))).tolist():
            pairs |= {(j, i) for j in posting[x]}
            posting[x].append(i)
    for i, j in similar_pairs(words, pairs):
        unite(i, j)
    least = {}
    for i, k in enumerate(keys):
        r = root(i)
        least[r] = k if r not in least else min(least[r], k, key=lambda v: (v is None, v))
    return [least[root(i)] for i in range(len(keys))]


@pytest.fixture(scope="module")
def family():
    """Copies with their own edits, copies of copies, exact copies, a hub text and plain texts."""
    random.seed(11)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(160)]
    texts = []
    for n in (0, 1, 1, 2, 2, 3, 4, 6, 9, 12, 20) * 4:
        t = list(base)
        for _ in range(n):
            t[random.randrange(len(t))] = word()
        texts.append(t)
    chain = list(base)
    for _ in range(12):
        chain = list(chain)
        chain[random.randrange(len(chain))] = word()
        texts.append(chain)
    # one passage is most of each text: they share sketches and are not alike
    for _ in range(40):
        texts.append(base[:60] + [word() for _ in range(random.randrange(18, 30))])
    texts += [texts[3]] * 5 + [[word() for _ in range(random.randrange(1, 60))] for _ in range(60)] + [base[:100] + base[100:160][::-1]]
    return [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, ""), (901, None), (902, " \n"), (903, "one two"), (904, "One  TWO")]


@pytest.mark.parametrize("block, most_words", [(1024, 10**6), (7, 700)])
def test_classes_by_brute_force(spark, family, block, most_words):
    df = spark.createDataFrame(family, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(df, block=block, most_words=most_words).collect()}
    want = dict(zip([k for k, _ in family], plain_classes(family)))
    assert got == want
    if block == 7:
        kept = near_dup.representatives(df, block=block, most_words=most_words).collect()
        assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values()))


def test_recall_against_all_pairs(spark):
    """Every pair of different texts with an edit similarity of 0.8 or more, sketches aside."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    df = spark.read.parquet(path)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    words = [near_dup.words_of(t) for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: len(words[i]))
    within = ((i, j) for n, i in enumerate(order) for j in takewhile(lambda j: len(words[i]) >= 0.8 * len(words[j]) - 1e-9, order[n + 1 :]) if words[i] != words[j])
    true = list(similar_pairs(words, within))
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(df).collect()}
    assert len(true) > 50
    assert np.mean([got[rows[i][0]] == got[rows[j][0]] for i, j in true]) >= 0.98


def test_short_texts_with_one_edit(spark):
    words = [f"w{i}" for i in range(46)]
    rows = [(0, words[:40]), (1, [*words[:19], "x", *words[20:40]]), (2, [f"v{i}" for i in range(46)]), (3, [f"v{i}" for i in range(46) if i != 30])]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2}


def test_one_large_group_of_near_copies(spark):
    """Many copies of one text; each has its own edit."""
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*words[: i % 120], f"e{i}", *words[i % 120 + 1 :]])) for i in range(400)]
    got = near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert {(r["class_id"], r["class_rows"]) for r in got} == {(0, len(rows))}


def test_clashing_names_and_repeated_keys(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "a", 1, 2), (1, text, "a", 1, 2), (1, text + " more", "b", 3, 4), (None, text, "c", 5, 6), (2, None, "d", 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __tk string, text_key int, _gone_key int")
    kept = near_dup.representatives(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, text if near_dup_first(spark, text) else text + " more"), (2, None)], key=str)


def near_dup_first(spark, text):
    """Whether of two rows of one key the shorter text has the lesser hash, which decides."""
    a, b = spark.createDataFrame([(text,), (text + " more",)], "text string").select(near_dup.text_key("text").alias("k")).collect()
    return a["k"] < b["k"]


def test_classes_of_documents(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["class_id"], r["class_rows"]) for r in near_dup.classes(docs).collect()}
    want = dict(zip([k for k, _ in rows], plain_classes(rows)))
    assert {k: v[0] for k, v in got.items()} == want
    assert all(v[1] == sum(c == v[0] for c in want.values()) for v in got.values())


def test_odd_rows(odd, empty):
    got = near_dup.classes(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["class_id"], r["class_rows"]))
    assert by[1] == by[2] == by[3] == {(1, 3)} and by[5] == by[6] == {(5, 3)} and by[4] == {(4, 1)}
    kept = near_dup.representatives(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 7, 8, 9]
    assert near_dup.classes(empty).count() == 0 and near_dup.representatives(empty).count() == 0


def test_sketches_keep_text_order():
    words = [f"w{i}" for i in range(40)]
    turned = words[20:] + words[:20]
    a, b = (near_dup.kmers(near_dup.word_hashes(w)) for w in (words, turned))
    shared = set(a.tolist()) & set(b.tolist())
    assert len(shared) > 25  # as sets they are close, in order they are not
    assert np.mean(near_dup.sketch(a) == near_dup.sketch(b)) < 0.5
    assert (near_dup.sketch(a) == near_dup.sketch(a.copy())).all() and len(near_dup.sketch(a[:0])) == 0
    # an occurrence number tells repeats apart
    assert near_dup._occurrences(np.array([5, 7, 5, 5, 7], np.uint64)).tolist() == [0, 0, 1, 2, 1]


def test_pipeline_stages(spark, docs, sf_dir, odd):
    """Each stage's rows against the plain rule on its own input; columns stay."""
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in now.collect()}
        now = stage(spark, now, sf_dir).cache()
        after = {r["doc_id"]: r for r in now.collect()}
        assert now.columns == docs.columns and set(after) <= set(before), name
        if name == "language_id":
            verdicts = {r["doc_id"]: r["kept"] for r in lang_id.identify(docs, lang_id.train(docs)).collect()}
            assert len(after) >= 0.98 * len(before) and set(after) == {k for k, kept in verdicts.items() if kept}
        if name == "quality_rules":
            for k, r in before.items():
                n, _, _, _, repeat = quality_rules.text_stats(r["text"])[:5]
                if n < 50 or repeat * 100 > n * 50:
                    assert k not in after
        if name == "near_duplicates":
            rows = [(k, r["text"]) for k, r in sorted(before.items())]
            assert set(after) == set(plain_classes(rows))
        if name == "pii":
            assert set(after) == set(before)
            for k, r in after.items():
                found = pii.entities(before[k]["text"])
                assert (r["text"] == before[k]["text"]) if not found else ("<" in r["text"] and r["n_chars"] == len(r["text"]))
                assert not [e for e in pii.entities(r["text"])]
    last = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
    coder = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in last.collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for r in now.collect():  # every id of every text lies in exactly one piece
        ids, at = np.array([*coder.encode(r["text"], add_special_tokens=False).ids, packing.END_ID], "<u4"), 0
        for start, length, crc, total in sorted(pieces[r["doc_id"]]):
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in now.collect()}
    assert max(r["s"] for r in last.groupBy("sequence_id").agg({"length": "sum"}).toDF("id", "s").collect()) <= packing.WINDOW
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, sf_dir).count() <= 10 * odd.count() + 200
        assert stage(spark, odd.limit(0), sf_dir).count() == 0


def test_sizes_at_the_threshold_meet(spark):
    """Sizes of exactly 4 to 5 share a unit of work in a family larger than a block."""
    pairs = [(3820, 4775), (7456, 9320), (11644, 14555)]
    rows = [(i, 0, 10 * i + j, size, 0) for i, p in enumerate(pairs) for j, size in enumerate(p)]
    units = {}
    for r in near_dup._units(spark.createDataFrame(rows, "bucket long, f int, node long, size long, label long"), 1, 10**6).collect():
        units.setdefault(r["node"], set()).add(r["unit"])
    assert all(units[10 * i] & units[10 * i + 1] for i in range(len(pairs)))
