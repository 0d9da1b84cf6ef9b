"""Registered queries answer for every row of their table, held against plain Python.

Where a query has a SQL twin, both agree on every row of it.
"""

import difflib
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from docsheaf.operators import jobs
from docsheaf.plans import catalogue
from docsheaf.plans.catalogue import QUERIES
from docsheaf.plans.oracle import ORACLE_SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return c


def plain_profile(doc_id, text):
    out = [0] * 20
    for n, line in enumerate(text.split("\n")):
        out += [len("".join(line.split()))] * 12 + [0] * (4 + (n * 7 + doc_id) % 30)
    return out


def plain_splits(ink, k=2, least=64):
    size, lines = len(ink), {}
    for y, v in enumerate(ink):
        if v:
            lines.setdefault((y - 20) // 16, []).append(y)
    if not lines:
        return None
    taken = {y for ys in lines.values() for y in range(max(0, ys[0] - 5), ys[-1] + 6)}
    free, out = [y for y in range(size) if y not in taken], []
    for i in range(1, k + 1):
        ideal = int(size / (k + 1) * i)
        best = min(free, key=lambda y: (abs(y - ideal), y), default=None)
        if best is not None and abs(best - ideal) < size / (k + 1) * 0.5 and least <= best <= size - least and all(abs(best - s) >= least for s in out):
            out.append(best)
    return ",".join(map(str, sorted(out)))


def test_component_splits_of_tall_pages(spark, duck, sf_dir):
    got = {r["doc_id"]: r["splits"] for r in QUERIES["component_splits"](spark, sf_dir).collect()}
    ink = {i: plain_profile(i, t) for i, t in duck.sql("select doc_id, text from documents").fetchall()}
    want = {i: s for i, p in ink.items() if (s := plain_splits(p)) is not None}
    assert any(len(ink[i]) > 600 and s for i, s in want.items())
    assert got == want
    twin = duck.sql(ORACLE_SQL["component_splits"]).fetchall()
    assert twin and all(got[i] == s for i, s in twin)


def test_col_projection_of_all_positions(spark, duck, sf_dir):
    got = {(r["doc_id"], r["x"]): r["v"] for r in QUERIES["col_projection"](spark, sf_dir).collect()}
    want = {(i, x) for i, t in duck.sql("select doc_id, text from documents").fetchall() for x in range(len(plain_profile(i, t)))}
    assert set(got) == want
    twin = duck.sql(ORACLE_SQL["col_projection"]).fetchall()
    assert twin and all(abs(got[i, x] - v) < 1e-9 for i, x, v in twin)


def test_webhook_payload_of_all_jobs(spark, duck, sf_dir):
    got = {r["job_id"]: r["payload"] for r in QUERIES["webhook_payload"](spark, sf_dir).collect()}
    last = QUERIES["job_latest_state"](spark, sf_dir).where("status in ('completed', 'failed')").collect()
    assert set(got) == {r["job_id"] for r in last} and any(k % 2 for k in got)
    for r in last:
        said = json.loads(got[r["job_id"]])
        assert (said["job_id"], said["status"], said["error"]) == (str(r["job_id"]), r["status"], r["error"])
    twin = duck.sql(ORACLE_SQL["webhook_payload"]).fetchall()
    assert twin and all(got[k] == v for k, v in twin)


def test_pixels_of_the_whole_text(spark, duck, sf_dir):
    got = {r["doc_id"]: r for r in QUERIES["pixel_statistics"](spark, sf_dir).collect()}
    metrics = {r["doc_id"]: r for r in QUERIES["image_metrics"](spark, sf_dir).collect()}
    texts = dict(duck.sql("select doc_id, text from documents").fetchall())
    assert set(got) == set(metrics) == set(texts) and max(map(len, texts.values())) > 3072
    for i, t in texts.items():
        v = [ord(c) if " " <= c <= "~" else ord("~") for c in t]
        v += [32] * (max(48, -(-len(t) // 64)) * 64 - len(v))
        r = got[i]
        assert abs(r["brightness"] - sum(v) / len(v) / 255) < 2e-6 and abs(r["inverted_mean"] - (255 - sum(v) / len(v))) < 2e-6
        assert abs(r["contrast"] - (max(v) - min(v)) / (max(v) + min(v))) < 2e-6 and r["n_values"] == len(set(v))
        assert abs(metrics[i]["brightness"] - sum(v) / len(v) / 255) < 2e-6
    twin = duck.sql(ORACLE_SQL["pixel_statistics"] + " WHERE doc_id IN (SELECT doc_id FROM documents WHERE length(text) <= 3072)").fetchall()
    assert twin and all((got[i]["contrast"], got[i]["brightness"], got[i]["inverted_mean"], got[i]["n_values"]) == tuple(x) for i, *x in twin)


MARKS = {chr(i) for i in (*range(0x064B, 0x0660), 0x0670)}


def plain_merge(chunks, rtl=False):
    """Chunk texts by the rules of the merge, each length tried in turn; also the kinds of overlap met."""
    bare = lambda t: "".join(c for c in t if not (rtl and c in MARKS))
    out, prev, met = [], "", set()
    for t in (c.strip() for c in chunks):
        if not t:
            continue
        rest = t
        if prev:
            a, b = bare(prev[-500:]), bare(t[:500])
            n = next((k for k in range(min(len(a), len(b)), 9, -1) if a[-k:] == b[:k]), 0)
            kind = "exact"
            if not n:
                x, y, kind = a.split(), b.split(), "fuzzy"
                for k in range(min(len(x), len(y), 10) if min(len(x), len(y)) >= 3 else 0, 2, -1):
                    p, q = " ".join(x[-k:]), " ".join(y[:k])
                    if difflib.SequenceMatcher(None, p, q).ratio() >= 0.95 and sum(u == v for u, v in zip(x[-k:], y)) >= 0.8 * k:
                        n = len(q)
                        break
            if n:
                met.add(kind)
                seen = at = 0
                while at < len(t) and seen < n:
                    seen += not (rtl and t[at] in MARKS)
                    at += 1
                rest = t[at:].strip()
        if rest:
            out.append(rest)
            prev = t
    return "\n\n".join(out).strip(), met


@pytest.mark.parametrize("name, rtl", [("merge_fuzzy_overlap", False), ("merge_fuzzy_overlap_rtl", True)])
def test_merge_with_an_edited_overlap(spark, sf_dir, name, rtl):
    chunks = {}
    for r in catalogue.edited_chunks(spark, sf_dir, rtl).sort("doc_id", "index").collect():
        chunks.setdefault(r["doc_id"], []).append(r["text"])
    want = {i: plain_merge(c, rtl) for i, c in chunks.items()}
    assert {k for _, met in want.values() for k in met} == {"fuzzy"} | ({"exact"} if any("exact" in m for _, m in want.values()) else set())
    assert sum("fuzzy" in met for _, met in want.values()) > 50
    got = {r["doc_id"]: r["merged"] for r in QUERIES[name](spark, sf_dir).collect()}
    assert got == {i: t for i, (t, _) in want.items()}


def test_payload_escapes_control_characters(spark):
    df = spark.createDataFrame([(1, "failed", "a\nb.png", 'line one\nline "two"\t\x01')], "job_id long, status string, name string, error string")
    said = df.select(jobs.webhook_payload(F.col("job_id"), F.col("status"), F.col("name"), F.col("error")).alias("p")).first()["p"]
    assert json.loads(said) == {"job_id": "1", "status": "failed", "filename": "a\nb.png", "result": None, "error": 'line one\nline "two"\t\x01'}
