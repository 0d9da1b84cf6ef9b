"""Edges of single operators, held against plain Python written from their definitions."""

import math
import os
import subprocess
import sys
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docsheaf import config
from docsheaf.functions.text import exact_overlap, model_output_text, position_of_base_char, strip, without_marks
from docsheaf.operators import engines, geometry, jobs, kernels, merge, pages, profile, splitting, steps, validate
from docsheaf.sources import files
from docsheaf.streaming import jobs as job_stream


def one(df):
    return df.first()


def chunk_rows(spark, texts, columns=1):
    return spark.createDataFrame([(1, i, i // columns, i % columns, t) for i, t in enumerate(texts)], "doc_id long, index long, row long, col long, text string")


def plain_overlap(a, b, least=10):
    a, b = a[-500:], b[:500]
    return next((n for n in range(min(len(a), len(b)), least - 1, -1) if a[-n:] == b[:n]), 0)


def test_strip_takes_all_unicode_spaces(spark):
    for s in ("\t\x1c x y　\n", "\x85\xa0", "​z​", ""):
        assert one(spark.createDataFrame([(s,)], "t string").select(strip(F.col("t")).alias("r")))["r"] == s.strip()


@pytest.mark.parametrize(
    "a,b",
    [("hello wonderful world", "wonderful world again"), ("abcabcabcabcabc", "abcabcabcabcabcx"), ("short", "short"), ("x" * 600, "x" * 700), ("aaaaaaaaaab" * 3, "aaaaaaaaaabaaaaaaaaaac"), ("", "abc"), ("no overlap here at all", "something else entirely"), ("0123456789", "0123456789")],
)
def test_exact_overlap(spark, a, b):
    got = one(spark.createDataFrame([(a, b)], "a string, b string").select(exact_overlap(F.col("a"), F.col("b")).alias("n")))["n"]
    assert got == plain_overlap(a, b)


def test_merge_keeps_and_drops(spark):
    whole = "The quick brown fox jumps over the lazy dog and then sleeps for a long while under the tree."
    assert one(merge.merge_exact(chunk_rows(spark, [whole[:60], whole[40:]])))["merged"] == f"{whole[:60].strip()}\n\n{whole[60:].strip()}"
    # a chunk wholly contained in its predecessor disappears and is not the next one's predecessor
    assert one(merge.merge_exact(chunk_rows(spark, [whole, whole[-30:], "next part"])))["merged"] == f"{whole}\n\nnext part"
    # a blank chunk between neighbours
    assert one(merge.merge_exact(chunk_rows(spark, [whole[:60], " \n", whole[40:]])))["merged"] == f"{whole[:60].strip()}\n\n{whole[60:].strip()}"
    assert one(merge.merge_exact(chunk_rows(spark, ["  single \n"])))["merged"] == "single"


def test_rtl_cut_stops_after_the_last_base_character(spark):
    a, b = "كتاب جميل جدا", "كتَاب جميل جداً هنا"
    r = one(merge.merge_exact(chunk_rows(spark, [a, b]), rtl=True))["merged"]
    assert r == f"{a}\n\nً هنا"
    df = spark.createDataFrame([(b,)], "t string")
    assert one(df.select(without_marks(F.col("t")).alias("x")))["x"] == b.replace("َ", "").replace("ً", "")
    assert one(df.select(position_of_base_char(F.col("t"), F.lit(3)).alias("x")))["x"] == 4


def test_fuzzy_length():
    a, b = "one two three four five six seven eight nine ten", "one two three four five six seven eighx nine ten more"
    assert SequenceMatcher(None, a, b[: len(a)]).ratio() >= 0.95
    assert merge.fuzzy_length(a, b) == len(a)
    assert merge.fuzzy_length("a b", "a b") == 0 and merge.fuzzy_length("x y z w", "p q r s") == 0


def test_sections(spark):
    assert one(merge.sections(chunk_rows(spark, ["a", " ", "b", "c"]), columns=2))["text"] == "--- Section 1 ---\nb\n\n--- Section 2 ---\na\n\n--- Section 3 ---\nc"
    assert one(merge.sections(chunk_rows(spark, [" a ", ""])))["text"] == "a"


def test_model_output(spark):
    bar = "=" * 21
    cases = {f"{bar}\nBASE: 1\n{bar}\nline\n\nPATCHES: 2\nend\n{'=' * 15}save results:\nno": "line\n\nend", "plain": "", f"{bar}\n{bar}\na\n{bar}\nb": "a\nb", f"{'=' * 15}\n{bar}\n{bar}\nx": ""}
    for text, want in cases.items():
        assert one(spark.createDataFrame([(text,)], "t string").select(model_output_text(F.col("t")).alias("r")))["r"] == want


@pytest.mark.parametrize("w,h,want", [(1000, 1250, 125), (1000, 1350, 125), (1000, 1500, 125), (1000, 1300, 117), (1000, 1400, 120), (0, 500, 72), (9000, 9000, 600)])
def test_dpi_edges(spark, w, h, want):
    df = spark.createDataFrame([(w, h)], "w long, h long")
    assert one(df.select(geometry.estimated_dpi(F.col("w"), F.col("h")).alias("r")))["r"] == want


def test_split_limits_are_strict(spark):
    need = lambda w, h: one(spark.createDataFrame([(w, h)], "w long, h long").select(geometry.needs_splitting(F.col("w"), F.col("h"), 2.0, 2048).alias("r")))["r"]
    assert not need(2000, 1000) and need(2001, 1000) and not need(2048, 10) and need(10, 2049)


@settings(max_examples=15, deadline=None)
@given(st.integers(1, 5000), st.integers(1, 5000), st.integers(1, 4), st.integers(1, 4))
def test_tiles_cover_the_page(spark, w, h, rows, cols):
    df = spark.createDataFrame([(1, w, h, rows, cols)], "doc_id long, width long, height long, rows long, cols long")
    tiles = geometry.overlapping_tiles(df, 0.0).collect()
    assert sum(t["w"] * t["h"] for t in tiles) == w * h  # without overlap the tiles partition it
    wide = geometry.overlapping_tiles(df, 0.3).collect()
    assert min(t["x_offset"] for t in wide) == 0 and max(t["x_offset"] + t["w"] for t in wide) == w and max(t["y_offset"] + t["h"] for t in wide) == h


def test_file_checks(spark):
    limit = 50 * 1024 * 1024
    rows = [(0, "FFD8FF"), (limit, "FFD8FF"), (limit + 1, "FFD8FF"), (5, "52494646000000005745425000"), (5, "5249464600000000574542"), (5, "25504446"), (5, "255044462D"), (5, "424D"), (5, "")]
    df = spark.createDataFrame(rows, "n long, h string")
    got = [r["r"] for r in df.select(validate.check_file(F.col("n"), F.unhex("h"), "image", 50).alias("r")).collect()]
    assert got == ["File is empty", "ok", "File too large: 50.0MB (max 50MB)", "ok", "Unknown or unsupported file type", "Unknown or unsupported file type", "File type mismatch: expected image, detected pdf", "ok", "Unknown or unsupported file type"]


def test_names(spark):
    want = {"": "Filename cannot be empty", "a/b/c.png": "ok", "dir/": "ok", "/": "Invalid filename", "..": "Invalid filename pattern", ".x": "Invalid filename pattern", "a..b": "Invalid filename pattern", "x" * 255: "ok", "x" * 256: "Filename too long (max 255 characters)", None: "Filename cannot be empty"}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert [r["r"] for r in df.select(validate.check_name(F.col("t")).alias("r")).collect()] == list(want.values())


def plain_select(gaps, size, k):
    if len(gaps) <= k:
        return sorted(gaps)
    left, out = list(gaps), []
    for i in range(k):
        best = min(left, key=lambda g: abs(g - size / (k + 1) * (i + 1)))
        out.append(best)
        left.remove(best)
    return sorted(out)


@settings(max_examples=15, deadline=None)
@given(st.sets(st.integers(1, 999), max_size=12), st.integers(1, 4), st.integers(1, 300))
def test_split_choice(spark, gaps, k, least):
    g = sorted(gaps)
    df = spark.createDataFrame([(g, 1000)], "g array<bigint>, n long")
    r = one(df.select(profile.select_gaps(F.col("g"), F.col("n"), k).alias("s"), profile.by_min_size(F.col("g"), F.col("n"), least).alias("m")))
    assert r["s"] == plain_select(g, 1000, k)
    kept, prev = [], 0
    for s in g:
        if s - prev >= least and 1000 - s >= least:
            kept.append(s)
            prev = s
    assert r["m"] == kept


def test_runs_at_the_edges(spark):
    ink = [0] * 30 + [9] * 30 + [0] * 40 + [9] * 30 + [0] * 30  # the run that reaches the end is not closed
    df = spark.createDataFrame([(1, y, v) for y, v in enumerate(ink)], "doc_id long, y long, ink long")
    found = profile.runs(profile.smoothed(df)).collect()
    assert sorted((r["first"], r["width"]) for r in found) == [(0, 28), (62, 36)]
    assert [r["center"] for r in profile.gaps(profile.runs(profile.smoothed(df))).collect()] == [80]
    empty = spark.createDataFrame([(1, y, 0) for y in range(40)], "doc_id long, y long, ink long")
    assert profile.runs(profile.smoothed(empty)).count() == 0


def test_thresholds_of_steps(spark):
    c = config.GLOBAL_PREPROCESSING
    df = spark.createDataFrame([(1.0,), (1.01,), (-1.0,)], "skew double")
    flags = steps.flags(c, F.lit(0.1), F.col("skew"), F.lit(0.3))
    got = df.select(flags["needs_deskewing"].alias("a"), steps.rotates_page(c, F.col("skew")).alias("b"), flags["needs_denoising"].alias("n"), flags["needs_contrast"].alias("k")).collect()
    assert [tuple(r) for r in got] == [(False, True, False, False), (True, True, False, False), (False, True, False, False)]
    p = steps.StepPlan({"invert": F.lit(True)})
    p.add("mine", F.lit(True), 0)
    assert one(df.select(p.applied().alias("a")))["a"] == ["mine", "invert"] and p.remove("invert") and not p.remove("invert")


def test_config_ranges():
    with pytest.raises(ValueError):
        config.Splitting(overlap_percent=1.5)
    with pytest.raises(ValueError):
        config.Preprocessing(binarization_method="x")


def test_job_state(spark):
    s = 1_000_000
    rows = [(1, 1, 0, "processing", None, 300 * s), (2, 2, 0, "processing", None, 301 * s), (3, 3, 0, "failed", "E3", 9 * s), (3, 4, 5, "completed", None, 9 * s)]
    ev = spark.createDataFrame(rows, "job_id long, event_id long, us long, status string, error string, now_us long")
    got = {r["job_id"]: (r["status"], r["error"]) for r in jobs.swept(jobs.latest(ev)).collect()}
    assert got == {1: ("processing", None), 2: ("failed", jobs.STALE_ERROR), 3: ("completed", "E3")}
    state = jobs.latest(ev)
    assert not any(r["e"] for r in state.select(jobs.expired(state).alias("e")).collect())


def test_lock_winner(spark):
    m = 1_000_000
    df = spark.createDataFrame([("a", 1, 0, True), ("a", 2, 899 * m, True), ("a", 3, 900 * m, True), ("b", 4, 5, False)], "k string, event_id long, us long, locks boolean")
    assert [tuple(r) for r in jobs.lock_winners(df, "k").collect()] == [("a", 2, 3)]


def test_engines(spark):
    assert engines.ENGINES.names() == ["deepseek", "got", "qari"] and "got" in engines.ENGINES
    with pytest.raises(ValueError):
        engines.ENGINES.create("none")

    class Broken(engines.Engine):
        name = "broken"

        def extract(self, data):
            raise RuntimeError("no")

    c = chunk_rows(spark, ["a", "b"]).withColumn("data", F.encode("text", "UTF-8")).drop("text")
    assert [r["error"] for r in engines.recognise(c, Broken).collect()] == ["chunk 0: no", "chunk 1: no"]
    assert [(r["text"], r["error"]) for r in engines.recognise(c, Broken, swallow=True).collect()] == [("", None)] * 2


def test_page_source(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-one\ftwo")
    (tmp_path / "b.pdf").write_bytes(b"GIF89a")
    up = files.uploads(spark, str(tmp_path), "pdf")
    assert {r["name"]: r["check"] for r in up.collect()} == {"a.pdf": "ok", "b.pdf": "File type mismatch: expected pdf, detected image"}

    def render(data, zoom):
        if data.startswith(b"GIF"):
            raise ValueError("bad")
        return data.split(b"\f")

    got = files.pages(up, render, key="name").sort("name", "page_number").collect()
    assert [(r["page_name"], r["total_pages"], r["error"]) for r in got] == [("a.pdf_page_001.png", 2, None), ("a.pdf_page_002.png", 2, None), (None, 0, "Failed to convert: bad")]


def test_split_method(spark):
    df = spark.createDataFrame([([5], [], True), ([], [7], True), ([], [], True), ([5], [], False)], "p array<bigint>, c array<bigint>, n boolean")
    r = df.select(splitting.choose(F.col("n"), F.col("p"), F.col("c")).alias("m"), splitting.recommended(splitting.report(F.col("p"), F.col("c"))).alias("r")).collect()
    assert [x["m"] for x in r] == ["projection", "components", "grid", "none"] and [x["r"] for x in r] == ["projection", "components", "grid", "projection"]
    with pytest.raises(ValueError):
        splitting.by_name("x", F.lit(1), F.lit(1), F.lit(1))


def test_pixel_kernels():
    flat = np.full((12, 12), 7, np.uint8)
    assert kernels.laplacian_variance(flat) == 0 and kernels.noise_level(flat) == 0 and kernels.michelson(flat) == 0 and kernels.skew_angle(flat) == 0
    two = np.full((40, 60), 250, np.uint8)
    two[5:15, 5:15] = 10
    two[20:35, 30:55] = 12
    assert 12 <= kernels.otsu_threshold(two) < 250 and kernels.ink(two).sum() == 100 + 375
    assert [r[:4] for r in kernels.regions(two)] == [(1, 1, 18, 18), (26, 16, 33, 23)]
    assert set(np.unique(kernels.binarize_otsu(two))) == {0, 255} and (kernels.invert(kernels.invert(two)) == two).all()
    assert kernels.stretch(np.array([[10, 20], [30, 60]], np.uint8)).tolist() == [[0, 51], [102, 255]]
    assert kernels.rotate(two, 0.05) is two and kernels.rotate(two, 90).shape == (60, 40)
    assert kernels.resize(two, 120, 80).shape == (80, 120) and kernels.denoise(flat, 10).tolist() == flat.tolist()
    assert kernels.binarize_adaptive(two).shape == two.shape
    assert kernels.michelson(np.zeros((1, 1), np.uint8)) == 0.0 and kernels.analyse.__doc__
    diagonal = np.eye(4, dtype=bool)
    assert kernels.components(diagonal) == [(0, 0, 4, 4, 4)]
    assert len(kernels.components(np.array([[1, 0, 1], [1, 0, 1], [1, 1, 1]], bool))) == 1


def test_webhook_attempts():
    calls = []

    class Frame:
        def select(self, *a):
            return self

        def where(self, *a):
            return self

        def foreachPartition(self, f):
            f([{"webhook_url": "u", "payload": "p"}, {"webhook_url": "", "payload": "q"}])

    import docsheaf.streaming.jobs as m

    old, m.F = m.F, type("F", (), {"coalesce": staticmethod(lambda *a: ""), "lit": staticmethod(lambda x: x)})
    try:
        job_stream.deliver(lambda u, p: calls.append(u) or False)(Frame(), 0)
    finally:
        m.F = old
    assert calls == ["u"] * 3


# --- pages, settings, locks, files --------------------------------------------------------


def plain_page(r, prepare_by, split):
    """A page by the kernels alone, with plain Python for the choice of cuts."""
    g = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"])
    skew = kernels.skew_angle(g)
    turned = abs(skew) >= prepare_by.skew_threshold
    g = kernels.rotate(g, skew) if turned else g
    h, w = g.shape
    if not (w * h / 1e6 > split.max_megapixels or max(w, h) > split.max_dimension):
        cut, method = [(0, 0, 0, 0, w, h)], "none"
    else:
        e = min(split.target_chunk_size, split.max_dimension)
        least = math.ceil(math.sqrt(math.ceil(w * h / 1e6 / split.max_megapixels))) if w * h / 1e6 > split.max_megapixels else 1
        rows, cols = max(math.ceil(h / e), least), max(math.ceil(w / e), least)
        if split.prefer_horizontal_splits and cols > 1:
            rows, cols = (rows * cols, 1) if rows * cols <= 4 else (math.ceil(rows * cols / min(cols, 2)), min(cols, 2))
        ink = kernels.ink(g).sum(axis=1)
        top, low = int(ink.max()), []
        for y in range(h):
            s = int(ink[max(0, y - 2) : y + 3].sum())
            low.append(s < (1 - split.gap_threshold) * 5 * top if top else True)
        runs, y = [], 0
        while y < h:
            n = y
            while n < h and low[n]:
                n += 1
            if n > y and n < h:
                runs.append((y, n - y))
            y = max(n, y + 1)
        centers = [a + n // 2 for a, n in runs if n >= split.min_gap_pixels and (a + n // 2) * 10 > h and (a + n // 2) * 10 < h * 9]
        left, picked = list(centers), []
        if len(centers) > rows - 1:
            for i in range(1, rows):
                best = min(left, key=lambda c: (abs(c - h * float(i) / float(rows)), c), default=None)
                if best is not None:
                    left.remove(best)
                    picked.append(best)
        else:
            picked = centers
        splits, prev = [], 0
        for c in sorted(picked):
            if c - prev >= split.min_chunk_size and h - c >= split.min_chunk_size:
                splits.append(c)
                prev = c
        if splits:
            edges = [0, *splits, h]
            cut, method = [(i, 0, 0, a, w, b - a) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "projection"
        else:
            method, cut = "grid", []
            bh, bw = h / rows, w / cols
            oy, ox = int(bh * split.overlap_percent), int(bw * split.overlap_percent)
            for i in range(rows):
                for j in range(cols):
                    y0, y1 = max(0, int(i * bh) - (oy if i else 0)), min(h, int((i + 1) * bh) + (oy if i < rows - 1 else 0))
                    x0, x1 = max(0, int(j * bw) - (ox if j else 0)), min(w, int((j + 1) * bw) + (ox if j < cols - 1 else 0))
                    cut.append((i, j, x0, y0, x1 - x0, y1 - y0))
    done = [pages.prepare(g[y : y + ch, x : x + cw], prepare_by) for _, _, x, y, cw, ch in cut]
    texts = [(i, j, d.tobytes().decode("utf-8", "replace")) for (i, j, *_), (d, _) in zip(cut, done)]
    used = {s for _, names in done for s in names}
    applied = (["global_deskew"] if turned else []) + [s for s in steps.ORDER if s in used]
    return method, len(cut), ",".join(applied), merge.merged_text(texts)


@pytest.mark.parametrize("engine", ["deepseek", "small"])
def test_page_pipeline(spark, engine, monkeypatch):
    """Pages with bands of text, slanted lines and noise, under wide and narrow limits."""
    if engine == "small":
        limits = config.Splitting(max_megapixels=0.02, max_dimension=120, target_chunk_size=100, min_chunk_size=30, min_gap_pixels=8, overlap_percent=0.25)
        monkeypatch.setattr(config, "GLOBAL_SPLITTING", limits)
    split = config.GLOBAL_SPLITTING
    rng = np.random.default_rng(8)
    made = []
    for i in range(6):
        g = np.full((240, 150), 235, np.uint8)
        for y in range(12, 230, 46):
            g[y : y + (20 if i % 2 else 40)] = rng.integers(30, 90, (1, 150))
        if i == 4:
            g = rng.integers(0, 256, (240, 150)).astype(np.uint8)
        if i == 5:
            g = kernels.rotate(np.repeat(np.repeat(rng.integers(0, 2, (20, 1)) * 200 + 30, 12, 0), 150, 1).astype(np.uint8), -7)
        made.append((i, g.shape[0], g.shape[1], 1, bytearray(g.tobytes())))
    prepare_by = config.Preprocessing(denoise_strength=0)
    monkeypatch.setitem(config.ENGINE_PREPROCESSING, "deepseek", prepare_by)
    df = spark.createDataFrame(made, "doc_id long, height int, width int, channels int, data binary")
    got = {r["doc_id"]: (r["method"], r["n_chunks"], r["applied"], r["merged"]) for r in pages.process(df, "deepseek").collect()}
    want = {m[0]: plain_page(dict(zip(("doc_id", "height", "width", "channels", "data"), m)), prepare_by, split) for m in made}
    assert got == want
    assert {m for m, *_ in got.values()} == ({"none"} if engine == "deepseek" else {"projection", "grid"})
    assert all("binarization" in a for _, _, a, _ in got.values()) and any("global_deskew" in a for _, _, a, _ in got.values())


def test_a_page_is_read_once(spark):
    df = spark.createDataFrame([(1, 48, 64, 1, bytearray(b"x" * 48 * 64))], "doc_id long, height int, width int, channels int, data binary")
    ids = [r[0] for r in pages.process(df.union(df).union(df.selectExpr("null", "height", "width", "channels", "data")), "qari").select("doc_id").collect()]
    assert sorted(ids, key=str) == [1, 1, None]  # each page has its row
    for engine in ("qari", "got", "deepseek"):
        plan = pages.process(df, engine)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Aggregate" not in plan, engine


def test_pages_after_a_used_function(spark, tmp_path):
    """Functions go to executors by value: without those of the driver that hold its JVM, and without the package."""
    spark.createDataFrame([("a b c", "a b c")], "a string, b string").select(merge.fuzzy_overlap("a", "b")).collect()
    df = spark.createDataFrame([(1, 48, 64, 1, bytearray(b"x" * 48 * 64))], "doc_id long, height int, width int, channels int, data binary")
    assert pages.process(df, "qari").count() == 1
    (tmp_path / "f").write_bytes(cloudpickle.dumps((kernels.skew_angle, pages.cut, config.GLOBAL_SPLITTING)))
    code = "import pickle, numpy as np; f, cut, c = pickle.load(open('f', 'rb')); x = np.full((9, 150), 7, np.uint8); print(f(x), cut(x, c)[0])"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True).stdout.split() == ["0.0", "none"]


def test_a_failed_chunk_is_named():
    class Broken(engines.Engine):
        name = "broken"

        def extract(self, data):
            if data[0] == 7:
                raise ValueError("unreadable")
            return "text", "text", 0.0

    c, plain = config.GLOBAL_SPLITTING, config.Preprocessing(enabled=False)
    x = np.zeros((20, 10), np.uint8)
    x[10:] = 7
    places = [(0, 0, 0, 0, 10, 10), (1, 0, 0, 10, 10, 10)]
    assert pages.page_text(x, places, plain, Broken().ready()) == (None, "chunk 1: unreadable", set())
    assert pages.page_text(x[:10], places[:1], plain, Broken().ready()) == ("text", None, set())
    assert pages.cut(x, c) == ("none", [(0, 0, 0, 0, 10, 20)])


@pytest.mark.parametrize("wide", [False, True])
def test_cuts_as_the_column_operators(spark, wide):
    """Gaps, grids, split lines and tiles of a page in hand are those of the columns."""
    c = config.Splitting(max_megapixels=0.02, max_dimension=120, target_chunk_size=100, min_chunk_size=25, overlap_percent=0.3, prefer_horizontal_splits=wide)
    rng = np.random.default_rng(5)
    inks = [np.repeat(rng.integers(0, 3, 40) * rng.integers(0, 20, 40), rng.integers(1, 16, 40)) for _ in range(30)] + [np.zeros(90, int), np.full(200, 3)]
    sizes = [(len(x), int(rng.integers(40, 500))) for x in inks]
    rows = spark.createDataFrame([(i, y, int(v)) for i, x in enumerate(inks) for y, v in enumerate(x)], "doc_id long, y long, ink long")
    found = profile.gaps(profile.runs(profile.smoothed(rows), 0.05), 3).groupBy("doc_id").agg(F.array_sort(F.collect_list("center")).alias("g"))
    want = {r["doc_id"]: r["g"] for r in found.collect()}
    got = {i: pages.gaps(x, 0.05, 3) for i, x in enumerate(inks)}
    assert got == {i: want.get(i, []) for i in got} and sum(map(len, got.values())) > 60
    n_rows, n_cols = geometry.grid_size(F.col("width"), F.col("height"), c.target_chunk_size, c.max_dimension, c.max_megapixels, F.lit(wide))
    df = spark.createDataFrame([(i, h, w, got[i]) for i, (h, w) in enumerate(sizes)], "doc_id long, height long, width long, g array<long>").withColumns({"rows": n_rows, "cols": n_cols})
    split = profile.by_min_size(profile.select_nearest(F.col("g"), F.col("height"), F.col("rows") - 1), F.col("height"), c.min_chunk_size)
    for r in df.withColumn("s", split).collect():
        assert pages.grid(r["height"], r["width"], c) == (r["rows"], r["cols"])
        assert pages.splits(r["g"], r["height"], r["rows"] - 1, c.min_chunk_size) == r["s"]
    by_page = {}
    for r in geometry.overlapping_tiles(df, c.overlap_percent).orderBy("doc_id", "index").collect():
        by_page.setdefault(r["doc_id"], []).append(tuple(r[n] for n in ("row", "col", "x_offset", "y_offset", "w", "h")))
    assert by_page == {i: pages.tiles(h, w, *pages.grid(h, w, c), c.overlap_percent) for i, (h, w) in enumerate(sizes)}


def plain_skew(g):
    ys, xs = np.nonzero(kernels.edges(g))
    found = []
    for k in range(180):
        t = np.deg2rad(k)
        d = np.rint(xs * np.cos(t) + ys * np.sin(t)).astype(int)
        found += [(-int(n), k) for n in np.unique(d, return_counts=True)[1] if n > 100]
    angles = [k - 90.0 for _, k in sorted(found)[:50] if 45 < k < 135]
    return float(np.median(angles)) if angles else 0.0


def test_skew_and_its_bound(monkeypatch):
    rng = np.random.default_rng(11)
    found = []
    for i in range(24):
        g = np.repeat(np.repeat(rng.integers(0, 2, (20, 1)) * 200 + 30, 8, 0), int(rng.integers(66, 240)), 1).astype(np.uint8)
        g = kernels.rotate(g, float(rng.uniform(-50, 50)) if i % 3 else 0.0)
        found.append(kernels.skew_angle(g))
        assert found[-1] == plain_skew(g)
    assert sum(x != 0 for x in found) > 5
    for w in (1, 2, 30, 64, 71, 140):  # no line on a page of nothing but edges has more pixels
        ys, xs = (v.ravel() for v in np.mgrid[: 2 * w + 9, :w])
        lines = [np.bincount(d - d.min()).max() for d in (np.rint(xs * np.cos(t) + ys * np.sin(t)).astype(int) for t in np.deg2rad(range(46, 135)))]
        assert max(lines) <= kernels.longest_line(w) <= max(lines) + 2
    monkeypatch.setattr(kernels, "edges", None)  # a page too narrow for 100 votes needs no edges
    assert kernels.skew_angle(rng.integers(0, 256, (400, 64)).astype(np.uint8)) == 0.0


def test_noise_level_by_definition():
    rng = np.random.default_rng(12)
    for h, w in ((1, 1), (2, 9), (5, 4), (48, 64), (33, 7)):
        g = rng.integers(90, 90 + 30 * h, (h, w)).clip(0, 255).astype(np.uint8)
        p = kernels._padded(g.astype(float), 2)
        boxes = [p[y : y + 5, x : x + 5].std() for y in range(h) for x in range(w)]
        assert kernels.noise_level(g) == pytest.approx(min(1.0, np.median(boxes) / 50), abs=1e-9)


def test_settings_from_the_environment(spark):
    env = config.dotenv("# limits\nSPLITTING_MAX_MEGAPIXELS=3.5\nexport SPLITTING_ENABLED='no'\n\nOTHER=1\nbroken")
    found = config.loaded(config.Splitting, "SPLITTING", env=env)
    assert found == config.Splitting(max_megapixels=3.5, enabled=False)
    spark.conf.set("spark.docsheaf.splitting.max_dimension", "999")
    assert config.loaded(config.Splitting, "SPLITTING", spark, env).max_dimension == 999
    spark.conf.unset("spark.docsheaf.splitting.max_dimension")
    assert config.loaded(config.Splitting, "SPLITTING", env={}) == config.Splitting()
    for bad in ({"SPLITTING_MAX_DIMENSION": "many"}, {"SPLITTING_OVERLAP_PERCENT": "2"}, {"SPLITTING_ENABLED": "perhaps"}):
        with pytest.raises(ValueError):
            config.loaded(config.Splitting, "SPLITTING", env=bad)


def test_locks_and_switches(spark):
    tries = [(1, 10, 100, True), (1, 11, 200, True), (1, 12, 100 + 900_000_000, True), (2, 13, 5, True), (2, 14, 6, False), (None, 15, 1, True), (None, 16, 2, True)]
    df = spark.createDataFrame(tries, "user_id long, event_id long, us long, locks boolean").repartition(3)
    assert {tuple(r) for r in jobs.lock_winners(df, "user_id").collect()} == {(1, 2, 12), (2, 1, 13), (None, 1, 15)}
    held = spark.createDataFrame([("a", "x"), ("b", "y")], "model string, holder string")
    asked = spark.createDataFrame([("a", "other"), ("b", "y"), ("b", "y")], "model string, holder string")
    assert [tuple(r) for r in jobs.released(held, asked).collect()] == [("a", "x")]
    models = spark.createDataFrame([("qari", "ready"), ("got", "loading")], "model string, status string")
    want = {1: "switched", 2: "timeout", 3: "not_ready", 4: "unknown"}
    requests = spark.createDataFrame([(1, "qari", 30.0), (2, "qari", 30.5), (3, "got", 0.0), (4, "zzz", 0.0)], "request_id long, model string, busy_s double")
    assert {r["request_id"]: r["outcome"] for r in jobs.switches(requests, models).collect()} == want


def test_files_in_and_out(spark, tmp_path):
    good = bytes.fromhex("89504e470d0a1a0a0000000d4948445200000001000000010802000000907753de0000000c49444154789c63f8cfc0000003010100c9fe92ef0000000049454e44ae426082")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(good)
    (tmp_path / "in" / "b.png").write_bytes(good[:30])
    pictures = files.images(spark, str(tmp_path / "in"))
    found = {r["origin"].rpartition("/")[2]: (r["height"], r["error"]) for r in pictures.collect()}
    assert found == {"a.png": (1, None), "b.png": (None, "Invalid or corrupted image file")}
    up = files.uploads(spark, str(tmp_path / "in"))
    checked = files.decodable(up, pictures)
    assert checked.columns == up.columns
    assert {r["name"]: r["check"] for r in checked.collect()} == {"a.png": "ok", "b.png": "Invalid or corrupted image file"}
    texts = spark.createDataFrame([("scan", "one\ntwo"), ("page 2", None)], "stem string, text string")
    files.write_texts(texts, str(tmp_path / "out"))
    back = {r["file"]: r["value"] for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect()}
    assert {k: v.rstrip("\n") for k, v in back.items()} == {"scan_ocr.txt": "one\ntwo", "page 2_ocr.txt": ""}

    def read(data):
        if data == b"bad":
            raise ValueError("no such format")
        return {"page_count": len(data), "title": "T"}

    docs = spark.createDataFrame([(1, bytearray(b"abc")), (2, bytearray(b"bad")), (3, None)], "doc_id long, content binary")
    told = {r["doc_id"]: (r["page_count"], r["title"], r["author"], r["error"]) for r in files.metadata(docs, read).collect()}
    assert told == {1: (3, "T", None, None), 2: (0, None, None, "no such format"), 3: (0, "T", None, None)}


def test_engines_load_before_they_read():
    e = engines.ENGINES.create("got")
    with pytest.raises(RuntimeError, match="not loaded"):
        e.read(b"x")
    assert e.ready().read(b"x") == ("x", "$ x", 0.0) and e.ready() is e


def test_enqueued_jobs_carry_their_time(spark, tmp_path):
    rows = spark.createDataFrame([(1, "qari", 3), (2, "got", None)], "job_id long, engine string, pages int")
    jobs.enqueue(rows, str(tmp_path / "queue"))
    jobs.enqueue(rows.limit(1), str(tmp_path / "queue"))
    got = sorted((r["job_id"], r["timeout_s"]) for r in spark.read.json(str(tmp_path / "queue")).collect())
    assert got == [(1, 3600), (1, 3600), (2, 1200)]
