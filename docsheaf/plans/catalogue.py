"""The registered queries and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsheaf import config
from docsheaf.functions.text import model_output_text, without_marks
from docsheaf.operators import engines, jobs, kernels, merge, pages, profile, splitting, steps, validate
from docsheaf.operators import geometry as geo
from docsheaf.plans.oracle import ORACLE_SQL  # noqa: F401
from docsheaf.sources import files
from docsheaf.sources import fixtures as fx
from docsheaf.streaming import jobs as job_stream

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


GLOBAL = config.GLOBAL_SPLITTING
QARI = config.ENGINE_SPLITTING["qari"]


def wh():
    return F.col("width"), F.col("height")


# --- text merge ---------------------------------------------------------------------------


@query
def merge_exact_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return merge.merge_exact(fx.chunk_text(spark, sf))


@query
def merge_two_columns(spark, sf):
    return merge.merge_exact(fx.chunk_text(spark, sf, 2))


@query
def reading_order_ltr(spark, sf):
    return merge.formatted(fx.chunk_text(spark, sf, 2))


@query
def reading_order_rtl(spark, sf):
    return merge.formatted(fx.chunk_text(spark, sf, 2), rtl=True)


@query
def adjacent_pairs(spark, sf):
    return merge.adjacency(fx.chunk_text(spark, sf, 2))


@query
def chunk_concat(spark, sf):
    return merge.concat(fx.chunk_text(spark, sf))


@query
def section_merge(spark, sf):
    return merge.sections(fx.chunk_text(spark, sf))


@query
def section_merge_rtl(spark, sf):
    return merge.sections(fx.chunk_text(spark, sf), columns=2)


@query
def pdf_page_merge(spark, sf):
    return merge.pages(fx.pdf_pages(spark, sf))


@query
def infer_output_parse(spark, sf):
    bar = F.lit("=" * 21)
    p = fx.pdf_pages(spark, sf).withColumn("k", F.col("job_id") % 3)
    head = F.concat(bar, F.lit("\nBASE:  torch.Size([1])\nPATCHES:  torch.Size([2])\n"))
    out = F.when(F.col("k") == 0, F.col("text")).otherwise(F.concat(head, bar, F.lit("\n"), F.col("text"), F.lit("\nPATCHES: x\n\nlast line\n"), F.when(F.col("k") == 1, "=" * 15 + "save results:" + "=" * 15 + "\nignored").otherwise(F.concat(bar, F.lit("\nmore")))))
    return p.select("job_id", "page_number", model_output_text(out).alias("parsed"))


@query
def fuzzy_overlap(spark, sf):
    c = fx.chunk_text(spark, sf)
    # one changed letter in the shared part, so that only the fuzzy test finds it
    nxt = c.select("doc_id", (F.col("index") - 1).alias("index"), F.concat(F.substring("text", 1, 12), F.lit("#"), F.substring("text", 14, 600)).alias("after"))
    tail = F.right("text", F.lit(120))
    return c.join(nxt, ["doc_id", "index"]).select("doc_id", "index", merge.fuzzy_overlap(tail, "after").alias("cut"))


def edited_chunks(spark, sf, rtl: bool = False) -> DataFrame:
    """Chunks of whole words that share some words with the chunk before, one letter of them changed."""
    whole = F.regexp_replace("text", r"\s\S*$", "")
    later = F.regexp_replace(F.substring("text", 71, F.lit(fx.CHUNK)), r"^\S*\s+", "")
    later = F.regexp_replace(F.concat(F.left(later, F.lit(14)), F.lit("#"), F.substring(later, 16, F.lit(fx.CHUNK))), r"\s\S*$", "")
    text = F.when(F.col("index") % 2 == 0, whole).otherwise(later)
    if rtl:  # marks differ between the copies of an overlap
        text = F.when(F.col("index") % 2 == 1, F.regexp_replace(text, "e", "eِ")).otherwise(text)
    return fx.chunk_text(spark, sf).withColumns({"text": text, "col": F.lit(0).cast("long")})


@query
def merge_fuzzy_overlap(spark, sf):
    return merge.merge_exact(edited_chunks(spark, sf))


@query
def merge_fuzzy_overlap_rtl(spark, sf):
    return merge.merge_exact(edited_chunks(spark, sf, rtl=True), rtl=True)


@query
def rtl_marks(spark, sf):
    base = fx.chunk_text(spark, sf).select("doc_id", "index", F.regexp_replace("text", "a", "aَ").alias("t"))
    return base.select("doc_id", "index", F.char_length("t").cast("long").alias("before"), without_marks(F.col("t")).alias("plain"))


@query
def rtl_merge(spark, sf):
    c = fx.chunk_text(spark, sf)
    # marks differ between the copies of an overlap: every second chunk carries them
    marked = c.withColumn("text", F.when(F.col("index") % 2 == 1, F.regexp_replace("text", "e", "eِ")).otherwise(F.col("text"))).withColumn("col", F.lit(0).cast("long"))
    return merge.merge_exact(marked, rtl=True)


@query
def result_base64(spark, sf):
    return fx.read(spark, sf, "documents").select("doc_id", F.translate(F.base64(F.encode("text", "UTF-8")), "\r\n", "").alias("encoded"))


# --- geometry -----------------------------------------------------------------------------


@query
def needs_splitting(spark, sf):
    docs = fx.image_meta(spark, sf).withColumn("engine", F.get(F.array(*[F.lit(e) for e in ("qari", "got", "deepseek", "other")]), (F.col("doc_id") % 4).cast("int")))
    c = docs.join(F.broadcast(config.engine_config(spark)), "engine", "left")  # one row per engine
    mp, dim = F.coalesce("max_megapixels", F.lit(GLOBAL.max_megapixels)), F.coalesce("max_dimension", F.lit(GLOBAL.max_dimension))
    return c.select("doc_id", "engine", geo.needs_splitting(*wh(), mp, dim).alias("needs_split"))


@query
def estimated_dpi(spark, sf):
    return fx.image_meta(spark, sf).select("doc_id", geo.estimated_dpi(*wh()).alias("dpi"))


@query
def target_chunks_grid(spark, sf):
    d = fx.image_meta(spark, sf).withColumn("target", geo.target_chunks(*wh(), GLOBAL.max_megapixels, GLOBAL.max_dimension))
    rows, cols = geo.chunk_grid(F.col("target"))
    return d.select("doc_id", "target", rows.alias("rows"), cols.alias("cols"))


def _grids(spark, sf, c=GLOBAL):
    d = fx.image_meta(spark, sf).withColumn("prefer_horizontal", F.explode(F.array(F.lit(False), F.lit(True))))
    rows, cols = geo.grid_size(*wh(), c.target_chunk_size, c.max_dimension, c.max_megapixels, F.col("prefer_horizontal"))
    return d.withColumns({"rows": rows, "cols": cols})


@query
def grid_size(spark, sf):
    return _grids(spark, sf).select("doc_id", "prefer_horizontal", "rows", "cols")


@query
def grid_tiles(spark, sf):
    return geo.overlapping_tiles(_grids(spark, sf, QARI).where("prefer_horizontal"), QARI.overlap_percent)


@query
def boundary_tiles(spark, sf):
    d = fx.image_meta(spark, sf)
    return geo.boundary_tiles(d, F.array(F.expr("2 * height div 3"), F.expr("height div 3")), F.array(F.expr("width div 2")))


@query
def legacy_suggested_grid(spark, sf):
    rows, cols = geo.suggested_grid(*wh())
    return fx.image_meta(spark, sf).select("doc_id", rows.alias("rows"), cols.alias("cols"))


@query
def legacy_grid_tiles(spark, sf):
    rows, cols = geo.suggested_grid(*wh())
    return geo.integer_grid_tiles(fx.image_meta(spark, sf).withColumns({"rows": rows, "cols": cols}))


@query
def legacy_columns(spark, sf):
    return geo.columns(fx.image_meta(spark, sf), 3)


@query
def scale_factor_dims(spark, sf):
    d = fx.image_meta(spark, sf).withColumn("dpi", geo.estimated_dpi(*wh())).withColumn("factor", geo.scale_factor(F.col("dpi")))
    return d.select("doc_id", F.round("factor", 6).alias("factor"), (F.col("width") * F.col("factor")).cast("long").alias("w"), (F.col("height") * F.col("factor")).cast("long").alias("h"))


@query
def adaptive_block_size(spark, sf):
    return fx.image_meta(spark, sf).select("doc_id", geo.adaptive_block(*wh()).alias("block"))


@query
def rotation_canvas(spark, sf):
    angle = ((F.col("doc_id") * 53) % 200 - 100) / F.lit(20.0)
    w, h = geo.rotated_canvas(*wh(), angle)
    return fx.image_meta(spark, sf).select("doc_id", angle.alias("angle"), w.alias("w"), h.alias("h"))


def _analysis(spark, sf):
    d = F.col("doc_id")
    part = lambda m, n, s: ((d * m) % n) / F.lit(float(s))
    return fx.image_meta(spark, sf).withColumns({"dpi": geo.estimated_dpi(*wh()), "noise": part(37, 100, 500), "skew": ((d * 53) % 200 - 100) / F.lit(20.0), "contrast": part(29, 100, 100), "value_range": part(17, 100, 100), "is_inverted": d % 7 == 0, "is_binary": d % 11 == 0})


@query
def step_plan(spark, sf):
    a = _analysis(spark, sf)
    out = []
    for engine, c in (("deepseek", config.GLOBAL_PREPROCESSING), ("qari", config.ENGINE_PREPROCESSING["qari"])):
        applies = steps.predicates(c, F.col("channels"), F.col("is_inverted"), F.col("noise"), F.col("skew"), F.col("contrast"), F.col("value_range"), F.col("is_binary"), F.col("dpi"))
        applied, skipped = steps.plan(applies)
        out.append(F.struct(F.lit(engine).alias("engine"), F.array_join(applied, ",").alias("applied"), F.array_join(skipped, ",").alias("skipped"), steps.rotates_page(c, F.col("skew")).alias("rotates_page")))
    return a.select("doc_id", F.explode(F.array(*out)).alias("p")).select("doc_id", "p.*")


@query
def applied_step_union(spark, sf):
    """Distinct steps over all chunks of a document, in pipeline order."""
    s = step_plan(spark, sf).select((F.col("doc_id") % 50).alias("grp"), F.explode(F.split("applied", ",")).alias("s")).where("s != ''")
    order = F.array(*[F.lit(x) for x in steps.ORDER])
    return s.groupBy("grp").agg(F.array_sort(F.collect_set(F.struct(F.array_position(order, F.col("s")).alias("i"), "s"))).alias("a")).select("grp", F.array_join(F.transform("a", lambda x: x["s"]), ",").alias("steps"))


@query
def image_info(spark, sf):
    rows, cols = geo.suggested_grid(*wh())
    return fx.image_meta(spark, sf).select("doc_id", "width", "height", F.round(geo.megapixels(*wh()), 6).alias("megapixels"), geo.needs_splitting(*wh(), 2.0, 2048).alias("needs_splitting"), rows.alias("rows"), cols.alias("cols"))


@query
def scale_to_dpi(spark, sf):
    d = fx.image_meta(spark, sf).withColumn("dpi", geo.estimated_dpi(*wh())).withColumn("f", geo.dpi_factor(F.col("dpi"), 400))
    w, h = geo.scaled(*wh(), F.col("f"))
    bw, bh = geo.scaled(*wh(), F.lit(1.5))
    return d.select("doc_id", w.alias("w"), h.alias("h"), bw.alias("by_factor_w"), bh.alias("by_factor_h"))


@query
def split_grid(spark, sf):
    d = fx.image_meta(spark, sf).withColumn("target", geo.target_chunks(*wh(), GLOBAL.max_megapixels, GLOBAL.max_dimension)).withColumn("prefer_horizontal", F.explode(F.array(F.lit(False), F.lit(True))))
    rows, cols = geo.split_grid(F.col("target"), F.col("prefer_horizontal"))
    return d.select("doc_id", "prefer_horizontal", rows.alias("rows"), cols.alias("cols"))


# --- validation ---------------------------------------------------------------------------


@query
def detect_file_type(spark, sf):
    return fx.uploads(spark, sf).select("doc_id", validate.detect_type(F.col("header")).alias("file_type"))


@query
def validate_upload(spark, sf):
    u = fx.uploads(spark, sf)
    return u.select("doc_id", validate.check_file(F.col("size_bytes"), F.col("header"), "image", config.MAX_IMAGE_MB).alias("image_result"), validate.check_file(F.col("size_bytes"), F.col("header"), "pdf", config.MAX_PDF_MB).alias("pdf_result"), validate.check_dpi(F.col("dpi")).alias("dpi_ok"))


@query
def validate_filename(spark, sf):
    return fx.uploads(spark, sf).select("doc_id", validate.safe_name(F.col("filename")).alias("base"), validate.check_name(F.col("filename")).alias("result"))


# --- profiles -----------------------------------------------------------------------------


@query
def row_projection(spark, sf):
    s = profile.smoothed(fx.ink_profile(spark, sf))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("window_ink").alias("total"), F.max("top").alias("top"), F.max(F.round(profile.value(F.col("window_ink"), F.col("top")), 6)).alias("peak"), F.sum(F.when(F.col("window_ink") < 0.25 * F.col("top"), 1).otherwise(0)).alias("low"))


@query
def col_projection(spark, sf):
    p = fx.ink_profile(spark, sf).withColumnRenamed("y", "x")
    return profile.smoothed(p, "x", 5).select("doc_id", "x", F.round(profile.value(F.col("window_ink"), F.col("top")), 6).alias("v"))


def _gaps(spark, sf):
    return profile.gaps(profile.runs(profile.smoothed(fx.ink_profile(spark, sf))))


@query
def find_gaps(spark, sf):
    return _gaps(spark, sf)


def _positions(spark, sf):
    return _gaps(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list("center")).alias("g"), F.max("size").alias("size"))


@query
def select_gaps(spark, sf):
    g = _positions(spark, sf)
    return g.select("doc_id", F.array_join(profile.select_gaps(F.col("g"), F.col("size"), 3).cast("array<string>"), ",").alias("splits"))


@query
def min_size_filter(spark, sf):
    g = _positions(spark, sf)
    return g.select("doc_id", *[F.array_join(profile.by_min_size(F.col("g"), F.col("size"), n).cast("array<string>"), ",").alias(f"min{n}") for n in (64, 256)])


@query
def otsu_threshold(spark, sf):
    h = fx.ink_profile(spark, sf).groupBy("doc_id", (F.col("ink") % 256).alias("v")).agg(F.count("*").alias("n"))
    return profile.otsu(h)


@query
def component_splits(spark, sf):
    """Split lines on rows no padded text line covers; runs of ink stand for text regions."""
    p = fx.ink_profile(spark, sf)
    lines = p.where("ink > 0").groupBy("doc_id", F.floor((F.col("y") - 20) / 16).alias("line")).agg(F.min("y").alias("a"), (F.max("y") + 1).alias("b"))
    size = p.groupBy("doc_id").agg(F.count("*").alias("size"))
    occ = lines.groupBy("doc_id").agg(F.collect_list(F.struct(F.greatest(F.lit(0), F.col("a") - 5).alias("first"), (F.col("b") + 5).alias("last"))).alias("o"))
    return occ.join(size, "doc_id").select("doc_id", F.array_join(profile.free_positions_split(F.col("o"), F.col("size"), 2, 64).cast("array<string>"), ",").alias("splits"))


# --- jobs and models ----------------------------------------------------------------------


@query
def job_latest_state(spark, sf):
    return jobs.latest(fx.job_events(spark, sf)).select("job_id", "status", "updated_us", "error")


@query
def job_expired(spark, sf):
    s = jobs.latest(fx.job_events(spark, sf))
    return s.select("job_id", jobs.expired(s).alias("expired"))


@query
def stale_jobs(spark, sf):
    return jobs.swept(jobs.latest(fx.job_events(spark, sf))).select("job_id", "status", "error", "is_stale")


@query
def model_listing(spark, sf):
    registered = spark.createDataFrame([(e,) for e in config.ENGINES], "model string")
    return jobs.listing(registered, fx.model_events(spark, sf), config.DEFAULT_ENGINE)


@query
def stale_model_status(spark, sf):
    return jobs.stale_status(fx.model_events(spark, sf), "user_id")


@query
def available_models(spark, sf):
    dirs = fx.read(spark, sf, "events").select(F.get(F.array(*[F.lit(x) for x in ("qari", "got", "deepseek", "tmp", ".cache")]), (F.col("user_id") % 5).cast("int")).alias("model")).distinct()
    return dirs.join(F.broadcast(spark.createDataFrame([(e,) for e in config.ENGINES], "model string")), "model", "left_semi")


@query
def resolve_engine(spark, sf):
    m = fx.model_events(spark, sf)
    state = m.groupBy("model").agg(F.max_by("status", F.struct("us", "event_id")).alias("status"))  # one row per engine
    ids = m.select("user_id").distinct()
    asked = F.get(F.array(F.lit("qari"), F.lit(""), F.lit(None).cast("string"), F.lit("unknown")), (F.col("user_id") % 4).cast("int"))
    e = ids.select("user_id", jobs.resolve_engine(asked, F.when(F.col("user_id") % 3 == 0, "got").otherwise("")).alias("engine"))
    return e.join(state, e["engine"] == state["model"], "left").select("user_id", "engine", jobs.submit_gate(F.col("engine"), F.col("status")).alias("code"))


@query
def download_lock_winner(spark, sf):
    return jobs.lock_winners(fx.model_events(spark, sf), "user_id")


@query
def job_timeout_budget(spark, sf):
    return fx.pdf_pages(spark, sf).groupBy("job_id").agg((F.count("*") * config.JOB_TIMEOUT_S).alias("timeout_s"))


@query
def webhook_payload(spark, sf):
    s = jobs.latest(fx.job_events(spark, sf)).where("status in ('completed', 'failed')")
    name = F.when(F.col("job_id") % 6 == 0, F.lit('a "quoted" \\ name.png')).otherwise(F.concat(F.lit("f"), F.col("job_id"), F.lit(".png")))
    result = F.when(F.col("status") == "completed", F.struct(F.concat(F.lit("page\n"), F.col("job_id")).alias("text"), (F.col("job_id") % 100).alias("confidence")))
    return s.select("job_id", jobs.webhook_payload(F.col("job_id"), F.col("status"), name, F.col("error"), result).alias("payload"))


@query
def failure_handler(spark, sf):
    """Failures of page jobs are marked; those of whole-document jobs are not."""
    e = fx.events(spark, sf).where("event_type = 'error'")
    func = F.when(F.col("event_id") % 3 == 0, "process_pdf_job").otherwise("process_ocr_job")
    return e.select("event_id", F.col("user_id").alias("job_id"), func.alias("func"), F.when(func == "process_ocr_job", F.concat(F.lit("RuntimeError: E"), F.col("event_id"))).alias("marked"))


@query
def download_complete(spark, sf):
    d = fx.read(spark, sf, "documents")
    files = d.select((F.col("doc_id") % 97).alias("model"), (F.col("n_chars") * 7919).alias("bytes"), F.concat(F.lit("blob"), F.col("doc_id"), F.when(F.col("doc_id") % 331 == 5, ".incomplete").otherwise("")).alias("path"))
    return jobs.download_complete(files)


@query
def current_model(spark, sf):
    return jobs.current_model(fx.model_events(spark, sf))


@query
def status_map(spark, sf):
    m = jobs.status_map(fx.model_events(spark, sf))
    entry = lambda e: F.concat(e["key"], F.lit("="), e["value"])
    return m.select(F.array_join(F.array_sort(F.transform(F.map_entries("statuses"), entry)), ",").alias("statuses"))


@query
def submit_upload(spark, sf):
    """Uploads to job rows: engine gate, checks, stored name, first status."""
    m = fx.model_events(spark, sf)
    state = m.groupBy("model").agg(F.max_by("status", F.struct("us", "event_id")).alias("status"))  # one row per engine
    u = fx.uploads(spark, sf).withColumn("engine", jobs.resolve_engine(F.get(F.array(F.lit("qari"), F.lit(""), F.lit("nope")), (F.col("doc_id") % 3).cast("int")), F.lit(None).cast("string")))
    j = u.join(state, u["engine"] == state["model"], "left")
    code = validate.submit(jobs.submit_gate(F.col("engine"), F.col("status")), validate.check_name(F.col("filename")), validate.check_file(F.col("size_bytes"), F.col("header"), "image", config.MAX_IMAGE_MB))
    return j.withColumn("code", code).select("doc_id", "engine", "code", F.when(F.col("code") == 202, "pending").alias("state"), F.when(F.col("code") == 202, validate.stored_name(F.col("doc_id"), F.col("filename"))).alias("stored_as"))


@query
def job_lookup(spark, sf):
    """Point lookup and prefix scan over keyed states; deleted jobs are gone."""
    s = jobs.latest(fx.job_events(spark, sf))
    left = jobs.without(s, s.where("job_id % 10 = 3")).withColumn("key", F.concat(F.lit("job:"), F.col("job_id")))
    return jobs.with_prefix(left, "job:1").select("key", "status")


# --- pixels -------------------------------------------------------------------------------


def rasters(spark, sf):
    """A gray raster for each document, filled with its text: rows of 64, at least 48 of them."""
    text = F.regexp_replace("text", "[^ -~]", "~")
    d = fx.read(spark, sf, "documents").withColumn("height", F.greatest(F.lit(48), F.ceil(F.char_length("text") / 64.0).cast("int")))
    return d.select("doc_id", "height", F.lit(64).alias("width"), F.lit(1).alias("channels"), F.encode(F.rpad(text, F.col("height") * 64, " "), "UTF-8").alias("data"))


@query
def image_metrics(spark, sf):
    return kernels.analyse(rasters(spark, sf))


@query
def page_quality(spark, sf):
    """The metrics that follow from sums of the pixels alone, from the pixel pass."""
    return kernels.analyse(rasters(spark, sf)).select("doc_id", "blur_score", F.round("contrast_ratio", 6).alias("contrast"), F.round("brightness", 6).alias("brightness"), "otsu", F.round("content_density", 6).alias("content_density"), "estimated_dpi", "needs_sharpening")


@query
def page_pipeline(spark, sf):
    """Rasters through straightening, splitting, preparation, a stand-in engine and the merge."""
    return pages.process(rasters(spark, sf), "qari")


@query
def pixel_statistics(spark, sf):
    """Contrast, brightness and the inverted mean of the same rasters, without Python."""
    px = rasters(spark, sf).select("doc_id", F.transform(F.split(F.decode("data", "UTF-8"), ""), lambda c: F.ascii(c)).alias("v"))
    lo, hi, total = F.array_min("v"), F.array_max("v"), F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x)
    n = F.size("v")
    return px.select("doc_id", F.round((hi - lo) / (hi + lo).cast("double"), 6).alias("contrast"), F.round(total / (n * 255.0), 6).alias("brightness"), F.round((n * 255 - total) / n.cast("double"), 6).alias("inverted_mean"), F.size(F.array_distinct("v")).cast("long").alias("n_values"))


# --- engines, pages, streams --------------------------------------------------------------


@query
def engine_pipeline(spark, sf):
    """Chunks as rasters through a stand-in engine and back into documents."""
    c = fx.chunk_text(spark, sf).withColumn("data", F.encode("text", "UTF-8")).drop("text")
    return engines.process(c, "deepseek").select("doc_id", "merged")


@query
def engine_concat(spark, sf):
    c = fx.chunk_text(spark, sf).withColumn("data", F.encode("text", "UTF-8")).drop("text")
    return engines.process(c, "got").select("doc_id", F.col("merged").alias("text"))


@query
def pdf_to_pages(spark, sf):
    d = fx.read(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    found = files.pages(d, lambda data, zoom: data.split(b"\n"))
    return found.select("doc_id", "page_number", "total_pages", "page_name", F.octet_length("data").cast("long").alias("bytes"), "error")


@query
def smart_split_method(spark, sf):
    """Which splitter each page gets: gaps of its profile, free rows, or a grid."""
    p = fx.ink_profile(spark, sf)
    size = p.groupBy("doc_id").agg(F.count("*").alias("height"))
    g = size.join(_positions(spark, sf).select("doc_id", "g"), "doc_id", "left").withColumn("g", F.coalesce("g", F.array().cast("array<bigint>")))
    lines = p.where("ink > 0").groupBy("doc_id", F.floor((F.col("y") - 20) / 16).alias("line")).agg(F.min("y").alias("a"), (F.max("y") + 1).alias("b"))
    occ = lines.groupBy("doc_id").agg(F.collect_list(F.struct(F.greatest(F.lit(0), F.col("a") - 5).alias("first"), (F.col("b") + 5).alias("last"))).alias("o"))
    d = g.join(occ, "doc_id", "left").withColumn("width", F.lit(1000).cast("long"))
    proj = profile.by_min_size(profile.select_gaps(F.col("g"), F.col("height"), 1), F.col("height"), 128)
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    comp = F.when(F.size(proj) > 0, F.array().cast("array<bigint>")).otherwise(profile.free_positions_split(F.coalesce("o", none), F.col("height"), 1, 64))
    need = geo.needs_splitting(F.col("width"), F.col("height"), 0.15, 2048)
    d = d.withColumns({"proj": proj, "comp": comp})
    report = splitting.report(F.col("proj"), F.col("comp"))
    return d.select("doc_id", splitting.choose(need, F.col("proj"), F.col("comp")).alias("method"), splitting.recommended(report).alias("recommended"))


@query
def job_state_stream(spark, sf):
    """The stream of job events, run over what there is; the last update of each job."""
    schema = fx.read(spark, sf, "events").schema
    bounds = fx.read(spark, sf, "events").agg(F.min(fx.epoch_us(F.col("ts"))).alias("t0")).first()["t0"] or 0
    e = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    status = fx.mapped(F.col("event_type"), fx.JOB_STATUS)
    events = e.select(F.col("user_id").alias("job_id"), "event_id", ((fx.epoch_us(F.col("ts")) - F.lit(bounds)) / 20).cast("long").alias("us"), status.alias("status"), F.when(F.col("event_type") == "error", F.concat(F.lit("E"), F.col("event_id"))).alias("error")).where("status is not null")
    last = job_stream.run_once(job_stream.job_states(events, timeouts=False))
    return last.select("job_id", "status", "updated_us", "error")
