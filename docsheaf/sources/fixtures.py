"""Image-, file- and job-shaped inputs derived from the tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsheaf.functions.text import WS

CHUNK, STEP = 600, 480
#: first bytes of uploads by doc_id % 12
HEADERS = ("FFD8FFE000104A46", "89504E470D0A1A0A", "474946383761", "474946383961", "424D36000000", "49492A00", "4D4D002A", "524946460000000057454250", "524946460000000057415645", "52494646", "255044462D312E37", "DEADBEEF")
FILENAMES = ("scan.png", "../../etc/x.png", ".hidden", "a..b.png", "", "dir/", "dir/sub/page.pdf", "x" * 300, "..")
JOB_STATUS = {"signup": "pending", "view": "processing", "purchase": "completed", "error": "failed"}
MODEL_STATUS = {"signup": "not_found", "view": "downloading", "purchase": "ready", "error": "failed", "click": "loading"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def image_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = F.col("doc_id"), F.col("n_chars")
    return read(spark, sf_dir, "documents").select(d, (400 + (d * 7919) % 3200).alias("width"), (400 + (n * 31 + d) % 4800).alias("height"), F.get(F.array(F.lit(1), F.lit(3), F.lit(4)), (d % 3).cast("int")).cast("long").alias("channels"))


def chunk_text(spark: SparkSession, sf_dir: str, columns: int = 1) -> DataFrame:
    """(doc_id, index, row, col, text): overlapping windows in one or two columns."""
    last = F.greatest(F.lit(0), F.ceil((F.col("n_chars") - 120) / F.lit(float(STEP))) - 1).cast("int")
    # the text is cut once into steps; a window is a step and the start of the next one
    steps = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{STEP}}}"), F.lit(0))
    rows = read(spark, sf_dir, "documents").select("doc_id", steps.alias("p"), F.sequence(F.lit(0), last).alias("at"))
    piece = lambda i: F.coalesce(F.get("p", i), F.lit(""))
    windows = F.transform("at", lambda i: F.struct(i.alias("i"), F.concat(piece(i), F.left(piece(i + 1), F.lit(CHUNK - STEP))).alias("text")))
    rows = rows.select("doc_id", F.explode(windows).alias("w")).select("doc_id", "w.i", "w.text")
    return rows.select("doc_id", F.col("i").cast("long").alias("index"), F.floor(F.col("i") / columns).cast("long").alias("row"), (F.col("i") % columns).cast("long").alias("col"), "text")


def ink_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, y, ink): twelve inked rows for each line, gaps of 4 to 33 empty rows between."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    sized = lines.select("doc_id", "n", F.char_length(F.regexp_replace("line", WS, "")).cast("long").alias("k"), (16 + (F.col("n") * 7 + F.col("doc_id")) % 30).alias("r"))
    before = F.sum("r").over(Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    placed = sized.withColumn("y0", 20 + F.coalesce(before, F.lit(0)))
    body = placed.select("doc_id", "k", "y0", F.explode(F.sequence(F.lit(0), (F.col("r") - 1).cast("int"))).alias("j")).select("doc_id", (F.col("y0") + F.col("j")).alias("y"), F.when(F.col("j") < 12, F.col("k")).otherwise(0).alias("ink"))
    top = placed.where("n = 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("j")).select("doc_id", F.col("j").cast("long").alias("y"), F.lit(0).cast("long").alias("ink"))
    return body.unionByName(top)


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    return (F.unix_date(F.to_date(ts)) * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60) * F.lit(1_000_000).cast("long") + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ``us`` (compressed time) and ``now_us``, its largest value."""
    e = read(spark, sf_dir, "events").withColumn("t", epoch_us(F.col("ts")))
    # two scalar subqueries over the one column, computed once
    bound = lambda f: read(spark, sf_dir, "events").select(f(epoch_us(F.col("ts")))).scalar()
    return e.withColumn("t0", bound(F.min)).withColumn("t1", bound(F.max)).withColumn("us", F.expr("(t - t0) div 20")).withColumn("now_us", F.expr("(t1 - t0) div 20")).drop("t", "t0", "t1")


def mapped(column: Column, names: dict) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = mapped(F.col("event_type"), JOB_STATUS)
    return events(spark, sf_dir).select(F.col("user_id").alias("job_id"), "event_id", "us", "now_us", status.alias("status"), F.when(F.col("event_type") == "error", F.concat(F.lit("E"), F.col("event_id"))).alias("error")).where("status is not null")


def model_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    model = F.get(F.array(*[F.lit(x) for x in ("qari", "got", "deepseek")]), (F.col("user_id") % 3).cast("int"))
    return e.select("user_id", "event_id", "us", "now_us", model.alias("model"), mapped(F.col("event_type"), MODEL_STATUS).alias("status"), F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("progress"), (F.col("event_type") == "click").alias("locks"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (d % n).cast("int"))
    return read(spark, sf_dir, "documents").select(d, F.when(d % 50 == 0, 0).otherwise(F.col("n_chars") * 40_000).cast("long").alias("size_bytes"), F.unhex(pick(HEADERS, 12)).alias("header"), pick(FILENAMES, 9).alias("filename"), (60 + (d * 13) % 600).alias("dpi"))


def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id")
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("job_id"), F.row_number().over(w.orderBy("turn")).cast("long").alias("page_number"), F.count("*").over(w).alias("total_pages"), "text", F.when(F.col("role") == "system", "").otherwise(F.col("text")).alias("formatted_text"), ((F.char_length("text") % 100) / F.lit(100.0)).alias("confidence"))
