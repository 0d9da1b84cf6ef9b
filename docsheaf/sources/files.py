"""File sources: uploads as binary files, page explosion by a pluggable renderer, decoded images."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docsheaf import config
from docsheaf.operators import validate


def uploads(spark: SparkSession, path: str, expected: str = "image", stream: bool = False) -> DataFrame:
    """(path, name, size_bytes, check, content): files with the first failed check or ok. Size and
    signature are tested before anything is decoded; ``stream`` reads new files as they come."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read
    files = reader.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    most = config.MAX_PDF_MB if expected == "pdf" else config.MAX_IMAGE_MB
    named = validate.check_name(name)
    return files.select("path", name.alias("name"), F.col("length").alias("size_bytes"), F.when(named != "ok", named).otherwise(validate.check_file(F.col("length"), F.col("content"), expected, most)).alias("check"), "content")


PAGE = T.StructType([T.StructField("page_number", T.LongType()), T.StructField("total_pages", T.LongType()), T.StructField("page_name", T.StringType()), T.StructField("data", T.BinaryType()), T.StructField("error", T.StringType())])


def pages(df: DataFrame, render: Callable[[bytes, float], Iterable[bytes]], key: str = "doc_id", content: str = "content", dpi: int = 300) -> DataFrame:
    """One row per page of each file: ``render(content, zoom)`` gives the pages, zoom is dpi / 72.
    A file without pages or with an error is one row that says so, so that its job can fail as a
    whole. Only the pages of one file are held at a time, since each row tells their number."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *PAGE.fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found, error = list(render(data or b"", dpi / 72)), None
                except Exception as e:  # noqa: BLE001  whatever a renderer raises is that file's failure
                    found, error = [], f"Failed to convert: {e}"
                rows = [(k, i, len(found), f"{k}_page_{i:03d}.png", p, None) for i, p in enumerate(found, 1)] or [(k, 0, 0, None, None, error or "File has no pages")]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=arrow)

    return df.select(key, content).mapInArrow(run, schema)


def metadata(df: DataFrame, read: Callable[[bytes], dict], key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, page_count, title, author, subject, creator, producer, format, error) of each file;
    ``read(content)`` gives a dict with those names, absent ones are null. A file that cannot be read has
    the error and a page count of 0."""
    told = ("title", "author", "subject", "creator", "producer", "format")
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("page_count", T.LongType()), *[T.StructField(n, T.StringType()) for n in (*told, "error")]])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            out = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found, error = read(data or b""), None
                except Exception as e:  # noqa: BLE001  whatever a reader raises is that file's failure
                    found, error = {"page_count": 0}, str(e)
                out.append({key: k, "page_count": found.get("page_count"), "error": error} | {n: found.get(n) for n in told})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.select(key, content).mapInArrow(run, schema)


def images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, height, width, channels, data, error) of pictures, by the JVM's decoder; three channels
    are blue, green, red. A file that cannot be decoded is a row with the error and no data."""
    found = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    bad = F.col("height") < 0
    whole = lambda c: F.when(~bad, F.col(c))
    return found.select("origin", whole("height").alias("height"), whole("width").alias("width"), whole("nChannels").alias("channels"), whole("data").alias("data"), F.when(bad, "Invalid or corrupted image file").alias("error"))


def decodable(files: DataFrame, pictures: DataFrame, check: str = "check") -> DataFrame:
    """``uploads`` with the decode test as the last check: a file that passed the others and that
    ``images`` of the same folder could not read has its error. Matched by path."""
    place = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  the two readers write local paths differently
    bad = pictures.where("error is not null").select(place("origin").alias("place"), F.col("error").alias("decode_error")).distinct()
    return files.join(bad, place("path") == F.col("place"), "left").withColumn(check, F.when(F.col(check) == "ok", F.coalesce("decode_error", check)).otherwise(F.col(check))).select(*files.columns)


def write_texts(df: DataFrame, path: str, stem: str = "stem", text: str = "text") -> None:
    """A text output per row, in the folder ``file={stem}_ocr.txt`` below ``path``; the folder's one
    part holds the text's lines. A null text is empty."""
    named = df.select(F.concat(F.col(stem), F.lit("_ocr.txt")).alias("file"), F.coalesce(F.col(text), F.lit("")).alias("value"))
    named.repartition("file").write.mode("overwrite").partitionBy("file").text(path)
