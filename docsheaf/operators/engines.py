"""Recognition engines: a registry, and one Arrow pass that loads an engine once per task.

Model inference is pluggable; the engines here are stand-ins that read a raster's bytes as text.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docsheaf.operators import merge


class Engine:
    """load() once per task, extract(raster bytes) -> (text, formatted text, confidence)."""

    name = ""
    splits_pages = True
    right_to_left = False
    loaded = False

    def load(self) -> None:
        pass

    def ready(self) -> Engine:
        """Loaded once, however often it is asked for."""
        if not self.loaded:
            self.load()
            self.loaded = True
        return self

    def read(self, data: bytes) -> tuple[str, str, float]:
        if not self.loaded:
            raise RuntimeError(f"The {self.name} engine is not loaded")
        return self.extract(data)

    def extract(self, data: bytes) -> tuple[str, str, float]:
        raise NotImplementedError


class Registry:
    def __init__(self):
        self._known: dict[str, type[Engine]] = {}

    def register(self, cls: type[Engine]) -> type[Engine]:
        if not cls.name:
            raise ValueError("an engine needs a name")
        self._known[cls.name] = cls
        return cls

    def create(self, name: str) -> Engine:
        if name not in self._known:
            raise ValueError(f"Unknown engine: {name}. Available: {', '.join(self.names())}")
        return self._known[name]()

    def names(self) -> list[str]:
        return sorted(self._known)

    def __contains__(self, name: str) -> bool:
        return name in self._known


ENGINES = Registry()


@ENGINES.register
class Qari(Engine):
    name, right_to_left = "qari", True

    def extract(self, data):
        text = data.decode("utf-8", "replace")
        return text, text, 0.0


@ENGINES.register
class Got(Engine):
    name = "got"

    def extract(self, data):
        text = data.decode("utf-8", "replace")
        return text, f"$ {text}", 0.0


@ENGINES.register
class Deepseek(Engine):
    name, splits_pages = "deepseek", False

    def extract(self, data):
        text = data.decode("utf-8", "replace")
        return text, text, 0.0


RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("formatted_text", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("error", T.StringType())])


def recognise(chunks: DataFrame, engine: str | Callable[[], Engine], data: str = "data", swallow: bool = False) -> DataFrame:
    """``chunks`` without ``data`` plus text, formatted_text, confidence and error. An error names
    its chunk; with ``swallow`` the chunk's text is empty instead."""
    make = (lambda: ENGINES.create(engine)) if isinstance(engine, str) else engine
    keep = [f for f in chunks.schema.fields if f.name != data]
    schema = T.StructType([*keep, *RESULT.fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        e = make().ready()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                raw = r.pop(data)
                try:
                    out = (*e.read(bytes(raw or b"")), None)
                except Exception as x:  # noqa: BLE001  an engine's failure belongs to its chunk
                    out = ("", "", 0.0, None if swallow else f"chunk {r.get('index')}: {x}")
                rows.append(r | dict(zip(RESULT.names, out)))
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return chunks.select(*[f.name for f in keep], data).mapInArrow(run, schema)


def process(chunks: DataFrame, engine: str) -> DataFrame:
    """(doc_id, merged, error): recognised chunks of each document in reading order. A document
    with a failed chunk has no text and the first error."""
    e = ENGINES.create(engine)
    done = recognise(chunks, engine)
    failed = done.where("error is not null").groupBy("doc_id").agg(F.min("error").alias("error"))
    texts = done.select("doc_id", "index", "row", "col", "text")
    if engine == "got":
        whole = merge.concat(texts).withColumnRenamed("text", "merged")
    else:
        whole = merge.merge_exact(texts, rtl=e.right_to_left)
    return whole.join(failed, "doc_id", "left").select("doc_id", F.when(F.col("error").isNull(), F.col("merged")).alias("merged"), "error")
