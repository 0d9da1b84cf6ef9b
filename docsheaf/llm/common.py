"""Shared plumbing: Arrow batches through Python, intermediate tables in the shared folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


ROWS = 1000
_local: str | None = None


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until no column of ``df`` has them in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def map_batches(df: DataFrame, columns: list[str], schema: StructType, make: Callable) -> DataFrame:
    """One Arrow pass. ``make()`` runs once per task and gives a function from a dict of
    column lists to a dict of column lists; only one batch is in memory at a time."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        step = make()
        for batch in batches:
            yield pa.RecordBatch.from_pydict(step(batch.to_pydict()), schema=arrow)

    return map_small(df.select(*columns), run, schema)


def map_small(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """``mapInArrow`` whose function sees at most ``ROWS`` rows at a time. Spark's own bounds of a
    batch (10,000 rows or 64 MB) hold what crosses to Python; lists made of it stay small."""

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield batch.slice(at, ROWS)

    return df.mapInArrow(lambda batches: run(cut(batches)), schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. Where none is configured a folder of this machine serves a
    local master, as in tests; on a cluster that is an error. Nothing is set in the session."""
    global _local
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _local = _local or f"file://{tempfile.mkdtemp(prefix='docsheaf-')}"
        found = _local
    return found.rstrip("/")


def table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage with
    files that outlive any executor. Removed when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docsheaf-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(schema).parquet(path)
    out._docsheaf_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables that nothing reads any more; what follows them must be written already."""
    for t in tables:
        _remove(t.sparkSession, t._docsheaf_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the JVM may be gone already; the folder is scratch space
        pass


def id_type(df: DataFrame, name: str):
    return df.schema[name].dataType
