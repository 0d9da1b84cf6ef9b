"""Job and model state from event tables: latest state, expiry, sweeps, listings, locks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docsheaf import config

# Fixed value: the message of the sweep.
STALE_ERROR = "Job timed out - worker may have crashed"


def latest(events: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, status, updated_us, error, now_us): the last write wins; an error stays until another
    one comes. One aggregation, partial on the map side."""
    at = F.struct("us", "event_id")
    # max of (time, error) over rows with an error is the last error
    last_error = F.max(F.when(F.col("error").isNotNull(), F.struct("us", "event_id", "error")))
    return events.groupBy(key).agg(F.max_by("status", at).alias("status"), F.max("us").alias("updated_us"), last_error["error"].alias("error"), F.max("now_us").alias("now_us"))


def expired(state: DataFrame, ttl_s: int = config.JOB_TTL_S) -> Column:
    return F.col("now_us") - F.col("updated_us") > ttl_s * 1_000_000


def swept(state: DataFrame, stale_s: int = config.STALE_JOB_S) -> DataFrame:
    """Jobs processing for longer than ``stale_s`` (strictly) become failed."""
    stale = (F.col("status") == "processing") & (F.col("now_us") - F.col("updated_us") > stale_s * 1_000_000)
    return state.withColumns({"is_stale": stale, "status": F.when(stale, "failed").otherwise(F.col("status")), "error": F.when(stale, STALE_ERROR).otherwise(F.col("error"))})


def live_status(events: DataFrame, key: str, ttl_s: int = config.STATUS_TTL_S) -> DataFrame:
    """(key, status, updated_us, now_us): the latest status; transient ones expire to not_found."""
    s = events.groupBy(key).agg(F.max_by("status", F.struct("us", "event_id")).alias("raw"), F.max("us").alias("updated_us"), F.max("now_us").alias("now_us"))
    gone = F.col("raw").isin(*config.TRANSIENT) & (F.col("now_us") - F.col("updated_us") > ttl_s * 1_000_000)
    return s.select(key, F.when(gone, "not_found").otherwise(F.col("raw")).alias("status"), "updated_us", "now_us")


def listing(registered: DataFrame, events: DataFrame, current: str | None) -> DataFrame:
    """Registered models with status and progress; unparsable progress is 0. Events of other models
    go before anything is grouped, so what is joined has a row per registered model at most."""
    own = events.join(registered.select("model"), "model", "left_semi")
    status = live_status(own, "model")
    progress = own.groupBy("model").agg(F.max_by("progress", F.struct("us", "event_id")).alias("p"))
    out = registered.join(status, "model", "left").join(progress, "model", "left")
    state = F.coalesce("status", F.lit("not_found"))
    return out.select("model", F.col("model").eqNullSafe(F.lit(current)).alias("is_loaded"), (state == "ready").alias("is_available"), state.alias("status"), F.coalesce(F.col("p").try_cast("double"), F.lit(0.0)).alias("progress"))


def stale_status(events: DataFrame, key: str, status_ttl_s: int = config.STATUS_TTL_S, lock_ttl_s: int = config.LOCK_TTL_S) -> DataFrame:
    """Keys whose latest status is transient while nobody holds a live lock."""
    state = events.groupBy(key).agg(F.max_by("status", F.struct("us", "event_id")).alias("status"), F.max("now_us").alias("now_us"))
    locks = events.where("locks").where(F.col("now_us") - F.col("us") <= lock_ttl_s * 1_000_000).select(key).distinct()
    return state.where(F.col("status").isin(*config.TRANSIENT)).join(locks, key, "left_anti").select(key, "status")


def lock_winners(events: DataFrame, key: str, ttl_s: int = config.LOCK_TTL_S) -> DataFrame:
    """(key, acquisitions, holder): set-if-absent with a time to live, in order of time. Who wins
    hangs on the winner before, so a key's attempts are one sequence; they are sorted by Spark and
    stream past one state, whatever their number."""
    schema = T.StructType([events.schema[key], T.StructField("acquisitions", T.LongType()), T.StructField("holder", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        now, held = None, None  # key, (time, holder, acquisitions)
        for batch in batches:
            done = []
            for k, us, event in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held is None or k != now:
                    if held is not None:
                        done.append((now, held[2], held[1]))
                    now, held = k, (us, event, 1)
                elif us - held[0] >= ttl_s * 1_000_000:
                    held = (us, event, held[2] + 1)
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in done], schema=arrow)
        if held is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, (now, held[2], held[1])))], schema=arrow)

    tries = events.where("locks").select(key, "us", "event_id").repartition(key).sortWithinPartitions(key, "us", "event_id")
    return tries.mapInArrow(run, schema)


def released(locks: DataFrame, requests: DataFrame, key: str = "model") -> DataFrame:
    """The locks that stay: one is taken away only by a request that names its holder."""
    asked = requests.select(key, "holder").distinct()
    return locks.join(asked, [key, "holder"], "left_anti").select(*locks.columns)


def resolve_engine(requested: Column, current: Column, default: str = config.DEFAULT_ENGINE) -> Column:
    return F.coalesce(F.nullif(requested, F.lit("")), F.nullif(current, F.lit("")), F.lit(default))


def submit_gate(engine: Column, status: Column) -> Column:
    """400 for an unknown engine, 503 while it downloads or after it failed, else 202."""
    return F.when(~engine.isin(*config.ENGINES), 400).when(status.isin("downloading", "failed"), 503).otherwise(202).cast("long")


def enqueue(requests: DataFrame, path: str) -> None:
    """Append job rows (job_id, engine, pages, ...) as files to the folder that a job stream reads; a
    job's time is the usual one for each of its pages, one at least."""
    budget = F.greatest(F.coalesce("pages", F.lit(1)), F.lit(1)) * config.JOB_TIMEOUT_S
    requests.withColumn("timeout_s", budget.cast("long")).write.mode("append").json(path)


def webhook_payload(job_id: Column, status: Column, filename: Column, error: Column, result: Column | None = None) -> Column:
    """The delivery as JSON text; fields without a value are null. ``result`` is a struct, present
    for a job that ended well."""
    fields = {"job_id": job_id.cast("string"), "status": status, "filename": filename, "result": F.lit(None).cast("string") if result is None else result, "error": error}
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def download_complete(files: DataFrame, key: str = "model", least: int = config.MODEL_MIN_BYTES) -> DataFrame:
    """Models whose files have no unfinished part and ``least`` bytes in all."""
    return files.groupBy(key).agg(F.sum("bytes").alias("bytes"), F.max(F.col("path").endswith(".incomplete").cast("int")).alias("open")).select(key, "bytes", ((F.col("open") == 0) & (F.col("bytes") >= least)).alias("complete"))


def current_model(events: DataFrame, default: str = config.DEFAULT_ENGINE) -> DataFrame:
    """(model): the global register. A ready model takes it, a removed one (not_found) clears it if
    it was the last to write; an empty register holds the default."""
    last = events.where(F.col("status").isin("ready", "not_found")).agg(F.max_by(F.struct("model", "status"), F.struct("us", "event_id")).alias("x"))
    return last.select(F.coalesce(F.when(F.col("x.status") == "ready", F.col("x.model")), F.lit(default)).alias("model"))


def status_map(events: DataFrame) -> DataFrame:
    """(statuses): one map of every model's live status."""
    return live_status(events, "model").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "status")))).alias("statuses"))  # a row per model


def switches(requests: DataFrame, models: DataFrame, wait_s: int = config.SWITCH_WAIT_S) -> DataFrame:
    """(request_id, model, outcome) of requests (request_id, model, busy_s) to change the current
    model: ``unknown`` if it is not registered, ``not_ready`` unless its status is ready, ``timeout``
    if the engine in use stays busy longer than ``wait_s``, else ``switched``."""
    known = models.select("model", F.col("status").alias("model_status"))
    out = requests.join(known, "model", "left")
    outcome = F.when(F.col("model_status").isNull(), "unknown").when(F.col("model_status") != "ready", "not_ready").when(F.col("busy_s") > wait_s, "timeout").otherwise("switched")
    return out.select("request_id", "model", outcome.alias("outcome"))


def without(jobs_: DataFrame, gone: DataFrame, key: str = "job_id") -> DataFrame:
    """Deleted jobs taken out."""
    return jobs_.join(gone.select(key).distinct(), key, "left_anti")


def with_prefix(keys: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    return keys.where(F.startswith(F.col(key), F.lit(prefix)))
