"""Job state over a stream of events: keyed state, last write wins, time to live, stale sweep."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from docsheaf import config
from docsheaf.operators.jobs import STALE_ERROR
from docsheaf.sources import scratch

OUT = "job_id long, status string, updated_us long, error string, expired boolean"
STATE = "us long, event_id long, status string, error_us long, error_id long, error string"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: Any, timeouts: bool = True) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        us, _, status, _, _, error = state.get
        state.remove()
        stale = status == "processing"
        yield pd.DataFrame([(key[0], "failed" if stale else status, us, STALE_ERROR if stale else error, not stale)], columns=["job_id", "status", "updated_us", "error", "expired"])
        return
    now = state.get if state.exists else (-1, -1, None, -1, -1, None)
    us, eid, status, eus, ees, error = now
    for f in frames:
        for r in f.itertuples(index=False):
            if (r.us, r.event_id) > (us, eid):
                us, eid, status = int(r.us), int(r.event_id), r.status
            if r.error is not None and r.error == r.error and (r.us, r.event_id) > (eus, ees):
                eus, ees, error = int(r.us), int(r.event_id), r.error
    state.update((us, eid, status, eus, ees, error))
    if timeouts:
        state.setTimeoutDuration((config.STALE_JOB_S if status == "processing" else config.JOB_TTL_S) * 1000)
    yield pd.DataFrame([(key[0], status, us, error, False)], columns=["job_id", "status", "updated_us", "error", "expired"])


def job_states(events: DataFrame, timeouts: bool = True) -> DataFrame:
    """Updates of (job_id, us, event_id, status, error) events. A job without events for its time
    to live leaves the state as expired; a job that keeps processing is swept to failed. A run
    over what there is (availableNow) needs ``timeouts=False``: waiting for one never ends."""

    def advance(key, frames, state):
        return _advance(key, frames, state, timeouts)

    mode = GroupStateTimeout.ProcessingTimeTimeout if timeouts else GroupStateTimeout.NoTimeout
    return events.select("job_id", "us", "event_id", "status", "error").groupBy("job_id").applyInPandasWithState(advance, OUT, STATE, "update", mode)


def run_once(states: DataFrame, key: str = "job_id") -> DataFrame:
    """The last state of each key after a run over what there is. Updates are written batch by
    batch as files to the shared folder; a batch that runs again replaces its files."""
    out = f"{scratch.folder(states.sparkSession)}/states"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/part={number}")

    empty = states.sparkSession.createDataFrame([], states.schema).withColumn("batch", F.lit(-1).cast("long"))
    empty.write.parquet(f"{out}/part=-1")
    run = states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = states.sparkSession.read.schema(empty.schema).parquet(out)
    names = [c for c in states.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "batch").alias("s")).select(key, "s.*")  # one row of a key in a batch


def deliver(post: Callable[[str, str], bool], attempts: int | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: POST each (webhook_url, payload), up to ``attempts`` times, without
    a pause between; rows without a url count as delivered."""
    most = attempts or config.WEBHOOK_ATTEMPTS

    def send(rows):
        for r in rows:
            if r["webhook_url"]:
                any(post(r["webhook_url"], r["payload"]) for _ in range(most))

    return lambda batch, _: batch.select("webhook_url", "payload").where(F.coalesce("webhook_url", F.lit("")) != "").foreachPartition(send)
