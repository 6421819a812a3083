"""Jobs as streams: submissions from a landing folder, job states with expiry, progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom.operators.jobs import ACTIVE, TTL, UPLOAD, status_of

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
STATE = "status string, steps long, total long, created long, at long, seq long"
CHANGED = "job_id long, status string, steps long, total long, expired boolean"


def landing(spark: SparkSession, path: str) -> DataFrame:
    """New files of a folder, at most ACTIVE a trigger: admission is the trigger's size."""
    s = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", ACTIVE).load(path)
    return s.filter(F.lower("path").endswith(".pdf") & (F.col("length") <= UPLOAD))


def submit(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``work`` on each batch of submissions; a batch that failed is run again under its number, so ``work`` writes by that number."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def states(events: DataFrame, late: str = "1 hour", ttl: int = TTL) -> DataFrame:
    """A stream of job events as a stream of changed job states; a job is dropped ``ttl`` seconds of event time after its creation, running or not."""
    e = events.select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), status_of(F.col("event_type")).alias("status"), F.col("event_type").isin("click", "view").cast("long").alias("step"))
    e = e.filter("job_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (job,) = key
        if state.hasTimedOut:
            status, steps, total, *_ = state.get
            state.remove()
            yield pd.DataFrame({"job_id": [job], "status": [status], "steps": [steps], "total": [total], "expired": [True]})
            return
        rows = pd.concat(list(frames))
        micros = [int(t.timestamp() * 1_000_000) for t in rows["ts"]]
        status, steps, total, created, at, seq = state.get if state.exists else (None, 0, 0, min(micros), min(micros), -(2**63))
        # the state is the newest row's, whatever order they come in; a job is as old as its oldest row
        newest = max(zip(micros, rows["seq"], rows["status"], strict=True), key=lambda r: r[:2])
        if newest[:2] >= (at, seq):
            at, seq, status = int(newest[0]), int(newest[1]), newest[2]
        steps, total, created = steps + int(rows["step"].sum()), total + len(rows), min(created, *micros)
        state.update((status, steps, total, created, at, seq))
        state.setTimeoutTimestamp(max(created // 1000 + 1000 * ttl, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": [job], "status": [status], "steps": [steps], "total": [total], "expired": [False]})

    return e.groupBy("job_id").applyInPandasWithState(run, CHANGED, STATE, "update", GroupStateTimeout.EventTimeTimeout)


class Progress(StreamingQueryListener):
    """Passes (batch number, rows read) of every batch to a callback, (0, 0) first."""

    def __init__(self, callback: Callable[[int, int], None]):
        self.callback = callback

    def onQueryStarted(self, event) -> None:
        self.callback(0, 0)

    def onQueryProgress(self, event) -> None:
        self.callback(event.progress.batchId, event.progress.numInputRows)

    def onQueryTerminated(self, event) -> None:
        pass
