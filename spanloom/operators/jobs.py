"""The job log: status, expiry, admission, names. Batch forms; ``spanloom.streaming`` has the continuous ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds a job is kept, jobs at once, bytes of an upload, progress steps.
TTL, ACTIVE, UPLOAD = 600, 2, 50 * 1024 * 1024
STATUS = {"signup": "processing", "click": "processing", "view": "processing", "purchase": "done", "error": "error"}


def status_of(event_type: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv)), event_type)


def log(events: DataFrame) -> DataFrame:
    """Events as a job log: job_id, ts, seq, status, step."""
    return events.filter(F.col("user_id").isNotNull()).select(
        F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), status_of(F.col("event_type")).alias("status"), F.col("event_type").isin("click", "view").cast("int").alias("step")
    )


def latest(rows: DataFrame) -> DataFrame:
    """A job's last state, its progress so far, and when it was created; a total only where there is progress, percent rounded."""
    order = F.struct("ts", "seq")
    s = rows.groupBy("job_id").agg(F.max_by("status", order).alias("status"), F.sum("step").alias("steps"), F.count(F.lit(1)).alias("total"), F.min("ts").alias("created"))
    return s.select("job_id", "status", "created", F.when(F.col("steps") > 0, F.col("steps")).alias("progress"), F.when(F.col("steps") > 0, F.col("total")).alias("total"), F.when(F.col("steps") > 0, F.floor(100.0 * F.col("steps") / F.col("total") + 0.5)).cast("long").alias("percent"))


def expired(jobs: DataFrame, now: Column, ttl: int = TTL) -> DataFrame:
    """Jobs created longer ago than they are kept, running ones too."""
    return jobs.filter(F.col("created") < now - F.expr(f"INTERVAL {ttl} SECONDS"))


def admission(events: DataFrame, servers: int = 8, active: int = ACTIVE, ttl: int = TTL) -> DataFrame:
    """For each submission on its server: jobs active just before it, and whether it is let in. A refused submission never becomes active.

    Whether a submission counts depends on those before it, so a server's log is a fold: rows of a server stream in order, and
    the state is the set of its active jobs, ``active`` of them at most. A submission first drops jobs of more than ``ttl`` seconds, running or not;
    an end of a job that is not active changes nothing.
    """
    e = events.filter(F.col("user_id").isNotNull() & F.col("event_type").isin("signup", "purchase", "error"))
    e = e.select(F.pmod(F.col("user_id"), F.lit(servers)).cast("int").alias("server"), "ts", "event_id", "user_id", (F.col("event_type") == "signup").alias("asks"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        server, live = None, {}
        for pdf in frames:
            out = []
            for s, ts, i, job, asks in zip(*(pdf[c] for c in ("server", "ts", "event_id", "user_id", "asks")), strict=True):
                if s != server:
                    server, live = s, {}
                if asks:
                    live = {k: t for k, t in live.items() if (ts - t).total_seconds() <= ttl}
                    out.append((i, s, len(live), len(live) < active))
                    if len(live) < active:
                        live[job] = ts
                else:
                    live.pop(job, None)
            yield pd.DataFrame(out, columns=["event_id", "server", "n_active", "admitted"])

    return e.repartition(servers, "server").sortWithinPartitions("server", "ts", "event_id").mapInPandas(run, "event_id long, server int, n_active int, admitted boolean")


def acceptable(name: Column, size: Column) -> Column:
    """Why an upload is refused: ``suffix``, ``size``, or null."""
    return F.when(~F.lower(name).endswith(".pdf"), "suffix").when(size > UPLOAD, "size")


def output_name(name: Column, target: str | None = None) -> Column:
    """The result's file name: up to the last dot, then ``-translated`` or ``-<target>``."""
    stem = F.regexp_replace(name, "\\.[^.]*$", "")
    return F.concat(stem, F.lit(f"-{target}.pdf" if target else "-translated.pdf"))


def download(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """Answers to downloads (job_id): 404 for unknown jobs, 400 for those not done, 200 with the rest."""
    known = jobs.select("job_id", "status")
    code = F.when(F.col("status").isNull(), 404).when(F.col("status") != "done", 400).otherwise(200)
    return asked.join(known, "job_id", "left").select("job_id", code.alias("code"))
