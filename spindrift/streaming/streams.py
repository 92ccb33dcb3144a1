"""Unbounded forms: upserts by micro-batch, running progress, and a keyed rate limiter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.corpus import latest
from spindrift.operators.novelty import Prepared, novelty_guard, novelty_join, prepared
from spindrift.sources.io import work_dir


def _drained(stream: DataFrame, each, name: str, mode: str = "append") -> None:
    q = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", work_dir(stream.sparkSession, f"{name}-log")).trigger(availableNow=True).start()
    q.awaitTermination()


def stream_upsert(spark: SparkSession, stream: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Micro-batches land under their batch id (so a repeated batch replaces itself); readers take the last version of each key."""
    target = work_dir(spark, "upserts")
    _drained(stream, lambda df, batch: df.write.mode("overwrite").parquet(f"{target}/batch={batch}"), "upsert")
    return latest(spark.read.schema(stream.schema).parquet(target).select(*stream.columns), keys, version)


def stream_progress(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Running count and best score by (exercise_id, user_id); every batch writes the groups it changed."""
    target = work_dir(spark, "progress")
    running = stream.groupBy("exercise_id", "user_id").agg(F.count("*").alias("n"), F.max("score").alias("best_score"))
    _drained(running, lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{target}/b{batch}"), "progress", "update")
    return latest(spark.read.option("recursiveFileLookup", True).parquet(target), ["exercise_id", "user_id"], "batch").drop("batch")


def stream_novelty_guard(spark: SparkSession, stream: DataFrame, references: DataFrame | Prepared) -> DataFrame:
    """The guard for candidates (id, text) as they arrive, against a fixed corpus; a repeated batch replaces itself.

    The corpus is prepared once (its sets and its shingle index are written tables), and batches meet those: no batch reads a reference text."""
    target, fixed = work_dir(spark, "guarded"), prepared(references, stored=True)

    def each(df: DataFrame, batch: int) -> None:
        own = df.select("id", "text")
        novelty_guard(own, novelty_join(own, fixed)).write.mode("overwrite").parquet(f"{target}/batch={batch}")

    _drained(stream, each, "guard")
    return spark.read.parquet(target).select("candidate_id", "rejected", "offenders")


def stream_rate_limit(stream: DataFrame, limit: int, window_s: int, late: str = "1 hour") -> DataFrame:
    """``stream`` (key, ts, event_id) with ``allowed``, sliding; arrivals wait for the watermark and are released in order of time, to the microsecond.

    State of a key is what was accepted within the window (``limit`` times at most) and what waits. Arrivals behind the watermark are dropped by Spark before they come here."""
    span = window_s * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        from collections import deque

        log, waiting = state.get if state.exists else ([], [])
        log, waiting = deque(log), [tuple(x) for x in waiting]
        for b in batches:
            waiting += zip((b["ts"].astype("datetime64[us]").astype("int64")).tolist(), b["event_id"].astype("int64").tolist(), strict=True)
        mark = state.getCurrentWatermarkMs()
        waiting.sort()
        out, due = [], 0
        for at, event in waiting:
            if at > mark * 1000:
                break
            due += 1
            while log and log[0] <= at - span:
                log.popleft()
            allowed = len(log) < limit
            if allowed:
                log.append(at)
            out.append((key[0], event, allowed))
        waiting = waiting[due:]
        wake = lambda at: max(mark + 1, -(-at // 1000))
        if waiting:
            state.update((list(log), [list(x) for x in waiting]))
            state.setTimeoutTimestamp(wake(waiting[0][0]))
        elif log and log[-1] + span > mark * 1000:
            state.update((list(log), []))
            state.setTimeoutTimestamp(wake(log[-1] + span))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "event_id", "allowed"])

    marked = stream.withWatermark("ts", late)
    return marked.groupBy("key").applyInPandasWithState(step, "key string, event_id long, allowed boolean", "log array<long>, waiting array<array<long>>", "append", "EventTimeTimeout")
