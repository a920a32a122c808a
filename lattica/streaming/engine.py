"""Batch tasks as streams: items are read in micro-batches, worked on, counted, and checkpointed, until a limit is met."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.plans.storage import shared_folder


@dataclass
class Limits:
    """When a task stops: after so many items or batches, or seconds, or when a test on its counters says so."""

    items: int | None = None
    batches: int | None = None
    seconds: float | None = None
    test: Callable[[dict], bool] | None = None


@dataclass
class State:
    """The counters of a task."""

    counters: dict[str, int] = field(default_factory=lambda: {"items": 0, "batches": 0})
    started: float = field(default_factory=time.time)

    def bump(self, name: str, by: int) -> None:
        self.counters[name] = self.counters.get(name, 0) + by


def run(source: DataFrame, work: Callable[[DataFrame, int], dict[str, int] | None], name: str, limits: Limits | None = None, before: Callable[[DataFrame, int], None] | None = None, after: Callable[[DataFrame, int], None] | None = None, checkpoint: str | None = None, timeout: float = 600) -> State:
    """Works through what a streaming source has now. work(batch, number) returns counters to add. A batch is done once; after a
    failure the task goes on from the checkpoint with the batch that was not finished, under the same number, so that work must
    write under it."""
    limits, state = limits or Limits(), State()
    spark = source.sparkSession
    place = checkpoint or f"{shared_folder(spark)}/tasks/{name}"
    done = {"stop": False}

    def batch(rows: DataFrame, number: int) -> None:
        if done["stop"]:  # a batch that returned would count as done
            raise RuntimeError("the task has stopped")
        if before:
            before(rows, number)
        counted = work(rows, number) or {}
        if "items" not in counted:
            counted["items"] = rows.count()
        for k, v in counted.items():
            state.bump(k, v)
        state.bump("batches", 1)
        if after:
            after(rows, number)
        c = state.counters
        done["stop"] = bool((limits.items and c["items"] >= limits.items) or (limits.batches and c["batches"] >= limits.batches) or (limits.seconds and time.time() - state.started >= limits.seconds) or (limits.test and limits.test(c)))

    query = source.writeStream.foreachBatch(batch).option("checkpointLocation", place).trigger(availableNow=True).queryName(name).start()
    _await(query, timeout, done)
    return state


def _await(query: StreamingQuery, timeout: float, done: dict) -> None:
    until = time.time() + timeout
    while query.isActive and time.time() < until:
        try:
            if query.awaitTermination(0.2):
                return
        except StreamingQueryException:
            if done["stop"]:
                return
            raise
        if done["stop"]:
            query.stop()
            return
    if query.isActive:
        query.stop()
        raise TimeoutError(f"the task took more than {timeout} seconds")


def items(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100, format: str = "parquet") -> DataFrame:
    """A queue of files: each micro-batch takes so many."""
    return spark.readStream.schema(schema).format(format).option("maxFilesPerTrigger", files_per_batch).load(path)


def line_items(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def without_repeats(source: DataFrame, keys: list[str], time_column: str | None = None, within: str | None = None) -> DataFrame:
    """A queue that passes an item on once; with a time column, repeats are known for as long as `within` says, and state is bounded."""
    if time_column and within:
        return source.withWatermark(time_column, within).dropDuplicatesWithinWatermark(keys)
    return source.dropDuplicates(keys)


def counters(source: DataFrame, keys: list[str], value: str, into: str = "total") -> DataFrame:
    """A running table of totals, kept as state."""
    return source.groupBy(*keys).agg(F.sum(value).alias(into), F.count("*").alias("n"))


def windowed(source: DataFrame, time_column: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Totals by window of event time; rows later than `late` are left out, and closed windows leave the state."""
    timed = source.withWatermark(time_column, late)
    return timed.groupBy(F.window(time_column, width), *keys).agg(F.sum(value).alias("total"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "total", "n")


def sessions(source: DataFrame, time_column: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    timed = source.withWatermark(time_column, late)
    return timed.groupBy(F.session_window(time_column, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def branch_writer(path: str) -> Callable[[DataFrame, int], dict[str, int]]:
    """Work that writes each batch as a branch of its own, named by the batch: a repeated batch replaces its branch."""

    def write(rows: DataFrame, number: int) -> dict[str, int]:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        return {}

    return write


def merge_branches(spark: SparkSession, path: str) -> DataFrame:
    """All branches as one set."""
    return spark.read.parquet(path).drop("batch").distinct()
