"""Latency of an online stage: how long its micro-batches take, and whether that fits the time a batch may take."""

from __future__ import annotations

import threading
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.diagnostics import latency_percentiles


@dataclass(frozen=True)
class RealTimeProfile:
    """What an online stage says of itself; the budget is in milliseconds a batch."""

    mode: str = "unknown"
    latency_budget_ms: float | None = None
    stateful: bool = False
    adaptive: bool = False
    closed_loop_candidate: bool = False


class BatchLatency(StreamingQueryListener):
    """Milliseconds of a query's micro-batches that had rows; the first `warmup` of them are left out, and at most
    `most` are looked at. It keeps counts by millisecond, so a query that runs for months needs little room."""

    def __init__(self, name: str, warmup: int = 0, most: int | None = None):
        if warmup < 0:
            raise ValueError("warmup must not be negative")
        if most is not None and most <= 0:
            raise ValueError("most must be positive")
        self.name, self.warmup, self.most = name, warmup, most
        self.seen, self.rows, self.counts, self.ended = 0, 0, Counter(), threading.Event()
        self._id = None

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self._id = event.id

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name != self.name or p.numInputRows == 0 or (self.most is not None and self.seen >= self.most):
            return
        self.seen += 1
        self.rows += p.numInputRows
        if self.seen > self.warmup:
            self.counts[int(p.durationMs["triggerExecution"])] += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.id == self._id:
            self.ended.set()

    def samples(self, spark: SparkSession) -> DataFrame:
        """(stage, ms), a row for each batch that was counted."""
        rows = [(self.name, float(ms), n) for ms, n in sorted(self.counts.items())]
        return spark.createDataFrame(rows, "stage string, ms double, n int").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("n")))).select("stage", "ms")


def feasibility(samples: DataFrame, budget_ms: float) -> DataFrame:
    """Per stage the percentiles of (stage, ms), the batches over budget, and whether the stage is fast enough: p99
    within the budget. A stage without samples has no row, so it is not said to be fast enough."""
    if budget_ms <= 0:
        raise ValueError("the budget must be positive")
    out = latency_percentiles(samples, ["stage"], "ms", budget_ms)
    return out.withColumnRenamed("meets_budget", "feasible").withColumn("budget_ms", F.lit(float(budget_ms)))


def benchmark(stage: DataFrame, name: str, budget_ms: float, warmup: int = 0, most: int | None = None, checkpoint: str | None = None, seconds: float = 600.0) -> DataFrame:
    """Runs a streaming stage over all that its source holds now, throws its rows away, and tells whether it is feasible."""
    spark = stage.sparkSession
    listener = BatchLatency(name, warmup, most)
    spark.streams.addListener(listener)
    try:
        writer = stage.writeStream.queryName(name).format("noop").outputMode("append").trigger(availableNow=True)
        running = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
        try:
            if not running.awaitTermination(seconds):
                raise TimeoutError(f"{name} did not end in {seconds:.0f} seconds")
        finally:
            running.stop()
        listener.ended.wait(30)  # events come after the query's end
    finally:
        spark.streams.removeListener(listener)
    return feasibility(listener.samples(spark), budget_ms)
