"""Online scoring of series: a state of a few numbers for each key, and a batch twin that gives the same scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCORED = "key string, frame int, value double, z double, hit boolean"
_STATE = "mean double, variance double, frame int"


def ewma_step(mean: float, variance: float, value: float, alpha: float) -> tuple[float, float, float]:
    """(z, new mean, new variance): z against the state before the value; the variance follows the distance from the old mean."""
    error = value - mean
    return error / np.sqrt(variance + 1e-6), mean + alpha * error, (1 - alpha) * variance + alpha * error * error


def _fold(values: pd.DataFrame, state: tuple[float, float, int] | None, alpha: float, threshold: float) -> tuple[pd.DataFrame, tuple[float, float, int] | None]:
    values = values.sort_values("frame", kind="stable")
    z = []
    for frame, value in zip(values["frame"], values["value"], strict=True):
        mean, variance, _ = state or (float(value), 1.0, -1)
        score, mean, variance = ewma_step(mean, variance, float(value), alpha)
        state = (mean, variance, int(frame))
        z.append(score)
    out = values[["key", "frame", "value"]].assign(z=z)
    return out.assign(hit=out["z"] > threshold), state


def ewma_batch(rows: DataFrame, alpha: float, threshold: float) -> DataFrame:
    """Scores of a table (key, frame, value): each key's series is folded in the order of frames."""
    return rows.select("key", F.col("frame").cast("int").alias("frame"), F.col("value").cast("double").alias("value")).groupBy("key").applyInPandas(lambda x: _fold(x, None, alpha, threshold)[0], SCORED)


def ewma_stream(rows: DataFrame, alpha: float, threshold: float) -> DataFrame:
    """Scores of a stream (key, frame, value). Within a micro-batch frames are put in order; a frame that comes after a
    later one of its key was scored is dropped, as the state has moved past it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        values = pd.concat(list(batches), ignore_index=True)
        held = state.get if state.exists else None
        if held is not None:
            values = values[values["frame"] > held[2]]
        out, held = _fold(values, held, alpha, threshold)
        if held is not None:
            state.update(held)
        yield out

    typed = rows.select("key", F.col("frame").cast("int").alias("frame"), F.col("value").cast("double").alias("value"))
    return typed.groupBy("key").applyInPandasWithState(step, SCORED, _STATE, "append", GroupStateTimeout.NoTimeout)


def frame_stream(spark: SparkSession, path: str, schema: str, rate: float, files: int = 1) -> DataFrame:
    """A stream of frame files (Parquet) with the seconds of each frame."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows.withColumn("timestamp_sec", F.col("frame") / F.lit(rate))


def windowed_counts(rows: DataFrame, at: str, key: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts by key over tumbling or sliding windows of event time; rows later than `late` are left out of a stream."""
    own = F.window(at, width, slide) if slide else F.window(at, width)
    return rows.withWatermark(at, late).groupBy(own.alias("w"), key).agg(F.count("*").alias("n")).select("w.start", "w.end", key, "n")


def sessions(rows: DataFrame, at: str, key: str, gap: str, late: str) -> DataFrame:
    """Counts of rows of a key with no pause longer than `gap`."""
    return rows.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select("w.start", "w.end", key, "n")
