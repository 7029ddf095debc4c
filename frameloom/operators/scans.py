"""Scans of ordered series that carry a state from one value to the next: any length, in time that grows with it.

A key's rows are dealt to one task and sorted there; the task folds them batch by batch and holds the state of one key
only, so neither a series nor its results are gathered. The same folds run on streams with the state kept by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

State = tuple[float, ...]
#: fold(state or None, values in order) -> (a result for each value, state)
Fold = Callable[[State | None, np.ndarray], tuple[np.ndarray, State]]


def kalman_fold(gain: float = 0.08, spike_gain: float = 0.015, spike: float = 2.5, negative_gain: float = 0.11, noise: float = 1.0) -> Fold:
    """Positive innovations over a level that follows slow change fast and events slowly; it starts at the first value."""

    def fold(state: State | None, values: np.ndarray) -> tuple[np.ndarray, State]:
        level, out = (float(values[0]) if state is None else state[0]), np.empty(len(values))
        for k, x in enumerate(values.tolist()):
            e = x - level
            level += (negative_gain if e < 0 else spike_gain if e > spike * noise else gain) * e
            out[k] = e / noise if e > 0 else 0.0
        return out, (level,)

    return fold


def ewma_fold(alpha: float, floor: float = 1e-6) -> Fold:
    """z of each value against mean and variance before it; the mean starts at the first value, the variance at 1."""

    def fold(state: State | None, values: np.ndarray) -> tuple[np.ndarray, State]:
        mean, variance = (float(values[0]), 1.0) if state is None else state
        out = np.empty(len(values))
        for k, x in enumerate(values.tolist()):
            e = x - mean
            out[k] = e / (variance + floor) ** 0.5
            mean, variance = mean + alpha * e, (1 - alpha) * variance + alpha * e * e
        return out, (mean, variance)

    return fold


def apart_fold(least: float) -> Fold:
    """1 for places at least so far from the last one that got 1, else 0; the first gets 1."""

    def fold(state: State | None, values: np.ndarray) -> tuple[np.ndarray, State]:
        last, out = (-np.inf if state is None else state[0]), np.zeros(len(values))
        for k, x in enumerate(values.tolist()):
            if x - last >= least:
                out[k], last = 1.0, x
        return out, (last,)

    return fold


def scanned(rows: DataFrame, by: Sequence[str], at: str, value: str, fold: Fold, out: str = "z") -> DataFrame:
    """rows with the fold's result for each value, key by key in the order of `at`; a null value is NaN to the fold.

    A null in `by` is a key of its own. Rows of a key at the same place are taken in the order of their values.
    """
    names = rows.columns
    wide = rows.withColumn("_key", F.to_json(F.struct(*by), {"ignoreNullFields": "false"})).withColumn("_v", F.col(value).cast("double"))
    wide = wide.repartition(*[F.col(c) for c in by]).sortWithinPartitions("_key", at, "_v")
    schema = "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in rows.schema) + f",`{out}`:double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("_key").dictionary_encode()
            codes, values = keys.indices.to_numpy(), batch.column("_v").to_numpy(zero_copy_only=False)
            result = np.empty(len(values))
            bounds = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
            for start, stop in zip(bounds, bounds[1:], strict=False):
                own = keys.dictionary[int(codes[start])].as_py()
                result[start:stop], state = fold(state if own == key else None, values[start:stop])
                key = own
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(result)], [*names, out])

    return wide.mapInArrow(run, schema.removeprefix("struct<").removesuffix(">").replace("`:", "` "))


def scanned_stream(rows: DataFrame, at: str, value: str, fold: Fold, numbers: int) -> DataFrame:
    """A stream (key, frame, value) with z, the fold's result; numbers: how many the fold's state has.

    Within a micro-batch frames are put in order; a frame that is not behind the last one of its key is dropped.
    """
    state = ", ".join([f"s{k} double" for k in range(numbers)] + ["frame long"])

    def step(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(batches), ignore_index=True).sort_values(["frame", "value"], kind="stable")
        held = kept.get if kept.exists else None
        if held is not None:
            data = data[data["frame"] > held[-1]]
        if len(data):
            z, new = fold(None if held is None else tuple(held[:-1]), data["value"].to_numpy(float))
            kept.update((*map(float, new), int(data["frame"].iloc[-1])))
            yield data[["key", "frame", "value"]].assign(z=z)

    typed = rows.select("key", F.col(at).cast("long").alias("frame"), F.col(value).cast("double").alias("value"))
    return typed.groupBy("key").applyInPandasWithState(step, "key string, frame long, value double, z double", state, "append", GroupStateTimeout.NoTimeout)


def spaced_peaks(peaks: DataFrame, by: Sequence[str], at: str, least: float) -> DataFrame:
    """Places of peaks (by, at) at least so far from the one kept before them, from the first on."""
    return scanned(peaks.select(*by, at).distinct(), by, at, at, apart_fold(least), "_kept").where("_kept > 0").drop("_kept")


def trace_events(traces: DataFrame, event_threshold_z: float, by: Sequence[str] = ("id",)) -> DataFrame:
    """(by, frame, z) of traces (by, frame, value) where the robust z of the value in its trace reaches the threshold."""
    from .signal import counted_robust_z

    return counted_robust_z(traces, by, "value").where(F.col("z") >= event_threshold_z).select(*by, "frame", "z")


def innovation_events(traces: DataFrame, event_threshold_z: float = 2.4, kalman_gain: float = 0.06, spike_gain: float = 0.008, by: Sequence[str] = ("id",)) -> DataFrame:
    """(by, frame, z) of traces (by, frame, value) where the positive innovation reaches the threshold."""
    found = scanned(traces.select(*by, "frame", "value"), by, "frame", "value", kalman_fold(kalman_gain, spike_gain))
    return found.where(F.col("z") >= event_threshold_z).select(*by, "frame", "z")
