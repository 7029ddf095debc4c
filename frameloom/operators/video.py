"""Stages over videos: frames(frame, height, width, pixels) in, frames or candidates out.

What looks at one frame is a kernel on Arrow batches. What looks along time takes chunks of frames with as many frames of
their neighbours as it reaches (temporal_highpass), or, where every frame depends on all before it, rows of pixels over all
times (ewma_scores). Frames are numbered without gaps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .candidates import priority, ranked
from .regions import grown
from .signal import annular_cfar, gaussian_weights, labelled, pixels

FRAMES = "frame int, height int, width int, pixels array<float>"


def per_frame(frames: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """kernel(image) of the same size in place of each frame's image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            images = (np.asarray(r.pixels, np.float64).reshape(int(r.height), int(r.width)) for r in rows.itertuples())
            yield rows.assign(pixels=[kernel(x).astype(np.float32).ravel() for x in images])

    return frames.select("frame", "height", "width", "pixels").mapInPandas(run, FRAMES)


def temporal_highpass(frames: DataFrame, sigma_frames: float = 6.0, chunk: int = 64) -> DataFrame:
    """Frames less their Gaussian average along time; before the first and after the last frame the end frames hold.

    A chunk is worked on with the frames around it that the average reaches, so the result does not depend on its size.
    Chunks are at least as long as that reach, so a frame is sent to three chunks at most.
    """
    if sigma_frames <= 0:
        return frames.select("frame", "height", "width", "pixels")
    weights = gaussian_weights(sigma_frames)
    reach = len(weights) // 2
    size = max(chunk, reach)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame")
        numbers = rows["frame"].to_numpy()
        if (np.diff(numbers) != 1).any():
            raise ValueError("frames are numbered without gaps or repeats")
        stack = np.stack([np.asarray(x, np.float64) for x in rows["pixels"]])
        own = np.flatnonzero(numbers // size == key[0])
        low = np.zeros((len(own), stack.shape[1]))
        for k, w in zip(range(-reach, reach + 1), weights, strict=True):
            low += w * stack[np.clip(own + k, 0, len(stack) - 1)]
        out = rows.iloc[own].copy()
        out["pixels"] = pd.Series(list((stack[own] - low).astype(np.float32)), out.index, object)  # may be none
        return out[["frame", "height", "width", "pixels"]]

    first, last = F.floor((F.col("frame") - reach) / size), F.floor((F.col("frame") + reach) / size)
    near = frames.select(F.explode(F.sequence(first, last)).alias("_part"), "frame", "height", "width", "pixels")
    return near.groupBy("_part").applyInPandas(run, FRAMES)


def spatial_gaussian(frames: DataFrame, sigma_px: float = 0.8) -> DataFrame:
    """Frames weighted by a Gaussian around each pixel; beyond the edges the edge pixels hold."""
    if sigma_px <= 0:
        return frames.select("frame", "height", "width", "pixels")
    weights = gaussian_weights(sigma_px)
    reach = len(weights) // 2

    def along(image: np.ndarray, axis: int) -> np.ndarray:
        padded = np.pad(image, [(reach, reach) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        return sum(w * padded.take(range(k, k + image.shape[axis]), axis) for k, w in enumerate(weights))

    return per_frame(frames, lambda image: along(along(image, 0), 1))


def frame_robust_z(frames: DataFrame, local_radius_px: int = 11, epsilon: float = 1.0) -> DataFrame:
    """How far pixels lie above their frame's median, in scaled median deviations plus epsilon, not below 0.

    local_radius_px belongs to the stage's parameters, but the score is that of the whole frame.
    """

    def kernel(image: np.ndarray) -> np.ndarray:
        above = image - np.median(image)
        return np.maximum(above / np.maximum(1.4826 * np.median(np.abs(above)) + epsilon, 1e-12), 0)

    return per_frame(frames, kernel)


def truncated_box_sums(image: np.ndarray, radius: int) -> np.ndarray:
    """Sum over the part of the square of that radius around each pixel that lies in the image."""
    (h, w), total = image.shape, np.pad(image, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    y, x = np.arange(h), np.arange(w)
    top, bottom, left, right = np.maximum(y - radius, 0), np.minimum(y + radius, h - 1) + 1, np.maximum(x - radius, 0), np.minimum(x + radius, w - 1) + 1
    return total[np.ix_(bottom, right)] - total[np.ix_(top, right)] - total[np.ix_(bottom, left)] + total[np.ix_(top, left)]


def event_preserving_z(frames: DataFrame, local_window_px: int = 23, epsilon: float = 1.0, floor: float = 0.25, spatial_sigma_px: float = 1.0, temporal_window_frames: int = 3) -> DataFrame:
    """How far pixels above their frame's median lie above the mean around them, in deviations of that surrounding plus epsilon; 0 for others.

    The surrounding is a square window, cut at the edges. A deviation counts as epsilon and as the share `floor` of the
    frame's scaled median deviation at least. The last two belong to the stage's parameters, but the score is that of a frame.
    """
    radius = local_window_px // 2

    def kernel(image: np.ndarray) -> np.ndarray:
        signal = (image - np.median(image)).astype(np.float32).astype(np.float64)
        least = max(epsilon, floor * 1.4826 * float(np.median(np.abs(signal))))
        area = truncated_box_sums(np.ones_like(signal), radius)
        mean = truncated_box_sums(signal, radius) / area
        variance = np.maximum(truncated_box_sums(signal**2, radius) / area - mean**2, 0)
        return np.where(signal > 0, (signal - mean) / (np.maximum(np.sqrt(variance), least) + epsilon), 0)

    return per_frame(frames, kernel)


def supported_mask(frames: DataFrame, threshold: float, least: int = 2) -> DataFrame:
    """1 where a pixel reaches the threshold and so do `least` pixels of the 3 by 3 around it, itself included; else 0."""

    def kernel(image: np.ndarray) -> np.ndarray:
        active = image >= threshold
        return active & (truncated_box_sums(active.astype(float), 1) >= least)

    return per_frame(frames, kernel)


def candidate_events(frames: DataFrame, event_threshold_z: float = 2.4, min_area_px: int = 4, grow_z: float = 1.1, max_area_px: int = 300) -> DataFrame:
    """Accepted regions of frames of z scores: grown from pixels at the threshold over connected pixels at grow_z."""
    found = grown(pixels(frames), event_threshold_z, min(grow_z, event_threshold_z), min_area_px, max_area_px)
    return found.where("reason = 'accepted'").drop("reason", "region")


def cfar_mask(frames: DataFrame, pfa: float = 0.001, guard_px: int = 2, training_radius_px: int = 11, epsilon: float = 1e-6, update_alpha: float | None = None) -> DataFrame:
    """1 where a pixel's positive part stands out from the ring around it, else 0. update_alpha is taken, but changes nothing."""
    if not 0 <= guard_px < training_radius_px:
        raise ValueError("the training radius must be larger than the guard, and that not below 0")
    alarm = min(max(pfa, float(np.finfo(np.float32).tiny)), 1.0)
    return per_frame(frames, lambda image: annular_cfar(np.maximum(image, 0), guard_px, training_radius_px, alarm, epsilon)[1])


def registered(frames: DataFrame, max_shift_px: int = 4, reference: str = "first") -> DataFrame:
    """Frames moved by the whole shift that brings them onto the reference best (first frame, or mean of all); 0 moves in.

    The reference is one image: it is joined to the frames, not collected.
    """
    if reference == "first":
        base = frames.agg(F.min_by("pixels", "frame").alias("_base"))
    elif reference == "mean":
        means = frames.select(F.posexplode("pixels").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("v"))
        base = means.agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("a")).select(F.col("a.v").cast("array<float>").alias("_base"))
    else:
        raise ValueError("the reference is first or mean")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                image, target = (np.asarray(x, np.float64).reshape(int(r.height), int(r.width)) for x in (r.pixels, r.base))
                out.append(best_shift(image, target, max_shift_px)[2].astype(np.float32).ravel())
            yield rows.drop(columns="base").assign(pixels=out)

    both = frames.select("frame", "height", "width", "pixels").crossJoin(F.broadcast(base)).withColumnRenamed("_base", "base")
    return both.mapInPandas(run, FRAMES)


def best_shift(image: np.ndarray, reference: np.ndarray, most: int) -> tuple[int, int, np.ndarray]:
    """(dy, dx, moved image) of the whole shift with the largest product with the centred reference; the first of equals."""
    centred, (h, w) = reference - reference.mean(), image.shape
    best: tuple[float, int, int, np.ndarray] | None = None
    for dy in range(-most, most + 1):
        for dx in range(-most, most + 1):
            moved = np.zeros_like(image)
            if abs(dy) < h and abs(dx) < w:
                moved[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] = image[max(-dy, 0) : h + min(-dy, 0), max(-dx, 0) : w + min(-dx, 0)]
            score = float((moved * centred).sum())
            if best is None or score > best[0]:
                best = (score, dy, dx, moved)
    return best[1:]


def ewma_scores(frames: DataFrame, alpha: float = 0.02, threshold_z: float = 3.0, epsilon: float = 1.0) -> DataFrame:
    """Each pixel's z against its running mean and variance before the frame, 0 where it is below threshold_z.

    The mean starts at the first frame and the variance at 1; epsilon is added to the deviation. The unit of work is a row
    of pixels over all times.
    """
    row = F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y")
    rows = frames.select("frame", "height", "width", row, "pixels").withColumn("pixels", F.slice("pixels", F.col("y") * F.col("width") + 1, F.col("width")))

    def run(data: pd.DataFrame) -> pd.DataFrame:
        data = data.sort_values("frame")
        mean, variance, out = None, 1.0, []
        for values in data["pixels"]:
            v = np.asarray(values, np.float64)
            mean = v if mean is None else mean
            error = v - mean
            z = error / (np.sqrt(variance) + epsilon)
            mean, variance = mean + alpha * error, (1 - alpha) * variance + alpha * error * error
            out.append(np.where(z >= threshold_z, z, 0).astype(np.float32))
        return data.assign(pixels=out)

    scored = rows.groupBy("y").applyInPandas(run, "frame int, height int, width int, y int, pixels array<float>")
    whole = scored.groupBy("frame", "height", "width").agg(F.array_sort(F.collect_list(F.struct("y", "pixels"))).alias("a"))
    return whole.select("frame", "height", "width", F.flatten("a.pixels").alias("pixels"))


def projected_components(frames: DataFrame, seed_z: float = 2.0, grow_z: float = 1.1, min_area_px: int = 8, max_area_px: int = 260) -> DataFrame:
    """The connected parts (by edges) of the largest values over all frames that reach seed_z, of an area in the bounds.

    id, x, y (centre), area_px, peak_z, bbox (first and last x and y: x0, y0, x1, y1). Numbers follow reading order.
    grow_z belongs to the stage's parameters, but parts are not grown. Largest values are taken in each task first, so the
    last one holds an image for each task.
    """

    def largest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, size = None, None
        for rows in batches:
            for r in rows.itertuples():
                image = np.asarray(r.pixels, np.float32)
                best, size = (image if best is None else np.maximum(best, image)), (r.height, r.width)
        if best is not None:
            yield pd.DataFrame({"height": [size[0]], "width": [size[1]], "pixels": [best]})

    def parts(rows: pd.DataFrame) -> pd.DataFrame:
        top = np.max(np.stack(rows["pixels"]), axis=0).reshape(int(rows["height"].iloc[0]), int(rows["width"].iloc[0]))
        marks, found = labelled(top >= seed_z, eight=False), []
        y, x = np.nonzero(marks)
        order = np.argsort(marks[y, x], kind="stable")
        y, x = y[order], x[order]
        ends = np.cumsum(np.bincount(marks[y, x], minlength=1)[1:])
        for b, e in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=False):
            if min_area_px <= e - b <= max_area_px:
                own_y, own_x = y[b:e], x[b:e]
                box = [int(own_x.min()), int(own_y.min()), int(own_x.max()), int(own_y.max())]
                found.append((f"roi_{len(found) + 1:03d}", own_x.mean(), own_y.mean(), e - b, float(top[own_y, own_x].max()), box))
        return pd.DataFrame(found, columns=["id", "x", "y", "area_px", "peak_z", "bbox"])

    tops = frames.select("height", "width", "pixels").mapInPandas(largest, "height int, width int, pixels array<float>")
    return tops.groupBy().applyInPandas(parts, "id string, x double, y double, area_px int, peak_z double, bbox array<int>")


def prioritised(candidates: DataFrame, local_correlation_weight: float = 0.2, event_support_weight: float = 0.2, artifact_weight: float = -0.15) -> DataFrame:
    """candidates with priority_score, from the features that they have, and rank by it, then id."""
    weights = {"local_correlation": local_correlation_weight, "event_support": event_support_weight, "artifact_score": artifact_weight}
    scored = candidates.withColumn("priority_score", priority({c: F.col(c) for c in candidates.columns}, weights=weights))
    return ranked(scored, "priority_score", "id")
