"""Kernels over images and stacks: gamma filters, clutter-adaptive detection, background folds, peaks, regions, shapes."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .signal import box_sums, by_frame


def gamma_decay(half_decay: float) -> float:
    """The rate at which a gamma kernel of order 1 falls to a half at that distance; 0 switches it off."""
    return math.log(2) / half_decay if half_decay > 0 else 0.0


def gamma_profile(size: int, rate: float) -> np.ndarray:
    """Weights exp(-rate * distance) over an odd number of places, summing to 1."""
    r = np.abs(np.arange(size) - size // 2)
    k = np.exp(-rate * r)
    return k / k.sum()


def gamma_disc(size: int, rate: float) -> np.ndarray:
    y, x = np.mgrid[:size, :size] - size // 2
    k = np.exp(-rate * np.hypot(y, x))
    return k / k.sum()


def convolved(image: np.ndarray, kernel: np.ndarray, mode: str = "constant") -> np.ndarray:
    """The image weighted by a symmetric kernel around each pixel; beyond the edges 0, or mirrored (reflect)."""
    h, w = (s // 2 for s in kernel.shape)
    padded = np.pad(image, ((h, h), (w, w)), mode=mode)
    spectrum = np.fft.rfft2(padded) * np.fft.rfft2(kernel, padded.shape)
    full = np.fft.irfft2(spectrum, padded.shape)
    return full[kernel.shape[0] - 1 :, kernel.shape[1] - 1 :][: image.shape[0], : image.shape[1]]


def gamma_cfar(image: np.ndarray, rate: float, size: int = 23, eps: float = 1e-3) -> np.ndarray:
    """Each pixel's distance from the weighted mean around it, in weighted deviations."""
    kernel = gamma_disc(size, rate)
    mean = convolved(image, kernel, "reflect")
    spread = np.sqrt(np.maximum(convolved(image * image, kernel, "reflect") - mean * mean, 0))
    return (image - mean) / (spread + eps)


def temporal_gamma(long: DataFrame, rate: float, size: int = 19, by: Sequence[str] = ("y", "x"), at: str = "frame", value: str = "v") -> DataFrame:
    """A dense pixel table with `value` replaced by its gamma-weighted average along time; beyond the ends 0."""
    weights = gamma_profile(size, rate).tolist() if rate > 0 else [1.0]
    order, total = Window.partitionBy(*by).orderBy(at), F.lit(0.0)
    for k, w in zip(range(-(len(weights) // 2), len(weights) // 2 + 1), weights, strict=True):
        total = total + w * F.coalesce(F.lag(value, -k).over(order) if k < 0 else F.lead(value, k).over(order) if k else F.col(value), F.lit(0.0))
    return long.withColumn(value, total)


def stage_scores(frames: DataFrame, spatial_rate: float, cfar_rate: float, size: int = 23) -> DataFrame:
    """(frame, y, x, z) of one detection stage: spatial gamma filter, then clutter-adaptive score. A second stage takes these as frames."""

    def kernel(frame: int, image: np.ndarray) -> pd.DataFrame:
        smooth = convolved(image, gamma_disc(size, spatial_rate)) if spatial_rate > 0 else image
        z = gamma_cfar(smooth, cfar_rate, size)
        y, x = np.indices(z.shape)
        return pd.DataFrame({"frame": frame, "y": y.ravel(), "x": x.ravel(), "z": z.ravel()})

    return by_frame(frames, kernel, "frame int, y int, x int, z double")


def correntropy_fold(trace: Column, rate: float, sigma: float) -> Column:
    """Array of a pixel's background: a fold that follows small errors and hardly moves for large ones."""
    start = F.struct(F.element_at(trace, 1).cast("double").alias("x"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, v: Column) -> Column:
        e = v.cast("double") - s["x"]
        x = s["x"] + rate / sigma**2 * F.exp(-e * e / (2 * sigma**2)) * e
        return F.struct(x.alias("x"), F.concat(s["out"], F.array(x)).alias("out"))

    return F.when(F.size(trace) > 0, F.aggregate(trace, start, step, lambda s: s["out"]))


def peaks(frames: DataFrame, threshold: float, radius: int, apart: float, most: int) -> DataFrame:
    """Per frame the strongest pixels that reach a threshold and all others within a radius, no two closer than `apart`."""

    def kernel(frame: int, image: np.ndarray) -> pd.DataFrame:
        padded = np.pad(image, radius, constant_values=-np.inf)
        top = np.max([padded[dy : dy + image.shape[0], dx : dx + image.shape[1]] for dy in range(2 * radius + 1) for dx in range(2 * radius + 1)], axis=0)
        y, x = np.nonzero((image >= threshold) & (image >= top))
        order = np.lexsort((x, y, -image[y, x]))
        kept: list[tuple[int, int]] = []
        for k in order.tolist():
            if len(kept) < most and all(math.hypot(y[k] - a, x[k] - b) >= apart for a, b in kept):
                kept.append((int(y[k]), int(x[k])))
        return pd.DataFrame({"frame": frame, "place": range(len(kept)), "y": [a for a, _ in kept], "x": [b for _, b in kept], "v": [float(image[p]) for p in kept]})

    return by_frame(frames, kernel, "frame int, place int, y int, x int, v double")


def grown(image: np.ndarray, y: int, x: int, level: float, radius: float) -> np.ndarray:
    """The pixels at or over a level that hang together with a seed (edges or corners) and lie within a radius of it."""
    yy, xx = np.indices(image.shape)
    allowed = (image >= level) & (np.hypot(yy - y, xx - x) <= radius)
    out = np.zeros(image.shape, bool)
    out[y, x] = True
    while True:
        padded = np.pad(out, 1)
        near = np.max([padded[dy : dy + out.shape[0], dx : dx + out.shape[1]] for dy in range(3) for dx in range(3)], axis=0)
        new = out | (near & allowed)
        if np.array_equal(new, out):
            return out
        out = new


def local_correlation(long: DataFrame) -> DataFrame:
    """(y, x, coherence): the mean correlation of a pixel's trace with its four neighbours', put from -1..1 to 0..1."""
    shifts = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0))]))
    a = long.select("frame", F.col("y").alias("ya"), F.col("x").alias("xa"), F.col("v").alias("va"), shifts.alias("n"))
    b = long.select("frame", F.col("y").alias("yb"), F.col("x").alias("xb"), F.col("v").alias("vb"))
    pairs = a.join(b, (a["frame"] == b["frame"]) & (F.col("n.y") == F.col("yb")) & (F.col("n.x") == F.col("xb")))
    m = pairs.groupBy("ya", "xa", "yb", "xb").agg(F.covar_pop("va", "vb").alias("c"), F.stddev_pop("va").alias("sa"), F.stddev_pop("vb").alias("sb"))
    r = F.when((F.col("sa") > 0) & (F.col("sb") > 0), F.col("c") / (F.col("sa") * F.col("sb"))).otherwise(0.0)
    return m.groupBy(F.col("ya").alias("y"), F.col("xa").alias("x")).agg(((F.avg(r) + 1) / 2).alias("coherence"))


def radial_power(frames: DataFrame, bins: int) -> DataFrame:
    """(frame, bin, power): mean spectral power of each frame's centred image by distance from zero frequency."""

    def kernel(frame: int, image: np.ndarray) -> pd.DataFrame:
        power = np.abs(np.fft.fftshift(np.fft.fft2(image - image.mean()))) ** 2
        y, x = np.indices(power.shape)
        r = np.hypot(y - power.shape[0] // 2, x - power.shape[1] // 2)
        part = np.minimum((r / (r.max() + 1e-9) * bins).astype(int), bins - 1)
        n = np.bincount(part.ravel(), minlength=bins)
        return pd.DataFrame({"frame": frame, "bin": range(bins), "power": np.bincount(part.ravel(), power.ravel(), bins) / np.maximum(n, 1)})

    return by_frame(frames, kernel, "frame int, bin int, power double")


def circle_pixels(circles: DataFrame) -> DataFrame:
    """(region, y, x) of the pixels within each circle (region, cx, cy, radius)."""
    reach = lambda c: F.explode(F.sequence(F.ceil(c - F.col("radius")).cast("int"), F.floor(c + F.col("radius")).cast("int")))
    rows = circles.where("radius >= 0").withColumn("y", reach(F.col("cy"))).withColumn("x", reach(F.col("cx")))
    return rows.where(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) <= F.col("radius")).select("region", "y", "x")


def lasso_pixels(lassos: DataFrame) -> DataFrame:
    """(region, y, x) of the pixels inside each polygon (region, points array<struct<x, y>>), by the parity of crossings."""
    at = lambda f, c: f(F.transform("points", lambda p: p[c]))
    rows = lassos.where(F.size("points") >= 3)
    rows = rows.withColumn("y", F.explode(F.sequence(F.floor(at(F.array_min, "y")), F.ceil(at(F.array_max, "y")))))
    rows = rows.withColumn("x", F.explode(F.sequence(F.floor(at(F.array_min, "x")), F.ceil(at(F.array_max, "x")))))
    turned = F.concat(F.slice("points", 2, F.size("points") - 1), F.slice("points", 1, 1))
    edges = F.arrays_zip(F.col("points").alias("p"), turned.alias("q"))
    above = lambda p: p["y"] > F.col("y")
    cross = lambda e: F.when((above(e["p"]) != above(e["q"])) & (F.col("x") < (e["q"]["x"] - e["p"]["x"]) * (F.col("y") - e["p"]["y"]) / (e["q"]["y"] - e["p"]["y"]) + e["p"]["x"]), 1).otherwise(0)
    parity = F.aggregate(F.transform(edges, cross), F.lit(0), lambda a, b: a + b) % 2
    return rows.where(parity == 1).select("region", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))


def shape_summary(pixels: DataFrame) -> DataFrame:
    """Per region over its distinct pixels: area, centre, box."""
    one = pixels.select("region", "y", "x").distinct()
    return one.groupBy("region").agg(
        F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("x").alias("bx"), F.min("y").alias("by"),
        (F.max("x") - F.min("x") + 1).alias("bw"), (F.max("y") - F.min("y") + 1).alias("bh"),
    )


def frame_chunks(frames: DataFrame, size: int, process, schema: str) -> DataFrame:
    """process(stack) of each chunk of `size` frames on its own; it returns as many frames as it got.

    For work that looks at one frame at a time the result equals that over the whole stack.
    """
    if size <= 0:
        raise ValueError("a chunk has at least one frame")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame")
        h, w = int(rows["height"].iloc[0]), int(rows["width"].iloc[0])
        out = process(np.stack([np.asarray(p, np.float64).reshape(h, w) for p in rows["pixels"]]))
        if len(out) != len(rows):
            raise ValueError(f"{len(rows)} frames went in, {len(out)} came out")
        return pd.DataFrame({"frame": rows["frame"].to_numpy(), "height": h, "width": w, "pixels": [x.astype(np.float32).ravel() for x in out]})

    return frames.select("frame", "height", "width", "pixels", F.floor(F.col("frame") / size).alias("_chunk")).groupBy("_chunk").applyInPandas(run, schema)


def review_frames(activity: DataFrame, fixed: Sequence[int], top: int, frame: str = "frame", value: str = "n") -> DataFrame:
    """The frames to look at: given ones put into the range, the most active and the quietest."""
    ends = activity.agg(F.min(frame).alias("low"), F.max(frame).alias("high"))
    spark = activity.sparkSession
    given = spark.createDataFrame([(int(x),) for x in fixed], "given int").crossJoin(ends).select(F.least("high", F.greatest("low", F.col("given"))).alias(frame))
    most = activity.orderBy(F.desc(value), frame).limit(top).select(frame)
    least = activity.orderBy(value, frame).limit(top).select(frame)
    return given.unionByName(most).unionByName(least).distinct()



def local_z(image: np.ndarray, radius: int, floor: float) -> np.ndarray:
    """How far each pixel lies above the mean of the square around it, in its deviations (at least floor), not below 0."""
    n = (2 * radius + 1) ** 2
    mean = box_sums(image, radius) / n
    spread = np.sqrt(np.maximum(box_sums(image * image, radius) / n - mean * mean, 0))
    return np.maximum((image - mean) / np.maximum(spread, floor), 0)


def local_median_z(image: np.ndarray, radius: int, floor: float = 1e-6) -> np.ndarray:
    """As local_z with the median and the scaled median deviation of the square; edge pixels are repeated beyond the edges."""
    padded = np.pad(image, radius, mode="edge")
    squares = np.lib.stride_tricks.sliding_window_view(padded, (2 * radius + 1, 2 * radius + 1)).reshape(*image.shape, -1)
    middle = np.median(squares, axis=-1)
    spread = np.median(np.abs(squares - middle[..., None]), axis=-1)
    return np.maximum((image - middle) / (1.4826 * spread + floor), 0)


def smoothed(image: np.ndarray) -> np.ndarray:
    """The mean of the 3 by 3 square around each pixel, within the image."""
    inside = np.pad(np.ones_like(image), 1)
    padded = np.pad(image, 1)
    total = sum(padded[dy : dy + image.shape[0], dx : dx + image.shape[1]] for dy in range(3) for dx in range(3))
    return total / sum(inside[dy : dy + image.shape[0], dx : dx + image.shape[1]] for dy in range(3) for dx in range(3))


def normalised(image: np.ndarray, low: float = 1.0, high: float = 99.5) -> np.ndarray:
    """Values from 0 to 1 between two percentiles."""
    a, b = np.percentile(image, [low, high])
    return np.clip((image - a) / max(b - a, 1e-12), 0, 1)


def pixel_samples(long: DataFrame, truth: DataFrame, seed: int = 3) -> DataFrame:
    """(frame, y, x, v, kind): the pixels of truth (frame, y, x) that lie in the image, and as many others of each frame, drawn by a seeded hash."""
    front = long.join(truth.select("frame", "y", "x").distinct(), ["frame", "y", "x"]).withColumn("kind", F.lit("foreground"))
    rest = long.join(truth.select("frame", "y", "x"), ["frame", "y", "x"], "left_anti")
    wanted = front.groupBy("frame").agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.partitionBy("frame").orderBy(F.xxhash64("frame", "y", "x", F.lit(seed)), "y", "x"))
    back = rest.join(wanted, "frame").withColumn("_k", place).where("_k <= _n").drop("_k", "_n").withColumn("kind", F.lit("background"))
    return front.unionByName(back)


def temporal_score(candidate: Column, rise: Column, peak: Column, coincidence: Column, collapse: Column) -> Column:
    """A component's score from its own, the rise of the raw signal, the filtered peak and activity nearby, less a penalty for collapsing."""
    return 0.25 * candidate + 0.35 * rise + 0.25 * peak + 0.25 * coincidence - collapse


def neighbouring_activity(components: DataFrame, labelled: DataFrame, margin: int, offsets: Sequence[int] = (-1, 1, 2)) -> DataFrame:
    """Per component (frame, det_idx, bx, by, bw, bh) the labelled pixels (frame, y, x) of nearby frames within its widened box."""
    rows = components.withColumn("_offset", F.explode(F.array(*[F.lit(k) for k in offsets]))).withColumn("_frame", F.col("frame") + F.col("_offset"))
    cells = labelled.select(F.col("frame").alias("_frame"), F.col("y").alias("_y"), F.col("x").alias("_x"))
    near = F.col("_x").between(F.col("bx") - margin, F.col("bx") + F.col("bw") - 1 + margin) & F.col("_y").between(F.col("by") - margin, F.col("by") + F.col("bh") - 1 + margin)
    found = rows.join(cells, "_frame").where(near).groupBy("frame", "det_idx").agg(F.count("*").alias("n_near"), F.count_distinct("_offset").alias("n_frames"))
    return components.select("frame", "det_idx").join(found, ["frame", "det_idx"], "left").fillna(0, ["n_near", "n_frames"])


def active_neighbours(frames: DataFrame, at: int, frame: str = "frame") -> DataFrame:
    """(previous, next): the frames with events before and after a frame, going round at the ends."""
    days = frames.select(frame).distinct()
    return days.agg(
        F.coalesce(F.max(F.when(F.col(frame) < at, F.col(frame))), F.max(frame)).alias("previous"), F.coalesce(F.min(F.when(F.col(frame) > at, F.col(frame))), F.min(frame)).alias("next"),
    )
