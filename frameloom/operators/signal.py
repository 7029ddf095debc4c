"""Signals: traces as long tables or arrays, images as one row a frame.

What relates a value to others of its frame or its neighbours in time is expressed with groups and windows. Kernels over
whole images (box statistics, labelling, shifts) run on Arrow batches, a frame at a time, so frames stay where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def medians(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, median) of the values of each group that are not null: distinct values are counted first, so a group of any size
    is a sorted run of counts, not a list in one task's memory."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumns({"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(whole)})
    low, high = (F.min(F.when(c, F.col("_v"))) for c in (2 * F.col("_upto") >= F.col("_all"), 2 * F.col("_upto") > F.col("_all")))
    return placed.groupBy(*by).agg(((low + high) / 2).alias("median"))


def counted_robust_z(rows: DataFrame, by: Sequence[str], value: str, floor: float = 1e-6) -> DataFrame:
    """rows with z: how far a value lies above its group's median, in scaled median deviations, not below 0."""
    with_median = lambda df, of, name: df.alias("a").join(medians(df, by, of).alias("m"), [F.col(f"a.{c}").eqNullSafe(F.col(f"m.{c}")) for c in by]).select("a.*", F.col("m.median").alias(name))
    placed = with_median(rows, value, "_m").withColumn("_e", F.abs(F.col(value) - F.col("_m")))
    placed = with_median(placed, "_e", "_d")
    return placed.withColumn("z", F.greatest(F.lit(0.0), (F.col(value) - F.col("_m")) / (1.4826 * F.col("_d") + floor))).drop("_m", "_e", "_d")


def robust_z(rows: DataFrame, frame: str, value: str, floor: float = 1e-6) -> DataFrame:
    """rows with z: how far a value lies above its frame's median, in scaled median deviations, not below 0."""
    return counted_robust_z(rows.where(F.col(frame).isNotNull()), [frame], value, floor)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(raw) for x in raw]


def highpass(rows: DataFrame, by: Sequence[str], at: str, value: str, sigma: float, first: int, last: int) -> DataFrame:
    """A dense series less its Gaussian average along `at`; beyond its ends (first, last) the end values hold."""
    if sigma <= 0:
        return rows.withColumn("low", F.lit(0.0)).withColumn("high", F.col(value))
    weights = gaussian_weights(sigma)
    radius = len(weights) // 2
    order = Window.partitionBy(*by).orderBy(at)
    ends = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    low = F.lit(0.0)
    head, tail = F.first(value).over(ends), F.last(value).over(ends)
    for k, w in zip(range(-radius, radius + 1), weights, strict=True):
        shifted = F.lag(value, -k).over(order) if k < 0 else F.lead(value, k).over(order)
        shifted = F.lag(value, abs(k)).over(order) if k < 0 else shifted if k > 0 else F.col(value)
        low = low + w * F.coalesce(shifted, head if k < 0 else tail)
    return rows.withColumn("low", low).withColumn("high", F.col(value) - F.col("low"))


def supported(cells: DataFrame, x: str, y: str, least: int, by: Sequence[str] = ()) -> DataFrame:
    """Active cells of a grid with at least so many active ones in their 3 by 3 neighbourhood, themselves included."""
    own = cells.select(*by, x, y).distinct()
    if least <= 1:
        return own.withColumn("support", F.lit(1).cast("long"))
    around = F.explode(F.array(*[F.struct((F.col(x) + dx).alias(x), (F.col(y) + dy).alias(y)) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    votes = own.select(*by, around.alias("c")).groupBy(*by, f"c.{x}", f"c.{y}").agg(F.count("*").alias("support"))
    return own.join(votes, [*by, x, y]).where(F.col("support") >= least)


def local_maxima(rows: DataFrame, by: Sequence[str], at: str, value: str, threshold: float) -> DataFrame:
    """Inner places whose value reaches the threshold and both neighbours."""
    order = Window.partitionBy(*by).orderBy(at)
    marked = rows.withColumn("_b", F.lag(value).over(order)).withColumn("_a", F.lead(value).over(order))
    return marked.where(F.col("_b").isNotNull() & F.col("_a").isNotNull() & (F.col(value) >= threshold) & (F.col(value) >= F.col("_b")) & (F.col(value) >= F.col("_a"))).drop("_b", "_a")


def apart(peaks: DataFrame, by: Sequence[str], at: str, least: int) -> DataFrame:
    """Peaks at least so far from the one kept before them, from the first on."""
    places = peaks.groupBy(*by).agg(F.array_sort(F.collect_set(at)).alias("_all"))
    start = F.array().cast("array<bigint>")
    step = lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) >= least), F.concat(kept, F.array(x))).otherwise(kept)
    return places.select(*by, F.explode(F.aggregate(F.col("_all").cast("array<bigint>"), start, step)).alias(at))


def rise(rows: DataFrame, by: Sequence[str], at: str, value: str, before: int = 4, after: int = 8) -> DataFrame:
    """rows with pre (median of the places before), post (largest of those after), rise (value less pre) and rise_z.

    rise_z is the rise in units of the spread before: 1.4826 times the median distance from pre, 1 at least. Without places
    before or after, the value itself stands for pre or post. The frames are short, so their lists are.
    """
    order = Window.partitionBy(*by).orderBy(at)
    middle = lambda a: (a[F.floor((F.size(a) - 1) / 2).cast("int")] + a[F.floor(F.size(a) / 2).cast("int")]) / 2
    held = F.array_sort(F.collect_list(F.col(value).cast("double")).over(order.rowsBetween(-before, -1)))
    rows = rows.withColumn("pre", held)
    own = F.when(F.size("pre") > 0, middle(F.col("pre"))).otherwise(F.col(value))
    rows = rows.withColumn("pre", F.struct(F.col("pre").alias("all"), own.alias("mid")))
    spread = F.greatest(F.lit(1.0), 1.4826 * middle(F.array_sort(F.transform("pre.all", lambda x: F.abs(x - F.col("pre.mid"))))))
    rows = rows.withColumn("rise_z", (F.col(value) - F.col("pre.mid")) / F.when(F.size("pre.all") > 0, spread).otherwise(1.0))
    rows = rows.withColumn("pre", F.col("pre.mid")).withColumn("rise", F.col(value) - F.col("pre"))
    return rows.withColumn("post", F.coalesce(F.max(value).over(order.rowsBetween(1, after)), F.col(value)))


def islands(rows: DataFrame, by: Sequence[str], at: str) -> DataFrame:
    """Runs of consecutive places: first, last and length."""
    days = rows.select(*by, at).distinct()
    group = F.col(at) - F.row_number().over(Window.partitionBy(*by).orderBy(at))
    return days.withColumn("_g", group).groupBy(*by, "_g").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("length")).drop("_g")


def corrected_trace(raw: Column, ring: Column, weight: float) -> Column:
    """raw less a share of its surroundings, element by element."""
    return F.zip_with(raw, ring, lambda a, b: a - weight * b)


def kalman_innovation(trace: Column, gain: float = 0.08, spike_gain: float = 0.015, spike: float = 2.5, negative_gain: float = 0.11, noise: float = 1.0) -> Column:
    """Array of positive innovations of a trace: a fold that follows slow change fast and events slowly."""
    start = F.struct(F.element_at(trace, 1).cast("double").alias("level"), F.array().cast("array<double>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        e = x.cast("double") - state["level"]
        own = F.when(e < 0, negative_gain).when(e > spike * noise, spike_gain).otherwise(gain)
        return F.struct((state["level"] + own * e).alias("level"), F.concat(state["out"], F.array(F.greatest(F.lit(0.0), e) / noise)).alias("out"))

    return F.when(F.size(trace) > 0, F.aggregate(trace, start, step, lambda s: s["out"]))


def ewma_z(values: Column, alpha: float) -> Column:
    """Array of z scores of a series against the mean and variance before each value; the first value is 0.

    The mean starts at the first value and the variance at 1; the variance follows the distance from the old mean.
    """
    start = F.struct(F.element_at(values, 1).cast("double").alias("m"), F.lit(1.0).alias("v"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        e = x.cast("double") - s["m"]
        z = e / F.sqrt(s["v"] + F.lit(1e-6))
        return F.struct((s["m"] + alpha * e).alias("m"), ((1 - alpha) * s["v"] + alpha * e * e).alias("v"), F.concat(s["out"], F.array(z)).alias("out"))

    return F.when(F.size(values) > 0, F.aggregate(values, start, step, lambda s: s["out"]))


# --- images: frames(frame, height, width, pixels array<float>) ---


def by_frame(frames: DataFrame, kernel, schema: str) -> DataFrame:
    """kernel(frame number, image) -> pandas rows, for each frame of each Arrow batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [kernel(int(r.frame), np.asarray(r.pixels, np.float64).reshape(int(r.height), int(r.width))) for r in rows.itertuples()]
            if found:
                yield pd.concat(found, ignore_index=True)

    return frames.select("frame", "height", "width", "pixels").mapInPandas(run, schema)


def box_sums(image: np.ndarray, radius: int) -> np.ndarray:
    """Sum over the square of that radius around each pixel; beyond the edges the edge pixels hold."""
    padded = np.pad(image, radius, mode="edge")
    total = np.pad(padded, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    size = 2 * radius + 1
    return total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]


def annular_cfar(image: np.ndarray, guard: int, ring: int, false_alarm: float, epsilon: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(score, mask): pixels against the mean and deviation of the ring between two squares around them.

    epsilon is added to variance and deviation, and scores are not below 0; without it the variance is 1e-12 at least.
    """
    outer, inner = (2 * ring + 1) ** 2, (2 * guard + 1) ** 2
    n = outer - inner
    mean = (box_sums(image, ring) - box_sums(image, guard)) / n
    square = (box_sums(image**2, ring) - box_sums(image**2, guard)) / n
    if epsilon is None:
        score = (image - mean) / np.sqrt(np.maximum(square - mean**2, 1e-12))
    else:
        spread = np.sqrt(np.maximum(square - mean**2, 0) + epsilon) + epsilon
        score = np.maximum((image - mean) / np.maximum(spread, 1e-12), 0)
    return score, score >= math.sqrt(-2 * math.log(false_alarm))


def cfar_detections(frames: DataFrame, guard: int = 1, ring: int = 5, false_alarm: float = 0.05) -> DataFrame:
    """(frame, y, x, score) of all pixels that stand out from the ring around them."""

    def kernel(frame: int, image: np.ndarray) -> pd.DataFrame:
        score, mask = annular_cfar(image, guard, ring, false_alarm)
        y, x = np.nonzero(mask)
        return pd.DataFrame({"frame": frame, "y": y, "x": x, "score": score[y, x]})

    return by_frame(frames, kernel, "frame int, y int, x int, score double")


def labelled(mask: np.ndarray, eight: bool = True) -> np.ndarray:
    """Connected parts of a mask, numbered from 1 in reading order, by smallest labels spread until nothing changes."""
    height, width = mask.shape
    own = np.where(mask, np.arange(1, height * width + 1).reshape(height, width), 0)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
    while True:
        new = own.copy()
        for dy, dx in steps:
            a = (slice(dy, None), slice(max(dx, 0), width + min(dx, 0)))
            b = (slice(0, height - dy), slice(max(-dx, 0), width - max(dx, 0)))
            both = (new[a] > 0) & (new[b] > 0)
            least = np.minimum(new[a], new[b])
            new[a] = np.where(both, least, new[a])
            new[b] = np.where(both, np.minimum(least, new[b]), new[b])
        roots = new[mask] - 1
        flat = new.reshape(-1)
        while len(roots) and not np.array_equal(jumped := flat[roots] - 1, roots):
            roots = jumped
        new[mask] = roots + 1
        if np.array_equal(new, own):
            break
        own = new
    _, index = np.unique(own[mask], return_inverse=True)
    out = np.zeros_like(own)
    out[mask] = index + 1
    return out


def components(frames: DataFrame, threshold: float, least: int = 1, most: int | None = None, eight: bool = True) -> DataFrame:
    """Per frame the connected parts of pixels at or over a threshold: number, centre, area, box, peak."""

    def kernel(frame: int, image: np.ndarray) -> pd.DataFrame:
        parts = labelled(image >= threshold, eight)
        rows = []
        for k in range(1, int(parts.max(initial=0)) + 1):
            y, x = np.nonzero(parts == k)
            if len(y) >= least and (most is None or len(y) <= most):
                rows.append((frame, len(rows), x.mean(), y.mean(), len(y), int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1, float(image[y, x].max())))
        return pd.DataFrame(rows, columns=["frame", "det_idx", "x", "y", "area", "bx", "by", "bw", "bh", "peak"])

    return by_frame(frames, kernel, "frame int, det_idx int, x double, y double, area int, bx int, by int, bw int, bh int, peak double")


def rigid_shifts(frames: DataFrame, reference: np.ndarray, most: int) -> DataFrame:
    """Per frame the whole shift (dy, dx) that brings it onto a reference image best, by the product with it centred."""
    from .video import best_shift

    def kernel(frame: int, image: np.ndarray) -> pd.DataFrame:
        best = best_shift(image, reference, most)
        return pd.DataFrame({"frame": [frame], "dy": [best[0]], "dx": [best[1]]})

    return by_frame(frames, kernel, "frame int, dy int, dx int")


def pixels(frames: DataFrame) -> DataFrame:
    """(frame, y, x, v): images as a long table."""
    rows = frames.select("frame", "width", F.posexplode("pixels").alias("k", "v"))
    return rows.select("frame", F.floor(F.col("k") / F.col("width")).cast("int").alias("y"), (F.col("k") % F.col("width")).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def projections(long: DataFrame, active: float = 2.0) -> DataFrame:
    """Per pixel over all frames: mean, population deviation, largest value, frames at or over a level."""
    return long.groupBy("y", "x").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.max("v").alias("peak"), F.count_if(F.col("v") >= active).alias("n_active"))


def region_traces(long: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, frame, mean value) over the pixels (region, y, x) of each region."""
    return long.join(regions, ["y", "x"]).groupBy("region", "frame").agg(F.avg("v").alias("value"))


def ring_pixels(regions: DataFrame, inner: int, outer: int) -> DataFrame:
    """(region, y, x) of pixels near a region's pixels, beyond the inner and within the outer distance, and in no region."""
    shifts = [(dy, dx) for dy in range(-outer, outer + 1) for dx in range(-outer, outer + 1) if inner**2 < dy * dy + dx * dx <= outer**2]
    around = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in shifts]))
    ring = regions.select("region", around.alias("c")).select("region", "c.y", "c.x").distinct()
    near = [(dy, dx) for dy in range(-inner, inner + 1) for dx in range(-inner, inner + 1) if dy * dy + dx * dx <= inner**2]
    close = regions.select("region", F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in near])).alias("c")).select("region", "c.y", "c.x")
    return ring.join(close, ["region", "y", "x"], "left_anti").join(regions.select("y", "x").distinct(), ["y", "x"], "left_anti").select("region", "y", "x")
