"""Evidence images of a recording, pixel by pixel, and the scores of regions and suggestions that rest on them.

Images are long tables (by, y, x, ...), one row a pixel, so several recordings go through together under their keys
`by`. Nothing gathers an image: statistics and smoothing are aggregates that combine before the shuffle, and the
percentiles that scale an image are found by counting.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clamp
from .diagnostics import values_at_ranks
from .scoring import _value

# What each scaled image adds to a pixel's event support and to its discovery score.
SUPPORT = (("active", 0.55), ("peak_z", 0.25), ("coherence", 0.20))
DISCOVERY = (("peak_z", 0.40), ("deviation", 0.20), ("active", 0.20), ("uncovered", 0.15), ("coherence", 0.05))
SCALE = {"low": 0.01, "high": 0.995}
PERSISTENCE, PERSISTENT_FRAMES = 0.35, 10.0
# Terms of a region's and of a suggestion's evidence priority.
REGION_EVIDENCE = (("local_correlation", 0.20, 1.0), ("event_support", 0.20, 1.0), ("trace_snr", 0.20, 8.0), ("compactness", 0.15, 1.0), ("event_count", 0.15, 8.0))
SUGGESTION_EVIDENCE = (("seed_score", 0.25), ("local_correlation", 0.25), ("event_support", 0.25), ("compactness", 0.15))
INCOHERENT, SPREAD, ELONGATED = 0.45, 0.30, 4.0


def pixel_evidence(long: DataFrame, level: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, y, x, peak_z, deviation, active) of (by, frame, y, x, v, z): the largest z, not below 0, the deviation of v,
    the frames with z at or over the level."""
    return long.groupBy(*by, "y", "x").agg(
        F.greatest(F.lit(0.0), F.max(F.col("z").cast("double"))).alias("peak_z"), F.stddev_pop("v").alias("deviation"), F.count_if(F.col("z") >= level).cast("double").alias("active")
    )


def persistent_score(peak_z: Column, active: Column) -> Column:
    """A pixel's score: its peak, raised for pixels that are active in many frames."""
    return peak_z * (1 + PERSISTENCE * F.least(F.lit(1.0), active / PERSISTENT_FRAMES))


def blocked_pixels(regions: DataFrame, distance: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, y, x): the pixels within that distance of a region's pixel (by, y, x)."""
    near = [(dy, dx) for dy in range(-distance, distance + 1) for dx in range(-distance, distance + 1) if dy * dy + dx * dx <= distance * distance]
    return regions.select(*by, _shifted(near)).select(*by, "c.y", "c.x").distinct()


def _shifted(shifts: Sequence[tuple[int, int]]) -> Column:
    return F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in shifts])).alias("c")


def unit_scaled(images: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The named columns put to 0..1 between two percentiles of their own image."""
    tall = images.unpivot([*by], [*names], "_image", "_v")
    ends = values_at_ranks(tall, [*by, "_image"], "_v", SCALE)
    wide = [F.max(F.when(F.col("_image") == name, F.col(end))).alias(f"_{name}_{end}") for name in names for end in SCALE]
    scaled = {name: clamp((F.col(name) - F.col(f"_{name}_low")) / F.greatest(F.lit(1e-6), F.col(f"_{name}_high") - F.col(f"_{name}_low")), 0.0, 1.0) for name in names}
    joined = images.join(ends.groupBy(*by).agg(*wide), [*by]) if by else images.crossJoin(ends.agg(*wide))  # one row
    return joined.withColumns(scaled).select(*images.columns)


def smoothed_pixels(images: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, y, x, names): the mean over the 3 by 3 square around each pixel, of the pixels that are there.

    Every pixel gives its values to its neighbours; sums combine before the shuffle.
    """
    square = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    given = images.select(*by, *names, F.col("y").alias("_y"), F.col("x").alias("_x"), _shifted(square))
    own = (F.col("c.y") == F.col("_y")) & (F.col("c.x") == F.col("_x"))
    out = given.groupBy(*by, F.col("c.y").alias("y"), F.col("c.x").alias("x")).agg(*[F.avg(n).alias(n) for n in names], F.bool_or(own).alias("_there"))
    return out.where("_there").drop("_there")


def evidence_maps(pixels: DataFrame, coherence: DataFrame, blocked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, y, x, support, discovery), both smoothed: how far events support a pixel, and how much it asks for a
    suggestion. pixels: as pixel_evidence gives them; coherence: (by, y, x, coherence), missing 0; blocked: (by, y, x),
    pixels too near a region to be suggested."""
    at = [*by, "y", "x"]
    rows = pixels.join(coherence.select(*at, "coherence"), at, "left").join(blocked.select(*at).distinct().withColumn("_blocked", F.lit(True)), at, "left")
    free = F.col("_blocked").isNull()
    rows = rows.withColumns({"coherence": F.coalesce("coherence", F.lit(0.0)), "uncovered": F.when(free, persistent_score(F.col("peak_z"), F.col("active"))).otherwise(0.0)})
    names = [name for name, _ in DISCOVERY]
    scaled = unit_scaled(rows.select(*at, *names, free.alias("_free")), names, by)
    total = lambda terms: sum((weight * F.col(name) for name, weight in terms), F.lit(0.0))
    both = scaled.select(*at, clamp(total(SUPPORT), 0.0, 1.0).alias("support"), F.when(F.col("_free"), total(DISCOVERY)).otherwise(0.0).alias("discovery"))
    return smoothed_pixels(both, ["support", "discovery"], by)


def region_means(images: DataFrame, regions: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, region, names): the mean of images over the pixels (by, region, y, x) of each region."""
    return regions.join(images, [*by, "y", "x"]).groupBy(*by, "region").agg(*[F.avg(n).alias(n) for n in names])


def region_artifact_score(columns: Mapping[str, Column], smallest: float) -> Column:
    """How likely a region is an artifact by its pixels, from 0 to 1; smallest: the least area of a region.
    columns: background_correlation, local_correlation, compactness, area; missing ones count as 0."""
    mark = lambda c, weight: F.when(c, weight).otherwise(0.0)
    total = 0.35 * F.greatest(F.lit(0.0), _value(columns, "background_correlation")) + mark(_value(columns, "local_correlation") < INCOHERENT, 0.25)
    return clamp(total + mark(_value(columns, "compactness") < SPREAD, 0.20) + mark(_value(columns, "area") < 1.5 * smallest, 0.10), 0.0, 1.0)


def region_evidence(columns: Mapping[str, Column], artifact: Column, peak_level: float) -> Column:
    """A region's own priority, from 0 to 1; event_count and trace_snr count up to 8, peak_score up to its level."""
    total = sum((weight * (clamp(_value(columns, name) / most, 0.0, 1.0) if most > 1 else _value(columns, name)) for name, weight, most in REGION_EVIDENCE), F.lit(0.0))
    total = total + 0.10 * clamp(_value(columns, "peak_score") / max(1.0, peak_level), 0.0, 1.0)
    return clamp(total - 0.20 * F.greatest(F.lit(0.0), _value(columns, "background_correlation")) - 0.15 * artifact, 0.0, 1.0)


def suggestion_artifact_score(columns: Mapping[str, Column], bright: Column) -> Column:
    """How likely a suggestion is an artifact, from 0 to 1. columns: aspect (longer by shorter side), local_correlation;
    bright: whether its largest value is among the brightest of the picture."""
    mark = lambda c, weight: F.when(c, weight).otherwise(0.0)
    return clamp(mark(_value(columns, "aspect") > ELONGATED, 0.45) + mark(_value(columns, "local_correlation") < INCOHERENT, 0.25) + mark(bright, 0.25), 0.0, 1.0)


def suggestion_cue(columns: Mapping[str, Column], border: Column, bright: Column) -> Column:
    """What speaks against a suggestion; the first that holds."""
    return F.when(border, "border").when(_value(columns, "aspect") > ELONGATED, "elongated_structure").when(bright, "very_bright").otherwise("none")


def suggestion_evidence(columns: Mapping[str, Column], artifact: Column, frames: int) -> Column:
    """A suggestion's own priority, from 0 to 1. columns: seed_score, local_correlation, event_support, compactness,
    active_frames out of all frames."""
    total = sum((weight * _value(columns, name) for name, weight in SUGGESTION_EVIDENCE), F.lit(0.0))
    return clamp(total + 0.10 * _value(columns, "active_frames") / max(1.0, float(frames)) - 0.20 * artifact, 0.0, 1.0)


def quality(columns: Mapping[str, Column]) -> Column:
    """A region's quality for sorting: its priority, or its peak over its noise and its events."""
    noise = F.greatest(F.lit(0.04), F.coalesce(columns["noise"].cast("double"), F.lit(0.04)) if "noise" in columns else F.lit(0.04))
    own = _value(columns, "peak_score") / noise + 0.4 * _value(columns, "event_count")
    return F.coalesce(columns["priority"].cast("double"), own) if "priority" in columns else own


def unsureness(columns: Mapping[str, Column], labelled: Column) -> Column:
    """How unsure a region is for sorting: unlabelled, noisy, of unusual area, of few events."""
    return F.when(labelled, 0.0).otherwise(20.0) + 12 * _value(columns, "noise") + F.abs(_value(columns, "area") - 65) / 50 - 0.15 * _value(columns, "event_count")
