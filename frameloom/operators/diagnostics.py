"""Checks of timestamps, frame-to-time mappings, intensities and latencies."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import nearest_rank, ratio


def timestamp_diagnostics(rows: DataFrame, by: Sequence[str], position: str, seconds: str, gap: float = 1.5) -> DataFrame:
    """Per group: missing, repeated and falling timestamps, gaps of over 1.5 times the median step, median and largest step."""
    order = Window.partitionBy(*by).orderBy(position)
    known = rows.where(F.col(seconds).isNotNull()).withColumn("_step", F.col(seconds) - F.lag(seconds).over(order))
    steps = known.groupBy(*by).agg(
        F.median(F.when(F.col("_step") > 0, F.col("_step"))).alias("median_step"), F.max("_step").alias("largest_step"),
        F.count_if(F.col("_step") == 0).alias("n_repeated"), F.count_if(F.col("_step") < 0).alias("n_falling"),
    )
    wide = known.join(steps.select(*by, "median_step"), list(by)).groupBy(*by).agg(F.count_if(F.col("_step") > gap * F.col("median_step")).alias("n_gaps"))
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(seconds).isNull()).alias("n_missing"))
    return counts.join(steps, list(by), "left").join(wide, list(by), "left").fillna(0, ["n_repeated", "n_falling", "n_gaps"])


def mapping_error(rows: DataFrame, by: Sequence[str], frame: str, seconds: str, rate: float, tolerance: float) -> DataFrame:
    """Per group: largest and mean distance of frame / rate from the time given, and whether it is within tolerance."""
    error = F.abs(F.col(frame) / F.lit(rate) - F.col(seconds))
    out = rows.groupBy(*by).agg(F.max(error).alias("max_error"), F.avg(error).alias("mean_error"))
    return out.withColumn("status", F.when(F.col("max_error") <= tolerance, "ok").otherwise("failed"))


def intensity_quality(rows: DataFrame, frame: str, value: str, drift_at: Column | None = None) -> DataFrame:
    """Extremes, mean, population deviation, exact percentiles, share at the extremes, and drift between the halves."""
    v = F.col(value)
    ends = rows.agg(F.min(v).alias("low"), F.max(v).alias("high"), F.min(frame).alias("f0"), F.max(frame).alias("f1"))
    half = F.col(frame) >= (F.col("f0") + F.col("f1") + 1) / 2 if drift_at is None else drift_at
    both = rows.crossJoin(F.broadcast(ends))  # one row
    out = both.agg(
        F.count("*").alias("n"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.avg(v).alias("mean_value"), F.stddev_pop(v).alias("std_value"),
        F.count_if(v == F.col("low")).alias("n_low"), F.count_if(v == F.col("high")).alias("n_high"),
        (F.avg(F.when(half, v)) - F.avg(F.when(~half, v))).alias("drift"),
    )
    quantiles = {"p01": 0.01, "p50": 0.5, "p99": 0.99}
    places = {f"{name}_{end}": (lambda n, q=q, f=f: f((n - 1) * F.lit(q))) for name, q in quantiles.items() for end, f in (("below", F.floor), ("above", F.ceil))}
    at, rank = _values_at(rows, [], value, places), lambda q: (F.count(v) - 1) * F.lit(q)
    shares = rows.agg(*[(rank(q) - F.floor(rank(q))).alias(f"{name}_part") for name, q in quantiles.items()])
    between = {name: F.col(f"{name}_below") + F.when(F.col(f"{name}_below") == F.col(f"{name}_above"), 0.0).otherwise((F.col(f"{name}_above") - F.col(f"{name}_below")) * F.col(f"{name}_part")) for name in quantiles}
    found = at.crossJoin(shares).select(*[c.alias(name) for name, c in between.items()])  # one row each
    return out.crossJoin(found).withColumn("saturated_share", ratio(F.col("n_high"), F.col("n")))


def latency_percentiles(samples: DataFrame, by: Sequence[str], value: str, budget: float) -> DataFrame:
    """Per group: median, nearest-rank p95 and p99, largest, mean, samples over budget, whether p99 meets it.

    The place of a rank is found by counting distinct values, so samples are not gathered.
    """
    v = F.col(value)
    counts = samples.where(v.isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_upto", F.sum("_n").over(upto))
    total = samples.groupBy(*by).agg(F.count(v).alias("n"), F.max(v).alias("max_value"), F.avg(v).alias("mean_value"), F.count_if(v > budget).alias("n_over"))
    rank = lambda q: F.bround((F.col("n") - 1) * F.lit(q), 0)
    at = placed.join(total.select(*by, "n"), list(by)) if by else placed.crossJoin(total.select("n"))
    middle = (F.col("n") - 1) / 2
    places = {"p95": rank(0.95), "p99": rank(0.99), "_below": F.floor(middle), "_above": F.ceil(middle)}
    picks = [F.min(F.when(F.col("_upto") > place, v)).alias(name) for name, place in places.items()]
    ranks = at.groupBy(*by).agg(*picks) if by else at.agg(*picks)
    ranks = ranks.withColumn("p50", (F.col("_below") + F.col("_above")) / 2).drop("_below", "_above")
    out = total.join(ranks, list(by), "left") if by else total.crossJoin(ranks)
    return out.withColumn("meets_budget", (F.coalesce("p99", F.lit(0.0)) <= budget).cast("int"))


def values_at_ranks(rows: DataFrame, by: Sequence[str], value: str, ranks: Mapping[str, float], cells: int = 4096) -> DataFrame:
    """(by, a column for each rank): per group the value at place (n - 1) * q, halves up, in ascending order; nulls are no values.

    Counts over cells of equal width tell the cell that holds a place; only that cell's distinct values are put in order.
    So a group of any size is counted by all tasks, and neither its values nor its distinct values come together.
    """
    places = {name: (lambda n, q=q: F.floor((n - 1) * F.lit(q) + 0.5)) for name, q in ranks.items()}
    return _values_at(rows.where(~F.isnan(F.col(value).cast("double"))), by, value, places, cells)


def _values_at(rows: DataFrame, by: Sequence[str], value: str, places: Mapping[str, Callable[[Column], Column]], cells: int = 4096) -> DataFrame:
    """As values_at_ranks, at places that follow from the number of values; NaN is the largest value."""
    keys = list(by)
    rows = rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    finite = F.when(F.abs("_v") < float("inf"), F.col("_v"))
    ends = rows.groupBy(*keys).agg(F.min(finite).alias("_low"), F.max(finite).alias("_high"), F.count("*").alias("_n"))
    width = (F.col("_high") - F.col("_low")) / cells
    cell = F.when(width > 0, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(cells - 1.0), (F.col("_v") - F.col("_low")) / width))).cast("int")).otherwise(0)
    placed = (rows.join(ends, keys) if keys else rows.crossJoin(F.broadcast(ends))).withColumn("_cell", cell)
    order = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    counts = placed.groupBy(*keys, "_cell").agg(F.count("*").alias("_in"), F.first("_n").alias("_n")).withColumn("_upto", F.sum("_in").over(order))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("_n")).cast("long").alias("place")) for name, place in places.items()]))
    held = counts.withColumn("_r", wanted).where("_r.place < _upto AND _r.place >= _upto - _in")
    held = held.select(*keys, "_cell", F.col("_r.name").alias("_name"), (F.col("_r.place") - F.col("_upto") + F.col("_in")).alias("_left"))
    distinct = placed.groupBy(*keys, "_cell", "_v").agg(F.count("*").alias("_in"))
    inner = Window.partitionBy(*keys, "_cell", "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = distinct.join(held, [*keys, "_cell"]).withColumn("_upto", F.sum("_in").over(inner))
    return near.groupBy(*keys).agg(*[F.min(F.when((F.col("_name") == name) & (F.col("_upto") > F.col("_left")), F.col("_v"))).alias(name) for name in places])


def small_percentile(values: Column, q: float) -> Column:
    return nearest_rank(values, q)


def runtime_summary(runs: DataFrame, seconds: str, status: str) -> DataFrame:
    """Number of runs by outcome, and their times."""
    return runs.agg(
        F.count("*").alias("n_runs"), F.count_if(F.col(status) == "completed").alias("n_completed"), F.count_if(F.col(status) == "failed").alias("n_failed"),
        F.sum(seconds).alias("total_seconds"), F.avg(seconds).alias("mean_seconds"), F.max(seconds).alias("max_seconds"),
    )


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n, mean, std): counts of finite values from low to high in equal bins, with the Gaussian that fits all of them."""
    v = F.col(value).cast("double")
    kept = rows.where(v.between(low, high) & ~F.isnan(v)).select(v.alias("_v"))
    fit = kept.agg(F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"))
    place = F.least(F.lit(bins - 1), F.floor((F.col("_v") - low) / ((high - low) / bins))).cast("int")
    return kept.groupBy(place.alias("bin")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(fit))  # fit has one row


def sensitivity(results: DataFrame, down: str, across: str, value: str, order: str) -> DataFrame:
    """A matrix of a value over two parameters; of several results for a cell the last in order counts."""
    levels = [r[0] for r in results.select(across).distinct().orderBy(across).collect()]  # values of one parameter
    return results.groupBy(down).pivot(across, levels).agg(F.max_by(value, order))


def distribution(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per group the number, mean, extremes of a value and its nearest-rank quartiles."""
    v = F.col(value)
    ranks = {q: latency_percentiles_at(rows, by, value, q) for q in (0.25, 0.75)}
    out = rows.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"))
    for q, found in ranks.items():
        out = out.join(found.withColumnRenamed("_rank", f"p{round(100 * q)}"), list(by), "left")
    return out


def latency_percentiles_at(rows: DataFrame, by: Sequence[str], value: str, q: float) -> DataFrame:
    """Per group the nearest-rank quantile of a value, by counts of distinct values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    along = Window.partitionBy(*by).orderBy(value)
    placed = counts.withColumn("_upto", F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    return placed.where(F.col("_upto") > F.bround((F.col("_all") - 1) * F.lit(q), 0)).groupBy(*by).agg(F.min(value).alias("_rank"))
