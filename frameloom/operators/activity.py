"""Event rasters, population activity and correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio


def in_range(events: DataFrame, frames: int, frame: str = "frame") -> DataFrame:
    """Events with a frame from 0 to frames - 1; the others are dropped, as a raster has no place for them."""
    return events.where((F.col(frame) >= 0) & (F.col(frame) < frames))


def event_raster(events: DataFrame, frames: int, width: int, obj: str = "object_id", frame: str = "frame") -> DataFrame:
    """(object, bin, n_events): counts of every object in every bin, zeros too."""
    kept = in_range(events, frames, frame)
    counts = kept.groupBy(obj, F.floor(F.col(frame) / width).cast("int").alias("bin")).agg(F.count("*").alias("n_events"))
    bins = -(-frames // width)
    grid = events.select(obj).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, [obj, "bin"], "left").select(obj, "bin", F.coalesce("n_events", F.lit(0)).alias("n_events"))


def population_activity(events: DataFrame, frames: int, width: int, obj: str = "object_id", frame: str = "frame") -> DataFrame:
    """Per bin: events, active objects, their share of all, events per active object, whether two or more are active, whether it is the first peak."""
    spark = events.sparkSession
    kept = in_range(events, frames, frame).withColumn("bin", F.floor(F.col(frame) / width).cast("int"))
    per_object = kept.groupBy("bin", obj).agg(F.count("*").alias("n"))
    per_bin = per_object.groupBy("bin").agg(F.sum("n").alias("total_events"), F.count("*").alias("active_objects"))
    objects = events.agg(F.count_distinct(obj).alias("n_objects"))
    grid = spark.range(-(-frames // width)).select(F.col("id").cast("int").alias("bin"))
    out = grid.join(per_bin, "bin", "left").crossJoin(F.broadcast(objects)).fillna(0, ["total_events", "active_objects"])  # objects has one row
    order = Window.orderBy(F.desc("total_events"), "bin")  # a row for each bin
    return out.select(
        "bin", "total_events", "active_objects", ratio(F.col("active_objects"), F.col("n_objects")).alias("active_fraction"),
        ratio(F.col("total_events"), F.col("active_objects")).alias("mean_per_active"), (F.col("active_objects") >= 2).cast("int").alias("coactive"),
        (F.row_number().over(order) == 1).cast("int").alias("is_peak"),
    )


def correlation(series: DataFrame, obj: str, at: str, value: str, n: int) -> DataFrame:
    """(a, b, r, defined) of all pairs of objects: Pearson correlation of their values over n places; missing ones are 0.

    Without variance r is 0 and not defined. Objects are few: pairs are made of them, not of their values.
    """
    rows = series.groupBy(obj, at).agg(F.sum(value).cast("double").alias("v"))
    sums = rows.groupBy(obj).agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    x, y = (rows.select(F.col(obj).alias(k), at, F.col("v").alias(f"v_{k}")) for k in ("a", "b"))
    products = x.join(y, at).where("a < b").groupBy("a", "b").agg(F.sum(F.col("v_a") * F.col("v_b")).alias("sxy"))
    a, b = (sums.select(F.col(obj).alias(k), F.col("s").alias(f"s_{k}"), F.col("ss").alias(f"ss_{k}")) for k in ("a", "b"))
    pairs = a.join(b, F.col("a") < F.col("b")).join(products, ["a", "b"], "left").fillna(0.0, ["sxy"])
    top = n * F.col("sxy") - F.col("s_a") * F.col("s_b")
    below = F.sqrt(F.greatest(F.lit(0.0), (n * F.col("ss_a") - F.col("s_a") ** 2) * (n * F.col("ss_b") - F.col("s_b") ** 2)))
    return pairs.select("a", "b", ratio(top, below).alias("r"), (below > 0).cast("int").alias("defined"))
