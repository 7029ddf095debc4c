"""Regions of pixels grown from seeds: connected pixels over a low level that hold one over a high level.

Pixels are a long table (frame, y, x, v), so an image may be larger than a task. Tiles are labelled one by one; parts that
meet at the rim of tiles are linked by a join on neighbouring places, and linked parts are found as connected components.
What a region measures is summed from its parts; no region is gathered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import _kept, connected_components
from .signal import labelled

#: Pixels of a tile's side; images are at most 2^20 pixels wide and high.
TILE = 128
_PARTS = "frame long, part long, n long, sx long, sy long, sz double, peak double, seeded boolean, x0 int, y0 int, x1 int, y1 int, rim array<struct<y:int,x:int>>"


def _tile_parts(pixels: DataFrame, seed: float, tile: int) -> DataFrame:
    """The connected parts (by edges and corners) of each tile's pixels. A part's number is the place of its first pixel."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        frame, top, left = int(rows["frame"].iloc[0]), int(rows["y"].min()), int(rows["x"].min())
        y, x, v = rows["y"].to_numpy(), rows["x"].to_numpy(), rows["v"].to_numpy(float)
        mask = np.zeros((int(y.max()) - top + 1, int(x.max()) - left + 1), bool)
        mask[y - top, x - left] = True
        marks = labelled(mask)[y - top, x - left]
        order = np.lexsort((x, y, marks))
        y, x, v, marks = y[order], x[order], v[order], marks[order]
        starts = np.flatnonzero(np.r_[True, marks[1:] != marks[:-1]])
        at = lambda f, a: f.reduceat(a, starts)
        outer = (y % tile == 0) | (y % tile == tile - 1) | (x % tile == 0) | (x % tile == tile - 1)
        stops = [*starts[1:].tolist(), len(y)]
        rims = [[{"y": int(a), "x": int(b)} for a, b in zip(y[s:e][outer[s:e]], x[s:e][outer[s:e]], strict=True)] for s, e in zip(starts.tolist(), stops, strict=True)]
        return pd.DataFrame(
            {
                "frame": frame, "part": (frame << 40) + (y[starts].astype(np.int64) << 20) + x[starts], "n": np.diff([*starts, len(y)]), "sx": at(np.add, x.astype(np.int64)), "sy": at(np.add, y.astype(np.int64)),
                "sz": at(np.add, v), "peak": at(np.maximum, v), "seeded": at(np.maximum, v) >= seed, "x0": at(np.minimum, x), "y0": at(np.minimum, y), "x1": at(np.maximum, x), "y1": at(np.maximum, y), "rim": rims,
            }
        )

    tiled = pixels.select(F.col("frame").cast("long").alias("frame"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v"))
    return tiled.groupBy("frame", F.floor(F.col("y") / tile).alias("_ty"), F.floor(F.col("x") / tile).alias("_tx")).applyInPandas(run, _PARTS)


def grown(pixels: DataFrame, seed: float, grow: float, least: int = 1, most: int = 300, fill: float = 0.10, aspect: float = 6.0, tile: int = TILE) -> DataFrame:
    """Every region of pixels that reach grow: frame, region (its first pixel, y * 2^20 + x), area, x, y, peak_z, mean_z, its box and

    reason: accepted, no_seed (no pixel reaches seed), area (outside least to most) or shape (fills less of its box than
    fill, or is more than aspect times as long as wide); component_id numbers accepted regions of a frame in reading order.
    Pixels with a null value belong to none. A place that occurs twice in a frame counts twice.
    """
    parts = _kept(_tile_parts(pixels.where(F.col("v") >= grow), seed, tile))
    rim = parts.select("frame", "part", F.explode("rim").alias("p")).select("frame", "part", "p.y", "p.x")
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])).alias("s")
    near = rim.select("frame", F.col("part").alias("a"), "y", "x", steps).select("frame", "a", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    links = near.join(rim.withColumnRenamed("part", "b"), ["frame", "y", "x"]).where("a <> b").select("a", "b").distinct()
    joined = parts.drop("rim").join(connected_components(links).withColumnRenamed("id", "part"), "part", "left")
    whole = joined.groupBy("frame", F.coalesce("component", "part").alias("_c")).agg(
        F.sum("n").alias("area"), F.sum("sx").alias("_sx"), F.sum("sy").alias("_sy"), F.sum("sz").alias("_sz"), F.max("peak").alias("peak_z"), F.max("seeded").alias("_seeded"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    wide, high = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    whole = whole.withColumns({"width": wide, "height": high}).withColumns({"fill": F.col("area") / (F.col("width") * F.col("height")), "aspect": F.greatest("width", "height") / F.least("width", "height")})
    reason = F.when(~F.col("_seeded"), "no_seed").when((F.col("area") < least) | (F.col("area") > most), "area").when((F.col("fill") < fill) | (F.col("aspect") > aspect), "shape").otherwise("accepted")
    whole = whole.withColumn("reason", reason)
    number = F.when(F.col("reason") == "accepted", F.row_number().over(Window.partitionBy("frame", "reason").orderBy("_c")))
    return whole.select(
        "frame", F.col("_c").bitwiseAND((1 << 40) - 1).alias("region"), number.alias("component_id"), "area", (F.col("_sx") / F.col("area")).alias("x"), (F.col("_sy") / F.col("area")).alias("y"), "peak_z",
        (F.col("_sz") / F.col("area")).alias("mean_z"), "x0", "y0", "x1", "y1", "width", "height", "fill", "aspect", "reason",
    )


def frame_outcomes(regions: DataFrame) -> DataFrame:
    """Per frame how many regions were accepted, of how many pixels, and how many were rejected for each reason."""
    count = lambda r: F.count_if(F.col("reason") == r)
    return regions.groupBy("frame").agg(
        count("accepted").alias("accepted"), F.coalesce(F.sum(F.when(F.col("reason") == "accepted", F.col("area"))), F.lit(0)).alias("accepted_pixels"),
        count("no_seed").alias("rejected_no_seed"), count("area").alias("rejected_area"), count("shape").alias("rejected_shape"),
    )
