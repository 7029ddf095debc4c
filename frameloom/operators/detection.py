"""Detections against ground truth: operating points over thresholds, areas, coverage, latency, taxonomy, intervals."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio
from .joins import asof_backward, binned_join


def in_tolerance(gt: DataFrame, det: DataFrame, tolerance: float, by: Sequence[str] = ()) -> DataFrame:
    """(frame, gt_id, x, y, det_idx, dx, dy, z) of pairs in one frame whose places (x, y) lie the tolerance apart at most."""
    right = det.select("frame", "det_idx", F.col("x").alias("dx"), F.col("y").alias("dy"), "z", *by)
    return binned_join(gt.select("frame", "gt_id", "x", "y"), right, ["frame"], [("x", "dx", tolerance), ("y", "dy", tolerance)], circle=tolerance)


def froc_sweep(gt: DataFrame, det: DataFrame, thresholds: Sequence[float], tolerance: float, frames: int, by: Sequence[str] = ()) -> DataFrame:
    """Per threshold: tp, fp, fn, tpr, fppi (false positives by frame).

    A ground-truth point is found if any detection of at least the threshold lies within tolerance in its frame. It
    credits the first such detection; detections that no point credits are false positives. Without points, tpr is 0.
    `by`: columns of det that separate groups; all groups share gt.
    """
    spark = gt.sparkSession
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    reached = lambda z: F.explode(F.filter(levels, lambda t: z >= t))
    near = in_tolerance(gt, det, tolerance, by).withColumn("threshold", reached(F.col("z")))
    credited = near.groupBy("threshold", *by, "frame", "gt_id", "x", "y").agg(F.min("det_idx").alias("det_idx"))
    hits = credited.groupBy("threshold", *by).agg(F.count("*").alias("tp"), F.count_distinct("frame", "det_idx").alias("credited"))
    counts = det.withColumn("threshold", reached(F.col("z"))).groupBy("threshold", *by).agg(F.count("*").alias("n_det"))
    grid = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    if by:
        grid = grid.crossJoin(det.select(*by).distinct())
    total = gt.agg(F.count("*").alias("n_gt"))
    out = grid.join(counts, ["threshold", *by], "left").join(hits, ["threshold", *by], "left").crossJoin(F.broadcast(total))
    out = out.fillna(0, ["n_det", "tp", "credited"])
    fp = F.col("n_det") - F.col("credited")
    return out.select("threshold", *by, "tp", fp.alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"), ratio(F.col("tp"), F.col("n_gt")).alias("tpr"), (fp / F.lit(float(frames))).alias("fppi"))


def truncated_auc(points: DataFrame, limit: float, by: Sequence[str], order: str = "threshold") -> DataFrame:
    """Area under tpr over fppi up to a limit, by group: trapezoids from (0, 0) to the limit, the last point carried on.

    Of points with the same fppi the one that comes first in the sweep (descending `order`) counts.
    """
    keep = Window.partitionBy(*by, "fppi").orderBy(F.desc(order))
    inside = points.where(F.col("fppi") <= limit).withColumn("_k", F.row_number().over(keep)).where("_k = 1").select(*by, "fppi", "tpr")
    ends = inside.groupBy(*by).agg(F.min("fppi").alias("low"), F.max_by("tpr", "fppi").alias("top"), F.max("fppi").alias("high"))
    start = ends.where("low > 0").select(*by, F.lit(0.0).alias("fppi"), F.lit(0.0).alias("tpr"))
    stop = ends.where(F.col("high") < limit).select(*by, F.lit(float(limit)).alias("fppi"), F.col("top").alias("tpr"))
    along = Window.partitionBy(*by).orderBy("fppi")
    every = inside.unionByName(start).unionByName(stop)
    piece = (F.col("fppi") - F.lag("fppi").over(along)) * (F.col("tpr") + F.lag("tpr").over(along)) / 2
    area = every.withColumn("piece", piece).groupBy(*by).agg(F.coalesce(F.sum("piece"), F.lit(0.0)).alias("auc"))
    return points.select(*by).distinct().join(area, list(by), "left").fillna(0.0, ["auc"]) if by else area


def operating_points(points: DataFrame, limit: float, by: Sequence[str], order: str = "threshold") -> DataFrame:
    """The best balanced point of each group: the first of largest tpr - fppi / limit, ranked over groups."""
    points = points.withColumn("balance", F.col("tpr") - F.col("fppi") / limit)
    first = Window.partitionBy(*by).orderBy(F.desc("balance"), F.desc(order))
    best = points.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("balance"), *by)))  # a row for each group


def cheapest_full(points: DataFrame, by: Sequence[str], top: int) -> DataFrame:
    """Of each group the full-recall point with the fewest false positives; the first `top` groups."""
    full = points.where(F.col("tpr") >= 1 - 1e-9).groupBy(*by).agg(F.min(F.struct("fppi", "threshold")).alias("best"))
    return full.select(*by, "best.fppi", "best.threshold").orderBy("fppi", *by).limit(top)


def coverage_threshold(gt: DataFrame, det: DataFrame, tolerance: float) -> DataFrame:
    """Per identifier the highest threshold at which any of its points is found; null if none ever is."""
    best = in_tolerance(gt, det, tolerance).groupBy("gt_id").agg(F.max("z").alias("best_z"))
    return gt.select("gt_id").distinct().join(best, "gt_id", "left")


def detection_latency(onsets: DataFrame, detections: DataFrame, by: str, at: str) -> DataFrame:
    """Per onset, the time from it to the first detection at or after it and before the next onset of its object; null if none."""
    held = asof_backward(detections.select(by, at), onsets.select(by, at, F.col(at).alias("onset")), [by], at, ["onset"])
    first = held.where("onset is not null").groupBy(by, "onset").agg(F.min(at).alias("found"))
    return onsets.select(by, F.col(at).alias("onset")).distinct().join(first, [by, "onset"], "left").withColumn("latency", F.col("found") - F.col("onset"))


def located_latency(truth: DataFrame, detections: DataFrame, by: str, at: str, tolerance: float) -> DataFrame:
    """Per identifier the first detection at or after its onset that lies near its place at that time, or its last one before.

    truth: by, at, x, y for every time at which the object is somewhere; its onset is the first. detections: at, x, y and
    by, the identifiers whose objects may be meant.
    """
    held = asof_backward(detections.select(by, at, F.col("x").alias("dx"), F.col("y").alias("dy")), truth.select(by, at, "x", "y"), [by], at, ["x", "y"])
    near = held.where(F.sqrt(F.pow(F.col("dx") - F.col("x"), 2) + F.pow(F.col("dy") - F.col("y"), 2)) <= tolerance)
    first = near.groupBy(by).agg(F.min(at).alias("found"))
    onsets = truth.groupBy(by).agg(F.min(at).alias("onset"))
    return onsets.join(first, by, "left").withColumn("latency", F.col("found") - F.col("onset"))


def match_metrics(truth: DataFrame, candidates: DataFrame, eligible: DataFrame, matches: DataFrame, gt: str, cand: str, means: Sequence[str] = ()) -> DataFrame:
    """One row: counts, TP, FP, FN, precision and recall of one-to-one matches, means of columns of matches, and how many
    candidates are duplicates (eligible but unmatched), truths split (several eligible) and candidates merged."""
    one = lambda df, *aggs: F.broadcast(df.agg(*aggs))  # one row each
    by_gt = eligible.groupBy(gt).agg(F.count_distinct(cand).alias("n"))
    by_cand = eligible.groupBy(cand).agg(F.count_distinct(gt).alias("n"))
    out = truth.agg(F.count("*").alias("count_gt")).crossJoin(one(candidates, F.count("*").alias("count_candidate")))
    out = out.crossJoin(one(matches, F.count("*").alias("TP"), *[F.avg(c).alias(f"mean_{c}") for c in means], *[F.avg(F.abs(c)).alias(f"mean_abs_{c}") for c in means]))
    out = out.crossJoin(one(by_cand.join(matches.select(cand).distinct(), cand, "left_anti"), F.count("*").alias("duplicate_candidate_count")))
    out = out.crossJoin(one(by_gt, F.count_if(F.col("n") > 1).alias("split_ground_truth_count"))).crossJoin(one(by_cand, F.count_if(F.col("n") > 1).alias("merged_candidate_count")))
    share = lambda n, of: F.coalesce(ratio(F.col(n), F.col(of)), F.lit(0.0))
    return out.withColumns(
        {
            "FP": F.col("count_candidate") - F.col("TP"), "FN": F.col("count_gt") - F.col("TP"), "precision": share("TP", "count_candidate"), "recall": share("TP", "count_gt"),
            "duplicate_rate": share("duplicate_candidate_count", "count_candidate"), "split_rate": share("split_ground_truth_count", "count_gt"),
            "merge_rate": share("merged_candidate_count", "count_candidate"),
        }
    )


def latency_summary(latencies: DataFrame, value: str = "latency") -> DataFrame:
    v = F.col(value)
    return latencies.agg(
        F.count("*").alias("n_onsets"), F.count(v).alias("n_found"), F.avg(v).alias("mean_latency"), F.median(v).alias("median_latency"), F.min(v).alias("min_latency"), F.max(v).alias("max_latency"),
    )


def false_positive_taxonomy(detections: DataFrame, structures: DataFrame, radius: float) -> DataFrame:
    """Counts and shares of detections near a structure of their frame and of others."""
    places = structures.select("frame", F.col("x").alias("sx"), F.col("y").alias("sy"))
    marked = binned_join(detections.select("frame", "det_idx", "x", "y"), places, ["frame"], [("x", "sx", radius), ("y", "sy", radius)], "left_semi", circle=radius)
    near = marked.agg(F.count("*").alias("near"))
    total = detections.agg(F.count("*").alias("total"))
    both = near.crossJoin(total)
    rows = both.select(F.explode(F.array(F.struct(F.lit("structure").alias("category"), F.col("near").alias("n")), F.struct(F.lit("isolated").alias("category"), (F.col("total") - F.col("near")).alias("n")))).alias("r"), "total")
    return rows.select("r.category", "r.n", (100 * ratio(F.col("r.n"), F.col("total"))).alias("percentage"))


def _bisect(f, low: float, high: float) -> float:
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) > 0 else (low, mid)
    return (low + high) / 2


def _binomial_tail(k: int, n: int, p: float) -> float:
    """Probability of k or more of n."""
    if p <= 0:
        return float(k <= 0)
    if p >= 1:
        return 1.0
    i = np.arange(k, n + 1)
    logs = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in i.tolist()]
    return float(np.exp(logs).sum())


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact interval of a share of k in n; (0, 0) without trials."""
    if n <= 0:
        return 0.0, 0.0
    alpha = (1 - level) / 2
    low = 0.0 if k == 0 else _bisect(lambda p: alpha - _binomial_tail(k, n, p), 0, 1)
    high = 1.0 if k == n else _bisect(lambda p: (1 - alpha) - _binomial_tail(k + 1, n, p), 0, 1)
    return low, high


def _poisson_at_most(k: int, mean: float) -> float:
    return float(sum(math.exp(-mean + j * math.log(mean) - math.lgamma(j + 1)) for j in range(k + 1))) if mean > 0 else 1.0


def poisson_interval(k: int, exposure: float, level: float = 0.95) -> tuple[float, float]:
    """Exact interval of a rate from k events in an exposure."""
    alpha, top = (1 - level) / 2, 10.0 * (k + 10)
    low = 0.0 if k == 0 else _bisect(lambda m: alpha - (1 - _poisson_at_most(k - 1, m)), 0, top)
    high = _bisect(lambda m: _poisson_at_most(k, m) - alpha, 0, top)
    return low / exposure, high / exposure


def bootstrap_coverage(found: DataFrame, n_total: int, replicates: int = 200, seed: int = 5) -> DataFrame:
    """Percentile interval of the share of identifiers among resampled true positives (gt_id).

    Each replicate draws every true positive a Poisson(1) number of times, which resamples without gathering them.
    """
    copies = found.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    draw = F.pmod(F.xxhash64("gt_id", "frame", "replicate", F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    kept = copies.where(draw >= math.exp(-1))  # drawn at least once
    shares = kept.groupBy("replicate").agg((F.count_distinct("gt_id") / F.lit(float(n_total))).alias("share"))
    return shares.agg(F.percentile("share", 0.025).alias("low"), F.percentile("share", 0.975).alias("high"))


def drift(gt: DataFrame) -> DataFrame:
    """(gt_id, first, last, duration, distance): how far each identifier's last place lies from its first, in one grouping.

    gt: frame, gt_id, x, y. Of several places in one frame the smallest counts.
    """
    ends = gt.groupBy("gt_id").agg(F.min(F.struct("frame", "x", "y")).alias("a"), F.max("frame").alias("last"), F.min(F.struct((-F.col("frame")).alias("k"), "x", "y")).alias("b"))
    return ends.select("gt_id", F.col("a.frame").alias("first"), "last", (F.col("last") - F.col("a.frame") + 1).alias("duration"), F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")).alias("distance"))


def ground_truth_summary(gt: DataFrame, voxels: int, pixel_um: float = 0.5) -> DataFrame:
    """One row: points, identifiers, share of all voxels that are points (percent), the largest drift in pixels and micrometres; zeros without points."""
    counts = gt.agg(F.count("*").alias("points"))
    whole = drift(gt).agg(F.count("*").alias("identifiers"), F.coalesce(F.max("distance"), F.lit(0.0)).alias("max_drift"))
    share = 100 * F.col("points") / F.lit(float(voxels)) if voxels > 0 else F.lit(0.0)
    return counts.crossJoin(F.broadcast(whole)).select("points", "identifiers", share.alias("occupancy"), "max_drift", (F.col("max_drift") * pixel_um).alias("max_drift_um"))  # one row each


def found_by_id(gt: DataFrame, det: DataFrame, tolerance: float, threshold: float) -> DataFrame:
    """(gt_id, points, found, missed) of every identifier: its points that a detection of at least the threshold lies near."""
    near = in_tolerance(gt, det.where(F.col("z") >= threshold), tolerance).select("frame", "gt_id", "x", "y").distinct()
    counted = near.groupBy("gt_id").agg(F.count("*").alias("found"))
    points = gt.select("frame", "gt_id", "x", "y").distinct().groupBy("gt_id").agg(F.count("*").alias("points"))
    out = points.join(counted, "gt_id", "left").fillna(0, ["found"])
    return out.withColumn("missed", F.col("points") - F.col("found"))


def unique_rate(found: DataFrame) -> DataFrame:
    """One row from found_by_id: identifiers, those found at least once, and their share (0 without identifiers)."""
    return found.agg(F.count("*").alias("identifiers"), F.count_if(F.col("found") > 0).alias("detected")).withColumn("rate", ratio(F.col("detected"), F.col("identifiers")))


def best_by_level(points: DataFrame, by: Sequence[str], levels: int, order: str = "threshold") -> DataFrame:
    """For each of the highest numbers of true positives the point with the fewest false positives by frame, ties by `by` and descending order."""
    first = Window.partitionBy("tp").orderBy("fppi", *by, F.desc(order))
    best = points.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    return best.orderBy(F.desc("tp")).limit(levels)


def cutoff_sweep(rows: DataFrame, score: str, size: str, cutoffs: Sequence[float], frames: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, cutoff, kept, kept_size, and both by frame) of rows whose score reaches each cut-off, from one pass.

    Rows are counted by how many cut-offs they reach; a cut-off keeps the counts of its own and all higher ones, which
    are a row for each cut-off and group.
    """
    levels = sorted(set(map(float, cutoffs)))
    reached = sum((F.when(F.col(score) >= c, 1).otherwise(0) for c in levels), F.lit(0))
    counts = rows.groupBy(*by, reached.alias("_k")).agg(F.count("*").alias("_n"), F.coalesce(F.sum(size), F.lit(0)).alias("_s"))
    grid = F.array(*[F.struct(F.lit(k + 1).alias("need"), F.lit(c).alias("cutoff")) for k, c in enumerate(levels)])
    each = counts.select(*by, "_k", "_n", "_s", F.explode(grid).alias("_g"))
    over = lambda c: F.coalesce(F.sum(F.when(F.col("_k") >= F.col("_g.need"), F.col(c))), F.lit(0))
    out = each.groupBy(*by, F.col("_g.cutoff").alias("cutoff")).agg(over("_n").alias("kept"), over("_s").alias("kept_size"))
    return out.withColumns({"kept_by_frame": F.col("kept") / F.lit(float(frames)), "size_by_frame": F.col("kept_size") / F.lit(float(frames))})
