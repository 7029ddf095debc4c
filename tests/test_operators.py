import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.functions import expr, sql
from frameloom.operators import activity, candidates, detection, diagnostics, review, signal


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_raster_and_population(spark):
    events = spark.createDataFrame([("b", 1), ("a", 1), ("a", 3), ("b", 4), ("a", 9)], "object_id string, frame int")
    raster = {(r.object_id, r.bin): r.n_events for r in activity.event_raster(events, 6, 2).collect()}
    assert [[raster[o, b] for b in range(3)] for o in "ab"] == [[1, 1, 0], [1, 0, 1]]
    bins = activity.population_activity(events, 6, 2).orderBy("bin").collect()
    assert [(r.total_events, r.active_objects, r.active_fraction, r.coactive, r.is_peak) for r in bins] == [(2, 2, 1.0, 1, 1), (1, 1, 0.5, 0, 0), (1, 1, 0.5, 0, 0)]


def test_correlation_with_constant_series(spark):
    values = {"a": [0, 1, 2], "b": [2, 1, 0], "c": [5, 5, 5]}
    rows = spark.createDataFrame([(k, i, float(v)) for k, x in values.items() for i, v in enumerate(x)], "o string, t int, v double")
    found = {(r.a, r.b): (round(r.r, 9), r.defined) for r in activity.correlation(rows, "o", "t", "v", 3).collect()}
    assert found == {("a", "b"): (-1.0, 1), ("a", "c"): (0.0, 0), ("b", "c"): (0.0, 0)}


def test_froc_credits_the_first_detection(spark):
    gt = spark.createDataFrame([(0, 1, 10.0, 5.0), (0, 2, 11.0, 5.0), (1, 1, 10.0, 5.0)], "frame int, gt_id int, x double, y double")
    det = spark.createDataFrame([(0, 0, 10.5, 6.0, 5.0), (0, 1, 10.6, 5.0, 9.0), (2, 0, 10.0, 5.0, 9.0)], "frame int, det_idx int, x double, y double, z double")
    found = {r.threshold: (r.tp, r.fp, r.fn) for r in detection.froc_sweep(gt, det, [9.0, 1.0], 2.0, 3).collect()}
    assert found == {9.0: (2, 1, 1), 1.0: (2, 2, 1)}
    none = detection.froc_sweep(gt.limit(0), det, [1.0], 2.0, 3).collect()[0]
    assert (none.tp, none.fp, none.fn, none.tpr) == (0, 3, 0, 0.0)
    # near in either coordinate, but not in the plane
    far = det.withColumn("y", F.col("y") + 1.9).withColumn("x", F.col("x") + 1.0)
    assert [(r.tp, r.fp) for r in detection.froc_sweep(gt, far, [9.0], 2.0, 3).collect()] == [(1, 1)]


@pytest.mark.parametrize(("points", "area"), [([(0.0, 0.0), (1.0, 1.0)], 0.5), ([(0.0, 0.0), (0.5, 0.5), (2.0, 1.0)], 0.375)])
def test_truncated_area(spark, points, area):
    df = spark.createDataFrame([("g", float(-k), x, y) for k, (x, y) in enumerate(points)], "g string, threshold double, fppi double, tpr double")
    assert detection.truncated_auc(df, 1.0, ["g"]).first().auc == pytest.approx(area)


def test_exact_intervals():
    low, high = detection.clopper_pearson(5, 10)
    assert (round(low, 4), round(high, 4)) == (0.1871, 0.8129)
    assert detection.clopper_pearson(0, 0) == (0.0, 0.0)
    low, high = detection.poisson_interval(3, 1.0)
    assert (round(low, 4), round(high, 4)) == (0.6187, 8.7673)


def test_bootstrap_stays_below_the_estimate(spark):
    found = spark.createDataFrame([(k % 10, k) for k in range(30)], "gt_id int, frame int")
    out = detection.bootstrap_coverage(found, 10).first()
    assert 0.5 < out.low <= out.high <= 1.0


def test_kappa_rules(spark):
    one = lambda rows: review.cohen_kappa(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()
    assert one([(1, 1), (0, 0)]).kappa == 1.0
    mixed = one([(1, 1), (1, 0), (0, 0), (0, 0), (1, None)])
    assert (mixed.n, mixed.observed, mixed.expected, mixed.kappa) == (4, 0.75, 0.5, 0.5)
    assert one([(1, 1), (1, 1)]).kappa == 1.0
    assert (one([]).n, one([]).kappa) == (0, 0.0)


def test_agreement_counts_both_sides(spark):
    a = spark.createDataFrame([(1, "r", "yes"), (2, "r", "no"), (3, "s", None)], "id int, g string, label string")
    b = spark.createDataFrame([(1, "r", "yes"), (2, "r", "yes"), (4, "s", "no")], "id int, g string, label string")
    total = review.agreement(a, b, "id", "label", "g").where("overall = 1").first()
    assert (total.subjects, total.both_labelled, total.equal, total.to_settle, total.missing_first, total.missing_second) == (4, 2, 1, 1, 2, 1)
    assert [r[0] for r in rows_of(review.disagreements(a, b, "id", "label"))] == [2, 4]


def test_next_batch_prefers_children_of_chosen_parents(spark):
    parents = spark.createDataFrame([(1, 5.0), (2, 1.0)], "p int, s double")
    children = spark.createDataFrame([(1, 10, 1.0), (2, 20, 1.5)], "p int, c int, t double")
    out = review.next_batch(parents, children, "p", "c", "s", "t", 1, 1).collect()
    assert [(r.kind, r.id) for r in out] == [("parent", 1), ("child", 10)]


def test_reviewer_backfill(spark):
    df = spark.createDataFrame([(1, "", "accepted"), (2, "x", "accepted"), (3, None, "unlabelled")], "id int, r string, state string")
    out = {r.id: r.r for r in review.with_reviewer(df, "r", "me", F.col("state") == "accepted").collect()}
    assert out == {1: "me", 2: "x", 3: None}


def test_rank_is_total_and_ties_go_by_identifier(spark):
    df = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("s"))
    got = [r.id for r in candidates.ranked(df, "s", "id").orderBy("rank").collect()]
    assert got == [k for k in sorted(range(200), key=lambda k: (-(k % 7), k))]


def test_clusters_follow_chains(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0, 1.0), ("b", 4.0, 0.0, 2.0), ("c", 8.0, 0.0, 3.0), ("d", 90.0, 0.0, 4.0)], "i string, x double, y double, area double")
    links = candidates.near_links(df, "i", "x", "y", 4.1)
    assert [r[:2] for r in rows_of(links)] == [("a", "b"), ("b", "c")]
    only = candidates.clusters(df, links, "i", "x", "y", "area").collect()
    assert [(r.component, r.n_members, r.cx, r.total_area, r.min_distance) for r in only] == [("a", 3, 4.0, 6.0, 4.0)]


def test_consensus_and_overlap(spark):
    runs = spark.createDataFrame([(r, c) for r, cs in (("a", (1, 2, 3)), ("b", (2, 3, 4)), ("c", (3, 4, 5))) for c in cs], "run string, c int")
    found = candidates.consensus(runs, "run", "c").collect()
    assert sorted(r.c for r in found if r.in_all) == [3] and sorted(r.c for r in found if r.unique) == [1, 5] and len(found) == 5
    assert {(r.run_a, r.run_b): r.jaccard for r in candidates.run_overlap(runs, "run", "c").collect()}["a", "b"] == 0.5


def test_overlap_of_boxes(spark):
    out = spark.range(1).select(expr.overlap([F.lit(float(v)) for v in (0, 0, 4, 4)], [F.lit(float(v)) for v in (1, 1, 4, 4)]).alias("v")).first().v
    assert out == pytest.approx(9 / 23)


def test_timestamps(spark):
    df = spark.createDataFrame([("g", k, t) for k, t in enumerate([0.0, 0.1, 0.1, None, 0.5])], "g string, k int, t double")
    out = diagnostics.timestamp_diagnostics(df, ["g"], "k", "t").first()
    assert (out.n_missing, out.n_repeated, out.n_falling, out.n_gaps) == (1, 1, 0, 1)


def test_latency_percentiles_and_budget(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (8.0,)], "v double")
    out = diagnostics.latency_percentiles(df, [], "v", 5.0).first()
    assert (out.p50, out.p99, out.max_value, out.n_over, out.meets_budget) == (2.0, 8.0, 8.0, 1, 0)


def test_kalman_and_ewma_are_their_loops(spark):
    rng = np.random.default_rng(2)
    trace = rng.normal(size=40).tolist()
    df = spark.createDataFrame([(trace,), ([],)], "t array<double>")
    got = df.select(signal.kalman_innovation(F.col("t")).alias("k"), signal.ewma_z(F.col("t"), 0.1).alias("e")).collect()
    level, want = trace[0], []
    for x in trace:
        e = x - level
        want.append(max(0.0, e))
        level += (0.11 if e < 0 else 0.015 if e > 2.5 else 0.08) * e
    assert got[0].k == pytest.approx(want)
    m, v, want = trace[0], 1.0, []
    for x in trace:
        e = x - m
        want.append(e / math.sqrt(v + 1e-6))
        m, v = m + 0.1 * e, 0.9 * v + 0.1 * e * e
    assert got[0].e == pytest.approx(want) and got[1].k is None


def test_highpass_holds_the_ends(spark):
    values = [float(k * k % 11) for k in range(30)]
    df = spark.createDataFrame([("g", k, v) for k, v in enumerate(values)], "g string, t int, v double")
    got = [r.low for r in signal.highpass(df, ["g"], "t", "v", 1.5, 0, 29).orderBy("t").collect()]
    w = signal.gaussian_weights(1.5)
    radius = len(w) // 2
    want = [sum(x * values[min(29, max(0, k + j - radius))] for j, x in enumerate(w)) for k in range(30)]
    assert got == pytest.approx(want)


def test_cfar_finds_two_spots_on_a_slope(spark):
    y, x = np.mgrid[:28, :34]
    image = (0.08 * x + 0.03 * y).astype(float)
    image[9, 7] += 8
    image[20, 27] += 8
    rows = [(k, 28, 34, (image if k == 1 else 0.08 * x + 0.03 * y).astype(float).ravel().tolist()) for k in range(3)]
    frames = spark.createDataFrame(rows, "frame int, height int, width int, pixels array<float>")
    found = {(r.frame, r.y, r.x) for r in signal.cfar_detections(frames).collect()}
    assert {(1, 9, 7), (1, 20, 27)} <= found and len(found) < 0.02 * 3 * 28 * 34


@pytest.mark.parametrize("eight", [True, False])
def test_labels_are_flood_fills(eight):
    mask = np.random.default_rng(3).random((20, 23)) < 0.45
    parts = signal.labelled(mask, eight)
    seen, want, n = np.zeros(mask.shape, bool), np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if seen[y, x]:
            continue
        n += 1
        stack = [(y, x)]
        seen[y, x] = True
        while stack:
            a, b = stack.pop()
            want[a, b] = n
            for da in (-1, 0, 1):
                for db in (-1, 0, 1):
                    c, d = a + da, b + db
                    if (eight or da * db == 0) and 0 <= c < 20 and 0 <= d < 23 and mask[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        stack.append((c, d))
    assert np.array_equal(parts, want)


def test_components_keep_what_is_large_enough(spark):
    image = np.zeros((6, 6))
    image[1:3, 1:3], image[5, 5] = 5, 9
    frames = spark.createDataFrame([(0, 6, 6, image.ravel().tolist())], "frame int, height int, width int, pixels array<float>")
    only = signal.components(frames, 1.0, 2).collect()
    assert [(r.x, r.y, r.area, r.bw, r.bh) for r in only] == [(1.5, 1.5, 4, 2, 2)]


def test_shift_is_found(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(16, 16))
    moved = np.roll(base, (2, -1), (0, 1))
    frames = spark.createDataFrame([(0, 16, 16, moved.ravel().tolist())], "frame int, height int, width int, pixels array<float>")
    out = signal.rigid_shifts(frames, base, 3).first()
    assert (out.dy, out.dx) == (-2, 1)


def test_peaks_apart(spark):
    df = spark.createDataFrame([("g", t) for t in (1, 2, 4, 5, 9)], "g string, t bigint")
    assert [r[1] for r in rows_of(signal.apart(df, ["g"], "t", 3))] == [1, 4, 9]


def test_traces_and_rings(spark):
    frames = spark.createDataFrame([(k, 6, 6, [float(k)] * 36) for k in range(3)], "frame int, height int, width int, pixels array<float>")
    regions = spark.createDataFrame([("r", 2, 2), ("r", 2, 3)], "region string, y int, x int")
    long = signal.pixels(frames)
    assert [r.value for r in signal.region_traces(long, regions).orderBy("frame").collect()] == [0.0, 1.0, 2.0]
    ring = {(r.y, r.x) for r in signal.ring_pixels(regions, 1, 2).collect()}
    assert (2, 2) not in ring and (2, 1) not in ring and (0, 2) in ring
    assert signal.projections(long).first().n_active == 1


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT safe_ratio(1, 0) a, clamp(5, 0, 2) b, nearest_rank(array(1D, 2D, 8D), 0.95D) c, binary_kappa(0.75D, 0.5D, 0.25D) d, frame_seconds(10, 5D) e").first()
    assert tuple(row) == (0.0, 2.0, 8.0, 0.5, 2.0)


def test_expressions(spark):
    df = spark.createDataFrame([("roi_10", "1e3", "A\tb\n"), ("roi_9", "nan", None)], "i string, n string, t string")
    out = df.orderBy(*expr.natural_key(F.col("i"))).select("i", expr.finite(F.col("n")).alias("n"), expr.plain_text(F.col("t")).alias("t")).collect()
    assert [tuple(r) for r in out] == [("roi_9", None, ""), ("roi_10", 1000.0, "A b ")]
