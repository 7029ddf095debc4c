import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import images, scoring, signal

FRAME = "frame int, height int, width int, pixels array<float>"


def test_convolution_is_the_loop():
    rng = np.random.default_rng(1)
    image, kernel = rng.normal(size=(9, 11)), images.gamma_disc(5, 0.4)
    for mode in ("constant", "reflect"):
        padded = np.pad(image, 2, mode=mode)
        want = np.array([[(padded[y : y + 5, x : x + 5] * kernel).sum() for x in range(11)] for y in range(9)])
        assert np.allclose(images.convolved(image, kernel, mode), want)
    assert images.gamma_decay(0) == 0 and math.isclose(math.exp(-images.gamma_decay(3) * 3), 0.5)
    assert math.isclose(images.gamma_profile(19, 0.2).sum(), 1)


def test_clutter_scores_mark_the_spot():
    image = np.random.default_rng(2).normal(size=(30, 30))
    image[12, 17] += 15
    z = images.gamma_cfar(image, 0.2)
    assert np.unravel_index(z.argmax(), z.shape) == (12, 17)


def test_background_fold_is_its_loop(spark):
    trace = np.random.default_rng(3).normal(size=30).tolist()
    got = spark.createDataFrame([(trace,)], "t array<double>").select(images.correntropy_fold(F.col("t"), 0.3, 0.8).alias("b")).first().b
    x, want = trace[0], []
    for v in trace:
        e = v - x
        x += 0.3 / 0.64 * math.exp(-e * e / 1.28) * e
        want.append(x)
    assert got == pytest.approx(want)


def test_temporal_filter_is_the_loop(spark):
    values = [float(k * 7 % 5) for k in range(25)]
    df = spark.createDataFrame([(k, 0, 0, v) for k, v in enumerate(values)], "frame int, y int, x int, v double")
    w = images.gamma_profile(5, 0.5)
    padded = np.pad(values, 2)
    got = [r.v for r in images.temporal_gamma(df, 0.5, 5).orderBy("frame").collect()]
    assert got == pytest.approx([float((padded[k : k + 5] * w).sum()) for k in range(25)])


def test_peaks_and_growth(spark):
    image = np.zeros((20, 20))
    image[5, 5], image[5, 7], image[15, 15] = 9, 8, 7
    frames = spark.createDataFrame([(0, 20, 20, image.ravel().tolist())], FRAME)
    assert [(r.y, r.x) for r in images.peaks(frames, 5.0, 1, 4.0, 5).orderBy("place").collect()] == [(5, 5), (15, 15)]
    blob = np.zeros((10, 10))
    blob[2:5, 2:5], blob[8, 8] = 3, 3
    assert images.grown(blob, 3, 3, 2.0, 9.0).sum() == 9 and images.grown(blob, 3, 3, 2.0, 1.0).sum() == 5


def test_coherence_of_neighbours(spark):
    rows = [(t, 0, x, float(t if x < 2 else -t)) for t in range(5) for x in range(3)]
    out = {r.x: r.coherence for r in images.local_correlation(spark.createDataFrame(rows, "frame int, y int, x int, v double")).collect()}
    assert out[0] == pytest.approx(1.0) and out[1] == pytest.approx(0.5) and out[2] == pytest.approx(0.0)


def test_shapes(spark):
    circle = images.circle_pixels(spark.createDataFrame([("c", 5.0, 5.0, 2.0)], "region string, cx double, cy double, radius double"))
    assert circle.count() == 13
    points = [(1.5, 1.5), (6.5, 1.5), (6.5, 4.5), (1.5, 4.5)]
    lasso = images.lasso_pixels(spark.createDataFrame([("l", points)], "region string, points array<struct<x double, y double>>"))
    assert {(r.y, r.x) for r in lasso.collect()} == {(y, x) for y in range(2, 5) for x in range(2, 7)}
    box = images.shape_summary(lasso.unionByName(lasso)).first()
    assert (box.area, box.bx, box.by, box.bw, box.bh, box.cx) == (15, 2, 2, 5, 3, 4.0)


def test_chunks_equal_the_whole(spark):
    stack = np.random.default_rng(4).normal(size=(13, 12, 14)).astype(np.float32)
    frames = spark.createDataFrame([(k, 12, 14, x.ravel().tolist()) for k, x in enumerate(stack)], FRAME)
    score = lambda part: np.stack([signal.annular_cfar(x.astype(np.float64), 1, 3, 0.05)[0] for x in part])
    got = images.frame_chunks(frames, 5, score, FRAME).orderBy("frame").collect()
    assert np.allclose(np.stack([np.reshape(r.pixels, (12, 14)) for r in got]), score(stack), atol=1e-5)
    with pytest.raises(Exception, match="went in"):
        images.frame_chunks(frames, 5, lambda part: part[:1], FRAME).count()


def test_power_of_a_wave(spark):
    y, x = np.mgrid[:32, :32]
    frames = spark.createDataFrame([(0, 32, 32, np.sin(2 * np.pi * 8 * x / 32).ravel().tolist())], FRAME)
    power = [r.power for r in images.radial_power(frames, 8).orderBy("bin").collect()]
    assert int(np.argmax(power)) == int(8 / math.hypot(16, 16) * 8)


def test_artifact_outranks_a_clean_region(spark):
    schema = "id int, area double, artifact_score double, background_correlation double, local_correlation double, trace_snr double, elongation double, event_count int, event_support double"
    df = spark.createDataFrame([(7, 220.0, 0.7, 0.8, 0.2, 0.5, 9.0, 0, 0.0), (1, 60.0, 0.0, 0.1, 0.8, 3.0, 1.2, 4, 0.6)], schema)
    c = {k: F.col(k) for k in df.columns if k != "id"}
    no = F.lit(False)
    rows = df.select("id", scoring.artifact_risk(c, no, no).alias("risk"), scoring.region_priority(c, no, no).alias("p"), scoring.region_reasons(c, no).alias("why"), scoring.conflict(c).alias("x")).orderBy("id").collect()
    assert rows[1].risk >= 0.4 > rows[0].risk and rows[0].p > rows[1].p
    assert rows[0].why == ["unlabeled ROI", "4 candidate events", "usable trace SNR", "locally coherent", "event-supported footprint"] and "artifact risk" in rows[1].why
    assert rows[0].p == pytest.approx(4 * 0.45 + 3 * 0.25 + 0.8 * 1.2 + 0.6 * 1.1 + 2.0 + 0.35)


def test_local_scores():
    image = np.random.default_rng(6).normal(size=(12, 12))
    image[6, 6] += 20
    for z in (images.local_z(image, 3, 0.1), images.local_median_z(image, 3)):
        assert np.unravel_index(z.argmax(), z.shape) == (6, 6) and z.min() == 0
    flat = images.smoothed(np.ones((5, 5)))
    assert np.allclose(flat, 1) and images.normalised(image).max() == 1


def test_samples_and_neighbours(spark):
    long = spark.createDataFrame([(f, y, x, float(x)) for f in range(2) for y in range(3) for x in range(3)], "frame int, y int, x int, v double")
    truth = spark.createDataFrame([(0, 1, 1), (0, 9, 9), (1, 0, 0), (1, 2, 2)], "frame int, y int, x int")
    kinds = {(r.frame, r.kind): r.n for r in images.pixel_samples(long, truth).groupBy("frame", "kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {(0, "foreground"): 1, (0, "background"): 1, (1, "foreground"): 2, (1, "background"): 2}
    parts = spark.createDataFrame([(1, 0, 1, 1, 1, 1), (5, 0, 0, 0, 1, 1)], "frame int, det_idx int, bx int, by int, bw int, bh int")
    near = {(r.frame): (r.n_near, r.n_frames) for r in images.neighbouring_activity(parts, long, 1).collect()}
    assert near == {1: (9, 1), 5: (0, 0)}
    days = spark.createDataFrame([(2,), (5,), (9,)], "frame int")
    assert tuple(images.active_neighbours(days, 9).first()) == (5, 2)


def test_histograms_and_ranks(spark):
    from frameloom.functions import expr
    from frameloom.operators import diagnostics
    from frameloom.plans.pipeline import preset_runs

    df = spark.createDataFrame([("g", float(k)) for k in range(10)] + [("g", float("nan")), ("g", None)], "g string, v double")
    assert {r.bin: r.n for r in diagnostics.histogram(df, "v", 0, 10, 5).collect()} == {k: 2 for k in range(5)}
    row = diagnostics.distribution(df.where("v < 10"), ["g"], "v").first()
    assert (row.n, row.low, row.high, row.p25, row.p75) == (10, 0.0, 9.0, 2.0, 7.0)
    cells = spark.createDataFrame([(1, 1, 0.1, 1), (1, 1, 0.2, 2), (1, 2, 0.3, 3)], "a int, b int, auc double, pos int")
    assert tuple(diagnostics.sensitivity(cells, "a", "b", "auc", "pos").first()) == (1, 0.2, 0.3)
    times = spark.createDataFrame([("2024-01-01T00:00:00Z", "2024-01-01T00:00:02.5Z"), ("x", "2024-01-01T00:00:00Z")], "a string, b string")
    assert [r[0] for r in times.select(expr.duration_seconds(F.col("a"), F.col("b"))).collect()][:1] == [2.5]
    runs = preset_runs({"id": "s", "steps": [{"id": "z", "stage": "robust_positive_local_z"}, {"id": "c", "stage": "component_filter"}]})
    assert [r["id"] for r in runs] == ["s_permissive", "s_balanced", "s_strict", "s_artifact_suppression", "s_high_recall"]
    assert runs[4]["steps"][1]["params"] == {"seed_z": 1.4, "grow_z": 0.7, "min_area_px": 3} and not runs[4]["steps"][0]["params"]
