"""Split frame stacks, linear scans, grown regions, as-of joins by range, wildcard matching, and the stages made of them."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import joins, regions, scans, signal, video
from frameloom.plans.pipeline import default_registry
from frameloom.sources import readers, stacks

RNG = np.random.default_rng(5)


def frames_of(spark, stack):
    return spark.createDataFrame([(k, *x.shape, x.astype(float).ravel().tolist()) for k, x in enumerate(stack)], video.FRAMES).repartition(3)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("stacks")
    one, two = RNG.integers(0, 4000, (37, 5, 7)).astype(np.uint16), RNG.normal(size=(10, 3, 4))
    np.save(out / "a.npy", one)
    np.save(out / "b.npy", np.asfortranarray(two))
    return out, one, two


@pytest.mark.parametrize("chunk", [1, 8, 64])
def test_stacks_are_read_by_ranges(spark, folder, chunk):
    path, one, two = folder
    df = readers.npy_frames(spark, str(path), chunk)
    rows = sorted(df.collect(), key=lambda r: (r.source, r.frame))
    assert [r.frame for r in rows] == [*range(37), *range(10)]
    for r, want in zip(rows, [*one, *two], strict=True):
        assert (r.height, r.width) == want.shape and np.array_equal(np.float32(r.pixels), want.astype(np.float32).ravel())
    assert df.rdd.getNumPartitions() == -(-37 // chunk) + -(-10 // chunk)


def test_conditions_on_frames_prune_ranges(spark, folder):
    path, one, _ = folder
    df = readers.npy_frames(spark, str(path / "a.npy"), 8).where("frame >= 17 and frame < 20")
    assert sorted(r.frame for r in df.select("frame").collect()) == [17, 18, 19]
    assert df.rdd.getNumPartitions() == 1
    assert readers.npy_frames(spark, str(path), 8).where("frame > 100").count() == 0
    reader = stacks._Reader([f"{path}/a.npy"], 10)
    assert [(p.first, p.stop) for p in reader.partitions()] == [(0, 10), (10, 20), (20, 30), (30, 37)]


def test_a_large_stack_is_never_read_whole(spark, tmp_path, monkeypatch):
    big = np.lib.format.open_memmap(tmp_path / "big.npy", "w+", np.uint8, (40_000, 250, 250))  # 2.5 GB, more than a cell can hold
    big[39_999, 3, 4] = 7
    big.flush()
    del big
    row = readers.npy_frames(spark, str(tmp_path), 16).where("frame = 39999").first()
    assert row.pixels[3 * 250 + 4] == 7 and sum(row.pixels) == 7


def test_stacks_that_cannot_be_read_are_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        stacks.frame_stacks(spark, str(tmp_path))
    np.save(tmp_path / "flat.npy", np.zeros((3, 4)))
    with pytest.raises(Exception, match="3 are needed"):
        readers.npy_frames(spark, str(tmp_path)).count()


def test_long_tables_become_images(spark):
    rows = [(0, 1, 2, 5.0), (0, 0, 0, 1.0), (0, 1, 2, 7.0), (0, 9, 9, 3.0), (3, 0, 1, None), (None, 0, 0, 1.0)]
    got = {r.frame: np.reshape(r.pixels, (2, 3)).tolist() for r in readers.long_frames(spark.createDataFrame(rows, "frame int, y int, x int, v double"), 2, 3).collect()}
    assert got == {0: [[1, 0, 0], [0, 0, 7]], 3: [[0, 0, 0], [0, 0, 0]]}


def one_by_one(values, gain=0.08, spike_gain=0.015, spike=2.5, negative=0.11):
    level, out = values[0], []
    for x in values:
        e = x - level
        level += (negative if e < 0 else spike_gain if e > spike else gain) * e
        out.append(max(0.0, e))
    return out


def test_scans_carry_their_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        series = {k: RNG.normal(0, 3, n).tolist() for k, n in (("a", 100), ("b", 1), (None, 25), ("c", 60))}
        rows = [(k, t, v) for k, s in series.items() for t, v in enumerate(s)]
        random.Random(1).shuffle(rows)
        df = spark.createDataFrame(rows, "key string, t int, v double")
        got = scans.scanned(df, ["key"], "t", "v", scans.kalman_fold()).collect()
        for k, s in series.items():
            assert [r.z for r in sorted((r for r in got if r.key == k), key=lambda r: r.t)] == pytest.approx(one_by_one(s))
        z = scans.scanned(df, ["key"], "t", "v", scans.ewma_fold(0.1)).where("key = 'a'").orderBy("t").collect()
        array = df.where("key = 'a'").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda x: x["v"]).alias("a")).select(signal.ewma_z(F.col("a"), 0.1).alias("z")).first().z
        assert [r.z for r in z] == pytest.approx(array)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert scans.scanned(df.limit(0), ["key"], "t", "v", scans.kalman_fold()).count() == 0


def test_a_million_values_take_linear_time(spark):
    df = spark.range(1_000_000).select(F.lit("k").alias("key"), F.col("id").alias("t"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 100.0).alias("v"))
    began = time.time()
    row = scans.scanned(df, ["key"], "t", "v", scans.kalman_fold()).agg(F.count("*").alias("n"), F.max("z").alias("z")).first()
    assert row.n == 1_000_000 and row.z > 5 and time.time() - began < 60


def test_a_stream_scans_as_a_batch_does(spark, tmp_path):
    rows = [(k, t, float(v)) for k in "ab" for t, v in enumerate(RNG.normal(0, 3, 40))]
    df = spark.createDataFrame(rows, "key string, frame long, value double")
    for k, part in enumerate(("frame < 15", "frame >= 15 and frame < 30", "frame >= 30")):
        df.where(part).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    stream = spark.readStream.schema("key string, frame long, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = scans.scanned_stream(stream, "frame", "value", scans.kalman_fold(), 1)
    query = out.writeStream.format("memory").queryName("scan_test").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.key, r.frame): r.z for r in spark.table("scan_test").collect()}
    want = {(r.key, r.frame): r.z for r in scans.scanned(df, ["key"], "frame", "value", scans.kalman_fold()).collect()}
    assert got == pytest.approx(want)


def test_spaced_peaks_and_trace_stages(spark):
    peaks = spark.createDataFrame([("a", x) for x in (1, 2, 4, 6, 7, 9, 9)] + [("b", 5)], "key string, at int")
    assert sorted(map(tuple, scans.spaced_peaks(peaks, ["key"], "at", 3).collect())) == [("a", 1), ("a", 4), ("a", 7), ("b", 5)]
    values = RNG.normal(0, 1, 200)
    values[[50, 120]] = 15
    traces = spark.createDataFrame([("r", k, float(v)) for k, v in enumerate(values)], "id string, frame int, value double")
    registry = default_registry()
    spec = lambda stage, params: {"source": "traces", "steps": [{"id": "s", "stage": stage, "params": params}]}
    got = {r.frame: r.z for r in registry.run(spec("trace_event_scoring", {"event_threshold_z": 5.0}), traces).collect()}
    middle = np.median(values)
    z = np.maximum(0, (values - middle) / (1.4826 * np.median(abs(values - middle)) + 1e-6))
    assert got == pytest.approx({k: x for k, x in enumerate(z) if x >= 5})
    got = {r.frame: r.z for r in registry.run(spec("robust_kalman_positive_innovation", {"event_threshold_z": 4.0}), traces).collect()}
    assert got == pytest.approx({k: x for k, x in enumerate(one_by_one(values.tolist(), 0.06, 0.008)) if x >= 4})


def test_medians_by_counting(spark):
    rows = [(g, float(v)) for g in (1, 2, None) for v in RNG.integers(0, 9, 50 + (g or 0))] + [(3, None), (4, 2.5)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r.median for r in signal.medians(df, ["g"], "v").collect()}
    assert got == {g: float(np.median([v for k, v in rows if k == g and v is not None])) for g in (1, 2, None, 4)}


def grown_by_hand(image, seed, grow, least, most, fill, aspect):
    marks, out = signal.labelled(image >= grow), []
    for k in range(1, marks.max() + 1):
        y, x = np.nonzero(marks == k)
        v, w, h = image[y, x], np.ptp(x) + 1, np.ptp(y) + 1
        share, long = len(y) / (w * h), max(w, h) / min(w, h)
        reason = "no_seed" if v.max() < seed else "area" if not least <= len(y) <= most else "shape" if share < fill or long > aspect else "accepted"
        out.append((int(y[0]), int(x[0]), len(y), round(float(v.sum()), 6), reason))
    return sorted(out)


@pytest.mark.parametrize("tile", [1, 4, 7, 128])
def test_regions_grow_over_the_rims_of_tiles(spark, tile):
    stack = np.round(RNG.normal(0, 1, (3, 23, 19)), 3)
    stack[1, 10, :] = 3.0  # a line over all tiles
    found = regions.grown(signal.pixels(frames_of(spark, stack)), 1.8, 0.5, 3, 60, 0.3, 3.0, tile=tile).collect()
    for k, image in enumerate(stack.astype(np.float32).astype(float)):
        own = [r for r in found if r.frame == k]
        assert sorted((r.region >> 20, r.region & 0xFFFFF, r.area, round(r.mean_z * r.area, 6), r.reason) for r in own) == grown_by_hand(image, 1.8, 0.5, 3, 60, 0.3, 3.0)
        numbers = [r.component_id for r in sorted(own, key=lambda r: r.region) if r.reason == "accepted"]
        assert numbers == list(range(1, len(numbers) + 1))
    counts = {r.frame: r for r in regions.frame_outcomes(spark.createDataFrame(found)).collect()}
    assert counts[0].accepted == sum(r.reason == "accepted" and r.frame == 0 for r in found)


def test_no_pixels_no_regions(spark):
    empty = spark.createDataFrame([(0, 0, 0, 0.1), (0, 0, 1, None)], "frame int, y int, x int, v double")
    assert regions.grown(empty, 2.0, 1.0).count() == 0


def local_z_by_hand(image, window, epsilon):
    signal_, radius = (image - np.median(image)).astype(np.float32).astype(float), window // 2
    least = max(epsilon, 0.25 * 1.4826 * np.median(abs(signal_)))
    out = np.zeros(image.shape)
    for y, x in np.ndindex(*image.shape):
        near = signal_[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1]
        if signal_[y, x] > 0:
            out[y, x] = (signal_[y, x] - near.mean()) / (max(near.std(), least) + epsilon)
    return out


def test_event_preserving_chain(spark):
    stack = RNG.normal(0, 4, (4, 15, 13)).astype(np.float32)
    stack[2, 4:8, 5:9] += 60
    frames = frames_of(spark, stack)
    got = {r.frame: np.reshape(r.pixels, (15, 13)) for r in video.event_preserving_z(frames, 7, 0.5).collect()}
    for k, image in enumerate(stack.astype(float)):
        assert np.allclose(got[k], local_z_by_hand(image, 7, 0.5), atol=1e-4)
    mask = {r.frame: np.reshape(r.pixels, (15, 13)) for r in video.supported_mask(frames, 10.0).collect()}
    active = stack[2] >= 10
    want = [[active[y, x] and active[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].sum() >= 2 for x in range(13)] for y in range(15)]
    assert (mask[2] == np.array(want)).all()
    spec = {"steps": [{"id": "d", "stage": "event_preserving_noise_suppression"}, {"id": "e", "stage": "candidate_event_pipeline", "params": {"event_threshold_z": 2.0}}]}
    events = default_registry().run(spec, frames).collect()
    assert [(r.frame, r.component_id) for r in events] == [(2, 1)] and 4 <= events[0].y <= 8 and 5 <= events[0].x <= 9


def test_asof_by_range_spreads_a_hot_key(spark):
    rng = random.Random(3)
    left = [(rng.choice(["hot"] * 9 + ["b", None]), rng.randint(0, 200), k) for k in range(300)]
    right = [(rng.choice(["hot"] * 9 + ["b", None]), rng.randint(0, 200), float(k)) for k in range(40)]
    a, b = spark.createDataFrame(left, "key string, at int, id int"), spark.createDataFrame(right, "key string, at int, v double")
    want = sorted(map(tuple, joins.asof_backward(a, b, ["key"], "at", ["v"]).collect()), key=lambda r: r[2])
    assert any(r[3] is None for r in want) and any(r[0] is None and r[3] is not None for r in want)
    for width in (1, 17, 1000):
        assert sorted(map(tuple, joins.asof_by_range(a, b, ["key"], "at", ["v"], width).collect()), key=lambda r: r[2]) == want
    hot = joins.asof_by_range(a, b, ["key"], "at", ["v"], 10).where("key = 'hot'")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert hot.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_blank_objects_match_any(spark):
    rng = random.Random(8)
    side = lambda n: [(k, rng.choice(["a", "b", " a ", "", "  ", None]), rng.randint(0, 40), rng.randint(0, 40), rng.randint(1, 9)) for k in range(n)]
    gt, found = side(40), side(50)
    a = spark.createDataFrame(gt, "gt_id int, gt_object string, gt_onset int, gt_peak int, gt_duration int")
    b = spark.createDataFrame(found, "cand_id int, cand_object string, cand_onset int, cand_peak int, cand_duration int")
    name = lambda x: (x or "").strip()
    pairs = [(g, c) for g in gt for c in found if abs(g[2] - c[2]) <= 3 and (not name(g[1]) or not name(c[1]) or name(g[1]) == name(c[1]))]
    got = joins.event_pairs(a, b, "gt_object", "cand_object", [("gt_onset", "cand_onset", 3)])
    assert sorted((r.gt_id, r.cand_id) for r in got.collect()) == sorted((g[0], c[0]) for g, c in pairs)
    taken, want = (set(), set()), []
    for g, c in sorted(pairs, key=lambda p: (abs(p[1][2] - p[0][2]), abs(p[1][3] - p[0][3]), p[0][0], p[1][0])):
        if g[0] not in taken[0] and c[0] not in taken[1]:
            taken[0].add(g[0])
            taken[1].add(c[0])
            want.append((g[0], c[0], c[2] - g[2], c[3] - g[3], c[4] - g[4]))
    assert sorted(map(tuple, joins.match_events(a, b, 3).collect())) == sorted(want)
