"""Pairs of many candidates: what they cost, and that forms that need no row for each pair say the same."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from frameloom.operators import candidates, diagnostics, joins, matching


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def boxes(spark, rows):
    df = spark.createDataFrame([(i, float(x), float(y), float(w), float(h)) for i, x, y, w, h in rows], "id long, bbox_x double, bbox_y double, bbox_width_px double, bbox_height_px double")
    return df.selectExpr("*", "bbox_x + bbox_width_px / 2 AS centroid_x", "bbox_y + bbox_height_px / 2 AS centroid_y", "bbox_width_px * bbox_height_px AS area_px")


#: Copies of one box, two that overlap it, a pair that only lies near, a lone box.
SOME = [*[(i, 0, 0, 4, 4) for i in range(30, 0, -3)], (2, 1, 1, 4, 4), (41, 3, 0, 3, 4), (50, 60, 60, 1, 1), (44, 61.5, 60, 1, 1), (70, 200, 0, 5, 5)]


def test_box_links_send_no_bins_to_every_task(spark):
    df = boxes(spark, SOME)
    assert "BroadcastHashJoin" not in plan_of(candidates.box_links(df, "id", 2.0, 0.2))


def test_box_links_of_copies(spark):
    got = sorted((r.a, r.b) for r in candidates.box_links(boxes(spark, SOME), "id", 2.0, 0.2).collect())
    want = []
    for n, (i, x, y, w, h) in enumerate(SOME):
        for j, u, v, s, t in SOME[n + 1 :]:
            both = max(0, min(x + w, u + s) - max(x, u)) * max(0, min(y + h, v + t) - max(y, v))
            if ((x + w / 2 - u - s / 2) ** 2 + (y + h / 2 - v - t / 2) ** 2) ** 0.5 <= 2 or both / (w * h + s * t - both) >= 0.2:
                want.append((min(i, j), max(i, j)))
    assert got == sorted(want)


@pytest.fixture
def edges(monkeypatch):
    """Numbers of edges whose components are sought."""
    seen, own = [], candidates.connected_components
    monkeypatch.setattr(candidates, "connected_components", lambda links, *a: seen.append(links.count()) or own(links, *a))
    return seen


def test_box_clusters_seek_components_among_shapes(spark, edges):
    df = boxes(spark, SOME)
    got = candidates.box_clusters(df, "id", 2.0, 0.2)
    want = candidates.cluster_summary(df, candidates.box_links(df, "id", 2.0, 0.2), "id")
    plain = lambda d: sorted(repr(tuple(r)) for r in d.select(sorted(want.columns)).collect())
    assert plain(got) == plain(want)
    assert edges[0] <= 5 < 45 <= edges[1]


def test_near_clusters_count_links_by_cells(spark, edges):
    rows = [(i, float(i % 3), float(i % 2), 1.0) for i in range(60)] + [(100, 9.0, 9.0, 2.0), (90, 12.0, 9.0, 2.0), (200, 50.0, 50.0, 1.0), (300, -40.0, 0.0, 1.0), (301, -40.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "i long, x double, y double, area double")
    got = candidates.near_clusters(df, "i", "x", "y", 4.0, "area")
    want = candidates.clusters(df, candidates.near_links(df, "i", "x", "y", 4.0), "i", "x", "y", "area")
    plain = lambda d: sorted(tuple(round(float(v), 9) for v in r) for r in d.select(want.columns).collect())
    assert plain(got) == plain(want)
    assert edges[0] < 10 < 1000 < edges[1]


def test_nearest_compares_few_places(spark, monkeypatch):
    seen, own = [], joins.binned_join
    monkeypatch.setattr(joins, "binned_join", lambda *a, **k: (lambda out: seen.append(out.count()) or out)(own(*a, **k)))
    at = [(7 * i % 101 / 1.0, 3 * i % 89 / 1.0) for i in range(300)]
    targets = spark.createDataFrame([(i, *at[i % 150]) for i in range(299, -1, -1)], "t long, tx double, ty double")
    points = [(i, x + 0.25, y - 0.5) for i, (x, y) in enumerate(at)] + [(900, 140.0, 20.0), (901, 900.0, 0.0), (902, None, 1.0)]
    got = joins.nearest(spark.createDataFrame(points, "p long, x double, y double"), targets, ("x", "y"), ("tx", "ty"), "t", 60.0)
    want = []
    for p, x, y in points[:-1]:
        d, t = min((math.hypot(x - at[i % 150][0], y - at[i % 150][1]), i) for i in range(300))
        want += [(p, t, round(d, 9))] if d <= 60 else []
    assert sorted((r.p, r.nearest_t, round(r.distance, 9)) for r in got.collect()) == sorted(want)
    assert sum(seen) < 20_000  # all pairs within the radius are more than 45,000


def test_intensity_percentiles_are_counted(spark):
    values = [float(v) for v in [*range(100), 5, 5, 5, 1e9, float("inf"), float("nan")]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "f long, v double")
    out = diagnostics.intensity_quality(df, "f", "v")
    assert "percentile(" not in plan_of(out)
    got, want = out.first(), df.selectExpr("percentile(v, 0.01) AS p01", "percentile(v, 0.5) AS p50", "percentile(v, 0.99) AS p99").first()
    assert [got.p01, got.p50] == pytest.approx([want.p01, want.p50]) and repr(got.p99) == repr(want.p99)
    empty = diagnostics.intensity_quality(df.where("f < 0"), "f", "v").collect()
    assert len(empty) == 1 and (empty[0].n, empty[0].p50) == (0, None)


def test_shared_items_shuffle_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(candidates, "LISTED", 3)
    rows = [(o, i) for o in range(12) for i in range(9) if (o * i) % 4 < 2] + [(1, 1), (3, None), (None, 2)]
    out = candidates.shared_items(spark.createDataFrame(rows, "o long, i long"), "o", "i")
    assert not re.search(r"Exchange hashpartitioning\(a#\w+, b#", plan_of(out))
    sets = {o: {i for p, i in rows if p == o and i is not None} for o in range(12)}
    want = [(a, b, len(sets[a] & sets[b]), round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9)) for a in sets for b in sets if a < b and sets[a] & sets[b]]
    assert sorted((r.a, r.b, r.n_both, round(r.iou, 9)) for r in out.collect()) == sorted(want)


def test_pairs_of_one_hour_are_dealt_over_tasks(spark):
    gt = spark.createDataFrame([(i, "", 5) for i in range(40)], "g long, go string, gh long")
    found = spark.createDataFrame([(i, str(i % 3) if i % 2 else None, 6) for i in range(40)], "c long, co string, ch long")
    out = joins.event_pairs(gt, found, "go", "co", [("gh", "ch", 2)])
    assert sorted((r.g, r.c) for r in out.collect()) == [(a, b) for a in range(40) for b in range(40)]
    assert out.groupBy(F.spark_partition_id()).count().count() > 1


@pytest.mark.parametrize(("at_once", "tolerance", "kind"), [(50_000, 2, "int"), (0, 2, "int"), (0, 1, "int"), (0, 0, "int"), (3, 1.5, "double")])
def test_event_matches_make_no_pairs(spark, monkeypatch, at_once, tolerance, kind):
    monkeypatch.setattr(matching, "AT_ONCE", at_once)
    monkeypatch.setattr(joins, "event_pairs", lambda *a: pytest.fail("a row for each pair"))
    rng = random.Random(f"{at_once} {tolerance}")
    at = lambda high: rng.randint(0, high) if kind == "int" else rng.choice([rng.uniform(0, high), float(rng.randint(-5, high)), -0.0])
    side = lambda n, base: [(base - k, rng.choice(["a", "b", " a", "", None]), at(70), rng.choice([at(9), None]), rng.randint(1, 9)) for k in range(n)]
    gt, found = [*side(140, 900), (7, "a", None, at(9), 1)], side(150, 5000)
    schema = ", ".join(f"{{0}}_{c}" for c in ("id long", "object string", f"onset {kind}", f"peak {kind}", "duration int"))
    got = joins.match_events(spark.createDataFrame(gt, schema.replace("{0}", "gt")), spark.createDataFrame(found, schema.replace("{0}", "cand")), tolerance)
    name = lambda x: (x or "").strip()
    less = lambda b, a: None if a is None or b is None else b - a
    pairs = [(g, c) for g in gt for c in found if g[2] is not None and abs(g[2] - c[2]) <= tolerance and (not name(g[1]) or not name(c[1]) or name(g[1]) == name(c[1]))]
    taken, want = (set(), set()), []
    last = lambda x: (x is None, abs(x or 0))
    for g, c in sorted(pairs, key=lambda p: (abs(p[1][2] - p[0][2]), last(less(p[1][3], p[0][3])), p[0][0], p[1][0])):
        if g[0] not in taken[0] and c[0] not in taken[1]:
            taken[0].add(g[0])
            taken[1].add(c[0])
            want.append((g[0], c[0], c[2] - g[2], less(c[3], g[3]), c[4] - g[4]))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])


def test_shared_pairs_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(joins, "ITEM_ROWS", 10)
    sides = [[(o, i) for o in range(25) for i in range(6) if (o * i + k) % 3 == 0] for k in range(2)]
    a, b = (spark.createDataFrame(x, f"{c} long, item long") for x, c in zip(sides, "ab", strict=True))
    out = joins.shared_pairs(a, b, "item", "a", "b")
    sets = [{o: {i for p, i in x if p == o} for o in range(25)} for x in sides]
    want = [(p, q, len(x & y)) for p, x in sets[0].items() for q, y in sets[1].items() if x & y]
    assert sorted(map(tuple, out.collect())) == want
    assert out.rdd.getNumPartitions() == -(-(len(sides[0]) + len(sides[1])) // 10)


def test_box_links_meet_lists_in_tasks_that_grow_with_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(candidates, "LISTED", 3)
    monkeypatch.setattr(candidates, "TASK_PAIRS", 20, raising=False)
    calls = spark.sparkContext.accumulator(0)

    def said(reasons):
        calls.add(1)
        return "+".join(reasons)

    df = boxes(spark, [*SOME, (80, 2, 1, 4, 4), (81, 2, 1, 4, 4), (82, 2, 1, 4, 4), (83, 2, 1, 4, 4)])
    out = candidates.box_links(df, "id", 2.0, 0.2, {"reasons": F.udf(said)("reasons")})
    got = sorted((r.a, r.b, r.reasons) for r in out.collect())
    x, y = df.alias("x"), df.alias("y")
    wide, high = (F.expr(f"greatest(0, least(x.bbox_{c} + x.bbox_{s}_px, y.bbox_{c} + y.bbox_{s}_px) - greatest(x.bbox_{c}, y.bbox_{c}))") for c, s in (("x", "width"), ("y", "height")))
    pairs = x.join(y, F.expr("x.id < y.id")).select(
        F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.expr("hypot(x.centroid_x - y.centroid_x, x.centroid_y - y.centroid_y) <= 2").alias("near"),
        (wide * high / (F.expr("x.area_px + y.area_px") - wide * high) >= 0.2).alias("over"),
    )
    want = [(r.a, r.b, "+".join(t for t, holds in (("nearby_centroids", r.near), ("overlapping_bboxes", r.over)) if holds)) for r in pairs.where("near or over").collect()]
    assert got == sorted(want)
    assert out.rdd.getNumPartitions() > len(want) // 20 > 4
    assert calls.value < 12 < 90 < len(want)


@pytest.mark.parametrize("piece", [1000, 5])
def test_event_pairs_are_those_of_lists(spark, monkeypatch, piece):
    monkeypatch.setattr(joins, "PIECE", piece, raising=False)
    met, own = [], joins.binned_join
    monkeypatch.setattr(joins, "binned_join", lambda a, b, *rest, **k: met.append(a.count() + b.count()) or own(a, b, *rest, **k))
    rng = random.Random(piece)
    name = lambda: rng.choice(["a", "b", " a", "", None])
    gt = [(k, name(), rng.choice([0.5, 2.5, 3.0, None]), rng.choice([None, 1, 2])) for k in range(200)]
    found = [(k, name(), rng.choice([1.0, 4.0]), rng.randint(1, 2)) for k in range(240)]
    a, b = (spark.createDataFrame(x, f"{c} long, {c}o string, {c}h double, {c}p int") for x, c in ((gt, "g"), (found, "c")))
    out = joins.event_pairs(a, b, "go", "co", [("gh", "ch", 1.0)])
    assert out.dtypes == [*a.dtypes, *b.dtypes]
    rows = [list(map(tuple, part)) for part in out.rdd.glom().collect()]
    plain = lambda x: (x or "").strip()
    want = [(*g, *c) for g in gt for c in found if g[2] is not None and abs(g[2] - c[2]) <= 1 and (not plain(g[1]) or not plain(c[1]) or plain(g[1]) == plain(c[1]))]
    assert sorted(map(repr, (r for part in rows for r in part))) == sorted(map(repr, want))
    if piece == 1000:
        assert sum(met) < 150  # lists; the rows are more than a thousand
        turns = sum(x[0] != y[0] for part in rows for x, y in zip(part, part[1:]))
        assert turns < len(want) / 5  # an event's pairs follow each other
