import random

import pytest

from frameloom.graph import connected_components
from frameloom.operators import joins


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_binned_join_is_the_nested_loop(spark):
    rng = random.Random(4)
    left = [(rng.randint(0, 2), k, rng.uniform(-20, 20)) for k in range(60)] + [(None, 60, 1.0), (1, 61, None)]
    right = [(rng.randint(0, 2), k, rng.uniform(-20, 20)) for k in range(60)]
    a, b = spark.createDataFrame(left, "g int, a int, x double"), spark.createDataFrame(right, "g int, b int, y double")
    want = sorted((p[1], q[1]) for p in left for q in right if p[0] == q[0] and p[2] is not None and abs(p[2] - q[2]) <= 3)
    assert rows_of(joins.binned_join(a, b, ["g"], [("x", "y", 3.0)]).select("a", "b")) == want
    some = sorted({p for p, _ in want})
    assert [r[0] for r in rows_of(joins.binned_join(a, b, ["g"], [("x", "y", 3.0)], "left_semi").select("a"))] == some
    assert sorted(r[0] for r in joins.binned_join(a, b, ["g"], [("x", "y", 3.0)], "left_anti").select("a").collect()) == sorted(set(range(62)) - set(some))


def test_zero_radius_and_edges_of_bins(spark):
    a, b = spark.createDataFrame([(1, 2.0), (2, 4.0)], "a int, x double"), spark.createDataFrame([(1, 4.0), (2, 6.0)], "b int, y double")
    assert rows_of(joins.binned_join(a, b, [], [("x", "y", 0.0)]).select("a", "b")) == [(2, 1)]
    assert rows_of(joins.binned_join(a, b, [], [("x", "y", 2.0)]).select("a", "b")) == [(1, 1), (2, 1), (2, 2)]


def test_asof_takes_the_latest_at_or_before(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 5, 3)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 6, "z"), ("b", 9, "w")], "k string, t int, v string")
    assert rows_of(joins.asof_backward(left, right, ["k"], "t", ["v"]).select("id", "v")) == [(1, "y"), (2, None), (3, None)]


def test_nearest_breaks_ties_by_identifier(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 50.0)], "p int, x double, y double")
    targets = spark.createDataFrame([(8, 3.0, 0.0), (7, -3.0, 0.0)], "t int, tx double, ty double")
    assert rows_of(joins.nearest(points, targets, ("x", "y"), ("tx", "ty"), "t", 5.0).select("p", "nearest_t", "distance")) == [(1, 7, 3.0)]


def test_greedy_is_the_sequential_greedy(spark):
    rng = random.Random(9)
    pairs = sorted({(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(40)})
    rows = [(a, b, rng.randint(0, 5)) for a, b in pairs]
    lefts, rights, want = set(), set(), []
    for a, b, c in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        if a not in lefts and b not in rights:
            lefts.add(a)
            rights.add(b)
            want.append((a, b, c))
    df = spark.createDataFrame(rows, "a int, b int, cost int")
    assert rows_of(joins.greedy_match(df, "a", "b", ["cost", "a", "b"])) == sorted(want)


@pytest.mark.parametrize("at_once", [1, 7, 50_000])
@pytest.mark.parametrize("kind", ["random", "one chain", "all ties", "nulls"])
def test_greedy_takes_one_large_component_in_rounds(spark, monkeypatch, at_once, kind):
    monkeypatch.setattr(joins, "AT_ONCE", at_once)
    monkeypatch.setattr(type(spark.range(1).groupBy()), "applyInPandas", None)  # no group of pairs is loaded whole
    rng = random.Random(2)
    if kind == "one chain":
        rows = [("u", k // 2, (k + 1) // 2, k) for k in range(9)]
    elif kind == "all ties":
        rows = [("u", a, b, 0) for a in range(5) for b in range(5)]
    else:
        some = (lambda x: x if rng.random() < 0.8 else None) if kind == "nulls" else (lambda x: x)
        rows = [(some(rng.choice("uv")), some(rng.randint(0, 5)), some(rng.randint(0, 5)), some(rng.randint(0, 3))) for _ in range(40)]
    last = lambda x: (x is None, x or 0)
    lefts, rights, want = set(), set(), []
    for u, a, b, c in sorted(rows, key=lambda r: (last(r[3]), r[0] is None, r[0] or "", last(r[1]), last(r[2]))):
        if (u, a) not in lefts and (u, b) not in rights:
            lefts.add((u, a))
            rights.add((u, b))
            want.append((u, a, b, c))
    df = spark.createDataFrame(rows, "u string, a int, b int, cost int")
    assert sorted(map(str, map(tuple, joins.greedy_match(df, "a", "b", ["cost"], ["u"]).collect()))) == sorted(map(str, want))
    assert joins.greedy_match(df.limit(0), "a", "b", ["cost"], ["u"]).columns == df.columns


def test_components_of_chains_loops_and_nothing(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    found = dict(rows_of(connected_components(spark.createDataFrame(edges, "a int, b int"))))
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0
