"""Evidence images, proposals, named queues, progress, reviewers side by side, latency of micro-batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import diagnostics, evidence, proposals, review
from frameloom.streaming import latency, stages


def test_values_at_ranks_are_those_of_the_sorted_list(spark):
    rng = np.random.default_rng(5)
    groups = {
        "even": rng.random(1001).tolist(), "one": [4.5], "equal": [2.0] * 50, "hot": [1.0] * 400 + rng.normal(1, 1e-6, 100).tolist(),
        "far": [*rng.random(200).tolist(), 1e12], "holes": [3.0, None, float("nan"), 1.0, 2.0],
    }
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(5)
    ranks = {"low": 0.01, "mid": 0.5, "high": 0.995}
    got = {r.g: r for r in diagnostics.values_at_ranks(rows, ["g"], "v", ranks, cells=16).collect()}
    for g, vs in groups.items():
        ordered = sorted(v for v in vs if v is not None and v == v)
        for name, q in ranks.items():
            assert got[g][name] == ordered[int(np.floor((len(ordered) - 1) * q + 0.5))], (g, name)
    alone = diagnostics.values_at_ranks(rows.where("g = 'even'"), [], "v", {"mid": 0.5}).collect()
    assert [r.mid for r in alone] == [sorted(groups["even"])[500]]
    assert diagnostics.values_at_ranks(rows.where("false"), ["g"], "v", ranks).count() == 0


def test_medians_and_ranks_of_latencies(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 10)] + [("b", 7.0), ("b", 7.0), ("b", 9.0), ("b", None)], "g string, v double")
    got = {r.g: (r.n, r.p50, r.p95, r.max_value, r.n_over, r.meets_budget) for r in diagnostics.latency_percentiles(rows, ["g"], "v", 9.5).collect()}
    assert got == {"a": (4, 2.5, 10.0, 10.0, 1, 0), "b": (3, 7.0, 9.0, 9.0, 0, 1)}


def maps(stack, level, blocked):
    """The two images by numpy, in plain loops over pixels."""
    frames, high, wide = stack.shape
    peak, deviation, active = np.maximum(stack.max(0), 0), stack.std(0), (stack >= level).sum(0).astype(float)
    coherence = np.zeros((high, wide))
    for y in range(high):
        for x in range(wide):
            r = []
            for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)):
                if 0 <= y + dy < high and 0 <= x + dx < wide:
                    a, b = stack[:, y, x], stack[:, y + dy, x + dx]
                    r.append(((a - a.mean()) * (b - b.mean())).mean() / (a.std() * b.std()) if a.std() > 0 and b.std() > 0 else 0.0)
            coherence[y, x] = (np.mean(r) + 1) / 2
    uncovered = np.where(blocked, 0, peak * (1 + 0.35 * np.minimum(1, active / 10)))

    def unit(image):
        ordered = np.sort(image.ravel())
        low, top = (ordered[int(np.floor((len(ordered) - 1) * q + 0.5))] for q in (0.01, 0.995))
        return np.clip((image - low) / max(1e-6, top - low), 0, 1)

    p, s, a, u, c = map(unit, (peak, deviation, active, uncovered, coherence))
    support = np.clip(0.55 * a + 0.25 * p + 0.2 * c, 0, 1)
    discovery = np.where(blocked, 0, 0.4 * p + 0.2 * s + 0.2 * a + 0.15 * u + 0.05 * c)
    mean = lambda m: np.array([[m[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].mean() for x in range(wide)] for y in range(high)])
    return mean(support), mean(discovery)


def test_evidence_maps_of_two_recordings_are_those_of_each_alone(spark):
    from frameloom.operators import images

    rng = np.random.default_rng(2)
    stacks = {"a": rng.integers(0, 5, (6, 7, 5)).astype(float), "b": rng.integers(0, 9, (4, 3, 8)).astype(float)}
    rows = [(k, f, y, x, float(v)) for k, s in stacks.items() for (f, y, x), v in np.ndenumerate(s)]
    long = spark.createDataFrame(rows, "k string, frame int, y int, x int, v double").repartition(4).withColumn("z", F.col("v"))
    known = {"a": [(0, 0), (3, 2)], "b": [(1, 7)]}
    regions = spark.createDataFrame([(k, y, x) for k, ps in known.items() for y, x in ps], "k string, y int, x int")
    each = [images.local_correlation(long.where(F.col("k") == k)).withColumn("k", F.lit(k)) for k in stacks]
    out = evidence.evidence_maps(evidence.pixel_evidence(long, 3.0, ["k"]), each[0].unionByName(each[1]), evidence.blocked_pixels(regions, 1, ["k"]), ["k"]).collect()
    assert len(out) == sum(s[0].size for s in stacks.values())
    for k, stack in stacks.items():
        blocked = np.zeros(stack[0].shape, bool)
        for y, x in known[k]:
            for dy, dx in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)):
                if 0 <= y + dy < blocked.shape[0] and 0 <= x + dx < blocked.shape[1]:
                    blocked[y + dy, x + dx] = True
        support, discovery = maps(stack, 3.0, blocked)
        for r in out:
            if r.k == k:
                assert abs(r.support - support[r.y, r.x]) < 1e-9 and abs(r.discovery - discovery[r.y, r.x]) < 1e-9, (k, r)


def values(spark, **columns):
    return [r[0] for r in spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).unpivot([], [*columns], "k", "v").orderBy("k").select("v").collect()]


def test_scores_of_regions_and_suggestions(spark):
    L = F.lit
    c = {"background_correlation": L(0.5), "local_correlation": L(0.4), "compactness": L(0.2), "area": L(14.0), "event_support": L(0.5), "trace_snr": L(4.0), "event_count": L(16), "peak_score": L(3.0), "aspect": L(5.0), "seed_score": L(0.8), "active_frames": L(10), "noise": L(0.1)}
    artifact = 0.35 * 0.5 + 0.25 + 0.2 + 0.1
    priority = 0.2 * 0.4 + 0.2 * 0.5 + 0.2 * 0.5 + 0.15 * 0.2 + 0.15 + 0.1 * 0.5 - 0.2 * 0.5 - 0.15 * artifact
    cut = max(0.0, 0.25 * 0.8 + 0.25 * 0.4 + 0.25 * 0.5 + 0.15 * 0.2 + 0.1 * 10 / 40 - 0.2 * 0.95)
    got = values(
        spark, a=evidence.region_artifact_score(c, 10), b=evidence.region_evidence(c, evidence.region_artifact_score(c, 10), 6.0), c=evidence.suggestion_artifact_score(c, L(True)),
        d=evidence.suggestion_evidence(c, L(0.95), 40), e=evidence.quality(c), f=evidence.unsureness(c, L(False)), g=evidence.region_artifact_score({}, 10),
    )
    assert got == pytest.approx([artifact, priority, 0.95, cut, 3.0 / 0.1 + 6.4, 20 + 1.2 + 51 / 50 - 2.4, 0.55])
    assert values(spark, a=evidence.quality({"priority": L(2.0), "peak_score": L(9.0)}), b=evidence.quality({"priority": L(None), "peak_score": L(1.0)})) == pytest.approx([2.0, 25.0])
    cues = [evidence.suggestion_cue({"aspect": L(a)}, L(near), L(bright)) for a, near, bright in ((5.0, True, True), (5.0, False, True), (4.0, False, True), (4.0, False, False))]
    assert [r for r in spark.range(1).select(*cues).first()] == ["border", "elongated_structure", "very_bright", "none"]


def test_borders_shapes_and_reasons_of_proposals(spark):
    boxes = [((1, 9, 20, 20), True), ((2, 2, 97, 47), False), ((2, 2, 98, 20), True), ((2, 2, 20, 48), True), ((None, 2, 3, 4), False)]
    rows = spark.createDataFrame([(*b, k) for b, k in boxes], "a int, b int, c int, d int, k boolean")
    box = [F.col(c) for c in "abcd"]
    got = rows.select("k", proposals.near_border(box, F.lit(100), F.lit(50)).alias("near"), proposals.near_border(box, F.lit(0), F.lit(50)).alias("flat"), proposals.elongation(box).alias("e"), "a").collect()
    assert all(r.near == r.k and r.flat is False for r in got)
    assert [r.e for r in got if r.a is None] == [1.0] and {round(r.e, 6) for r in got if r.a == 1} == {round(20 / 12, 6)}

    c = {"event_support": F.lit(0.35), "local_correlation": F.lit(0.44), "max_z": F.lit(3.0), "active_frames": F.lit(None)}
    cues = F.array(*map(F.lit, ("w", "x", "y", "z")))
    none = F.array().cast("array<string>")
    a, b = spark.range(1).select(proposals.proposal_reasons(c, cues, F.lit("accepted")), proposals.proposal_reasons({}, none, F.lit(None).cast("string"))).first()
    assert a == ["uncovered discovery suggestion", "event-supported", "strong positive evidence", "artifact cue: w, x, y", "annotation: accepted"]
    assert b == ["uncovered discovery suggestion"]

    rows = spark.createDataFrame([(1, 0.4, 0.65, ["p", "q", "p"], "border"), (2, 0.39, 0.9, ["q"], "none"), (3, 0.9, 0.1, [], None), (4, None, None, None, "")], "id int, risk double, score double, why array<string>, cue string")
    assert {r.reason: r.n for r in proposals.reason_counts(rows, "why").collect()} == {"p": 1, "q": 2}
    assert tuple(proposals.analysis_summary(rows, "risk", rows, "score", "cue", 3).first()) == (4, 2, 4, 3, 2, 1)
    assert tuple(proposals.analysis_summary(rows.limit(0), "risk", rows.limit(0), "score", "cue", 3).first()) == (0, 0, 0, 0, 0, 0)
    assert [r.id for r in proposals.best(rows.fillna(0.9, ["score"]), ["score"], "id", 2).collect()] == [2, 4]


ANNOTATED = "id string, state string, confidence string, needs_action string, reason_tags array<string>, artifact_score double, artifact_class string, artifact_cue string, score double"


def test_the_five_queues(spark):
    regions = spark.createDataFrame(
        [
            ("r1", None, None, None, None, 0.1, None, None, 3.0), ("r2", "Accepted ", "high", "take a SECOND look", None, 0.4, None, None, 5.0), ("r3", "unsure", "medium", None, [" Second_Review "], None, "motion", None, 3.0),
            ("r4", "rejected", "low", None, [None, "other"], 0.2, "", None, 1.0), ("r5", "promoted", "", "", [], 0.0, "", None, 3.0),
        ], ANNOTATED,
    )
    events = spark.createDataFrame([("r1:4", "unsure", None, None, None, None, None, None, 4.0), ("r1:9", "accepted", "", None, ["needs_second_reviewer"], None, None, None, 9.0)], ANNOTATED)
    offered = spark.createDataFrame(
        [("s1", "", None, None, None, 0.0, None, "none", 3.0), ("s2", "missed", None, None, None, 0.4, None, None, 2.0), ("s3", "artifact", "low", None, None, 0.0, None, "border", 1.0), ("s4", "promoted", "medium", None, None, 0.0, None, "", 7.0)],
        ANNOTATED,
    )
    c = {k: F.col(k) for k in ("state", "confidence", "needs_action", "reason_tags", "artifact_score", "artifact_class", "artifact_cue")}
    parts = [("region", regions, F.col("id"), F.col("score"), review.region_queues(c)), ("event", events, F.col("id"), F.col("score"), review.event_queues(c)), ("suggestion", offered, F.col("id"), F.col("score"), review.suggestion_queues(c))]

    def listed(limit):
        out = {}
        for r in review.guided_items(parts, limit).orderBy("queue", "place").collect():
            out.setdefault(r.queue, []).append(r.subject_id)
            assert r.queue_length == {"unreviewed_high_priority": 2, "uncertain": 5, "likely_artifact": 4, "possible_missed_neuron": 2, "needs_second_reviewer": 5}[r.queue]
        return out

    whole = {
        "unreviewed_high_priority": ["r1", "r5"], "uncertain": ["s4", "r1:4", "r3", "r4", "s3"], "likely_artifact": ["r2", "r3", "s2", "s3"], "possible_missed_neuron": ["s4", "s1"],
        "needs_second_reviewer": ["r1:9", "r2", "r3", "r4", "s3"],
    }
    assert listed(None) == whole
    assert listed(2) == {k: v[:2] for k, v in whole.items()}


def test_progress_and_the_gate_for_tuning(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(["accepted", "Rejected", "unsure", "accept", "", None, "promoted"])], "id int, state string")
    offered = spark.createDataFrame([("", True), ("missed", False), (None, None), ("", False)], "state string, promoted boolean")
    got = review.review_progress(rows, rows.limit(0), offered, "state", "promoted", 4, 0).first().asDict()
    assert got == {
        "reviewed_regions": 4, "accepted_regions": 1, "rejected_regions": 1, "reviewed_events": 0, "accepted_events": 0, "rejected_events": 0, "reviewed_suggestions": 2,
        "region_review_share": 4 / 7, "event_review_share": 0.0, "suggestion_review_share": 0.5, "tuning_ready": True,
    }
    assert not review.review_progress(rows, rows, offered, "state", "promoted", 4, 5).first().tuning_ready


def test_two_reviewers_side_by_side(spark):
    schema = "kind string, id string, state string, confidence string, artifact string, tags array<string>, note string"
    a = spark.createDataFrame([("roi", "1", "Accepted", "High", None, ["x", "y"], "a\tb"), ("roi", "2", "rejected", None, "motion", None, None), ("roi", "3", "", "low", "", [], None), ("event", "1", "accepted", "low", None, None, None)], schema)
    b = spark.createDataFrame([("roi", "1", "accepted ", "high", "None", None, None), ("roi", "2", "accepted", "low", "motion", ["z"], None), ("event", "9", "unlabeled", None, None, None, None)], schema)
    rows = review.compared(a, b, ["kind", "id"], "state", "confidence", "artifact", ["tags", "note"])
    got = {(r.kind, r.id): (r.label_a, r.label_b, r.both_labeled, r.exact_agreement, r.to_settle) for r in rows.collect()}
    assert got == {
        ("roi", "1"): ("accepted", "accepted", True, True, False), ("roi", "2"): ("rejected", "accepted", True, False, True), ("roi", "3"): ("", "", False, False, True),
        ("event", "1"): ("accepted", "", False, False, True), ("event", "9"): ("", "unlabeled", False, False, True),
    }
    pairs = {(r.kind, r.pair): r.n for r in review.pair_breakdowns(rows).collect()}
    assert pairs == {
        ("confidence", "high / high"): 1, ("confidence", "unlabeled / low"): 1, ("confidence", "low / unlabeled"): 2, ("confidence", "unlabeled / unlabeled"): 1,
        ("artifact", "none / none"): 4, ("artifact", "motion / motion"): 1, ("label", "accepted / accepted"): 1, ("label", "rejected / accepted"): 1,
    }
    flat = {(r.kind, r.id): r for r in review.disagreement_rows(rows, ["kind", "id"], ("ann", "bob"), ["tags", "note"]).collect()}
    assert set(flat) == {k for k, v in got.items() if v[4]}
    r = flat["roi", "2"]
    assert (r.reviewer_a, r.reviewer_b, r.both_labeled, r.exact_agreement, r.tags_b, r.note_a) == ("ann", "bob", 1, 0, "z", "")
    rows = review.label_counts(a.withColumnRenamed("kind", "subject"), "subject", "state", "confidence", "tags")
    counts = {(r.subject, r.kind, r.value): r.n for r in rows.collect()}
    assert counts["roi", "state", "unlabeled"] == 1 and counts["roi", "confidence", "unlabeled"] == 1 and counts["roi", "tag", "x"] == 1 and counts["event", "confidence", "low"] == 1


def test_latency_of_an_online_stage(spark, tmp_path):
    for k in range(4):
        spark.createDataFrame([("p", k * 2 + j, float(j)) for j in range(2)], "key string, frame int, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = stages.frame_stream(spark, str(tmp_path / "in"), "key string, frame int, value double", 10.0)
    stage = stages.ewma_stream(rows, 0.1, 3.0)
    got = latency.benchmark(stage, "ewma", 600_000.0, warmup=1, checkpoint=str(tmp_path / "a")).collect()
    assert [(r.stage, r.n, r.n_over, r.feasible) for r in got] == [("ewma", 3, 0, 1)] and 0 < got[0].p50 <= got[0].p99 <= got[0].max_value
    slow = latency.benchmark(stages.ewma_stream(rows, 0.1, 3.0), "slow", 0.001, most=2, checkpoint=str(tmp_path / "b")).collect()
    assert [(r.n, r.n_over, r.feasible) for r in slow] == [(2, 2, 0)]
    assert latency.benchmark(stages.ewma_stream(rows, 0.1, 3.0), "none", 10.0, warmup=9, checkpoint=str(tmp_path / "c")).count() == 0
    for bad in ({"warmup": -1}, {"most": 0}):
        with pytest.raises(ValueError):
            latency.BatchLatency("x", **bad)
    with pytest.raises(ValueError):
        latency.feasibility(spark.createDataFrame([], "stage string, ms double"), 0)
