"""Active review tasks, ground truth over time, cut-off sweeps and published bundles."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from frameloom.operators import active, detection
from frameloom.sources import exports

CANDIDATES = "candidate_id string, priority_score double, state string, trace_snr double, local_correlation double, event_support double, artifact_score double, event_count int"


def test_candidate_tasks_by_hand(spark):
    rows = [
        ("a", 1.0, "", 1.0, 0.3, 0.1, 0.5, 2),  # near the median, unsure of three features, in conflict
        ("b", 5.0, None, 9.0, 0.9, 0.9, 0.0, 0),
        ("c", 1.1, " Accepted ", 1.0, 0.3, 0.3, 0.5, 1),
        ("d", 0.0, "weak", None, None, None, 0.9, 0),
        ("", 9.0, "", 0.0, 0.0, 0.0, 0.0, 0),
        ("b", 4.0, "unlabeled", 9.0, 0.9, 0.9, 0.0, 0),
    ]
    df = spark.createDataFrame(rows, CANDIDATES)
    got = {r.subject_id: r for r in active.candidate_tasks(df).collect()}
    assert set(got) == {"a", "b", "d"}  # the median over all is 2.55
    a, b, d = got["a"], got["b"], got["d"]
    assert (a.active_score, a.uncertainty_score, a.state) == (pytest.approx(1 + 0.95 + 0.75 + 0.75), 0.95, "unlabeled")
    assert a.selected_by == ["high_priority_unlabeled", "decision_boundary_uncertainty", "artifact_neuron_conflict"]
    assert a.reason_codes == sorted(["trace_snr_uncertainty", "local_coherence_uncertainty", "artifact_uncertainty", "artifact_neuron_conflict", "unlabeled_candidate"])
    assert (b.active_score, b.selected_by) == (5.75, ["high_priority_unlabeled"])
    assert (d.active_score, d.state, d.selected_by) == (0.0, "weak", ["high_priority_unlabeled"])
    assert {r.subject_id for r in active.candidate_tasks(df, include_reviewed=True).collect()} == {"a", "b", "c", "d"}
    assert active.candidate_tasks(df.limit(0)).count() == 0


def test_cluster_tasks_batches_and_counts(spark):
    df = spark.createDataFrame([("a", 1.0, "", 0.0, 0.0, 0.0, 0.0, 0), ("b", 3.0, "accepted", 0.0, 0.0, 0.0, 0.0, 0)], CANDIDATES)
    clusters = spark.createDataFrame([("x", ["a", "b"], ["possible_duplicate"]), ("y", ["b"], []), ("z", ["q"], None), ("w", [], [])], "cluster_id string, candidate_ids array<string>, issue_codes array<string>")
    tasks = active.candidate_tasks(df).unionByName(active.cluster_tasks(clusters, df))
    got = {r.task_id: r.active_score for r in tasks.collect()}
    assert got == {"candidate:a": 1.75, "cluster:x": 3.0 + 1.25 + 0.5 + 0.75, "cluster:z": 1.5}
    batch = active.review_batch(tasks, 2)
    assert [r.task_id for r in batch.collect()] == ["cluster:x", "candidate:a"]
    assert sorted(map(tuple, active.batch_counts(batch).collect())) == [("strategy", "high_priority_unlabeled", 1), ("strategy", "split_merge_cluster", 1), ("type", "candidate", 1), ("type", "cluster", 1)]
    with pytest.raises(ValueError):
        active.review_batch(tasks, 0)


def test_feature_rows_and_reason_codes(spark):
    regions = spark.createDataFrame([("r1", "Accepted", 1.23456, 4, 20.0, ["Unlabeled ROI", "high trace SNR", "who knows", "needs a look"])], "id string, state string, priority_score double, event_count int, area double, reasons array<string>")
    found = spark.createDataFrame([("s1", None, 0.5, ["locally coherent", "artifact-like event"])], "id string, state string, priority_score double, reasons array<string>")
    got = [tuple(r) for r in active.feature_rows({"roi": regions, "suggestion": found}).orderBy("subject_type").collect()]
    assert got == [
        ("roi", "r1", "accepted", 1.2346, 4.0, 20.0, None, None, None, None, "needs_action,trace_snr,unlabeled_roi"),
        ("suggestion", "s1", "unlabeled", 0.5, None, None, None, None, None, None, "artifact_check,local_coherence"),
    ]


def test_truth_over_time(spark):
    gt = spark.createDataFrame([(3, 1, 0.0, 0.0), (9, 1, 3.0, 4.0), (5, 1, 50.0, 50.0), (2, 2, 1.0, 1.0)], "frame int, gt_id int, x double, y double")
    assert {r.gt_id: tuple(r)[1:] for r in detection.drift(gt).collect()} == {1: (3, 9, 7, 5.0), 2: (2, 2, 1, 0.0)}
    assert tuple(detection.ground_truth_summary(gt, 1000).first()) == (4, 2, 0.4, 5.0, 2.5)
    assert tuple(detection.ground_truth_summary(gt.limit(0), 0).first()) == (0, 0, 0.0, 0.0, 0.0)
    det = spark.createDataFrame([(3, 0, 0.5, 0.0, 2.0), (2, 0, 1.0, 1.0, 0.5)], "frame int, det_idx int, x double, y double, z double")
    found = detection.found_by_id(gt, det, 1.0, 1.0)
    assert {r.gt_id: tuple(r)[1:] for r in found.collect()} == {1: (3, 1, 2), 2: (1, 0, 1)}
    assert tuple(detection.unique_rate(found).first()) == (2, 1, 0.5)


def test_cutoffs_and_levels(spark):
    rows = spark.createDataFrame([("a", 1.0, 5), ("a", 2.0, 7), ("a", None, 9), ("b", 0.0, 1)], "g string, score double, area int")
    got = {(r.g, r.cutoff): (r.kept, r.kept_size, r.kept_by_frame) for r in detection.cutoff_sweep(rows, "score", "area", [2.0, 1.0], 4, ["g"]).collect()}
    assert got == {("a", 1.0): (2, 12, 0.5), ("a", 2.0): (1, 7, 0.25), ("b", 1.0): (0, 0, 0.0), ("b", 2.0): (0, 0, 0.0)}
    points = spark.createDataFrame([("p", 3.0, 5, 0.4), ("q", 3.0, 5, 0.2), ("p", 1.0, 9, 3.0), ("q", 2.0, 1, 0.0)], "c string, threshold double, tp int, fppi double")
    assert [(r.tp, r.c, r.fppi) for r in detection.best_by_level(points, ["c"], 2).collect()] == [(9, "p", 3.0), (5, "q", 0.2)]


@pytest.fixture
def control(spark):
    regions = spark.createDataFrame([("r1", [1.0, 2.0, 3.0], [0.5], None), ("r2", [4.0], [], [9.0])], "roi_id string, dff array<double>, event_trace array<double>, z array<double>")
    events = spark.createDataFrame([("r1", 2, 3.5, 1.0), ("r1", 3, 1.0, None), ("r2", 1, 1.0, 1.0)], "roi_id string, frame int, z double, amplitude double")
    marks = spark.createDataFrame([("r1", "accepted", "weak", "yes", None, ["a\tb", "c"]), ("r2", "accepted", "noisy", "yes", None, [])], "roi_id string, cell_state string, trace_quality string, control_ready string, artifact_class string, reason_tags array<string>")
    told = spark.createDataFrame([("r1", 2, "accepted")], "roi_id string, frame int, event_state string")
    return lambda **more: exports.control_tables(regions, events, marks, told, **({"rate": 2.0} | more))


def test_control_tables(control):
    tables = control()
    assert [tuple(r) for r in tables["accepted_traces"].orderBy("frame").collect()] == [
        ("r1", "1", "0.0", "1.0", "0.5", "", "accepted", "weak", "yes"),
        ("r1", "2", "0.5", "2.0", "", "", "accepted", "weak", "yes"),
        ("r1", "3", "1.0", "3.0", "", "", "accepted", "weak", "yes"),
    ]
    assert [tuple(r) for r in tables["accepted_events"].orderBy("frame").collect()] == [("r1", "2", "0.5", "3.5", "1.0", "accepted", "", "", "accepted", "yes"), ("r1", "3", "1.0", "1.0", "", "", "", "", "accepted", "yes")]
    assert [tuple(r) for r in tables["neuron_metadata"].collect()] == [("r1", "accepted", "weak", "yes", "", "", "", "a b,c")]
    everything = control(include_pending=True, rate=None)
    assert {r.roi_id for r in everything["neuron_metadata"].collect()} == {"r1", "r2"}
    assert {r.time_sec for r in everything["accepted_traces"].collect()} == {""} and everything["accepted_events"].where("time_sec <> ''").count() == 0


def test_bundles_are_published_whole(spark, control, tmp_path):
    tables, path = control(), f"{tmp_path}/bundle"
    manifest = exports.publish(tables, path, {"profile": "inverse_dynamics"})
    assert {k: v["rows"] for k, v in manifest["tables"].items()} == {"accepted_traces": 3, "accepted_events": 2, "neuron_metadata": 1}
    with open(f"{path}/manifest.json", encoding="utf-8") as f:
        assert json.load(f) == manifest
    back = exports.published(spark, path)
    for name, df in tables.items():
        assert back[name].columns == df.columns
        assert sorted(tuple(x or "" for x in r) for r in back[name].collect()) == sorted(map(tuple, df.collect()))
    # an export that fails leaves the one before it as it was
    broken = tables | {"neuron_metadata": tables["neuron_metadata"].withColumn("roi_id", F.raise_error(F.lit("cut off")))}
    with pytest.raises(Exception, match="cut off"):
        exports.publish(broken, path)
    assert exports.published(spark, path)["accepted_traces"].count() == 3 and not [x for x in os.listdir(path) if x.endswith(".part")]
    with open(f"{path}/{manifest['files'][0]['path']}", "a") as f:
        f.write("more\n")
    with pytest.raises(Exception, match="not as it was published|Checksum"):
        exports.published(spark, path)
    assert not math.isnan(sum(x["bytes"] for x in manifest["files"]))
