import pytest
from pyspark.sql import functions as F

from frameloom.operators import annotations as A


def test_migration_and_its_repeat(spark):
    df = spark.createDataFrame([(1, "accept", None, "a, b;c ,", "HIGH"), (2, "rejected", "unsure", None, "sure"), (3, None, None, "", None)], "id int, state string, cell_state string, reason_codes string, confidence string")
    once = A.migrated(df, "cell_state", A.REGION_FIELDS)
    rows = once.orderBy("id").collect()
    assert [(r.cell_state, r.reason_tags, r.confidence, r.artifact_class) for r in rows] == [("accepted", ["a", "b", "c"], "high", ""), ("unsure", [], "", ""), ("", [], "", "")]
    assert A.migrated(once, "cell_state", A.REGION_FIELDS).orderBy("id").collect() == rows


def test_decisions_are_clamped(spark):
    df = spark.createDataFrame([(" Split", "maybe", "1;2"), ("join", "Accepted", None)], "decision_type string, decision_state string, source_roi_ids string")
    rows = A.migrated_decisions(df).collect()
    assert [(r.decision_type, r.decision_state, r.source_roi_ids) for r in rows] == [("split", "", ["1", "2"]), ("", "accepted", [])]


def test_label_pairs(spark):
    a = spark.createDataFrame([(1, "x"), (2, " "), (3, "y")], "id int, l string")
    b = spark.createDataFrame([(1, "x"), (3, "x"), (4, "y")], "id int, l string")
    assert {(r.first, r.second): r.n for r in A.label_pairs(a, b, "id", "l").collect()} == {("x", "x"): 1, ("missing", "missing"): 1, ("y", "x"): 1, ("missing", "y"): 1}


def test_tasks_are_ordered(spark):
    r = spark.createDataFrame([("3", 1.0), ("1", 2.0)], "region_id string, score double")
    e = spark.createDataFrame([("1", 10, 2.0)], "region_id string, frame int, score double")
    s = spark.createDataFrame([("S1", 5.0)], "suggestion_id string, score double")
    assert [x.task_id for x in A.review_tasks(r, e, s).collect()] == ["suggestion:S1", "event:1:10", "roi:1", "roi:3"]


def test_sync_and_verdict(spark):
    points = spark.createDataFrame([("a", 0.1, 0.0, 0.1, 0.005), ("a", 0.2, 0.1, 0.1, 0.005), ("b", 0.25, 0.1, None, 0.01), ("c", None, 1.0, None, None)], "k string, imaging_sec double, behavior_sec double, offset_sec double, tolerance_sec double")
    got = {r.k: (r.sync, r.n_errors) for r in A.sync_errors(points, "k").collect()}
    assert got == {"a": ("ok", 2), "b": ("failed", 1), "c": ("not_tested", 0)}
    yes, no = F.lit(True), F.lit(False)
    cases = [A.alignment_state(F.lit("Validated"), no, no, no, no, yes), A.alignment_state(F.lit(None).cast("string"), yes, no, no, no, no), A.alignment_state(F.lit("x"), no, no, yes, no, no), A.alignment_state(F.lit("validated"), no, no, no, yes, no)]
    assert list(spark.range(1).select(*[c.alias(str(k)) for k, c in enumerate(cases)]).first()) == ["provided_unvalidated", "validated", "provided_unvalidated", "failed"]


def test_reports(spark):
    runs = spark.createDataFrame([("r1", "d", "completed", 2.0, ["b", "a"]), ("r2", "e", "failed", 1.0, ["a"])], "run_id string, dataset_id string, status string, seconds double, artifacts array<string>")
    row = A.metrics_report(runs).first()
    assert (row.n_runs, row.n_completed, row.n_failed, row.total_seconds, row.dataset_id, row.artifacts) == (2, 1, 1, 3.0, "multiple_datasets", ["a", "b"])
    metrics = spark.createDataFrame([("r1", "event", "recall", 0.5), ("r2", "event", "recall", 0.75), ("r1", "runtime", "seconds", 2.0)], "run_id string, section string, metric string, value double")
    table = {r.run_id: (r.event_recall, r.runtime_seconds) for r in A.comparison(metrics, [("event", "recall"), ("runtime", "seconds")]).collect()}
    assert table == {"r1": (0.5, 2.0), "r2": (0.75, None)}
    assert [r.run_id for r in A.best_of_runs(metrics, "event", "recall").collect()] == ["r2", "r1"]
    assert A.best_of_runs(metrics, "runtime", "seconds", True).first().value == pytest.approx(2.0)
