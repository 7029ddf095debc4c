"""Annotation tables: bringing old forms up to date, label pairs, review tasks, alignment verdicts, run reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Old names of states, the confidences, types and states of decisions that are known.
STATE_NAMES = {"accept": "accepted", "reject": "rejected"}
CONFIDENCES = ("low", "medium", "high")
DECISION_TYPES = ("split", "merge")
DECISION_STATES = ("proposed", "accepted", "rejected", "unsure")
ALIGNMENT_STATES = ("validated", "failed", "provided_unvalidated", "not_provided")
#: Text columns of a region's and an event's annotation that are empty where unset.
REGION_FIELDS = ("state", "trace_quality", "control_ready", "artifact_class", "identity_group", "needs_action")
EVENT_FIELDS = ("state", "event_type", "timing_quality")


def tag_list(c: Column, kind: str) -> Column:
    """Tags as a list: text is cut at commas and semicolons; blanks go, empty ones are left out."""
    parts = c if kind.startswith("array") else F.split(F.coalesce(c.cast("string"), F.lit("")), "[,;]")
    return F.filter(F.transform(F.coalesce(parts, F.array()), lambda x: F.trim(x.cast("string"))), lambda x: x != "")


def one_of(c: Column, known: Sequence[str]) -> Column:
    """A label in small letters if it is known, else empty."""
    text = F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    return F.when(text.isin(*known), text).otherwise("")


def current_state(c: Column) -> Column:
    """A state under its present name; unknown ones stay."""
    out = c
    for old, new in STATE_NAMES.items():
        out = F.when(c == old, new).otherwise(out)
    return F.coalesce(out, F.lit(""))


def migrated(rows: DataFrame, derived: str, fields: Sequence[str]) -> DataFrame:
    """Annotations in the present form: all fields there, the derived state taken from the old one where it is null,
    tags as a list, confidence a known one. Migrating twice changes nothing."""
    kinds = dict(rows.dtypes)
    given = lambda c: F.col(c) if c in kinds else F.lit(None).cast("string")
    tags = "reason_tags" if "reason_tags" in kinds else "reason_codes"
    new = {c: F.coalesce(given(c), F.lit("")) for c in fields}
    new[derived] = F.coalesce(given(derived), current_state(given("state")))
    new["reason_tags"] = tag_list(F.col(tags), kinds[tags]) if tags in kinds else F.array().cast("array<string>")
    new["confidence"] = one_of(given("confidence"), CONFIDENCES)
    return rows.withColumns(new)


def migrated_decisions(rows: DataFrame) -> DataFrame:
    """Split and merge decisions in the present form."""
    kinds = dict(rows.dtypes)
    lists = {c: tag_list(F.col(c), kinds[c]) for c in ("source_roi_ids", "target_roi_ids", "reason_tags") if c in kinds}
    return rows.withColumns({"decision_type": one_of(F.col("decision_type"), DECISION_TYPES), "decision_state": one_of(F.col("decision_state"), DECISION_STATES)} | lists)


def label_pairs(first: DataFrame, second: DataFrame, key: str, label: str) -> DataFrame:
    """How often each pair of labels of two reviewers occurs; a missing one is "missing"."""
    a, b = first.select(key, F.col(label).alias("_a")), second.select(key, F.col(label).alias("_b"))
    told = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("missing"))
    return a.join(b, key, "full_outer").groupBy(told("_a").alias("first"), told("_b").alias("second")).agg(F.count("*").alias("n"))


def review_tasks(regions: DataFrame, events: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Tasks of a batch in one list: task_id, task_type, subject_id, priority; by falling priority, then task_id.

    regions (region_id, score), events (region_id, frame, score), suggestions (suggestion_id, score).
    """
    r = regions.select(F.concat(F.lit("roi:"), "region_id").alias("task_id"), F.lit("roi").alias("task_type"), F.col("region_id").cast("string").alias("subject_id"), F.col("score").alias("priority"))
    subject = F.concat_ws(":", F.col("region_id").cast("string"), F.col("frame").cast("string"))
    e = events.select(F.concat(F.lit("event:"), subject).alias("task_id"), F.lit("event").alias("task_type"), subject.alias("subject_id"), F.col("score").alias("priority"))
    s = suggestions.select(F.concat(F.lit("suggestion:"), "suggestion_id").alias("task_id"), F.lit("suggestion").alias("task_type"), F.col("suggestion_id").cast("string").alias("subject_id"), F.col("score").alias("priority"))
    return r.unionByName(e).unionByName(s).orderBy(F.desc("priority"), "task_id")


def sync_errors(points: DataFrame, key: str) -> DataFrame:
    """Per recording the largest and mean distance of its sync points, with the tolerance's verdict.

    points: key, imaging_sec, behavior_sec, offset_sec, tolerance_sec; points that lack a time are not counted.
    """
    error = F.abs(F.col("imaging_sec") - (F.col("behavior_sec") + F.coalesce("offset_sec", F.lit(0.0))))
    out = points.groupBy(key).agg(F.count("*").alias("n_points"), F.count(error).alias("n_errors"), F.max(error).alias("max_error"), F.avg(error).alias("mean_error"), F.max(F.coalesce(F.nullif("tolerance_sec", F.lit(0.0)), F.lit(0.05))).alias("tolerance"))
    return out.withColumn("sync", F.when(F.col("n_errors") == 0, "not_tested").when(F.col("max_error") > F.col("tolerance"), "failed").otherwise("ok"))


def alignment_state(declared: Column, validated: Column, failed: Column, provided: Column, checks_failed: Column, warned: Column) -> Column:
    """The verdict on a recording's alignment: what was declared, then what the flags say; failed checks overrule, warnings demote."""
    said = F.lower(F.trim(F.coalesce(declared, F.lit(""))))
    state = F.when(said.isin(*ALIGNMENT_STATES), said).when(validated, "validated").when(failed, "failed").when(provided, "provided_unvalidated").otherwise("not_provided")
    return F.when(checks_failed, "failed").when((state == "validated") & warned, "provided_unvalidated").otherwise(state)


def metrics_report(runs: DataFrame) -> DataFrame:
    """One row over runs (run_id, dataset_id, status, seconds, artifacts array): counts, times, data set, artifacts."""
    return runs.agg(
        F.count("*").alias("n_runs"), F.count_if(F.col("status") == "completed").alias("n_completed"), F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("total_seconds"),
        F.when(F.count_distinct("dataset_id") > 1, "multiple_datasets").otherwise(F.coalesce(F.min("dataset_id"), F.lit(""))).alias("dataset_id"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("artifacts")))).alias("artifacts"),
    )


def comparison(metrics: DataFrame, specs: Sequence[tuple[str, str]]) -> DataFrame:
    """A row for each run with a column for each metric (section.metric), null where a run lacks it."""
    names = [f"{section}.{metric}" for section, metric in specs]
    keyed = metrics.withColumn("_name", F.concat_ws(".", "section", "metric"))
    out = keyed.groupBy("run_id").pivot("_name", names).agg(F.first("value"))
    return out.toDF("run_id", *[n.replace(".", "_") for n in names])


def best_of_runs(metrics: DataFrame, section: str, metric: str, lower: bool = False) -> DataFrame:
    """Runs by one metric, best first; ties by run."""
    rows = metrics.where((F.col("section") == section) & (F.col("metric") == metric) & F.col("value").isNotNull())
    return rows.orderBy(F.asc("value") if lower else F.desc("value"), "run_id").select("run_id", "value")
