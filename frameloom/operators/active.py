"""Active review: tasks for candidates and clusters with the strategies that ask for them, batches, counts and feature rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import label, rounded
from . import scoring
from .signal import medians

# States that count as reviewed, codes of uncertain features, strategies, and weights of a cluster's task.
REVIEWED = ("accepted", "rejected", "unsure", "accept", "reject", "artifact", "missed", "promoted")
UNCERTAIN_CODES = {"trace_snr": "trace_snr_uncertainty", "local_correlation": "local_coherence_uncertainty", "event_support": "event_support_uncertainty", "artifact_score": "artifact_uncertainty"}
UNLABELED, BOUNDARY, CONFLICT, SPLIT_MERGE = "high_priority_unlabeled", "decision_boundary_uncertainty", "artifact_neuron_conflict", "split_merge_cluster"
CLUSTER_BASE, CLUSTER_MEMBER, CLUSTER_ISSUE = 1.25, 0.25, 0.75

_TASK = ("task_id", "task_type", "subject_id", "active_score", "priority_score", "uncertainty_score", "state", "selected_by", "reason_codes")


def _present(*columns: Column) -> Column:
    return F.filter(F.array(*columns), lambda x: x.isNotNull())


def candidate_tasks(candidates: DataFrame, include_reviewed: bool = False) -> DataFrame:
    """A task for each candidate (candidate_id, priority_score, state, reason_codes and features as columns) that is not reviewed.

    The median priority is that of all candidates, reviewed ones too. Candidates without an identifier have no task, of
    several with one identifier the one with the largest score counts.
    """
    names = candidates.columns
    columns = {c: F.col(c) for c in names}
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in names else F.lit(0.0)
    rows = candidates.withColumn("priority_score", F.coalesce(F.col("priority_score").cast("double"), F.lit(0.0)))
    middle = F.broadcast(medians(rows, [], "priority_score").withColumnRenamed("median", "_mid"))  # one row
    rows = rows.crossJoin(middle).withColumn("state", label(F.col("state")) if "state" in names else F.lit(""))
    rows = rows.where(F.coalesce(F.col("candidate_id").cast("string"), F.lit("")) != "")
    if not include_reviewed:
        rows = rows.where(~F.col("state").isin(*REVIEWED))
    new = F.col("state").isin("", "unlabeled")
    priority = F.col("priority_score")
    unsure, against = scoring.uncertainty(columns, priority, F.col("_mid")), scoring.conflict(columns)
    near = F.abs(priority - F.col("_mid")) <= F.greatest(F.lit(0.25), 0.15 * F.abs("_mid"))
    unsure_codes = [F.when(near, "decision_boundary"), *[F.when((value(c) > low) & (value(c) < high), UNCERTAIN_CODES[c]) for c, low, high, _ in scoring.UNCERTAIN]]
    given = F.coalesce(F.col("reason_codes"), F.array().cast("array<string>")) if "reason_codes" in names else F.array().cast("array<string>")
    codes = F.array_sort(F.array_distinct(F.concat(given, _present(*unsure_codes, F.when(new, "unlabeled_candidate"), F.when(against > 0, CONFLICT)))))
    # strategies follow from all codes, those that a candidate came with included
    unlabeled, boundary, conflict = F.array_contains("reason_codes", "unlabeled_candidate"), F.exists("reason_codes", lambda x: x.endswith("_uncertainty") | (x == "decision_boundary")), F.array_contains("reason_codes", CONFLICT)
    chosen = _present(F.when(unlabeled, UNLABELED), F.when(boundary, BOUNDARY), F.when(conflict, CONFLICT))
    score = priority + unsure + against + F.when(new, scoring.UNLABELLED).otherwise(0.0)
    tasks = rows.select(
        F.concat(F.lit("candidate:"), F.col("candidate_id").cast("string")).alias("task_id"), F.lit("candidate").alias("task_type"), F.col("candidate_id").cast("string").alias("subject_id"),
        rounded(score, 6).alias("active_score"), rounded(priority, 6).alias("priority_score"), rounded(unsure, 6).alias("uncertainty_score"),
        F.when(F.col("state") == "", "unlabeled").otherwise(F.col("state")).alias("state"), codes.alias("reason_codes"),
    ).withColumn("selected_by", F.when(F.size(chosen) > 0, chosen).otherwise(F.array(F.lit(UNLABELED))))
    return _largest(tasks.select(*_TASK))


def cluster_tasks(clusters: DataFrame, candidates: DataFrame, include_reviewed: bool = False) -> DataFrame:
    """A task for each cluster (cluster_id, candidate_ids, issue_codes) that has a member which is not reviewed.

    Members are looked up by a join; members that are no candidates count as not reviewed, with priority 0.
    """
    members = clusters.where(F.size("candidate_ids") > 0).select("cluster_id", "issue_codes", F.size("candidate_ids").alias("_many"), F.explode("candidate_ids").alias("_id"))
    known = candidates.groupBy(F.col("candidate_id").cast("string").alias("_id")).agg(F.max("priority_score").alias("_p"), F.min(label(F.col("state")).isin(*REVIEWED)).alias("_done"))
    joined = members.withColumn("_id", F.col("_id").cast("string")).join(known, "_id", "left")
    out = joined.groupBy("cluster_id").agg(F.first("issue_codes").alias("_codes"), F.first("_many").alias("_many"), F.coalesce(F.max("_p").cast("double"), F.lit(0.0)).alias("_top"), F.min(F.coalesce("_done", F.lit(False))).alias("_done"))
    if not include_reviewed:
        out = out.where("not _done")
    codes = F.coalesce("_codes", F.array().cast("array<string>"))
    issue = F.array_contains(codes, "possible_duplicate") | F.array_contains(codes, "split_merge_review")
    top = F.col("_top")
    score = top + CLUSTER_BASE + CLUSTER_MEMBER * F.col("_many") + F.when(issue, CLUSTER_ISSUE).otherwise(0.0)
    tasks = out.select(
        F.concat(F.lit("cluster:"), F.col("cluster_id").cast("string")).alias("task_id"), F.lit("cluster").alias("task_type"), F.col("cluster_id").cast("string").alias("subject_id"), rounded(score, 6).alias("active_score"),
        rounded(top, 6).alias("priority_score"), F.lit(0.0).alias("uncertainty_score"), F.lit(None).cast("string").alias("state"), F.array(F.lit(SPLIT_MERGE)).alias("selected_by"),
        F.array_sort(F.array_distinct(F.concat(codes, F.array(F.lit(SPLIT_MERGE))))).alias("reason_codes"),
    )
    return tasks.select(*_TASK)


def _largest(tasks: DataFrame) -> DataFrame:
    """One row for each task, the one with the largest score."""
    rest = F.struct("active_score", *[c for c in _TASK if c not in ("task_id", "active_score")])
    return tasks.groupBy("task_id").agg(F.max(rest).alias("_r")).select("task_id", "_r.*").select(*_TASK)


def review_batch(tasks: DataFrame, size: int) -> DataFrame:
    """The tasks with the largest scores, ties by task_id."""
    if size < 1:
        raise ValueError("a batch has at least one task")
    return tasks.orderBy(F.desc("active_score"), "task_id").limit(size)


def batch_counts(tasks: DataFrame) -> DataFrame:
    """(kind, name, n): tasks by type, and by each strategy that selected them."""
    by_type = tasks.groupBy(F.col("task_type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("type").alias("kind"), "name", "n")
    by_strategy = tasks.select(F.explode("selected_by").alias("name")).groupBy("name").agg(F.count("*").alias("n")).select(F.lit("strategy").alias("kind"), "name", "n")
    return by_type.unionByName(by_strategy)


FEATURE_ROW = ("subject_type", "subject_id", "label_state", "priority_score", "event_count", "area", "trace_snr", "local_correlation", "event_support", "artifact_score", "reason_codes")


def feature_rows(subjects: Mapping[str, DataFrame], missing: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Rows for learning from reviews, of every kind of subject (id, state, priority_score, reasons and features as columns).

    Texts of reasons become codes joined by commas; a kind goes without the features that it lacks, or that missing names.
    """
    out = None
    for kind, rows in subjects.items():
        own = lambda c: F.col(c).cast("double").alias(c) if c in rows.columns and c not in (missing or {}).get(kind, ()) else F.lit(None).cast("double").alias(c)  # noqa: B023, E731
        state = label(F.col("state"))
        one = rows.select(
            F.lit(kind).alias("subject_type"), F.col("id").cast("string").alias("subject_id"), F.when(state == "", "unlabeled").otherwise(state).alias("label_state"),
            F.round(F.col("priority_score").cast("double"), 4).alias("priority_score"), *[own(c) for c in FEATURE_ROW[4:10]], F.array_join(reason_codes(F.col("reasons")), ",").alias("reason_codes"),
        )
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no subjects")
    return out


# What a reason's text speaks of, in this order, and the code that stands for it.
REASON_CODES = (
    ("unlabeled roi", "unlabeled_roi"), ("unlabeled event", "unlabeled_event"), ("unlabeled suggestion", "unlabeled_suggestion"), ("artifact", "artifact_check"),
    ("coherent", "local_coherence"), ("event", "event_support"), ("snr", "trace_snr"), ("needs", "needs_action"),
)


def reason_codes(reasons: Column) -> Column:
    """The codes of reasons' texts, sorted, each once; texts that speak of nothing known have none."""

    def code(text: Column) -> Column:
        out = None
        for word, name in REASON_CODES:
            found = F.lower(text).contains(word)
            out = F.when(found, name) if out is None else out.when(found, name)
        return out

    return F.array_sort(F.array_distinct(F.filter(F.transform(reasons, code), lambda x: x.isNotNull())))
