"""Review work: agreement, summaries, provenance, triage, queues and batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import label, plain_text, ratio


def cohen_kappa(rows: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Binary kappa of two raters over the rows that both labelled (0 or 1).

    With a chance agreement of 1, kappa is 1 if they always agree and else 0; without rows all is 0.
    """
    both = rows.where(F.col(a).isin(0, 1) & F.col(b).isin(0, 1))
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    same = F.when(x == y, 1.0).otherwise(0.0)
    measured = [F.count("*").alias("n"), F.coalesce(F.avg(same), F.lit(0.0)).alias("observed"), F.avg(x).alias("pa"), F.avg(y).alias("pb")]
    out = both.groupBy(*by).agg(*measured) if by else both.agg(*measured)
    expected = F.coalesce(F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb")), F.lit(0.0))
    out = out.withColumn("expected", expected)
    sure = F.abs(1 - F.col("expected")) < 1e-12
    kappa = F.when(F.col("n") == 0, 0.0).when(sure, F.when(F.col("observed") == 1, 1.0).otherwise(0.0)).otherwise(ratio(F.col("observed") - F.col("expected"), 1 - F.col("expected")))
    return out.select(*by, "n", "observed", "expected", kappa.alias("kappa"))


def agreement(first: DataFrame, second: DataFrame, key: str, label: str, group: str) -> DataFrame:
    """Over all subjects of two label sets, in all and by group: both labelled, equal, missing on a side, to be settled."""
    a = first.select(key, F.col(group).alias("_ga"), F.col(label).alias("_a"))
    b = second.select(key, F.col(group).alias("_gb"), F.col(label).alias("_b"))
    both = a.join(b, key, "full_outer").withColumn("subject_group", F.coalesce("_ga", "_gb"))
    equal, known = F.col("_a") == F.col("_b"), F.col("_a").isNotNull() & F.col("_b").isNotNull()
    out = both.groupingSets([[], ["subject_group"]], "subject_group").agg(
        F.grouping("subject_group").alias("overall"), F.count("*").alias("subjects"), F.count_if(known).alias("both_labelled"), F.count_if(known & equal).alias("equal"),
        F.count_if(F.col("_a").isNull()).alias("missing_first"), F.count_if(F.col("_b").isNull()).alias("missing_second"), F.count_if(known & ~equal).alias("to_settle"),
    )
    return out.withColumn("exact_share", ratio(F.col("equal"), F.col("subjects")))


def disagreements(first: DataFrame, second: DataFrame, key: str, label: str) -> DataFrame:
    """Subjects whose two labels differ or of which one is missing."""
    a, b = first.select(key, F.col(label).alias("label_first")), second.select(key, F.col(label).alias("label_second"))
    return a.join(b, key, "full_outer").where(~F.col("label_first").eqNullSafe(F.col("label_second")))


def state_summary(rows: DataFrame, group: str, state: str, states: Sequence[str], reviewed: Sequence[str]) -> DataFrame:
    """Per group the count of each state, zeros too, and the share of rows in a reviewed state."""
    counts = [F.count_if(F.col(state) == s).alias(f"n_{s.lower()}") for s in states]
    return rows.groupBy(group).agg(F.count("*").alias("n"), *counts, F.avg(F.when(F.col(state).isin(*reviewed), 1.0).otherwise(0.0)).alias("reviewed_share"))


def provenance(rows: DataFrame, scope: str, group: str, reviewer: str) -> DataFrame:
    """Rows and rows with a reviewer, rolled up over scope and group."""
    out = rows.rollup(scope, group).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.count(reviewer).alias("n_named"))
    return out.withColumn("coverage", ratio(F.col("n_named"), F.col("n")))


def triage(rows: DataFrame, identifier: str, categories: dict[str, Column]) -> DataFrame:
    """(identifier, category) for each category that a row falls in; categories don't exclude one another."""
    marks = F.filter(F.array(*[F.when(c, name) for name, c in categories.items()]), lambda x: x.isNotNull())
    return rows.select(identifier, F.explode(marks).alias("category"))


def _empty(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)), F.lit("")).isin("", "none")


def region_categories(c: Mapping[str, Column], grouped: Column) -> dict[str, Column]:
    """The triage categories of a region. c: cell_state, trace_quality, control_ready, artifact_class, needs_action,
    artifact_score; grouped: whether other regions share its identity group."""
    artifact = ~_empty(c["artifact_class"]) | (F.coalesce(c["artifact_score"], F.lit(0.0)) >= 0.4)
    return {
        "strong_neuron": (c["cell_state"] == "accepted") & (c["trace_quality"] == "good") & c["control_ready"].isin("yes", "maybe") & ~artifact,
        "artifact_like": artifact,
        "merged_cluster": F.coalesce(F.lower(c["needs_action"]).contains("merge"), F.lit(False)) | grouped,
        "weak_trace": c["trace_quality"].isin("weak", "noisy", "unusable"),
    }


def suggestion_categories(c: Mapping[str, Column]) -> dict[str, Column]:
    """The triage categories of a suggestion. c: state, artifact_class, artifact_cue, artifact_score."""
    artifact = (c["state"] == "artifact") | ~_empty(c["artifact_class"]) | ~_empty(c["artifact_cue"]) | (F.coalesce(c["artifact_score"], F.lit(0.0)) >= 0.4)
    return {"possible_missed_neuron": c["state"].isin("missed", "promoted"), "artifact_like": artifact}


def event_categories(c: Mapping[str, Column]) -> dict[str, Column]:
    """The triage category of an event. c: event_state, event_type, timing_quality."""
    waits = F.coalesce(c["event_state"], F.lit("unlabeled")).isin("unlabeled", "", "unsure")
    return {"needs_event_review": waits | (F.lower(F.trim(c["event_type"])) == "weak") | c["timing_quality"].isin("ambiguous", "slow_transient")}


def guided_queues(rows: DataFrame, identifier: str, score: str, queues: dict[str, Column], limit: int) -> DataFrame:
    """The first `limit` rows of each queue by falling score, with their place and the queue's full length.

    A row-number filter, so each task keeps `limit` rows of a queue before the shuffle.
    """
    members = rows.select(identifier, score, F.explode(F.filter(F.array(*[F.when(c, name) for name, c in queues.items()]), lambda x: x.isNotNull())).alias("queue"))
    totals = members.groupBy("queue").agg(F.count("*").alias("queue_length"))
    place = F.row_number().over(Window.partitionBy("queue").orderBy(F.desc(score), identifier))
    return members.withColumn("place", place).where(F.col("place") <= limit).join(F.broadcast(totals), "queue")  # a row for each queue


def next_batch(parents: DataFrame, children: DataFrame, key: str, child: str, score: str, child_score: str, n_parents: int, n_children: int, boost: float = 1.0) -> DataFrame:
    """The best parents, and the best children, of which those of a chosen parent get a boost."""
    top = parents.orderBy(F.desc(score), key).limit(n_parents).select(key, F.col(score).alias("score"))
    chosen = top.select(key, F.lit(boost).alias("_boost"))
    boosted = children.join(F.broadcast(chosen), key, "left")  # n_parents rows
    boosted = boosted.withColumn("score", F.col(child_score) + F.coalesce("_boost", F.lit(0.0)))
    best = boosted.orderBy(F.desc("score"), child).limit(n_children)
    rows = top.select(F.lit("parent").alias("kind"), F.col(key).cast("long").alias("id"), "score")
    return rows.unionByName(best.select(F.lit("child").alias("kind"), F.col(child).cast("long").alias("id"), "score"))


def export_rows(rows: DataFrame, annotations: DataFrame, key: str, state: str, keep: Sequence[str] | None) -> DataFrame:
    """rows with their annotation, those in a state to keep (None: all), unlabelled ones as such."""
    joined = rows.join(annotations, key, "left").withColumn(state, F.coalesce(state, F.lit("unlabeled")))
    return joined if keep is None else joined.where(F.col(state).isin(*keep))


def with_reviewer(rows: DataFrame, reviewer: str, name: str, reviewed: Column, overwrite: bool = False) -> DataFrame:
    """Stamps reviewed rows that name no reviewer, or all reviewed ones."""
    stamp = reviewed if overwrite else reviewed & (F.coalesce(F.trim(reviewer), F.lit("")) == "")
    return rows.withColumn(reviewer, F.when(stamp, F.lit(name)).otherwise(F.col(reviewer)))


REVIEWED = ("accepted", "rejected", "unsure", "accept", "reject")
TUNING_REGIONS, TUNING_EVENTS = 20, 20


def needs_second_reviewer(needs_action: Column, tags: Column, confidence: Column) -> Column:
    """Whether an annotation asks for a second reviewer: by its action, by a tag, or by low confidence."""
    named = F.transform(F.coalesce(tags, F.array().cast("array<string>")), label)
    return label(needs_action).contains("second") | F.arrays_overlap(named, F.array(F.lit("second_review"), F.lit("needs_second_reviewer"))) | (label(confidence) == "low")


def _unsure(c: Mapping[str, Column]) -> Column:
    return (label(c["state"]) == "unsure") | F.coalesce(c["confidence"], F.lit("")).isin("low", "medium")


def _risky(c: Mapping[str, Column]) -> Column:
    return F.coalesce(c["artifact_score"].cast("double"), F.lit(0.0)) >= 0.4


def _second(c: Mapping[str, Column]) -> Column:
    return needs_second_reviewer(c["needs_action"], c["reason_tags"], c["confidence"])


def region_queues(c: Mapping[str, Column]) -> dict[str, Column]:
    """The guided queues of a region. c: state, confidence, artifact_score, artifact_class, needs_action, reason_tags."""
    named = F.coalesce(c["artifact_class"], F.lit("")) != ""
    return {"unreviewed_high_priority": ~label(c["state"]).isin(*REVIEWED), "uncertain": _unsure(c), "likely_artifact": _risky(c) | named, "needs_second_reviewer": _second(c)}


def event_queues(c: Mapping[str, Column]) -> dict[str, Column]:
    """The guided queues of an event. c: state, confidence, needs_action, reason_tags."""
    return {"uncertain": _unsure(c), "needs_second_reviewer": _second(c)}


def suggestion_queues(c: Mapping[str, Column]) -> dict[str, Column]:
    """The guided queues of a suggestion. c: state (promoted included), confidence, artifact_score, artifact_cue, needs_action, reason_tags."""
    artifact = _risky(c) | ~F.coalesce(c["artifact_cue"], F.lit("")).isin("", "none")
    return {
        "possible_missed_neuron": label(c["state"]).isin("", "missed", "promoted") & ~artifact, "likely_artifact": (label(c["state"]) == "artifact") | artifact,
        "uncertain": _unsure(c), "needs_second_reviewer": _second(c),
    }


def event_queue_score(region_score: Column, z: Column) -> Column:
    """An event's place in a queue: its region's score, raised by its own."""
    return region_score + 0.4 * F.coalesce(z.cast("double"), F.lit(0.0))


def guided_items(parts: Sequence[tuple[str, DataFrame, Column, Column, dict[str, Column]]], limit: int | None) -> DataFrame:
    """(queue, place, subject_type, subject_id, score, queue_length) of several kinds of subjects in the same queues.

    parts: (subject type, rows, identifier, score, queues). Falling score, then type, then identifier as text. Each kind
    keeps `limit` rows of a queue in every task before the shuffle, so a queue that holds all rows is no burden.
    """
    members = None
    for kind, rows, identifier, score, queues in parts:
        own = F.explode(F.filter(F.array(*[F.when(c, name) for name, c in queues.items()]), lambda x: x.isNotNull()))
        these = rows.select(own.alias("queue"), F.lit(kind).alias("subject_type"), identifier.cast("string").alias("subject_id"), score.cast("double").alias("score"))
        members = these if members is None else members.unionByName(these)
    totals = members.groupBy("queue").agg(F.count("*").alias("queue_length"))
    place = F.row_number().over(Window.partitionBy("queue").orderBy(F.desc("score"), "subject_type", "subject_id"))
    placed = members.withColumn("place", place)
    return (placed if limit is None else placed.where(F.col("place") <= limit)).join(F.broadcast(totals), "queue")  # a row for each queue


def review_progress(regions: DataFrame, events: DataFrame, suggestions: DataFrame, state: str, promoted: str, regions_needed: int = TUNING_REGIONS, events_needed: int = TUNING_EVENTS) -> DataFrame:
    """One row: reviewed, accepted and rejected regions and events, reviewed suggestions, their shares, and whether there
    are labels enough to tune. A suggestion is reviewed if it has a state or was promoted."""
    s = label(F.col(state))

    def counts(rows: DataFrame, name: str) -> DataFrame:
        n = [F.count_if(s.isin(*REVIEWED)).alias(f"reviewed_{name}s"), F.count_if(s == "accepted").alias(f"accepted_{name}s"), F.count_if(s == "rejected").alias(f"rejected_{name}s")]
        return rows.agg(*n, F.greatest(F.lit(1), F.count("*")).alias(f"_{name}"))

    told = (s != "") | F.coalesce(F.col(promoted), F.lit(False))
    of = suggestions.agg(F.count_if(told).alias("reviewed_suggestions"), F.greatest(F.lit(1), F.count("*")).alias("_suggestion"))
    out = counts(regions, "region").crossJoin(counts(events, "event")).crossJoin(of)  # one row each
    out = out.withColumns({f"{name}_review_share": ratio(F.col(f"reviewed_{name}s"), F.col(f"_{name}")) for name in ("region", "event", "suggestion")})
    ready = (F.col("reviewed_regions") >= regions_needed) & (F.col("reviewed_events") >= events_needed)
    return out.withColumn("tuning_ready", ready).drop("_region", "_event", "_suggestion")


def compared(first: DataFrame, second: DataFrame, key: Sequence[str], state: str, confidence: str, artifact: str, others: Sequence[str] = ()) -> DataFrame:
    """Subjects of two reviewers side by side: label, confidence and artifact class of both (`_a`, `_b`), whether both
    labelled, whether they agree, whether the subject waits to be settled. A missing label is '', a missing confidence
    'unlabeled', a missing class 'none'; 'unlabeled' counts as no label. Other columns are put beside each other."""

    def side(rows: DataFrame, end: str) -> DataFrame:
        usual = lambda c, text: F.coalesce(F.nullif(label(F.col(c)), F.lit("")), F.lit(text))
        named = [label(F.col(state)).alias(f"label_{end}"), usual(confidence, "unlabeled").alias(f"confidence_{end}"), usual(artifact, "none").alias(f"artifact_{end}")]
        return rows.select(*key, *named, *[F.col(c).alias(f"{c}_{end}") for c in others])

    out = side(first, "a").join(side(second, "b"), [*key], "full_outer")
    usual = {"label": "", "confidence": "unlabeled", "artifact": "none"}
    out = out.withColumns({f"{c}_{end}": F.coalesce(f"{c}_{end}", F.lit(text)) for c, text in usual.items() for end in "ab"})
    both = ~F.col("label_a").isin("", "unlabeled") & ~F.col("label_b").isin("", "unlabeled")
    out = out.withColumn("both_labeled", both).withColumn("exact_agreement", F.col("both_labeled") & (F.col("label_a") == F.col("label_b")))
    return out.withColumn("to_settle", ~F.col("exact_agreement"))


def pair_breakdowns(rows: DataFrame) -> DataFrame:
    """(kind, pair, n): compared subjects by pair of confidences, by pair of artifact classes and, of those that both
    labelled, by pair of labels; one pass."""
    pair = lambda c: F.concat_ws(" / ", *[F.coalesce(F.nullif(F.col(f"{c}_{end}"), F.lit("")), F.lit("unlabeled")) for end in "ab"])
    kinds = F.array(*[F.struct(F.lit(c).alias("kind"), pair(c).alias("pair"), (F.col("both_labeled") if c == "label" else F.lit(True)).alias("counts")) for c in ("confidence", "artifact", "label")])
    tall = rows.select(F.explode(kinds).alias("p")).where("p.counts")
    return tall.groupBy("p.kind", "p.pair").agg(F.count("*").alias("n"))


def disagreement_rows(rows: DataFrame, key: Sequence[str], reviewers: tuple[str, str], others: Sequence[str] = ()) -> DataFrame:
    """Compared subjects that wait to be settled, in the shape of a tab-separated file: flags as 0 or 1, lists with commas."""
    kinds = dict(rows.dtypes)
    flat = lambda c: (F.array_join(c, ",") if kinds[c].startswith("array") else plain_text(F.col(c))).alias(c)
    sides = [flat(f"{c}_{end}") for c in ("label", "confidence", "artifact", *others) for end in "ab"]
    who = [F.lit(name).alias(f"reviewer_{end}") for name, end in zip(reviewers, "ab", strict=True)]
    flags = [F.col(c).cast("int").alias(c) for c in ("both_labeled", "exact_agreement")]
    return rows.where("to_settle").select(*key, *who, *flags, *sides)


def label_counts(rows: DataFrame, group: str, state: str, confidence: str, tags: str) -> DataFrame:
    """(group, kind, value, n): per group of subjects its states, its confidences and its tags; 'unlabeled' for none."""
    usual = lambda c: F.coalesce(F.nullif(label(F.col(c)), F.lit("")), F.lit("unlabeled"))
    own = F.array(F.struct(F.lit("state").alias("kind"), usual(state).alias("value")), F.struct(F.lit("confidence").alias("kind"), usual(confidence).alias("value")))
    named = F.transform(F.coalesce(F.col(tags), F.array().cast("array<string>")), lambda t: F.struct(F.lit("tag").alias("kind"), label(t).alias("value")))
    tall = rows.select(group, F.explode(F.concat(own, named)).alias("p"))
    return tall.groupBy(group, "p.kind", "p.value").agg(F.count("*").alias("n"))
