"""Scores of regions, suggestions and candidates as column expressions over a table of ramps.

A ramp (column, zero_at, one_at, weight) adds weight times how far the column has come from zero_at to one_at, from 0 to
1. Missing values count as 0 unless a ramp is switched off for them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expr import clamp

Ramp = tuple[str, float, float, float]

# Weight and cap of each term of a region's review priority, and what else adds to it.
REGION_TERMS = (("event_count", 0.45, 8.0), ("trace_snr", 0.25, 6.0), ("local_correlation", 1.2, 1.0), ("event_support", 1.1, 1.0), ("artifact_score", -1.6, 1.0))
UNREVIEWED, NEEDS_ACTION, USUAL_AREA, AREA_RANGE = 2.0, 0.6, 0.35, (20, 180)
# Weights of a suggestion's review priority.
SUGGESTION_TERMS = (("local_correlation", 0.8), ("event_support", 0.8))
SUGGESTION_UNLABELED, SUGGESTION_ARTIFACT = 1.5, 0.7
# Ramps of a region's artifact risk; those of SWITCHED count only where the column is above 0.
ARTIFACT_RAMPS: tuple[Ramp, ...] = (
    ("artifact_score", 0, 1, 0.45), ("background_correlation", 0.35, 0.8, 0.20), ("local_correlation", 0.40, 0, 0.15), ("area", 140, 300, 0.10), ("area", 8, 0, 0.08),
    ("elongation", 3, 7, 0.10), ("trace_snr", 1.5, 0, 0.08),
)
SWITCHED = frozenset({("local_correlation", 0.40), ("area", 8), ("trace_snr", 1.5)})
BORDER_RISK, ANNOTATED_RISK = 0.08, 0.15
# Ramps of a missed candidate's proposal score.
PROPOSAL_RAMPS: tuple[Ramp, ...] = (
    ("priority", 0, 1, 0.35), ("discovery", 0, 1, 0.20), ("event_support", 0, 1, 0.18), ("local_correlation", 0, 1, 0.14), ("compactness", 0, 1, 0.08), ("max_z", 0, 6, 0.06),
    ("active_frames", 0, 20, 0.04), ("artifact_score", 0, 1, -0.22), ("area", 180, 360, -0.08), ("elongation", 3, 7, -0.08),
)
BORDER_PROPOSAL, REJECTED, ACCEPTED = -0.05, -0.35, 0.10
# Open ranges in which a candidate is uncertain, and what each adds.
UNCERTAIN = (("trace_snr", 0.5, 1.8, 0.35), ("local_correlation", 0.2, 0.45, 0.25), ("event_support", 0.2, 0.45, 0.25), ("artifact_score", 0.3, 0.65, 0.35))
NEAR_MEDIAN, CONFLICT, UNLABELLED = 0.35, 0.75, 0.75


def _value(columns: Mapping[str, Column], name: str) -> Column:
    return F.coalesce(columns[name].cast("double"), F.lit(0.0)) if name in columns else F.lit(0.0)


def ramped(columns: Mapping[str, Column], ramps: Sequence[Ramp], switched: frozenset = frozenset()) -> Column:
    """The sum of the ramps."""
    total = F.lit(0.0)
    for name, zero, one, weight in ramps:
        x = _value(columns, name)
        part = weight * clamp((x - float(zero)) / float(one - zero), 0.0, 1.0)
        total = total + (F.when(x > 0, part).otherwise(0.0) if (name, zero) in switched else part)
    return total


def region_priority(columns: Mapping[str, Column], reviewed: Column, needs_action: Column) -> Column:
    """Review priority of a region: its own priority, the capped terms, and whether it still waits for a reviewer."""
    low, high = AREA_RANGE
    terms = sum((weight * clamp(_value(columns, name), 0.0, cap) for name, weight, cap in REGION_TERMS), F.lit(0.0))
    extra = F.when(reviewed, 0.0).otherwise(UNREVIEWED) + F.when(needs_action, NEEDS_ACTION).otherwise(0.0)
    return _value(columns, "raw_score") + terms + extra + F.when(_value(columns, "area").between(low, high), USUAL_AREA).otherwise(0.0)


def region_reasons(columns: Mapping[str, Column], reviewed: Column, needs_action: Column | None = None) -> Column:
    """Why a region is worth a look, as a list; needs_action: the action that its annotation asks for."""
    snr, near, support, artifact, events = (_value(columns, c) for c in ("trace_snr", "local_correlation", "event_support", "artifact_score", "event_count"))
    action = F.lit(None).cast("string") if needs_action is None else needs_action
    found = F.array(
        F.when(~reviewed, F.lit("unlabeled ROI")), F.when(events > 0, F.concat(events.cast("long").cast("string"), F.lit(" candidate events"))),
        F.when(snr >= 1.5, F.lit("usable trace SNR")).when(snr > 0, F.lit("weak trace SNR")), F.when(near >= 0.4, F.lit("locally coherent")).when(near > 0, F.lit("low local coherence")),
        F.when(support >= 0.35, F.lit("event-supported footprint")), F.when(artifact >= 0.4, F.lit("artifact risk")), F.when(F.length(action) > 0, F.concat(F.lit("needs "), action)),
    )
    return _or_else(found, "baseline candidate")


def _or_else(found: Column, usual: str) -> Column:
    """The texts of a list that are there, or the usual one."""
    own = F.filter(found, lambda x: x.isNotNull())
    return F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(usual)))


def suggestion_priority(columns: Mapping[str, Column], state: Column, cue: Column) -> Column:
    """Review priority of a suggestion; state: its annotation's, cue: its artifact cue."""
    raw = F.coalesce(*[columns[c].cast("double") for c in ("priority", "discovery") if c in columns], F.lit(0.0))
    terms = sum((weight * _value(columns, name) for name, weight in SUGGESTION_TERMS), F.lit(0.0))
    return raw + terms + F.when(_blank(state), SUGGESTION_UNLABELED).otherwise(0.0) + F.when(_cued(columns, cue), SUGGESTION_ARTIFACT).otherwise(0.0)


def suggestion_reasons(columns: Mapping[str, Column], state: Column, cue: Column) -> Column:
    """Why a suggestion is worth a look, as a list."""
    found = F.array(
        F.when(_blank(state), F.lit("unlabeled suggestion")), F.when(_cued(columns, cue), F.lit("artifact check")), F.when(_value(columns, "local_correlation") >= 0.4, F.lit("locally coherent")),
        F.when(_value(columns, "event_support") >= 0.35, F.lit("event-supported")),
    )
    return _or_else(found, "discovery candidate")


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _cued(columns: Mapping[str, Column], cue: Column) -> Column:
    return (_value(columns, "artifact_score") >= 0.4) | ~F.coalesce(cue, F.lit("")).isin("", "none")


def region_category(columns: Mapping[str, Column], reviewed: Column, accepted: Column, ready: Column) -> Column:
    """What kind of review a region needs; the first that holds."""
    snr = F.coalesce(columns["trace_snr"].cast("double"), F.lit(99.0))
    waiting = F.when(_value(columns, "artifact_score") >= 0.4, "artifact_check").when(snr < 1.5, "weak_trace_check").when(_value(columns, "event_count") > 0, "event_supported_unlabeled").otherwise("unlabeled_roi")
    return F.when(~reviewed, waiting).when(accepted & ~ready, "control_readiness_check").otherwise("reviewed_followup")


def artifact_reasons(columns: Mapping[str, Column], near_border: Column, cue: Column, annotated: Column) -> Column:
    """What speaks for an artifact, as a list without repeats; cue and annotated: classes, "none" or nothing for none."""
    area, near = _value(columns, "area"), _value(columns, "local_correlation")
    named = lambda c: F.when(~F.coalesce(c, F.lit("")).isin("", "none"), F.translate(c, "_", " "))
    found = F.array(
        F.when(_value(columns, "artifact_score") >= 0.4, F.lit("artifact score")), F.when(_value(columns, "background_correlation") >= 0.55, F.lit("background correlated")),
        F.when((near > 0) & (near < 0.35), F.lit("low local coherence")), F.when((area != 0) & (area < 8), F.lit("too small")), F.when(area >= 180, F.lit("large or merged")),
        F.when(_value(columns, "elongation") >= 5, F.lit("elongated")), F.when(near_border, F.lit("near border")), named(cue), named(annotated),
    )
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def artifact_risk(columns: Mapping[str, Column], near_border: Column, annotated: Column) -> Column:
    """How likely a region is an artifact, from 0 to 1."""
    extra = F.when(near_border, BORDER_RISK).otherwise(0.0) + F.when(annotated, ANNOTATED_RISK).otherwise(0.0)
    return clamp(ramped(columns, ARTIFACT_RAMPS, SWITCHED) + extra, 0.0, 1.0)


def proposal_score(columns: Mapping[str, Column], near_border: Column, state: Column) -> Column:
    """How likely a suggestion is a candidate that was missed, from 0 to 1."""
    if "discovery" not in columns and "priority" in columns:
        columns = {**columns, "discovery": columns["priority"]}
    told = F.when(state.isin("reject", "rejected", "artifact"), REJECTED).when(state.isin("accept", "accepted"), ACCEPTED).otherwise(0.0)
    return clamp(ramped(columns, PROPOSAL_RAMPS) + F.when(near_border, BORDER_PROPOSAL).otherwise(0.0) + told, 0.0, 1.0)


def uncertainty(columns: Mapping[str, Column], priority: Column, median: Column) -> Column:
    """How much a label of a candidate would teach: nearness to the median priority and to borderline values."""
    total = F.when(F.abs(priority - median) <= F.greatest(F.lit(0.25), 0.15 * F.abs(median)), NEAR_MEDIAN).otherwise(0.0)
    for name, low, high, weight in UNCERTAIN:
        x = _value(columns, name)
        total = total + F.when((x > low) & (x < high), weight).otherwise(0.0)
    return total


def conflict(columns: Mapping[str, Column]) -> Column:
    """Whether artifact risk and evidence for a candidate stand against each other."""
    evidence = (_value(columns, "event_count") > 0) | (_value(columns, "trace_snr") >= 1.5) | (_value(columns, "event_support") >= 0.35)
    return F.when((_value(columns, "artifact_score") >= 0.4) & evidence, CONFLICT).otherwise(0.0)


def active_score(columns: Mapping[str, Column], priority: Column, median: Column, labelled: Column) -> Column:
    return priority + uncertainty(columns, priority, median) + conflict(columns) + F.when(labelled, 0.0).otherwise(UNLABELLED)
