"""Analysis of proposals: why a suggestion may be a candidate that was missed, and counts over regions and suggestions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import reasons
from .scoring import _value

HIGH_RISK, HIGH_CONFIDENCE = 0.4, 0.65


def near_border(box: Sequence[Column], width: Column, height: Column) -> Column:
    """Whether a box (left, top, right, bottom, all within) comes within a pixel of an edge; not if something is missing."""
    left, top, right, bottom = box
    out = (width > 0) & (height > 0) & ((left <= 1) | (top <= 1) | (right >= width - 2) | (bottom >= height - 2))
    whole = width.isNotNull() & height.isNotNull()
    for side in box:
        whole = whole & side.isNotNull()
    return F.when(whole, out).otherwise(False)


def elongation(box: Sequence[Column]) -> Column:
    """The longer by the shorter side of a box (left, top, right, bottom, all within); 1 if a side is missing."""
    wide, high = (F.greatest(F.lit(1.0), b - a + 1.0) for a, b in ((box[0], box[2]), (box[1], box[3])))
    known = box[0].isNotNull() & box[1].isNotNull() & box[2].isNotNull() & box[3].isNotNull()
    return F.when(known, F.greatest(wide / high, high / wide)).otherwise(1.0)


def proposal_reasons(columns: Mapping[str, Column], artifact: Column, state: Column) -> Column:
    """Why a suggestion is proposed, as a list; artifact: the list of what speaks for an artifact, of which three are named."""
    v = lambda name: _value(columns, name)
    told = reasons(
        (F.lit(True), "uncovered discovery suggestion"), (v("event_support") >= 0.35, "event-supported"), (v("local_correlation") >= 0.45, "locally coherent"),
        (v("compactness") >= 0.45, "compact footprint"), (v("max_z") >= 3, "strong positive evidence"), (v("active_frames") >= 4, "repeated activity"),
    )
    cues = F.when(F.size(artifact) > 0, F.concat(F.lit("artifact cue: "), F.array_join(F.slice(artifact, 1, 3), ", ")))
    own = F.when(F.coalesce(state, F.lit("")) != "", F.concat(F.lit("annotation: "), state))
    return F.filter(F.concat(told, F.array(cues, own)), lambda x: x.isNotNull())


def reason_counts(rows: DataFrame, listed: str) -> DataFrame:
    """(reason, n): how many rows name each reason; a row names a reason once."""
    return rows.select(F.explode(F.array_distinct(listed)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def analysis_summary(regions: DataFrame, risk: str, suggestions: DataFrame, score: str, cue: str, limit: int) -> DataFrame:
    """One row: regions and those of high risk; suggestions, those shown, of high confidence, with an artifact cue."""
    a = regions.agg(F.count("*").alias("region_count"), F.count_if(F.col(risk) >= HIGH_RISK).alias("high_risk_count"))
    cued = F.count_if(~F.coalesce(F.col(cue), F.lit("")).isin("", "none"))
    b = suggestions.agg(F.count("*").alias("proposal_count"), F.least(F.lit(limit), F.count("*")).alias("shown_count"), F.count_if(F.col(score) >= HIGH_CONFIDENCE).alias("high_confidence_count"), cued.alias("artifact_cued_count"))
    return a.crossJoin(b)  # one row each


def best(rows: DataFrame, scores: Sequence[str], position: str, limit: int) -> DataFrame:
    """The first `limit` rows by falling scores, equal ones by their position."""
    return rows.orderBy(*[F.desc(s) for s in scores], position).limit(limit)
