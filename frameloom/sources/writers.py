"""Writers: tab-separated exports, records of artifacts, JSON documents, and the bundle of an export profile."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import plain_text
from ..operators.review import export_rows

# The states that each export profile keeps; None keeps all.
PROFILES = {"accepted_only": ["accepted"], "all_reviewed": ["accepted", "rejected", "unsure"], "all_candidates": None}


def write_tsv(rows: DataFrame, path: str) -> None:
    """Tab-separated files with a header: lists are joined by ", ", nulls are empty, tabs and line ends blanks."""
    columns = []
    for name, kind in rows.dtypes:
        c = F.array_join(F.col(name), ", ", "") if kind.startswith("array") else F.col(name)
        columns.append(plain_text(c).alias(name))
    rows.select(columns).write.option("header", True).option("sep", "\t").option("emptyValue", "").option("quote", "").csv(path)


def write_json(path: str, data: object) -> None:
    """A JSON document with sorted keys, put in place at once so that no reader sees half of it."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(data, f, indent=2, sort_keys=True, ensure_ascii=False)
        f.write("\n")
    os.replace(part, path)


def latest(records: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """The newest record of each key of an append-only log; of equal times the last in text order counts."""
    order = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(F.to_json(F.struct(*records.columns))))
    return records.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def flat_results(results: DataFrame) -> DataFrame:
    """A row for each operating point of each result (params struct, roc_points array of structs)."""
    points = results.select("config_id", "params.*", F.explode("roc_points").alias("_p"))
    return points.select(*[c for c in points.columns if c != "_p"], "_p.*")


def trace_rows(regions: DataFrame, key: str, arrays: Sequence[str], rate: float) -> DataFrame:
    """Traces as rows: frame from 1, seconds from 0, one column for each array; arrays that end early give nulls."""
    first = arrays[0]
    zipped = regions.select(key, F.size(first).alias("_n"), F.posexplode(F.arrays_zip(*arrays)).alias("_k", "_v")).where("_k < _n")
    return zipped.select(key, (F.col("_k") + 1).alias("frame"), (F.col("_k") / rate).alias("time_sec"), *[F.col(f"_v.{a}").alias(a) for a in arrays])


def export_bundle(path: str, profile: str, regions: DataFrame, events: DataFrame, annotations: DataFrame, event_annotations: DataFrame) -> dict:
    """Writes the regions and events that a profile keeps, and a manifest with their counts.

    regions have region_id, events region_id and frame; annotations give a region's or an event's state. An accepted
    event also needs an accepted region in the profile of accepted ones.
    """
    keep = PROFILES[profile]
    kept = export_rows(regions, annotations, "region_id", "state", keep)
    keyed = events.withColumn("event_key", F.concat_ws(":", "region_id", "frame"))
    found = export_rows(keyed, event_annotations, "event_key", "state", keep)
    if profile == "accepted_only":
        found = found.join(kept.select("region_id"), "region_id", "left_semi")
    write_tsv(kept.orderBy(F.col("region_id").cast("string")), f"{path}/regions")
    write_tsv(found.orderBy("region_id", F.col("frame").cast("int")), f"{path}/events")
    return {"profile": profile, "regions": kept.count(), "events": found.count()}
