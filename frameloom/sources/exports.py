"""Bundles of tables for control models: traces, events and metadata of the regions that are ready for it, published at once.

A bundle is a folder. Each export writes its tables under a name of its own and then puts a manifest in place that lists
every file with its size and checksum; who reads goes by the manifest, so an export that was cut off is never seen, and
the one before it stays whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import plain_text
from .readers import checksums
from .writers import trace_rows, write_tsv

# Columns of the tables, and what a region's annotation must say for it to be ready.
TRACE_COLUMNS = ("roi_id", "frame", "time_sec", "dff", "event_trace", "z", "cell_state", "trace_quality", "control_ready")
EVENT_COLUMNS = ("roi_id", "frame", "time_sec", "z", "amplitude", "event_state", "event_type", "timing_quality", "cell_state", "control_ready")
METADATA_COLUMNS = ("roi_id", "cell_state", "trace_quality", "control_ready", "artifact_class", "identity_group", "confidence", "reason_tags")
READY = {"cell_state": ("accepted",), "trace_quality": ("good", "weak"), "control_ready": ("yes", "maybe"), "artifact_class": ("", "none")}


def control_ready(names: list[str]) -> Column:
    """Whether an annotation makes its region ready; an absent class of artifact is none, other absent values are not."""
    out = F.lit(True)
    for name, allowed in READY.items():
        value = F.coalesce(F.col(name), F.lit("")) if name in names else F.lit("")
        out = out & value.isin(*allowed)
    return out


def _given(df: DataFrame, names: tuple[str, ...]) -> list[Column]:
    return [(F.col(c) if c in df.columns else F.lit(None)).alias(c) for c in names]


def control_tables(regions: DataFrame, events: DataFrame, annotations: DataFrame, event_annotations: DataFrame, rate: float | None, include_pending: bool = False) -> dict[str, DataFrame]:
    """accepted_traces, accepted_events and neuron_metadata of the ready regions (of all, with include_pending), as text.

    regions: roi_id, dff, event_trace, z (arrays); events: roi_id, frame (from 1), z, amplitude; annotations: roi_id and
    METADATA_COLUMNS; event_annotations: roi_id, frame, event_state, event_type, timing_quality. Without a frame rate
    times are empty. Traces are as long as dff; other arrays that end early are empty there.
    """
    named = annotations.select("roi_id", *_given(annotations, METADATA_COLUMNS[1:]))
    ready = named.where(control_ready(named.columns))
    kept = regions.join(named, "roi_id", "left") if include_pending else regions.join(ready, "roi_id")
    kept = kept.withColumns({c: F.coalesce(c, F.array().cast(dict(kept.dtypes)[c])) for c in ("dff", "event_trace", "z")})  # a missing trace is an empty one
    rated = rate is not None and rate > 0
    traces = trace_rows(kept, "roi_id", ["dff", "event_trace", "z"], rate if rated else 1.0).join(kept.select("roi_id", "cell_state", "trace_quality", "control_ready"), "roi_id")
    own = events.join(kept.select("roi_id", "cell_state", "control_ready"), "roi_id")
    own = own.join(event_annotations.select("roi_id", "frame", *_given(event_annotations, EVENT_COLUMNS[5:8])), ["roi_id", "frame"], "left")
    seconds = lambda frame: frame / F.lit(float(rate)) if rated else F.lit(None).cast("double")
    own = own.withColumn("time_sec", seconds(F.coalesce(F.col("frame").cast("long"), F.lit(1)) - 1))
    if not rated:
        traces = traces.withColumn("time_sec", F.lit(None).cast("double"))
    tags = F.array_join("reason_tags", ",") if dict(kept.dtypes)["reason_tags"].startswith("array") else F.col("reason_tags")
    text = lambda df, names: df.select([plain_text(F.col(c)).alias(c) for c in names])
    return {
        "accepted_traces": text(traces.select(*_given(traces, TRACE_COLUMNS)), TRACE_COLUMNS),
        "accepted_events": text(own.select(*_given(own, EVENT_COLUMNS)), EVENT_COLUMNS),
        "neuron_metadata": text(kept.withColumn("reason_tags", tags), METADATA_COLUMNS),
    }


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def publish(tables: Mapping[str, DataFrame], path: str, more: Mapping[str, object] | None = None) -> dict:
    """Writes the tables and then their manifest, which it returns: all tables are published, or none.

    Counts, sizes and checksums are those of the files as they were written. more: what else the manifest is to say.
    """
    spark = next(iter(tables.values())).sparkSession
    export = f"export-{uuid.uuid4().hex[:12]}"
    entries = []
    for name, df in tables.items():
        place = f"{path.rstrip('/')}/{export}/{name}"
        write_tsv(df, place)
        rows = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(place).count() if df.columns else 0
        where, inner = _at(place)
        written = sorted(f.path for f in where.get_file_info(fs.FileSelector(inner)) if f.base_name.startswith("part-"))
        for r in checksums(spark, [place]).orderBy("path").collect() if written else []:  # a row for each file
            if r.path.rsplit("/", 1)[-1].startswith("part-"):
                entries.append({"table": name, "path": f"{export}/{name}/{r.path.rsplit('/', 1)[-1]}", "bytes": r.bytes, "sha256": r.sha256})
        entries.append({"table": name, "rows": rows})
    manifest = {"export": export, "tables": {x["table"]: {"rows": x["rows"]} for x in entries if "rows" in x}, "files": [x for x in entries if "path" in x], **(more or {})}
    where, inner = _at(path.rstrip("/"))
    part = f"{inner}/manifest.{uuid.uuid4().hex}.part"
    with where.open_output_stream(part) as f:
        f.write(json.dumps(manifest, indent=2, sort_keys=True, ensure_ascii=False).encode() + b"\n")
    where.move(part, f"{inner}/manifest.json")
    return manifest


def published(spark: SparkSession, path: str, check: bool = True) -> dict[str, DataFrame]:
    """The tables of a bundle, by its manifest; check: whether files must have the checksums that it gives."""
    where, inner = _at(path.rstrip("/"))
    with where.open_input_stream(f"{inner}/manifest.json") as f:
        manifest = json.loads(f.read())
    if check and manifest["files"]:
        want = {x["path"]: x["sha256"] for x in manifest["files"]}
        for r in checksums(spark, [f"{path.rstrip('/')}/{p}" for p in want]).collect():
            if want["/".join(r.path.split("/")[-3:])] != r.sha256:
                raise ValueError(f"{r.path} is not as it was published")
    read = spark.read.option("header", True).option("sep", "\t").option("quote", "").option("nullValue", "\u0000")
    return {name: read.csv(f"{path.rstrip('/')}/{manifest['export']}/{name}") for name in manifest["tables"]}
