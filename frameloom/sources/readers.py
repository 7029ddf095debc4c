"""Readers: interval tables, frames, JSON documents, candidate lists, run records, checksums, synthetic frames."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Mapping, Sequence
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import workers_import_this
from .stacks import frame_stacks

FRAMES = "source string, frame int, height int, width int, pixels array<float>"


def intervals(spark: SparkSession, path: str) -> DataFrame:
    """Ground-truth intervals of a CSV file with columns X, Y, Start Frame, End Frame and ID in any order; names are trimmed."""
    rows = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    rows = rows.toDF(*[c.strip().lower().replace(" ", "_") for c in rows.columns])
    number = lambda c, kind: F.col(c).try_cast("double").cast(kind).alias(c)
    return rows.select(number("id", "int"), number("start_frame", "int"), number("end_frame", "int"), number("x", "double"), number("y", "double"))


def ground_truth(intervals: DataFrame) -> DataFrame:
    """(frame, id, x, y): intervals spread over their frames, the last included. Intervals that end before they start have none."""
    kept = intervals.where("end_frame >= start_frame")
    return kept.select(F.explode(F.sequence("start_frame", "end_frame")).alias("frame"), "id", "x", "y")


def npy_frames(spark: SparkSession, path: str, chunk: int = 64) -> DataFrame:
    """Frames of .npy stacks (frames first, three dimensions), a row each; ranges of chunk frames are read by different tasks."""
    return frame_stacks(spark, path, chunk)


def chunked(frames: DataFrame, size: int) -> DataFrame:
    """frames with chunk, the number of their half-open range of `size` frames; the last one may be short."""
    if size <= 0:
        raise ValueError("a chunk has at least one frame")
    return frames.withColumn("chunk", F.floor(F.col("frame") / size).cast("int"))


def long_frames(rows: DataFrame, height: int, width: int) -> DataFrame:
    """Frames of a long table (frame, y, x, v); places without a value are 0, of several values of a place the largest counts.

    Rows are laid into images in one pass over each frame's rows, at most height * width places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = height * width
        for batch in batches:
            n = batch.num_rows
            cells = batch.column("cells")
            inner = cells.flatten()
            owner = np.repeat(np.arange(n), cells.value_lengths().to_numpy())
            images = np.zeros(n * size, np.float32)
            k, v = inner.field("k").to_numpy(), inner.field("v").fill_null(0).to_numpy()
            order = np.argsort(v, kind="stable")
            images[(owner * size + k)[order]] = v[order]
            listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(images))
            yield pa.RecordBatch.from_arrays([batch.column("frame"), listed], ["frame", "pixels"])

    inside = (F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width)
    cell = F.struct((F.col("y") * width + F.col("x")).cast("int").alias("k"), F.col("v").cast("float").alias("v"))
    cells = rows.where("frame is not null").groupBy(F.col("frame").cast("int").alias("frame")).agg(F.collect_list(F.when(inside, cell)).alias("cells"))
    images = cells.mapInArrow(run, "frame int, pixels array<float>")
    return images.select(F.lit("").alias("source"), "frame", F.lit(height).alias("height"), F.lit(width).alias("width"), "pixels")


def documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON documents, one to a file, with their path; fields that the schema lacks are left out."""
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    rows = (reader.schema(schema) if schema else reader).json(path)
    return rows.withColumn("path", F.col("_metadata.file_path"))


def manifest(path: str, project: str | None = None) -> dict:
    """A data set manifest with its relative paths made whole: beside the manifest, else in the project's folder."""
    where = PurePosixPath(path)
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    base = PurePosixPath(project) if data.get("paths_from") == "project" and project else where.parent
    data["paths"] = {k: v if PurePosixPath(v).is_absolute() or "://" in v else str(base / v) for k, v in data.get("paths", {}).items()}
    return data


def candidates_tsv(spark: SparkSession, path: str, variant: str | None = None, preset: str | None = None) -> DataFrame:
    """Rows of tab-separated candidate lists, of one variant and preset if given; both filters reach the scan."""
    rows = spark.read.option("header", True).option("sep", "\t").option("inferSchema", True).csv(path)
    for name, value in (("variant", variant), ("preset", preset)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def checksums(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, bytes, sha256) of files."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def input_paths(paths: Mapping[str, str]) -> dict[str, str]:
    """The entries of a manifest's paths that name inputs: none whose key speaks of an output, a result or an export."""
    return {k: v for k, v in paths.items() if not any(x in k.lower() for x in ("output", "result", "export", "app", "cache"))}


# Preference among the arrays of a deconvolution file.
SPIKE_ARRAYS = ("spikes", "spks", "deconvolved", "oasis", "S", "C")


def archive_shapes(spark: SparkSession, path: str) -> DataFrame:
    """(path, array, shape, chosen) of .npz archives: the first array of a preferred name, else the first, is chosen. Only headers are read."""
    files = workers_import_this(spark).read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zipfile

        for files in batches:
            for name, content in zip(files["path"], files["content"], strict=True):
                rows = []
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        with archive.open(member) as f:
                            version = np.lib.format.read_magic(f)
                            shape = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)[0]
                        rows.append((member.removesuffix(".npy"), ",".join(map(str, shape))))
                names = [x for x, _ in rows]
                chosen = next((x for x in SPIKE_ARRAYS if x in names), names[0] if names else None)
                yield pd.DataFrame({"path": name, "array": names, "shape": [x for _, x in rows], "chosen": [x == chosen for x in names]})

    return files.mapInPandas(run, "path string, array string, shape string, chosen boolean")


def synthetic_frames(spark: SparkSession, frames: int, height: int, width: int, events: Sequence[tuple[int, int, int, int, float]], noise: float = 0.03, seed: int = 7) -> DataFrame:
    """Noise with blobs: events are (x, y, first frame, last frame, height). Each frame's noise depends on its number alone."""
    workers_import_this(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yy, xx = np.mgrid[:height, :width]
        for rows in batches:
            out = []
            for k in rows["id"].tolist():
                image = np.random.Generator(np.random.PCG64([seed, k])).normal(0, noise, (height, width))
                for x, y, first, last, top in events:
                    if first <= k <= last:
                        image += top * np.exp(-((xx - x) ** 2 + (yy - y) ** 2) / 8.0)
                out.append(image.astype(np.float32).ravel())
            yield pd.DataFrame({"source": "synthetic", "frame": rows["id"].astype(np.int32), "height": height, "width": width, "pixels": out})

    return spark.range(frames).mapInPandas(run, FRAMES)
