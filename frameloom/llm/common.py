"""What the operators of this folder share: scratch tables in the shared folder, Arrow helpers, 64-bit mixing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that the numpy kernels take at a time; a larger Arrow batch is cut, a longer text stays whole.
KERNEL_BYTES = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only a local master may go without it (tests); a cluster has no machine-local stand-in.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/frameloom-{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    """How many partitions a shuffle makes in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Gives memory that is free but still held by the allocators back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = KERNEL_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a task's batches in pieces of about size bytes of text; null texts become empty.

    Trims the worker's memory when the task has read all.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.schema.get_field_index(text)
        filled = pc.fill_null(batch.column(k).cast(pa.large_string()), "")
        batch = batch.set_column(k, text, filled)
        ends = np.cumsum(pc.binary_length(filled).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, to - at)
            at = to
    trim()


def words_of(texts: pa.Array, lower: str = "ascii") -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(word codes, list offsets by text, distinct words): the runs of anything but ASCII white space, lower-cased."""
    texts = pc.ascii_lower(texts) if lower == "ascii" else pc.utf8_lower(texts) if lower == "utf8" else texts
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    if "" in words:  # leading or trailing white space leaves empty pieces
        keep = codes != words.index("")
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return codes, offsets, words


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose outputs look random (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
