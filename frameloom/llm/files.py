"""Binary files that tasks write to and read from the shared folder, whatever store it lies in.

A task writes under a name that no other attempt uses and returns it in a row; only files named in the rows that Spark
committed count, so a lost executor or a second attempt leaves at most a stray file behind.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession

from .common import scratch_path


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, as a URI."""
    path = scratch_path(spark, name)
    where, inner = opened(path)
    where.create_dir(inner, recursive=True)
    return path


def new_file(folder: str, suffix: str) -> str:
    """A name for a file of this attempt of this task."""
    task = TaskContext.get()
    return f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}{suffix}"
