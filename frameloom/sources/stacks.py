"""Frame stacks in .npy files as a data source whose partitions are ranges of frames, read by byte offset.

A stack's header says where each frame lies, so a file of any size is read by many tasks, none of which holds more than
`chunk` frames. Conditions on frame prune ranges before anything of them is read.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..session import workers_import_this

FRAMES = "source string, frame int, height int, width int, pixels array<float>"


def _opened(path: str) -> pa.NativeFile:
    where, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return where.open_input_file(inner)


@dataclass
class Stack:
    """What a .npy header says."""

    path: str
    shape: tuple[int, ...]
    kind: str
    by_column: bool
    begins: int

    @classmethod
    def of(cls, path: str) -> Stack:
        with _opened(path) as f:
            version = np.lib.format.read_magic(f)
            shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            if len(shape) < 3:
                raise ValueError(f"{path}: {len(shape)} dimensions, 3 are needed")
            if kind.hasobject:
                raise ValueError(f"{path}: holds objects")
            return cls(path, shape, kind.str, by_column, f.tell())

    def frames(self, first: int, stop: int) -> np.ndarray:
        """Frames first to stop, a row each."""
        kind = np.dtype(self.kind)
        pixels = int(np.prod(self.shape[1:]))
        with _opened(self.path) as f:
            if not self.by_column:
                raw = f.read_at((stop - first) * pixels * kind.itemsize, self.begins + first * pixels * kind.itemsize)
                return np.frombuffer(raw, kind).reshape(stop - first, pixels)
            # frames lie next to each other pixel by pixel: the range is gathered from each pixel's series
            out = np.empty((stop - first, pixels), kind)
            for k, place in enumerate(np.ndindex(*self.shape[1:])):
                at = int(np.ravel_multi_index(place[::-1], self.shape[:0:-1]))
                out[:, k] = np.frombuffer(f.read_at((stop - first) * kind.itemsize, self.begins + (at * self.shape[0] + first) * kind.itemsize), kind)
            return out


@dataclass
class FrameRange(InputPartition):
    """Frames first to stop of a stack."""

    stack: Stack
    first: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, paths: Sequence[str], chunk: int):
        self.paths, self.chunk, self.low, self.high = paths, chunk, 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrows the range of frames; Spark applies all conditions to the rows as well."""
        for f in filters:
            if getattr(f, "attribute", None) != ("frame",):
                continue
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self._narrow(f.value + isinstance(f, GreaterThan), None)
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self._narrow(None, f.value + 1 - isinstance(f, LessThan))
            elif isinstance(f, EqualTo):
                self._narrow(f.value, f.value + 1)
            elif isinstance(f, In) and f.value:
                self._narrow(min(f.value), max(f.value) + 1)
        return filters

    def _narrow(self, low: int | None, high: int | None) -> None:
        self.low = self.low if low is None else max(self.low, low)
        self.high = high if self.high is None else self.high if high is None else min(self.high, high)

    def partitions(self) -> list[FrameRange]:
        out = []
        for path in self.paths:
            stack = Stack.of(path)
            stop = stack.shape[0] if self.high is None else min(self.high, stack.shape[0])
            # ranges begin at multiples of chunk, whatever the conditions
            starts = range(self.low // self.chunk * self.chunk, max(stop, 0), self.chunk)
            out += [FrameRange(stack, max(k, self.low), min(k + self.chunk, stop)) for k in starts if min(k + self.chunk, stop) > max(k, self.low)]
        return out or [FrameRange(Stack("", (0, 0, 0), "<f4", False, 0), 0, 0)]

    def read(self, part: FrameRange) -> Iterator[pa.RecordBatch]:
        if part.stop <= part.first:
            return
        images = part.stack.frames(part.first, part.stop).astype(np.float32)
        n, pixels = images.shape
        height, width = part.stack.shape[1:3]
        listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * pixels), pa.array(images.reshape(-1)))
        same = lambda x, kind: pa.array(np.full(n, x), kind)
        columns = [pa.array([part.stack.path] * n), pa.array(np.arange(part.first, part.stop), pa.int32()), same(height, pa.int32()), same(width, pa.int32()), listed]
        yield pa.RecordBatch.from_arrays(columns, ["source", "frame", "height", "width", "pixels"])


class StackSource(DataSource):
    """Format npy_stack; options: paths (a JSON list of files), chunk (frames of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "npy_stack"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(json.loads(self.options["paths"]), int(self.options.get("chunk", 64)))


def frame_stacks(spark: SparkSession, path: str, chunk: int = 64) -> DataFrame:
    """Frames of .npy stacks (frames first), a row each: a file, a folder of them or a pattern. An empty folder is an error.

    A range of chunk frames is one task's, so chunk frames have to fit its memory. Files are listed, and their headers
    read, before the query runs.
    """
    if chunk <= 0:
        raise ValueError("a chunk has at least one frame")
    files = workers_import_this(spark).read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    paths = sorted(r.path for r in files.select("path").collect())  # a name for each file
    if not paths:
        raise ValueError(f"no .npy file at {path}")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StackSource)
    return spark.read.format("npy_stack").option("paths", json.dumps(paths)).option("chunk", str(chunk)).load()
