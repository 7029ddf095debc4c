"""Token files: the ids of documents one after another, with Elias-Fano coded document boundaries.

A data set is a folder of shards; shard k holds the documents of the k-th range of identifiers, in ascending order. A
shard is: the ids of its documents, WIDTH bytes each (2 if the vocabulary fits, else 4), little-endian; the identifiers
(deflated differences); the Elias-Fano coded ends of its documents, counted in ids; and a footer with the lengths of
these parts, the width and a magic number. The manifest has a row for each shard, and its running sum of ids places a
shard in the whole array.

Null texts are empty documents of the end id alone. Rows with the same identifier stand together, ordered by a hash of their text;
missing identifiers come first and are read back as missing. An empty table has no shards.
Memory: a task holds a few batches of texts, and a few bytes for each document of its shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, shuffle_width, slices
from .eliasfano import EliasFano
from .files import new_file, new_folder, opened
from .tokens import encoder

_FOOT = "<QQQB7s"  # bytes of ids, identifiers and boundaries, width, magic
_MAGIC = b"FLTOK01"
#: Text bytes that are encoded at a time, and pieces that a worker remembers: words of this kind of vocabulary are many.
ENCODE_BYTES, PIECES = 6 << 20, 800_000
#: Ids that are read at a time; a longer document is read whole.
BLOCK = 4 << 20
#: Stands for a missing identifier in a shard.
NO_ID = -(1 << 63)
MANIFEST = "shard int, path string, n_docs long, n_ids long"


def write_token_files(docs: DataFrame, vocabulary: str, end: int = 2, key: str = "doc_id", text: str = "text", id_bytes: int = 2) -> DataFrame:
    """Encodes documents and writes their shards; returns the manifest. id_bytes: 2 or 4, what every id must fit."""
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    kind = np.dtype({2: "<u2", 4: "<u4"}[id_bytes])
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tie = F.xxhash64("text")  # splitters are sampled from the keys, so texts must not be among them
    rows = rows.repartitionByRange(shuffle_width(spark), "doc_id", tie).sortWithinPartitions("doc_id", tie, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(vocabulary, PIECES)
        where = path = out = None
        numbers, sizes = [], []
        for batch in slices(batches, "text", ENCODE_BYTES):
            if out is None:
                path = new_file(folder, ".tok")
                where, inner = opened(path)
                out = where.open_output_stream(inner)
            ids, offsets = codes.encode(batch.column("text"), end)
            if id_bytes == 2 and len(ids) and int(ids.max()) >> 16:
                raise ValueError("an id needs more than 2 bytes")
            out.write(np.ascontiguousarray(ids.astype(kind)).data)
            numbers.append(pc.fill_null(batch.column("doc_id"), NO_ID).to_numpy().astype("<i8"))
            sizes.append(np.diff(offsets))
        if out is None:
            return
        ids, ends = np.concatenate(numbers), np.cumsum(np.concatenate(sizes))
        named, bounds = zlib.compress(np.diff(ids, prepend=np.int64(0)).tobytes(), 1), EliasFano.of(ends).to_bytes()
        out.write(named)
        out.write(bounds)
        out.write(struct.pack(_FOOT, int(ends[-1]) * id_bytes, len(named), len(bounds), id_bytes, _MAGIC))
        out.close()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [path], "n_docs": [len(ids)], "n_ids": [int(ends[-1])]})

    return saved(rows.mapInArrow(run, MANIFEST), "token-manifest")


class Shard:
    """A shard opened for reading."""

    def __init__(self, path: str):
        where, inner = opened(path)
        self.file = where.open_input_file(inner)
        size = self.file.size()
        ids, named, bounds, self.width, magic = struct.unpack(_FOOT, self.file.read_at(struct.calcsize(_FOOT), size - struct.calcsize(_FOOT)))
        if magic != _MAGIC:
            raise ValueError(f"not a token file: {path}")
        self.kind = np.dtype({2: "<u2", 4: "<u4"}[self.width])
        self.doc_ids = np.cumsum(np.frombuffer(zlib.decompress(self.file.read_at(named, ids)), "<i8"))
        self.ends = EliasFano.from_bytes(self.file.read_at(bounds, ids + named))

    def __len__(self) -> int:
        return len(self.ends)

    def span(self, k: int) -> tuple[int, int]:
        """Where document k begins and ends in the shard's ids."""
        return self.ends[k - 1] if k else 0, self.ends[k]

    def ids(self, start: int, stop: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((stop - start) * self.width, start * self.width), self.kind).astype("<u4")

    def document(self, k: int) -> np.ndarray:
        """The ids of document k, its end id included."""
        return self.ids(*self.span(k))


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with the number of ids before each shard. It has a row for each task that wrote, not for each document."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shards themselves."""
    spark: SparkSession = manifest.sparkSession
    shards = placed(manifest).select("path", "base").repartition(shuffle_width(spark))  # dealt round: shards are alike

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                yield from _documents(Shard(path), base)

    return shards.mapInArrow(run, READ)


def _documents(shard: Shard, base: int) -> Iterator[pa.RecordBatch]:
    ends = shard.ends.all()
    starts = np.concatenate([[0], ends[:-1]])
    at = 0
    while at < len(ends):
        first = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, first + BLOCK, "right")))
        data = shard.ids(first, int(ends[to - 1]))
        view = memoryview(data).cast("B")
        bounds = ((ends[at:to] - first) * 4).tolist()
        crcs = [zlib.crc32(view[a:b]) for a, b in zip([0, *bounds[:-1]], bounds, strict=True)]
        own = shard.doc_ids[at:to]
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(own, mask=own == NO_ID), "start": base + starts[at:to], "n_tokens": ends[at:to] - starts[at:to], "ids_crc32": pa.array(crcs, pa.int64())})
        at = to
