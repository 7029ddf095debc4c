"""Token counts of whole texts by a two-tier lookup, in the tasks that read the texts.

1. The first tier is a broadcast hash table: the token counts of the most frequent pre-tokens, at most FREQUENT of at
   most LONGEST bytes each, which bounds it to about 5 MB. They are counted in a sample: the first SAMPLE_BYTES of text
   of a few tasks. The sample decides what is looked up fast and nothing else.
2. Pre-tokens that are not in it go to a cache of the Python worker; those that it lacks too are encoded by the library
   and remembered. No pre-token of the corpus is shuffled: a row goes in, its count comes out.

A pre-token here is what lies between two spaces (any ASCII white space, if the vocabulary drops white space), as no token
of these vocabularies reaches across it. Texts where that does not hold (spaces next to other white space or at the ends,
strings of added tokens) are encoded whole. A vocabulary is a .json file of ``tokenizers`` or a .model file of
``sentencepiece``; special strings inside texts are handled as the library does by default.

Null and empty texts have 0 tokens. Very long texts are counted whole. Repeated rows and rows without an identifier give a
row each; an empty table gives none. Other columns of the table, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokenmodels import PieceEncoder

#: Entries of the first tier at most, and bytes of one.
FREQUENT, LONGEST = 65_536, 64
#: Text bytes that a sampled task reads.
SAMPLE_BYTES = 4 << 20
#: Pre-tokens that a worker's cache remembers.
PIECES = 400_000
_COUNTED = "doc_id long, n_bytes long, n_tokens long"


class Counter:
    """Counts the tokens of Arrow arrays of texts."""

    def __init__(self, vocabulary: str, most: int = PIECES):
        self.pieces = PieceEncoder(vocabulary, most)
        self.missed = 0

    def sizes(self, found: pa.Array, table: tuple[pa.Array, np.ndarray] | None) -> np.ndarray:
        """Tokens of each of some distinct pre-tokens."""
        if table is None:
            return self.pieces.sizes_of(found.to_pylist())
        at = pc.index_in(found, value_set=table[0])
        known = at.is_valid().to_numpy(zero_copy_only=False)
        out = np.empty(len(found), np.int64)
        out[known] = table[1][at.drop_null().to_numpy()]
        if not known.all():
            lacking = found.filter(pa.array(~known)).to_pylist()
            self.missed += len(lacking)
            out[~known] = self.pieces.sizes_of(lacking)
        return out

    def counts(self, texts: pa.Array, table: tuple[pa.Array, np.ndarray] | None) -> np.ndarray:
        """Tokens of each text; texts has no nulls."""
        whole = self.pieces.inseparable(texts)
        out = np.zeros(len(texts), np.int64)
        if whole.any():
            out[whole] = [len(x) for x in self.pieces.whole_ids(texts.filter(pa.array(whole)).to_pylist())]
        if not whole.all():
            coded, offsets, opening = self.pieces.split(texts.filter(pa.array(~whole)))
            own = self.sizes(coded.dictionary, table)[coded.indices.to_numpy()]
            if opening is not None:
                own[offsets[:-1]] = self.pieces.opening_sizes(opening)
            out[~whole] = np.diff(np.concatenate([[0], np.cumsum(own)])[offsets])
        return out


_COUNTERS: dict[str, Counter] = {}


def counter(vocabulary: str) -> Counter:
    """The counter of this Python worker, kept between its tasks."""
    if vocabulary not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[vocabulary] = Counter(vocabulary)
    return _COUNTERS[vocabulary]


def _sampled(task: int) -> bool:
    """Task numbers of at most four binary digits before zeros: all below 16, then eight for each doubling."""
    return task < 16 or not task & ((1 << (task.bit_length() - 4)) - 1)


def frequent_lengths(docs: DataFrame, vocabulary: str, text: str = "text", entries: int = FREQUENT) -> tuple[pa.Array, np.ndarray]:
    """The first tier: frequent pre-tokens and how many tokens each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _sampled(TaskContext.get().partitionId()):
            return
        count, read = counter(vocabulary), 0
        for batch in slices(batches, "text"):
            read += batch.nbytes
            texts = batch.column("text")
            texts = texts.filter(pa.array(~count.pieces.inseparable(texts)))
            if len(texts):
                coded, _, _ = count.pieces.split(texts)
                found, often = coded.dictionary, np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                short = pc.less_equal(pc.binary_length(found), LONGEST).to_numpy(zero_copy_only=False)
                found = found.filter(pa.array(short))
                yield pa.RecordBatch.from_pydict({"piece": found.cast(pa.string()), "n": often[short], "tokens": count.sizes(found, None)})
            if read >= SAMPLE_BYTES:
                return

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "piece string, n long, tokens long").groupBy("piece").agg(F.sum("n").alias("n"), F.min("tokens").alias("tokens"))
    top = found.orderBy(F.desc("n"), "piece").limit(entries).select("piece", "tokens").toArrow()
    return top.column("piece").combine_chunks().cast(pa.large_string()), top.column("tokens").to_numpy()


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, key: str = "doc_id", text: str = "text", entries: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every row."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, vocabulary, text, entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pc.binary_length(texts), "n_tokens": count.counts(texts, table.value)})

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, _COUNTED).withColumn("over_limit", F.col("n_tokens") > limit)
