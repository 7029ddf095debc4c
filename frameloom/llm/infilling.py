"""Fill-in-middle: texts cut in three at random units, and the parts put in the order that a model is to learn.

1. A text is cut into chunks of CHUNK bytes that overlap by one byte, so that a unit's first byte is told from it and the
   one before. Each chunk counts the units that begin in it; no chunk needs another for that.
2. Prefix sums of the counts say how many units a text has, which chunk owns the first byte of each of the two ranks
   where the text is to be cut, and its rank there. Only the chunks that own a cut are read again.

Units are code points, words (a run of what is not ASCII white space, and the white space after it) or lines. Null texts
are empty; an empty text has no units and stays plain. Very long texts are cut like others, chunk by chunk. Repeated rows
give equal rows, rows without an identifier are drawn as one whose identifier is an empty string; an empty table gives no
rows. Other columns of the table, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Bytes of a chunk, and of the chunks that are counted at a time.
CHUNK, TOGETHER = 1 << 14, 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True

#: Whether a unit begins with a byte, by the byte before and itself. A text's first byte always begins one.
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "character": lambda before, own: (own & 0xC0) != 0x80,
    "word": lambda before, own: _BLANK[before] & ~_BLANK[own],
    "line": lambda before, own: before == 10,
}


def _begins(data: np.ndarray, first: int, stop: int, heads: np.ndarray, unit: str) -> np.ndarray:
    """Which of the bytes from first to stop begin a unit; heads: first bytes of texts, in order."""
    own = data[first:stop]
    before = np.empty_like(own)
    before[:1], before[1:] = (data[first - 1] if first else 10), own[:-1]
    out = UNITS[unit](before, own)
    a, b = np.searchsorted(heads, [first, stop])
    out[heads[a:b] - first] = True
    return out


class Chunks:
    """The chunks of texts that lie one after another in data, and how many units begin in each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str = "character", size: int = CHUNK):
        self.data, self.offsets, self.unit = data, offsets, unit
        many = -(-np.diff(offsets) // size)
        owner = np.repeat(np.arange(len(many)), many)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        self.first = offsets[owner] + rank * size
        self.stop = np.minimum(self.first + size, offsets[owner + 1])
        self.heads = offsets[:-1][np.diff(offsets) > 0]
        counts = np.zeros(len(owner), np.int64)
        at = 0
        while at < len(owner):
            to = max(at + 1, int(np.searchsorted(self.stop, self.first[at] + TOGETHER, "right")))
            begins = _begins(data, self.first[at], self.stop[to - 1], self.heads, unit)
            counts[at:to] = np.add.reduceat(begins.astype(np.int64), self.first[at:to] - self.first[at])
            at = to
        self.before = np.concatenate([[0], np.cumsum(counts)])  # units ahead of each chunk, over all texts
        chunk_of = np.concatenate([[0], np.cumsum(many)])
        self.base = self.before[chunk_of]  # units ahead of each text
        self.units = np.diff(self.base)

    def places(self, rank: np.ndarray) -> np.ndarray:
        """The byte at which the rank-th unit of each text begins; rank = units is the text's end."""
        out = self.offsets[1:].copy()
        inner = np.flatnonzero(rank < self.units)
        want = self.base[inner] + rank[inner]
        owner = np.searchsorted(self.before, want, "right") - 1
        for text, chunk, k in zip(inner.tolist(), owner.tolist(), (want - self.before[owner]).tolist(), strict=True):
            if k == 0 and self.first[chunk] == self.offsets[text]:
                out[text] = self.offsets[text]
            else:
                begins = _begins(self.data, int(self.first[chunk]), int(self.stop[chunk]), self.heads, self.unit)
                out[text] = self.first[chunk] + np.flatnonzero(begins)[k]
        return out


_CUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, seed: str = "1", plain: int = 10, spm: int = 20, unit: str = "character", key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every row.

    The draws are the first four groups of eight hexadecimal digits of sha256(seed:key): two cut ranks, whether the text
    stays plain (plain percent, and texts that hold a mark), and whether the suffix goes first (spm percent of the rest).
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *draws)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            body = texts.buffers()[2]
            data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
            data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
            h1, h2, h3, h4 = (batch.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4))
            chunks = Chunks(data, offsets, unit)
            n = chunks.units
            low, high = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
            marked = np.zeros(len(texts), bool)
            for x in (PREFIX, SUFFIX, MIDDLE):
                marked |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
            as_is = (n == 0) | marked | (h3 % 100 >= 100 - plain)
            last = h4 % 100 < spm
            a, b = chunks.places(np.where(as_is, 0, low)), chunks.places(np.where(as_is, 0, high))
            view, out, chars = memoryview(data), [], np.zeros((len(texts), 2), np.int64)
            for k, (start, p, q, stop) in enumerate(zip(offsets[:-1].tolist(), a.tolist(), b.tolist(), offsets[1:].tolist(), strict=True)):
                if as_is[k]:
                    out.append(bytes(view[start:stop]))
                    continue
                prefix, middle, suffix = view[start:p], view[p:q], view[q:stop]
                parts = (marks[1], suffix, marks[0], prefix, marks[2], middle) if last[k] else (marks[0], prefix, marks[1], suffix, marks[2], middle)
                out.append(b"".join(parts))
                chars[k] = np.count_nonzero((data[start:p] & 0xC0) != 0x80), np.count_nonzero((data[p:q] & 0xC0) != 0x80)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"), "n": n, "form": np.where(as_is, "plain", np.where(last, "spm", "psm")).tolist(),
                    "prefix_chars": pa.array(chars[:, 0], mask=as_is), "middle_chars": pa.array(chars[:, 1], mask=as_is), "output": pa.array(out, pa.binary()).cast(pa.string()),
                }
            )

    return rows.mapInArrow(run, _CUT)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Texts that hold a mark are plain, so the first of each mark is the one put in."""
    size = len(PREFIX)
    behind = F.substr(output, F.lit(size + 1))
    first = lambda x, mark: F.substring_index(x, mark, 1)
    rest = lambda x, mark: F.substr(x, F.length(first(x, mark)) + size + 1)
    psm = F.concat(first(behind, SUFFIX), rest(rest(behind, SUFFIX), MIDDLE), first(rest(behind, SUFFIX), MIDDLE))
    spm = F.concat(first(rest(behind, PREFIX), MIDDLE), rest(rest(behind, PREFIX), MIDDLE), first(behind, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
