"""Alignment of two tokenizers' tokens of the same texts, and counts of the pairs of ids that it links.

1. Both tokenizers encode a text in the task that reads it; running sums of the tokens' lengths give the byte offset at
   which each ends, on either side.
2. Offsets at which a token of both sides ends are cuts; the tokens between two cuts are a group. Texts of a batch are
   lined up at once, as both sides spell the same bytes.
3. Links, all pairs of a token of one side and one of the other in a group, are given out with their text.
4. For every pair of ids the documents that hold it linked are counted by a shuffle, and the highest count of each id of
   side A. The counts go back to the links: broadcast while they are at most MOST_BROADCAST rows, joined by shuffle beyond.

Token bytes of side A and B must both give a space and the text; texts that are null, empty or not so have no tokens, and
zeros. Very long texts are aligned whole, in one row as they come. Repeated rows are documents of their own, so are rows
without an identifier; an empty table gives no rows. Other columns of the table, whatever their names, are not looked at.
Rows are numbered where they are read; a table whose rows a lost executor may compute in another order is to be saved first.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, slices
from .tokenmodels import PieceEncoder

#: Rows of pair counts that are broadcast at most (some 60 bytes each).
MOST_BROADCAST = 300_000
#: Groups that are spelled at a time, and links of a text, or of a batch, that a task gives out at a time.
SEGMENT, HELD = 1 << 13, 1 << 20
#: Text bytes that are encoded at a time, and pieces that an encoder remembers.
ENCODE_BYTES, PIECES = 1 << 20, 100_000


class SideEncoder:
    """ids of a space and a text under a vocabulary, and whether their bytes are those of the space and the text."""

    def __init__(self, vocabulary: str):
        self.pieces = PieceEncoder(vocabulary, PIECES, plain=True)
        spelled = self.pieces.token_bytes()
        self.lengths = np.array([len(x) for x in spelled], np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)

    def right(self, ids: np.ndarray, sizes: np.ndarray, texts: pa.Array) -> np.ndarray:
        """Which texts, each with a space before it, are what the bytes of their ids spell."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        many = self.lengths[ids]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        spelled = np.concatenate([[0], np.cumsum(many)])[bounds]
        same = np.diff(spelled) == np.diff(offsets) + 1
        # of texts of the right length, all bytes are laid out and compared at once
        kept = np.repeat(same, sizes)
        ids, many = ids[kept], many[kept]
        stops = np.cumsum(many)
        found = self.spelled[np.repeat(self.first[ids] - (stops - many), many) + np.arange(int(stops[-1]) if len(stops) else 0)]
        size = np.diff(offsets)[same] + 1
        opens = np.cumsum(size) - size
        want = np.empty(int(size.sum()), np.uint8)
        inner = np.ones(len(want), bool)
        inner[opens] = False
        want[opens] = 32
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        want[inner] = data[np.repeat(same, np.diff(offsets))]
        if len(opens):
            same[same] = np.add.reduceat((found != want).astype(np.int64), opens) == 0
        return same

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has, whether its bytes are right)."""
        whole = self.pieces.inseparable(texts)
        sizes = np.zeros(len(texts), np.int64)
        own: list[tuple[np.ndarray, np.ndarray]] = []
        if whole.any():
            given = texts.filter(pa.array(whole)).to_pylist()
            # sentencepiece puts the space before the text itself
            lists = self.pieces.whole_ids(given if self.pieces.model else [" " + x for x in given])
            sizes[whole] = [len(x) for x in lists]
            own.append((whole, np.array([k for x in lists for k in x], np.int64)))
        if not whole.all():
            coded, offsets, _ = self.pieces.split(texts.filter(pa.array(~whole)))
            slots = self.pieces.slots_of(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            codes = self.pieces.codes
            many = codes.sizes[slots].astype(np.int64)
            ends = np.cumsum(many)
            sizes[~whole] = np.diff(np.concatenate([[0], ends])[offsets])
            own.append((~whole, codes.pool[np.repeat(codes.starts[slots] - (ends - many), many) + np.arange(int(ends[-1]))].astype(np.int64)))
        ids = np.empty(int(sizes.sum()), np.int64)
        for mask, values in own:
            ids[np.repeat(mask, sizes)] = values
        return ids, sizes, self.right(ids, sizes, texts)


_SIDES: dict[str, SideEncoder] = {}


def _side(vocabulary: str) -> SideEncoder:
    if vocabulary not in _SIDES:
        if len(_SIDES) > 1:
            _SIDES.clear()
        _SIDES[vocabulary] = SideEncoder(vocabulary)
    return _SIDES[vocabulary]


@functools.cache
def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 to most, one row each, and how many there are."""
    shown = [str(k) for k in range(most + 1)]
    wide = len(shown[-1])
    return np.frombuffer("".join(x.ljust(wide) for x in shown).encode(), np.uint8).reshape(-1, wide), np.array([len(x) for x in shown], np.int64)


class _Lined:
    """Groups of a batch of texts, from the ids of both sides, their lengths in bytes, and how many of side A a text has."""

    def __init__(self, ids: tuple[np.ndarray, np.ndarray], lengths: tuple[np.ndarray, np.ndarray], many: np.ndarray):
        self.ids = ids
        ends = [np.cumsum(x[k]) for x, k in zip(lengths, ids, strict=True)]
        met = np.zeros((2, max((int(x[-1]) for x in ends if len(x)), default=0) + 1), bool)
        for row, x in zip(met, ends, strict=True):
            row[x] = True
        cuts = np.flatnonzero(met[0] & met[1])
        self.stops = [np.searchsorted(x, cuts, "right") for x in ends]
        self.many = [np.diff(x, prepend=0) for x in self.stops]
        self.starts = [x - n for x, n in zip(self.stops, self.many, strict=True)]
        #: Groups, and links of groups, before each text and group, and of all.
        self.groups = np.concatenate([[0], np.searchsorted(cuts, np.concatenate([[0], ends[0]])[np.cumsum(many)], "right")])
        self.links = np.concatenate([[0], np.cumsum(self.many[0] * self.many[1])])

    def pairs(self, first: int, stop: int) -> np.ndarray:
        """The links from first to stop, by group, token of side B, token of side A: each a * 2^32 + b."""
        at = np.arange(first, stop)
        g = np.searchsorted(self.links, at, "right") - 1
        b, a = np.divmod(at - self.links[g], self.many[0][g])
        return (self.ids[0][self.starts[0][g] + a] << 32) | self.ids[1][self.starts[1][g] + b]

    def spelled(self, segment: int) -> tuple[bytes, np.ndarray]:
        """All groups as ;a1,a2|b1;a3|b2,b3 and where each begins, and the end."""
        out, sizes = [], [np.zeros(1, np.int64)]
        most = max((int(x.max()) for x in self.ids if len(x)), default=0)
        digits, wide = _digits(1 << most.bit_length())
        for low in range(0, len(self.stops[0]), segment):
            own = slice(low, low + segment)
            first, stops, many = ([x[own] for x in y] for y in (self.starts, self.stops, self.many))
            a0, b0 = int(first[0][0]), int(first[1][0])
            values = np.empty(int(stops[0][-1]) - a0 + int(stops[1][-1]) - b0, np.int64)
            signs = np.full(len(values), ord(","), np.uint8)
            # a group's tokens of side A stand behind all of side B before it, its tokens of side B behind its own of side A
            places = first[0] - a0 + first[1] - b0, stops[0] - a0 + first[1] - b0
            for ids, at, begin, n, sign in zip(self.ids, places, first, many, b";|", strict=True):
                took = np.arange(int(begin[0]), int(begin[-1] + n[-1]))
                values[np.repeat(at - begin, n) + took] = ids[took]
                signs[at] = sign
            shown = np.column_stack([signs, digits[values]])
            size = wide[values] + 1
            out.append(shown[np.arange(shown.shape[1]) < size[:, None]].tobytes())
            sizes.append(np.add.reduceat(size, places[0]))
        return b"".join(out), np.cumsum(np.concatenate(sizes))


_ALIGNED = "row long, last boolean, chunk int, doc_id long, n_a long, n_b long, n_groups long, groups string, links array<long>"


def aligned(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text", shown: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups (a1,a2|b1;a3|b2) and links (pairs of ids, each a * 2^32 + b) of every text, saved.

    shown: "sha256" gives the digest of groups in their place. A text of more than HELD links has further rows, numbered
    by chunk, which hold links alone; last marks the row that has the rest.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    held, segment = HELD, SEGMENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _side(a), _side(b)
        for batch in slices(batches, "text", ENCODE_BYTES):
            texts = batch.column("text")
            (ids1, n1, ok1), (ids2, n2, ok2) = one.encode(texts), two.encode(texts)
            good = ok1 & ok2 & (np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]) > 0)
            ids = ids1[np.repeat(good, n1)], ids2[np.repeat(good, n2)]
            n1, n2 = np.where(good, n1, 0), np.where(good, n2, 0)
            lined = _Lined(ids, (one.lengths, two.lengths), n1)
            body, at = lined.spelled(segment)
            signs = [body[s + 1 : e] for s, e in zip(at[lined.groups[:-1]].tolist(), at[lined.groups[1:]].tolist(), strict=True)]
            told = [(hashlib.sha256(x).hexdigest() if shown == "sha256" else x.decode()) if x else "" for x in signs]
            # rows of at most `held` links; a text's last row has what is left, perhaps none
            before = lined.links[lined.groups]
            chunks = np.maximum(0, np.diff(before) - 1) // held
            owner = np.repeat(np.arange(len(texts)), chunks + 1)
            chunk = np.arange(len(owner)) - np.repeat(np.cumsum(chunks + 1) - chunks - 1, chunks + 1)
            last = chunk == chunks[owner]
            bounds = np.append(before[owner] + chunk * held, before[-1])
            low = 0
            while low < len(owner):
                high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + held, "right")) - 1)
                mine, whole = owner[low:high], last[low:high]
                links = pa.ListArray.from_arrays(pa.array((bounds[low : high + 1] - bounds[low]).astype(np.int32)), pa.array(lined.pairs(int(bounds[low]), int(bounds[high]))))
                of = lambda x: pa.array(x[mine], pa.int64(), mask=~whole)  # noqa: B023, E731
                names = batch.column("doc_id").take(pa.array(mine))
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": batch.column("row").take(pa.array(mine)), "last": pa.array(whole), "chunk": pa.array(chunk[low:high].astype(np.int32)), "doc_id": pc.if_else(pa.array(whole), names, None), "n_a": of(n1), "n_b": of(n2),
                        "n_groups": of(np.diff(lined.groups)), "groups": pa.array([told[k] if w else None for k, w in zip(mine.tolist(), whole.tolist(), strict=True)], pa.string()), "links": links,
                    }
                )
                low = high

    return saved(rows.mapInArrow(run, _ALIGNED), "aligned")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked) and best (whether n is the highest of its id of side A), saved."""
    own = rows.select("row", (F.col("last") & (F.col("chunk") == 0)).alias("_whole"), F.explode(F.array_distinct("links")).alias("pair"))
    divided = own.where("not _whole").select("row", "pair").distinct()  # a text in several rows counts once
    counted = own.where("_whole").select("pair").unionByName(divided.select("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counted = saved(counted.select("pair", F.shiftright("pair", 32).alias("_a"), "n"), "pairs")
    highest = counted.groupBy("_a").agg(F.max("n").alias("_most"))
    return saved(counted.join(highest, "_a").select("pair", "n", (F.col("n") == F.col("_most")).cast("int").alias("best")), "pair-counts")


def alignment(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text", shown: str = "text") -> DataFrame:
    """The rows of aligned with n_links, and over their links n_best (its pair's count is its id's highest) and count_sum."""
    rows = aligned(docs, a, b, key, text, shown)
    counts = pair_counts(rows)
    known = F.broadcast(counts) if counts.count() <= MOST_BROADCAST else counts
    found = rows.select("row", F.explode("links").alias("pair")).join(known, "pair")
    sums = found.groupBy("row").agg(F.count("*").alias("n_links"), F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    return rows.where("last").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), "groups")
