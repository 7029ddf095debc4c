"""Packing documents into sequences of a fixed number of tokens: Martello-Toth dominance reduction, then best fit.

Only the lengths matter for a plan, and there are at most `capacity` different ones. So the documents' lengths are
counted on the cluster, the plan is made from those counts (a table of at most `capacity` rows), and the documents of a
length take that length's places in the plan in turn.

The plan: a set of pieces that fits a sequence dominates another if the other's pieces can be dealt into as many groups
as the set has pieces, each no longer than its piece. If one set with a piece dominates all other sets with it, some best
packing holds that set, and it is fixed for good; the rest shrinks by it. Pieces without such a set are passed over.
What is left when no set can be fixed any more is packed best fit, longest first.

A document longer than `capacity` is cut from its end into full pieces; the first piece takes what is left over, so that
every document has one piece at most that must share a sequence.

Null texts are empty documents of the end id alone. Repeated rows are documents of their own. Missing identifiers stay.
An empty table gives no pieces, and very long texts as many as they need. Documents of equal length are alike to the
plan; which of them takes which place follows from the order in which tasks read them. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, slices
from .tokens import ENCODE_BYTES, encoder

Groups = list[tuple[tuple[int, ...], int]]


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> tuple[Groups, np.ndarray]:
    """(sets of lengths fixed for good, how often each; counts of what is left). counts[l]: pieces of length l.

    Every length is tried, longest first, and again as long as something was fixed; a piece without a dominating set is
    passed over. Taking pieces away only takes away rivals of a set, so a set is fixed as often as its pieces last.
    """
    counts = counts.copy()
    fixed: Groups = []
    again = True
    while again:
        again = False
        for w in np.flatnonzero(counts)[::-1].tolist():
            while counts[w] and (beside := _dominating(np.flatnonzero(counts).tolist(), counts, w, capacity - w)) is not None:
                own = (w, *beside)
                times = min(int(counts[x]) // own.count(x) for x in own)
                fixed.append((own, times))
                for x in own:
                    counts[x] -= times
                again = True
    return fixed, counts


def _dominating(present: list[int], counts: np.ndarray, w: int, room: int) -> tuple[int, ...] | None:
    """What stands beside a piece of length w in a set of up to three that dominates all its sets; None if none is known.

    Let a be the longest other piece that fits the room. {w} dominates if nothing fits; {w, a} if a fills the room, if
    no two pieces fit it together, or if three don't and no two that do are longer than a. If three don't fit and b is the longest
    that fits beside a, {w, a, b} dominates unless two pieces, both longer than b, fit together and are longer than a.
    """
    least: list[int] = []
    for x in present:
        least += [x] * min(3 - len(least), int(counts[x]) - (x == w))
        if len(least) == 3:
            break
    if not least or least[0] > room:
        return ()
    a = _longest(present, counts, room, (w,))
    if a == room or sum(least[:2]) > room or len(least) == 1:
        return (a,)
    if len(least) == 3 and sum(least) <= room:
        return None
    if _best_pair(present, counts, room, w, 0) <= a:
        return (a,)
    b = _longest(present, counts, room - a, (w, a))
    return (a, b) if b and _best_pair(present, counts, room, w, b) <= a else None


def _longest(present: list[int], counts: np.ndarray, room: int, aside: tuple[int, ...]) -> int:
    """The longest piece that fits a room, some pieces set aside; 0 if there is none."""
    for at in range(bisect_left(present, room + 1) - 1, -1, -1):
        if counts[present[at]] > aside.count(present[at]):
            return present[at]
    return 0


def _best_pair(present: list[int], counts: np.ndarray, room: int, w: int, above: int) -> int:
    """The largest sum up to room of two pieces longer than above, one w set aside; 0 if no two fit."""
    best, lo, hi = 0, bisect_left(present, above + 1), bisect_left(present, room + 1) - 1
    have = lambda x: int(counts[x]) - (x == w)
    while lo <= hi:
        a, b = present[lo], present[hi]
        if a + b > room or not have(b):
            hi -= 1
        elif not have(a) or (lo == hi and have(a) < 2):
            lo += 1
        else:
            best = max(best, a + b)
            lo += 1
    return best


def best_fit(counts: np.ndarray, capacity: int) -> Groups:
    """Sequences of what counts holds, longest piece first, each into the fullest sequence that takes it.

    Sequences with the same pieces are handled together, so the work follows the number of lengths, not of pieces.
    """
    open_: dict[int, list[list]] = {}  # by room: [pieces, how many]
    rooms: list[int] = []
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):  # a new sequence takes as many as fit, as best fit would place them one by one
                each = min(left, capacity // length)
                whole = left // each
                _put(open_, rooms, capacity - each * length, (length,) * each, whole)
                left -= whole * each
                continue
            room = rooms[at]
            own = open_[room]
            pieces, many = own[-1]
            each = min(left, room // length)
            take = min(many, left // each)
            if take == many:
                own.pop()
                if not own:
                    del open_[room]
                    rooms.pop(at)
            else:
                own[-1][1] -= take
            _put(open_, rooms, room - each * length, pieces + (length,) * each, take)
            left -= take * each
    return [(pieces, many) for own in open_.values() for pieces, many in own]


def _put(open_: dict[int, list[list]], rooms: list[int], room: int, pieces: tuple[int, ...], many: int) -> None:
    if room not in open_:
        open_[room] = []
        insort(rooms, room)
    open_[room].append([pieces, many])


def plan(counts: np.ndarray, capacity: int) -> Groups:
    """The sets of lengths that make up all sequences, and how often each."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


class Places:
    """Where the n-th piece of a length goes in a plan: arrays by length of (first number, sequence, offset)."""

    def __init__(self, groups: Groups):
        raw: dict[int, list[tuple[int, int, int]]] = {}
        used: dict[int, int] = {}
        first = 0
        for pieces, many in groups:
            offset = 0
            for x in pieces:
                raw.setdefault(x, []).append((used.get(x, 0), first, offset))
                used[x] = used.get(x, 0) + many
                offset += x
            first += many
        self.sequences = first
        self.by_length = {k: tuple(np.array(x, np.int64).T) for k, x in raw.items()}

    def of(self, length: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, firsts, offsets = self.by_length[length]
        at = np.searchsorted(starts, numbers, "right") - 1
        return firsts[at] + numbers - starts[at], offsets[at]


MEASURED = "doc_id long, n_tokens long, rest int, part int, place long, crcs array<long>"


def measured(docs: DataFrame, vocabulary: str, capacity: int, end: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's number of ids, the length of its first piece, its task, its number among the pieces of that
    length in the task, and the checksums of its pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, part = encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "text", ENCODE_BYTES):
            ids, offsets = codes.encode(batch.column("text"), end)
            view = memoryview(ids.astype("<u4")).cast("B")
            sizes = np.diff(offsets)
            rest = (sizes - 1) % capacity + 1
            crcs = []
            for a, n, r in zip(offsets[:-1].tolist(), sizes.tolist(), rest.tolist(), strict=True):
                cuts = [a, *range(a + r, a + n + 1, capacity)]
                crcs.append([zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(cuts, cuts[1:], strict=False)])
            order = np.argsort(rest, kind="stable")
            own = rest[order]
            fresh = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            runs = np.diff(np.r_[fresh, len(own)])
            place = np.empty(len(rest), np.int64)
            place[order] = np.arange(len(own)) - np.repeat(fresh, runs) + seen[own]
            seen[own[fresh]] += runs
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"), "n_tokens": sizes.astype(np.int64), "rest": rest.astype(np.int32),
                    "part": np.full(len(rest), part, np.int32), "place": place, "crcs": pa.array(crcs, pa.list_(pa.int64())),
                }
            )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, MEASURED)


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def packed(docs: DataFrame, vocabulary: str, capacity: int = 1024, end: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Shared sequences are numbered from 0 on; those of one full piece have negative numbers.
    """
    found = saved(measured(docs, vocabulary, capacity, end, key, text), "measured")
    by_part = found.where(F.col("rest") < capacity).groupBy("part", "rest").agg(F.count("*").alias("n"))
    by_part = saved(by_part, "lengths")  # a row for each task and length: not more than its documents
    counts = np.zeros(capacity + 1, np.int64)
    for x in by_part.groupBy("rest").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        counts[x.rest] = x.n
    places = Places(plan(counts, capacity))

    before = F.sum("n").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = by_part.select("part", "rest", F.coalesce(before, F.lit(0)).alias("base"))
    numbered = found.join(bases, ["part", "rest"], "left").withColumn("number", F.col("place") + F.coalesce("base", F.lit(0))).drop("base", "place")
    # the plan goes to every executor: a few entries for each length, so bounded by the capacity and not by the input
    shared = docs.sparkSession.sparkContext.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, full = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, rest, numbers = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("n_tokens", "rest", "number"))
            sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for length in np.unique(rest).tolist():
                if length < capacity:
                    these = np.flatnonzero(rest == length)
                    sequence[these], offset[these] = own.of(length, numbers[these])
            pieces = (sizes - rest) // capacity + 1
            total = int(pieces.sum())
            first = np.cumsum(pieces) - pieces
            piece = np.arange(total) - np.repeat(first, pieces)
            length = np.full(total, capacity, np.int64)
            length[first] = rest
            ids, offsets = np.zeros(total, np.int64), np.zeros(total, np.int64)
            lone = length == capacity
            ids[first], offsets[first] = sequence, offset
            ids[lone] = -1 - (full + np.arange(int(lone.sum())))
            full += int(lone.sum())
            start = np.where(piece == 0, 0, np.repeat(rest, pieces) + (piece - 1) * capacity)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(sizes)), pieces))), "piece": piece.astype(np.int32),
                    "start": start.astype(np.int64), "length": length, "ids_crc32": batch.column("crcs").flatten(), "sequence_id": ids, "offset": offsets,
                }
            )

    return numbered.mapInArrow(run, PACKED)

