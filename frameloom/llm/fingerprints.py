"""Document fingerprints: a Merkle tree over a text's paragraphs and sections.

Paragraphs are the lines of a text, sections the runs of lines between blank ones. A paragraph's leaves are runs of a few
words whose ends depend on the words alone (one word in four ends a run), so an edit changes the leaves around it and no
others, wherever it stands. A paragraph's node is the digest of its leaves, a section's node that of its paragraphs' nodes,
the root that of the sections' nodes: equal roots mean equal texts, and where roots differ, following the digests that
have no counterpart leads to the edited paragraphs. A fingerprint is the root and the smallest digests of the tree's
leaves; the share of leaves that two trees have in common is their likeness, estimated from the fingerprints alone.

Null texts count as empty; an empty text has a root and a likeness of 1 to another empty one. Rows with the same
identifier are ordered by a hash of their text, rows without one come last. Very long texts are read whole: of a word
longer than 64 characters each character counts as a word. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, saved, shuffle_width, slices

#: A word with the white space around it, a line end, or white space alone.
_TOKEN = re.compile(r"\n|[^\S\n]*\S+[^\S\n]*|[^\S\n]+")
#: One word in so many ends a leaf; a leaf has MOST_WORDS at most (repeated words may have no end among them).
ONE_IN, MOST_WORDS = 4, 32
#: Characters of a word from which on its characters stand for words (text without spaces, keys).
LONG_WORD = 64
#: How many of the smallest leaf digests a fingerprint holds.
SKETCH = 64
_LINE_END = np.uint64(xxhash.xxh3_64_intdigest("\n"))


def leaf_digests(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(digest of each leaf of a text, number of leaves up to the end of each line)."""
    words = _TOKEN.findall(text)
    if max(map(len, words), default=0) > LONG_WORD:
        words = list(chain.from_iterable(x if len(x) > LONG_WORD else (x,) for x in words))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    lines = h == _LINE_END
    ends = np.cumsum(~lines)[lines]  # words up to the end of each line but the last
    h = h[~lines]
    n = len(h)
    ends = np.append(ends, n)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    cuts = h % np.uint64(ONE_IN) == 0
    cuts[ends[ends > 0] - 1] = True
    first = np.flatnonzero(np.append(True, cuts[:-1]))
    place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    if place.max() >= MOST_WORDS:
        first = np.flatnonzero(place % MOST_WORDS == 0)
        place %= MOST_WORDS
    leaves = mix64(np.add.reduceat(mix64(h + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first))
    return leaves, np.searchsorted(first, ends)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Tree:
    """The Merkle tree of one text."""

    __slots__ = ("paragraphs", "print", "root", "sections", "sketch")

    def __init__(self, text: str):
        data = text.encode()
        leaves, ends = leaf_digests(text)
        raw = leaves.astype("<u8").tobytes()
        #: (digest, start in bytes) of each line, and per section the digest and the numbers of its lines.
        self.paragraphs: list[tuple[bytes, int]] = []
        self.sections: list[tuple[bytes, int, int]] = []
        at, first, done = 0, 0, 0
        for line, end in zip(data.split(b"\n"), (8 * ends).tolist(), strict=True):
            blank = not line.strip()
            self.paragraphs.append((_digest(raw[done:end]), at))
            done = end
            at += len(line) + 1
            if blank:
                self._close(first)
                first = len(self.paragraphs)
        self._close(first)
        self.root = _digest(b"".join(x[0] for x in self.sections)).hex()
        self.sketch = np.unique((leaves >> np.uint64(32)).astype(np.uint32))[:SKETCH]
        self.print = self.root + "." + self.sketch.astype(">u4").tobytes().hex()

    def _close(self, first: int) -> None:
        own = self.paragraphs[first:]
        if own:
            self.sections.append((_digest(b"".join(x[0] for x in own)), first, len(own)))


def likeness(a: str, b: str) -> float:
    """How like two fingerprints' texts are, 0 to 1: 1 for equal roots, else the estimated share of common leaves."""
    (root_a, _, leaves_a), (root_b, _, leaves_b) = a.partition("."), b.partition(".")
    if root_a == root_b:
        return 1.0
    left, right = (np.frombuffer(bytes.fromhex(x), ">u4") for x in (leaves_a, leaves_b))
    return _share(left, right)


def _share(left: np.ndarray, right: np.ndarray) -> float:
    if not len(left) or not len(right):
        return 0.0
    both = np.union1d(left, right)[:SKETCH]
    common = np.intersect1d(left, right, assume_unique=True)
    return float(np.isin(both, common, assume_unique=True).sum()) / len(both)


def first_difference(a: Tree, b: Tree) -> int | None:
    """Byte offset in a of the first paragraph that differs, found from the root down; None for equal trees."""
    if a.root == b.root:
        return None
    for k, (digest, first, count) in enumerate(a.sections):
        if k < len(b.sections) and b.sections[k][0] == digest and b.sections[k][1:] == (first, count):
            continue
        for j in range(first, first + count):
            if j >= len(b.paragraphs) or a.paragraphs[j][0] != b.paragraphs[j][0]:
                return a.paragraphs[j][1]
        return a.paragraphs[first + count][1] if first + count < len(a.paragraphs) else a.paragraphs[-1][1]
    return a.paragraphs[-1][1]


NODES = "doc_id long, level string, node int, start long, digest string"


def merkle_nodes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every node of every text's tree: level root, section or paragraph, its number, its byte offset and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                tree = Tree(t)
                rows.append((i, "root", 0, 0, tree.root))
                rows += [(i, "section", k, tree.paragraphs[x[1]][1], x[0].hex()) for k, x in enumerate(tree.sections)]
                rows += [(i, "paragraph", k, x[1], x[0].hex()) for k, x in enumerate(tree.paragraphs)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["doc_id", "level", "node", "start", "digest"]).cast(
                pa.schema([("doc_id", pa.int64()), ("level", pa.string()), ("node", pa.int32()), ("start", pa.int64()), ("digest", pa.string())])
            )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, NODES)


def changed_branches(before: DataFrame, after: DataFrame) -> DataFrame:
    """Nodes (as merkle_nodes gives them) of two versions of the same documents that have no counterpart in the other.

    Nodes are matched by digest within document and level, equal ones in order, so what was put in or taken out marks its
    own branches and not those after it. Columns: doc_id, level, digest, node and start before and after (null on one side).
    """
    on = ["doc_id", "level", "digest", "again"]
    again = F.row_number().over(Window.partitionBy("doc_id", "level", "digest").orderBy("node")).alias("again")

    def side(nodes: DataFrame, name: str) -> DataFrame:
        return nodes.select("doc_id", "level", "digest", again, F.col("node").alias(f"node_{name}"), F.col("start").alias(f"start_{name}"))

    both = side(before, "before").join(side(after, "after"), on, "full_outer").drop("again")
    return both.where("node_before is null or node_after is null")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_sections int, n_paragraphs int, first_difference long"
_FIELDS = [x.split(" ")[0] for x in EDITED.split(", ")]
_EDGE = EDITED + ", part int, place string, text string"


def _compared(key: int, text: str, tree: Tree, after: str, next_tree: Tree) -> tuple:
    cut = len(text) // 3
    edited = text[: len(text) - cut] + after[:cut]
    new = tree if edited == text else Tree(edited)
    like = 1.0 if new.root == tree.root else _share(tree.sketch, new.sketch)
    near = 1.0 if next_tree.root == tree.root else _share(tree.sketch, next_tree.sketch)
    return (key, len(text), hashlib.sha256(edited.encode()).hexdigest(), tree.print, new.print, like, near, len(tree.sections), len(tree.paragraphs), first_difference(tree, new))


def fingerprint_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, and that of its text with the last third replaced from the next document.

    The documents are dealt by ranges of descending key, so the next one is the next row of the same task; only the
    first and last row of each task meet in a second, small step. Texts move through one shuffle.
    """
    spark = docs.sparkSession
    ordered = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    tie = F.xxhash64("text")  # splitters are sampled from the keys, so texts must not be among them
    ordered = ordered.repartitionByRange(shuffle_width(spark), F.col("doc_id").desc(), tie).sortWithinPartitions(F.col("doc_id").desc(), tie, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        for batch in slices(batches, "text"):
            rows = []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                tree = Tree(t)
                if last is None:
                    rows.append((i, *[None] * 9, part, "first", t))
                else:
                    rows.append((*_compared(*last, t, tree), part, None, None))
                last = (i, t, tree)
            yield _table(rows)
        if last is not None:
            yield _table([(last[0], *[None] * 9, part, "last", last[1])])

    found = saved(ordered.mapInArrow(run, _EDGE), "fingerprints")
    parts = sorted(x.part for x in found.where("place = 'first'").select("part").collect())  # numbers of tasks that had rows
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, follower int")
    heads = found.where("place = 'first'").select(F.col("part").alias("follower"), F.col("text").alias("after"))
    tails = found.where("place = 'last'").select("doc_id", "text", "part").join(follows, "part").join(heads, "follower")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*_compared(x["doc_id"], x["text"], Tree(x["text"]), x["after"], Tree(x["after"])), None, None, None) for x in batch.to_pylist()]
            if rows:
                yield _table(rows).select(_FIELDS)

    edge = tails.select("doc_id", "text", "after").mapInArrow(ends, EDITED)
    return found.where("place is null").select(*_FIELDS).unionByName(edge)


_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(x, pa.string()) for x in _FIELDS[2:5]], ("near_edited", pa.float64()), ("near_next", pa.float64())]
    + [("n_sections", pa.int32()), ("n_paragraphs", pa.int32()), ("first_difference", pa.int64()), ("part", pa.int32()), ("place", pa.string()), ("text", pa.string())]
)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
