"""Near-duplicate documents: MinHash bands for candidates, odd sketches to weigh them, full shingle sets to confirm.

1. One pass over the texts makes each document's set of word shingles (as 64-bit hashes) and from it the set's size,
   a 128-bit digest of the set, BANDS band keys of ROWS MinHash values each, and an odd sketch: every (position, value)
   of the MinHash sample flips one of SKETCH_BITS parity bits, so that the bits in which two sketches differ count the
   positions in which the samples differ.
2. Documents with equal sets form a class, which has a number of its own; classes, not identifiers, are what is linked.
3. In every band bucket each class is paired with the bucket's smallest one. Pairs that the sketches don't rule out
   are confirmed on the full sets, and the links' connected components are formed.
4. In buckets whose members still lie in several components, the pairs between different components are weighed. Small
   buckets give them as rows. Larger ones are cut into blocks, and each two blocks meet in one task, which weighs their
   pairs in the first bucket that they share, by odd sketch and then by bottom-k sketch, and returns those that may
   reach the similarity. After confirming these, every pair that shares a bucket is linked, refuted or already in one
   component, and rows are made for likely links only, not for all pairs of a group.

A pair with similarity s shares no bucket with probability (1 - s^ROWS)^BANDS: 5e-8 at 0.8. The sketch rejects only
pairs whose estimate lies five standard errors or more below the threshold.

Null or empty texts and texts of white space have an empty set and are linked with nothing. Rows that repeat an
identifier are told apart by their sets: each is linked as its own text is. Rows without an identifier are linked with
nothing and kept. Very long texts are read whole, an empty table gives no rows, and columns other than the identifier and
the text are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import connected_components
from .common import mix64, saved, slices, words_of

BANDS, ROWS = 32, 4
#: Buckets up to SMALL members give pairs as rows; larger ones are weighed in blocks of about BLOCK members.
SMALL, BLOCK = 12, 2048
#: The smallest hashes of a set that blocks weigh; a set of no more is weighed exactly.
LOWEST = 256
SKETCH_BITS = 1024
_N = BANDS * ROWS
_LONGS = SKETCH_BITS // 64

_random = np.random.Generator(np.random.PCG64(20240229))
_XOR = _random.integers(0, 1 << 32, _N, dtype=np.uint32)
_FACTOR = _random.integers(0, 1 << 32, _N, dtype=np.uint32) | np.uint32(1)


def shingle_hashes(codes: np.ndarray, offsets: np.ndarray, words: list[str], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words than width has one, of all its words."""
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    h = table[codes] if len(words) else np.zeros(0, np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    n = len(h)
    rolled = h.copy()
    for k in range(1, width):
        if n > k:
            rolled[: n - k] = mix64(rolled[: n - k] * step + h[k:])
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            own = h[a : a + 1]
            for k in range(a + 1, b):
                own = mix64(own * step + h[k : k + 1])
            out.append(mix64(own ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhash(hashes: np.ndarray) -> np.ndarray:
    """_N MinHash values (32 bits) of a set that isn't empty."""
    out = np.full(_N, 0xFFFFFFFF, np.uint32)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(low), 2048):
        np.minimum(out, ((low[k : k + 2048, None] ^ _XOR) * _FACTOR).min(axis=0), out=out)
    return out


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """SKETCH_BITS parity bits (as 64-bit words) of MinHash values at their positions."""
    place = mix64(values.astype(np.uint64) + (np.arange(_N, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    bits = (np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.uint64)


def sketch_bits_allowed(similarity: float) -> int:
    """The number of differing sketch bits up to which a pair goes on to the full comparison."""
    low = max(0.0, similarity - 5 * math.sqrt(similarity * (1 - similarity) / _N))
    toggles = 2 * _N * (1 - low)  # each differing position flips one bit for either side
    mean = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** toggles)
    return math.ceil(mean + 5 * math.sqrt(mean * (1 - mean / SKETCH_BITS)))


_SIGNED = "doc_id long, mark long, n_shingles long, set_a long, set_b long, bands array<long>, " + ", ".join(f"s{k} long" for k in range(_LONGS))
_SIGNED_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64())), *[(f"s{k}", pa.int64()) for k in range(_LONGS)]]
)


def signatures(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's set size, set digest, band keys (null for an empty set) and odd sketch; mark: a hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(BANDS, dtype=np.uint64)
        for batch in slices(batches, "text"):
            sets = shingle_hashes(*words_of(batch.column("text")), width)
            n = len(sets)
            sizes = np.array([len(x) for x in sets], np.int64)
            a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            samples = np.zeros((n, _N), np.uint32)
            sketches = np.zeros((n, _LONGS), np.uint64)
            for k, x in enumerate(sets):
                if len(x):
                    a[k], b[k] = mix64(x).sum(), mix64(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()
                    samples[k] = minhash(x)
                    sketches[k] = odd_sketch(samples[k])
            grouped = samples.reshape(n, BANDS, ROWS).astype(np.uint64)
            bands = np.zeros((n, BANDS), np.uint64)
            for k in range(ROWS):
                bands = mix64(bands * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, k] + number)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1).view(np.int64)))
            if not sizes.all():
                held = lists.to_pylist()
                lists = pa.array([x if s else None for x, s in zip(held, sizes, strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(sizes), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), lists, *[pa.array(np.ascontiguousarray(sketches[:, k]).view(np.int64)) for k in range(_LONGS)]],
                schema=_SIGNED_ARROW,
            )

    return _texts(docs, key, text).mapInArrow(run, _SIGNED)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """id and the array of its shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_hashes(*words_of(batch.column("text")), width)
            ends = np.cumsum([0, *[len(x) for x in sets]]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "hashes"])

    return docs.select("id", "text").mapInArrow(run, "id long, hashes array<long>")


def near_duplicates(docs: DataFrame, similarity: int = 80, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id, n_links of every row.

    similarity: per cent of the union that the intersection of two documents' sets of width-word shingles must reach.
    component_id: the smallest identifier that links reach; class_id: that of the documents with the same set;
    n_links: confirmed links of the class with other classes. kept: doc_id is component_id.
    """
    return _decided(docs, similarity, width, key, text).drop("mark")


def without_near_copies(docs: DataFrame, similarity: int = 80, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs, all columns, for each group of near-duplicates: that of the smallest identifier.

    Where a group has several texts under that identifier, the one with the smallest hash stays; rows that are equal in
    identifier and text share their fate. Rows with an empty set or without an identifier stay.
    """
    rows = saved(_decided(docs, similarity, width, key, text).where("n_shingles > 0 and doc_id is not null").select("doc_id", "mark", "component_id", "kept"), "decided")
    heads = rows.where("kept").groupBy("doc_id").agg(F.min("mark").alias("first"), F.max("mark").alias("last")).where("first <> last")
    second = rows.where("kept").join(heads, "doc_id").where("mark <> first").select("doc_id", "mark")
    gone = rows.where("not kept").select("doc_id", "mark").unionByName(second).toDF("gone_id", "gone_mark").alias("gone")
    both = (docs[key].cast("long") == F.col("gone.gone_id")) & (F.xxhash64(docs[text]) == F.col("gone.gone_mark"))
    return docs.join(gone, both, "left_anti")


def _decided(docs: DataFrame, similarity: int, width: int, key: str, text: str) -> DataFrame:
    """near_duplicates() with mark, a hash of the row's text."""
    spans = [f"s{k}" for k in range(_LONGS)]
    signed = saved(signatures(docs, width, key, text), "signatures")
    # bands and sketch follow from the set, so any row of a class has them; its head is its smallest identifier's row
    head = F.min(F.struct("doc_id", "mark")).alias("head")
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "n_shingles").agg(head, F.first("bands").alias("bands"), *[F.first(x).alias(x) for x in spans])
    classes = classes.select(F.monotonically_increasing_id().alias("id"), "set_a", "set_b", "n_shingles", F.col("head.doc_id").alias("class_id"), F.col("head.mark").alias("mark"), "bands", *spans)
    classes = saved(classes, "classes")  # written, so the numbers stand
    keys = classes.select("id", F.explode("bands").alias("bucket"))
    full = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where("n > 1").select("bucket", "hub")
    members = saved(keys.join(full, "bucket"), "buckets")  # only buckets with two or more classes

    asked = members.select("id").distinct()
    stands = classes.join(asked, "id", "left_semi")
    wanted = stands.select("id", F.col("class_id").alias("doc_id"), "mark")
    texts = _texts(docs, key, text).join(wanted.hint("shuffle_hash"), ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])
    sets = saved(shingle_sets(texts, width), "sets")
    sketches = saved(stands.select("id", "n_shingles", *spans), "sketches")

    first = confirmed(members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), sketches, sets, similarity)
    first = saved(first, "links")
    parts = connected_components(first)
    placed = members.join(parts, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    split = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x <> y").select("bucket", "n")
    placed = saved(placed.join(split, "bucket"), "split")
    few = placed.where(F.col("n") <= SMALL)
    left = few.select("bucket", F.col("id").alias("a"), F.col("component").alias("part_a"))
    right = few.select("bucket", F.col("id").alias("b"), F.col("component").alias("part_b"))
    across = left.join(right, "bucket").where("a < b and part_a <> part_b").select("a", "b")
    across = across.unionByName(weighed(placed.where(F.col("n") > SMALL), stands, sets, similarity)).distinct()
    second = saved(confirmed(across, sketches, sets, similarity), "links")

    links = first.unionByName(second)
    parts = connected_components(parts.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(second))
    named = parts.join(classes.select("id", "class_id"), "id")
    parts = named.join(named.groupBy("component").agg(F.min("class_id").alias("component_id")), "component").select("id", "component_id")
    count = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("n_links"))
    told = classes.select("id", "set_a", "set_b", "n_shingles", "class_id").join(parts, "id", "left").join(count, "id", "left").drop("id")
    rows = signed.select("doc_id", "mark", "n_shingles", "set_a", "set_b").join(told, ["set_a", "set_b", "n_shingles"], "left")
    known = F.col("doc_id").isNotNull()
    own = F.when(known, F.coalesce("class_id", "doc_id"))
    component = F.when(known, F.coalesce("component_id", own))
    kept = F.coalesce(component == F.col("doc_id"), F.lit(True))
    return rows.select("doc_id", "mark", "n_shingles", component.alias("component_id"), kept.alias("kept"), own.alias("class_id"), F.coalesce(F.when(known, F.col("n_links")), F.lit(0)).alias("n_links"))


def weighed(members: DataFrame, stands: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) of members (bucket, id, component, n) of different components that may reach the similarity."""
    asked = members.select("id").distinct()
    lowest = F.transform(F.slice("hashes", 1, LOWEST), lambda h: F.shiftright(h, 32).cast("int")).alias("low")
    about = sets.join(asked, "id", "left_semi").select("id", lowest)
    about = about.join(stands.select("id", "n_shingles", "bands", F.array(*[f"s{k}" for k in range(_LONGS)]).alias("sketch")), "id")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    rows = members.select("bucket", "id", "component", blocks.alias("blocks"), own.alias("own"))
    # a block meets itself and every other: as (smaller, larger)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", "id", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = rows.join(about, "id")
    allowed, least = sketch_bits_allowed(similarity / 100), similarity / 100 - 5 * math.sqrt(similarity / 100 * (1 - similarity / 100) / LOWEST)

    def weigh(key: tuple, rows: pa.Table) -> pa.Table:
        bucket, i, j = (x.as_py() for x in key)
        ids, parts, sizes = (rows.column(x).to_numpy() for x in ("id", "component", "n_shingles"))
        bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        sketches = rows.column("sketch").combine_chunks().flatten().to_numpy().reshape(-1, _LONGS).view(np.uint64)
        lists = rows.column("low").combine_chunks()
        ends, low = lists.offsets.to_numpy(), lists.flatten().to_numpy().view(np.uint32)
        low = [low[a - ends[0] : b - ends[0]] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        own = rows.column("own").to_numpy()
        found = []
        band = int(np.flatnonzero(bands[0] == bucket)[0])
        for x in np.flatnonzero(own == i).tolist():
            y = own == j if i != j else np.arange(len(ids)) > x
            y &= parts != parts[x]
            y &= (100 * np.minimum(sizes, sizes[x]) >= similarity * np.maximum(sizes, sizes[x])) & ~(bands[:, :band] == bands[x, :band]).any(axis=1)
            y = np.flatnonzero(y)
            y = y[np.bitwise_count(sketches[y] ^ sketches[x]).sum(axis=1) <= allowed]
            for k in y.tolist():
                if _likeness(low[x], low[k], int(sizes[x]), int(sizes[k]), similarity, least):
                    found.append((min(ids[x], ids[k]), max(ids[x], ids[k])))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.groupBy("bucket", "i", "j").applyInArrow(weigh, "a long, b long")


def _likeness(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, similarity: int, least: float) -> bool:
    """Whether sets of n_a and n_b hashes, of which the smallest are known, may reach the similarity."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = both[1:] == both[:-1]
    if n_a <= LOWEST and n_b <= LOWEST:
        common = int(same.sum())
        return 100 * common >= similarity * (n_a + n_b - common)
    first = np.concatenate([[True], ~same])
    place = np.cumsum(first)
    whole = min(LOWEST, int(place[-1]))
    return int(same[place[1:] <= whole].sum()) >= least * whole


def confirmed(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity: first sizes and sketches, then the full sets."""

    def side(name: str) -> DataFrame:
        return sketches.select(F.col("id").alias(name), F.col("n_shingles").alias(f"n_{name}"), *[F.col(f"s{k}").alias(f"{name}{k}") for k in range(_LONGS)])

    differ = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(_LONGS)), F.lit(0))
    likely = pairs.join(side("a"), "a").join(side("b"), "b")
    likely = likely.where((100 * F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")) & (differ <= sketch_bits_allowed(similarity / 100)))
    likely = likely.select("a", "b", "n_a", "n_b")
    with_b = likely.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("set_b")), "b")
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("set_a")), "a")
    common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return both.withColumn("common", common).where(100 * F.col("common") >= similarity * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")
