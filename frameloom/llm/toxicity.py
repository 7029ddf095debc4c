"""Toxicity of whole texts: disguised words are restored by a noisy channel, then words and stems are weighed.

1. The channel's language model counts the characters of all documents.
2. On a bounded sample of labelled rows, the documents of either class that hold a feature are counted. A feature is a
   word in small letters or its first 3 to 8 letters; a document has those of its words as written and as restored.
   Features whose likelihood ratio stands out among all features stay, with their log odds.
3. A logistic regression on the same sample weighs a document's strongest and second strongest word and the number of
   its strong words. For it, features come from the other half of the sample, so chance finds count as little as they
   will in new documents.
4. One more pass scores every document.

Only text is looked at. Null, empty and blank texts have no features and get the score of such texts in the sample's
regression; very long texts and words are read whole. Labels that are null or repeated: nulls are left out, and of several
the largest counts; of several texts under a labelled identifier the one with the smallest hash is learnt from. Without
labels of both classes every score is the share of label 1, or 0. Rows with missing identifiers count as held out. Repeated
rows are scored alike, and an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, slices, words_of
from .deobfuscate import DISGUISED, LOOKS_LIKE, Channel, character_counts, spaced_runs
from .regression import fitted, sigmoid

#: Labelled rows that the classifier is fitted on at most.
LABELLED_ROWS = 60_000
#: A longer word is a feature by its digest.
NAMED = 64
#: Text bytes whose features are counted together before they are shuffled.
COUNTED_BYTES = 8 << 20
STEMS = (3, 4, 5, 6, 7, 8)
#: Log odds from which a word counts as strong.
STRONG = 2.0
_OUTER = ".,;:!?()[]{}<>\"'|#$%&*+-_=/\\~^`@"
#: Of these, what stands for no letter.
_PLAIN_OUTER = "".join(x for x in _OUTER if x not in LOOKS_LIKE)


def held_out(key: str = "doc_id") -> Column:
    """The rows whose labels are never learnt from: one in five, by a checksum of the identifier."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled(labels: DataFrame, label: str, key: str = "doc_id", most: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, label) of at most so many rows that may be learnt from, in the order of a hash."""
    rows = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where("label in (0, 1) and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64(F.col("doc_id"), F.lit(3)), "doc_id").limit(most)


def one_each(rows: DataFrame, known: DataFrame) -> DataFrame:
    """One row (all columns of rows, label) for each labelled identifier: of several, the one with the smallest text hash.

    known: a bounded table, so what comes is bounded too."""
    whole = F.struct(F.xxhash64("text").alias("mark"), *[F.col(c) for c in rows.columns if c != "doc_id"])
    found = rows.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min(whole).alias("row"))
    return found.select("doc_id", "label", *[F.col(f"row.{c}") for c in rows.columns if c != "doc_id"])


def readings(word: str) -> list[str]:
    """A word with its outer signs that may stand for letters: with all of them, and without the outermost kinds."""
    core = word.strip(_OUTER)
    if not core:
        return [word]
    at = word.index(core)
    end = at + len(core)
    first, last = at, end
    while first and word[first - 1] in LOOKS_LIKE:
        first -= 1
    while last < len(word) and word[last] in LOOKS_LIKE:
        last += 1
    # * may be left out by the channel, so it needs no reading of its own; equal signs stay together
    starts = [k for k in range(first, at + 1) if k in (first, at) or word[k - 1] not in (word[k], "*")]
    ends = [k for k in range(end, last + 1) if k in (end, last) or word[k] not in (word[k - 1], "*")]
    return sorted({word[a:b] for a in starts for b in ends} - {core})


class Words:
    """The words of a batch of texts: as written and as restored."""

    def __init__(self, texts: pa.Array, channel: Channel):
        codes, offsets, words = words_of(texts, "utf8")
        listed = pc.utf8_trim(pa.array(words, pa.large_string()), _OUTER)
        signed = pc.utf8_trim(pa.array(words, pa.large_string()), _PLAIN_OUTER)  # outer signs may be letters
        odd = [pc.match_substring_regex(x, DISGUISED).to_numpy(zero_copy_only=False).astype(bool) for x in (listed, signed)]
        odd[1] &= pc.not_equal(signed, listed).to_numpy(zero_copy_only=False).astype(bool)
        asked = [(k, 0, x) for k, x in zip(np.flatnonzero(odd[0]).tolist(), listed.filter(pa.array(odd[0])).to_pylist(), strict=True)]
        spelt = zip(np.flatnonzero(odd[1]).tolist(), map(readings, signed.filter(pa.array(odd[1])).to_pylist()), strict=True)
        asked += [(k, n, x) for k, own in spelt for n, x in enumerate(own, 1)]
        restored = [channel.restore(x) for _, _, x in asked]
        extras = []
        for n in range(max((n for _, n, _ in asked), default=0) + 1):  # the nth other reading of each word
            again = np.full(len(words), -1, np.int64)
            for at, (k, own, _) in enumerate(asked):
                if own == n:
                    again[k] = len(words) + at
            extras.append(again[codes])
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        pieces = pc.if_else(pc.equal(pc.utf8_length(signed), 0), pa.array(words, pa.large_string()), signed)
        sizes = pc.utf8_length(pieces).to_numpy(zero_copy_only=False)
        joined = [(t, x) for t, run in spaced_runs(sizes, offsets, codes, pieces.to_pylist()) for x in channel.restore(run).split()]
        spelled = [x for _, x in joined]
        hits = [x >= 0 for x in extras]
        #: Distinct words, and the (text, word) of every place.
        self.listed = pa.concat_arrays([listed, pa.array(restored + spelled, pa.large_string())])
        self.text = np.concatenate([owner, *(owner[x] for x in hits), np.array([x for x, _ in joined], np.int64)])
        self.word = np.concatenate([codes, *(x[x >= 0] for x in extras), len(words) + len(restored) + np.arange(len(spelled))]).astype(np.int64)

    def features(self) -> list[pa.Array]:
        """The features of every distinct word; null where it has none of that kind."""
        size = pc.utf8_length(self.listed)
        whole = pc.if_else(pc.greater(size, 1), self.listed, None)
        long = pc.greater(size, NAMED)
        if pc.any(long).as_py():
            named = pa.array(["#" + xxhash.xxh3_128_hexdigest(x) for x in self.listed.filter(long).to_pylist()], pa.large_string())
            whole = pc.replace_with_mask(whole, long, named)
        out = [whole]
        for k in STEMS:
            stem = pc.binary_join_element_wise(pc.utf8_slice_codeunits(self.listed, 0, k), pa.scalar("*", pa.large_string()), pa.scalar("", pa.large_string()))
            out.append(pc.if_else(pc.greater(size, k), stem, None))
        return out


def _counted(rows: DataFrame, channel) -> DataFrame:
    """(feature, half, n1, n0): documents of either label with a feature, by half of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", COUNTED_BYTES):
            found = Words(batch.column("text"), channel.value)
            kind = 2 * batch.column("half").to_numpy() + batch.column("label").to_numpy()
            for own in found.features():
                coded = own.dictionary_encode()
                many = len(coded.dictionary)
                code = pc.fill_null(coded.indices.cast(pa.int64()), -1).to_numpy()[found.word]
                pair = np.unique(found.text[code >= 0] * (many + 1) + code[code >= 0])
                text, feature = np.divmod(pair, many + 1)
                table = np.bincount(kind[text] * many + feature, minlength=4 * many).reshape(4, many) if many else np.zeros((4, 0), np.int64)
                for half in (0, 1):
                    seen = np.flatnonzero(table[2 * half] + table[2 * half + 1])
                    if len(seen):
                        yield pa.RecordBatch.from_pydict(
                            {"feature": coded.dictionary.take(pa.array(seen)).cast(pa.string()), "half": np.full(len(seen), half, np.int32), "n1": table[2 * half + 1][seen], "n0": table[2 * half][seen]}
                        )

    counted = rows.select("text", "label", "half").mapInArrow(run, "feature string, half int, n1 long, n0 long")
    return counted.groupBy("feature", "half").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def _chosen(counts: DataFrame, ones: int, zeros: int) -> tuple[pa.Array, np.ndarray]:
    """Features of label 1 whose likelihood ratio is larger than chance gives among so many, and their log odds."""
    share = ones / max(ones + zeros, 1)
    counts = counts.groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where("n1 + n0 >= 2")
    n = F.col("n1") + F.col("n0")
    part = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    rows = []
    if ones and zeros:
        counts = counts.withColumn("ratio", 2 * (part(F.col("n1"), share) + part(F.col("n0"), 1 - share)))
        many = counts.count()
        strong = counts.where((F.col("n1") > n * share) & (F.col("ratio") >= 2 * math.log(max(many, 2))))
        rows = strong.orderBy(F.desc("ratio"), "feature").collect()  # of the words of LABELLED_ROWS texts
    odds = [math.log((x.n1 + 0.5) / (ones + 1)) - math.log((x.n0 + 0.5) / (zeros + 1)) for x in rows]
    return pa.array([x.feature for x in rows], pa.large_string()), np.array(odds, float)


def _measures(found: Words, many: int, names: pa.Array, weights: np.ndarray) -> np.ndarray:
    """For each text: strongest and second strongest log odds of its distinct words, log of the number of strong ones."""
    best = np.zeros(len(found.listed))
    for own in found.features():
        at = pc.index_in(own, value_set=names)
        hit = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        best[hit] = np.maximum(best[hit], weights[at.take(pa.array(hit)).to_numpy().astype(np.int64)])
    out = np.zeros((many, 3))
    value = best[found.word]
    hot = value > 0
    pair = np.unique(found.text[hit_ := np.flatnonzero(hot)] * len(best) + found.word[hit_])
    text, word = np.divmod(pair, max(len(best), 1))
    value = best[word]
    order = np.lexsort((-value, text))
    text, value = text[order], value[order]
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.zeros(0, np.int64)
    out[text[first], 0] = value[first]
    second = first + 1
    second = second[second < len(text)]
    second = second[text[second] == text[second - 1]]
    out[text[second], 1] = value[second]
    out[:, 2] = np.log1p(np.bincount(found.text[hot], weights=(best[found.word][hot] >= STRONG), minlength=many))
    return out


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    channel = share(Channel.of(character_counts(rows)))
    known = spark.createDataFrame([tuple(x) for x in labelled(labels, label).collect()], "doc_id long, label int")  # LABELLED_ROWS at most
    half = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)).cast("int")
    few = saved(one_each(rows, known).withColumn("half", half), "labelled")
    counts = {(x.half, x.label): x.n for x in few.groupBy("half", "label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = (sum(n for (_, label), n in counts.items() if label == k) for k in (1, 0))
    if not ones or not zeros:
        return rows.select("doc_id", held_out().alias("held_out"), F.lit(float(ones > 0)).alias("score"), F.lit(int(ones > 0)).alias("predicted"))
    counted = saved(_counted(few, channel), "features")
    halves = share([_chosen(counted.where(F.col("half") != k), counts.get((1 - k, 1), 0), counts.get((1 - k, 0), 0)) for k in (0, 1)])
    model = share(_chosen(counted, ones, zeros))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found, own = Words(batch.column("text"), channel.value), batch.column("half").to_numpy()
            x = np.where((own == 0)[:, None], *(_measures(found, batch.num_rows, *halves.value[k]) for k in (0, 1)))
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]})

    sample = few.select("label", "half", "text").mapInArrow(measured, "label int, a double, b double, c double").toPandas()  # LABELLED_ROWS at most
    beta = fitted(sample[["a", "b", "c"]].to_numpy(), sample["label"].to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = _measures(Words(batch.column("text"), channel.value), batch.num_rows, *model.value)
            score = sigmoid(beta[0] + x @ beta[1:])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": score})

    done = rows.mapInArrow(run, "doc_id long, score double")
    return done.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
