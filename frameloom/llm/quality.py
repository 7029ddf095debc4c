"""Quality by co-training: a classifier of the text and one of the page's metadata teach each other, then score together.

1. On a bounded sample of labelled rows, hashed words and word pairs get log odds. One pass then measures every document:
   shares of kinds of characters, words and lines, repetition, lengths and the odds of its words (the text view); language
   and source, and the classes of its size, its number of lines and their length (the metadata view).
2. The text view is a logistic regression, the metadata view sums the odds of its values. In each round either view scores
   all documents, and all those that it is sure of, with the labels it gives them, teach the other view: the regression
   by Newton steps whose sums Spark adds up, the odds by counts. What is passed on for a label weighs no more in all
   than the labelled rows do. A view is sure of a label by its calibrated probability, or by rank: as sure as of the
   share FIRST of the labelled rows that it is surest of, if it gives the label LEAST at least. A document of which the
   other view is sure otherwise teaches nobody. A view goes back to what it was if what it was taught raises its log loss on
   the labelled rows that it is calibrated on; a round in which neither view teaches or learns is the last.
3. Each view is calibrated on labelled rows that it was not fitted on, and a logistic regression on these rows weighs
   the two calibrated log odds against each other. That scores every document.

Null, empty and blank texts have zero measures and are scored as such; very long texts are read whole. Null metadata is a
value of its own, values that no labelled row has share one. Labels as for toxicity: nulls are left out, of several the
largest counts, of several texts under a labelled identifier the one with the smallest hash is learnt from; rows with
missing identifiers are not learnt from. Without labels of both classes every document is kept, at score 1. Repeated rows
are scored alike, an empty table gives no rows, and other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, saved, slices, words_of
from .regression import fitted, sigmoid
from .toxicity import held_out, labelled, one_each

#: Labelled rows that are learnt from at most.
LABELLED_ROWS = 20_000
ROUNDS = 3
#: Newton steps of the text view in a round; each starts from the last.
STEPS = 3
#: Calibrated probability of a label from which a view is sure.
SURE = 0.98
#: Share of the labelled rows whose rank makes a view sure of either label, and the probability that it takes with it.
FIRST, LEAST = 0.01, 0.75
#: Values that words and word pairs are hashed to.
WORDS = 1 << 16
#: Classes of bytes: small, capital, digit, blank, line end, sentence mark, other sign, beyond ASCII.
_CLASSES = 8
_CLASS = np.full(256, 6, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[9, 11, 12, 32]], _CLASS[[10, 13]], _CLASS[128:] = 0, 1, 2, 3, 4, 7
_CLASS[[ord(x) for x in ".,;:'\"()-?"]] = 5
MEASURES = [
    *[f"share_{x}" for x in ("small", "capital", "digit", "blank", "line_end", "mark", "sign", "beyond")],
    "log_words", "word_length", "distinct_words", "top_word", "short_words", "signed_words", "capital_words", "bare_signs", "distinct_lines",
    "word_odds", "good_words", "bad_words",
]
#: Columns of the metadata view: those of the table, and classes of what a text measures, which the text view goes without.
GIVEN, DERIVED = ("lang", "source"), ("size", "lines", "line_length")
METADATA = GIVEN + DERIVED


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values of each stretch between offsets; 0 for an empty one."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(codes: np.ndarray, offsets: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """For each stretch the number of distinct codes, and how often the commonest occurs."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    pair, often = np.unique(owner * max(many, 1) + codes, return_counts=True)
    text = pair // max(many, 1)
    distinct, most = np.bincount(text, minlength=len(offsets) - 1), np.zeros(len(offsets) - 1)
    np.maximum.at(most, text, often)
    return distinct, most


def word_places(codes: np.ndarray, offsets: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, place among WORDS) of every word and every pair of words in a row, in small letters."""
    table = np.fromiter((xxhash.xxh3_64_intdigest(w.lower()) for w in words), np.uint64, len(words))
    h = table[codes] if len(words) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    pairs = mix64(h[inner] * np.uint64(0x9E3779B97F4A7C15) + h[inner + 1])
    return np.concatenate([owner, owner[inner]]), (np.concatenate([h, pairs]) % np.uint64(WORDS)).astype(np.int64)


def text_measures(texts: pa.Array, odds: np.ndarray) -> np.ndarray:
    """MEASURES of each text, as a matrix. odds: log odds of each of WORDS places."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    start = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset] if n else 0
    data = np.frombuffer(texts.buffers()[2], np.uint8)[start : start + ends[-1]] if ends[-1] else np.zeros(0, np.uint8)
    kinds = _CLASS[data]
    filled = np.maximum(size, 1)
    out = np.zeros((n, len(MEASURES)))
    for k in range(_CLASSES):
        out[:, k] = _sums(kinds == k, ends) / filled
    codes, offsets, words = words_of(texts, "no")
    count = np.diff(offsets)
    some = np.maximum(count, 1)
    owner, place = word_places(codes, offsets, words)
    own = odds[place]
    pieces = np.maximum(np.bincount(owner, minlength=n), 1)
    listed = pa.array(words, pa.large_string())
    length = pc.utf8_length(listed).to_numpy(zero_copy_only=False).astype(np.float64)
    signed = pc.match_substring_regex(listed, r"[#$%&*!|~^=+<>_]$").to_numpy(zero_copy_only=False).astype(bool)
    capital = pc.utf8_is_upper(listed).to_numpy(zero_copy_only=False).astype(bool) & (length > 1)
    bare = pc.match_substring_regex(listed, r"^[^\pL\pN]+$").to_numpy(zero_copy_only=False).astype(bool)
    distinct, most = _distinct(codes, offsets, len(words))
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten().dictionary_encode()
    line_ends = lists.offsets.to_numpy().astype(np.int64)
    line_ends = line_ends - (line_ends[0] if n else 0)
    different, _ = _distinct(lines.indices.to_numpy(zero_copy_only=False).astype(np.int64), line_ends, len(lines.dictionary))
    many_lines = np.maximum(np.diff(line_ends), 1)
    rest = [
        np.log1p(count), _sums(length[codes], offsets) / some, distinct / some, most / some,
        _sums((length <= 3)[codes], offsets) / some, _sums(signed[codes], offsets) / some, _sums(capital[codes], offsets) / some,
        _sums(bare[codes], offsets) / some, different / many_lines,
        *(np.bincount(owner, weights=x, minlength=n) / pieces for x in (own, own > 1, own < -1)),
    ]
    out[:, _CLASSES:] = np.array(rest).T
    return out


def derived(texts: pa.Array) -> list[pa.Array]:
    """DERIVED of each text: classes as wide as a factor of 2, of lines' length 1.4."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False) + 1
    lines = pc.count_substring(texts, "\n").to_numpy(zero_copy_only=False) + 1
    return [pa.array(np.floor(x).astype(np.int64)).cast(pa.string()) for x in (np.log2(size), np.log2(lines), 2 * np.log2(size / lines))]


class Values:
    """The metadata view: log odds of the values of each column that labelled rows have, others sharing one."""

    def __init__(self, known: list[list[str | None]]):
        self.known = [{v: k + 1 for k, v in enumerate(own)} for own in known]  # 0: any other value
        self.counts = [np.zeros((len(own) + 1, 2)) for own in known]

    def codes(self, columns: Sequence[pa.Array]) -> list[np.ndarray]:
        """The number of each row's value, by column."""
        out = []
        for known, own in zip(self.known, columns, strict=True):
            coded = own.dictionary_encode()
            table = np.array([known.get(x, 0) for x in coded.dictionary.to_pylist()] + [known.get(None, 0)], np.int64)
            out.append(table[pc.fill_null(coded.indices.cast(pa.int64()), len(table) - 1).to_numpy()])
        return out

    def learn(self, counts: list[np.ndarray]) -> None:
        """counts: for each column, rows of label 0 and 1 with each value."""
        self.total = counts[0].sum(axis=0) + 1
        self.odds = [np.log((n[:, 1] + 0.5) / self.total[1]) - np.log((n[:, 0] + 0.5) / self.total[0]) for n in counts]

    def raw(self, codes: list[np.ndarray]) -> np.ndarray:
        return np.log(self.total[1] / self.total[0]) + sum(own[k] for own, k in zip(self.odds, codes, strict=True))


class CoTrained:
    """Both views, their calibration and the weights of the whole."""

    def __init__(self, words: np.ndarray, text: np.ndarray, values: Values):
        self.words, self.text, self.values = words, text, values
        self.levels = [np.array([0.0, 1.0])] * 2
        self.cuts = np.array([[1 - SURE, SURE]] * 2)  # of each view, the probabilities that make it sure of label 0 and 1
        self.whole: np.ndarray | None = None

    def odds(self, x: np.ndarray, codes: list[np.ndarray]) -> np.ndarray:
        """Calibrated log odds of either view."""
        raw = [self.text[0] + x @ self.text[1:], self.values.raw(codes)]
        return np.stack([level[0] + level[1] * np.clip(r, -12, 12) for level, r in zip(self.levels, raw, strict=True)], axis=1)

    def scores(self, x: np.ndarray, codes: list[np.ndarray]) -> np.ndarray:
        """Columns: score of the text view, of the metadata view, of both."""
        odds = self.odds(x, codes)
        return np.c_[sigmoid(odds), sigmoid(self.whole[0] + odds @ self.whole[1:])]


def _inputs(docs: DataFrame, key: str, text: str) -> DataFrame:
    own = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in GIVEN]
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *own)


def _word_odds(sample: DataFrame) -> list[np.ndarray]:
    """Log odds of the WORDS places: learnt from part 1, from part 0, and from both (part 2 is not learnt from)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            owner, place = word_places(*words_of(batch.column("text"), "no"))
            owner, place = np.divmod(np.unique(owner * WORDS + place), WORDS)
            kind = (2 * batch.column("part").to_numpy() + batch.column("label").to_numpy())[owner]
            seen, n = np.unique(kind * WORDS + place, return_counts=True)
            yield pa.RecordBatch.from_pydict({"place": seen, "n": n})

    rows = sample.where("part < 2")
    found = rows.select("text", "part", "label").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    counts = np.zeros(4 * WORDS)
    for x in found.toArrow().to_batches():  # 4 * WORDS rows at most
        counts[x.column("place").to_numpy()] = x.column("n").to_numpy()
    counts = counts.reshape(2, 2, WORDS)
    many = np.zeros((2, 2))
    for x in rows.groupBy("part", "label").agg(F.count("*").alias("n")).collect():
        many[x.part, x.label] = x.n
    out = []
    for c, m in ((counts[1], many[1]), (counts[0], many[0]), (counts.sum(axis=0), many.sum(axis=0))):
        odds = np.log((c[1] + 1) / (m[1] + 2)) - np.log((c[0] + 1) / (m[0] + 2))
        odds[c.sum(axis=0) == 0] = 0
        out.append(odds.astype(np.float32))
    return out


_MEASURED = "doc_id long, x array<float>, " + ", ".join(f"{c} string" for c in METADATA)


def _measured(docs: DataFrame, odds: list[np.ndarray], more: Sequence[str] = ()) -> DataFrame:
    """The views of every row. Rows with a part are measured with odds[part], others with the last."""
    share, kept = docs.sparkSession.sparkContext.broadcast(odds), ["doc_id", *GIVEN, *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            if "part" in more:
                part = batch.column("part").to_numpy()
                x = np.zeros((batch.num_rows, len(MEASURES)))
                for k in np.unique(part).tolist():
                    x[part == k] = text_measures(batch.column("text").filter(pa.array(part == k)), share.value[k])
            else:
                x = text_measures(batch.column("text"), share.value[-1])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.astype(np.float32).reshape(-1)))
            own = {c: batch.column(c) for c in kept} | {"x": flat} | dict(zip(DERIVED, derived(batch.column("text")), strict=True))
            yield pa.RecordBatch.from_pydict({c: own[c] for c in ("doc_id", "x", *METADATA, *more)})

    return docs.select("text", *kept).mapInArrow(run, _MEASURED + "".join(f", {c} int" for c in more))


def _unpacked(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, list[pa.Array]]:
    pick = lambda c: (batch.column(c).combine_chunks() if isinstance(batch, pa.Table) else batch.column(c))
    return pick("x").flatten().to_numpy().reshape(batch.num_rows, len(MEASURES)).astype(np.float64), [pick(c) for c in METADATA]


def _calibrated(raw: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intercept and slope that turn a view's log odds into calibrated ones."""
    level = fitted(np.clip(raw, -12, 12)[:, None], y, ridge=0.1)
    return level if level[1] > 0 else np.array([level[0], 0.0])


def log_loss(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each column of probabilities against labels."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return -np.where(y[:, None] == 1, np.log(p), np.log(1 - p)).mean(axis=0)


def sure_cuts(p: np.ndarray) -> np.ndarray:
    """For each view (a column of probabilities of labelled rows) those from which it is sure of label 0 and of label 1."""
    low, high = np.quantile(p, [FIRST, 1 - FIRST], axis=0)
    return np.stack([np.maximum(1 - SURE, np.minimum(low, 1 - LEAST)), np.minimum(SURE, np.maximum(high, LEAST))], axis=1)


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> tuple[CoTrained | None, DataFrame | None]:
    """The co-trained views, and the measures of every document; None, None without labels of both classes."""
    spark, rows = docs.sparkSession, _inputs(docs, key, text)
    known = spark.createDataFrame([tuple(x) for x in labelled(labels, label, most=LABELLED_ROWS).collect()], "doc_id long, label int")  # LABELLED_ROWS at most
    # parts 0 and 1 are fitted on, part 2 calibrates
    part = F.when(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) == 0, 2).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(2)).cast("int"))
    sample = saved(one_each(rows, known).withColumn("part", part), "labelled")
    groups = {(x.part, x.label) for x in sample.groupBy("part", "label").agg(F.count("*")).collect()}
    if len({y for _, y in groups}) < 2:
        return None, None
    if len(groups) < 6:  # too few to be divided
        sample = sample.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(2)).cast("int"))
    odds = _word_odds(sample)
    table = _measured(sample, odds, ("part", "label")).orderBy("doc_id").toArrow()  # LABELLED_ROWS at most
    x, columns = _unpacked(table)
    y, part = table.column("label").to_numpy(), table.column("part").to_numpy()
    fit = part < 2
    check = ~fit if (~fit).any() else fit
    values = Values([sorted(set(c.filter(pa.array(fit)).to_pylist()), key=lambda v: (v is None, v or "")) for c in columns])
    codes = values.codes(columns)
    own = [np.stack([np.bincount(c[fit & (y == k)], minlength=len(n)) for k in (0, 1)], axis=1).astype(float) for c, n in zip(codes, values.counts, strict=True)]
    values.learn(own)
    model = CoTrained(odds[2], fitted(x[fit], y[fit]), values)

    def calibrate() -> None:
        model.levels = [_calibrated(r, y[check]) for r in (model.text[0] + x[check] @ model.text[1:], values.raw([c[check] for c in codes]))]
        model.cuts = sure_cuts(sigmoid(model.odds(x, codes)))

    calibrate()
    measured = saved(_measured(rows, odds[2:]), "measures")
    weight = np.array([(fit & (y == k)).sum() for k in (0, 1)], float)
    loss = lambda: log_loss(sigmoid(model.odds(x[check], [c[check] for c in codes])), y[check])
    for _ in range(rounds):
        taught, counts = _counts(measured, model)
        if not taught.any():
            break
        scale = np.minimum(1, weight / np.maximum(taught, 1))  # by teacher and label
        before, old = loss(), (model.text, values.odds, values.total)
        text = _stepped(measured, model, x[fit], y[fit], scale[1]) if taught[1].any() else model.text
        if taught[0].any():
            values.learn([a + n * scale[0] for a, n in zip(own, counts, strict=True)])
        model.text = text
        calibrate()
        worse = loss() > before
        if worse[0]:
            model.text = old[0]
        if worse[1]:
            values.odds, values.total = old[1:]
        calibrate()
        if worse.all():
            break
    model.whole = fitted(model.odds(x[check], [c[check] for c in codes]), y[check], ridge=0.1)
    return model, measured


def _sure(model: CoTrained, batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(measures, codes, label that either view is sure of, -1 for none; where they are sure of different ones, none)."""
    x, columns = _unpacked(batch)
    codes = model.values.codes(columns)
    p = sigmoid(model.odds(x, codes))
    given = np.where(p >= model.cuts[:, 1], 1, np.where(p <= model.cuts[:, 0], 0, -1))
    given[(given.min(axis=1) == 0) & (given.max(axis=1) == 1)] = -1
    return x, codes, given


def _summed(measured: DataFrame, of) -> np.ndarray:
    """The sum over all batches of of(batch), a flat array; tasks add up their own, Spark those of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = of(batch)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"place": np.arange(len(total)), "v": total})

    found = measured.mapInArrow(run, "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(found.num_rows)
    out[found.column("place").to_numpy()] = found.column("v").to_numpy()
    return out


def _counts(measured: DataFrame, model: CoTrained) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many documents either view is sure of by label, and the text view's labels by metadata value."""
    share, sizes = measured.sparkSession.sparkContext.broadcast(model), [len(n) for n in model.values.counts]

    def of(batch: pa.RecordBatch) -> np.ndarray:
        _, codes, given = _sure(share.value, batch)
        out = [np.array([(given[:, t] == k).sum() for t in (0, 1) for k in (0, 1)], float)]
        for c, n in zip(codes, sizes, strict=True):
            out.append(np.stack([np.bincount(c[given[:, 0] == k], minlength=n) for k in (0, 1)], axis=1).reshape(-1).astype(float))
        return np.concatenate(out)

    total = _summed(measured, of)
    if not len(total):
        total = np.zeros(4 + 2 * sum(sizes))
    cuts = np.cumsum([4, *[2 * n for n in sizes]])
    return total[:4].reshape(2, 2), [total[a:b].reshape(-1, 2) for a, b in zip(cuts, cuts[1:], strict=False)]


def _stepped(measured: DataFrame, model: CoTrained, x: np.ndarray, y: np.ndarray, scale: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """The text view after Newton steps over labelled rows and all documents that the metadata view is sure of."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-9] = 1.0
    beta = np.append(model.text[0] + model.text[1:] @ mean, model.text[1:] * spread)
    penalty = np.full(len(beta), ridge)
    penalty[0] = 1e-6
    d = len(beta)

    def sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, beta: np.ndarray) -> np.ndarray:
        z = np.c_[np.ones(len(x)), (x - mean) / spread]
        p = sigmoid(z @ beta)
        return np.concatenate([z.T @ (weight * (y - p)), ((z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z).reshape(-1)])

    for _ in range(STEPS):
        share = measured.sparkSession.sparkContext.broadcast((model, beta))

        def of(batch: pa.RecordBatch, share=share) -> np.ndarray:
            own, at = share.value
            x, _, given = _sure(own, batch)
            sure = given[:, 1] >= 0
            return sums(x[sure], given[sure, 1], scale[given[sure, 1]], at)

        total = sums(x, y, np.ones(len(y)), beta)
        taught = _summed(measured, of)
        total = total + taught if len(taught) else total
        step = np.linalg.solve(total[d:].reshape(d, d) + np.diag(penalty), total[:d] - penalty * beta)
        beta = beta + step / max(1.0, np.abs(step).max() / 4)
    out = beta.copy()
    out[1:] = beta[1:] / spread
    out[0] -= out[1:] @ mean
    return out


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, text_score, metadata_score, score, predicted, kept of every row; 1 is good."""
    model, measured = trained(docs, labels, label, key, text)
    if model is None:
        one = F.lit(1.0)
        return _inputs(docs, key, text).select("doc_id", held_out().alias("held_out"), one.alias("text_score"), one.alias("metadata_score"), one.alias("score"), F.lit(1).alias("predicted"), F.lit(True).alias("kept"))
    share = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, columns = _unpacked(batch)
                s = share.value.scores(x, share.value.values.codes(columns))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text_score": s[:, 0], "metadata_score": s[:, 1], "score": s[:, 2]})

    done = measured.mapInArrow(run, "doc_id long, text_score double, metadata_score double, score double")
    return done.select("doc_id", held_out().alias("held_out"), "text_score", "metadata_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= 0.5).alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score is 0.5 or more; they are judged where they lie, without a join."""
    model, _ = trained(docs, labels, label, key, text)
    if model is None:
        return docs
    share = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            own = [batch.column(c).cast(pa.string()) if c in names else pa.nulls(batch.num_rows, pa.string()) for c in GIVEN]
            inner = pa.RecordBatch.from_arrays([batch.column(text).cast(pa.large_string()), *own], ["text", *GIVEN])
            for part in slices(iter([inner]), "text"):
                # as floats, which the measures are kept in
                x = text_measures(part.column("text"), share.value.words).astype(np.float32).astype(np.float64)
                good = share.value.scores(x, share.value.values.codes([*(part.column(c) for c in GIVEN), *derived(part.column("text"))]))[:, 2] >= 0.5
                yield batch.slice(at, part.num_rows).filter(pa.array(good))
                at += part.num_rows

    return docs.mapInArrow(run, docs.schema)
