import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from frameloom.llm import quality, toxicity
from frameloom.llm.deobfuscate import SYMBOLS, Channel, character_counts, lattice
from frameloom.llm.regression import fitted, sigmoid


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


BAD = ["idiot", "moron", "worthless", "clown"]


def disguise(rng, word):
    leet = {"i": "1", "o": "0", "e": "3", "s": "5", "t": "7"}
    kind = rng.randrange(4)
    if kind == 0:
        return "".join(leet.get(c, c) if rng.random() < 0.8 else c for c in word)
    if kind == 1:
        return " ".join(word)
    if kind == 2:
        return ".".join(word)
    k = rng.randrange(1, len(word) - 1)
    return word[:k] + word[k] * 3 + word[k:]


@pytest.fixture(scope="module")
def corpus(spark, prose):
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(900):
        text = prose(i, rng.randint(20, 120))
        toxic = int(rng.random() < 0.2)
        if toxic:
            words = text.split(" ")
            for _ in range(2):
                word = rng.choice(BAD)
                words.insert(rng.randrange(len(words)), disguise(rng, word) if rng.random() < 0.4 else word)
            text = " ".join(words)
        junk = int(rng.random() < 0.2)
        if junk:
            text = " | ".join(text.split()) if rng.random() < 0.5 else " ".join(w.upper() + "!!" for w in text.split())
        docs.append((i, text, rng.choice(["en", "de"]), "spam" if junk and rng.random() < 0.7 else rng.choice(["news", "web", None]), len(text)))
        if rng.random() < 0.8:
            labels.append((i, 1 - junk, toxic))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(docs, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(rows, labels, label):
    truth = {r.doc_id: r[label] for r in labels.collect()}
    tested = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == held(r.doc_id) for r in rows) and len(tested) > 80
    return np.mean([r.predicted == truth[r.doc_id] for r in tested])


def test_quality_on_held_out_rows(corpus):
    docs, labels = corpus
    rows = quality.scored(docs, labels).collect()
    assert len(rows) == docs.count() and accuracy(rows, labels, "quality") > 0.97
    assert all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) == bool(r.predicted) for r in rows)
    left = quality.accepted(docs, labels)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.select("doc_id").collect()) == sorted(r.doc_id for r in rows if r.kept)


def test_views_teach_each_other(corpus, monkeypatch):
    docs, labels = corpus
    seen = []
    original = quality._counts

    def watch(*args):
        out = original(*args)
        seen.append(out)
        return out

    monkeypatch.setattr(quality, "_counts", watch)
    first, _ = quality.trained(docs, labels, rounds=0)
    taught, measured = quality.trained(docs, labels, rounds=2)
    assert len(seen) == 2 and seen[0][0].min() > 0  # either view is sure of both labels
    assert not np.allclose(first.text, taught.text)
    assert any(not np.allclose(a, b) for a, b in zip(first.values.odds, taught.values.odds, strict=True))
    # every document of which a view is sure counts: by brute force over the measures
    table = measured.toArrow()
    x, columns = quality._unpacked(table)
    model, _ = quality.trained(docs, labels, rounds=0)
    p = sigmoid(model.odds(x, model.values.codes(columns)))
    for k in (0, 1):
        low, high = model.cuts[k]
        other = model.cuts[1 - k]
        assert 1 - quality.SURE <= low < 0.5 < high <= quality.SURE
        assert seen[0][0][k].tolist() == [((p[:, k] <= low) & (p[:, 1 - k] < other[1])).sum(), ((p[:, k] >= high) & (p[:, 1 - k] > other[0])).sum()]


def test_newton_sums_are_those_of_one_table(corpus):
    docs, labels = corpus
    model, measured = quality.trained(docs, labels, rounds=0)
    table = measured.toArrow()
    x, columns = quality._unpacked(table)
    fit = np.arange(len(x)) < 300
    values = sigmoid(model.odds(x, model.values.codes(columns)))
    told = np.where(values >= model.cuts[:, 1], 1, np.where(values <= model.cuts[:, 0], 0, -1))
    labelled = np.where(told.min(axis=1) + told.max(axis=1) == 1, -1, told[:, 1])
    y = (values[:, 0] >= 0.5).astype(int)
    got = quality._stepped(measured, model, x[fit], y[fit], np.array([0.5, 0.25]))
    sure = labelled >= 0
    rows, told = np.concatenate([x[fit], x[sure]]), np.concatenate([y[fit], labelled[sure]])
    weight = np.concatenate([np.ones(fit.sum()), np.where(labelled[sure] == 1, 0.25, 0.5)])
    mean, spread = x[fit].mean(axis=0), x[fit].std(axis=0)
    spread[spread < 1e-9] = 1.0
    z = np.c_[np.ones(len(rows)), (rows - mean) / spread]
    beta = np.append(model.text[0] + model.text[1:] @ mean, model.text[1:] * spread)
    penalty = np.ones(len(beta))
    penalty[0] = 1e-6
    for _ in range(quality.STEPS):
        p = sigmoid(z @ beta)
        curve = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(curve, z.T @ (weight * (told - p)) - penalty * beta)
        beta = beta + step / max(1.0, np.abs(step).max() / 4)
    assert got[1:] * spread == pytest.approx(beta[1:], rel=1e-4, abs=1e-6)


def test_words_are_read_and_repeated_identifiers_bounded(spark, prose):
    rows = [(k, prose(k, 40) + (" lovely" if k % 2 else " dreary"), "en", "s") for k in range(400)] + [(1, prose(1, 40) + " dreary", "en", "s")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, quality int")
    out = {(r.doc_id, r.held_out): r for r in quality.scored(docs, labels).collect()}
    tested = [r for (i, h), r in out.items() if h and i != 1]
    assert len(tested) > 50 and np.mean([r.predicted == r.doc_id % 2 for r in tested]) > 0.85
    few = toxicity.one_each(docs.select("doc_id", "text"), labels.withColumnRenamed("quality", "label"))
    assert few.count() == 400


def test_toxicity_on_held_out_rows(corpus):
    docs, labels = corpus
    rows = toxicity.scored(docs, labels).collect()
    assert len(rows) == docs.count() and accuracy(rows, labels, "toxic") > 0.93
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows_and_no_labels(spark, module, corpus, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert module.scored(odd, none).count() == odd.count()
    assert module.scored(empty, none).count() == 0
    labels = corpus[1].unionByName(spark.createDataFrame([(None, None, None), (3, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int"))
    both = corpus[0].select("doc_id", "text", "lang", "source", "n_chars").unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    assert module.scored(both, labels).count() == both.count()


def test_channel_restores_words(spark, prose):
    texts = [(prose(k, 200) + " " + " ".join(BAD * 3),) for k in range(20)]
    channel = Channel.of(character_counts(spark.createDataFrame(texts, "text string")))
    for word, told in {"1d10t": "idiot", "m0r0n": "moron", "w0rthl355": "worthless", "c.l.o.w.n": "clown", "idiooot": "idiot", "m*ron": "moron", "idiot": "idiot"}.items():
        assert channel.restore(word) == told


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    channel = Channel(rng.integers(0, 50, SYMBOLS**3))
    number = lambda c: ord(c) - 96
    for word in ("a1b", "x5ss", "1l0", "a.b1"):
        paths = [("", 0.0)]
        for options in lattice(word):
            paths = [(p + x, s + c) for p, s in paths for x, c in options]
        best = None
        for path, score in paths:
            if all("a" <= c <= "z" for c in path):
                a = b = 0
                for c in path:
                    score += float(channel.model[a, b, number(c)])
                    a, b = b, number(c)
                score += float(channel.model[a, b, 0])
                best = max(best or (score, path), (score, path))
        assert channel.restore(word) == best[1]


def test_regression_recovers_odds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20_000, 2))
    y = (rng.random(20_000) < sigmoid(0.5 + x @ [1.0, -2.0])).astype(int)
    assert fitted(x, y, ridge=0.01) == pytest.approx([0.5, 1.0, -2.0], abs=0.1)


def best_path(channel, word):
    """The likeliest path through a word's lattice: all states, by the full table of two characters."""
    number = lambda c: ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % (SYMBOLS - 27)
    best = {(0, 0): (0.0, "")}
    for options in lattice(word):
        ahead = {}
        for (a, b), (score, path) in best.items():
            for x, cost in options:
                to, new = ((b, number(x)), score + cost + float(channel.model[a, b, number(x)])) if x else ((a, b), score + cost)
                ahead[to] = max(ahead.get(to, (-1e9, "")), (new, path + x))
        best = ahead
    return max((score + float(channel.model[a, b, 0]), path) for (a, b), (score, path) in best.items())[1]


def test_no_state_is_dropped():
    rng = np.random.default_rng(6)
    for _ in range(3):
        channel = Channel(rng.integers(0, 50, SYMBOLS**3) ** 3)
        for word in ("f**k", "a**1*b", "**x**"):
            assert channel.restore(word) == best_path(channel, word)
    assert len(lattice("f****d")) == 6


def test_signs_at_the_edges_of_words(spark, prose):
    bad = ["stupid", "asshole", "ass", "idiot"]
    channel = Channel.of(character_counts(spark.createDataFrame([(prose(k, 200) + " " + " ".join(bad * 3),) for k in range(20)], "text string")))
    texts = ["you $tupid one", "(@sshole)", "an a$$.", "what an !diot!", "id**t", "a st***d one", "stupid!"]
    found = toxicity.Words(pa.array(texts, pa.large_string()), channel)
    words = [set() for _ in texts]
    for t, w in zip(found.text.tolist(), found.word.tolist(), strict=True):
        words[t].add(found.listed[w].as_py())
    for own, told in zip(words, ["stupid", "asshole", "ass", "idiot", "idiot", "stupid", "stupid"], strict=True):
        assert any(x == told or x[: len(told)] == told for x in own), (own, told)


def test_spaced_runs_are_cut_into_words(spark, prose):
    bad = ["idiot", "stupid", "you", "a", "are", "the"]
    channel = Channel.of(character_counts(spark.createDataFrame([(prose(k, 200) + " " + " ".join(bad * 9),) for k in range(20)], "text string")))
    long = "y o u a r e s t u p i d " * 6
    texts = ["so y o u i d i o t there", "what a i d i o t", "the id i ot there", long, "i d i o o o o t", "s t u p i d !", "", "i", "$ t u p 1 d", "one s t", "u p i d"]
    found = toxicity.Words(pa.array(texts, pa.large_string()), channel)
    words = [[] for _ in texts]
    for t, w in zip(found.text.tolist(), found.word.tolist(), strict=True):
        words[t].append(found.listed[w].as_py())
    assert {"you", "idiot"} <= set(words[0]) and "idiot" in words[1] and "idiot" in words[2] and "idiot" in words[4]
    assert words[3].count("stupid") == 6 and any(x.startswith("stupid") for x in words[5]) and "stupid" in words[8]
    assert not any("stupid" in x for own in words[9:] for x in own)  # runs end with their texts


def test_no_length_ends_the_search(spark, prose):
    bad = ["idiot", "stupid", "you", "are"]
    channel = Channel.of(character_counts(spark.createDataFrame([(prose(k, 200) + " " + " ".join(bad * 9),) for k in range(20)], "text string")))
    long = ".".join("youarestupid" * 4)
    assert "stupid" in channel.restore(long) and channel.restore("a" + "*" * 3000 + "b") == "ab"
    texts = [long, "x" * 5000, "q" * 70 + " fine"]
    found = toxicity.Words(pa.array(texts, pa.large_string()), channel)
    assert any("stupid" in x.as_py() for x in found.listed)
    names = found.features()[0]
    assert sum(str(x.as_py()).startswith("#") for x in names) >= 2 and all(len(x.as_py() or "") <= 64 for x in names)
