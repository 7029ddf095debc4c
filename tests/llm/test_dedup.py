import collections
import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from frameloom.llm import contentsort, neardup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_components(texts, width, percent):
    sets = {i: shingles(t, width) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def family(prose, rng, base, many, edits):
    words = prose(base, 120).split(" ")
    out = []
    for _ in range(many):
        own = list(words)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = rng.choice(["red", "blue", "green"]) + str(rng.randint(0, 99))
        out.append(" ".join(own))
    return out


def test_near_duplicates_are_the_brute_force(spark, prose):
    rng = random.Random(8)
    texts = [prose(k, rng.randint(1, 200)) for k in range(60)] + family(prose, rng, 500, 70, 22) + family(prose, rng, 600, 8, 3) + [None, "", "one", "One", "one two", " one  two "]
    rng.shuffle(texts)
    rows = dict(enumerate(texts))
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    for width in (2, 5):
        got = {r.doc_id: r for r in neardup.near_duplicates(df, 80, width).collect()}
        want, sizes = brute_components(rows, width, 80)
        assert {i: r.component_id for i, r in got.items()} == want
        assert {i: r.n_shingles for i, r in got.items()} == sizes
        assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_blocks_lose_no_link(spark, prose, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(neardup, "BLOCK", 5)
    rng = random.Random(3)
    rows = dict(enumerate(family(prose, rng, 700, 60, 26)))
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, 80, 2).collect()}
    assert got == brute_components(rows, 2, 80)[0]


def test_near_duplicates_bear_odd_rows(spark, odd, empty):
    rows = neardup.near_duplicates(odd, 80, 2).collect()
    assert len(rows) == odd.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[5][0].component_id == 1 and not by[5][0].kept and by[2][0].n_shingles == 0 and by[2][0].kept
    assert by[None][0].kept and by[None][0].component_id is None
    assert neardup.near_duplicates(empty, 80, 2).count() == 0


def test_texts_under_one_identifier_are_told_apart(spark, prose):
    a, b, c = prose(1, 120), prose(2, 120), prose(3, 90)
    near = a + " and one"
    rows = [(1, a), (2, a), (3, b), (3, near), (3, near), (4, c), (4, c.replace(" ", "  ")), (5, c + " more")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(*r, "x") for r in order], "doc_id long, text string, mark string")
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, 80, 5).collect())
        n = lambda t: len(shingles(t, 5))
        assert got == sorted([(1, n(a), 1, True), (2, n(a), 1, False), (3, n(b), 3, True), (3, n(near), 1, False), (3, n(near), 1, False), (4, n(c), 4, True), (4, n(c), 4, True), (5, n(c) + 1, 4, False)])
        left = neardup.without_near_copies(df, 80, 5)
        assert left.columns == df.columns
        kept = sorted((r.doc_id, " ".join(r.text.split())) for r in left.collect())
        assert kept == sorted((i, " ".join(t.split())) for i, t in ((1, a), (3, b), (4, c)))


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(0)
    for share in (0.8, 0.9, 0.97):
        n = 4000
        both = rng.integers(0, 1 << 63, int(2 * n * share / (1 + share)), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, n - len(both), dtype=np.uint64)])) for _ in range(2))
        differ = int(np.bitwise_count(neardup.odd_sketch(neardup.minhash(a)) ^ neardup.odd_sketch(neardup.minhash(b))).sum())
        assert differ <= neardup.sketch_bits_allowed(share)
        estimate = 1 + neardup.SKETCH_BITS / (4 * neardup._N) * np.log(1 - 2 * differ / neardup.SKETCH_BITS)
        assert abs(estimate - share) < 0.15


def brute_copies(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    return sorted((i, max(groups[n]), len(groups[n]), i == max(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for i, t in rows for n in [(t or "").translate(LOWER)])


def test_exact_copies(spark):
    rng = random.Random(1)
    base = ["", None, "É", "é", "A b", "a B", "a b ", "x" * 5000, "x" * 4999 + "Y", "x" * 4999 + "y"]
    rows = [(k, rng.choice(base)) for k in range(300)] + [(k, "HOT text") for k in range(300, 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in contentsort.mark_copies(df, keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == brute_copies(rows)
    kept = sorted(r.doc_id for r in contentsort.without_copies(df, keep="max").collect())
    assert kept == sorted(r[0] for r in brute_copies(rows) if r[3])
    least = sorted(r.doc_id for r in contentsort.without_copies(df, keep="min").collect())
    assert len(least) == len(kept) and max(least) <= 300


def test_ties_and_clashing_names(spark):
    rows = [(1, "A b", "x", "p", 5, 0.5), (1, "a B", "y", "q", 6, 0.5), (None, "c", "z", "r", 7, 0.5), (2, "C", "w", "s", 8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, norm string, _norm string, id long, lead double")
    first = sorted(map(tuple, contentsort.without_copies(df).collect()))
    again = sorted(map(tuple, contentsort.without_copies(df.repartition(3).orderBy("id")).collect()))
    assert first == again and len(first) == 2 and (2, "C", "w", "s", 8, None) in first
    assert contentsort.mark_copies(df).count() == 4


def test_exact_copies_bear_odd_rows(odd, empty):
    assert contentsort.mark_copies(odd).count() == odd.count()
    left = contentsort.without_copies(odd)
    assert left.columns == odd.columns and left.where("doc_id = 5").count() == 1 and left.where("doc_id = 1").count() == 0 and left.where("doc_id is null").count() == 1
    assert left.where(F.coalesce("text", F.lit("")) == "").count() == 1
    assert contentsort.mark_copies(empty).count() == 0 and contentsort.without_copies(empty).count() == 0
