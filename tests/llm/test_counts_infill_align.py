import bisect
import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from frameloom.llm import alignment, infilling, tokencounts
from frameloom.llm.tokenmodels import PieceEncoder
from frameloom.llm.tokens import default_vocabulary

from .test_tokens import PARTS

A, B, W = (default_vocabulary(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
SCHEMA = "doc_id long, text string"


def mixed(n, seed, longest=30):
    rng = random.Random(seed)
    return ["".join(rng.choice([*PARTS, "▁", "  ", "word"]) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def library_counts(path, texts):
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        return [len(x) for x in SentencePieceProcessor(model_file=path).encode(texts)]
    from tokenizers import Tokenizer

    return [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [A, B, W])
def test_counts_are_the_library_s(spark, prose, path):
    texts = [*mixed(400, 3), *(prose(k, 200) for k in range(20)), "", " "]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    for entries in (tokencounts.FREQUENT, 5):  # most pre-tokens in the first tier, or few
        got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencounts.token_counts(df, path, 100, entries=entries).collect()}
        assert got == {k: (len(t.encode()), n, n > 100) for k, (t, n) in enumerate(zip(texts, library_counts(path, texts), strict=True))}


def test_first_tier_answers_without_the_encoder(spark, prose):
    df = spark.createDataFrame([(k, prose(k, 300)) for k in range(10)], SCHEMA)
    table = tokencounts.frequent_lengths(df, W)
    count = tokencounts.Counter(W)
    count.counts(pa.array([prose(k, 300) for k in range(10)], pa.large_string()), table)
    assert count.missed == 0 and 0 < len(table[0]) <= tokencounts.FREQUENT
    assert sum(map(tokencounts._sampled, range(1 << 12))) == 16 + 8 * 8


def test_cache_drops_pieces_and_counts_stay_right(prose):
    count = tokencounts.Counter(W, 60)
    for k in range(30):
        texts = [prose(k, 50), *mixed(5, k)]
        assert count.counts(pa.array(texts, pa.large_string()), None).tolist() == library_counts(W, texts)


def test_counts_bear_odd_and_no_rows(spark, odd, empty):
    rows = odd.withColumn("n_tokens", F.lit("x")).withColumn("piece", F.lit(1))
    got = tokencounts.token_counts(rows, W).collect()
    assert got and sorted(r.n_tokens for r in got) == sorted(library_counts(W, [r.text or "" for r in odd.collect()]))
    assert {r.doc_id: r.over_limit for r in got}[7] and sum(r.doc_id == 5 for r in got) == 2
    assert tokencounts.token_counts(empty, W).count() == 0


def brute_infill(i, text, plain=10, spm=20):
    h = [int(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    p, q = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:p], text[p:q], text[q:]
    if h[3] % 100 < spm:
        return n, "spm", p, q - p, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", p, q - p, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_infilling_cuts_where_brute_force_does(spark, odd, empty, monkeypatch):
    texts = [*mixed(300, 5), "ab<", "x<P>y", "<S", "é" * 40_000 + "日本" * 9_000, "😀" * 20_000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], SCHEMA).repartition(3).unionByName(odd.select("doc_id", "text"))
    rows = infilling.fill_in_middle(df.withColumn("h1", F.lit(1)).withColumn("output", F.lit("x"))).withColumn("back", infilling.restored(F.col("output"), F.col("form"))).collect()
    want = collections.Counter((r.doc_id, *brute_infill(r.doc_id, r.text or ""), r.text or "") for r in df.collect())
    assert collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in rows) == want
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert infilling.fill_in_middle(empty).count() == 0


@pytest.mark.parametrize("unit", ["character", "word", "line"])
@pytest.mark.parametrize("size", [1, 3, 64])
def test_chunks_count_and_place_units_alike_at_every_size(unit, size):
    rng = random.Random(size)
    texts = ["".join(rng.choice("ab é\n日 ") for _ in range(rng.randint(0, 50))) for _ in range(60)]
    starts = {
        "character": lambda t: list(range(len(t))),
        "word": lambda t: [k for k in range(len(t)) if k == 0 or t[k - 1] in " \n" and t[k] not in " \n"],
        "line": lambda t: [k for k in range(len(t)) if k == 0 or t[k - 1] == "\n"],
    }[unit]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    chunks = infilling.Chunks(data, offsets, unit, size)
    assert chunks.units.tolist() == [len(starts(t)) for t in texts]
    for share in (0.0, 0.3, 0.99, 1.0):
        rank = (chunks.units * share).astype(np.int64)
        want = [o + len(t[: [*starts(t), len(t)][k]].encode()) for t, o, k in zip(texts, offsets[:-1].tolist(), rank.tolist(), strict=True)]
        assert chunks.places(rank).tolist() == want


def brute_groups(texts):
    """For each text, the groups of ids between offsets at which tokens of both sides end."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    spelled = [PieceEncoder(x, plain=True).token_bytes() for x in (A, B)]
    out = []
    for text in texts:
        sides = [one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)] if text else [[], []]
        if any(b"".join(s[k] for k in ids) != b" " + text.encode() for s, ids in zip(spelled, sides, strict=True)):
            out.append(([], [], []))
            continue
        ends = [np.cumsum([len(s[k]) for k in ids]).tolist() for s, ids in zip(spelled, sides, strict=True)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [[ids[bisect.bisect_right(at, low) : bisect.bisect_right(at, high)] for ids, at in zip(sides, ends, strict=True)] for low, high in zip([0, *cuts], cuts, strict=False)]
        out.append((*sides, groups))
    return out


def check_alignment(df, rows):
    texts = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    found = brute_groups([t for _, t in texts])
    counts = collections.Counter(x for _, _, groups in found for x in {(p, q) for a, b in groups for p in a for q in b})
    best = collections.defaultdict(int)
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    want = collections.Counter()
    for (i, _), (a, b, groups) in zip(texts, found, strict=True):
        links = [(p, q) for x, y in groups for p in x for q in y]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want[i, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), shown] += 1
    assert collections.Counter(tuple(r) for r in rows) == want
    return want


def test_alignment_is_brute_force_s(spark, prose, odd, empty, monkeypatch):
    texts = [*mixed(150, 9, 60), *(prose(k, 80) for k in range(15)), "a▁b", "<|endoftext|> here", "<s> x </s>", "ɲ" * 30, "aaaa" * 50]
    df = spark.createDataFrame([(k if k % 7 else None, t) for k, t in enumerate(texts)], SCHEMA).repartition(3).unionByName(odd.select("doc_id", "text"))
    clashing = df.withColumns({c: F.lit(0) for c in ("row", "t", "g", "pair", "last", "n_links")})
    want = check_alignment(df, alignment.alignment(clashing, A, B).collect())
    assert any(x[3] and x[1] > x[3] for x in want) and any(x[3] == 0 for x in want)
    assert alignment.alignment(empty, A, B).count() == 0
    # lists of few groups, links given out in many rows, counts joined by shuffle
    monkeypatch.setattr(alignment, "SEGMENT", 3)
    monkeypatch.setattr(alignment, "HELD", 5)
    monkeypatch.setattr(alignment, "MOST_BROADCAST", 0)
    check_alignment(df, alignment.alignment(df, A, B).collect())
    digests = {r.groups for r in alignment.aligned(df, A, B, shown="sha256").where("last").collect()}
    assert digests == {hashlib.sha256(x[7].encode()).hexdigest() if x[7] else "" for x in want}


def test_alignment_shuffles_no_tokens(spark, monkeypatch):
    plans, own = {}, alignment.saved
    monkeypatch.setattr(alignment, "saved", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and own(df, name))
    df = spark.createDataFrame([(1, "one two"), (2, None), (None, "two")], SCHEMA)
    check_alignment(df, alignment.alignment(df, A, B).collect())
    assert "Exchange" not in plans["aligned"] and "Exchange" in plans["pairs"]
