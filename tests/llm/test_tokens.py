import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frameloom.llm import packing, tokenfiles
from frameloom.llm.eliasfano import EliasFano
from frameloom.llm.tokens import BatchEncoder, default_vocabulary, encoder

PARTS = ["a", "B", "the", " ", "  ", "\n", "'s", "é", "́", "ß", "ΑΣ", "\x01", "12", "!", "###", " \t", " ", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "日本", "😀", "\x1c", "\r\n", "ing"]


def reference(vocabulary, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_vocabulary(vocabulary))
    return [np.array([*x.ids, 2], "<u4") for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("vocabulary", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_gives_the_library_s_ids(vocabulary, prose):
    rng = random.Random(6)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + [prose(k, 300) for k in range(20)] + ["", " "]
    ids, offsets = encoder(default_vocabulary(vocabulary)).encode(pa.array(texts, pa.large_string()), 2)
    for k, want in enumerate(reference(vocabulary, texts)):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == want.tolist()


@pytest.mark.parametrize("vocabulary", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_drops_pieces_and_stays_right(vocabulary, prose):
    rng = random.Random(8)
    codes = BatchEncoder(default_vocabulary(vocabulary), 150)
    for _ in range(25):
        texts = [prose(rng.randint(0, 5), 40), *("".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(20))]
        held = set(codes.slots)
        ids, offsets = codes.encode(pa.array(texts, pa.large_string()), 2)
        assert not held or held & set(codes.slots)
        for k, want in enumerate(reference(vocabulary, texts)):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == want.tolist()


@given(st.lists(st.integers(0, 1 << 40), max_size=700))
@settings(max_examples=40, deadline=None)
def test_elias_fano_round_trip_and_select(values):
    values = sorted(values)
    coded = EliasFano.from_bytes(EliasFano.of(np.array(values, np.uint64)).to_bytes())
    assert len(coded) == len(values) and coded.all().tolist() == values
    assert [coded[k] for k in range(0, len(values), 7)] == values[::7]


def test_elias_fano_is_near_its_bound():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 50_000))
    size = len(EliasFano.of(ends).to_bytes())
    assert size < len(ends) * (2.5 + np.log2(ends[-1] / len(ends))) / 8 < 8 * len(ends) / 4


def test_files_give_back_every_document(spark, odd, empty):
    manifest = tokenfiles.write_token_files(odd, default_vocabulary("word_bpe_49k.json"))
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    want, at = [], 0
    for r, ids in zip(rows, reference("word_bpe_49k.json", [r.text for r in rows]), strict=True):
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted((tuple(r) for r in tokenfiles.read_token_files(manifest).collect()), key=lambda r: r[1])
    assert got == want
    shard = tokenfiles.Shard(manifest.orderBy("shard").first().path)
    assert [len(shard.document(k)) for k in range(len(shard))] == [x[2] for x in want][: len(shard)]
    assert tokenfiles.read_token_files(tokenfiles.write_token_files(empty, default_vocabulary("word_bpe_49k.json"))).count() == 0


def spread(counts):
    return [k for k, n in enumerate(counts) for _ in range(n)]


def fewest(lengths, capacity):
    """The fewest sequences, by trying everything."""
    best = len(lengths)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= lengths[k] and rooms[j] not in rooms[:j]:
                go(k + 1, rooms[:j] + [rooms[j] - lengths[k]] + rooms[j + 1 :])
        go(k + 1, rooms + [capacity - lengths[k]])

    go(0, [])
    return best


@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
@settings(max_examples=300, deadline=None)
def test_reduction_keeps_an_optimum_and_plans_hold_all_pieces(lengths):
    counts = np.bincount(lengths, minlength=21)
    fixed, rest = packing.reduce_by_dominance(counts, 20)
    held = sum(n for _, n in fixed)
    left = sorted(spread(rest), reverse=True)
    assert held + (fewest(left, 20) if left else 0) == fewest(sorted(lengths, reverse=True), 20)
    groups = packing.plan(counts, 20)
    assert all(sum(p) <= 20 for p, _ in groups)
    assert sorted(x for p, n in groups for x in p * n) == sorted(lengths)


def test_reduction_passes_over_pieces_and_fixes_most():
    rng = np.random.default_rng(4)
    counts = np.bincount(np.minimum(rng.geometric(0.004, 20_000), 1023), minlength=1025)
    counts[1] += 3  # tiny pieces must not end it
    fixed, rest = packing.reduce_by_dominance(counts, 1024)
    assert rest.sum() < 0.8 * counts.sum()
    assert sum(n for _, n in packing.plan(counts, 1024)) <= sum(n for _, n in packing.best_fit(counts, 1024))
    triple, left = packing.reduce_by_dominance(np.bincount([60, 30, 10, 22, 45]), 100)
    assert ((60, 30, 10), 1) in triple and left.sum() == 0


def best_fit_one_by_one(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= x), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((capacity if fit is None else fit) - x)
    return len(rooms)


@given(st.lists(st.integers(1, 30), max_size=200))
@settings(max_examples=60, deadline=None)
def test_counted_best_fit_is_best_fit(lengths):
    groups = packing.best_fit(np.bincount(lengths, minlength=31) if lengths else np.zeros(31, int), 30)
    assert sum(n for _, n in groups) == best_fit_one_by_one(lengths, 30)


def check_packing(rows, texts, capacity):
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in texts.items():
        ids, at = reference("byte_bpe_50k.json", [text])[0], 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert k == 0 or r.length == capacity
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_places_every_piece_once(spark, prose, empty):
    rng = random.Random(2)
    texts = {k: prose(k, rng.choice([0, 3, 40, 90, 400])) for k in range(120)} | {200: None, 201: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = packing.packed(df, default_vocabulary("byte_bpe_50k.json"), 256).collect()
    used = check_packing(rows, texts, 256)
    assert -(-sum(r.length for r in rows) // 256) <= used <= best_fit_one_by_one([r.length for r in rows], 256)
    assert packing.packed(empty, default_vocabulary("byte_bpe_50k.json"), 256).count() == 0


def test_packing_bears_odd_rows(odd):
    rows = packing.packed(odd, default_vocabulary("byte_bpe_50k.json"), 1024).collect()
    assert sum(r.piece == 0 for r in rows) == odd.count() and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
