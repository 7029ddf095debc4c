import base64
import collections
import hashlib
import itertools
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from frameloom.llm import fingerprints, mixing, warc


def test_targets_fill_up_by_weight():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 1.5, 2) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.targets([10, 1000], [3, 1], 1.5, 2) == pytest.approx([20, 1495])
    assert mixing.targets([0, 0], [3, 1], 1.5, 2) == [0, 0] and mixing.targets([], [], 1.5, 2) == []


def cheapest(sizes, members, quotas, most):
    """(words taken, cost) of the best mix of tiny patterns, by trying everything."""
    best = (-1, 0)
    spaces = []
    for n, own in zip(sizes, members, strict=True):
        spaces.append([x for x in itertools.product(range(most * n + 1), repeat=len(own)) if sum(x) <= most * n])
    for pick in itertools.product(*spaces):
        got = collections.Counter()
        for own, x in zip(members, pick, strict=True):
            for s, a in zip(own, x, strict=True):
                got[s] += a
        if all(got[s] <= q for s, q in enumerate(quotas)):
            cost = sum(sum(max(0, sum(x) - r * n) for r in range(1, most)) for n, x in zip(sizes, pick, strict=True))
            taken = sum(got.values())
            if (taken, -cost) > best:
                best = (taken, -cost)
    return best


def test_flow_takes_most_words_at_least_cost():
    rng = random.Random(5)
    for _ in range(60):
        sizes = [rng.randint(0, 2) for _ in range(3)]
        members = [sorted(rng.sample(range(3), rng.randint(1, 2))) for _ in range(3)]
        quotas = [rng.randint(0, 4) for _ in range(3)]
        given = mixing.flow(sizes, members, quotas, 2)
        got = collections.Counter()
        for p, own in enumerate(given):
            assert set(own) <= set(members[p]) and sum(own.values()) <= 2 * sizes[p]
            got.update(own)
        assert all(got[s] <= q for s, q in enumerate(quotas))
        cost = sum(max(0, sum(own.values()) - sizes[p]) for p, own in enumerate(given))
        assert (sum(got.values()), -cost) == cheapest(sizes, members, quotas, 2)


def test_mix_meets_targets_and_reruns_agree(spark, prose):
    rng = random.Random(7)
    rows = [(k, prose(k, rng.randint(0, 60)), rng.choice(["s0"] * 6 + ["s1", "s2", None])) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = {r.doc_id: r for r in mixing.mixed(df).collect()}
    again = {r.doc_id: r for r in mixing.mixed(df.repartition(7)).collect()}
    assert first == again
    by = collections.defaultdict(list)
    for r in first.values():
        assert 0 <= r.taken <= 2 * r.size and r.size == len(re.findall(r"[^\x20\x09-\x0D]+", rows[r.doc_id][1]))
        by[r.members[0]].append(r)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5 and own[0].source_size == sum(r.size for r in own)
        assert sum(r.taken not in (0, r.size, 2 * r.size) for r in own) <= 1
    assert sum(own[0].target for own in by.values()) == pytest.approx(1.5 * sum(r.size for r in first.values()))


def test_mix_of_overlapping_sources(spark):
    rows = [(k, "w " * 10, ["a"] if k % 3 == 0 else ["b", "a"] if k % 3 == 1 else ["b"]) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, groups array<string>")
    out = mixing.mixed(df, sources=F.col("groups"), weights=(1, 2)).collect()
    aims = dict((r.members[0], r.target) for r in out)
    assert sum(r.taken for r in out) == pytest.approx(sum(aims.values()), abs=1)


def test_rows_are_repeated_as_the_mix_takes_them(spark, prose):
    rng = random.Random(9)
    rows = [(k % 150, prose(k, rng.randint(1, 60)), rng.choice(["s0"] * 6 + ["s1", None]), "x", k) for k in range(300)]  # two texts under an identifier
    rows += [(None, prose(k, 20), "s1", "y", k) for k in range(300, 320)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, h long")
    out = mixing.repeated(df)
    assert out.columns == df.columns
    count = collections.Counter(tuple(r) for r in out.collect())
    assert set(count) <= set(rows) and set(count.values()) <= {1, 2}
    size = lambda t: len(t.split())
    aims = {r.members[0]: r.target for r in mixing.mixed(df).collect()}
    for source, aim in aims.items():
        got = sum(n * size(r[1]) for r, n in count.items() if r[2] == source)
        assert abs(got - aim) <= 60


def test_mix_bears_odd_rows(odd, empty):
    assert mixing.repeated(empty).count() == 0 and mixing.repeated(odd).columns == odd.columns
    rows = mixing.mixed(odd).collect()
    assert len(rows) == odd.count() and all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mixed(empty).count() == 0


def test_archives_round_trip(spark):
    rng = random.Random(2)
    bodies = ["", None, "<p>é\r\n\r\nWARC/1.1</p>", "<p>hot</p>"] + [f"<p>{k}</p>" * k for k in range(8)]
    rows = [(k, f"http://x/{k}", rng.choice(bodies)) for k in range(200)] + [(3, "http://again", "<p>hot</p>"), (900, None, "z" * 3_000_000), (None, "http://none", "<p>hot</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_bytes", F.lit("clash"))
    archives = warc.write_archives(pages, warc.resolved(warc.headers(pages)))
    got = warc.read_archives(archives).collect()
    first = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", i)
    want = []
    for i, _, h in rows:
        data, target = (h or "").encode(), first[h or ""]
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if target == i else "revisit", None if target == i else target))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in columns)) for r in got)
    texts = {r.page_id: r.body for r in got if r.record_type == "response"}
    assert texts[900] == "z" * 3_000_000 and archives.agg(F.sum("n_records")).first()[0] == len(rows)
    whole = warc.with_bodies(warc.read_archives(archives)).collect()
    assert sorted((str(r.page_id), r.body) for r in whole) == sorted((str(i), h or "") for i, _, h in rows)
    small = {(r.page_id, r.record_type) for r in warc.resolved(warc.headers(pages), least=5).collect() if r.payload_bytes < 5}
    assert small and all(kind == "response" for _, kind in small)
    nothing = pages.limit(0)
    assert warc.read_archives(warc.write_archives(nothing, warc.resolved(warc.headers(nothing)))).count() == 0


def brute_edit(rows):
    """(identifier, edited text) with rows in falling order of identifiers."""
    ordered = sorted(rows, key=lambda r: -r[0])
    for k, (i, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        cut = len(text) // 3
        yield i, text, text[: len(text) - cut] + after[:cut], after


def test_fingerprints_follow_the_contract(spark, prose):
    rng = random.Random(4)
    rows = [(k, rng.choice([prose(k, rng.randint(1, 300)), None, "", "ab", "é😀" * 5, "same text here"])) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprint_with_edits(df).collect()}
    assert len(got) == 150
    for i, text, edited, after in brute_edit(rows):
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fingerprints.Tree(text).print and r.edited_fingerprint == fingerprints.Tree(edited).print
        assert r.near_edited == fingerprints.likeness(r.fingerprint, r.edited_fingerprint) and 0 <= r.near_next <= 1
        assert (r.near_edited == 1.0) or text != edited
        assert r.near_next == fingerprints.likeness(r.fingerprint, fingerprints.Tree(after).print)
        if text != edited:
            where = r.first_difference
            assert text.encode()[:where] == edited.encode()[:where] or len(edited.encode()) < where


def test_single_and_odd_rows(spark, odd, empty):
    one = fingerprints.fingerprint_with_edits(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert fingerprints.fingerprint_with_edits(odd).count() == odd.count()
    assert fingerprints.fingerprint_with_edits(empty).count() == 0


def test_branches_locate_edits(spark):
    before = spark.createDataFrame([(1, "a\nb\n\nc\nd"), (2, "same"), (3, "one\ntwo\nthree")], "doc_id long, text string")
    after = spark.createDataFrame([(1, "a\nb\n\nc\nX"), (2, "same"), (3, "zero\none\ntwo\nthree")], "doc_id long, text string")
    found = fingerprints.changed_branches(fingerprints.merkle_nodes(before), fingerprints.merkle_nodes(after)).collect()
    place = lambda r: (r.doc_id, r.level, r.node_before, r.node_after)
    own = [(1, "root", 0), (1, "section", 1), (1, "paragraph", 4)]
    want = {(i, level, n, None) for i, level, n in own} | {(i, level, None, n) for i, level, n in own}
    want |= {(3, level, n, None) for level, n in (("root", 0), ("section", 0))} | {(3, level, None, n) for level, n in (("root", 0), ("section", 0), ("paragraph", 0))}
    assert {place(r) for r in found} == want  # the line put in is the one paragraph that differs
    assert [r.start_before for r in found if r.level == "paragraph" and r.node_before is not None] == [7]


def leaves(text):
    """The leaves of every line of a text, by brute force: words with their white space, a leaf ends with one in four."""
    out = []
    for line in text.split("\n"):
        own = []
        for word in re.findall(r"\s*\S+\s*|\s+", line):
            for x in word if len(word) > 64 else [word]:
                own.append(x)
                if xxhash.xxh3_64_intdigest(x) % 4 == 0 or len(own) == 32:
                    out.append(tuple(own))
                    own = []
        if own:
            out.append(tuple(own))
    return out


def test_likeness_is_the_share_of_common_leaves(prose):
    rng = random.Random(8)
    kanji = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(300))
    pairs = [(kanji, "字" + kanji), ("one two three", "one two three four"), ("a b c d e", "z a b c d e"), ("x " * 500, "y " + "x " * 500), ("", "a"), (" ", "\n")]
    for k in range(40):
        text = prose(k, 200).replace("\n", " " if k % 2 else "\n")
        words = text.split(" ")
        pairs.append((text, "inserted " + text))
        pairs.append((text, text.replace(" ", "  ", 1)))
        pairs.append((text, " ".join(w for x in words for w in ([x] if rng.random() > 0.02 else ["inserted", x]))))
        pairs.append((text, " ".join(w for w in words if rng.random() > 0.05)))
    off = []
    for a, b in pairs:
        x, y = set(leaves(a)), set(leaves(b))
        assert len(fingerprints.leaf_digests(a)[0]) == len(leaves(a)) and len(set(fingerprints.leaf_digests(a)[0].tolist())) == len(x)
        got, want = fingerprints.likeness(fingerprints.Tree(a).print, fingerprints.Tree(b).print), len(x & y) / max(len(x | y), 1)
        off.append(abs(got - want))
        assert off[-1] < 1e-9 if len(x | y) <= 64 else off[-1] < 0.3
    assert sum(off) / len(off) < 0.06
    # one word put in, or a space doubled, leaves texts alike
    assert all(fingerprints.likeness(fingerprints.Tree(a).print, fingerprints.Tree(b).print) > 0.9 for k in (6, 7) for a, b in pairs[k::4])


def test_equal_roots_are_equal_texts(prose):
    rng = random.Random(3)
    texts = {"".join(rng.choice(["a", "b", " ", "\n", "  ", "\t", "é"]) for _ in range(rng.randint(0, 6))) for _ in range(3000)}
    assert len({fingerprints.Tree(t).root for t in texts}) == len(texts)
