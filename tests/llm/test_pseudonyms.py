import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from frameloom.llm import pseudonyms as P


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(re.sub(r"\D", "", digits))):
        x = int(c) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def mod97(text):
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def run(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in P.pseudonymised(df, key).orderBy("doc_id").collect()]


def card(stem):
    return next(stem + str(k) for k in range(10) if luhn(stem + str(k)))


SAMPLES = {
    "card": [card("441774428035154"), card("4417-7442-8035-154"), card("378282246310 00"), card("601111111111 1111 00")],
    "phone": ["+1 (487) 555-7209", "(212) 555-1212", "212-555-1212", "+49 30 1234567"],
    "ip": ["97.51.17.173", "0.0.0.0", "255.255.255.255"],
    "ssn": ["123-45-6789", "899-99-9999", "001-01-0001", "665-10-1000", "667-10-1000"],
    "email": ["me.joe99@mail4.example.com", "A_b+c%d-e@x.org"],
    "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"],
    "date": ["1984-02-29", "1900/01/01", "31.12.2199", "02/29/1984", "29/02/1984", "31/12/2000"],
}


@pytest.mark.parametrize("kind", sorted(SAMPLES))
def test_values_keep_their_format(spark, kind):
    rows = run(spark, [f"before {x} after." for x in SAMPLES[kind]])
    for old, r in zip(SAMPLES[kind], rows, strict=True):
        assert r.kinds == kind and r.n_found == 1
        new = r.text.removeprefix("before ").removesuffix(" after.")
        assert new != old
        if kind != "ip":
            shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", s)))
            assert shape(new) == shape(old)
        if kind == "card":
            assert luhn(re.sub(r"\D", "", new))
        if kind == "iban":
            assert mod97(new) == 1 and new[:2] == old[:2]
        if kind == "ip":
            assert all(0 <= int(x) <= 255 for x in new.split(".")) and len(new.split(".")) == 4
        if kind == "ssn":
            a, b, c = map(int, new.split("-"))
            assert 1 <= a <= 899 and a != 666 and b > 0 and c > 0
        if kind == "date":
            form = "%Y-%m-%d" if "-" in old else "%d.%m.%Y" if "." in old else "%Y/%m/%d" if old[4] == "/" else "%m/%d/%Y" if int(old[:2]) <= 12 else "%d/%m/%Y"
            day = datetime.datetime.strptime(new, form)
            assert 1900 <= day.year <= 2199


def test_what_does_not_validate_stays(spark):
    texts = ["4417744280351548", "300.1.1.1", "1.2.3.4.5", "000-12-3456", "666-12-3456", "1983-02-29", "2024-13-01", "31/02/2000", "a@b", "GB82 WEST 1234 5698 7654 33", "v1.2.3.4", "12345", "", "no digits here", "x4417744280351547"]
    rows = run(spark, texts)
    assert [r.text for r in rows] == texts and all(r.n_found == 0 and r.kinds == "" for r in rows)


def test_equal_values_stay_linked_and_keys_matter(spark):
    a = card("441774428035154")
    rows = run(spark, [f"{a}, {a}; mail x1@y.org", f"other text {a}!"])
    first = re.findall(r"\d{16}", rows[0].text)
    assert first[0] == first[1] == re.search(r"\d{16}", rows[1].text)[0] and rows[0].kinds == "card,card,email"
    assert run(spark, [f"{a}"], "another")[0].text != run(spark, [f"{a}"])[0].text


def test_permutations_are_one_to_one(spark):
    days = [(datetime.date(1999, 1, 1) + datetime.timedelta(k)).isoformat() for k in range(700)]
    assert len({r.text for r in run(spark, days)}) == 700
    number = spark.range(7 * 11).select(P.permuted_number(F.col("id"), 7, 11, "k", "t").alias("v")).collect()
    assert sorted(r.v for r in number) == list(range(77))
    text = spark.range(1000).select(P.permuted_text(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("v")).collect()
    assert len({r.v for r in text}) == 1000 and all(re.fullmatch(r"\d{3}", r.v) for r in text)
    low = [f"{d:02d}/{m:02d}/1990" for m in (1, 5) for d in range(13, 31)]
    assert len({r.text for r in run(spark, low)}) == len(low)


def test_odd_rows(odd, empty):
    out = P.pseudonymised(odd, "k")
    assert out.columns == [*odd.columns, "n_found", "kinds"] and out.count() == odd.count()
    before = {(r.doc_id, r.text) for r in odd.collect()}
    assert {(r.doc_id, r.text) for r in out.collect()} == before
    assert P.pseudonymised(empty, "k").count() == 0


def test_spellings_stay_linked(spark):
    plain = card("441774428035154")
    grouped = " ".join(plain[k : k + 4] for k in range(0, 16, 4))
    rows = run(spark, [plain, grouped, "1984-02-28", "28.02.1984", "02/28/1984", "28/02/1984", "212-555-1212", "(212) 555-1212", "GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32"])
    same = [re.sub(r"[^0-9A-Z]", "", r.text) for r in rows]
    assert same[0] == same[1] and same[6] == same[7] and same[8] == same[9] and same[0] != plain
    days = {datetime.datetime.strptime(r.text, f).date() for r, f in zip(rows[2:6], ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", "%d/%m/%Y"), strict=True)}
    assert len(days) == 1 and days != {datetime.date(1984, 2, 28)}


def test_cards_and_ibans_before_other_figures(spark):
    plain = card("411111111111111")
    grouped = " ".join(plain[k : k + 4] for k in range(0, 16, 4))
    rows = run(spark, [f"{grouped} 05/27", f"{grouped} 123", f"{plain} 123", "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00 AND MORE", "BE68 5390 0754 7034 PAID"])
    assert [r.kinds for r in rows] == ["card", "card", "card", "iban", "iban", "iban"]
    assert rows[1].text.endswith(" 123") and rows[5].text.endswith(" PAID") and all("5390" not in r.text for r in rows)


def test_clashing_columns_leak_nothing(spark):
    df = spark.createDataFrame([(1, "born 1984-02-28", "own", "x", "y", "z")], "doc_id long, text string, _hits string, hits string, n_found string, kinds string")
    r = P.pseudonymised(df, "k").first()
    assert r["_hits"] == "own" and r["hits"] == "x" and r["n_found"] == 1 and r["kinds"] == "date" and "1984-02-28" not in str(r)


def feistel(number, a, b, key, kind):
    """The rounds of permuted_number, in plain Python."""
    left, right = divmod(number, b)
    noise = lambda i, s: int(hashlib.sha512(f"{key}|{kind}|{i}|{s}".encode()).hexdigest()[:12], 16)
    for i in range(1, 2 * P.ROUNDS + 1):
        left, right = ((left + noise(i, right)) % a, right) if i % 2 else (left, (right + noise(i, left)) % b)
    return left * b + right


def test_rounds_are_those_of_the_network(spark):
    got = spark.range(0, 109_573, 997).select("id", P.permuted_number(F.col("id"), 79, 1387, "key", "date").alias("v")).collect()
    assert all(r.v == feistel(r.id, 79, 1387, "key", "date") for r in got)
