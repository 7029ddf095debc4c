"""Private numbers, dates and addresses replaced by keyed pseudonyms of the same format, with DataFrame functions only.

A match is validated, then permuted within its format by a Feistel network whose rounds are keyed SHA-2 digests. Only the
value itself is permuted, its separators are put back: equal values get equal pseudonyms in every document and spelling,
different values different ones, and nothing but the key undoes it.

- card: 13 to 19 digits, also in groups, that pass the Luhn check; the last digit is computed anew
- iban: passes mod 97; the country stays and the check digits are computed anew
- ssn: ddd-dd-dddd in the ranges that are given out; stays in them
- phone: + and 8 to 15 digits, or three groups of 3, 3 and 4 digits; the first digit after + stays
- ip: four numbers up to 255
- date: yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy or mm/dd/yyyy, else dd/mm/yyyy, from 1900 to 2199; stays a date of its form.
  Days up to the 12th stay such days, so that mm/dd and dd/mm are never confused
- email: the letters and digits before the @; the domain stays

A card or IBAN followed by other digits or capitals is found without them. What does not validate is left as it is, and so is
all other text. A null text stays null and has no matches; very long texts are read whole; repeated rows stay alike; an
empty table gives no rows. Columns n_found and kinds of the caller are replaced, all others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Java patterns, tried in this order at each place.
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9][A-Za-z0-9.-]{0,250}\.[A-Za-z]{2,24}(?![A-Za-z0-9])"
_DATE = r"(?<![\w./-])(?:(?:19|20|21)\d\d([-/])\d\d\1\d\d|\d\d\.\d\d\.(?:19|20|21)\d\d|\d\d/\d\d/(?:19|20|21)\d\d)(?![\w/-]|\.\d)"
_IP = r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w-]|\.\d)"
_IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
_SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
_PHONE = r"(?<![\w+])(?:\+[1-9](?:[ .-]?\(?\d{1,4}\)?){2,7}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[-. ]\d{3}[-. ]\d{4})(?![\w-])"
_CARD = r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"
PATTERN = "|".join((_EMAIL, _DATE, _IP, _IBAN, _SSN, _PHONE, _CARD))
KINDS = ("email", "date", "ip", "iban", "ssn", "phone", "card")

#: 1900-01-01 to 2199-12-31: 109,573 days, which is 79 times 1,387.
_FIRST_DAY, _DAYS_A, _DAYS_B = "1900-01-01", 79, 1387


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), f)[0]


def _each(s: Column, f) -> Column:
    """f(character, position from 1) of every character, as an array; empty for an empty text."""
    return F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda k: f(F.substring(s, k, F.lit(1)), k)))


def _luhn(reverse: Column, doubled: int) -> Column:
    """The Luhn sum of reversed digits; doubled: remainder by 2 of the positions that count twice."""

    def worth(c: Column, k: Column) -> Column:
        d = c.cast("int")
        return F.when(k % 2 == doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(_each(reverse, worth), F.lit(0), lambda a, x: a + x)


def _noise(key: str, kind: str, i: Column, s: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), s), 512)


def _shifted(s: Column, noise: Column) -> Column:
    """s with its digits and letters moved on within their kind by two hexadecimal digits of noise each."""

    def moved(c: Column, k: Column) -> Column:
        code, by = F.ascii(c), F.conv(F.substring(noise, 2 * k - 1, F.lit(2)), 16, 10).cast("int")
        turn = lambda first, size: F.char(F.lit(first) + (code - first + by) % size)
        return F.when(c.between("0", "9"), turn(48, 10)).when(c.between("A", "Z"), turn(65, 26)).when(c.between("a", "z"), turn(97, 26)).otherwise(c)

    return F.coalesce(F.array_join(_each(s, moved), ""), F.lit(""))


def permuted_text(s: Column, key: str, kind: str) -> Column:
    """A permutation of texts up to 128 characters that keeps every character's kind: digit, capital, small letter, other."""
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), half).alias("l"), F.substring(s, half + 1, F.length(s)).alias("r"))
    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    done = F.aggregate(rounds, start, lambda a, i: F.struct(a["r"].alias("l"), _shifted(a["l"], _noise(key, kind, i, a["r"])).alias("r")))
    return F.concat(done["l"], done["r"])


def permuted_number(x: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A permutation of the whole numbers from 0 to a * b - 1."""

    def turn(s: Column, i: Column) -> Column:
        by = lambda other, size: F.conv(F.substring(_noise(key, kind, i, other.cast("string")), 1, 12), 16, 10).cast("long") % size
        left = (s["l"] + F.when(i % 2 == 1, by(s["r"], a)).otherwise(0)) % a
        right = (s["r"] + F.when(i % 2 == 0, by(s["l"], b)).otherwise(0)) % b
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).cast("long").alias("r"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(2 * ROUNDS)), start, turn)
    return done["l"] * b + done["r"]


def _day(m: Column, form: str) -> Column:
    return F.to_date(F.try_to_timestamp(m, F.lit(form)))


def _date(m: Column, form: str, key: str) -> Column:
    first = F.lit(_FIRST_DAY).cast("date")
    step = lambda x: permuted_number(x, _DAYS_A, _DAYS_B, key, "date")
    late = lambda x: F.dayofmonth(F.date_add(first, x.cast("int"))) > 12
    # walks on to a day of the same part of the month; each step ends it with probability 0.4 or more
    walked = lambda n: F.aggregate(F.sequence(F.lit(1), F.lit(80)), step(n), lambda x, _: F.when(late(x) == late(n), x).otherwise(step(x)))
    new = _let(F.datediff(_day(m, form), first).cast("long"), walked)
    return F.date_format(F.date_add(first, new.cast("int")), form)


def _plain(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9A-Za-z]", "")


def _respaced(m: Column, new: Column) -> Column:
    """m with its letters and digits replaced in turn by the characters of new."""

    def joined(own: Column) -> Column:
        put = lambda c, k: F.when(c.rlike("[0-9A-Za-z]"), F.substring(own, F.length(_plain(F.substring(m, F.lit(1), k))), F.lit(1))).otherwise(c)
        return F.when(F.length(own) == F.length(m), own).otherwise(F.array_join(_each(m, put), ""))

    return _let(new, joined)


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    new = permuted_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    return _respaced(m, _let(new, lambda x: F.concat(x, ((10 - _luhn(F.reverse(x), 1) % 10) % 10).cast("string"))))


def _mod97(s: Column) -> Column:
    """The remainder by 97 of letters and digits, letters being 10 to 35."""

    def next_(a: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(_each(s, lambda c, _: c), F.lit(0), next_)


def _iban(m: Column, key: str) -> Column:
    country, rest = F.substring(m, 1, 2), F.substring(_plain(m), F.lit(5), F.length(m))
    new = permuted_text(rest, key, "iban")
    checked = lambda x: F.concat(country, F.lpad((98 - _mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"), x)
    return _respaced(m, _let(new, checked))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = _parts(m, "-", 3)
    place = F.when(area > 666, area - 2).otherwise(area - 1)  # 898 areas
    new = permuted_number((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, "ssn")
    head = F.floor(new / 9999)
    area = F.floor(head / 99)
    area = F.when(area >= 665, area + 2).otherwise(area + 1)
    return F.format_string("%03d-%02d-%04d", area.cast("long"), (head % 99 + 1).cast("long"), (new % 9999 + 1).cast("long"))


def _ip(m: Column, key: str) -> Column:
    parts = _parts(m, ".", 4)
    number = ((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3]
    new = permuted_number(number, 1 << 16, 1 << 16, key, "ip")
    return F.concat_ws(".", *[(F.shiftright(new, k).bitwiseAND(255)).cast("string") for k in (24, 16, 8, 0)])


def _phone(m: Column, key: str) -> Column:
    digits, keep = _digits(m), F.when(m.startswith("+"), 1).otherwise(0)
    return _respaced(m, F.concat(F.substring(digits, F.lit(1), keep), permuted_text(F.substring(digits, keep + 1, F.length(digits)), key, "phone")))


def _parts(m: Column, mark: str, n: int) -> list[Column]:
    return [F.split_part(m, F.lit(mark), F.lit(k)).cast("long") for k in range(1, n + 1)]


#: Forms of dates and what they look like; the first that gives a day counts.
_FORMS = (("yyyy-MM-dd", r"^\d{4}-"), ("yyyy/MM/dd", r"^\d{4}/"), ("dd.MM.yyyy", r"^\d\d\."), ("MM/dd/yyyy", r"^(?:0\d|1[0-2])/"), ("dd/MM/yyyy", r"^\d\d/"))


def _first(candidates: list[Column], valid) -> Column:
    """The first candidate that is valid; null if none is."""
    out = F.when(valid(candidates[0]), candidates[0])
    for c in candidates[1:]:
        out = out.when(valid(c), c)
    return out


def _card_in(m: Column) -> Column:
    """The card that a match begins with: all of it, or its usual grouping, or its first digits up to a separator."""
    short = [F.regexp_extract(m, f"^({x})[ -]", 1) for x in (r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", r"\d{4}[ -]\d{6}[ -]\d{5}", r"\d{13,18}")]
    return _first([m, *short], lambda c: F.length(_digits(c)).between(13, 19) & (_luhn(F.reverse(_digits(c)), 0) % 10 == 0))


def _iban_in(m: Column) -> Column:
    """The IBAN that a match begins with: all of it, or without up to four of its last groups."""
    candidates = [m]
    for _ in range(4):
        candidates.append(F.regexp_extract(candidates[-1], "^(.*) [A-Z0-9]{1,4}$", 1))

    def valid(c: Column) -> Column:
        plain = _plain(c)
        return F.length(plain).between(15, 34) & (_mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1)

    return _first(candidates, valid)


def _read(m: Column) -> Column:
    """What a match is once validated: kind (a date with its form; null for nothing of these), text and the tail left alone."""
    like = lambda pattern: m.rlike(f"^(?:{pattern})$")
    area, group, serial = _parts(m, "-", 3)
    form = F.lit(None).cast("string")
    for name, look in reversed(_FORMS):
        form = F.when(m.rlike(look) & _day(m, name).isNotNull(), f"date {name}").otherwise(form)
    told = lambda kind, text=m: F.struct(kind.alias("kind"), text.alias("text"), F.coalesce(F.substring(m, F.length(text) + 1, F.length(m)), F.lit("")).alias("tail"))
    named = lambda name, text: told(F.when(text.isNotNull(), name), F.coalesce(text, m))
    out = F.when(m.contains("@"), told(F.lit("email")))
    out = out.when(like(_DATE), told(form))
    out = out.when(like(_IP), told(F.when(F.greatest(*_parts(m, ".", 4)) <= 255, "ip")))
    out = out.when(like(_SSN), told(F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), "ssn")))
    out = out.when(like(_CARD), named("card", _card_in(m)))
    out = out.when(like(_IBAN), named("iban", _iban_in(m)))
    return out.otherwise(told(F.when(like(_PHONE) & F.length(_digits(m)).between(8, 15), "phone")))


def _pseudonym(kind: Column, m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    out = F.when(kind == "email", F.concat(permuted_text(F.substring(m, F.lit(1), at - 1), key, "email"), F.substring(m, at, F.length(m))))
    for form, _ in _FORMS:
        out = out.when(kind == f"date {form}", _date(m, form, key))
    for name, make in (("ip", _ip), ("ssn", _ssn), ("card", _card), ("iban", _iban), ("phone", _phone)):
        out = out.when(kind == name, make(m, key))
    return out.otherwise(m)


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with text replaced, and n_found (validated matches) and kinds (of them, in order, joined by commas)."""
    name = "hits"
    while name in docs.columns:  # a name that no column has
        name += "_"
    whole, found = F.col(text), F.col(name)
    may = whole.rlike("[0-9@]")  # no match is without one of these
    rows = docs.withColumn(name, F.when(may, F.transform(F.regexp_extract_all(whole, F.lit(PATTERN), F.lit(0)), _read)))
    between = F.split(whole, PATTERN, -1)
    new = F.transform(found, lambda x: F.concat(_pseudonym(x["kind"], x["text"], key), x["tail"]))
    new = F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    kinds = F.transform(F.filter(found, lambda x: x["kind"].isNotNull()), lambda x: F.split_part(x["kind"], F.lit(" "), F.lit(1)))
    return rows.select(
        *[F.when(may & (F.size(found) > 0), new).otherwise(whole).alias(text) if c == text else F.col(c) for c in docs.columns if c not in ("n_found", "kinds")],
        F.when(may, F.size(kinds)).otherwise(0).cast("long").alias("n_found"), F.when(may, F.array_join(kinds, ",")).otherwise("").alias("kinds"),
    )
