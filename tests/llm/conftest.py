import random

import pytest

WORDS = "the of and to in is was for on that by with from this be are it an as at river stone paper light engine market garden signal copper winter harbour letter".split()


@pytest.fixture(scope="session")
def prose():
    """prose(seed, words): invented text of so many words with some lines and sections."""

    def make(seed, words):
        rng = random.Random(seed)
        out = []
        for k in range(words):
            out.append(rng.choice(WORDS) + str(rng.randint(0, 40)) * (rng.random() < 0.5))
            out.append("\n\n" if k % 47 == 46 else "\n" if k % 19 == 18 else " ")
        return "".join(out).strip()

    return make


#: Rows that every operator of documents must bear: nulls, empty and blank texts, repeats, ties, extra and clashing columns.
ODD_ROWS = [
    (1, "One two three four five six seven", "en", "a", 33, "x"),
    (2, None, None, None, None, None),
    (3, "", "en", "b", 0, "y"),
    (4, " \n\t ", "de", "a", 4, ""),
    (5, "ONE TWO THREE FOUR FIVE SIX SEVEN", "en", "c", 33, None),
    (5, "ONE TWO THREE FOUR FIVE SIX SEVEN", "en", "c", 33, None),
    (6, "é ß 日本 \x00 😀 idiot", "fr", None, 9, "z"),
    (7, "word " * 30_000, "en", "a", 150_000, "long"),
    (None, "no identifier here at all", "en", "b", 5, "q"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, SCHEMA).withColumnRenamed("bucket", "hub")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
