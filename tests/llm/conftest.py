import random

import pytest

from riskloom.session import ship_package

DOCS = "doc_id bigint, text string"
#: A column of each name that some operator makes on its way.
CLASHING = "block int, n_words string, hit_words string, items string, component string, score string, c0_ string, bin int, tie string"


@pytest.fixture(scope="session")
def corpus(spark):
    """A function that makes a documents table of (doc_id, text) rows, with further columns if wanted."""
    ship_package(spark)

    def make(rows, clashing=False, parts=3):
        if clashing:
            filler = (7, "a", "b", "c", "d", "e", "f", 1, "g")
            return spark.createDataFrame([(*r, *filler) for r in rows], f"{DOCS}, {CLASHING}").repartition(parts)
        return spark.createDataFrame(rows, DOCS).repartition(parts)

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, repeated rows, a very long text, odd characters."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    prose = " ".join(rng.choice(words) for _ in range(120)) + "."
    return [
        (None, prose), (None, None), (1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, "one"), (5, "one two three four"), (6, prose), (7, prose), (7, prose), (8, long),
        (9, "Ünïcödé ﬁ ½ \U0001f600 \u0301x \x1c \x85 a\u00a0b 한국어"), (10, "\x00 nul \x00"), (11, "a" * 400), (12, "\n\n\n" + prose + "\n" + prose),
    ]
