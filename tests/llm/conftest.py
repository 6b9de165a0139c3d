import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__))]

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, kept boolean"
LINE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def passage(seed: int, n: int) -> str:
    """n words that no other seed has."""
    return " ".join(f"w{seed}x{k}" for k in range(n))


def cases() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named like results."""
    long_text = "\n".join(passage(7000 + k, 12) for k in range(3000))
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "!!! ??? ###", "en", None),
        (5, LINE, "en", "a"), (6, LINE, None, "a"), (7, LINE + " nu", "en", "b"), (7, LINE + " nu", "en", "b"),
        (None, LINE, "en", "a"), (None, None, None, None), (8, long_text, "en", "a"), (9, long_text + "\nend", "en", "a"),
        (10, "\n".join([LINE] * 8), "en", "a"), (11, passage(11, 60), "en", "a"), (12, passage(11, 60) + " more", "en", "a"),
        (13, "one two", "de", "b"), (14, "ÄÖÜ straße Éa Kelvin İstanbul", "de", "b"), (15, "x " * 400, "en", "c"),
        (16, "Under the MIT License under the MIT License.", "en", "c"), (17, "a\n\n\nb\n\nc", "en", "c"),
        (18, "<|endoftext|> café 漢字 １２ don't we'll", "en", "c"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), 99, 0.5, None) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    """The cases as a table, in two partitions."""
    return spark.createDataFrame(cases(), DOCS).repartition(2).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
