from __future__ import annotations

import random

import pytest

from sitrep.session import importable

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside; a table may have such columns of its own.
CLASHES = "key string, z string, row string, node long, size string, h long, n long, c string, block int"


@pytest.fixture(scope="session", autouse=True)
def library(spark):
    importable(spark)


def words(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(
        "".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(n)
    )


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, blank, very long and repeated texts, ties, clashing names."""
    long = words(1, 60_000)
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n\x0b", "en", "a", 4),
        (4, words(2, 80), "en", "a", 9),
        (5, words(2, 80), "de", None, 9),
        (6, long, "en", "b", len(long)),
        (7, "ß é 漢字 \U0001f600", "de", "b", 7),
        (7, "ß é 漢字 \U0001f600", "de", "b", 7),
        (None, "one two", "fr", "c", 7),
        (8, "<|endoftext|> a b", "fr", "c", None),
    ]
    extra = ("k", "z", "r", 1, "s", 2, 3, "c", 4)
    return spark.createDataFrame([r + extra for r in rows], f"{DOCS}, {CLASHES}")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
