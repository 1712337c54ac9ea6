import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

DOC_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs in every column, empty and long texts, repeated rows, ties, clashing extra columns."""
    words = " ".join(f"word{n % 97}" for n in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again", "en", "a", 1),
        (1, "The quick brown fox jumps over the lazy dog again", "en", "a", 1),
        (2, "the quick brown fox jumps over the lazy dog again", None, None, None),
        (3, None, None, "b", 2),
        (4, "", "en", "b", 0),
        (5, " \t\n", "en", "a", 3),
        (6, words, "en", "c", len(words)),
        (7, "x", "en", "\u00e9", 1),
        (None, "a row without id that says something short", "en", "a", 1),
        (None, None, None, None, None),
        (9007199254740993, "password = \"abcdefgh1\" \u00e9\u4e2d\U0001f600 <|endoftext|>", "en", "a", 1),
    ]
    extra = [(*r, f"s{n}", n, n * 2, "k", n) for n, r in enumerate(rows)]
    return spark.createDataFrame(extra, DOC_COLUMNS + ", shard string, size long, fp long, key string, slot long")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_COLUMNS)
