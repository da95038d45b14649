"""Fixtures of the training-data operators' tests."""

import importlib.util
from pathlib import Path

import numpy as np
import pytest

# Both folders' files are called conftest; this one gives what the other has.
_spec = importlib.util.spec_from_file_location("tests_conftest", Path(__file__).resolve().parents[1] / "conftest.py")
_above = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_above)
DATA, rows_of = _above.DATA, _above.rows_of

ODD = [
    (1, None, None, None, None, 9), (None, "a b c", "en", "s", 5, 9), (2, "", "en", "s", 0, 9), (2, "", "en", "s", 0, 9), (3, "!!! ???", "de", "s", 7, 9),
    (4, "word " * 60000, "fr", "t", 300000, 9), (5, "The cat sat on the mat. é 漢字 <|endoftext|>\n\tEND", "en", "t", 40, 9), (5, "another text for five", "en", "t", 20, 9),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, repeated, very long and odd rows, and a column that others use too."""
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long, shard long")


@pytest.fixture(scope="session")
def clashing(spark):
    """Columns named like those that operators add or use inside."""
    names = ["__tokens", "__kept", "__size", "__sig1", "__map", "__perhaps", "__d0", "__shard", "key", "row", "h", "id", "label", "size", "a.b"]
    rows = [(k, f"one text of its own, number {k} of some {k * 7} others", "en", "s", 30, *[f"{n}{k}" for n in names]) for k in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def tokenizer():
    from tokenizers import Tokenizer

    from pagequery.llm import words

    return Tokenizer.from_file(words.vocabulary_path())


@pytest.fixture(scope="session")
def ids_of(tokenizer):
    return lambda text, end: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")
