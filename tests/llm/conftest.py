import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    return lambda text: WORD.findall(text or "")


@pytest.fixture(scope="session")
def make(spark):
    """Rows (doc_id, text[, source]) -> documents."""

    def build(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else f"s{i % 4}", len(r[1] or "")) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return build


@pytest.fixture(scope="session")
def table(spark):
    return lambda name, folder=FOLDER: spark.read.parquet(f"{folder}/{name}.parquet")


LONG = " ".join(f"w{i * i % 7919}" for i in range(60_000))

#: Nulls, empty and very long texts, white space alone, ties, repeated rows, odd characters.
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b "), (4, LONG), (5, "one two three"), (5, "one two three"), (6, "one two three"),
    (7, "x" * 50_000), (8, "a\n\nb\n a b c d e f g h \n"), (9, "é🙂 ß   \x1c end"), (None, "no id here at all, friends"),
    (None, None), (10, "Same line of some length\nother"), (11, "same LINE of some length \nmore\nother"), (12, "\n"), (5, "another text, same id"),
    (13, "<p>&amp;<|endoftext|> $$$ ***"),
]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)


@pytest.fixture(scope="session")
def odd_rows():
    return list(ODD)


@pytest.fixture(scope="session")
def none(make):
    return make([])
