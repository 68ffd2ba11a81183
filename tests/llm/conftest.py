from __future__ import annotations

import random

import pytest

#: Columns with names that operators use themselves, to be carried or ignored.
EXTRA = "rid long, name string, n int, fp string, rejected string, score string, sha string, level string"


def words(seed: int, n: int, kind: int = 0) -> str:
    r = random.Random(seed)
    ends = (("ing", "the", "er"), ("ung", "ich", "sch"))[kind]
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 4))) + r.choice(ends) for _ in range(n))


def odd_texts() -> list[str | None]:
    """Nulls, empty, white space, very long, equal, and texts of several scripts."""
    long = words(1, 20_000)
    return [None, "", "", " \n\t ", "one", "a b", long, long, long + " x", words(2, 300), words(2, 300), "日本語 テキスト", "é́ ü <|endoftext|> it's 12.50, ok...", "x" * 5000, None]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows with null and repeated ids, repeated rows, and extra columns with clashing names."""
    texts = odd_texts()
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, None]
    rows = [(i, t, "en" if i and i % 2 else "de" if i else None, "s", 1, 7, "n", 1, "f", "r", "s", "h", "l") for i, t in zip(ids, texts, strict=True)]
    rows += [rows[4], rows[4], (6, "another text under an id in use", *rows[0][2:])]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")
