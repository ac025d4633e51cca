import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of and to in is that for it was on are as with at be this have from or one had by word but not".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "ed"]) for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids."""
    rng = random.Random(3)
    rows = [(k, prose(rng, rng.randint(60, 200)), rng.choice(["en", "xx"]), f"s{k % 3}", 0) for k in range(40)]
    long = prose(rng, 30_000)
    rows += [(100, None, None, None, None), (None, "no id " * 30, "en", "s0", 1), (101, "", "en", "s1", 0),
             (102, long, "en", "s1", 1), (103, long, "en", "s2", 1), (104, " \n\t ", None, "s2", 3),
             (7, rows[7][1], "en", "s1", 0), rows[8], rows[8], (105, "é ü\x1cx\r\ny  z 😀", "xx", "s1", 9)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def wide(docs, *names):
    """``docs`` with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F
    return docs.select("*", *[F.lit(f"own {n}").alias(n) for n in names if n not in docs.columns])
