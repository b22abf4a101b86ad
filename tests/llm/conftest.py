import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
PROSE = "the quick brown fox jumps over the lazy dog and runs away from here"

#: Names that operators use for columns of their own.
CLASHING = "row _row whole _h _d _g _t _e _n _y _f _id _at _key _size _copies _copy _prefix _last _source _host _path _stays _r _text h fp root n k v c at line place label list score rank copy host keep".split()


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, PROSE, "en", "a", 10, 1, "x"),
        (2, PROSE, "en", "a", 10, 1, "x"),
        (2, PROSE, "en", "a", 10, 1, "x"),
        (3, None, "en", "b", None, None, None),
        (4, "", None, "b", 0, 2, "y"),
        (5, " \n\t\n", "fr", None, 4, 2, "y"),
        (None, PROSE + " now", "en", "a", 10, 1, "x"),
        (7, LONG, "de", "c", 10, 1, "x"),
        (8, "one", "de", "", 3, 1, "x"),
        (9, PROSE.replace("fox", "cat") + "\n" + PROSE, "de", None, 3, 1, "x"),
        (-10, "É it's <|endoftext|> 😀 ß x y", "fr", "c", 3, 1, "x"),
        (11, "AAA!!! " * 50, "en", "a", 3, 1, "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, target string")
    return df.withColumns({c: F.col("target") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def texts(odd):
    return [(r["doc_id"], r["text"]) for r in odd.collect()]
