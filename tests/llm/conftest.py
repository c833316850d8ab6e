import pytest

LONG = " ".join(f"w{i % 5003}x{i % 7}" for i in range(120_000))
#: doc_id, text: null, empty, blank, repeated rows, one id with two texts, a null id, special strings, a very long text.
ODD = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one two three four five six"), (3, "one two three four five six"), (4, "another text"), (4, "with the same id"),
    (None, "a row without an id"), (5, "</s>[INST] <|endoftext|> ok [/INST]"), (6, "word"), (7, "ünï çødé 語 🎉 \u2003 x\x1cy"), (8, "aaaa aaaaaaaa aaa\n\n\naaaa"), (9, LONG), (10, LONG), (11, "  two  spaces \n"),
]
CLASH = "cast(7 as int) as n, 'x' as key, 1.5D as score, 2L as start, 3L as length, 4L as n_words, 'y' as grp, 5L as failed, 6 as kind, 'z' as ids, true as held_out"


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents, with further columns whose names clash with the operators' own."""
    return spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("doc_id", "text", *CLASH.split(", ")).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def table(spark):
    return lambda name, sf="/root/testdata/sf0.001": spark.read.parquet(f"{sf}/{name}.parquet")


@pytest.fixture(scope="session")
def rows_of():
    """(doc_id, text) of a documents table, as a list."""
    return lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
