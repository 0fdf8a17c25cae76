import pytest

#: Rows that every text operator must take: nulls, empty and very long texts, repeated rows.
ODD = [(1, None), (2, ""), (3, "one word"), (3, "one word"), (4, "lorem ipsum dolor " * 20_000), (None, "no id at all"), (5, " \t\n "), (6, "é\U0001f642漢 \x1c\x85"), (7, "<|endoftext|> </s>[INST]")]


@pytest.fixture(scope="session")
def odd(spark):
    """ODD, with extra columns of clashing names."""
    rows = [(i, t, "x", "y", 1, "z", 2) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, spans string, score int, kept string, task int")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
