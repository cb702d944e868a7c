import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, empty and long texts, copies, repeated rows and odd columns."""

    def make(*texts):
        rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def corpus(spark, sf_dir):
    """(doc_id, text) of the smallest table."""
    return dict(map(tuple, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()))
