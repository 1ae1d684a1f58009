import pytest

TOKENIZER = "byte_bpe_50k.json"


@pytest.fixture(scope="session")
def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path(TOKENIZER)


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents with columns that clash with names used inside the operators."""

    def make(rows, ids=None):
        ids = range(len(rows)) if ids is None else ids
        data = [(k, t, "x", 1.5, [1], "y") for k, t in zip(ids, rows, strict=True)]
        return spark.createDataFrame(data, "doc_id long, text string, id string, score double, found array<int>, digest string").repartition(3)

    return make
