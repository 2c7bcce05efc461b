import pytest

from weekloom.llm import shipped

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, part int, text_crc32 string"


@pytest.fixture(autouse=True)
def modules(spark):
    shipped(spark)


@pytest.fixture
def documents(spark):
    """Documents from texts, with ids from 0 and extra columns whose names operators use too."""
    def make(texts, ids=None, lang="en", source="src1"):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, lang, source, None if t is None else len(t), 0.5, 1, "x") for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, DOCS)
    return make
