import pytest
from llm_texts import prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, nth long, fp long, score double, n long"


def docs(spark, rows):
    """Documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 1, 1, 0.5, 1) for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: docs(spark, rows)


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and repeated texts, a null and a repeated doc_id, other scripts, a very long text."""
    long = prose(5, 30_000)
    rows = [(1, None), (2, ""), (3, "one"), (4, prose(1, 80)), (5, prose(1, 80)), (5, prose(2, 60)), (5, prose(2, 60)), (None, prose(1, 80)), (7, "ÄÖ é 日本語 \U0001f600 " * 30), (8, long), (9, long + " end"), (10, " \n\t "), (11, "a" * 500), (12, "a <|endoftext|> b")]
    return make(rows)
