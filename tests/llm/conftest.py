import pytest


def frame(spark, texts, parts=3):
    """Documents with clashing extra columns, over several partitions."""
    rows = [(i, t, "en", "s", i % 3, 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int, score double").repartition(parts)


@pytest.fixture
def docs_of(spark):
    return lambda texts: frame(spark, texts)
