import pytest

CLASHES = ["row", "key", "code", "line", "component", "n_words", "start", "length", "sequence_id", "lost", "_d", "doc_key", "gone_lines", "_d_id", "_d_hash", "_l_id", "_q_gone", "_s_id", "doc_hash"]


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path


@pytest.fixture
def documents(spark):
    """A DataFrame of (doc_id, text, source, lang), with more columns whose names operators use inside."""

    def make(rows):
        rows = [(*r, *["src", "en"][len(r) - 2 :])[:4] for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
        from pyspark.sql import functions as F

        return df.withColumns({c: F.lit("x") for c in CLASHES}).repartition(3)

    return make
