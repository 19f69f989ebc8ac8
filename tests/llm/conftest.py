import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text, lang, source)."""

    def make(rows, extra=None):
        df = spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], DOCS)
        for name in extra or ():
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit(f"own {name}"))
        return df

    return make


ODD = [
    (1, None, "en", "s0"),
    (2, "", "en", "s1"),
    (3, "   \n\n  ", None, None),
    (None, "some words without an id at all", "en", "s2"),
    (4, "one", "en", "s3"),
    (5, "long " * 30_000, "en", "s4"),
    (6, "日本語 text ￭ 😀", "en", "s5"),
    (7, "same text in two rows\nand a line", "en", "s6"),
    (7, "same text in two rows\nand a line", "en", "s6"),
    (8, "same text in two rows\nand a line", "en", "s7"),
]


@pytest.fixture(scope="session")
def odd(docs):
    return docs(ODD, ["k", "id", "drop", "lines_removed", "rate", "cdf", "mix_key", "mix_copy", "gone", "ident", "shard", "blob", "rules", "size", "counts"])


@pytest.fixture(scope="session")
def empty(docs):
    return docs([])
