import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def documents(spark):
    """A function from texts (or (id, text) or (id, text, source)) to a documents table."""

    def make(*texts):
        rows = []
        for i, t in enumerate(texts):
            doc_id, text, source = (*t, "s")[:3] if isinstance(t, tuple) else (i, t, "s")
            rows.append((doc_id, text, "en", source, None if text is None else len(text)))
        return spark.createDataFrame(rows, DOCS)

    return make


#: Texts that every operator must take: null, empty, blank, very long, repeated, with odd characters.
ODD = [None, "", "   \n\t ", "word " * 40_000, "x" * 200_000, "same text here", "same text here", "\x00   é 😀\nß\r\n", "a@b.cc " * 300]


@pytest.fixture(scope="session")
def odd(documents):
    return documents(*ODD, (None, "no id"), (3, "an id twice"))
