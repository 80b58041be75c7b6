import os

import pytest
from pyspark.sql import types as T

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

# Names that the operators use themselves, so that a mix-up would show.
CLASHING = ("id", "key", "score", "term", "word", "at", "leaf", "fp", "component", "block", "rest")
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASHING]])


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang[, source]]) with clashing extra columns."""
    def build(rows):
        full = []
        for r in rows:
            doc_id, text, lang, source = (*r, None, None)[:4]
            full.append((doc_id, text, lang, source, None if text is None else len(text),
                         *["x"] * len(CLASHING)))
        return spark.createDataFrame(full, SCHEMA)
    return build


@pytest.fixture(scope="session")
def sf(spark):
    if not os.path.isdir(SF):
        pytest.skip("driver tables not present")
    return SF
