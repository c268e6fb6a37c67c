import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from edge_cases import EDGE  # noqa: E402


@pytest.fixture
def docs_of(spark):
    """A documents table of (doc_id, text) pairs, with columns whose names the operators use themselves."""

    def make(rows, partitions=3):
        extra = [(i, t, "en", "src1", len(t or ""), "x", 1.5, True) for i, t in rows]
        schema = ("doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, score double, kept boolean")
        return spark.createDataFrame(extra, schema).repartition(partitions)

    return make


@pytest.fixture
def edge_docs(docs_of):
    """Nulls, empty, blank, very long, unbroken, repeated and id-less documents."""
    return docs_of(EDGE)


@pytest.fixture
def no_docs(docs_of, spark):
    return spark.createDataFrame([], docs_of([(1, "a")]).schema)
