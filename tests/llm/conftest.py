import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from mountwait.llm.common import prepare  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def llm(spark):
    prepare(spark)
    return spark


@pytest.fixture()
def docs(llm):
    """documents with the given (doc_id, text) rows; an extra column clashes with result names."""
    def make(rows):
        return llm.createDataFrame([(i, t, "en", "s", None if t is None else len(t), i) for i, t in rows],
                                   DOCS + ", score long").repartition(3)
    return make


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "two words"), (5, "é" * 30_000),
       (6, "a b c d e " * 4_000), (7, "\x00 ▁ 中文 😀")]


@pytest.fixture(scope="session")
def odd():
    return ODD


@pytest.fixture(scope="session")
def real():
    """Whole texts of the smallest test table, as (doc_id, text)."""
    import pyarrow.parquet as pq
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])
    return list(zip(*(c.to_pylist() for c in t.columns)))
