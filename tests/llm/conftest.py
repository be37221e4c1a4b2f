import pytest
from pyspark.sql import functions as F

from llm.cases import EDGE

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, spans string, slot string"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang) rows, with extra columns of clashing names."""
    from deskpark.llm.common import ship

    ship(spark)

    def of(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1]), 9.5, 7, "x", "y") for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(3, F.col("source"), F.col("text"))

    return of


@pytest.fixture
def edge(make):
    return make(EDGE)


@pytest.fixture
def empty(make):
    return make([])
