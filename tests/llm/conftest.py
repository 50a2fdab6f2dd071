import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def lspark():
    spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(lspark):
    def make(texts, **more):
        """Documents from texts, or (id, text) pairs."""
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
        return lspark.createDataFrame(
            [(i, t, more.get("lang", "en"), "src0", None if t is None else len(t)) for i, t in rows], DOCS)
    return make
