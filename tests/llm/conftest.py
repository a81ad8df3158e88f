"""One Spark session for all tests of this folder."""

import pytest
from pyspark.sql import SparkSession

from tandem.shipping import ship


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return ship(session)


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table from (doc_id, text) pairs, with clashing columns beside."""

    def make(rows, extra=()):
        schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, hash string, n int"
        full = [(d, t, None, "s", None if t is None else len(t), "x", "y", 1) for d, t in rows]
        return spark.createDataFrame(full, schema)

    return make


SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def sf(spark):
    return SF
