import os
import sys
import tempfile

import numpy as np
import pytest
from pyspark import SparkConf
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[8]")
    if not SparkConf().get("spark.checkpoint.dir", None):
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="ckpt-"))
    session = (
        builder
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture
def rng():
    return np.random.default_rng(5)


@pytest.fixture
def vectors(spark):
    """An (id, x) table from an array, in a given number of partitions."""

    def make(x, partitions=4):
        rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
        return spark.createDataFrame(rows, "id LONG, x ARRAY<DOUBLE>").repartition(partitions)

    return make
