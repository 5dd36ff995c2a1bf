from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


PAIRS = "id long, question1 string, question2 string, is_duplicate int"


@pytest.fixture(scope="session")
def pairs(spark):
    """A few pairs, one of them missing and one without any word."""
    rows = [
        (10, "How old is the sun ?", "How old is our sun ?", 1),
        (11, "What is AI ?", None, 0),
        (13, "!!!", "***", 0),
        (17, "the the cat", "a cat, the cat", 0),
        (40, "Cannot do 3.5 e.g. this...", "cannot do 3,500 this", 1),
    ]
    return spark.createDataFrame(rows, PAIRS)
