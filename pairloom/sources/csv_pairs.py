"""Text-pair tables from CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.features import normalize_pairs
from pairloom.sources.csv_records import read_records


def _read(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    """All columns as strings, and ``_position``."""
    # Columns are found by header name, so all are read as text first and cast after.
    if multiline:
        df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
        return df.withColumn("_position", F.monotonically_increasing_id())
    return read_records(spark, path)


def _key(df: DataFrame, name: str):
    """The id column, or the order of rows in the files where there is none."""
    return F.col(name).cast("long") if name in df.columns else F.col("_position")


def read_train_pairs(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """(id, question1, question2, is_duplicate), missing-value words as NULL.

    Quoted fields may hold line breaks, and a file is read by many tasks (see
    ``read_records``). ``multiline`` leaves it to Spark's own reader: a file is
    one task, and bytes that are no UTF-8 are replaced instead of kept for the
    filter. Ids that are made up here follow the split of the files: write the
    pairs once before reading them twice, as the plans do.
    """
    df = _read(spark, path, multiline)
    return normalize_pairs(df.select(
        _key(df, "id").alias("id"), "question1", "question2",
        F.col("is_duplicate").cast("int").alias("is_duplicate")))


def read_test_pairs(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """(test_id, position, question1, question2); ``position`` orders repeated ids."""
    df = _read(spark, path, multiline)
    return normalize_pairs(df.select(
        _key(df, "test_id").alias("test_id"), F.col("_position").alias("position"),
        "question1", "question2"))
