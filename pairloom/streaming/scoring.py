"""Scoring of arriving pairs: the batch features and model, appended per trigger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pairloom.operators.features import normalize_pairs, pair_features

PAIR_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("question1", T.StringType()),
    T.StructField("question2", T.StringType()),
])


def pair_stream(spark: SparkSession, path: str, files_per_trigger: int = 100, fmt: str = "parquet") -> DataFrame:
    """Pairs from Parquet or CSV files as they arrive in a folder.

    CSV files have the header ``id,question1,question2`` (another one is an
    error) and may hold quoted line breaks, so a file is one task; their
    missing-value words become NULL, as in the batch reader.
    """
    arriving = spark.readStream.schema(PAIR_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
    if fmt == "parquet":
        return arriving.parquet(path)
    if fmt == "csv":
        return normalize_pairs(arriving.csv(path, header=True, quote='"', escape='"', enforceSchema=False, multiLine=True))
    raise ValueError(f"unknown format {fmt!r}")


def score_stream(
    pairs: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, fmt: str = "csv"
) -> StreamingQuery:
    """Score every pair that has arrived, append ``id, prediction``, then stop.

    Features are a function of the row, so no state is kept; the checkpoint
    makes each pair appear once, also after a restart.
    """
    scored = score(pair_features(pairs)).select("id", "prediction")
    return (
        scored.writeStream.format(fmt)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
