"""Word-vector tables (token, vec)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Pretrained vectors from Parquet, as (token, vec array<float>)."""
    return spark.read.parquet(path).select("token", F.col("vec").cast("array<float>").alias("vec"))


def vectors_by_rank(vocabulary: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(token, vec): spread a table of vectors over a vocabulary by rank.

    One rank in eleven stays without a vector, so that missing words occur.
    """
    count = embeddings.count()
    slot = F.pmod(F.col("idx"), F.lit(count + count // 10))
    ranked = vocabulary.select("token", slot.cast("long").alias("vec_id"))
    return ranked.join(embeddings.select("vec_id", F.col("embedding").alias("vec")), "vec_id").select("token", "vec")
