"""Losses, accuracies and data profiles as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.constants import BATCH_SIZE
from pairloom.functions.scoring import log_loss
from pairloom.functions.text import whitespace_tokens
from pairloom.operators.rows import minibatches


def true_class_probability(label: Column, p0: Column, p1: Column) -> Column:
    return F.when(label == 0, p0).otherwise(p1)


def cross_entropy(scored: DataFrame) -> DataFrame:
    """One row: mean of -ln p of the true class, over columns p0, p1, is_duplicate."""
    p = true_class_probability(F.col("is_duplicate"), F.col("p0"), F.col("p1"))
    return scored.agg(F.avg(log_loss(p)).alias("cross_entropy"))


def accuracy(scored: DataFrame) -> DataFrame:
    """One row: share of rows whose prediction equals the label."""
    hit = (F.col("prediction") == F.col("is_duplicate")).cast("double")
    return scored.agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"))


def outcome_counts(scored: DataFrame) -> DataFrame:
    """Rows per label and prediction."""
    return scored.groupBy("is_duplicate", "prediction").agg(F.count("*").alias("n"))


def batch_accuracy(scored: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """(batch_id, n, accuracy) per mini-batch of consecutive rows."""
    hit = (F.col("prediction") == F.col("is_duplicate")).cast("double")
    return minibatches(scored, "id", batch_size).groupBy("batch_id").agg(
        F.count("*").alias("n"), F.avg(hit).alias("accuracy"))


def macro_batch_accuracy(scored: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Mean accuracy over full batches; the short last batch is left out."""
    full = batch_accuracy(scored, batch_size).filter(F.col("n") == batch_size)
    return full.agg(F.count("*").alias("batches"), F.avg("accuracy").alias("accuracy"))


def pair_profile(pairs: DataFrame) -> DataFrame:
    """One row of counts, missing texts, labels and token lengths."""
    sized = pairs.select(
        "is_duplicate", "question1", "question2",
        *(F.size(whitespace_tokens(F.col(f"question{i}"))).alias(f"n{i}") for i in (1, 2)),
    )
    lengths = [
        f(F.col(f"n{i}")).alias(f"{name}_len{i}")
        for i in (1, 2)
        for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg))
    ]
    return sized.agg(
        F.count("*").alias("n_pairs"),
        F.count_if(F.col("question1").isNull()).alias("null1"),
        F.count_if(F.col("question2").isNull()).alias("null2"),
        F.sum("is_duplicate").alias("n_duplicate"),
        *lengths,
    )


def vector_profile(vectors: DataFrame) -> DataFrame:
    """One row: how many vectors, their widths, and how many are zero."""
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return vectors.select(F.size("vec").alias("w"), F.sqrt(norm).alias("norm")).agg(
        F.count("*").alias("n_vectors"), F.min("w").alias("min_width"), F.max("w").alias("max_width"),
        F.count_if(F.col("norm") == 0).alias("n_zero"), F.avg("norm").alias("mean_norm"))
