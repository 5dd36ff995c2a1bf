"""Pair features for training and scoring: one narrow select, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.constants import BASIC3
from pairloom.functions.similarity import common_words, edit_sigmoid_of_folded, tfidf_cosine
from pairloom.functions.text import folded, is_decodable, na_to_null, tfidf_tokens_of_folded, whitespace_tokens


def normalize_pairs(pairs: DataFrame) -> DataFrame:
    """Missing-value words to NULL on both sides; all other columns kept."""
    return pairs.withColumns({q: na_to_null(F.col(q)) for q in ("question1", "question2")})


def decodable_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs whose texts are both valid UTF-8; the label stays with its row."""
    return pairs.filter(is_decodable(F.col("question1")) & is_decodable(F.col("question2")))


def pair_features(pairs: DataFrame) -> DataFrame:
    """(id, cosine, edit_sig, len1, len2, common, is_duplicate).

    The label is NULL where the input has none, so training and scoring share
    this one definition.
    """
    label = F.col("is_duplicate") if "is_duplicate" in pairs.columns else F.lit(None)
    q1, q2 = F.col("question1"), F.col("question2")
    low1, low2 = F.col("low1"), F.col("low2")
    # Lower case is a column, so cosine and edit distance make it once.
    tokens = pairs.select(
        "id", folded(q1).alias("low1"), folded(q2).alias("low2"), label.cast("int").alias("is_duplicate"),
        whitespace_tokens(q1).alias("words1"), whitespace_tokens(q2).alias("words2"),
    )
    return tokens.select(
        "id",
        tfidf_cosine(tfidf_tokens_of_folded(low1), tfidf_tokens_of_folded(low2)).alias("cosine"),
        edit_sigmoid_of_folded(low1, low2).alias("edit_sig"),
        F.size("words1").alias("len1"),
        F.size("words2").alias("len2"),
        common_words(F.col("words1"), F.col("words2")).alias("common"),
        "is_duplicate",
    )


def feature_set(features: DataFrame, names: tuple[str, ...] = BASIC3, label: bool = True) -> DataFrame:
    """Named features, with the label for training."""
    return features.select("id", *names, *(["is_duplicate"] if label else []))
