"""Text pairs made of the sample tables, whole rows and whole texts.

Training pairs come from ``documents``: copies and reworded copies (duplicates),
unrelated and containing texts, and missing ones (not duplicates). Test pairs
come from ``conversations``: each message with the following one or with a
reworded copy of itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.features import normalize_pairs

# Ids of messages: conversation number, then turn.
TURNS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arriving_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream, whether it is one file or a folder of files."""
    schema = table(spark, sf_dir, name).schema
    # A pattern, because the source takes a plain path for a folder.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _reworded(text: Column, id_: Column) -> Column:
    return F.concat(F.repeat(F.lit("well "), (id_ % 9).cast("int")), text, F.lit(" ?"))


def following_texts(documents: DataFrame) -> DataFrame:
    """(id, next_text): the text of document id + 1, NULL where the pair of id doesn't read it; each document keeps its row."""
    id_ = F.col("doc_id") - 1
    unread = (id_ % 4).isin(0, 1) | (id_ % 8 == 3)
    return documents.select(id_.alias("id"), F.when(~unread, F.col("text")).alias("next_text"))


def following_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, next_text): the text of the turn after, NULL where the pair of the turn doesn't read it; each turn keeps its row."""
    turn = F.col("turn") - 1
    unread = (F.col("conv_id") + turn) % 3 == 0
    return turns.select("conv_id", turn.alias("turn"), F.when(~unread, F.col("text")).alias("next_text"))


def pairs_of_documents(documents: DataFrame, following: DataFrame) -> DataFrame:
    """Raw pairs; ``documents`` may be a stream, ``following`` is a table."""
    after = following_texts(following)
    # Both sides have the table's rows, so they meet in a shuffle.
    both = documents.select(F.col("doc_id").alias("id"), "text").join(after.hint("merge"), "id", "left")
    id_, text = F.col("id"), F.col("text")
    missing = F.array(*(F.lit(w) for w in ("", "NaN", "null", "N/A", None)))
    second = (
        F.when(id_ % 4 == 0, text)
        .when(id_ % 4 == 1, _reworded(text, id_))
        .when(id_ % 4 == 2, F.col("next_text"))
        .when(id_ % 8 == 3, F.get(missing, (F.floor(id_ / 8) % 5).cast("int")))
        .otherwise(F.concat(F.col("next_text"), F.lit(" "), text))
    )
    return both.select(
        "id", text.alias("question1"), second.alias("question2"),
        F.when(id_ % 4 <= 1, 1).otherwise(0).alias("is_duplicate"))


def raw_train_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pairs_of_documents(docs, docs)


def train_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, question1, question2, is_duplicate)."""
    return normalize_pairs(raw_train_pairs(spark, sf_dir))


def test_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, question1, question2), without a label."""
    turns = table(spark, sf_dir, "conversations")
    both = turns.select("conv_id", "turn", "text").join(following_turns(turns).hint("merge"), ["conv_id", "turn"], "left")
    step = F.col("conv_id") + F.col("turn")
    second = F.when(step % 3 == 0, _reworded(F.col("text"), step)).otherwise(F.col("next_text"))
    return normalize_pairs(both.select(
        (F.col("conv_id") * TURNS + F.col("turn")).alias("id"),
        F.col("text").alias("question1"), second.alias("question2")))
