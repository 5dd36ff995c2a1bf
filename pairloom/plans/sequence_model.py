"""Vocabulary, order-aware sequence vectors and a decision head, end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.constants import SEQUENCE_LENGTH, VOCABULARY_CAP
from pairloom.operators.features import decodable_pairs
from pairloom.operators.heads import DenseHead, PairHead, load_head, run_head, save_head
from pairloom.operators.metrics import accuracy, outcome_counts
from pairloom.operators.rows import keep_last, split_by_position
from pairloom.operators.vectors import decayed_encoding, pair_sides
from pairloom.operators.vocabulary import build_vocabulary, encode_long, pair_tokens, vector_matrix
from pairloom.sources.predictions import prediction_rows
from pairloom.sources.tables import last_version, new_version, read_table, stage, write_table


@dataclass(frozen=True)
class SequenceModel:
    """What a fitted run needs to score other pairs: the matrix of word vectors (token, idx, vec) and the head."""

    matrix: DataFrame
    head: PairHead
    width: int
    decay: float

    def score(self, test: DataFrame, rule: str = "blank") -> DataFrame:
        """One prediction for each id; of repeated ids the last row counts."""
        pairs = by_id(test)
        sides = sequence_sides(pairs, self.matrix, self.width, rule, self.decay)
        return prediction_rows(with_all_pairs(run_head(self.head, sides), pairs))

    def save(self, path: str) -> None:
        """Keep a model with a dense head under a folder; until all of it is written, ``load`` gives the one kept before."""
        spark = self.matrix.sparkSession
        with new_version(spark, path) as folder:
            write_table(self.matrix, f"{folder}/matrix")
            save_head(self.head, spark, f"{folder}/head")
            write_table(spark.createDataFrame([(self.width, self.decay)], "width int, decay double"), f"{folder}/shape")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SequenceModel:
        folder = last_version(spark, path)
        shape = read_table(spark, f"{folder}/shape").first()
        return cls(read_table(spark, f"{folder}/matrix"), load_head(spark, f"{folder}/head"), shape["width"], shape["decay"])


@dataclass(frozen=True)
class SequenceRun:
    """``sides`` and ``labels`` are what the head was fitted on."""

    head: PairHead
    holdout: DataFrame
    predictions: DataFrame
    vocabulary: DataFrame
    model: SequenceModel
    sides: DataFrame
    labels: DataFrame

    def accuracy(self) -> DataFrame:
        return accuracy(self.holdout)

    def outcomes(self) -> DataFrame:
        return outcome_counts(self.holdout)


def by_id(test: DataFrame) -> DataFrame:
    """Test pairs with a column ``id``: rows of the CSV reader (test_id, position) keep the last of each id."""
    if "test_id" not in test.columns:
        return test
    return keep_last(test, "test_id", "position").withColumnRenamed("test_id", "id").drop("position")


def with_all_pairs(scored: DataFrame, pairs: DataFrame, *columns: str) -> DataFrame:
    """One row per pair: a pair without any token has no vectors and is no duplicate."""
    rows = pairs.select("id", *columns).join(scored, "id", "left")
    return rows.withColumn("prediction", F.coalesce("prediction", F.lit(0)))


def sequence_sides(
    pairs: DataFrame, matrix: DataFrame, width: int, rule: str = "blank", decay: float = 0.9,
    length: int = SEQUENCE_LENGTH,
) -> DataFrame:
    """Order-aware vectors (id, left, right) of both texts, of twice the word-vector width."""
    return pair_sides(decayed_encoding(encode_long(pairs, matrix, rule, length), width, decay), 2 * width)


def run_sequence_model(
    train: DataFrame, test: DataFrame, vectors: DataFrame, width: int,
    test_rule: str = "blank", decay: float = 0.9, cap: int = VOCABULARY_CAP,
) -> SequenceRun:
    """Fit the dense head on the first rows, check it on the rest, score the test pairs."""
    train = stage(decodable_pairs(train), "train")  # ids may be generated by the reader
    vocabulary = stage(build_vocabulary(pair_tokens(train), cap), "vocabulary")
    matrix = stage(vector_matrix(vocabulary, vectors, width), "matrix").select("token", "idx", "vec")
    sides = stage(sequence_sides(train, matrix, width, decay=decay), "sides")
    labels = train.select("id", "is_duplicate")
    fit_labels, holdout_labels = split_by_position(labels)
    head = DenseHead.fit(sides, fit_labels)
    held = sides.join(holdout_labels.select("id"), "id", "left_semi")
    holdout = with_all_pairs(run_head(head, held), holdout_labels, "is_duplicate")
    model = SequenceModel(matrix, head, width, decay)
    test = stage(decodable_pairs(test), "test")
    return SequenceRun(head, holdout, model.score(test, test_rule), vocabulary, model, sides, fit_labels)
