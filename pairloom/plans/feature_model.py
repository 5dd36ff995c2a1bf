"""Train on pair features, validate on the last rows, score the test pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.constants import BASIC3
from pairloom.operators.features import decodable_pairs, pair_features
from pairloom.operators.metrics import accuracy, outcome_counts
from pairloom.operators.regression import apply_regression, fit_regression
from pairloom.operators.rows import keep_last, split_by_position
from pairloom.sources.predictions import prediction_rows
from pairloom.sources.tables import stage


@dataclass(frozen=True)
class FeatureRun:
    model: PipelineModel
    holdout: DataFrame
    predictions: DataFrame

    def accuracy(self) -> DataFrame:
        return accuracy(self.holdout)

    def outcomes(self) -> DataFrame:
        return outcome_counts(self.holdout)


def run_feature_model(train: DataFrame, test: DataFrame, columns: tuple[str, ...] = BASIC3) -> FeatureRun:
    """One feature pass over the training pairs, written once; all fits read that table.

    ``test`` may repeat ids if it has a ``position``: then the last row counts.
    Rows with undecodable texts are left out on both sides.
    """
    features = stage(pair_features(decodable_pairs(train)), "features")
    test = decodable_pairs(test)
    fit_part, holdout = split_by_position(features)
    model = fit_regression(fit_part.select(*columns, "is_duplicate"), columns)
    if "position" in test.columns:
        test = keep_last(test, "test_id", "position").withColumnRenamed("test_id", "id")
    scored = apply_regression(model, pair_features(test))
    return FeatureRun(model, apply_regression(model, holdout), prediction_rows(scored.select(F.col("id"), "prediction")))
