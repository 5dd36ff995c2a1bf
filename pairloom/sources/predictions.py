"""Prediction files: headerless ``id,label`` lines, appended."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pairloom.operators.rows import row_index


def prediction_rows(scored: DataFrame, key: str = "id") -> DataFrame:
    return scored.selectExpr(f"{key} AS id", "CAST(prediction AS INT) AS prediction")


def counter_rows(scored: DataFrame, key: str = "id") -> DataFrame:
    """Predictions under a generated 0-based counter in key order."""
    numbered = row_index(scored.select(key, "prediction"), key, "counter")
    return numbered.selectExpr("counter AS id", "CAST(prediction AS INT) AS prediction")


def append_predictions(rows: DataFrame, path: str) -> None:
    """Append; running it again appends the rows again."""
    rows.select("id", "prediction").write.mode("append").csv(path, header=False)
