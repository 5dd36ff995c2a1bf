"""Two-class softmax regression on named features.

``fit_regression`` is the production fit (MLlib). ``logistic_gd`` is the
auditable one: full-batch descent from zero, one aggregate job per step; only
weights and the cost of a step reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.constants import BASIC3, MIN_PROBABILITY, REGRESSION_EPOCHS, REGRESSION_RATE
from pairloom.functions.scoring import argmax2, linear_score, softmax2


@dataclass(frozen=True)
class LinearModel:
    """Weights of the score whose softmax against zero is p(duplicate)."""

    columns: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float
    means: tuple[float, ...] = ()
    scales: tuple[float, ...] = ()
    costs: tuple[float, ...] = field(default=(), compare=False)

    def score(self, df: DataFrame) -> DataFrame:
        """Add score, p0, p1 and prediction; other columns are kept."""
        w, b = list(self.weights), self.bias
        if self.means:
            # Standardising is folded into the weights: w.(x-m)/s = (w/s).x - sum(w.m/s).
            w = [x / s for x, s in zip(self.weights, self.scales, strict=True)]
            b = self.bias - sum(x * m for x, m in zip(w, self.means, strict=True))
        scored = df.withColumn("score", linear_score(self.columns, w, b))
        p0, p1 = softmax2(F.lit(0.0), F.col("score"))
        return scored.withColumns({"p0": p0, "p1": p1}).withColumn(
            "prediction", argmax2(F.col("p0"), F.col("p1")))

    def parameters(self, df: DataFrame) -> DataFrame:
        """The model as a table of named values."""
        rows = [*zip(self.columns, self.weights, strict=True), ("bias", self.bias)]
        return df.sparkSession.createDataFrame(rows, "name string, value double")

    def cost_curve(self, df: DataFrame) -> DataFrame:
        rows = list(enumerate(self.costs, start=1))
        return df.sparkSession.createDataFrame(rows, "epoch int, cost double")


def _multiplicity(df: DataFrame) -> Column:
    """How often a row counts: column ``n`` of a collapsed table, else once."""
    return F.col("n").cast("double") if "n" in df.columns else F.lit(1.0)


def collapse_rows(df: DataFrame, columns: Sequence[str], label: str = "is_duplicate") -> DataFrame:
    """Equal (features, label) rows once, with their number: the sums stay the same.

    Copies of a pair, however many, cost one row in each later pass.
    """
    return df.groupBy(*columns, label).agg(F.count("*").alias("n"))


def standard_scales(df: DataFrame, columns: Sequence[str]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Means and population deviations; a constant column keeps scale 1."""
    n = _multiplicity(df)
    means = df.agg(*(F.sum(n * F.col(c)) / F.sum(n) for c in columns)).first()
    off = [F.pow(F.col(c) - F.lit(m), 2) for c, m in zip(columns, means, strict=True)]
    scales = df.agg(*(F.sqrt(F.sum(n * o) / F.sum(n)) for o in off)).first()
    return tuple(means), tuple(s if s > 0 else 1.0 for s in scales)


def class_label(label: str) -> Column:
    """Class 0 for label 0, class 1 for any other, NULL for none."""
    return F.when(F.col(label).isNull(), None).when(F.col(label) == 0, 0).otherwise(1)


def gradient_step(df: DataFrame, model: LinearModel, label: str = "is_duplicate") -> DataFrame:
    """One row: cost and gradient of the mean loss at the model's weights.

    ``df`` may carry multiplicities in a column ``n``. Label 0 is class 0, any
    other class 1; rows without a label are left out. A step is planned once
    per epoch, so it is written as a few SQL expressions.
    """
    if not all(math.isfinite(x) for x in (*model.weights, model.bias, *model.means, *model.scales)):
        raise ValueError("the weights or scales are not finite: use a smaller rate or standardised features")
    n = "CAST(n AS DOUBLE)" if "n" in df.columns else "1D"
    values = {f"x_{c}": f"CAST({c} AS DOUBLE)" for c in model.columns}
    if model.means:
        shifts = zip(values.items(), model.means, model.scales, strict=True)
        values = {name: f"(({v}) - ({m!r}D)) / ({s!r}D)" for (name, v), m, s in shifts}
    inputs = df.where(F.col(label).isNotNull()).selectExpr(*(f"{v} AS {name}" for name, v in values.items()), f"CASE WHEN {label} = 0 THEN 0 ELSE 1 END AS y", f"{n} AS n")
    # The weights come as a row, not as literals, so that the code of a step is compiled once for all epochs.
    names = [f"_w{i}" for i in range(len(model.weights))]
    row = ", ".join(f"{w!r}D" for w in (*model.weights, model.bias))
    weights = df.sparkSession.sql(f"SELECT * FROM VALUES ({row}) AS t({', '.join([*names, '_bias'])})")
    score = " + ".join(f"{w} * {x}" for x, w in zip(values, names, strict=True))
    scored = inputs.crossJoin(F.broadcast(weights)).selectExpr("*", f"1D / (1D + exp(-({score} + _bias))) AS p1")
    loss = f"-ln(greatest(CASE WHEN y = 0 THEN 1D - p1 ELSE p1 END, {MIN_PROBABILITY!r}D))"
    means = {"cost": loss, **{f"g_{x[2:]}": f"(p1 - y) * {x}" for x in values}, "g_bias": "p1 - y"}
    return scored.agg(*(F.expr(f"sum(n * ({v})) / sum(n) AS {name}") for name, v in means.items()))


def logistic_gd(
    features: DataFrame,
    columns: Sequence[str] = BASIC3,
    rate: float = REGRESSION_RATE,
    epochs: int = REGRESSION_EPOCHS,
    standardize: bool = True,
) -> LinearModel:
    """Full-batch descent from zero weights.

    Two softmax classes that start at zero stay mirror images, so the step on
    their difference is twice the rate. ``features`` is read once per epoch:
    pass a staged table, collapsed if it holds many copies.
    """
    columns = tuple(columns)
    features = features.where(F.col("is_duplicate").isNotNull())
    if features.isEmpty():
        raise ValueError("there is no row with a label")
    means, scales = standard_scales(features, columns) if standardize else ((), ())
    weights, bias, costs = [0.0] * len(columns), 0.0, []
    for _ in range(epochs):
        model = LinearModel(columns, tuple(weights), bias, means, scales)
        # Only these few numbers reach the driver.
        cost, *gradient, g_bias = gradient_step(features, model).first()
        if cost is None:
            raise ValueError("there is no row with a label")
        costs.append(cost)
        weights = [w - 2.0 * rate * g for w, g in zip(weights, gradient, strict=True)]
        bias -= 2.0 * rate * g_bias
    return LinearModel(columns, tuple(weights), bias, means, scales, tuple(costs))


def fit_regression(features: DataFrame, columns: Sequence[str] = BASIC3, reg: float = 1e-3) -> PipelineModel:
    """MLlib fit; a little regularisation keeps separable data finite. Labels as in ``gradient_step``."""
    features = features.where(F.col("is_duplicate").isNotNull()).withColumn("is_duplicate", class_label("is_duplicate"))
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(columns), outputCol="x"),
        LogisticRegression(featuresCol="x", labelCol="is_duplicate", predictionCol="p",
                           probabilityCol="pv", rawPredictionCol="rv", regParam=reg, maxIter=REGRESSION_EPOCHS),
    ]).fit(features)


def apply_regression(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Add p0, p1 and an integer prediction; other columns are kept."""
    p = vector_to_array("pv")
    scored = model.transform(features).withColumns({"p0": p[0], "p1": p[1]})
    return scored.withColumn("prediction", F.col("p").cast("int")).drop("x", "p", "pv", "rv")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score_with(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], columns: Sequence[str], out: str = "score"
) -> DataFrame:
    """Plug-in scorer: ``fn`` maps a batch of feature columns to scores, batch by batch."""
    names = list(columns)

    @F.pandas_udf("double")
    def scorer(batch: pd.DataFrame) -> pd.Series:
        return fn(batch[names])

    return df.withColumn(out, scorer(F.struct(*names)))
