"""Exchangeable decision heads on pairs of sentence vectors (id, left, right)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.constants import DISTANCE_THRESHOLD, NORM_EPSILON
from pairloom.functions.arrays import joint_vector
from pairloom.functions.scoring import argmax2, softmax2, threshold_decision
from pairloom.functions.similarity import normalized_distance
from pairloom.operators.regression import class_label
from pairloom.operators.vectors import batch_normalize, component_moments, moment_values, normalize_per_batch
from pairloom.sources.tables import stage


class PairHead(Protocol):
    """Scores pairs of vectors, then turns scores into 0/1 predictions, row by row."""

    def score(self, sides: DataFrame) -> DataFrame: ...

    def decide(self, scored: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class DistanceHead:
    """Duplicate if the normalised distance is below the threshold."""

    threshold: float = DISTANCE_THRESHOLD

    def score(self, sides: DataFrame) -> DataFrame:
        return sides.select("id", normalized_distance(F.col("left"), F.col("right")).alias("distance"))

    def decide(self, scored: DataFrame) -> DataFrame:
        return scored.withColumn("prediction", threshold_decision(F.col("distance"), self.threshold))


def joint(sides: DataFrame) -> DataFrame:
    """(id, vec): both vectors of a pair behind each other."""
    return sides.select("id", joint_vector(F.col("left"), F.col("right")).alias("vec"))


def _numbers(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


@dataclass(frozen=True)
class DenseHead:
    """Joint vector, batch normalisation, one dense layer of two classes, softmax.

    The moments are those of the training data, so a row's score does not
    depend on its neighbours. All parameters are as many numbers as the joint
    vector is wide, and scoring is a projection.
    """

    means: Sequence[float]
    variances: Sequence[float]
    weights: tuple[Sequence[float], Sequence[float]]
    biases: tuple[float, float]
    epsilon: float = NORM_EPSILON

    def score(self, sides: DataFrame) -> DataFrame:
        z = batch_normalize(F.col("vec"), _numbers(self.means), _numbers(self.variances), self.epsilon)
        return self._forward(joint(sides).withColumn("vec", z))

    def score_per_batch(self, sides: DataFrame, batches: DataFrame) -> DataFrame:
        """Normalise by the moments of each row's own batch; ``batches`` is (id, batch_id)."""
        return self._forward(normalize_per_batch(joint(sides).join(batches, "id")))

    def _forward(self, normal: DataFrame) -> DataFrame:
        def logit(c: int) -> Column:
            terms = F.zip_with("vec", _numbers(self.weights[c]), lambda x, w: x * w)
            return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) + F.lit(float(self.biases[c]))

        logits = normal.select("id", logit(0).alias("z0"), logit(1).alias("z1"))
        p0, p1 = softmax2(F.col("z0"), F.col("z1"))
        return logits.withColumns({"p0": p0, "p1": p1})

    def decide(self, scored: DataFrame) -> DataFrame:
        return scored.withColumn("prediction", argmax2(F.col("p0"), F.col("p1")))

    @classmethod
    def fit(cls, sides: DataFrame, labels: DataFrame, reg: float = 1e-3, epochs: int = 100) -> DenseHead:
        """Fit the layer on normalised joint vectors; ``labels`` is (id, is_duplicate), rows without a label are left out."""
        known = labels.where(F.col("is_duplicate").isNotNull()).withColumn("is_duplicate", class_label("is_duplicate"))
        rows = stage(joint(sides).join(known, "id"), "joint")
        means, variances = moment_values(component_moments(rows))
        z = batch_normalize(F.col("vec"), _numbers(means), _numbers(variances))
        data = rows.select(array_to_vector(z).alias("x"), F.col("is_duplicate").cast("double").alias("y"))
        fitted: LogisticRegressionModel = LogisticRegression(
            featuresCol="x", labelCol="y", family="multinomial", regParam=reg, maxIter=epochs, standardization=False,
        ).fit(data)
        w, b = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
        return cls(means, variances, (w[0].tolist(), w[1].tolist()), (float(b[0]), float(b[1])))


def head_gradient(head: DenseHead, sides: DataFrame, labels: DataFrame, reg: float = 1e-3) -> DataFrame:
    """(c, d, gradient) of the loss that ``DenseHead.fit`` minimises, at the weights of a head; d = -1 are the biases.

    All near zero certify a fit: the loss is convex. One row for each weight.
    """
    known = labels.where(F.col("is_duplicate").isNotNull()).select("id", class_label("is_duplicate").alias("y"))
    z = joint(sides).select("id", batch_normalize(F.col("vec"), _numbers(head.means), _numbers(head.variances), head.epsilon).alias("z"))
    off = [F.col(f"p{c}") - (F.col("y") == c).cast("double") for c in (0, 1)]
    rows = z.join(head.score(sides).select("id", "p0", "p1"), "id").join(known, "id")
    cells = rows.select(*(o.alias(f"e{c}") for c, o in enumerate(off)), F.posexplode(F.array_append("z", F.lit(1.0))).alias("d", "x"))
    means = cells.groupBy("d").agg(*(F.avg(F.col(f"e{c}") * F.col("x")).alias(f"g{c}") for c in (0, 1)))
    width = len(head.means)
    by_class = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"g{c}").alias("g")) for c in (0, 1)))).alias("x")
    weights = [F.get(_numbers(head.weights[c]), F.col("d")) for c in (0, 1)]
    means = means.select("d", by_class).select("d", "x.c", "x.g")
    penalty = F.when(F.col("d") == width, 0.0).when(F.col("c") == 0, weights[0]).otherwise(weights[1]) * reg
    return means.select("c", F.when(F.col("d") == width, -1).otherwise(F.col("d")).alias("d"), (F.col("g") + penalty).alias("gradient"))


def save_head(head: DenseHead, spark: SparkSession, path: str) -> None:
    """Keep a head as a small Parquet table: one row for each component, and one (d = -1) for the biases."""
    rows = [(d, *map(float, x)) for d, x in enumerate(zip(head.means, head.variances, *head.weights, strict=True))]
    rows.append((-1, head.epsilon, 0.0, *map(float, head.biases)))
    table = spark.createDataFrame(rows, "d int, mean double, var double, w0 double, w1 double")
    table.coalesce(1).write.mode("overwrite").parquet(path)


def load_head(spark: SparkSession, path: str) -> DenseHead:
    biases, *rows = spark.read.parquet(path).orderBy("d").collect()
    return DenseHead(
        [r["mean"] for r in rows], [r["var"] for r in rows], ([r["w0"] for r in rows], [r["w1"] for r in rows]),
        (biases["w0"], biases["w1"]), biases["mean"])


def run_head(head: PairHead, sides: DataFrame) -> DataFrame:
    """Score and decide."""
    return head.decide(head.score(sides))
