"""Scores and decisions as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.constants import DISTANCE_THRESHOLD, MIN_PROBABILITY


def linear_score(columns: Sequence[str], weights: Sequence[float], bias: float) -> Column:
    """x . w + b over named columns."""
    terms = [F.col(c).cast("double") * F.lit(float(w)) for c, w in zip(columns, weights, strict=True)]
    return reduce(lambda a, b: a + b, terms) + F.lit(float(bias))


def softmax2(z0: Column, z1: Column) -> tuple[Column, Column]:
    """Two-class softmax, shifted by the larger score so that exp never overflows."""
    top = F.greatest(z0, z1)
    e0, e1 = F.exp(z0 - top), F.exp(z1 - top)
    return e0 / (e0 + e1), e1 / (e0 + e1)


def argmax2(p0: Column, p1: Column) -> Column:
    """1 if the second class is strictly ahead; ties go to class 0."""
    return F.when(p1 > p0, 1).otherwise(0)


def threshold_decision(distance: Column, threshold: float = DISTANCE_THRESHOLD) -> Column:
    """1 below the threshold; an undefined distance counts as far."""
    return F.when(distance < F.lit(float(threshold)), 1).otherwise(0)


def log_loss(probability_of_true: Column) -> Column:
    """-ln p of the true class, with p kept away from zero."""
    return -F.ln(F.greatest(probability_of_true, F.lit(MIN_PROBABILITY)))
