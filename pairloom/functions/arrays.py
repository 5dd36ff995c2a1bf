"""Array expressions: padding, one-hot labels, vector prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.constants import SEQUENCE_LENGTH, UNKNOWN_INDEX


def last_n(values: Column, n: int = SEQUENCE_LENGTH) -> Column:
    """The last ``n`` elements, or all of a shorter array."""
    return F.when(F.size(values) > n, F.slice(values, -n, n)).otherwise(values)


def pad_left(values: Column, n: int = SEQUENCE_LENGTH, pad_value: int = UNKNOWN_INDEX) -> Column:
    """Exactly ``n`` elements: cut on the left, or filled up on the left."""
    fill = F.array_repeat(F.lit(pad_value), F.greatest(F.lit(n) - F.size(values), F.lit(0)))
    return F.concat(fill, last_n(values, n))


def one_hot(label: Column) -> Column:
    """0 gives [1, 0]; anything else, a missing label too, gives [0, 1]."""
    return F.when(label == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))


def vector_prefix(vector: Column, n: int) -> Column:
    """The first ``n`` components."""
    return F.slice(vector, 1, n)


def zero_vector(width: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), width)


def joint_vector(left: Column, right: Column) -> Column:
    return F.concat(left, right)
