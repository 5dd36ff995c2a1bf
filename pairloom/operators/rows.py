"""Row positions, splits, batches and last-wins duplicates, without a global window."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.constants import BATCH_SIZE, SCORE_CHUNK, TRAIN_FRACTION

_CELLS = 4096


def _range_buckets(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Add ``_bucket``: contiguous, nearly equal key ranges.

    The bounds are a handful of quantiles fixed as literals, so the bucket is a
    function of the key alone and stays the same if a task runs again.
    """
    points = [i / buckets for i in range(1, buckets)]
    bounds = df.agg(F.percentile_approx(key, points, 10 * buckets)).first()[0] or []
    inner = sorted({float(b) for b in bounds}) or [0.0]
    splits = [-math.inf, *inner, math.inf]
    keyed = df.withColumn("_key", F.col(key).cast("double"))
    cut = Bucketizer(splits=splits, inputCol="_key", outputCol="_bucket")
    return cut.transform(keyed).withColumn("_bucket", F.col("_bucket").cast("int")).drop("_key")


def row_index(df: DataFrame, key: str = "id", out: str = "rn", buckets: int | None = None) -> DataFrame:
    """Dense 0-based position in the order of a unique numeric key.

    Rows are numbered inside key ranges in parallel; a table with one row per
    range carries the number of rows before it.
    """
    if buckets is None:
        buckets = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = _range_buckets(df, key, max(buckets, 2))
    sizes = ranged.groupBy("_bucket").agg(F.count("*").alias("_n"))
    # One row per bucket, so this window sorts a number of rows fixed beforehand.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(key)) - 1
    return (
        ranged.withColumn("_inside", inside)
        .join(F.broadcast(starts), "_bucket")
        .withColumn(out, (F.col("_start") + F.col("_inside")).cast("long"))
        .drop("_bucket", "_inside", "_start")
    )


def kth_key(df: DataFrame, key: str, k: int, bounds: tuple[int, int] | None = None) -> int:
    """The k-th smallest (0-based) value of an integer column, exactly.

    Each pass counts keys in a fixed number of equal cells and goes on inside
    the cell that holds position k; only cell counts reach the driver. Nothing
    is sorted, and the range filter is pushed to the scan.
    """
    if bounds is None:
        row = df.agg(F.min(key), F.max(key)).first()
        bounds = (row[0], row[1])
    low, high = bounds
    while low < high:
        width = -(-(high - low + 1) // _CELLS)
        cells = (
            df.filter(F.col(key).between(low, high))
            .groupBy(F.expr(f"CAST(({key} - {low}L) DIV {width}L AS INT)").alias("cell"))
            .count()
            .orderBy("cell")
            .collect()
        )
        for cell in cells:
            if k < cell["count"]:
                low = low + cell["cell"] * width
                high = min(high, low + width - 1)
                break
            k -= cell["count"]
        else:
            raise ValueError("position beyond the last row")
    return low


def split_by_position(
    df: DataFrame, key: str = "id", fraction: float = TRAIN_FRACTION
) -> tuple[DataFrame, DataFrame]:
    """First floor(fraction * n) rows in key order, and the rest.

    Both parts are plain range filters on the key, so no row is numbered or
    moved. A row without a key has no position and is an error.
    """
    n, keyed, low, high = df.agg(F.count("*"), F.count(key), F.min(key), F.max(key)).first()
    if keyed < n:
        raise ValueError(f"{n - keyed} rows have no {key}")
    k = math.floor(fraction * n)
    if k >= n:
        return df, df.filter(F.lit(False))
    cut = kth_key(df.select(key), key, k, (low, high))
    return df.filter(F.col(key) < cut), df.filter(F.col(key) >= cut)


def minibatches(df: DataFrame, key: str = "id", batch_size: int = BATCH_SIZE) -> DataFrame:
    """Batch number by position."""
    numbered = row_index(df, key)
    return numbered.withColumn("batch_id", F.floor(F.col("rn") / F.lit(batch_size)).cast("long"))


def score_chunks(df: DataFrame, key: str = "id", chunk_size: int = SCORE_CHUNK) -> DataFrame:
    """Scoring chunk number by position."""
    return minibatches(df, key, chunk_size).withColumnRenamed("batch_id", "chunk_id")


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; partial results are merged, so no key fills one task."""
    last = F.max_by(F.struct(*df.columns), F.col(order)).alias("last")
    return df.groupBy(F.col(key).alias("_key")).agg(last).select("last.*")


def first_rows(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The first n rows in key order."""
    return df.orderBy(key).limit(n)
