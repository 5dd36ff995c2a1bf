"""Lookup joins that broadcast only what has been measured to be small."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.sources.tables import stage

BROADCAST_BYTES = 256 << 20
_ELEMENT_BYTES = {"float": 4, "int": 4, "double": 8, "bigint": 8}


def _column_bytes(field: T.StructField) -> Column:
    col = F.col(field.name)
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(F.octet_length(col), F.lit(0)).cast("long") + 16
    if isinstance(field.dataType, T.ArrayType):
        each = _ELEMENT_BYTES[field.dataType.elementType.simpleString()]
        return F.greatest(F.size(col), F.lit(0)).cast("long") * each + 16
    return F.lit(8).cast("long")


def table_bytes(df: DataFrame) -> int:
    """Data bytes of a table, by one aggregate row."""
    row = reduce(lambda a, b: a + b, [_column_bytes(f) for f in df.schema.fields])
    return df.agg(F.sum(row)).first()[0] or 0


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a table has been measured to be at most ``limit`` bytes."""
    return table_bytes(df) <= limit


def salted_join(
    facts: DataFrame, table: DataFrame, on: str, how: str = "left", spread_by: str = "id", pieces: int | None = None
) -> DataFrame:
    """Shuffle join to a table with unique keys, without hot tasks.

    The facts are written once and counted. A key with more than one in
    ``pieces`` of them (there are fewer such keys than pieces; unset: the number
    of shuffle partitions) is spread over as many tasks as it has such shares,
    and only its row of the table is copied. Facts without a key are spread too.
    """
    if pieces is None:
        pieces = max(2, int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    facts = stage(facts, "facts")
    share = max(1, -(-facts.count() // pieces))
    heavy = facts.where(F.col(on).isNotNull()).groupBy(on).count().where(F.col("count") > share)
    heavy = F.broadcast(stage(heavy.select(on, F.ceil(F.col("count") / share).cast("int").alias("_salts")), "heavy"))
    salts = F.coalesce("_salts", F.when(F.col(on).isNull(), pieces).otherwise(1))
    copies = table.join(heavy, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    salted = facts.join(heavy, on, "left").withColumn("_salt", F.pmod(F.xxhash64(spread_by), salts).cast("int"))
    return salted.drop("_salts").join(copies.drop("_salts").hint("merge"), [on, "_salt"], how).drop("_salt")


def lookup_join(
    facts: DataFrame, table: DataFrame, on: str, how: str = "left", spread_by: str = "id", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Join many rows to a lookup table with unique keys: broadcast if small, else salted.

    The table is read twice (size, join), so pass a staged or otherwise cheap
    one.
    """
    if fits_broadcast(table, limit):
        return facts.join(F.broadcast(table), on, how)
    return salted_join(facts, table, on, how, spread_by)
