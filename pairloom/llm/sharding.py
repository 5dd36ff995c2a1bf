"""Contiguous shards of nearly equal bytes that never split a group of equal texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.sources.tables import stage

SHARDS = 8
#: Parts of a group, so that a group of any size is numbered by many tasks.
PARTS = 256
#: Capacities tried at once.
TRIES = 63
_BIN_DIGITS = 3


def atomic_groups(cells: DataFrame) -> DataFrame:
    """Groups in the order of their digests with running sums: ``key, bytes, rows, end_bytes, end_rows``.

    Sums run inside 4,096 ranges of the digest, which are even whatever the
    texts are; only the sums of the ranges are added up in one task.
    """
    groups = cells.groupBy("key").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("rows"))
    groups = groups.withColumn("bin", F.substring("key", 1, _BIN_DIGITS))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = groups.groupBy("bin").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r"))
    bins = bins.select("bin", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("b", "r")))
    inside = Window.partitionBy("bin").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    return groups.join(F.broadcast(bins), "bin").select(
        "key", "bytes", "rows",
        (F.col("b0") + F.sum("bytes").over(inside)).alias("end_bytes"),
        (F.col("r0") + F.sum("rows").over(inside)).alias("end_rows"),
    )


def _last_ends(groups: DataFrame, limits: list[int], largest: int) -> list[int]:
    """For each limit the largest running sum within it (0 if none), in one pass over the groups near the limits."""
    near = groups.where((F.col("end_bytes") > min(limits) - largest) & (F.col("end_bytes") <= max(limits)))
    found = near.agg(*(F.max(F.when(F.col("end_bytes") <= x, F.col("end_bytes"))).alias(f"e{k}") for k, x in enumerate(limits)))
    return [x or 0 for x in found.first()]


def _cuts(groups: DataFrame, capacities: list[int], n: int, largest: int) -> list[list[int]]:
    """The ends of ``n - 1`` shards filled greedily, for each capacity."""
    ends: list[list[int]] = [[] for _ in capacities]
    at = [0] * len(capacities)
    for _ in range(n - 1):
        at = [max(a, e) for a, e in zip(at, _last_ends(groups, [a + c for a, c in zip(at, capacities)], largest))]
        for own, a in zip(ends, at):
            own.append(a)
    return ends


def minimax_cuts(groups: DataFrame, n: int = SHARDS) -> list[int]:
    """Ends, in bytes, of the first ``n - 1`` shards of the partition with the smallest largest shard.

    The search for the capacity tries 63 values at once; each try fills shards
    greedily. A shard of the mean size plus the largest group always suffices.
    The driver holds one number for each try and shard.
    """
    total, largest = groups.agg(F.max("end_bytes"), F.max("bytes")).first()
    if not total:
        return [0] * (n - 1)
    low = max(largest, -(-total // n))
    high = min(total, -(-total // n) + largest)
    while low < high:
        tries = sorted({low + (high - low) * k // (TRIES + 1) for k in range(TRIES + 1)})
        fits = [total - own[-1] <= c for own, c in zip(_cuts(groups, tries, n, largest), tries)] if n > 1 else [c >= total for c in tries]
        if any(fits):
            k = fits.index(True)
            high, low = tries[k], tries[k - 1] + 1 if k else tries[k]
        else:
            low = tries[-1] + 1
    return _cuts(groups, [low], n, largest)[0]


def _below(cuts: list[int], start: Column) -> Column:
    return sum((F.when(start >= x, 1).otherwise(0) for x in cuts), F.lit(0)).cast("int")


def shard_documents(docs: DataFrame, n: int = SHARDS) -> DataFrame:
    """Shard and slot of every row of ``docs`` (doc_id and text are read).

    Size: UTF-8 bytes of the text (null: none) plus 1. Rows of equal texts, null
    and empty alike, are one group and stay together. Groups follow one another
    in the order of their text digests; shards are runs of groups, cut so that
    the largest shard is as small as can be. Slots count from 0 inside a shard,
    by group, then by a hash of the id, then by id. Repeated rows get slots of
    their own; null ids are numbered like any other. With fewer groups than
    shards some shards stay empty; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stage(docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("key"), F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int").alias("part"),
    ), "sizes")
    cells = stage(rows.groupBy("key", "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "cells")
    groups = stage(atomic_groups(cells), "groups")
    cuts = minimax_cuts(groups, n)
    first = groups.agg(F.lit(0).alias("none"), *(F.max(F.when(F.col("end_bytes") <= x, F.col("end_rows"))) for x in cuts)).first()[1:]
    shard = _below(cuts, F.col("end_bytes") - F.col("bytes"))
    base = F.element_at(F.array(F.lit(0), *(F.lit(x or 0) for x in first)).cast("array<bigint>"), F.col("shard") + 1)
    starts = groups.withColumn("shard", shard).select(
        "key", "shard", (F.col("end_rows") - F.col("rows") - base).alias("start"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.join(starts, "key").select(
        "key", "part", "shard", (F.col("start") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("start"))
    place = F.row_number().over(Window.partitionBy("key", "part").orderBy("doc_id")) - 1
    return rows.join(cells, ["key", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + place).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
