"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.sources.tables import scratch, stage


def _to_least(links: DataFrame, both: bool) -> DataFrame:
    """Point neighbours of each node at the least of them: the larger ones (``both``), or the smaller ones and the node itself."""
    forth = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    sides = forth.union(forth.select("v", "u")) if both else forth.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = sides.join(least, "u")
    if both:
        out = met.where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = met.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select("m", "u").toDF("a", "b"))
    return out.where(F.col("a") != F.col("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``id, component`` for every id in ``links`` (a, b); the component is its smallest id.

    Alternates two rewrites of the links, on large and on small neighbours,
    until they form stars; the number of rounds grows with the logarithm of the
    size. Each round is a written table.
    """
    with scratch(links.sparkSession) as keep:
        now, last = stage(links.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "graph"), None
        while True:
            now = stage(_to_least(_to_least(now, True), False), "graph")
            mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if mark == last:
                break
            last = mark
        members = now.select(F.col("b").alias("id"), F.col("a").alias("component"))
        return keep(members.union(now.select("a", "a")).distinct(), "components")
