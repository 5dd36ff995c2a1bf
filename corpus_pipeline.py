"""From raw documents to shards: quality, near duplicates, benchmark passages, mixing, sharding.

Each stage works on what the one before kept. Rows without a doc_id can't be
named by a decision and pass through the filters; the mix takes them like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.decontamination import contaminated
from pairloom.llm.mixing import mixed_rows
from pairloom.llm.near_duplicates import near_duplicates
from pairloom.llm.quality import cleaned_texts
from pairloom.llm.sharding import shard_documents
from pairloom.operators.joins import fits_broadcast
from pairloom.sources.tables import scratch, stage

#: The plan of the mix and the cuts between shards are searches that SQL doesn't express; tests compare all stages with plain Python.
ORACLE_SQL = None
LOOKUP_BYTES = 64 << 20


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose doc_id isn't in ``gone``; texts are shuffled only where the ids are too many to be broadcast."""
    named = stage(gone.where("doc_id is not null").select(F.col("doc_id").alias("_gone_id")).distinct(), "gone")
    named = F.broadcast(named) if fits_broadcast(named, LOOKUP_BYTES) else named
    return docs.join(named, docs["doc_id"] == F.col("_gone_id"), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that too many documents of their source share.

    Null and empty texts go, but for rows without a doc_id. No rows give none.
    """
    return cleaned_texts(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id.

    Of rows that share an id the one with the least hash of all its columns
    stays, whatever their texts. Null and empty texts are in no group and stay,
    as do rows without a doc_id. No rows give none.
    """
    groups = near_duplicates(docs).select("doc_id", "kept")
    kept = _without(docs, groups.where("not kept"))
    repeated = groups.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1")
    again = stage(repeated.select(F.col("doc_id").alias("_again_id")), "repeated")
    if again.isEmpty():
        return kept
    again = F.broadcast(again) if fits_broadcast(again, LOOKUP_BYTES) else again
    twice = kept["doc_id"] == F.col("_again_id")
    one = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")
    first = kept.join(again, twice, "left_semi").groupBy("doc_id").agg(one).select("row.*")
    return kept.join(again, twice, "left_anti").unionByName(first)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``. Null and empty texts hold none and stay, as do rows without a doc_id."""
    return _without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once, or twice; null and empty texts count no words."""
    return mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row, repeated ones and those without a text or id included."""
    return shard_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
