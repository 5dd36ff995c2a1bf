"""Parquet artefacts: features, vocabularies, vectors, results."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where none is set and all tasks run in this process (as in tests) a
    folder of this session is made and set; on a cluster a folder of one machine
    would hide files from the others, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="pairloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@contextmanager
def new_version(spark: SparkSession, path: str) -> Iterator[str]:
    """A new folder under ``path`` for an artefact of several tables; it counts once the block has ended without an error.

    The list of versions is only added to, and last, so a run that ends halfway
    leaves the version before it in use. Earlier versions stay.
    """
    name = f"version-{uuid.uuid4().hex}"
    yield f"{path}/{name}"
    row = spark.range(1).select(F.lit(name).alias("name"), F.current_timestamp().alias("at"))
    write_table(row.coalesce(1), f"{path}/versions", "append")


def last_version(spark: SparkSession, path: str) -> str:
    """The folder of the version that was finished last."""
    last = read_table(spark, f"{path}/versions").agg(F.max_by("name", F.struct("at", "name")).alias("name")).first()
    return f"{path}/{last['name']}"


_staged: dict[str, list[str]] = {}


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_staged(spark: SparkSession) -> int:
    """Delete the intermediate tables that this session has staged; results that read them are lost. Returns their number."""
    paths = _staged.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete what is staged inside, but for tables staged with the function that is given.

    A result must read no other table of the inside, so stage it with that function.
    """
    app = spark.sparkContext.applicationId
    outer, own = _staged.setdefault(app, []), []
    _staged[app] = own

    def keep(df: DataFrame, name: str) -> DataFrame:
        _staged[app] = outer
        try:
            return stage(df, name)
        finally:
            _staged[app] = own

    try:
        yield keep
    finally:
        _staged[app] = outer
        _delete(spark, own)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result once to the shared folder and read it back.

    Later jobs read a columnar table with known size, and a lost executor costs
    no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    write_table(df, path)
    return read_table(spark, path)
