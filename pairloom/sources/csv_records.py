"""Records of CSV files whose quoted fields may hold line breaks, read by many tasks a file.

Files are read as lines, range by range. First each range says how it leaves a
quoted field, whether it starts inside one or not; put together in order, these
say how each range truly starts. Then lines are joined to records inside their
range, and the few records that cross ranges are put together from their parts.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.operators.joins import fits_broadcast
from pairloom.sources.tables import stage

#: One character for each byte, so that undecodable texts survive the parser.
_BYTES = "ISO-8859-1"
_QUOTE, _COMMA = b'"', b","
#: What a line is to its record: all of it, its first lines, its middle lines, its last lines.
WHOLE, HEAD, MIDDLE, TAIL = range(4)
#: A position is the number of a range and, in so many bits, of a record in it.
_RECORD_BITS = 33


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a line leaves a quoted field open.

    A quote opens a field only as its first character; inside, two quotes are
    one character. Quotes elsewhere are text.
    """
    at = 0
    while True:
        if inside:
            at = line.find(_QUOTE, at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == _QUOTE:
                at += 2
                continue
            inside = False
        elif line[at : at + 1] == _QUOTE:
            inside, at = True, at + 1
            continue
        at = line.find(_COMMA, at)
        if at < 0:
            return False
        at += 1


def _lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``file, start, value``, in order within a task (``start``: where the task's range of the file begins); and ``file, path``, files by name."""
    names = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path")).distinct()
    files = stage(names.select((F.row_number().over(Window.orderBy("path")) - 1).alias("file"), "path"), "files")
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    return lines.join(F.broadcast(files), "path").select("file", "start", "value"), files


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.Array]]:
    """The lines of a batch by file and range."""
    file, start = (batch.column(k).to_numpy() for k in (0, 1))
    cuts = np.flatnonzero((np.diff(file, prepend=-1) != 0) | (np.diff(start, prepend=-1) != 0))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(batch)]):
        yield (int(file[a]), int(start[a])), batch.slice(a, b - a)


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range: how it ends if it starts outside a quoted field, and if inside; and a file's first line.

    Lines without a quote may be null, but for a file's first range.
    """
    now, ends, head = None, [False, True], None

    def given() -> pa.RecordBatch:
        types = (pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in zip((*now, *ends, head), types)], ["file", "start", "from_out", "from_in", "head"])

    for batch in batches:
        for key, part in _runs(batch):
            if key != now:
                if now is not None:
                    yield given()
                now, ends = key, [False, True]
                head = part.column(2)[0].as_py() if key[1] == 0 else None
            for line in part.column(2).drop_null().to_pylist():
                if _QUOTE in line:
                    ends = [ends_inside(line, x) for x in ends]
    if now is not None:
        yield given()


def _starts(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the ranges of one file: whether each starts and ends inside a quoted field."""
    rows = rows.sort_values("start")
    inside, starts, ends = False, [], []
    for out, in_ in zip(rows["from_out"], rows["from_in"]):
        starts.append(inside)
        inside = bool(in_ if inside else out)
        ends.append(inside)
    return pd.DataFrame({"file": rows["file"], "start": rows["start"], "starts": starts, "ends": ends, "head": rows["head"]})


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines joined to records; what a range has of a record that crosses its ends is marked as such."""
    now, inside, held, number, kind = None, False, [], 0, WHOLE
    out: list[tuple] = []

    def given() -> pa.RecordBatch:
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["file", "range", "number", "kind", "record"])
        out.clear()
        return batch

    for batch in batches:
        for key, part in _runs(batch):
            if key != now:
                if held:
                    out.append((*now, number, MIDDLE if kind == TAIL else HEAD, b"\n".join(held)))
                now, inside, held, number = key, bool(part.column(3)[0].as_py()), [], 0
                kind = TAIL if inside else WHOLE
            for line in part.column(2).to_pylist():
                if inside or _QUOTE in line:
                    inside = ends_inside(line, inside)
                held.append(line)
                if not inside:
                    out.append((*now, number, kind, held[0] if len(held) == 1 else b"\n".join(held)))
                    held, kind, number = [], WHOLE, number + 1
        if out:
            yield given()
    if held:
        out.append((*now, number, MIDDLE if kind == TAIL else HEAD, b"\n".join(held)))
        yield given()


def _crossing(parts: DataFrame) -> DataFrame:
    """Records that cross ranges, from their parts; each stands where it begins."""
    order = Window.partitionBy("file").orderBy("range", "number")
    begins = F.last(F.when(F.col("kind") == HEAD, F.struct("range", "number")), ignorenulls=True).over(order)
    rows = parts.withColumn("begin", begins).where("begin is not null")
    text = F.struct("range", "number", F.decode("record", _BYTES).alias("text"))
    rows = rows.groupBy("file", "begin").agg(F.array_join(F.transform(F.sort_array(F.collect_list(text)), lambda x: x["text"]), "\n").alias("text"))
    return rows.select("begin.range", "begin.number", "text")


def _header(ranges: DataFrame, files: DataFrame) -> list[str]:
    """The column names that all files begin with. There is one row for each different header, so at most two are looked at."""
    head = F.regexp_replace(F.decode("head", "UTF-8"), "^\ufeff|\r$", "")
    found = ranges.where("head is not null").join(files, "file").groupBy(head.alias("head")).agg(F.min("path").alias("path")).orderBy("path").limit(2).collect()
    if not found:
        raise ValueError("there is no file with a header")
    if len(found) > 1:
        raise ValueError(f"{found[1].path} has another header than {found[0].path}")
    if ends_inside(found[0]["head"].encode(), False):
        raise ValueError(f"{found[0].path}: a header must be one line")
    return next(csv.reader([found[0]["head"]]))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files with a header line: its columns as strings, and ``_position``.

    Fields are separated by commas; quoted ones may hold commas, doubled quotes
    and line breaks, and undecodable bytes stay as they are. Lines end with a
    line feed, before which one carriage return is dropped at the end of a
    record. Blank records are left out, missing fields are NULL. ``_position``
    orders records by file name and place and doesn't depend on the tasks. All
    files need the same header, else a ValueError names one that differs.

    A file is read by many tasks. Only records that cross the ranges of two
    tasks are shuffled.
    """
    lines, files = _lines(spark, path)
    needed = F.col("value").contains(F.lit(bytearray(_QUOTE))) | (F.col("start") == 0)
    ways = lines.select("file", "start", F.when(needed, F.col("value")).alias("value")).mapInArrow(
        _ways, "file int, start long, from_out boolean, from_in boolean, head binary")
    ranges = ways.groupBy("file").applyInPandas(_starts, "file int, start long, starts boolean, ends boolean, head binary")
    ranges = stage(ranges.withColumn("range", F.row_number().over(Window.orderBy("file", "start")).cast("long")), "ranges")
    names = _header(ranges, files)
    place = ranges.select("file", "start", "starts", "range")
    place = F.broadcast(place) if fits_broadcast(place) else place
    changed = F.raise_error(F.lit("the files or their split have changed since they were looked through")).cast("long")
    marked = lines.join(place, ["file", "start"], "left").select("file", F.coalesce("range", changed).alias("range"), "value", "starts")
    joined = marked.mapInArrow(_joined, "file int, range long, number long, kind int, record binary")
    records = joined.where(F.col("kind") == WHOLE).select("range", "number", F.decode("record", _BYTES).alias("text"))
    if not ranges.where("ends").isEmpty():
        records = records.unionByName(_crossing(stage(joined.where(F.col("kind") != WHOLE), "parts")))
    heads = ranges.where("start = 0").select("range")
    records = records.join(F.broadcast(heads.withColumn("number", F.lit(0).cast("long"))), ["range", "number"], "left_anti")
    record = F.when(F.col("text").endswith("\r"), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    fields = F.from_csv(record, ", ".join(f"c{k} string" for k in range(len(names))), {"quote": '"', "escape": '"', "multiLine": "true"})
    position = F.shiftleft(F.col("range"), _RECORD_BITS) + F.col("number")
    parsed = records.where(F.trim(record) != "").select(fields.alias("x"), position.alias("_position"))
    return parsed.select(*(F.encode(F.col(f"x.c{k}"), _BYTES).cast("string").alias(c) for k, c in enumerate(names)), "_position")
