"""Word vectors in the binary word2vec layout, read by byte ranges.

A file is a line ``count width``, then for each word its bytes, a space and
``width`` little-endian floats, with or without a line feed after them. Words
differ in length, so where a range's first record begins is found by trying
places until a chain of records fits; the reader of the range before must end
exactly there, which proves every place that was found.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

RANGE_BYTES = 64 << 20
#: Records that must fit one after the other where a range is cut.
CHAIN = 16
LONGEST_WORD = 1024
_LARGEST = 1e6
_CHUNK = 8 << 20
_ROWS = 4096
_SCHEMA = "token string, vec array<float>"


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


@dataclass
class Layout:
    width: int
    newline: bool

    def end_of(self, raw: bytes, at: int) -> int | None:
        """Where the record that begins at a place ends, None where there can't be one, beyond ``raw`` if it is cut off."""
        space = raw.find(b" ", at, at + LONGEST_WORD + 1)
        if space < 0:
            return len(raw) + 1 if len(raw) - at <= LONGEST_WORD and not _blank(raw[at:]) else None
        end = space + 1 + 4 * self.width + self.newline
        if space == at or _blank(raw[at:space]):
            return None
        if end > len(raw):
            return end
        numbers = np.frombuffer(raw, "<f4", self.width, space + 1)
        if not (np.abs(numbers) < _LARGEST).all() or self.newline and raw[end - 1] != 10:
            return None
        return end

    def chain(self, raw: bytes, at: int, whole: bool) -> bool:
        """Whether records follow one another from a place on; ``whole``: the file ends with ``raw``."""
        for _ in range(CHAIN):
            if at == len(raw):
                return True
            end = self.end_of(raw, at)
            if end is None or end > len(raw):
                return end is not None and not whole
            at = end
        return True


def _blank(word: bytes) -> bool:
    return any(b <= 0x20 for b in word)


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int
    layout: Layout


class _Reader(DataSourceReader):
    def __init__(self, path: str, step: int):
        self.path, self.step = path, step

    def _files(self) -> list[str]:
        system, path = _filesystem(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [path]
        found = system.get_file_info(fs.FileSelector(path))
        return sorted(x.path for x in found if x.type == fs.FileType.File and os.path.basename(x.path)[0] not in "._")

    def partitions(self) -> list[_Range]:
        """Ranges that begin where a record does; a few records around each cut are read."""
        system, _ = _filesystem(self.path)
        out = []
        for path in self._files():
            with system.open_input_file(path) as file:
                size = file.size()
                head = file.read_at(min(size, 100), 0)
                line = head[: head.find(b"\n")]
                try:
                    _, width = map(int, line.split())
                except ValueError:
                    raise ValueError(f"{path}: a word2vec file begins with the numbers of words and of components") from None
                first, reach = len(line) + 1, (CHAIN + 2) * (4 * width + LONGEST_WORD + 2)
                raw = file.read_at(min(reach, size - first), first)
                layouts = [x for x in (Layout(width, True), Layout(width, False)) if x.chain(raw, 0, first + len(raw) == size)]
                if not layouts:
                    raise ValueError(f"{path}: no records of {width} components follow the header")
                cuts = [first]
                for at in range(first + self.step, size, self.step):
                    raw = file.read_at(min(reach, size - at), at)
                    fits = (k for k in range(4 * width + LONGEST_WORD + 3) if layouts[0].chain(raw, k, at + len(raw) == size))
                    k = next(fits, len(raw))  # may lie inside a word, but then the record ends where it truly does
                    cut = min(size, at + (layouts[0].end_of(raw, k) if k < len(raw) else k))
                    if cut > cuts[-1]:
                        cuts.append(cut)
                out += [_Range(path, a, b, layouts[0]) for a, b in zip(cuts, [*cuts[1:], size]) if a < b]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(self.path)
        layout, words, vectors, raw, at = partition.layout, [], [], b"", 0
        schema = pa.schema([("token", pa.string()), ("vec", pa.list_(pa.float32()))])

        def batch() -> pa.RecordBatch:
            values = np.frombuffer(b"".join(vectors), "<f4")
            lists = pa.ListArray.from_arrays(np.arange(len(words) + 1, dtype=np.int32) * layout.width, pa.array(values, pa.float32()))
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), lists], schema=schema)

        with system.open_input_file(partition.path) as file:
            place = partition.start
            while place < partition.end or at < len(raw):
                end = layout.end_of(raw, at) if at < len(raw) else len(raw) + 1
                if end is not None and end > len(raw) and place < partition.end:
                    more = file.read_at(min(_CHUNK, partition.end - place), place)
                    raw, at, place = raw[at:] + more, 0, place + len(more)
                    continue
                if end is None or end > len(raw):
                    raise ValueError(f"{partition.path}: no record fits at byte {place - len(raw) + at}")
                space = raw.find(b" ", at)
                words.append(raw[at:space].decode("utf-8", "replace"))
                vectors.append(raw[space + 1 : space + 1 + 4 * layout.width])
                at = end
                if len(words) == _ROWS:
                    yield batch()
                    words, vectors = [], []
        if words:
            yield batch()


class _Written(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class _Writer(DataSourceArrowWriter):
    """A file for each task, under its final name only when all are written."""

    def __init__(self, path: str):
        self.path, self.folder = path, f"_{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, path = _filesystem(self.path)
        count, width = 0, None
        with tempfile.TemporaryFile() as spool:  # the task's own, copied at the end, when the count is known
            for batch in iterator:
                for word, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if not word or _blank(word.encode()) or len(word.encode()) > LONGEST_WORD or not vector:
                        raise ValueError(f"the layout can't hold the word {word!r}")
                    if width not in (None, len(vector)):
                        raise ValueError(f"vectors of {width} and of {len(vector)} components")
                    numbers = np.array(vector, "<f4")
                    if not (np.abs(numbers) < _LARGEST).all():
                        raise ValueError(f"the vector of {word!r} has no finite number or one of {_LARGEST:g} or more")
                    width = len(vector)
                    spool.write(word.encode() + b" " + numbers.tobytes() + b"\n")
                    count += 1
            if not count:
                return _Written(None)
            spool.seek(0)
            name = f"part-{uuid.uuid4().hex}.bin"
            system.create_dir(f"{path}/{self.folder}", recursive=True)
            with system.open_output_stream(f"{path}/{self.folder}/{name}") as out:
                out.write(f"{count} {width}\n".encode())
                while chunk := spool.read(_CHUNK):
                    out.write(chunk)
        return _Written(name)

    def commit(self, messages: list) -> None:
        system, path = _filesystem(self.path)
        for m in messages:
            if m and m.path:
                system.move(f"{path}/{self.folder}/{m.path}", f"{path}/{m.path}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        system, path = _filesystem(self.path)
        if system.get_file_info(f"{path}/{self.folder}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.folder}")


class Word2VecSource(DataSource):
    """``word2vec`` as a format: ``spark.read.format("word2vec").load(path)`` of a file or folder, and ``df.write`` to a folder."""

    @classmethod
    def name(cls) -> str:
        return "word2vec"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("files are only added: choose a new folder, or mode append")
        return _Writer(self.options["path"])


def read_word2vec(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(token, vec) of a binary word2vec file or a folder of such files, about ``range_bytes`` a task.

    ``path`` is one that pyarrow's file systems open. Bytes of words that are no
    UTF-8 are replaced. A file that isn't in the layout is an error.
    """
    spark.dataSource.register(Word2VecSource)
    return spark.read.format("word2vec").option("rangeBytes", range_bytes).load(path)


def write_word2vec(vectors: DataFrame, path: str) -> None:
    """Add (token, vec) to a folder of binary word2vec files, one for each task with rows.

    Words must not be empty or hold white space, vectors must be finite and of one width in a file.
    """
    vectors.sparkSession.dataSource.register(Word2VecSource)
    vectors.select(F.col("token").cast("string"), F.col("vec").cast("array<float>")).write.format("word2vec").mode("append").save(path)
