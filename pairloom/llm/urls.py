"""URL filter: a sorted array of 64-bit digests on disk, probed by binary search, confirmed on the stored strings."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.words import column

#: Bytes of listed strings in one array; a longer list becomes more arrays, each one pass over the URLs.
ARRAY_BYTES = 16 << 20
#: The rules of the registered query: host and path, verdict.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
DEFAULT = "allow"


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise("")


def host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), upper, lower), F.lit(""))


def path(url: Column) -> Column:
    """From the host to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


class DigestArray:
    """Sorted digests, and for each the place of its string and its verdict; all memory-mapped."""

    def __init__(self, folder: str, blobs: dict[str, bytes]):
        def mapped(part: str, kind: type) -> np.ndarray:
            file = os.path.join(folder, part)
            with open(file, "wb") as out:
                out.write(blobs[part])
            return np.memmap(file, kind, "r")

        self.keys, self.ends, self.lengths = mapped("keys", np.uint64), mapped("ends", np.int64), mapped("lengths", np.int64)
        self.strings, self.blocks = mapped("strings", np.uint8), mapped("blocks", np.uint8)

    @staticmethod
    def pack(entries: list[tuple[str, str]]) -> dict[str, bytes]:
        rows = sorted((digest(s), s, v) for s, v in entries)
        raw = [s.encode("utf-8", "surrogatepass") for _, s, _ in rows]
        return {
            "keys": np.array([r[0] for r in rows], np.uint64).tobytes(),
            "ends": np.cumsum([len(x) for x in raw]).astype(np.int64).tobytes(), "strings": b"".join(raw),
            "blocks": bytes(v == "block" for _, _, v in rows),
            "lengths": np.unique([len(s) - s.index("/") for _, s, _ in rows]).astype(np.int64).tobytes(),
        }

    def probe(self, texts: list[str]) -> list[tuple[str, str] | None]:
        """For each text its stored verdict, if it is listed."""
        keys = np.array([digest(t) for t in texts], np.uint64)
        first = np.searchsorted(self.keys, keys)
        hit = first < len(self.keys)
        hit[hit] = self.keys[first[hit]] == keys[hit]
        out: list[tuple[str, str] | None] = [None] * len(texts)
        for k in np.flatnonzero(hit).tolist():
            at, raw = int(first[k]), texts[k].encode("utf-8", "surrogatepass")
            while at < len(self.keys) and self.keys[at] == keys[k]:
                begin = int(self.ends[at - 1]) if at else 0
                if self.strings[begin : int(self.ends[at])].tobytes() == raw:
                    out[k] = (texts[k], "block" if self.blocks[at] else "allow")
                    break
                at += 1
        return out


def _candidates(host_: str, path_: str, lengths: list[int]) -> list[str]:
    """Every listed form that could fit: the host and all above it, with prefixes of the path as long as listed ones."""
    starts = [0, *(k + 1 for k, c in enumerate(host_) if c == ".")]
    return [host_[s:] + path_[:n] for s in starts if host_[s:] for n in lengths if n <= len(path_)]


def _apply(urls: DataFrame, blobs: dict[str, bytes]) -> DataFrame:
    shared = urls.sparkSession.sparkContext.broadcast(blobs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            listed = DigestArray(folder, shared.value)
            lengths = listed.lengths.tolist()
            for batch in batches:
                rule, verdict = column(batch, "rule").to_pylist(), column(batch, "verdict").to_pylist()
                forms = [_candidates(h, p, lengths) for h, p in zip(column(batch, "host").to_pylist(), column(batch, "path").to_pylist())]
                found = iter(listed.probe([f for own in forms for f in own]))
                for k, own in enumerate(forms):
                    for f in [next(found) for _ in own]:
                        if f and (rule[k] is None or (len(f[0]), f[0]) > (len(rule[k]), rule[k])):
                            rule[k], verdict[k] = f
                yield batch.set_column(3, "rule", pa.array(rule, pa.string())).set_column(4, "verdict", pa.array(verdict, pa.string()))

    return urls.mapInArrow(run, urls.schema)


def judge_urls(pages: DataFrame, listed: DataFrame, default: str = DEFAULT, array_bytes: int = ARRAY_BYTES) -> DataFrame:
    """Verdict for every row of ``pages`` (page_id, url) under ``listed`` (entry: host and path, verdict: allow or block).

    An entry fits its host and all subdomains where the path starts with the
    entry's; the longest wins, of equal ones the last by code point. Returns
    page_id, host, path, rule (the entry, or null) and verdict (the entry's, or
    ``default``). Of entries listed twice a block counts. Entries without ``/``
    or null are left out. Null urls have an empty host and path and the default.
    Repeated rows get equal rows; other columns are not read.

    The list becomes arrays of at most ``array_bytes``, which are broadcast and
    mapped into memory from the task's own folder. Each array is one pass.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col("page_id").cast("long"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"),
        F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    entries = listed.where(F.instr("entry", "/") > 0).groupBy("entry").agg(F.max("verdict").alias("verdict"))
    size = entries.agg(F.sum(F.octet_length("entry") + 16)).first()[0] or 0
    n = -(-size // array_bytes)
    for part in range(n):
        own = entries.where(F.pmod(F.xxhash64("entry"), F.lit(n)) == part).collect()
        if own:
            rows = _apply(rows, DigestArray.pack([(r.entry, r.verdict) for r in own]))
    return rows
