"""How the terms of each source differ from those of other sources and of all texts of its language.

Terms travel as digests of a fixed width. Each digest's least and greatest
string show whether two terms share it; such digests are counted again by their
strings. Texts come back only for the terms of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.words import column
from pairloom.operators.joins import fits_broadcast
from pairloom.sources.tables import stage

MIN_DOCUMENTS = 3
TOP = 200
BITS = 64
#: Rows whose terms are counted at once, digests whose strings a task remembers to have sent, pairs of sources summed at once.
ROWS, SENT, PAIRS = 4096, 1 << 19, 1 << 21
#: Bytes of text that are counted at once, if there is more than one row.
TEXT_BYTES = 8 << 20
_LOOKUP_BYTES = 16 << 20
#: What stands for each byte of a text: A-Z lower-cased, a-z and bytes beyond ASCII as they are, a space for all others.
_LETTERS = np.array([b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)], np.uint8)


def terms(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Of a batch of texts (without nulls): the row of each term, and the terms."""
    filled = texts.cast(pa.large_string())
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    raw = np.frombuffer(filled.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    plain = pa.LargeStringArray.from_buffers(
        len(filled), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(_LETTERS[raw].tobytes()))
    lists = pc.split_pattern(plain, " ")
    flat = pc.list_flatten(lists)
    rows = np.repeat(np.arange(len(filled), dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    real = pc.not_equal(flat, "")
    return rows[real.to_numpy(zero_copy_only=False)], flat.filter(real).dictionary_encode()


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``ROWS`` rows and, but for single rows, ``TEXT_BYTES`` bytes of text."""
    size = np.cumsum(pc.binary_length(column(batch, "text")).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + TEXT_BYTES, "right"))
        end = max(at + 1, min(end, at + ROWS))
        yield batch.slice(at, end - at)
        at = end


def _counted(bits: int, by_text: bool):
    """Of each slice: counts by group and digest (``by_text``: and term); else also the strings of digests that weren't sent yet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[int, str] = {}
        fields = ["gid", "digest", "n", "documents", "term"]
        for batch in (x for whole in batches for x in _slices(whole)):
            rows, coded = terms(column(batch, "text"))
            if not len(rows):
                continue
            names = coded.dictionary.to_pylist()
            digest = (np.array([xxhash.xxh3_64_intdigest(x) for x in names], np.uint64) >> np.uint64(64 - bits)).view(np.int64)
            gid = column(batch, "gid").to_numpy().astype(np.int64)
            one, n = np.unique(rows * np.int64(len(names)) + coded.indices.to_numpy(), return_counts=True)
            key, where = np.unique(gid[one // len(names)] * len(names) + one % len(names), return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, where, n)
            term = key % len(names)
            yield pa.RecordBatch.from_arrays([
                pa.array((key // len(names)).astype(np.int32)), pa.array(digest[term]), pa.array(total),
                pa.array(np.bincount(where, minlength=len(key)).astype(np.int64)),
                coded.dictionary.take(pa.array(term)).cast(pa.string()) if by_text else pa.nulls(len(key), pa.string())], fields)
            if by_text:
                continue
            if len(sent) > SENT:
                sent.clear()
            fresh = [k for k, (d, x) in enumerate(zip(digest.tolist(), names)) if sent.get(d) != x]
            sent.update((int(digest[k]), names[k]) for k in fresh)
            none = pa.nulls(len(fresh), pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.nulls(len(fresh), pa.int32()), pa.array(digest[fresh]), none, none, pa.array([names[k] for k in fresh], pa.string())], fields)
    return run


_CELLS = "gid int, digest long, n long, documents long, term string"


def group_counts(docs: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Counts of terms by group, and the terms' strings, of ``docs`` (gid, text without nulls).

    First: gid, digest, split, n (occurrences), documents (rows with the term).
    Second: digest, split, term, one row for each term. ``split`` is 0 but for
    digests that several terms share: those are counted by string in a second
    reading of the texts, and their terms numbered.
    """
    rows = docs.select("gid", "text")
    cells = stage(rows.mapInArrow(_counted(bits, False), _CELLS), "cells")
    ends = cells.where("n is null").groupBy("digest").agg(F.min("term").alias("least"), F.max("term").alias("greatest"))
    ends = stage(ends, "terms")
    split = F.lit(0).alias("split")
    counts = cells.where("n is not null").groupBy("gid", "digest").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    names = ends.where("least = greatest").select("digest", split, F.col("least").alias("term"))
    shared = stage(ends.where("least != greatest").select("digest"), "shared")
    if shared.isEmpty():
        return counts.select("gid", "digest", split, "n", "documents"), names
    lookup = F.broadcast(shared) if fits_broadcast(shared, _LOOKUP_BYTES) else shared
    again = rows.mapInArrow(_counted(bits, True), _CELLS).join(lookup, "digest", "left_semi")
    again = stage(again.groupBy("gid", "digest", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")), "split")
    order = F.row_number().over(Window.partitionBy("digest").orderBy("term")).alias("split")
    numbered = stage(again.select("digest", "term").distinct().select("digest", order, "term"), "numbered")
    again = again.join(numbered, ["digest", "term"]).select("gid", "digest", "split", "n", "documents")
    counts = counts.join(lookup, "digest", "left_anti").select("gid", "digest", split, "n", "documents")
    return counts.unionByName(again), names.unionByName(numbered)


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10 ** 9 * (n + 1) / total), by long division in steps of 1,000: nothing leaves 64 bits below 9e15 occurrences."""
    rest, out = n + 1, 0
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def _share_sql(n: str, total: str) -> str:
    """``shares`` as SQL."""
    rest, out = f"({n} + 1)", "0L"
    for _ in range(3):
        out, rest = f"({out} * 1000 + {rest} * 1000 div {total})", f"({rest} * 1000 % {total})"
    return f"({out} + 1)"


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class _Sums:
    """Sums by key that are given out when there are many."""

    def __init__(self, most: int):
        self.most, self.held, self.size = most, [], 0

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.held.append(self._added(keys, values))
        self.size += len(self.held[-1][0])
        if self.size > self.most and len(self.held) > 1:
            self.held = [self._added(*map(np.concatenate, zip(*self.held)))]
            self.size = len(self.held[0][0])

    @staticmethod
    def _added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(keys, return_inverse=True)
        out = np.zeros(len(keys), np.int64)
        np.add.at(out, where, values)
        return keys, out

    def full(self) -> bool:
        return self.size > self.most // 2

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = self._added(*map(np.concatenate, zip(*self.held)))
        self.held, self.size = [], 0
        return out


def _expand(size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For items with ``size`` partners each: items and the partners' numbers, about ``PAIRS`` of them at once."""
    done = np.cumsum(size)
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, "right")))
        own = size[at:end]
        item = np.repeat(np.arange(at, end), own)
        yield item, np.arange(len(item)) - np.repeat(np.cumsum(own) - own, own)
        at = end


def _pair_sums(shared):
    """Of batches of terms: for each pair of groups what their terms add to the gap of two groups without them.

    A term of both groups is met where its groups are paired; a term of one of
    them counts by how many terms have the same count there.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first, groups = shared.value  # by group: denominator, first group of its language, groups of the language
        none = shares(np.zeros(len(total), np.int64), np.maximum(total, 1))
        sums = _Sums(PAIRS)

        def given() -> pa.RecordBatch:
            keys, values = sums.take()
            a, b = np.divmod(keys, len(total))
            return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(values)], ["a", "b", "value"])

        for batch in batches:
            lists = column(batch, "gids")
            size = lists.value_lengths().to_numpy()
            gid, n = (column(batch, c).flatten().to_numpy().astype(np.int64) for c in ("gids", "ns"))
            p = shares(n, total[gid])
            start = np.repeat(np.cumsum(size) - size, size)
            for item, other in _expand(np.repeat(size, size)):
                other = start[item] + other
                item, other = item[item != other], other[item != other]
                g, h = gid[item], gid[other]
                both = gaps(p[item], p[other]) - gaps(p[item], none[h]) - gaps(none[g], p[other]) + gaps(none[g], none[h])
                sums.add(g * len(total) + h, both)
            each, times = np.unique(np.stack([gid, n]), axis=1, return_counts=True)
            own, share = each[0], shares(each[1], total[each[0]])
            for item, other in _expand(groups[own]):
                h = first[own[item]] + other
                item, h = item[own[item] != h], h[own[item] != h]
                g, q = own[item], share[item]
                apart = gaps(none[g], none[h])
                sums.add(g * len(total) + h, times[item] * (gaps(q, none[h]) - apart))
                sums.add(h * len(total) + g, times[item] * (gaps(none[h], q) - gaps(none[h], none[g])))
            if sums.full():
                yield given()
        if sums.held:
            yield given()
    return run


_SIZES = "gid int, lang string, source string, terms long, lang_total long, total long"


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    """The result's columns of ``lang, source, gid, item, value``."""
    order = Window.partitionBy("gid").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _term_part(cells: DataFrame, names: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    """The terms of each group with the largest gaps; strings join once the values have named the terms that can be among them."""
    shares_of = cells.join(F.broadcast(sizes.drop("lang")), "gid").select(
        "gid", "digest", "split", F.expr(_share_sql("n", "total")).alias("p"), F.expr(_share_sql("lang_n", "lang_total")).alias("q"))
    found = stage(shares_of.where("p > q").select("gid", "digest", "split", F.expr("(p - q) * (p - q) div q").alias("value")), "gaps")
    by_value = Window.partitionBy("gid").orderBy(F.desc("value"))
    bounds = found.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top).groupBy("gid").agg(F.min("value").alias("bound"))
    near = stage(found.join(F.broadcast(bounds), "gid").where("value >= bound").drop("bound"), "near")
    near = F.broadcast(near) if fits_broadcast(near, _LOOKUP_BYTES) else near
    named = names.join(near, ["digest", "split"]).join(F.broadcast(sizes.select("gid", "lang", "source")), "gid")
    return _ranked(named.withColumnRenamed("term", "item"), "term").where(F.col("rank") <= top)


def _pair_part(kept: DataFrame, sizes: DataFrame, rows: list[tuple]) -> DataFrame:
    """The gap of each group to each other group of its language."""
    first: dict[str, int] = {}
    for k, lang, *_ in rows:
        first.setdefault(lang, k)
    many = {x: sum(1 for r in rows if r[1] == x) for x in first}
    shared = kept.sparkSession.sparkContext.broadcast((
        np.array([r[5] for r in rows], np.int64), np.array([first[r[1]] for r in rows], np.int64), np.array([many[r[1]] for r in rows], np.int64)))
    sums = kept.select("gids", "ns").mapInArrow(_pair_sums(shared), "a int, b int, value long")
    sums = sums.groupBy("a", "b").agg(F.sum("value").alias("more")).select(F.col("a").alias("gid"), F.col("b").alias("other"), "more")
    other = sizes.select("lang", F.col("gid").alias("other"), F.col("source").alias("item"), F.col("total").alias("other_total"))
    pairs = sizes.repartition("gid").join(F.broadcast(other), "lang").where("gid != other")
    p, q = (_share_sql("0L", f"greatest({c}, 1L)") for c in ("total", "other_total"))
    pairs = pairs.withColumn("p", F.expr(p)).withColumn("q", F.expr(q)).join(sums, ["gid", "other"], "left")
    return _ranked(pairs.withColumn("value", F.expr("terms * ((p - q) * (p - q) div q) + coalesce(more, 0L)")), "pair")


def source_divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP, bits: int = BITS) -> DataFrame:
    """Gaps between the term shares of each (lang, source) group of ``docs``, those of its language's other groups and of the language.

    Terms are runs of letters A-Z (lower-cased), a-z and characters beyond
    ASCII. A language keeps the terms of at least ``min_documents`` of its rows.
    A group's or language's share of a kept term is 1 + floor(10 ** 9 * (count
    + 1) / (N + V)), N its occurrences of kept terms, V their number. Returns
    lang, source, part, item, value, rank. Part ``pair``: each other source of
    the language, value the sum of floor((p - q) ** 2 / q) over all kept terms, p
    the group's share and q the other's. Part ``term``: the ``top`` terms of the
    group whose share exceeds the language's. Ranks go by value, then by item.

    Null text, lang and source are as empty ones; lang, source and text alone
    are read. Repeated rows count each. A language without kept terms has pairs
    of value 0 and no terms; a single source has no pairs; an empty table gives
    an empty result.

    The driver holds one row for each group, whose pairs the result has; so these rows are broadcast too.
    Counts are shuffled as digests; their strings once for each task, and again
    only for terms of the result and those tied with its last.
    """
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))
    rows = docs.select(lang, source, text)
    found = [tuple(r) for r in rows.select("lang", "source").distinct().orderBy("lang", "source").collect()]
    spark = docs.sparkSession
    groups = spark.createDataFrame([(k, *r) for k, r in enumerate(found)], "gid int, lang string, source string")
    counts, names = group_counts(rows.join(F.broadcast(groups), ["lang", "source"]).select("gid", "text"), bits)

    by_term = counts.join(F.broadcast(groups.select("gid", "lang")), "gid").groupBy("lang", "digest", "split").agg(
        F.sum("documents").alias("documents"), F.sum("n").alias("n"), F.collect_list(F.struct("gid", "n")).alias("x"))
    kept = stage(by_term.where(F.col("documents") >= min_documents).select(
        "lang", "digest", "split", "n", F.col("x.gid").alias("gids"), F.col("x.n").alias("ns")), "kept")
    cells = kept.select("lang", "digest", "split", F.col("n").alias("lang_n"), F.explode(F.arrays_zip("gids", "ns")).alias("x")).select(
        "digest", "split", "lang_n", F.col("x.gids").alias("gid"), F.col("x.ns").alias("n"))
    whole = {r.lang: (r.terms, r.n) for r in kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("n")).collect()}
    own = {r.gid: r.n for r in cells.groupBy("gid").agg(F.sum("n").alias("n")).collect()}
    totals = []
    for k, (lang, source) in enumerate(found):
        terms_of, n = whole.get(lang, (0, 0))
        totals.append((k, lang, source, terms_of, n + terms_of, own.get(k, 0) + terms_of))
    sizes = spark.createDataFrame(totals, _SIZES)
    return _term_part(cells, names, sizes, top).unionByName(_pair_part(kept, sizes, totals))
