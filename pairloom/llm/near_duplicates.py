"""Near duplicates by b-bit MinHash: banded minima find candidates, packed low bits sift them, full sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.graphs import connected_components
from pairloom.llm.words import column, mix, shingle_sets
from pairloom.operators.joins import fits_broadcast
from pairloom.sources.tables import scratch, stage

WIDTH = 5
PERCENT = 75
MINIMA = 128
BANDS = 32
BITS = 4
#: A pair is sifted out only where its estimate is four and a half standard errors below the limit.
MARGIN = 0.18
#: Pairs of one document that one task checks.
BLOCK = 1024
#: Documents of a bucket that one task holds on either side, when those of different components meet.
FEW, MANY = 4096, 1024
#: Bytes of ids that are broadcast to find their texts.
_LOOKUP_BYTES = 16 << 20
_SLICE = 512
_SEED = 20_231


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    return rng.integers(1 << 31, size=MINIMA, dtype=np.uint32) * 2 + 1, rng.integers(1 << 32, size=MINIMA, dtype=np.uint32)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """For each set (not empty) its minimum under each of the hash functions: ``len(sets) x MINIMA``."""
    out = np.empty((len(sets), MINIMA), np.uint32)
    if not sets:
        return out
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    for k, (a, b) in enumerate(zip(*_factors())):
        out[:, k] = np.minimum.reduceat(x * a + b, starts)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band, equal where all minima of the band are: ``sets x BANDS``."""
    rows = MINIMA // BANDS
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        key = mix(key + least[:, k::rows].astype(np.uint64))
    return key.view(np.int64)


def packed_bits(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima as 64-bit words; the words of one bit follow one another: ``sets x BITS * MINIMA / 64``."""
    planes = [np.packbits((least >> np.uint32(b) & np.uint32(1)).astype(np.uint8), axis=1) for b in range(BITS)]
    return np.ascontiguousarray(np.concatenate(planes, axis=1)).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, len(whole), _SLICE):
            batch = whole.slice(at, _SLICE)
            sets = shingle_sets(column(batch, "text"), WIDTH)
            full = [k for k, s in enumerate(sets) if len(s)]
            least = minima([sets[k] for k in full])
            keys, bits = [None] * len(sets), [None] * len(sets)
            for k, a, b in zip(full, band_keys(least), packed_bits(least)):
                keys[k], bits[k] = a, b
            yield pa.RecordBatch.from_arrays([
                column(batch, "doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())),
            ], ["doc_id", "n_shingles", "digest", "bands", "bits"])


def signatures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, digest of the shingle set, band keys and packed low bits (null without words)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _signatures, "doc_id long, n_shingles long, digest binary, bands array<long>, bits array<long>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, len(whole), _SLICE):
            batch = whole.slice(at, _SLICE)
            sets = [s.view(np.int64) for s in shingle_sets(column(batch, "text"), WIDTH)]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "items"])


def estimate(a: str, b: str) -> Column:
    """Similarity by equal low bits of the minima, less what falls together by chance."""
    words = MINIMA // 64
    apart = []
    for w in range(words):
        planes = [F.get(a, F.lit(p * words + w)).bitwiseXOR(F.get(b, F.lit(p * words + w))) for p in range(BITS)]
        apart.append(F.bit_count(reduce(Column.bitwiseOR, planes)))
    chance = 2.0**-BITS
    return ((MINIMA - reduce(Column.__add__, apart)) / MINIMA - chance) / (1 - chance)


def _similar(x: str, y: str, percent: int) -> Column:
    shared = F.size(F.array_intersect(x, y))
    return 100 * shared >= percent * (F.size(x) + F.size(y) - shared)


def _full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, items`` for the documents named in ``ids``; an id of several texts has several rows."""
    ids = stage(ids.distinct(), "ids")
    ids = F.broadcast(ids) if fits_broadcast(ids, _LOOKUP_BYTES) else ids
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
    sets = texts.join(ids, "id", "left_semi").mapInArrow(_sets, "id long, items array<long>")
    return stage(sets.withColumn("same", F.xxhash64("items")), "sets").dropDuplicates(["id", "same"]).drop("same")


def _confirm(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough.

    The set of a document with many pairs is copied once for each 1,024 of them.
    """
    with scratch(docs.sparkSession) as keep:
        pairs = stage(pairs, "pairs")
        if pairs.isEmpty():
            return keep(pairs, "links")
        sets = _full_sets(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
        slices = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("slices"))
        left = sets.withColumnRenamed("id", "a").join(slices, "a").select(
            "a", F.col("items").alias("x"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        right = pairs.join(slices, "a").withColumn("slice", F.pmod(F.xxhash64("b"), F.col("slices")).cast("int"))
        right = right.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
        found = left.join(right.drop("slices"), ["a", "slice"]).where(_similar("x", "y", percent)).select("a", "b")
        return keep(found.distinct(), "links")


def _shared_buckets(keyed: DataFrame) -> DataFrame:
    """The rows of buckets with two documents or more, with the bucket's smallest id ``a``."""
    centres = keyed.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a != z").drop("z")
    return stage(keyed.join(centres, "key"), "buckets")


def _pairs(left: Column, right: Column) -> list[Column]:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def _mixed(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """``key, id, component, most`` of the buckets that hold several components; ``most`` is the largest."""
    rows = buckets.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    most = parts.groupBy("key").agg(F.max(F.struct("n", "component")).component.alias("most"), F.count("*").alias("parts"))
    return stage(rows.join(most.where("parts > 1").drop("parts"), "key"), "mixed")


def _likely(pairs: DataFrame, signs: DataFrame, least: float) -> DataFrame:
    """The pairs whose low bits don't rule them out."""
    for side in "ab":
        pairs = pairs.join(signs.select(F.col("id").alias(side), F.col("bits").alias(f"x{side}")), side)
    return pairs.where(estimate("xa", "xb") >= least).select("a", "b").distinct()


def _all_across(mixed: DataFrame, signs: DataFrame, sets: DataFrame, percent: int, least: float) -> DataFrame:
    """Links between documents that share a bucket and are in different components.

    Documents outside the largest component of their bucket meet all others
    whose set's size allows the similarity: sizes fall into levels, and only
    neighbouring levels meet. Both sides are cut into blocks, so that a bucket
    of any size is spread over tasks. Two documents meet in the first bucket
    that they share. Low bits go to the buckets first; only documents that these
    leave with a partner take their full sets there, which decide where two
    documents meet, so only true links become rows.
    """
    step = max(math.log(100 / percent), 0.01) * (1 + 1e-9)  # a little wider than the ratio of two sizes can be
    level = F.floor(F.log(F.col("n_shingles")) / step).cast("int")
    keys = mixed.groupBy("id").agg(F.collect_set("key").alias("keys"))
    rows = stage(mixed.distinct().join(keys, "id").join(signs.withColumn("level", level), "id"), "levels")
    outside = rows.where(F.col("component") != F.col("most"))
    outside = outside.withColumn("level", F.explode(F.array(*(F.col("level") + k for k in (-1, 0, 1)))))
    parts = outside.groupBy("key", "level").agg(F.ceil(F.count("*") / FEW).cast("int").alias("parts"))
    blocks = rows.groupBy("key", "level").agg(F.ceil(F.count("*") / MANY).cast("int").alias("blocks"))
    cells = stage(blocks.join(parts, ["key", "level"]), "cells")
    few = outside.join(cells, ["key", "level"]).withColumn(
        "part", F.pmod(F.xxhash64(F.lit(1), "id"), F.col("parts")).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = rows.join(cells, ["key", "level"]).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell, own = ["key", "level", "block", "part"], ["id", "component", "n_shingles", "keys", "bits"]
    few = stage(few.select(*cell, *own), "few")
    every = stage(every.select(*cell, *(F.col(c).alias(f"other_{c}") for c in own)), "every")

    apart = F.col("component") != F.col("other_component")
    small, large = (f("n_shingles", "other_n_shingles") for f in (F.least, F.greatest))
    first = F.array_min(F.array_intersect("keys", "other_keys"))
    likely = apart & (100 * small >= percent * large) & (estimate("bits", "other_bits") >= least)
    together = reduce(Column.__and__, [few[c] == every[c] for c in cell]) & likely & (first == few["key"])
    left = stage(few.join(every, together, "left_semi"), "left")
    right = stage(every.join(few, together, "left_semi"), "right")
    sets = stage(sets.join(left.select("id").union(right.select("other_id")).distinct(), "id", "left_semi"), "sets")
    left = left.join(sets, "id").where(F.size("items") == F.col("n_shingles"))
    right = right.join(sets.select(F.col("id").alias("other_id"), F.col("items").alias("other_items")), "other_id").where(
        F.size("other_items") == F.col("other_n_shingles"))
    met = left.join(right, cell).where(likely & (first == F.col("key")) & _similar("items", "other_items", percent))
    return met.select(*_pairs(F.col("id"), F.col("other_id"))).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, margin: float = MARGIN) -> DataFrame:
    """Groups of documents whose sets of five-word shingles have a similarity of ``percent`` or more.

    Reads doc_id and text. Returns doc_id, n_shingles, component_id (the
    smallest id that links reach, the own one included) and kept (the own id is
    that one). A text with fewer than five words is one shingle; without words
    the set is empty and linked with nothing. Rows with equal ids are one
    document with the links of all their texts; null ids have a null component
    and are kept. Other columns are not read. An empty table gives an empty
    result.

    Equal sets are joined first, by digest. Documents that share a band meet
    their bucket's smallest id; then those still in different components meet
    all others, and components are formed anew. A pair at the limit shares one
    of 32 bands of four minima with probability 0.999995, so links are complete
    but for that; every link is confirmed on the full sets.
    """
    with scratch(docs.sparkSession) as keep:
        least = percent / 100 - margin
        rows = stage(signatures(docs), "signatures")
        sized = rows.where("digest is not null and doc_id is not null")
        classes = stage(sized.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "classes")
        first = sized.withColumnRenamed("doc_id", "id").join(classes.select("digest", "id"), ["digest", "id"], "left_semi")
        first = stage(first.select("id", "digest", "n_shingles", "bands", "bits").dropDuplicates(["id", "digest"]), "representatives")
        buckets = _shared_buckets(first.select("id", F.explode("bands").alias("key")))
        signs = first.select("id", "n_shingles", "bits")

        several = sized.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x != y").select("doc_id")
        same = sized.join(several, "doc_id", "left_semi").join(classes.select("digest", "id"), "digest")
        links = stage(same.where("doc_id != id").select(*_pairs(F.col("doc_id"), F.col("id"))).distinct(), "links")
        near = buckets.where("id != a").select("a", F.col("id").alias("b")).distinct()
        found = connected_components(links.union(_confirm(_likely(near, signs, least), docs, percent)))
        mixed = _mixed(buckets, found)
        if not mixed.isEmpty():
            links = stage(_all_across(mixed, signs, _full_sets(docs, mixed.select("id")), percent, least), "links")
            if not links.isEmpty():
                stars = found.select(F.col("component").alias("a"), F.col("id").alias("b"))
                found = connected_components(stars.union(links))

        groups = classes.join(found, "id", "left").select("digest", "n", F.coalesce("component", "id").alias("component"))
        large = F.broadcast(stage(groups.where(F.col("n") * 200 > rows.count()), "large"))  # at most 199 rows
        small = groups.join(large.select("digest"), "digest", "left_anti").select("digest", F.col("component").alias("small"))
        out = rows.join(large.select("digest", F.col("component").alias("large")), "digest", "left")
        out = out.withColumn("own", F.when(F.col("large").isNull(), F.col("digest"))).join(
            small.withColumnRenamed("digest", "own"), "own", "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("large", "small", "doc_id"))
        return keep(out.select(
            "doc_id", "n_shingles", component.alias("component_id"),
            F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), "near")
