"""Mixing sources to target weights by fitting word budgets over counts of documents by length."""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.words import word_count
from pairloom.operators.joins import fits_broadcast
from pairloom.sources.tables import scratch, stage

WEIGHTS = (5, 2, 1)
TOTAL_PERCENT = 150
MOST_REPEATS = 2
SEED = 17
#: Words that the table of reachable sums spans to both sides: so many, or so many times the longest length that it moves.
SPAN, LONGEST = 1 << 14, 32
#: Longer documents are dealt with the others, but not moved to meet a budget exactly.
MOVED = 1 << 21
#: Parts of the documents of one length, so that many tasks choose among them.
PART_BITS = 12
_LOOKUP_BYTES = 64 << 20
_CHUNK = 10_000
_LAST = (1 << 63) - 1


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = TOTAL_PERCENT, most: int = MOST_REPEATS
) -> DataFrame:
    """Words that each source shall give: ``sk, source_size, target`` from ``sk, source, source_size``.

    Sources by code point, null last, have the weights in turn. A source gives
    at most ``most`` times its size; what it can't give is shared by the others
    by weight. In the order of ``limit / weight`` those at their limit come
    first, so that running sums find the level of the rest. One row for each
    source is handled here, by one task.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    order = Window.orderBy("ratio", "sk")
    below, onward, every = (
        order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing),
        Window.partitionBy())
    rows = sizes.withColumn("w", turn).withColumn("limit", F.col("source_size") * float(most))
    rows = rows.withColumn("ratio", F.col("limit") / F.col("w"))
    total = F.sum("source_size").over(every) * (percent / 100)
    rows = rows.withColumn("level", (total - F.coalesce(F.sum("limit").over(below), F.lit(0.0))) / F.sum("w").over(onward))
    rows = rows.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "sk", "level"))).over(every).level)
    return rows.select("sk", "source_size", F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("w"), F.col("limit"))).alias("target"))


def deal(lengths: list[int], counts: list[int], budget: int, seed: int = SEED) -> list[int]:
    """Of each length the same share, ``budget`` to all words; what rounding leaves falls by running sums from a seeded start.

    So any run of neighbouring lengths gives its share to within a document.
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    at = random.Random(seed).randrange(total)
    taken = [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: lengths[k]):
        taken[k] = (at + counts[k] * budget) // total - at // total
        at += counts[k] * budget
    return taken


def fit_counts(lengths: list[int], counts: list[int], budget: int, span: int = SPAN, seed: int = SEED) -> list[int]:
    """How many documents of each length to take, so that their words come as near to ``budget`` as can be, never above.

    Every length gives its share first. A bounded knapsack then moves documents
    in and out, in a seeded order of lengths, until the rest is met: bits of a
    whole number stand for reachable differences, counts go in by powers of two.
    """
    if sum(n * c for n, c in zip(lengths, counts)) <= budget:
        return list(counts)
    taken = deal(lengths, counts, budget, seed)
    left = budget - sum(n * t for n, t in zip(lengths, taken))
    moved = [k for k, n in enumerate(lengths) if 0 < n <= MOVED and counts[k]]
    width = min(sum(lengths[k] * counts[k] for k in moved), max([span, *(LONGEST * lengths[k] for k in moved)]))
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        if abs(left) <= width:
            break  # beyond it only where documents are too long to be moved
        if lengths[k]:
            more = max(-taken[k], min(counts[k] - taken[k], left // lengths[k]))
            taken[k] += more
            left -= more * lengths[k]
    random.Random(seed).shuffle(moved)
    step = math.gcd(*(lengths[k] for k in moved))
    goal = left - left % step + width if step else width
    steps: list[tuple[int, int, int]] = []
    reach, every = 1 << width, (1 << (2 * width + 1)) - 1
    for k in moved:
        for sign, free in ((1, counts[k] - taken[k]), (-1, taken[k])):
            free, part = min(free, 2 * width // lengths[k]), 1
            while free > 0 and not reach >> goal & 1:
                part = min(part, free)
                by = part * lengths[k]
                more = reach | (reach << by if sign > 0 else reach >> by)
                if more & every != reach:
                    steps.append((k, sign * part, reach))
                    reach = more & every
                free, part = free - part, part * 2
        if reach >> goal & 1:
            break
    at = (reach & ((1 << (left + width + 1)) - 1)).bit_length() - 1
    for k, part, earlier in reversed(steps):
        if not earlier >> at & 1:
            at -= part * lengths[k]
            taken[k] += part
    return taken


def length_plan(hist: DataFrame, targets: DataFrame, span: int = SPAN) -> DataFrame:
    """``sk, size, passes, more``: how often every document of a length is taken, and of how many one time more.

    A group holds one row for each length in a source, however many documents
    there are.
    """
    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        whole, target = int(rows.source_size[0]), round(float(rows.target[0]))
        passes = min(target // whole, MOST_REPEATS) if whole else 0
        sizes = [int(x) for x in rows["size"]]
        more = fit_counts(sizes, [int(x) for x in rows["n"]], target - passes * whole, span) if passes < MOST_REPEATS else [0] * len(sizes)
        return pd.DataFrame({"sk": rows.sk, "size": sizes, "passes": passes, "more": more})

    return hist.join(targets, "sk").groupBy("sk").applyInPandas(plan, "sk string, size long, passes int, more long")


def _hashes(docs: DataFrame, seed: int) -> list[Column]:
    """``h``: the seeded hash of the id that orders the rows of a length, not negative; ``g``: a hash of the whole row, for equal ids."""
    whole = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    return [F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), 1).alias("h"), F.xxhash64(*whole).alias("g")]


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))


def _narrow(docs: DataFrame, seed: int, size: Column | None) -> DataFrame:
    words = word_count(F.col("text")) if size is None else size
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), _source_key().alias("sk"), words.alias("size"), *_hashes(docs, seed))


def _cuts(rows: DataFrame, span: int) -> DataFrame:
    """``sk, size, source_size, target, passes, h1, g1, ties, same``: rows of a length before (h1, g1) go once more, and ``ties`` of the ``same`` at it.

    Rows are counted by ranges of the hash; only those of the range that holds the cut are ranked.
    """
    part = F.shiftright("h", 63 - PART_BITS).cast("int")
    cells = stage(rows.groupBy("sk", "source", "size", part.alias("part")).agg(F.count("*").alias("n")), "lengths")
    hist = cells.groupBy("sk", "source", "size").agg(F.sum("n").alias("n"))
    sources = hist.groupBy("sk", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = stage(source_targets(sources), "targets")
    plan = stage(length_plan(hist.drop("source"), targets, span), "plan")
    lookup = F.broadcast(plan) if fits_broadcast(plan, _LOOKUP_BYTES) else plan
    earlier = Window.partitionBy("sk", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    at = cells.select("sk", "size", "part", "n", before.alias("before")).join(lookup, ["sk", "size"]).where("before < more and more <= before + n")
    at = stage(at.select("sk", "size", "part", "n", (F.col("more") - F.col("before")).alias("rank")), "at")
    whole = at.where("rank = n").select("sk", "size", F.lit(_LAST).alias("g1"), F.lit(0).cast("long").alias("ties"), F.lit(0).cast("long").alias("same"), (
        F.shiftleft(F.col("part").cast("long"), 63 - PART_BITS) + ((1 << 63 - PART_BITS) - 1)).alias("h1"))
    split = at.where("rank < n").select("sk", "size", "part", "rank")
    split = F.broadcast(split) if fits_broadcast(split, _LOOKUP_BYTES) else split
    near = rows.withColumn("part", part).join(split, ["sk", "size", "part"]).groupBy("sk", "size", "rank", "h", "g").agg(F.count("*").alias("same"))
    upto = F.sum("same").over(Window.partitionBy("sk", "size").orderBy("h", "g"))
    near = near.withColumn("upto", upto).where("upto >= rank and upto - same < rank")
    near = near.select("sk", "size", F.col("g").alias("g1"), (F.col("rank") - F.col("upto") + F.col("same")).alias("ties"), "same", F.col("h").alias("h1"))
    return plan.join(targets, "sk").join(whole.unionByName(near), ["sk", "size"], "left")


def _decided(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows with ``times``; null where only some of the rows that are alike are taken once more."""
    lookup = F.broadcast(cuts) if fits_broadcast(cuts, _LOOKUP_BYTES) else cuts
    once = F.expr("h1 is not null and (h < h1 or h = h1 and (g < g1 or g = g1 and ties = same))")
    split = F.expr("h1 is not null and h = h1 and g = g1 and ties < same")
    return rows.join(lookup, ["sk", "size"]).withColumn("times", F.when(split, None).otherwise(F.col("passes") + F.when(once, 1).otherwise(0)).cast("int"))


def _copies(n: Column) -> Column:
    """The numbers from 1 to ``n``, in lists of bounded length."""
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _CHUNK)), lambda k: F.sequence(k * _CHUNK + 1, F.least(n, (k + 1) * _CHUNK)))


def mix_sources(docs: DataFrame, seed: int = SEED, size: Column | None = None, span: int = SPAN) -> DataFrame:
    """How often the mix takes every row of ``docs`` (doc_id, text, source are read; others tell rows of one id apart).

    Size: words of the text (null: 0), or the column given. Returns doc_id, size,
    source_size, target (see ``source_targets``), times and taken = times * size.
    A source is taken whole as often as its target allows; for the rest of its
    budget the plan says how many documents of each length, and the order of a
    seeded hash of the id says which. Documents without words count as taken
    with every whole pass and not beyond. Repeated rows are rows of their own;
    a null id is hashed like any other. Without rows the result is empty.
    """
    rows = stage(_narrow(docs, seed, size), "mix")
    decided = _decided(rows, stage(_cuts(rows, span), "cuts"))
    out = ["doc_id", "size", "source_size", "target", "times"]
    alike = decided.where("times is null").groupBy("doc_id", "size", "source_size", "target", "passes", "ties").agg(F.count("*").alias("n"))
    alike = alike.withColumn("some", F.explode(_copies(F.col("n")))).withColumn("k", F.explode("some")).withColumn(
        "times", (F.col("passes") + F.when(F.col("k") <= F.col("ties"), 1).otherwise(0)).cast("int"))
    every = decided.where("times is not null").select(*out).unionByName(alike.select(*out))
    return every.select(
        "doc_id", "size", F.col("source_size").cast("long"), "target", (F.col("times") * F.col("size")).cast("long").alias("taken"), "times")


def mixed_rows(docs: DataFrame, seed: int = SEED, span: int = SPAN) -> DataFrame:
    """The rows of ``docs`` as often as ``mix_sources`` takes them, with all their columns.

    The decision is a small table of lengths that is joined to the rows, so
    texts stay where they are; only rows that are alike in all columns, and of
    which some are taken, are counted as one.
    """
    with scratch(docs.sparkSession) as keep:
        cuts = keep(_cuts(stage(_narrow(docs, seed, None), "mix"), span), "cuts")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(
        c for c in (_source_key().alias("sk"), word_count(F.col("text")).alias("size"), *_hashes(docs, seed))))
    decided = _decided(rows, cuts)
    alike = decided.where("times is null").groupBy("row", "passes", "ties").agg(F.count("*").alias("n"))
    alike = alike.select("row", (F.col("passes") * F.col("n") + F.col("ties")).alias("n")).where("n > 0")
    alike = alike.withColumn("some", F.explode(_copies(F.col("n")))).select("row", F.explode("some"))
    taken = decided.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return taken.select("row.*").unionByName(alike.select("row.*"))
