"""Pair similarity as native column expressions, one row in, one value out.

Token lists are compared by a sort of 64-bit digests and one pass over their
runs, never by searching one list for each token of the other: long texts cost
n log n, and no row is shuffled. Tokens that share a digest are noticed, and
such a pair of lists is counted by its strings.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.constants import SIGMOID_SATURATES_AT
from pairloom.functions.text import folded

# A token seen only in the second text weighs 1 + ln 2 (smoothed idf of one document).
IDF_SHARED = 1.0
IDF_SECOND_ONLY = 1.0 + math.log(2.0)
_BLOCK = 256


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x.cast("double")))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Compute a value once and use it several times in one expression."""
    return F.transform(F.array(value), use)[0]


def _overlap(tokens1: Column, tokens2: Column) -> Column:
    """Both lists with their distinct counts and the number of shared tokens."""
    lists = F.struct(tokens1.alias("t1"), tokens2.alias("t2"))
    return _let(lists, lambda x: F.struct(
        x["t1"].alias("t1"), x["t2"].alias("t2"),
        F.size(F.array_distinct(x["t1"])).alias("d1"), F.size(F.array_distinct(x["t2"])).alias("d2"),
        F.size(F.array_intersect(x["t1"], x["t2"])).alias("shared"),
    ))


def _merged(tokens1: Column, tokens2: Column) -> Column:
    """Both token lists in token order; for equal tokens the first text's come first."""

    def tag(tokens: Column, side: int) -> Column:
        return F.transform(tokens, lambda t: F.struct(t.alias("t"), F.lit(side).alias("s")))

    return F.sort_array(F.concat(tag(tokens1, 1), tag(tokens2, 2)))


def _digest(token: Column) -> Column:
    return F.xxhash64(token)


def _state(**named: Column) -> Column:
    return F.struct(*(value.alias(name) for name, value in named.items()))


def _counted(tokens1: Column, tokens2: Column, start: dict[str, Column], step: Callable, finish: Callable) -> Column:
    """A fold over the runs of equal tokens of a side, by the tokens' digests; the lists are not both empty.

    A digest's last bit is the side, so a token that both lists hold is two
    neighbouring runs, the first list's first. ``step`` gets the state (with the
    places where the last two runs end), the end of a run, and whether the run
    is of the first list and whether its token has a run before it.
    """
    one = F.lit(1).cast("long")

    def tag(tokens: Column, side: int) -> Column:
        return F.transform(tokens, lambda t: F.shiftleft(_digest(t), 1).bitwiseOR(F.lit(side).cast("long")))

    def of(m: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(m)), lambda i: ~F.get(m, i).eqNullSafe(F.get(m, i - 1)))

        def walk(acc: Column, end: Column) -> Column:
            v = F.get(m, end - 1)
            return step(acc, end, v.bitwiseAND(one) == 0, F.get(m, acc["at"] - 1).bitwiseOR(one) == v)

        return F.aggregate(ends, _state(before=F.lit(0), at=F.lit(0), **start), walk, finish)

    # Longs are sorted, not tokens.
    return _let(F.sort_array(F.concat(tag(tokens1, 0), tag(tokens2, 1))), of)


def tfidf_cosine(tokens1: Column, tokens2: Column) -> Column:
    """Cosine of two tf-idf vectors whose idf is fitted on the first text alone.

    Equal lists and empty ones need no counts. A zero norm gives 0.
    """

    def of(x: Column) -> Column:
        return (
            F.when(x["t1"] == x["t2"], F.when(F.size(x["t1"]) == 0, 0.0).otherwise(1.0))
            .when((F.size(x["t1"]) == 0) | (F.size(x["t2"]) == 0), 0.0)
            .otherwise(_let(_counted_cosine(x["t1"], x["t2"]), lambda c: F.when(
                c.isNull(), _folded_cosine(x["t1"], x["t2"])).otherwise(c)))
        )

    return _let(F.struct(tokens1.alias("t1"), tokens2.alias("t2")), of)


def _counted_cosine(tokens1: Column, tokens2: Column) -> Column:
    """The cosine of two lists by counts of digests, NULL if tokens share a digest."""
    start = {"different": F.lit(0), **{name: F.lit(0.0) for name in ("dot", "sq1", "both", "only")}}

    def step(acc: Column, end: Column, first: Column, shared: Column) -> Column:
        c, ends = (end - acc["at"]).cast("double"), {"before": acc["at"], "at": end}
        n, dot, sq1, both, only = (acc[f] for f in ("different", "dot", "sq1", "both", "only"))
        return (
            F.when(first, _state(**ends, different=n + 1, dot=dot, sq1=sq1 + c * c, both=both, only=only))
            .when(shared, _state(**ends, different=n, dot=dot + c * (acc["at"] - acc["before"]), sq1=sq1, both=both + c * c, only=only))
            .otherwise(_state(**ends, different=n + 1, dot=dot, sq1=sq1, both=both, only=only + c * c))
        )

    def finish(acc: Column) -> Column:
        norm = F.sqrt(acc["sq1"]) * F.sqrt(acc["both"] + acc["only"] * F.lit(IDF_SECOND_ONLY**2))
        unambiguous = acc["different"] == F.size(F.array_distinct(F.concat(tokens1, tokens2)))
        return F.when(unambiguous, F.try_divide(acc["dot"], norm))

    return _counted(tokens1, tokens2, start, step, finish)


def _folded_cosine(tokens1: Column, tokens2: Column) -> Column:
    """The cosine by one pass over the merged lists.

    Running squares use (n + 1)^2 - n^2 = 2n + 1, so one pass gives the dot
    product and both norms.
    """
    def state(t: Column, a: Column, b: Column, dot: Column, sq1: Column, sq2: Column) -> Column:
        named = {"t": t, "a": a, "b": b, "dot": dot, "sq1": sq1, "sq2": sq2}
        return F.struct(*(value.alias(name) for name, value in named.items()))

    zero, one = F.lit(0.0), F.lit(1.0)
    start = state(F.lit(""), zero, zero, zero, zero, zero)
    second_only = IDF_SECOND_ONLY**2

    def step(acc: Column, x: Column) -> Column:
        a, b, dot, sq1, sq2 = (acc[f] for f in ("a", "b", "dot", "sq1", "sq2"))
        t, first, same = x["t"], x["s"] == 1, acc["t"] == x["t"]
        weight = F.when(a > 0.0, IDF_SHARED**2).otherwise(second_only)
        return (
            F.when(first & same, state(t, a + 1.0, zero, dot, sq1 + a * 2.0 + 1.0, sq2))
            .when(first, state(t, one, zero, dot, sq1 + 1.0, sq2))
            .when(same, state(t, a, b + 1.0, dot + a, sq1, sq2 + weight * (b * 2.0 + 1.0)))
            .otherwise(state(t, zero, one, dot, sq1, sq2 + second_only))
        )

    def finish(acc: Column) -> Column:
        norm = F.sqrt(acc["sq1"]) * F.sqrt(acc["sq2"])
        return F.when(norm == 0.0, 0.0).otherwise(F.try_divide(acc["dot"], norm))

    return F.aggregate(_merged(tokens1, tokens2), start, step, finish)


def common_words(tokens1: Column, tokens2: Column) -> Column:
    """How many tokens of the first list, repeats included, occur in the second.

    Counts are needed only if some repeated tokens are shared and some are not.
    """

    def of(x: Column) -> Column:
        n1, shared = F.size(x["t1"]), x["shared"]
        return (
            F.when(shared == 0, 0)
            .when(shared == x["d1"], n1)
            .when(x["d1"] == n1, shared)
            .otherwise(_let(_counted_common(x), lambda c: F.when(c.isNull(), _folded_common(x["t1"], x["t2"])).otherwise(c)))
        )

    def unless_equal(x: Column) -> Column:
        return F.when(x["t1"] == x["t2"], F.size(x["t1"])).otherwise(_let(_overlap(x["t1"], x["t2"]), of))

    return _let(F.struct(tokens1.alias("t1"), tokens2.alias("t2")), unless_equal)


def _counted_common(x: Column) -> Column:
    """The count of an overlap that shares something, by counts of digests, NULL if tokens share a digest."""
    start = {"different": F.lit(0), "hits": F.lit(0)}

    def step(acc: Column, end: Column, first: Column, shared: Column) -> Column:
        ends, n, hits = {"before": acc["at"], "at": end}, acc["different"], acc["hits"]
        return (
            F.when(~first & shared, _state(**ends, different=n, hits=hits + acc["at"] - acc["before"]))
            .otherwise(_state(**ends, different=n + 1, hits=hits))
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["different"] == x["d1"] + x["d2"] - x["shared"], acc["hits"])

    # Only the first list's repeats count.
    return _counted(x["t1"], F.array_distinct(x["t2"]), start, step, finish)


def _folded_common(tokens1: Column, tokens2: Column) -> Column:
    """The overlap count by one pass over the merged lists."""
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("a"), F.lit(0).alias("hits"))

    def state(t: Column, a: Column, hits: Column) -> Column:
        return F.struct(t.alias("t"), a.alias("a"), hits.alias("hits"))

    def step(acc: Column, x: Column) -> Column:
        t, first, same = x["t"], x["s"] == 1, acc["t"] == x["t"]
        # The count is added at the first match of the second list and then set back.
        return (
            F.when(first & same, state(t, acc["a"] + 1, acc["hits"]))
            .when(first, state(t, F.lit(1), acc["hits"]))
            .when(same, state(t, F.lit(0), acc["hits"] + acc["a"]))
            .otherwise(acc)
        )

    return F.aggregate(_merged(tokens1, tokens2), start, step, lambda acc: acc["hits"])


def edit_distance(text1: Column, text2: Column) -> Column:
    """Full edit distance in characters, on lower-cased raw texts.

    A text inside the other one is as far away as the lengths differ. Equal ends
    of long texts are cut off; what is left costs the product of the lengths (the
    built-in limit of the distance saves next to nothing of that).
    """
    a, b = folded(text1), folded(text2)
    gap = F.abs(F.length(a) - F.length(b))
    cut = _let(_without_equal_ends(a, b), lambda p: F.levenshtein(p["a"], p["b"]))
    return F.when(F.contains(a, b) | F.contains(b, a), gap).otherwise(cut)


def _equal_blocks(a: Column, b: Column, from_end: bool) -> Column:
    """Characters in the leading (trailing) run of equal blocks of two texts."""
    blocks = F.floor(F.least(F.length(a), F.length(b)) / F.lit(_BLOCK)).cast("int")

    def differs(i: Column) -> Column:
        start = -(i + 1) * _BLOCK if from_end else i * _BLOCK + 1
        return F.substr(a, start, F.lit(_BLOCK)) != F.substr(b, start, F.lit(_BLOCK))

    flags = F.transform(F.sequence(F.lit(0), blocks - 1), differs)
    first = F.array_position(flags, True).cast("int")
    equal = F.when(first == 0, blocks).otherwise(first - 1) * _BLOCK
    return F.when(blocks == 0, 0).otherwise(equal)


def _without_equal_ends(a: Column, b: Column) -> Column:
    """Struct (a, b): two texts, equal ends of long ones cut off.

    Dropping a shared beginning or ending never changes an edit distance, so
    near copies of long texts do not pay for their length squared.
    """
    long = F.least(F.length(a), F.length(b)) >= 4 * _BLOCK
    head = F.when(long, _equal_blocks(a, b, False)).otherwise(0)

    def after_head(n: Column) -> Column:
        rest = [F.substr(t, n + 1, F.length(t)) for t in (a, b)]
        tail = F.when(long, _equal_blocks(rest[0], rest[1], True)).otherwise(0)
        pair = F.struct(rest[0].alias("a"), rest[1].alias("b"), tail.alias("n"))
        return _let(pair, lambda p: F.struct(
            F.substr(p["a"], F.lit(1), F.length(p["a"]) - p["n"]).alias("a"),
            F.substr(p["b"], F.lit(1), F.length(p["b"]) - p["n"]).alias("b"),
        ))

    return _let(head, after_head)


def _bounded_distance(a: Column, b: Column, limit: int) -> Column:
    """Edit distance up to ``limit``, else -1."""
    return _let(_without_equal_ends(a, b), lambda p: F.levenshtein(p["a"], p["b"], limit))


def edit_sigmoid(text1: Column, text2: Column) -> Column:
    """Logistic curve of the edit distance, exact in double precision."""
    return edit_sigmoid_of_folded(folded(text1), folded(text2))


def edit_sigmoid_of_folded(a: Column, b: Column) -> Column:
    """The same of two texts that are ``folded`` already.

    The curve is exactly 1.0 from distance 37 on, so only distances up to 36
    are measured: unequal lengths and unrelated texts leave at once, and a text
    inside the other one is as far away as the lengths differ.
    """
    limit = SIGMOID_SATURATES_AT - 1
    gap = F.abs(F.length(a) - F.length(b))
    inside = F.contains(a, b) | F.contains(b, a)
    near = F.when(gap > limit, -1).when(inside, gap).otherwise(_bounded_distance(a, b, limit))
    return _let(near, lambda d: F.when(d < 0, 1.0).otherwise(sigmoid(d)))


def normalized_distance(left: Column, right: Column) -> Column:
    """|l - r| / (|l| + |r|) of two vectors, NULL if both are zero."""

    def length(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))

    gap = length(F.zip_with(left, right, lambda a, b: a - b))
    return F.try_divide(gap, length(left) + length(right))
