"""Word vectors to sentence vectors, distances and normalised joint vectors.

Sums over words are taken component by component, in blocks of columns, so they
are hash aggregates on numbers: each task merges the words of a text before
anything is shuffled, and a text travels as one vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.constants import NORM_EPSILON
from pairloom.functions.arrays import zero_vector
from pairloom.functions.text import as_text, sequence_tokens, split_blanks
from pairloom.operators.joins import BROADCAST_BYTES, fits_broadcast, salted_join

# Components summed side by side in one generated aggregate.
_BLOCK = 64
# Words of an id with several rows that are held before equal ones are merged.
_MERGE_ROWS = 1 << 16


def _text_rows(pairs: DataFrame, rule: str) -> DataFrame:
    """(id, side, n, token), one row per token; a text without tokens keeps one row."""
    lists = pairs.select("id", *(sequence_tokens(F.col(f"question{i}"), rule).alias(f"t{i}") for i in (1, 2)))
    sides = F.array(*(F.struct(F.lit(i).alias("side"), F.col(f"t{i}").alias("t")) for i in (1, 2)))
    rows = lists.select("id", F.explode(sides).alias("s"))
    return rows.select("id", F.col("s.side").alias("side"), F.size("s.t").alias("n"),
                       F.explode_outer("s.t").alias("token"))


def sum_vectors(rows: DataFrame, keys: Sequence[str], vec: Column, weight: Column, width: int) -> DataFrame:
    """(keys, vec): weighted sum of vectors per key, ``width`` wide.

    Shorter vectors count as zero in the components they lack; a longer one is
    an error.
    """
    vec = F.when(F.size(vec) > width, F.raise_error(F.lit(f"a vector is wider than {width}"))).otherwise(vec)
    blocks = -(-width // _BLOCK)
    parts = rows.select(*keys, weight.cast("double").alias("_w"), vec.alias("_v"))
    if blocks == 1:
        place, by = F.lit(0), list(keys)
    else:
        used = F.floor((F.size("_v") - 1) / F.lit(_BLOCK)).cast("int")
        parts = parts.withColumn("_b", F.explode(F.sequence(F.lit(0), used)))
        place, by = F.col("_b") * _BLOCK, [*keys, "_b"]
    size = width if blocks == 1 else _BLOCK
    cell = [F.sum(F.col("_w") * F.get(F.col("_v"), place + i)).alias(f"_x{i}") for i in range(size)]
    sums = parts.groupBy(*by).agg(*cell)
    vector = F.array(*(F.coalesce(F.col(f"_x{i}"), F.lit(0.0)) for i in range(size)))
    if blocks == 1:
        return sums.select(*keys, vector.alias("vec"))
    # One group is one vector: its few blocks are put side by side, absent ones as zeros.
    whole = sums.groupBy(*keys).agg(F.collect_list(F.struct("_b", vector.alias("v"))).alias("_all"))
    zeros = F.array_repeat(F.lit(0.0), _BLOCK)

    def block(i: int) -> Column:
        return F.coalesce(F.get(F.filter("_all", lambda x: x["_b"] == i), F.lit(0))["v"], zeros)

    laid = F.concat(*(block(i) for i in range(blocks)))
    return whole.select(*keys, F.slice(laid, 1, width).alias("vec"))


def pooled_vectors(
    pairs: DataFrame, vectors: DataFrame, width: int, mode: str = "sum", rule: str = "blank",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """(id, side, vec): sum or mean of the word vectors of each text.

    Words without a vector count as zero; a text without words is the zero
    vector. If ``vectors`` has a column ``weight`` each word counts by it.
    """
    if mode not in ("sum", "mean"):
        raise ValueError(f"unknown mode {mode!r}")
    rows, keys = _text_rows(pairs, rule), ["id", "side", "n"]
    if fits_broadcast(vectors, limit):
        found, times = rows.join(F.broadcast(vectors), "token", "left"), F.lit(1.0)
    else:
        # Repeated words meet first; after the join the vectors of a text meet again
        # by its id, so that sums are complete where they are taken.
        counted = rows.groupBy(*keys, "token").agg(F.count("*").alias("times"))
        found, times = salted_join(counted, vectors, "token").repartition("id"), F.col("times")
    weight = times * F.coalesce("weight", F.lit(0.0)) if "weight" in vectors.columns else times
    sums = sum_vectors(found, keys, F.coalesce("vec", zero_vector(width)), weight, width)
    if mode == "mean":
        size = F.greatest("n", F.lit(1))
        sums = sums.withColumn("vec", F.transform("vec", lambda x: x / size))
    return sums.select("id", "side", "vec")


def inverse_document_frequency(pairs: DataFrame, rule: str = "blank") -> DataFrame:
    """(token, weight): smoothed idf over all texts of both sides."""
    texts = 2 * pairs.count()
    lists = pairs.select(*(F.array_distinct(sequence_tokens(F.col(f"question{i}"), rule)).alias(f"t{i}") for i in (1, 2)))
    df = lists.select(F.explode(F.concat("t1", "t2")).alias("token")).groupBy("token").count()
    return df.select("token", (F.ln(F.lit(1.0 + texts) / (F.lit(1.0) + F.col("count"))) + 1.0).alias("weight"))


def pair_sides(vectors: DataFrame, width: int) -> DataFrame:
    """(id, left, right): both texts of a pair in one row; a missing side is zero."""
    both = vectors.groupBy("id").agg(F.collect_list(F.struct("side", "vec")).alias("s"))
    zeros = F.array_repeat(F.lit(0.0), width)

    def of(side: int) -> Column:
        return F.coalesce(F.get(F.filter("s", lambda x: x["side"] == side), F.lit(0))["vec"], zeros)

    return both.select("id", of(1).alias("left"), of(2).alias("right"))


def component_moments(vectors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(d, mean, var): population moments per component, or per batch and component."""
    cells = vectors.select(*by, F.posexplode("vec").alias("d", "x"))
    return cells.groupBy(*by, "d").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var"))


def moment_values(moments: DataFrame) -> tuple[list[float], list[float]]:
    """Means and variances as two lists; there is one row per component."""
    rows = moments.orderBy("d").select("mean", "var").collect()
    return [r["mean"] for r in rows], [r["var"] for r in rows]


def batch_normalize(vec: Column, means: Column, variances: Column, epsilon: float = NORM_EPSILON) -> Column:
    """(x - mean) / sqrt(var + epsilon), component by component."""
    centred = F.zip_with(vec, means, lambda x, m: x - m)
    return F.zip_with(centred, variances, lambda x, v: x / F.sqrt(v + F.lit(epsilon)))


def normalize_per_batch(vectors: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Replace ``vec`` by its normalised form under its own batch's moments."""
    cells = component_moments(vectors, (batch,)).groupBy(batch).agg(
        F.sort_array(F.collect_list(F.struct("d", "mean", "var"))).alias("_m"))
    found = vectors.join(cells, batch)
    return found.withColumn("vec", batch_normalize(F.col("vec"), F.col("_m.mean"), F.col("_m.var"))).drop("_m")


def decayed_encoding(tokens: DataFrame, width: int, decay: float) -> DataFrame:
    """(id, side, vec) of width 2w: order-aware state of each sequence.

    The first half decays towards earlier words: sum of decay^(size-1-pos)
    times the word's vector. The second half is the last word's vector alone.
    ``tokens`` is the long encoding with a ``vec`` column.
    """
    vec = F.coalesce("vec", zero_vector(width))
    # Padded first, so that the second half begins at the same place for each vector.
    vec = F.when(F.size(vec) >= width, vec).otherwise(F.concat(vec, F.array_repeat(F.lit(0.0).cast("float"), F.lit(width) - F.size(vec))))
    vec = F.when(F.size(vec) > width, F.raise_error(F.lit(f"a vector is wider than {width}"))).otherwise(vec)
    back = F.col("size") - F.col("pos") - 1
    # The last word adds to both halves, every other word to the first only.
    wide = F.when(back == 0, F.concat(vec, vec)).otherwise(vec)
    return sum_vectors(tokens, ["id", "side"], wide, F.pow(F.lit(float(decay)), back), 2 * width)


def _counted_words(texts: DataFrame) -> DataFrame:
    """(id, pos, side, token, w): a row for each different word of a side; those of one row of ``texts`` follow one another from ``pos`` 0 on.

    Words are counted inside the row: sorted, a word's count is the length of
    its run. A row without words keeps one, without a token.
    """

    def run_ends(words: Column) -> Column:
        ends = F.transform(words, lambda t, i: F.when(~t.eqNullSafe(F.get(words, i + 1)), i + 1))
        return F.filter(ends, lambda e: e.isNotNull())

    def counted(side: int) -> Column:
        words, ends = F.col(f"t{side}"), F.col(f"e{side}")
        return F.transform(ends, lambda e, i: F.struct(
            F.lit(side).alias("side"), F.get(words, e - 1).alias("token"),
            (e - F.coalesce(F.get(ends, i - 1), F.lit(0))).cast("double").alias("w")))

    words = (F.sort_array(split_blanks(F.lower(as_text(F.col(f"question{i}"))))).alias(f"t{i}") for i in (1, 2))
    # Lists are columns before they are read twice, else they are made twice.
    lists = texts.select("id", *words)
    lists = lists.select("id", "t1", "t2", *(run_ends(F.col(f"t{i}")).alias(f"e{i}") for i in (1, 2)))
    rows = lists.select("id", F.posexplode_outer(F.concat(counted(1), counted(2))).alias("pos", "s"))
    return rows.select("id", "pos", "s.side", "s.token", "s.w")


def _mover_costs(merge_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reads (id, pos, side, w, vec), the rows of an id one after another, and gives (id, rwmd).

    Only the words of one id are held. Where an id has several rows of texts,
    equal vectors of a side are merged, also each time that they have doubled
    beyond ``merge_rows``, so that no more than the different ones are compared.
    """

    def nearest(a: np.ndarray, wa: np.ndarray, b: np.ndarray) -> float:
        """Weighted mean distance from each row of a to its nearest row of b, block by block.

        A product of matrices finds the nearest row; its distance is then taken from the differences.
        """
        block = max(1, 2_000_000 // len(b))
        half = (b * b).sum(axis=1) / 2
        parts = [
            np.sqrt(((x - b[(half - x @ b.T).argmin(axis=1)]) ** 2).sum(axis=1))
            for x in (a[i : i + block] for i in range(0, len(a), block))
        ]
        return float(np.concatenate(parts) @ (wa / wa.sum()))

    def matrix(vectors: pa.ListArray) -> np.ndarray:
        widths = pc.unique(pc.list_value_length(vectors))
        if len(widths) > 1:
            raise ValueError(f"vectors of different widths: {widths.to_pylist()}")
        return vectors.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(vectors), -1)

    def merged(side: np.ndarray, w: np.ndarray, vec: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
        """Equal vectors of a side once, with the sum of their weights."""
        cells = np.column_stack([side, matrix(vec)])
        keys = cells.view(np.dtype((np.void, cells.itemsize * cells.shape[1]))).ravel()
        _, first, group = np.unique(keys, return_index=True, return_inverse=True)
        return side[first], np.bincount(group, w), vec.take(pa.array(first))

    class Words:
        """The words of one id that have a vector."""

        def __init__(self):
            self.parts, self.texts, self.size, self.limit = [], 0, 0, merge_rows

        def all(self) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
            if len(self.parts) == 1:
                return self.parts[0]
            side, w, vec = zip(*self.parts)
            return np.concatenate(side), np.concatenate(w), pa.concat_arrays(vec)

        def add(self, texts: int, side: np.ndarray, w: np.ndarray, vec: pa.ListArray) -> None:
            self.parts.append((side, w, vec))
            self.texts, self.size = self.texts + texts, self.size + len(side)
            if self.texts > 1 and self.size > self.limit:
                self.parts = [merged(*self.all())]
                self.size = len(self.parts[0][0])
                self.limit = max(merge_rows, 2 * self.size)

        def cost(self) -> float:
            side, w, vec = self.all()
            left, right = side == 1, side == 2
            if not (left.any() and right.any()):
                return np.inf
            if self.texts > 1:
                side, w, vec = merged(side, w, vec)
                left, right = side == 1, side == 2
            a, b = (matrix(vec.filter(pa.array(x))) for x in (left, right))
            return max(nearest(a, w[left], b), nearest(b, w[right], a))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: list[pa.Array], costs: list[float]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(costs, pa.float64())], ["id", "rwmd"])

        last, words = None, Words()
        for batch in batches:
            ids, pos, side, w, vec = batch.columns
            if not len(ids):
                continue
            codes = (ids if last is None else pa.concat_arrays([last, ids])).dictionary_encode("encode").indices.to_numpy()
            starts = np.flatnonzero(np.diff(codes))
            if last is None:
                starts = np.concatenate([[0], starts + 1])
            known = vec.is_valid().to_numpy(zero_copy_only=False)
            begun = (pos.fill_null(0).to_numpy() == 0).cumsum()
            at, texts = (np.concatenate([[0], x]) for x in (known.cumsum(), begun))
            side, w = side.fill_null(0).to_numpy()[known], w.fill_null(0).to_numpy()[known]
            vec = vec.drop_null()
            costs, ends = [], [*starts.tolist(), len(ids)]
            for k, (i, j) in enumerate(zip([0, *ends], ends)):
                if k and last is not None or k > 1:
                    costs.append(words.cost())
                if k:
                    words = Words()
                if i < j:
                    words.add(int(texts[j] - texts[i]), side[at[i] : at[j]], w[at[i] : at[j]], vec.slice(at[i], at[j] - at[i]))
            if costs:
                yield out([*([] if last is None else [last]), ids.take(pa.array(starts[:-1]))], costs)
            if len(starts):
                last = ids.take(pa.array(starts[-1:]))
        if last is not None:
            yield out([last], [words.cost()])

    # All of this is local so that it travels to the workers by value.
    return run


def relaxed_mover_distance(
    pairs: DataFrame, vectors: DataFrame, limit: int = BROADCAST_BYTES, merge_rows: int = _MERGE_ROWS
) -> DataFrame:
    """(id, rwmd): lower bound of the word-mover distance of two texts.

    Each word moves to the nearest word of the other text, weighted by its
    share of its own text; the larger direction counts. Words without a vector
    are left out; a side without words gives infinity. Word pairs are never
    rows: distances are computed in blocks beside the vectors of one pair.

    Only texts are shuffled: they are laid by id, then counted, and their words
    get vectors from the broadcast table as they pass on to Python. Vectors are
    shuffled only where they are too large for that.
    """
    texts, table = pairs.select("id", "question1", "question2"), vectors.select("token", "vec")
    if fits_broadcast(table, limit):
        # Neither words nor the join change the order of the rows.
        laid = texts.repartition("id").sortWithinPartitions("id")
        words = _counted_words(laid).join(F.broadcast(table), "token", "left")
    else:
        words = salted_join(_counted_words(texts), table, "token").repartition("id").sortWithinPartitions("id")
    schema = T.StructType([pairs.schema["id"], T.StructField("rwmd", T.DoubleType())])
    return words.select("id", "pos", "side", "w", "vec").mapInArrow(_mover_costs(merge_rows), schema)
