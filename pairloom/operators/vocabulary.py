"""Token counts, the frequency-ranked vocabulary, and encoding by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.constants import (
    PADDING_INDEX, PADDING_TOKEN, SEQUENCE_LENGTH, UNKNOWN_INDEX, UNKNOWN_TOKEN, VOCABULARY_CAP,
)
from pairloom.functions.arrays import last_n, pad_left
from pairloom.functions.text import sequence_tokens, tfidf_tokens
from pairloom.operators.joins import BROADCAST_BYTES, lookup_join
from pairloom.operators.rows import kth_key
from pairloom.sources.tables import stage

# More tokens than one row can hold, so (id, position) packs into one number.
_POSITIONS = 1 << 31
_LOW = (1 << 32) - 1


def pair_tokens(pairs: DataFrame, rule: str = "blank") -> DataFrame:
    """(id, pos, token): all tokens of the first text, then all of the second."""
    # Both lists are columns before they are joined, else a text is tokenised again for its rows.
    sides = _side_tokens(pairs, rule, None, [])
    return sides.select("id", F.posexplode(F.concat("t1", "t2")).alias("pos", "token"))


def token_frequency(tokens: DataFrame) -> DataFrame:
    """(token, n), counted in each task before the shuffle."""
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


def term_frequency(pairs: DataFrame) -> DataFrame:
    """(id, token, tf1, tf2) over tf-idf tokens of both texts."""

    def tagged(name: str, side: int) -> Column:
        return F.transform(tfidf_tokens(F.col(name)), lambda t: F.struct(t.alias("token"), F.lit(side).alias("side")))

    rows = pairs.select("id", F.explode(F.concat(tagged("question1", 1), tagged("question2", 2))).alias("x"))
    return rows.groupBy("id", F.col("x.token").alias("token")).agg(
        F.count_if(F.col("x.side") == 1).alias("tf1"),
        F.count_if(F.col("x.side") == 2).alias("tf2"),
    )


def _ranked_candidates(counts: DataFrame, k: int) -> DataFrame:
    """The k top rows by (n descending, first), and at most one text's tokens more.

    Counting decides the lowest count kept, then the last id kept among tokens
    with that count, so the final sort never sees more rows than the cap.
    """
    total, low, high = counts.agg(F.count("*"), F.min("n"), F.max("n")).first()
    if total <= k:
        return counts
    n_cut = kth_key(counts.select("n"), "n", total - k, (low, high))
    above = counts.filter(F.col("n") > n_cut).count()
    ties = counts.filter(F.col("n") == n_cut)
    id_cut = kth_key(ties.select("first_id"), "first_id", k - above - 1)
    return counts.filter((F.col("n") > n_cut) | ((F.col("n") == n_cut) & (F.col("first_id") <= id_cut)))


def first_places() -> tuple[Column, Column]:
    """The first occurrence by (id, pos) as one number: a long over the ids that leave room for a position, a decimal over the others."""
    short = F.col("id").between(-(1 << 32), (1 << 32) - 1)
    narrow = F.col("id").cast("long") * F.lit(_POSITIONS) + F.col("pos")
    wide = F.col("id").cast("decimal(20,0)") * F.lit(_POSITIONS).cast("decimal(11,0)") + F.col("pos")
    return F.min(F.when(short, narrow)), F.min(F.when(~short, wide))


def build_vocabulary(tokens: DataFrame, cap: int = VOCABULARY_CAP) -> DataFrame:
    """(token, n, idx): frequency rank from 2 on, ties by first occurrence.

    0 and 1 are reserved. The first occurrence is one number, so both counting
    steps are hash aggregates with map-side partial results.
    """
    short, wide = first_places()
    counts = tokens.groupBy("token").agg(
        F.count("*").alias("n"), F.least(short.cast("decimal(32,0)"), wide).alias("first"), F.min("id").alias("first_id")
    )
    counts = stage(counts, "token-counts")
    k = cap - 2
    top = _ranked_candidates(counts, k).orderBy(F.desc("n"), "first").limit(k)
    # One window over at most ``cap`` rows, a number fixed beforehand.
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "first"))
    return top.select("token", "n", (rank + 1).alias("idx"))


def unknown_tokens(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, n) of the tokens that a vocabulary lacks."""
    return token_frequency(tokens).join(vocabulary.select("token"), "token", "left_anti")


def _side_tokens(pairs: DataFrame, rule: str, length: int | None, carry: list[str]) -> DataFrame:
    t1, t2 = (sequence_tokens(F.col(q), rule) for q in ("question1", "question2"))
    if length is not None:
        # Tokens map one to one, so cutting comes before the join.
        t1, t2 = last_n(t1, length), last_n(t2, length)
    return pairs.select("id", *carry, t1.alias("t1"), t2.alias("t2"))


def encode_long(
    pairs: DataFrame, lookup: DataFrame, rule: str = "blank",
    length: int | None = SEQUENCE_LENGTH, limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """(id, side, pos, size, token, ...lookup columns), one row per token kept.

    ``lookup`` has unique ``token``. An unknown token has index 0 and the other
    columns of the lookup's unknown entry, where it has one; else NULL.
    """
    sides = _side_tokens(pairs, rule, length, [])
    tokens = (
        sides.select("id", F.size("t1").alias("n1"), F.size("t2").alias("n2"),
                     F.posexplode(F.concat("t1", "t2")).alias("p", "token"))
        .select(
            "id", F.when(F.col("p") < F.col("n1"), 1).otherwise(2).alias("side"),
            F.when(F.col("p") < F.col("n1"), F.col("p")).otherwise(F.col("p") - F.col("n1")).alias("pos"),
            F.when(F.col("p") < F.col("n1"), F.col("n1")).otherwise(F.col("n2")).alias("size"),
            "token",
        )
    )
    found = lookup_join(tokens, lookup.withColumn("_known", F.lit(True)), "token", limit=limit)
    entry = lookup.where(F.col("token") == UNKNOWN_TOKEN).first()
    for f in lookup.schema.fields:
        if f.name == "idx":
            value = F.lit(UNKNOWN_INDEX)
        elif entry is None or f.name == "token" or entry[f.name] is None:
            continue
        else:
            value = F.array(*map(F.lit, entry[f.name])) if isinstance(entry[f.name], list) else F.lit(entry[f.name])
        found = found.withColumn(f.name, F.when(F.col("_known"), F.col(f.name)).otherwise(value.cast(f.dataType)))
    return found.drop("_known")


def encode(
    pairs: DataFrame, vocabulary: DataFrame, rule: str = "blank", length: int | None = None,
    carry: tuple[str, ...] = (), limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """(id, seq1, seq2): vocabulary indices in text order, 0 for unknown tokens.

    With ``length`` only the last tokens are looked up. Every pair keeps its
    row, also one without any token.
    """
    sides = _side_tokens(pairs, rule, length, list(carry))
    rows = sides.select("id", *carry, F.size("t1").alias("n1"),
                        F.posexplode_outer(F.concat("t1", "t2")).alias("pos", "token"))
    found = lookup_join(rows, vocabulary.select("token", "idx"), "token", limit=limit)
    kind = vocabulary.schema["idx"].dataType
    # Position and index travel as one number for each token.
    entry = F.when(F.col("pos").isNotNull(),
                   F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.coalesce("idx", F.lit(UNKNOWN_INDEX)).cast("int").cast("long")))
    seqs = found.groupBy("id", "n1", *carry).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    every = F.transform("e", lambda x: x.bitwiseAND(F.lit(_LOW)).cast(kind))
    return seqs.select(
        "id", *carry,
        F.slice(every, F.lit(1), F.col("n1")).alias("seq1"),
        F.slice(every, F.col("n1") + 1, F.greatest(F.size(every) - F.col("n1"), F.lit(0))).alias("seq2"),
    )


def encode_padded(
    pairs: DataFrame, vocabulary: DataFrame, rule: str = "blank", length: int = SEQUENCE_LENGTH,
    pad_value: int = UNKNOWN_INDEX, carry: tuple[str, ...] = (),
) -> DataFrame:
    """``encode`` cut and padded on the left to a fixed length."""
    seqs = encode(pairs, vocabulary, rule, length, carry)
    return seqs.select("id", *carry, *(pad_left(F.col(s), length, pad_value).alias(s) for s in ("seq1", "seq2")))


def vector_matrix(vocabulary: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """(idx, token, vec, known) for each vocabulary entry, reserved ones too.

    A token without a vector, and both reserved ones, get the zero vector.
    """
    spark = vocabulary.sparkSession
    reserved = spark.createDataFrame(
        [(UNKNOWN_TOKEN, UNKNOWN_INDEX), (PADDING_TOKEN, PADDING_INDEX)], "token string, idx int")
    entries = reserved.union(vocabulary.select("token", F.col("idx").cast("int")))
    zero = F.array_repeat(F.lit(0.0).cast("float"), width)
    return entries.join(vectors.select("token", "vec"), "token", "left").select(
        "idx", "token", F.coalesce("vec", zero).alias("vec"), F.col("vec").isNotNull().alias("known"))
