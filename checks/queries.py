"""One query per operator, each over whole tables and whole texts.

Doubles are rounded to six digits and lists joined to strings only here, so
that two engines can be compared value by value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.constants import ALL5, BASIC3
from pairloom.functions import text as tx
from pairloom.functions.arrays import one_hot, pad_left, vector_prefix
from pairloom.functions.scoring import argmax2, linear_score, softmax2
from pairloom.functions.similarity import IDF_SECOND_ONLY, edit_distance, edit_sigmoid, tfidf_cosine
from pairloom.functions.similarity import common_words as count_common
from pairloom.operators import features as ft
from pairloom.operators import metrics as mt
from pairloom.operators import regression as rg
from pairloom.operators import rows as rw
from pairloom.operators import vectors as vc
from pairloom.operators import vocabulary as vb
from pairloom.operators.heads import DenseHead, DistanceHead, head_gradient, joint, run_head
from pairloom.plans.feature_model import run_feature_model
from pairloom.plans.sequence_model import run_sequence_model
from pairloom.sources import sample_pairs as sp
from pairloom.sources.csv_pairs import read_train_pairs
from pairloom.sources.predictions import counter_rows, prediction_rows
from pairloom.sources.tables import shared_folder, stage
from pairloom.sources.vectors import vectors_by_rank
from pairloom.sources.word2vec import read_word2vec, write_word2vec
from pairloom.streaming.latest import read_latest, write_latest
from pairloom.streaming.scoring import score_stream

def q(side: int) -> Column:
    return F.col(f"question{side}")

WIDTH = 64
DECAY = 0.9
TOP_K = 100
BATCH = 128
CHUNK = 300
PREFIX = 16
FIRST_ROWS = 100
EPOCHS = 100
SMALL_CAP = 500
#: A fit is at its minimum where no component of the gradient is larger.
FLAT = 1e-3

# Fixed weights for forward passes, the same in the SQL.
FIXED = rg.LinearModel(BASIC3, (2.0, -3.0, 0.01), 1.0)


def r6(x: Column | str) -> Column:
    """Six digits, and no negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def joined(values: Column | str) -> Column:
    return F.array_join(values, " ")


def big(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


_staged: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries share is written once per session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _staged:
        _staged[key] = stage(make(), name)
    return _staged[key]


def vocabulary_table(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "vocabulary", lambda: vb.build_vocabulary(vb.pair_tokens(sp.train_pairs(spark, sf))))


def vector_table(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "vectors", lambda: vectors_by_rank(
        vocabulary_table(spark, sf), sp.table(spark, sf, "embeddings")))


def matrix_table(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "matrix", lambda: vb.vector_matrix(
        vocabulary_table(spark, sf), vector_table(spark, sf), WIDTH))


def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "features", lambda: ft.pair_features(sp.train_pairs(spark, sf)))


def mean_sides(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "means", lambda: vc.pair_sides(vc.pooled_vectors(
        sp.train_pairs(spark, sf), vector_table(spark, sf), WIDTH, "mean"), WIDTH))


def fixed_head(moments: DataFrame) -> DenseHead:
    """A fixed dense layer over the joint vector."""
    weights = ([(d % 7 - 3) / 10.0 for d in range(2 * WIDTH)], [(d % 5 - 2) / 10.0 for d in range(2 * WIDTH)])
    return DenseHead(*vc.moment_values(moments), weights, (0.1, -0.1))


# --- texts ---------------------------------------------------------------

def na_normalize(spark, sf):
    pairs = ft.normalize_pairs(sp.raw_train_pairs(spark, sf))
    return pairs.select("id", "question1", "question2", tx.as_text(q(2)).alias("text2"))


def valid_utf8_pairs(spark, sf):
    return ft.decodable_pairs(sp.train_pairs(spark, sf)).select("id", *big("is_duplicate"))


def _cleaned(clean: Callable[[Column], Column]):
    def query(spark, sf):
        return sp.train_pairs(spark, sf).select("id", clean(q(1)).alias("clean1"), clean(q(2)).alias("clean2"))
    return query


def _tokens(tokenize: Callable[[Column], Column]):
    def query(spark, sf):
        return sp.train_pairs(spark, sf).select(
            "id", joined(tokenize(q(1))).alias("tokens1"), joined(tokenize(q(2))).alias("tokens2"))
    return query


def token_lengths(spark, sf):
    return sp.train_pairs(spark, sf).select("id", *(
        F.size(tx.whitespace_tokens(t)).cast("long").alias(n) for t, n in ((q(1), "len1"), (q(2), "len2"))))


def pair_vocabulary(spark, sf):
    both = F.array_union(tx.split_blanks(tx.clean_tfidf(q(1))), tx.split_blanks(tx.clean_tfidf(q(2))))
    return sp.train_pairs(spark, sf).select("id", F.sort_array(both).alias("v")).select(
        "id", F.size("v").cast("long").alias("n_tokens"), joined("v").alias("tokens"))


# --- pair features -------------------------------------------------------

def term_frequency(spark, sf):
    return vb.term_frequency(sp.train_pairs(spark, sf)).select("id", "token", *big("tf1", "tf2"))


def pair_idf(spark, sf):
    idf = F.when(F.col("tf1") > 0, 1.0).otherwise(IDF_SECOND_ONLY)
    return vb.term_frequency(sp.train_pairs(spark, sf)).select("id", "token", r6(idf).alias("idf"))


def cosine(spark, sf):
    value = tfidf_cosine(tx.tfidf_tokens(q(1)), tx.tfidf_tokens(q(2)))
    return sp.train_pairs(spark, sf).select("id", r6(value).alias("cosine"))


def common_words(spark, sf):
    value = count_common(tx.whitespace_tokens(q(1)), tx.whitespace_tokens(q(2)))
    return sp.train_pairs(spark, sf).select("id", value.cast("long").alias("common"))


def common_words_semi(spark, sf):
    """The same count as a semi-join of token rows; left repeats are kept."""
    pairs = sp.train_pairs(spark, sf)
    left = pairs.select("id", F.explode(tx.whitespace_tokens(q(1))).alias("token"))
    right = pairs.select("id", F.explode(F.array_distinct(tx.whitespace_tokens(q(2)))).alias("token"))
    hits = left.join(right, ["id", "token"], "left_semi").groupBy("id").agg(F.count("*").alias("n"))
    return pairs.select("id").join(hits, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("common"))


def edit_distances(spark, sf):
    return sp.test_pairs(spark, sf).select("id", edit_distance(q(1), q(2)).cast("long").alias("distance"))


def edit_sigmoids(spark, sf):
    return sp.train_pairs(spark, sf).select("id", r6(edit_sigmoid(q(1), q(2))).alias("edit_sig"))


def _shown_features(df: DataFrame, names: tuple[str, ...], label: bool = True) -> DataFrame:
    shown = [r6(n).alias(n) if n in ("cosine", "edit_sig") else F.col(n).cast("long").alias(n) for n in names]
    return df.select("id", *shown, *(big("is_duplicate") if label else []))


def features(spark, sf):
    return _shown_features(ft.pair_features(sp.train_pairs(spark, sf)), ("cosine", "edit_sig", "len1", "len2", "common"))


def feature_set_basic3(spark, sf):
    """The scoring form: three features of the unlabelled test pairs."""
    return _shown_features(ft.feature_set(ft.pair_features(sp.test_pairs(spark, sf)), BASIC3, False), BASIC3, False)


def feature_set_all5(spark, sf):
    return _shown_features(ft.feature_set(ft.pair_features(sp.train_pairs(spark, sf)), ALL5), ALL5)


# --- rows ----------------------------------------------------------------

def pair_profile(spark, sf):
    p = mt.pair_profile(sp.train_pairs(spark, sf))
    return p.select(*(r6(c).alias(c) if c.startswith("mean") else F.col(c).cast("long").alias(c) for c in p.columns))


def row_index(spark, sf):
    return rw.row_index(sp.test_pairs(spark, sf).select("id"))


def split_train(spark, sf):
    return rw.split_by_position(sp.test_pairs(spark, sf))[0].select("id", "question1")


def split_holdout(spark, sf):
    return rw.split_by_position(sp.test_pairs(spark, sf))[1].select("id", "question1")


def minibatch_assign(spark, sf):
    return rw.minibatches(sp.train_pairs(spark, sf).select("id"), batch_size=BATCH).select("id", "batch_id")


def score_chunks(spark, sf):
    return rw.score_chunks(sp.train_pairs(spark, sf).select("id"), chunk_size=CHUNK).select("id", "chunk_id")


def dedupe_last(spark, sf):
    """The last turn of each conversation."""
    turns = sp.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return rw.keep_last(turns, "conv_id", "turn")


def limit_pairs(spark, sf):
    return rw.first_rows(sp.train_pairs(spark, sf), FIRST_ROWS).select("id", "question1", "question2")


# --- vocabulary ----------------------------------------------------------

def token_frequency(spark, sf):
    return vb.token_frequency(vb.pair_tokens(sp.train_pairs(spark, sf)))


def vocabulary(spark, sf):
    built = vb.build_vocabulary(vb.pair_tokens(sp.train_pairs(spark, sf)))
    return built.select("token", "n", *big("idx"))


def vocabulary_topk(spark, sf):
    built = vb.build_vocabulary(vb.pair_tokens(sp.train_pairs(spark, sf)), cap=TOP_K + 2)
    return built.select("token", "n", *big("idx"))


def oov_tokens(spark, sf):
    """Words of the test pairs that the training vocabulary lacks."""
    return vb.unknown_tokens(vb.pair_tokens(sp.test_pairs(spark, sf)), vocabulary_table(spark, sf))


def _shown_seqs(df: DataFrame) -> DataFrame:
    return df.select("id", joined("seq1").alias("seq1"), joined("seq2").alias("seq2"))


def vocab_encode(spark, sf):
    return _shown_seqs(vb.encode(sp.train_pairs(spark, sf), vocabulary_table(spark, sf)))


def pad_sequences(spark, sf):
    """Whole sequences first, padded after: equal to the form that cuts before the join."""
    seqs = vb.encode(sp.test_pairs(spark, sf), vocabulary_table(spark, sf))
    return _shown_seqs(seqs.select("id", pad_left(F.col("seq1")).alias("seq1"), pad_left(F.col("seq2")).alias("seq2")))


def sequence_prepare_train(spark, sf):
    seqs = vb.encode_padded(sp.train_pairs(spark, sf), vocabulary_table(spark, sf), carry=("is_duplicate",))
    return seqs.select("id", joined("seq1").alias("seq1"), joined("seq2").alias("seq2"), *big("is_duplicate"))


def sequence_prepare_test(spark, sf):
    return _shown_seqs(vb.encode_padded(sp.test_pairs(spark, sf), vocabulary_table(spark, sf), rule="delete"))


# --- vectors -------------------------------------------------------------

def _norm(vec: str) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def vector_source_profile(spark, sf):
    vectors = sp.table(spark, sf, "embeddings").select(F.col("embedding").alias("vec"))
    p = mt.vector_profile(vectors)
    return p.select(*big("n_vectors", "min_width", "max_width", "n_zero"), r6("mean_norm").alias("mean_norm"))


def vector_prefixes(spark, sf):
    head = vector_prefix(F.col("embedding"), PREFIX)
    rows = sp.table(spark, sf, "embeddings").select("vec_id", F.posexplode(head).alias("d", "x"))
    return rows.select("vec_id", *big("d"), r6(F.col("x").cast("double")).alias("x"))


def embedding_matrix(spark, sf):
    m = vb.vector_matrix(vocabulary_table(spark, sf), vector_table(spark, sf), WIDTH)
    return m.select(*big("idx"), "token", F.col("known").cast("long").alias("known"),
                    F.size("vec").cast("long").alias("width"), r6(_norm("vec")).alias("norm"))


def _looked_up(spark, sf, matrix: DataFrame) -> DataFrame:
    rows = vb.encode_long(sp.train_pairs(spark, sf), matrix.select("token", "idx", "vec"))
    return rows.select("id", *big("side", "pos", "idx"), r6(F.element_at("vec", 1).cast("double")).alias("first"),
                       r6(_norm("vec")).alias("norm"))


def embedding_lookup(spark, sf):
    return _looked_up(spark, sf, matrix_table(spark, sf))


def embedding_lookup_small_cap(spark, sf):
    """Most words are unknown to this vocabulary."""
    return _looked_up(spark, sf, matrix_table(spark, sf).where(F.col("idx") <= SMALL_CAP))


def _shown_vectors(df: DataFrame) -> DataFrame:
    """One row per component."""
    keys = [c for c in ("id", "side") if c in df.columns]
    cells = df.select(*big(*keys), F.posexplode("vec").alias("d", "x"))
    return cells.select(*keys, *big("d"), r6("x").alias("x"))


def _pooled(spark, sf, mode: str = "sum") -> DataFrame:
    return vc.pooled_vectors(sp.train_pairs(spark, sf), vector_table(spark, sf), WIDTH, mode)


def pooled_sum(spark, sf):
    return _shown_vectors(_pooled(spark, sf))


def pooled_mean(spark, sf):
    return _shown_vectors(_pooled(spark, sf, "mean"))


def pooled_idf(spark, sf):
    pairs = sp.train_pairs(spark, sf)
    idf = vc.inverse_document_frequency(pairs)
    weighted = _once(spark, sf, "idf-vectors", lambda: vector_table(spark, sf).join(idf, "token"))
    return _shown_vectors(vc.pooled_vectors(pairs, weighted, WIDTH))


def pair_distance(spark, sf):
    sides = vc.pair_sides(_pooled(spark, sf), WIDTH)
    return DistanceHead().score(sides).select("id", r6("distance").alias("distance"))


def distance_threshold_predict(spark, sf):
    sides = vc.pair_sides(_pooled(spark, sf), WIDTH)
    return run_head(DistanceHead(), sides).select("id", *big("prediction"))


def pooled_distance_scores(spark, sf):
    """Distances over the first components of the sentence vectors."""
    sides = vc.pair_sides(_pooled(spark, sf), WIDTH)
    short = sides.select("id", *(vector_prefix(F.col(c), PREFIX).alias(c) for c in ("left", "right")))
    return run_head(DistanceHead(), short).select("id", r6("distance").alias("distance"), *big("prediction"))


def joint_vectors(spark, sf):
    return _shown_vectors(joint(mean_sides(spark, sf)))


def batch_moments(spark, sf):
    m = vc.component_moments(joint(mean_sides(spark, sf)))
    return m.select(*big("d"), r6("mean").alias("mean"), r6("var").alias("var"))


def batch_normalize(spark, sf):
    rows = joint(mean_sides(spark, sf))
    means, variances = (F.array(*map(F.lit, v)) for v in vc.moment_values(vc.component_moments(rows)))
    return _shown_vectors(rows.withColumn("vec", vc.batch_normalize(F.col("vec"), means, variances)))


def encode_decay(spark, sf):
    matrix = matrix_table(spark, sf).select("token", "vec")
    rows = vb.encode_long(sp.train_pairs(spark, sf), matrix)
    return _shown_vectors(vc.decayed_encoding(rows, WIDTH, DECAY))


def relaxed_wmd(spark, sf):
    d = vc.relaxed_mover_distance(sp.test_pairs(spark, sf), vector_table(spark, sf))
    # Infinity is shown as -1, since engines print it differently.
    return d.select("id", r6(F.when(F.col("rwmd") == float("inf"), -1.0).otherwise(F.col("rwmd"))).alias("rwmd"))


# --- models --------------------------------------------------------------

def one_hot_label(spark, sf):
    v = one_hot(F.col("is_duplicate"))
    return sp.train_pairs(spark, sf).select("id", v[0].alias("c0"), v[1].alias("c1"))


def linear_scores(spark, sf):
    score = linear_score(BASIC3, FIXED.weights, FIXED.bias)
    return feature_table(spark, sf).select("id", r6(score).alias("score"))


def softmax_scores(spark, sf):
    p0, p1 = softmax2(F.lit(0.0), linear_score(BASIC3, FIXED.weights, FIXED.bias))
    return feature_table(spark, sf).select("id", r6(p0).alias("p0"), r6(p1).alias("p1"))


def argmax_predict(spark, sf):
    p0, p1 = softmax2(F.lit(0.0), linear_score(BASIC3, FIXED.weights, FIXED.bias))
    return feature_table(spark, sf).select("id", argmax2(p0, p1).cast("long").alias("prediction"))


def udf_score(spark, sf):
    def plug_in(batch):
        return 2.0 * batch["cosine"] - 3.0 * batch["edit_sig"] + 0.01 * batch["common"] + 1.0

    return rg.score_with(feature_table(spark, sf), plug_in, BASIC3).select("id", r6("score").alias("score"))


def cross_entropy(spark, sf):
    return mt.cross_entropy(FIXED.score(feature_table(spark, sf))).select(r6("cross_entropy").alias("cross_entropy"))


def gradient_step(spark, sf):
    step = rg.gradient_step(rg.collapse_rows(feature_table(spark, sf), BASIC3), FIXED)
    return step.select(*(r6(c).alias(c) for c in step.columns))


def _descent(spark, sf, df: DataFrame) -> rg.LinearModel:
    return rg.logistic_gd(df, BASIC3, epochs=EPOCHS)


def logistic_gd(spark, sf):
    table = feature_table(spark, sf)
    return _descent(spark, sf, table).parameters(table).select("name", r6("value").alias("value"))


def logistic_gd_raw(spark, sf):
    """Descent on raw features that stay small: cosine and edit curve."""
    table = feature_table(spark, sf)
    model = rg.logistic_gd(table, BASIC3[:2], epochs=EPOCHS, standardize=False)
    return model.parameters(table).select("name", r6("value").alias("value"))


def epoch_cost(spark, sf):
    table = feature_table(spark, sf)
    return _descent(spark, sf, table).cost_curve(table).select(*big("epoch"), r6("cost").alias("cost"))


def holdout_accuracy(spark, sf):
    train, holdout = rw.split_by_position(feature_table(spark, sf))
    scored = _descent(spark, sf, train).score(holdout)
    return mt.accuracy(scored).select("n", r6("accuracy").alias("accuracy"))


def holdout_outcomes(spark, sf):
    train, holdout = rw.split_by_position(feature_table(spark, sf))
    scored = _descent(spark, sf, train).score(holdout)
    return mt.outcome_counts(scored).select(*big("is_duplicate", "prediction", "n"))


def batch_accuracy(spark, sf):
    b = mt.batch_accuracy(FIXED.score(feature_table(spark, sf)), BATCH)
    return b.select("batch_id", "n", r6("accuracy").alias("accuracy"))


def macro_batch_accuracy(spark, sf):
    m = mt.macro_batch_accuracy(FIXED.score(feature_table(spark, sf)), BATCH)
    return m.select("batches", r6("accuracy").alias("accuracy"))


def predictions_csv_rows(spark, sf):
    scored = FIXED.score(ft.pair_features(sp.test_pairs(spark, sf)))
    return prediction_rows(scored).select("id", *big("prediction"))


def predictions_counter_rows(spark, sf):
    scored = FIXED.score(ft.pair_features(sp.test_pairs(spark, sf)))
    return counter_rows(stage(scored.select("id", "prediction"), "scored")).select("id", *big("prediction"))


def stream_score(spark, sf):
    """Documents read as a stream, paired, scored, appended and read back."""
    arriving = sp.arriving_table(spark, sf, "documents")
    pairs = ft.normalize_pairs(sp.pairs_of_documents(arriving, sp.table(spark, sf, "documents")))
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    score_stream(pairs, FIXED.score, f"{folder}/out", f"{folder}/state", "parquet").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("id", *big("prediction"))


def logistic_mllib(spark, sf):
    run = run_feature_model(sp.train_pairs(spark, sf), sp.test_pairs(spark, sf))
    return run.holdout.select("id", *big("is_duplicate", "prediction"))


def dense_head_forward(spark, sf):
    sides = mean_sides(spark, sf)
    scored = run_head(fixed_head(vc.component_moments(joint(sides))), sides)
    return scored.select("id", r6("p0").alias("p0"), r6("p1").alias("p1"), *big("prediction"))


def dense_head_batches(spark, sf):
    """The same layer, normalised by the moments of each mini-batch."""
    sides = mean_sides(spark, sf)
    batches = rw.minibatches(sides.select("id"), batch_size=BATCH).select("id", "batch_id")
    head = fixed_head(vc.component_moments(joint(sides)))
    scored = head.decide(head.score_per_batch(sides, batches))
    return scored.select("id", r6("p0").alias("p0"), r6("p1").alias("p1"), *big("prediction"))


def _certified(gradient: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row for each weight (is the loss flat there?) and for each pair (does its prediction follow from its scores?)."""
    weights = gradient.select(
        F.lit("weight").alias("part"), (F.col("c") * 10_000 + F.col("d")).cast("long").alias("id"), (F.abs("gradient") < FLAT).alias("holds"))
    return weights.unionByName(pairs.select(F.lit("pair").alias("part"), "id", "holds"))


def _follows(p1: str = "p1") -> Column:
    return F.coalesce(F.col("prediction") == (F.col(p1) > 0.5).cast("int"), F.col("prediction") == 0).alias("holds")


def dense_head_fit(spark, sf):
    """Fit on the first pairs, score the rest; the fit is checked by its gradient."""
    fit_labels, held = rw.split_by_position(sp.train_pairs(spark, sf).select("id", "is_duplicate"))
    sides = mean_sides(spark, sf)
    head = DenseHead.fit(sides, fit_labels)
    scored = run_head(head, sides.join(held, "id", "left_semi"))
    return _certified(head_gradient(head, sides, fit_labels), scored.select("id", _follows()))


def _sequence_run(spark, sf):
    return run_sequence_model(
        sp.train_pairs(spark, sf), sp.test_pairs(spark, sf), vector_table(spark, sf), WIDTH, decay=DECAY)


def pair_model_scores(spark, sf):
    run = _sequence_run(spark, sf)
    return _certified(head_gradient(run.head, run.sides, run.labels), run.holdout.select("id", _follows()))


def sequence_model_predictions(spark, sf):
    """One prediction of class 0 or 1 for each test pair, of a model whose fit is checked."""
    run = _sequence_run(spark, sf)
    pairs = run.predictions.select("id", F.col("prediction").isin(0, 1).alias("holds"))
    return _certified(head_gradient(run.head, run.sides, run.labels), pairs)


# --- sources ---------------------------------------------------------------

def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def csv_record_pairs(spark, sf):
    """Pairs with line breaks in their texts, written as CSV and read range by range."""
    folder = _folder(spark, "csv")
    sp.raw_train_pairs(spark, sf).write.csv(
        folder, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read_train_pairs(spark, folder).select("id", "question1", "question2", *big("is_duplicate"))


def stream_dedupe_last(spark, sf):
    """The last turn of each conversation, as keyed state of a stream."""
    arriving = sp.arriving_table(spark, sf, "conversations")
    folder = _folder(spark, "latest")
    write_latest(arriving.select("conv_id", "turn", "role", "text"), "conv_id", "turn", f"{folder}/out", f"{folder}/state").awaitTermination()
    return read_latest(spark, f"{folder}/out", "conv_id", "turn")


def word2vec_vectors(spark, sf):
    """Word vectors written in the binary layout and read by byte ranges."""
    folder = _folder(spark, "word2vec")
    write_word2vec(vector_table(spark, sf), folder)
    read = read_word2vec(spark, folder, 1 << 20)
    return read.select("token", r6(F.element_at("vec", 1).cast("double")).alias("first"), r6(_norm("vec")).alias("norm"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "tfidf_cosine": cosine,
    "features": features,
    "feature_set_basic3": feature_set_basic3,
    "feature_set_all5": feature_set_all5,
    "na_normalize": na_normalize,
    "valid_utf8_pairs": valid_utf8_pairs,
    "clean_tfidf": _cleaned(tx.clean_tfidf),
    "clean_train": _cleaned(tx.clean_train),
    "clean_test": _cleaned(tx.clean_test),
    "tokens_whitespace": _tokens(tx.whitespace_tokens),
    "tokens_word": _tokens(tx.sequence_tokens),
    "tokens_word_test": _tokens(lambda t: tx.sequence_tokens(t, "delete")),
    "tokens_tfidf": _tokens(tx.tfidf_tokens),
    "token_lengths": token_lengths,
    "pair_vocabulary": pair_vocabulary,
    "term_frequency": term_frequency,
    "pair_idf": pair_idf,
    "common_words": common_words,
    "common_words_semi": common_words_semi,
    "edit_distance": edit_distances,
    "edit_sigmoid": edit_sigmoids,
    "pair_profile": pair_profile,
    "row_index": row_index,
    "split_train": split_train,
    "split_holdout": split_holdout,
    "minibatch_assign": minibatch_assign,
    "score_chunks": score_chunks,
    "dedupe_last": dedupe_last,
    "limit_pairs": limit_pairs,
    "token_frequency": token_frequency,
    "vocabulary": vocabulary,
    "vocabulary_topk": vocabulary_topk,
    "oov_tokens": oov_tokens,
    "vocab_encode": vocab_encode,
    "pad_sequences": pad_sequences,
    "sequence_prepare_train": sequence_prepare_train,
    "sequence_prepare_test": sequence_prepare_test,
    "vector_source_profile": vector_source_profile,
    "vector_prefix": vector_prefixes,
    "embedding_matrix": embedding_matrix,
    "embedding_lookup": embedding_lookup,
    "embedding_lookup_small_cap": embedding_lookup_small_cap,
    "pooled_sum": pooled_sum,
    "pooled_mean": pooled_mean,
    "pooled_idf": pooled_idf,
    "pair_distance": pair_distance,
    "distance_threshold_predict": distance_threshold_predict,
    "pooled_distance_scores": pooled_distance_scores,
    "joint_vector": joint_vectors,
    "batch_moments": batch_moments,
    "batch_normalize": batch_normalize,
    "encode_decay": encode_decay,
    "relaxed_wmd": relaxed_wmd,
    "one_hot_label": one_hot_label,
    "linear_score": linear_scores,
    "softmax_scores": softmax_scores,
    "argmax_predict": argmax_predict,
    "udf_score": udf_score,
    "cross_entropy": cross_entropy,
    "gradient_step": gradient_step,
    "logistic_gd": logistic_gd,
    "epoch_cost": epoch_cost,
    "logistic_gd_raw": logistic_gd_raw,
    "holdout_accuracy": holdout_accuracy,
    "holdout_outcomes": holdout_outcomes,
    "batch_accuracy": batch_accuracy,
    "macro_batch_accuracy": macro_batch_accuracy,
    "predictions_csv_rows": predictions_csv_rows,
    "predictions_counter_rows": predictions_counter_rows,
    "stream_score": stream_score,
    "logistic_mllib": logistic_mllib,
    "dense_head_forward": dense_head_forward,
    "dense_head_batches": dense_head_batches,
    "dense_head_fit": dense_head_fit,
    "pair_model_scores": pair_model_scores,
    "sequence_model_predictions": sequence_model_predictions,
    "csv_record_pairs": csv_record_pairs,
    "stream_dedupe_last": stream_dedupe_last,
    "word2vec_vectors": word2vec_vectors,
}
