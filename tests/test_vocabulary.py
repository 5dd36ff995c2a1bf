from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairloom.functions.arrays import one_hot, pad_left, vector_prefix
from pairloom.operators import vocabulary as vb


def ranked(rows, cap):
    """Frequency rank with ties by first occurrence, one list at a time."""
    flat = [t for _, a, b in sorted(rows) for t in a.split() + b.split()]
    return [(t, n, i) for i, (t, n) in enumerate(Counter(flat).most_common()[: cap - 2], start=2)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(120)]
    return [(i * 3 - 50, " ".join(rng.choices(words, k=rng.randint(0, 6))) or "x", rng.choice(words)) for i in range(90)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, question1 string, question2 string").repartition(3)


@pytest.mark.parametrize("cap", [3, 10, 40, 100, 1000])
def test_vocabulary_matches_one_pass(table, rows, cap):
    got = vb.build_vocabulary(vb.pair_tokens(table), cap).orderBy("idx").collect()
    assert [tuple(r) for r in got] == ranked(rows, cap)


def test_ties_follow_first_occurrence(spark):
    df = spark.createDataFrame([(2, "cc dd", "aa"), (1, "zz", "bb aa")], "id long, question1 string, question2 string")
    got = vb.build_vocabulary(vb.pair_tokens(df)).orderBy("idx").collect()
    assert [r.token for r in got] == ["aa", "zz", "bb", "cc", "dd"]


@pytest.mark.parametrize("limit", [0, 1 << 30])
@pytest.mark.parametrize("length", [None, 3])
def test_encode_on_both_join_paths(table, rows, limit, length):
    vocab = vb.build_vocabulary(vb.pair_tokens(table), 60)
    index = {r.token: r.idx for r in vocab.collect()}
    got = {r.id: (r.seq1, r.seq2) for r in vb.encode(table, vocab, length=length, limit=limit).collect()}

    def seq(t):
        tokens = t.split()
        return [index.get(w, 0) for w in (tokens if length is None else tokens[-length:])]

    assert got == {i: (seq(a), seq(b)) for i, a, b in rows}


def test_pairs_without_words_keep_their_row(spark, pairs):
    vocab = vb.build_vocabulary(vb.pair_tokens(pairs))
    got = {r.id: r for r in vb.encode_padded(pairs, vocab, carry=("is_duplicate",)).collect()}
    assert set(got) == {10, 11, 13, 17, 40}
    assert got[13].seq1 == got[13].seq2 == [0] * 30
    assert all(len(r.seq1) == len(r.seq2) == 30 for r in got.values())
    assert got[40].is_duplicate == 1


def test_cut_before_the_join_equals_cut_after(table):
    vocab = vb.build_vocabulary(vb.pair_tokens(table))
    after = vb.encode(table, vocab).select("id", *(pad_left(F.col(s), 4).alias(s) for s in ("seq1", "seq2")))
    assert vb.encode_padded(table, vocab, length=4).exceptAll(after).count() == 0


def test_unknown_tokens(spark, table):
    vocab = vb.build_vocabulary(vb.pair_tokens(table))
    other = spark.createDataFrame([(1, "w1 new new", "w2"), (2, "zz", None)], "id long, question1 string, question2 string")
    got = {tuple(r) for r in vb.unknown_tokens(vb.pair_tokens(other), vocab).collect()}
    assert got == {("new", 2), ("zz", 1), ("nan", 1)}


def test_padding(spark):
    df = spark.createDataFrame([(0, []), (1, [5, 6]), (2, list(range(30))), (3, list(range(31)))], "i int, a array<int>")
    got = {r.i: r.p for r in df.select("i", pad_left(F.col("a")).alias("p")).collect()}
    assert got[0] == [0] * 30 and got[1] == [0] * 28 + [5, 6]
    assert got[2] == list(range(30)) and got[3] == list(range(1, 31))
    assert df.filter("i = 1").select(pad_left(F.col("a"), 3, 1).alias("p")).first().p == [1, 5, 6]


def test_one_hot_and_prefix(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (None,)], "y int").coalesce(1)
    assert [r[0] for r in df.select(one_hot(F.col("y"))).collect()] == [[1.0, 0.0]] + [[0.0, 1.0]] * 3
    v = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    assert v.select(vector_prefix(F.col("v"), 2)).first()[0] == [1.0, 2.0]


def test_vector_matrix_has_every_entry(spark, table):
    vocab = vb.build_vocabulary(vb.pair_tokens(table))
    vectors = spark.createDataFrame([("w1", [1.0, 2.0]), ("absent", [3.0, 3.0])], "token string, vec array<float>")
    rows = {r.token: r for r in vb.vector_matrix(vocab, vectors, 2).collect()}
    assert len(rows) == vocab.count() + 2
    assert (rows["<UNK>"].idx, rows["<PAD>"].idx) == (0, 1)
    assert rows["w1"].vec == [1.0, 2.0] and rows["w1"].known
    assert rows["w2"].vec == [0.0, 0.0] and not rows["w2"].known and "absent" not in rows


def test_a_token_is_gathered_as_one_number(spark, table, rows):
    seqs = vb.encode(table, vb.build_vocabulary(vb.pair_tokens(table)))
    plan = seqs._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and "struct" not in plan
    assert dict(seqs.dtypes)["seq1"] == "array<int>"


def test_first_occurrence_of_ids_of_any_size(spark):
    ids = [-(1 << 62), -(1 << 32) - 1, -(1 << 32), -1, 0, (1 << 32) - 1, 1 << 32, 1 << 62]
    texts = [(i, f"a{n} b{n}", f"c{n}") for n, i in enumerate(ids)]
    random.Random(4).shuffle(texts)
    tokens = vb.pair_tokens(spark.createDataFrame(texts, "id long, question1 string, question2 string"))
    got = [r.token for r in vb.build_vocabulary(tokens).orderBy("idx").collect()]
    assert got == [f"{c}{n}" for n in range(len(ids)) for c in "abc"]
    plan = tokens.groupBy("token").agg(*vb.first_places())._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
