from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import vectors as vc
from pairloom.operators.heads import DenseHead, DistanceHead, joint, run_head
from pairloom.operators.joins import fits_broadcast, table_bytes
from pairloom.operators.vocabulary import encode_long

WORDS = [f"w{i}" for i in range(30)]


def make_vectors(spark, width):
    rng = np.random.default_rng(width)
    known = {w: rng.normal(size=width).astype("float32").astype(float) for w in WORDS[:25]}
    df = spark.createDataFrame([(w, v.tolist()) for w, v in known.items()], "token string, vec array<float>")
    return known, df


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    made = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 40))), " ".join(rng.choices(WORDS, k=3))) for i in range(40)]
    return [*made, (100, "!!!", "w1 w1"), (101, "***", "###"), (102, "w29", "w28")]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, question1 string, question2 string").repartition(3)


def words(text):
    return [w for w in text.split() if w.startswith("w")]


@pytest.mark.parametrize("width", [2, 64, 130])
@pytest.mark.parametrize("limit", [0, 1 << 30])
@pytest.mark.parametrize("mode", ["sum", "mean"])
def test_pooled_vectors(spark, table, rows, width, limit, mode):
    known, df = make_vectors(spark, width)
    got = {(r.id, r.side): r.vec for r in vc.pooled_vectors(table, df, width, mode, limit=limit).collect()}
    assert len(got) == 2 * len(rows)
    for i, *texts in rows:
        for side, text in enumerate(texts, start=1):
            tokens = words(text)
            want = sum((known.get(w, np.zeros(width)) for w in tokens), np.zeros(width))
            want = want / max(len(tokens), 1) if mode == "mean" else want
            assert got[i, side] == pytest.approx(want.tolist())


def test_weights_by_idf(spark, table, rows):
    known, df = make_vectors(spark, 4)
    idf = {r.token: r.weight for r in vc.inverse_document_frequency(table).collect()}
    texts = [words(t) for _, *ts in rows for t in ts]
    assert idf["w3"] == pytest.approx(math.log((1 + len(texts)) / (1 + sum("w3" in t for t in texts))) + 1)
    weighted = df.join(vc.inverse_document_frequency(table), "token")
    got = {(r.id, r.side): r.vec for r in vc.pooled_vectors(table, weighted, 4).collect()}
    want = sum((idf[w] * known.get(w, np.zeros(4)) for w in words(rows[0][1])), np.zeros(4))
    assert got[0, 1] == pytest.approx(want.tolist())


def test_distance_head(spark, table, rows):
    known, df = make_vectors(spark, 4)
    sides = vc.pair_sides(vc.pooled_vectors(table, df, 4), 4)
    got = {r.id: r for r in run_head(DistanceHead(), sides).collect()}
    assert got[100].distance == 1.0 and got[100].prediction == 0
    assert got[101].distance is None and got[101].prediction == 0
    left, right = (sum((known.get(w, np.zeros(4)) for w in words(t)), np.zeros(4)) for t in rows[0][1:])
    want = np.linalg.norm(left - right) / (np.linalg.norm(left) + np.linalg.norm(right))
    assert got[0].distance == pytest.approx(want)
    assert all(r.distance is None or 0 <= r.distance <= 1 + 1e-12 for r in got.values())


@pytest.mark.parametrize("width", [3, 64, 100])
def test_decayed_encoding(spark, table, rows, width):
    known, df = make_vectors(spark, width)
    got = {(r.id, r.side): r.vec for r in vc.decayed_encoding(encode_long(table, df), width, 0.8).collect()}
    for i, *texts in rows:
        for side, text in enumerate(texts, start=1):
            tokens = words(text)[-30:]
            if not tokens:
                assert (i, side) not in got
                continue
            vecs = [known.get(w, np.zeros(width)) for w in tokens]
            front = sum(0.8 ** (len(vecs) - 1 - k) * v for k, v in enumerate(vecs))
            assert got[i, side] == pytest.approx([*front, *vecs[-1]])


def test_missing_sides_are_zero(spark):
    df = spark.createDataFrame([(1, 2, [1.0, 2.0])], "id long, side int, vec array<double>")
    assert tuple(vc.pair_sides(df, 2).first()) == (1, [0.0, 0.0], [1.0, 2.0])


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_relaxed_mover_distance(spark, table, rows, limit):
    known, df = make_vectors(spark, 5)
    got = {r.id: r.rwmd for r in vc.relaxed_mover_distance(table, df, limit).collect()}
    assert len(got) == len(rows)

    def cost(a, b):
        return sum(min(np.linalg.norm(known[x] - known[y]) for y in b) for x in a) / len(a)

    for i, q1, q2 in rows:
        a, b = ([w for w in t.split() if w in known] for t in (q1, q2))
        assert got[i] == pytest.approx(max(cost(a, b), cost(b, a)) if a and b else math.inf)


def test_relaxed_mover_distance_shuffles_only_texts(spark, table, capsys):
    _, df = make_vectors(spark, 5)
    vc.relaxed_mover_distance(table, df.coalesce(1)).explain(mode="formatted")
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", capsys.readouterr().out)
    assert moved and all(set(re.findall(r"(\w+)#", columns)) <= {"id", "question1", "question2"} for columns in moved)


@pytest.mark.parametrize("limit", [0, 1 << 30])
@pytest.mark.parametrize("batch, merge_rows", [(1, 1), (3, 4), (10_000, 1 << 16)])
def test_relaxed_mover_distance_of_repeated_ids(spark, limit, batch, merge_rows):
    """Rows that share an id, or have none, are one pair of bags; so are words of equal vectors."""
    known, df = make_vectors(spark, 5)
    known["twin"] = known["w1"]
    df = df.union(df.where("token = 'w1'").selectExpr("'twin'", "vec"))
    rows = [(1, "w1 w2 w2", "w3 w4"), (2, "w5", None), (1, "W2 w6 twin", "w3 w3 w7"), (3, "w8 w9", "w9"), (None, "w1", "w2"),
            (None, "w3 w3 unknown", "w1 twin"), (1, "", "unknown"), (4, None, None), (None, "w3", ""), (5, " ", "w1")]
    table = spark.createDataFrame(rows, "id long, question1 string, question2 string").repartition(3)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        found = vc.relaxed_mover_distance(table, df, limit, merge_rows).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    got = {r.id: r.rwmd for r in found}
    assert len(got) == len(found) and set(got) == {r[0] for r in rows}

    def bag(i, side):
        return [w for r in rows if r[0] == i for w in (r[side] or "nan").lower().split() if w in known]

    def cost(a, b):
        return sum(min(np.linalg.norm(known[x] - known[y]) for y in b) for x in a) / len(a)

    for i in got:
        a, b = bag(i, 1), bag(i, 2)
        assert got[i] == pytest.approx(max(cost(a, b), cost(b, a)) if a and b else math.inf)


def test_batch_normalisation(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 4))
    df = spark.createDataFrame([(i, i // 10, v.tolist()) for i, v in enumerate(x)], "id long, batch_id long, vec array<double>")
    means, variances = vc.moment_values(vc.component_moments(df))
    assert means == pytest.approx(x.mean(axis=0).tolist()) and variances == pytest.approx(x.var(axis=0).tolist())
    z = vc.batch_normalize(F.col("vec"), F.array(*map(F.lit, means)), F.array(*map(F.lit, variances)))
    got = np.array([r.z for r in df.select("id", z.alias("z")).orderBy("id").collect()])
    assert got == pytest.approx((x - x.mean(axis=0)) / np.sqrt(x.var(axis=0) + 1e-3))
    got = {r.id: r.vec for r in vc.normalize_per_batch(df).collect()}
    b = x[10:20]
    assert got[13] == pytest.approx(((x[13] - b.mean(axis=0)) / np.sqrt(b.var(axis=0) + 1e-3)).tolist())


def test_dense_head(spark):
    rng = np.random.default_rng(1)
    left, right = rng.normal(size=(80, 3)), rng.normal(size=(80, 3))
    y = (left[:, 0] + right[:, 1] > 0).astype(int)
    sides = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(left, right, strict=True))],
                                  "id long, left array<double>, right array<double>")
    labels = spark.createDataFrame(list(enumerate(y.tolist())), "id long, is_duplicate int")
    head = DenseHead.fit(sides, labels)
    got = {r.id: r for r in run_head(head, sides).collect()}
    assert np.mean([got[i].prediction == y[i] for i in range(80)]) > 0.95
    x = np.hstack([left, right])
    z = (x - x.mean(axis=0)) / np.sqrt(x.var(axis=0) + 1e-3)
    logits = z @ np.array(head.weights).T + np.array(head.biases)
    p = np.exp(logits[:, 1]) / np.exp(logits).sum(axis=1)
    assert [got[i].p1 for i in range(80)] == pytest.approx(p.tolist())
    one = spark.range(80).selectExpr("id", "0L AS batch_id")
    assert [r.p1 for r in head.score_per_batch(sides, one).orderBy("id").collect()] == pytest.approx(p.tolist())
    assert joint(sides).first().vec == pytest.approx(x[0].tolist())


def test_measured_size(spark):
    _, df = make_vectors(spark, 4)
    size = table_bytes(df)
    assert 25 * 16 < size < 25 * 80
    assert fits_broadcast(df, size) and not fits_broadcast(df, size - 1)


def test_vectors_of_another_width(spark):
    from pairloom.operators.vectors import decayed_encoding, sum_vectors

    rows = spark.createDataFrame(
        [(1, 1, 0, 2, [1.0, 2.0, 3.0, 4.0]), (1, 1, 1, 2, [5.0, 7.0])], "id long, side int, pos int, size int, vec array<float>")
    (r,) = decayed_encoding(rows, 4, 0.5).collect()
    assert r.vec == [5.5, 8.0, 1.5, 2.0, 5.0, 7.0, 0.0, 0.0]
    with pytest.raises(Exception, match="wider than 2"):
        decayed_encoding(rows, 2, 0.5).collect()
    with pytest.raises(Exception, match="wider than 3"):
        sum_vectors(rows, ["id"], F.col("vec"), F.lit(1.0), 3).collect()
