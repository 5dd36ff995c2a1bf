from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.constants import BASIC3
from pairloom.functions.scoring import argmax2, softmax2, threshold_decision
from pairloom.operators import metrics as mt
from pairloom.operators import regression as rg

SCHEMA = "id long, cosine double, edit_sig double, common int, is_duplicate int"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.random(200), rng.choice([0.5, 0.9, 1.0], 200), rng.integers(0, 30, 200)])
    y = (x[:, 0] + 0.02 * x[:, 2] + 0.2 * rng.normal(size=200) > 0.7).astype(int)
    return x, y


@pytest.fixture(scope="module")
def table(spark, data):
    x, y = data
    rows = [(i, float(a), float(b), int(c), int(t)) for i, ((a, b, c), t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("standardize", [True, False])
def test_descent_equals_two_class_softmax(table, data, standardize):
    x, y = data
    z = (x - x.mean(axis=0)) / x.std(axis=0) if standardize else x
    w, b, costs = np.zeros((3, 2)), np.zeros(2), []
    hot = np.eye(2)[y]
    for _ in range(8):
        e = np.exp(z @ w + b - (z @ w + b).max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        costs.append(-np.log((p * hot).sum(axis=1)).mean())
        w, b = w - 0.06 * z.T @ (p - hot) / len(y), b - 0.06 * (p - hot).mean(axis=0)
    model = rg.logistic_gd(table, epochs=8, standardize=standardize)
    assert model.weights == pytest.approx((w[:, 1] - w[:, 0]).tolist())
    assert model.bias == pytest.approx(b[1] - b[0])
    assert model.costs == pytest.approx(costs)
    if standardize:
        assert costs == sorted(costs, reverse=True)
    want = (z @ (w[:, 1] - w[:, 0]) + b[1] - b[0] > 0).astype(int).tolist()
    assert [r.prediction for r in model.score(table).orderBy("id").collect()] == want
    assert [r.cost for r in model.cost_curve(table).orderBy("epoch").collect()] == pytest.approx(costs)


def test_collapsed_copies_give_the_same_step(table):
    copies = table.union(table.filter("id < 5")).union(table.filter("id < 5"))
    model = rg.LinearModel(("cosine", "edit_sig", "common"), (1.0, -1.0, 0.1), 0.2)
    collapsed = rg.collapse_rows(copies, model.columns)
    assert collapsed.count() < copies.count()
    assert tuple(rg.gradient_step(collapsed, model).first()) == pytest.approx(tuple(rg.gradient_step(copies, model).first()))
    a, b = (rg.logistic_gd(df, epochs=3) for df in (collapsed, copies))
    assert (*a.weights, a.bias, *a.costs) == pytest.approx((*b.weights, b.bias, *b.costs))


def test_library_fit_saves_and_restores(table, tmp_path):
    model = rg.fit_regression(table)
    scored = rg.apply_regression(model, table)
    assert mt.accuracy(scored).first().accuracy > 0.8
    rg.save_model(model, str(tmp_path / "m"))
    rg.save_model(model, str(tmp_path / "m"))
    again = rg.apply_regression(rg.load_model(str(tmp_path / "m")), table)
    assert scored.exceptAll(again).count() == 0
    assert scored.columns == [*table.columns, "p0", "p1", "prediction"]


def test_softmax_argmax_threshold(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1000.0, -1000.0), (1.0, 3.0)], "a double, b double").coalesce(1)
    p0, p1 = softmax2(F.col("a"), F.col("b"))
    rows = df.select(p0.alias("p0"), p1.alias("p1"), argmax2(p0, p1).alias("c")).collect()
    assert all(r.p0 + r.p1 == pytest.approx(1.0) for r in rows)
    assert [r.c for r in rows] == [0, 0, 1]
    d = spark.createDataFrame([(0.69,), (0.7,), (None,)], "d double").coalesce(1)
    assert [r[0] for r in d.select(threshold_decision(F.col("d"))).collect()] == [1, 0, 0]


def test_cross_entropy_keeps_impossible_rows(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0), (0, 0.5, 0.5)], "is_duplicate int, p0 double, p1 double")
    assert mt.cross_entropy(df).first()[0] == pytest.approx((-math.log(1e-15) - math.log(0.5)) / 2)


def test_batch_accuracy_drops_the_tail(spark):
    df = spark.createDataFrame([(i, 1 if i < 15 else 0, 1) for i in range(25)], "id long, prediction int, is_duplicate int")
    got = {r.batch_id: (r.n, r.accuracy) for r in mt.batch_accuracy(df, 10).collect()}
    assert got == {0: (10, 1.0), 1: (10, 0.5), 2: (5, 0.0)}
    assert tuple(mt.macro_batch_accuracy(df, 10).first()) == (2, 0.75)
    assert tuple(mt.accuracy(df).first()) == (25, 0.6)
    assert {tuple(r) for r in mt.outcome_counts(df).collect()} == {(1, 1, 15), (1, 0, 10)}


def test_plug_in_scorer(table):
    scored = rg.score_with(table, lambda b: b["cosine"] * 2 + b["common"], ("cosine", "common"))
    assert scored.filter(F.abs(F.col("score") - (F.col("cosine") * 2 + F.col("common"))) > 1e-12).count() == 0


def test_pair_profile(pairs):
    row = mt.pair_profile(pairs).first()
    assert (row.n_pairs, row.null1, row.null2, row.n_duplicate) == (5, 0, 1, 2)
    assert (row.min_len1, row.max_len1, row.min_len2) == (1, 6, 1)


def test_labels_other_than_zero_are_class_one(spark):
    from pairloom.operators.regression import LinearModel, gradient_step, logistic_gd

    model = LinearModel(("x",), (0.0,), 0.0)
    rows = spark.createDataFrame([(1.0, 2), (3.0, 0), (5.0, None)], "x double, is_duplicate int")
    step = gradient_step(rows, model).first()
    assert (step.g_bias, step.g_x) == (0.0, (-0.5 * 1.0 + 0.5 * 3.0) / 2)
    for empty in (rows.limit(0), rows.where("x = 5")):
        with pytest.raises(ValueError):
            logistic_gd(empty, ("x",), epochs=1)
    with pytest.raises(ValueError):
        gradient_step(rows, LinearModel(("x",), (float("nan"),), 0.0))


def test_a_step_compiles_the_same_code_for_other_weights(table):
    def code(weights):
        step = rg.gradient_step(table, rg.LinearModel(BASIC3, weights, weights[0]))
        plan = step._jdf.queryExecution().optimizedPlan().toString()
        return [re.sub(r"#\d+L?", "", line) for line in plan.splitlines() if "LocalRelation" not in line]

    assert code((0.125, -2.5, 1e-9)) == code((3.5, 0.75, 0.0625))
