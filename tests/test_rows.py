from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import rows as rw


@pytest.fixture(scope="module")
def ids():
    rng = random.Random(1)
    near = rng.sample(range(1000), 300)
    far = [rng.randrange(-(2**62), 2**62) for _ in range(100)]
    return sorted(set(near + far + [2**60 + i for i in range(50)]))


@pytest.fixture(scope="module")
def table(spark, ids):
    mixed = ids[:]
    random.Random(2).shuffle(mixed)
    return spark.createDataFrame([(i, f"t{i}") for i in mixed], "id long, t string").repartition(5)


@pytest.mark.parametrize("buckets", [2, 7, 64])
def test_row_index_is_dense(table, ids, buckets):
    got = sorted((r.rn, r.id, r.t) for r in rw.row_index(table, buckets=buckets).collect())
    assert got == [(i, v, f"t{v}") for i, v in enumerate(ids)]


def test_row_index_of_one_and_no_row(spark):
    one = spark.createDataFrame([(5,)], "id long")
    assert [tuple(r) for r in rw.row_index(one).collect()] == [(5, 0)]
    assert rw.row_index(one.filter("id < 0")).count() == 0


def test_row_index_sorts_no_single_partition_of_rows(table):
    plan = rw.row_index(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") == 1  # the window over one row per bucket


def test_kth_key_with_repeats(spark):
    values = [5] * 400 + [-3] * 10 + list(range(100, 150)) + [10**15]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (0, 9, 10, 409, 410, 459, 460):
        assert rw.kth_key(df, "v", k) == sorted(values)[k]


@pytest.mark.parametrize("fraction", [0.0, 0.5, 0.8, 1.0])
def test_split_by_position(table, ids, fraction):
    a, b = rw.split_by_position(table, fraction=fraction)
    cut = math.floor(fraction * len(ids))
    assert sorted(r.id for r in a.collect()) == ids[:cut]
    assert sorted(r.id for r in b.collect()) == ids[cut:]


def test_split_is_a_pushed_filter(table, tmp_path, spark):
    table.write.parquet(str(tmp_path / "t"))
    a, _ = rw.split_by_position(spark.read.parquet(str(tmp_path / "t")))
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(id" in plan and "Exchange" not in plan


def test_minibatches_and_chunks(table, ids):
    got = {r.id: r.batch_id for r in rw.minibatches(table, batch_size=100).collect()}
    assert got == {v: i // 100 for i, v in enumerate(ids)}
    assert rw.score_chunks(table, chunk_size=7).agg(F.max("chunk_id")).first()[0] == (len(ids) - 1) // 7


def test_keep_last_with_a_hot_key(spark):
    rows = [(1, p, f"v{p}") for p in range(500)] + [(k, p, f"w{p}") for k in range(2, 50) for p in (7, 3)]
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, "test_id long, position long, t string").repartition(6)
    got = {r.test_id: (r.position, r.t) for r in rw.keep_last(df, "test_id", "position").collect()}
    assert got == {1: (499, "v499")} | {k: (7, "w7") for k in range(2, 50)}


def test_first_rows(table, ids):
    assert [r.id for r in rw.first_rows(table, 10).collect()] == ids[:10]


def test_rows_without_a_key_have_no_position(spark):
    from pairloom.operators.rows import split_by_position

    with pytest.raises(ValueError):
        split_by_position(spark.createDataFrame([(1,), (None,)], "id long"))
