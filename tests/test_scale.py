from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.operators.features import decodable_pairs
from pairloom.operators.joins import salted_join
from pairloom.sources.csv_pairs import read_train_pairs
from pairloom.streaming.scoring import pair_stream


def test_heavy_and_missing_keys_are_spread(spark):
    rows = [(i, "hot" if i % 3 else f"w{i % 50}") for i in range(900)] + [(i, None) for i in range(900, 1000)]
    facts = spark.createDataFrame(rows, "id long, token string")
    table = spark.createDataFrame([("hot", 1.0), ("w3", 3.0), ("w6", 6.0), ("unused", 0.0)], "token string, x double")
    for how in ("left", "inner"):
        got = salted_join(facts, table, "token", how, pieces=8).select("id", "token", "x")
        want = facts.join(table, "token", how).select("id", "token", "x")
        assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert salted_join(facts.where(F.lit(False)), table, "token").count() == 0


def test_undecodable_csv_rows_can_be_left_out(spark, tmp_path):
    (tmp_path / "pairs.csv").write_bytes(
        b'id,question1,question2,is_duplicate\n1,"caf\xc3\xa9, ""x""",na\xc3\xafve,1\n2,bad \xff byte,ok,0\n3,NaN,\xe6\x97\xa5\xe6\x9c\xac,0\n')
    pairs = read_train_pairs(spark, str(tmp_path / "pairs.csv"))
    assert pairs.count() == 3
    got = [tuple(r) for r in decodable_pairs(pairs).orderBy("id").collect()]
    assert got == [(1, 'café, "x"', "naïve", 1), (3, None, "日本", 0)]


def test_stream_of_csv_pairs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('id,question1,question2\n1,"a, b",c\n2,NaN,d\n', encoding="utf-8")
    stream = pair_stream(spark, str(tmp_path / "in"), fmt="csv")
    query = (stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
             .trigger(availableNow=True).start(str(tmp_path / "out")))
    query.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "a, b", "c"), (2, None, "d")]
