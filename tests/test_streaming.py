from __future__ import annotations

import random

import pytest

from pairloom.operators.features import pair_features
from pairloom.operators.regression import LinearModel
from pairloom.operators.rows import keep_last
from pairloom.sources.sample_pairs import arriving_table, table
from pairloom.streaming.latest import read_latest, write_latest
from pairloom.streaming.scoring import pair_stream, score_stream

MODEL = LinearModel(("cosine", "edit_sig", "common"), (2.0, -3.0, 0.01), 1.0)


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    rows = [(i, f"word{i} same text", f"word{i if i % 2 else -i} same {'text' if i % 3 else 'thing'}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, question1 string, question2 string")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def arrive(part):
        df.filter(part).repartition(3).write.mode("append").parquet(source)
        query = score_stream(pair_stream(spark, source, 1), MODEL.score, out, state)
        query.awaitTermination()

    arrive("id < 40")
    arrive("id >= 40")
    got = spark.read.schema("id long, prediction int").csv(out)
    want = MODEL.score(pair_features(df)).select("id", "prediction")
    assert got.count() == 60
    assert got.exceptAll(want).count() == 0


SCHEMA = "test_id long, position long, question1 string, question2 string"


def test_last_row_wins_on_a_stream_that_is_restarted(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(25), p, None if p % 7 == 0 else f"q{p}", "x") for p in range(200)] + [(1, 500 + p, f"hot{p}", "y") for p in range(80)]
    rows += [(None, 7, "no id", "z"), (3, None, "no place", "z")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in range(3):
        spark.createDataFrame(rows[part::3], SCHEMA).repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        write_latest(stream, "test_id", "position", out, state).awaitTermination()
        seen = spark.createDataFrame([r for k in range(part + 1) for r in rows[k::3]], SCHEMA).where("position is not null")
        got = read_latest(spark, out, "test_id", "position")
        assert got.columns == df.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, keep_last(seen, "test_id", "position").collect()))
    changes = spark.read.parquet(out)
    assert changes.count() <= df.count() and changes.groupBy("test_id", "position").count().where("count > 1").isEmpty()


def test_forgotten_keys_start_anew(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def arrive(position):
        spark.createDataFrame([(1, position, "a", "b")], SCHEMA).write.mode("append").parquet(source)
        write_latest(spark.readStream.schema(SCHEMA).parquet(source), "test_id", "position", out, state, expiry_ms=1).awaitTermination()

    arrive(5)
    arrive(3)  # the state of 5 has expired
    assert sorted(r.position for r in spark.read.parquet(out).collect()) == [3, 5]


@pytest.mark.parametrize("files", [0, 3])
def test_a_table_arrives_from_one_file_or_from_a_folder(spark, tmp_path, files):
    rows = spark.range(30).selectExpr("id AS conv_id", "id % 4 AS turn", "'user' AS role", "'x' AS text")
    if files:
        rows.repartition(files).write.parquet(str(tmp_path / "conversations.parquet"))
    else:
        rows.toPandas().to_parquet(tmp_path / "conversations.parquet")
    folder = str(tmp_path)
    arriving = arriving_table(spark, folder, "conversations")
    write_latest(arriving, "conv_id", "turn", f"{folder}/out", f"{folder}/state").awaitTermination()
    got = read_latest(spark, f"{folder}/out", "conv_id", "turn")
    assert got.count() == 30 and got.exceptAll(table(spark, folder, "conversations")).isEmpty()
