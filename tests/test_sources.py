from __future__ import annotations

import pandas as pd

from pairloom.operators.features import pair_features
from pairloom.plans.feature_model import run_feature_model
from pairloom.plans.sequence_model import run_sequence_model
from pairloom.sources import sample_pairs as sp
from pairloom.sources.csv_pairs import read_test_pairs, read_train_pairs
from pairloom.sources.predictions import append_predictions, counter_rows, prediction_rows
from pairloom.sources.tables import read_table, shared_folder, stage, write_table
from pairloom.sources.vectors import read_word_vectors, vectors_by_rank
from pairloom.operators.vocabulary import build_vocabulary, pair_tokens

SF = "/root/testdata/sf0.001"
CSV = '''is_duplicate,id,question2,question1
1,7,"a, ""quoted"" text","line one
line two"
0,3,NaN,back\\slash
0,5,"nan?",
'''


def test_train_csv_is_read_by_name(spark, tmp_path):
    path = tmp_path / "train.csv"
    path.write_text(CSV)
    got = {r.id: r for r in read_train_pairs(spark, str(path), multiline=True).collect()}
    want = pd.read_csv(path)
    for r in want.itertuples():
        q1, q2 = (None if pd.isna(v) else v for v in (r.question1, r.question2))
        assert (got[r.id].question1, got[r.id].question2, got[r.id].is_duplicate) == (q1, q2, r.is_duplicate)


def test_test_csv_keeps_the_order_of_repeats(spark, tmp_path):
    path = tmp_path / "test.csv"
    path.write_text("test_id,question1,question2\n4,first,x\n5,only,y\n4,last,z\n")
    df = read_test_pairs(spark, str(path), multiline=True)
    assert df.columns == ["test_id", "position", "question1", "question2"]
    assert [r.question1 for r in df.orderBy("position").collect()] == ["first", "only", "last"]


def test_tables_round_trip(spark, pairs, tmp_path):
    features = pair_features(pairs)
    write_table(features, str(tmp_path / "f"))
    assert read_table(spark, str(tmp_path / "f")).exceptAll(features).count() == 0
    staged = stage(pairs, "pairs")
    assert staged.exceptAll(pairs).count() == 0
    folder = shared_folder(spark).removeprefix("file:").lstrip("/")
    assert all(f"/{folder}/pairs-" in f for f in staged.inputFiles())


def test_predictions_are_appended_without_header(spark, tmp_path):
    scored = spark.createDataFrame([(9, 1), (4, 0)], "id long, prediction int")
    out = str(tmp_path / "p")
    append_predictions(prediction_rows(scored), out)
    append_predictions(prediction_rows(scored), out)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["4,0", "4,0", "9,1", "9,1"]
    assert sorted(tuple(r) for r in counter_rows(scored).collect()) == [(0, 0), (1, 1)]


def test_word_vector_sources(spark, pairs, tmp_path):
    vocab = build_vocabulary(pair_tokens(pairs))
    vectors = vectors_by_rank(vocab, sp.table(spark, SF, "embeddings"))
    write_table(vectors, str(tmp_path / "v"))
    read = read_word_vectors(spark, str(tmp_path / "v"))
    assert read.dtypes == [("token", "string"), ("vec", "array<float>")]
    assert read.count() == vocab.count()


def test_following_texts_are_moved_only_where_they_are_read(spark, tmp_path):
    ids = [*range(-9, 26), 40, 7, 7, 8, 3, None]
    docs = spark.createDataFrame([(i, f"text {i} {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    texts = [tuple(r) for r in docs.collect()]

    def rest(i, n):
        return i - n * int(i / n)  # with the sign of i

    reads = {i for i in range(-11, 42) if rest(i, 4) not in (0, 1) and rest(i, 8) != 3}
    moved = sorted((r.id, r.next_text or "") for r in sp.following_texts(docs.dropna()).collect())
    assert moved == sorted((i - 1, t if i - 1 in reads else "") for i, t in texts if i is not None)
    missing = ("", "NaN", "null", "N/A", None)

    def second(i, text, after):
        if i is not None and rest(i, 4) == 0:
            return text
        if i is not None and rest(i, 4) == 1:
            return "well " * (i % 9) + text + " ?"
        if i is not None and rest(i, 4) == 2:
            return after
        if i is not None and rest(i, 8) == 3:
            return missing[i // 8 % 5]
        return f"{after} {text}" if after else None

    want = []
    for i, text in texts:
        after = [t for j, t in texts if i is not None and j == i + 1] or [None]
        want += [(i, text, second(i, text, a)) for a in after]
    got = [tuple(r) for r in sp.pairs_of_documents(docs, docs).select("id", "question1", "question2").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))

    turns = [(c, t, f"turn {c} {t} {k}") for k, (c, t) in enumerate([(c, t) for c in range(4) for t in range(5)] + [(1, 2), (2, 3), (None, 1), (3, None)])]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    sent = sp.following_turns(sp.table(spark, str(tmp_path), "conversations").dropna()).collect()
    assert sorted((r.conv_id, r.turn, r.next_text or "") for r in sent) == sorted(
        (c, t - 1, x if (c + t - 1) % 3 else "") for c, t, x in turns if None not in (c, t))
    want = []
    for c, t, text in turns:
        named = None not in (c, t)
        for after in [x for d, u, x in turns if named and (d, u) == (c, t + 1)] or [None]:
            again = named and (c + t) % 3 == 0
            want.append((c * 1_000_000 + t if named else None, text, "well " * ((c + t) % 9) + text + " ?" if again else after))
    got = [tuple(r) for r in sp.test_pairs(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_feature_model_end_to_end(spark):
    test = sp.test_pairs(spark, SF)
    run = run_feature_model(sp.train_pairs(spark, SF), test)
    n, accuracy = run.accuracy().first()
    assert n == 40 and accuracy > 0.8
    assert sum(r.n for r in run.outcomes().collect()) == 40
    assert run.predictions.count() == test.count() == run.predictions.select("id").distinct().count()


def test_feature_model_scores_repeated_ids_once(spark, tmp_path):
    path = tmp_path / "test.csv"
    path.write_text("test_id,question1,question2\n1,aa bb cc,dd ee ff gg\n2,x,y\n1,same words here,same words here\n")
    run = run_feature_model(sp.train_pairs(spark, SF), read_test_pairs(spark, str(path)))
    got = {r.id: r.prediction for r in run.predictions.collect()}
    assert set(got) == {1, 2} and got[1] == 1


def test_sequence_model_end_to_end(spark):
    train, test = sp.train_pairs(spark, SF), sp.test_pairs(spark, SF)
    vocab = stage(build_vocabulary(pair_tokens(train)), "v")
    vectors = stage(vectors_by_rank(vocab, sp.table(spark, SF, "embeddings")), "w")
    run = run_sequence_model(train, test, vectors, 64)
    assert run.accuracy().first().n == 40
    assert sum(r.n for r in run.outcomes().collect()) == 40
    assert run.predictions.count() == test.count()


def test_sequence_model_is_kept_and_scores_csv(spark, tmp_path):
    from pairloom.plans.sequence_model import SequenceModel

    train = sp.train_pairs(spark, SF)
    vocab = stage(build_vocabulary(pair_tokens(train)), "v")
    vectors = stage(vectors_by_rank(vocab, sp.table(spark, SF, "embeddings")), "w")
    path = tmp_path / "test.csv"
    path.write_text("test_id,question1,question2\n1,aa bb cc,dd ee ff gg\n2,the of and,the of and\n1,the and of,the and of\n3,,\n")
    test = read_test_pairs(spark, str(path))
    run = run_sequence_model(train, test, vectors, 64)
    run.model.save(str(tmp_path / "model"))
    again = SequenceModel.load(spark, str(tmp_path / "model")).score(test)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in run.predictions.collect()}
    assert sorted(r.id for r in again.collect()) == [1, 2, 3]
    assert run.vocabulary.count() > 0


def test_staged_tables_can_be_dropped(spark, pairs):
    import os

    from pairloom.sources import tables

    kept = tables._staged.pop(spark.sparkContext.applicationId, [])
    folder = stage(pairs, "gone").inputFiles()[0].removeprefix("file:").rpartition("/")[0]
    folder = "/" + folder.lstrip("/")
    assert os.path.isdir(folder) and tables.drop_staged(spark) == 1 and not os.path.isdir(folder)
    tables._staged[spark.sparkContext.applicationId] = kept


def test_scratch_keeps_only_what_is_asked_for(spark, pairs):
    import os

    from pairloom.sources.tables import scratch

    def folder(df):
        return "/" + df.inputFiles()[0].removeprefix("file:").lstrip("/").rpartition("/")[0]

    with scratch(spark) as keep:
        inner = folder(stage(pairs, "inner"))
        with scratch(spark) as keep_more:
            deepest, deep = folder(stage(pairs, "deepest")), keep_more(pairs, "deep")
        assert not os.path.isdir(deepest) and deep.count() == pairs.count()
        kept = keep(deep, "kept")
    assert not os.path.isdir(inner) and not os.path.isdir(folder(deep)) and kept.exceptAll(pairs).count() == 0
    try:
        with scratch(spark):
            gone = folder(stage(pairs, "failed"))
            raise KeyError
    except KeyError:
        assert not os.path.isdir(gone)


def test_a_save_that_ends_halfway_leaves_the_model_before_it(spark, tmp_path, monkeypatch):
    from pairloom.operators.heads import DenseHead
    from pairloom.plans import sequence_model as sm

    def model(weight):
        matrix = spark.createDataFrame([("a", 2, [weight])], "token string, idx int, vec array<float>")
        return sm.SequenceModel(matrix, DenseHead([0.0], [1.0], ([weight], [0.0]), (0.0, 0.0)), 1, 0.9)

    path = str(tmp_path / "model")
    for weight in (1.0, 2.0):
        model(weight).save(path)
        assert sm.SequenceModel.load(spark, path).head.weights[0] == [weight]

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(sm, "save_head", fails)
        try:
            model(3.0).save(path)
        except OSError:
            pass
    again = sm.SequenceModel.load(spark, path)
    assert again.head.weights[0] == [2.0] and again.matrix.first().vec == [2.0]
