from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions import similarity as sm
from pairloom.functions.text import tfidf_tokens, whitespace_tokens
from pairloom.operators.features import feature_set, pair_features

def a() -> Column:
    return F.col("a")


def b() -> Column:
    return F.col("b")


def cosine(a, b):
    ca, cb = Counter(a), Counter(b)
    wb = {t: n * (1.0 if t in ca else 1 + math.log(2)) for t, n in cb.items()}
    dot = sum(n * wb.get(t, 0) for t, n in ca.items())
    norm = math.sqrt(sum(n * n for n in ca.values())) * math.sqrt(sum(w * w for w in wb.values()))
    return dot / norm if norm else 0.0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def run(spark, column, rows):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a string, b string")
    return [r[1] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["aa", "bb", "Bb", "cc", "d", "é", "nan", "ee,", "ee"]

    def text():
        return " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))

    return [(text(), text()) for _ in range(300)]


def test_cosine_matches_brute_force(spark, rows):
    got = run(spark, sm.tfidf_cosine(tfidf_tokens(a()), tfidf_tokens(b())), rows)

    def tokens(t):
        return [w for w in t.lower().replace(",", " ").split() if len(w) > 1] if t != "nan" else []

    assert got == pytest.approx([cosine(tokens(a), tokens(b)) for a, b in rows])


def test_cosine_special_cases(spark):
    cases = [("same text", "same text"), ("one two", "three four"), ("a b", "a b"), ("text", None), ("aa bb", "bb cc"),
             ("bb cc dd", "aa bb")]
    got = run(spark, sm.tfidf_cosine(tfidf_tokens(a()), tfidf_tokens(b())), cases)
    assert got[:4] == pytest.approx([1.0, 0.0, 0.0, 0.0])
    assert got[4] == pytest.approx(1 / (math.sqrt(2) * math.sqrt(1 + (1 + math.log(2)) ** 2)))
    swapped = run(spark, sm.tfidf_cosine(tfidf_tokens(b()), tfidf_tokens(a())), cases[5:])
    assert got[5] != pytest.approx(swapped[0])


def test_common_words_matches_brute_force(spark, rows):
    got = run(spark, sm.common_words(whitespace_tokens(a()), whitespace_tokens(b())), rows)
    assert got == [sum(w in b.split() for w in a.split()) for a, b in rows]


def test_common_words_counts_left_repeats(spark):
    column = sm.common_words(whitespace_tokens(a()), whitespace_tokens(b()))
    assert run(spark, column, [("x x y", "x"), ("x", "x x y"), ("X", "x"), (None, None)]) == [2, 1, 0, 1]


def test_edit_distance_counts_characters(spark):
    cases = [("é", "e"), ("Kitten", "sitting"), (None, ""), ("漢字", "漢"), ("", "")]
    assert run(spark, sm.edit_distance(a(), b()), cases) == [1, 3, 3, 1, 0]


def test_edit_sigmoid_matches_the_full_distance(spark):
    rng = random.Random(5)

    def noisy(t, n):
        chars = list(t)
        for _ in range(n):
            i = rng.randrange(len(chars) + 1)
            match rng.randrange(3):
                case 0:
                    chars.insert(i, rng.choice("abé"))
                case 1 if chars:
                    chars.pop(min(i, len(chars) - 1))
                case _ if chars:
                    chars[min(i, len(chars) - 1)] = rng.choice("xyz")
        return "".join(chars)

    cases = []
    for size in (0, 5, 60, 1100):
        for edits in (0, 1, 5, 30, 36, 37, 60):
            t = "".join(rng.choice("abcdeéñ ") for _ in range(size))
            cases += [(t, noisy(t, edits)), (noisy(t, edits), t)]
    long = "".join(rng.choice("abcd") for _ in range(1500))
    cases += [(long, long[:700] + "x" + long[700:]), (long, "well " + long), (long, long[::-1]), (None, "nan"), ("", None)]
    got = run(spark, sm.edit_sigmoid(a(), b()), cases)
    want = [1 / (1 + math.exp(-levenshtein((a if a is not None else "nan").lower(), (b if b is not None else "nan").lower())))
            for a, b in cases]
    assert got == want


def test_sigmoid_is_one_from_37(spark):
    assert 1 / (1 + math.exp(-37)) == 1.0 > 1 / (1 + math.exp(-36))


def test_normalized_distance(spark):
    df = spark.createDataFrame([([3.0, 0.0], [0.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), ([0.0], [0.0]), ([1.0], [1.0])],
                               "a array<double>, b array<double>").coalesce(1)
    assert [r[0] for r in df.select(sm.normalized_distance(a(), b())).collect()] == [5 / 7, 1.0, None, 0.0]


def test_features_train_and_score_alike(spark, pairs):
    train, score = pair_features(pairs), pair_features(pairs.drop("is_duplicate"))
    assert train.columns == ["id", "cosine", "edit_sig", "len1", "len2", "common", "is_duplicate"]
    assert score.filter("is_duplicate IS NOT NULL").count() == 0
    assert train.drop("is_duplicate").exceptAll(score.drop("is_duplicate")).count() == 0
    assert feature_set(train).columns == ["id", "cosine", "edit_sig", "common", "is_duplicate"]
    row = train.filter("id = 17").first()
    assert (row.len1, row.len2, row.common) == (3, 4, 3)


def test_features_fold_each_text_once(spark, pairs, tmp_path):
    texts = [None, "nan", "NaN", "nAn", "nan ", "İK nan", "ΑΣ ΑΣ.", "ÅNA", "", "na"]
    odd = spark.createDataFrame([(i, a, b, 0) for i, (a, b) in enumerate((a, b) for a in texts for b in texts)],
                                "id long, question1 string, question2 string, is_duplicate int")
    odd.write.parquet(str(tmp_path / "p"))
    odd = spark.read.parquet(str(tmp_path / "p"))
    q1, q2 = F.col("question1"), F.col("question2")
    alone = odd.select("id", sm.tfidf_cosine(tfidf_tokens(q1), tfidf_tokens(q2)).alias("cosine"), sm.edit_sigmoid(q1, q2).alias("edit_sig"))
    features = pair_features(odd)
    assert features.select(alone.columns).exceptAll(alone).count() == 0
    assert features._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 2
    nothing = odd.where(F.coalesce(F.lower(q1), F.lit("nan")) == "nan").select(F.sum(F.size(tfidf_tokens(q1)))).first()[0]
    assert nothing == 0


def test_features_need_no_shuffle(spark, pairs, tmp_path):
    pairs.write.parquet(str(tmp_path / "p"))
    plan = pair_features(spark.read.parquet(str(tmp_path / "p")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_equal_ends_of_long_texts_cost_no_square(spark):
    import random

    from pairloom.functions.similarity import edit_distance

    rng = random.Random(1)
    a = "".join(rng.choice("abcdefgh ") for _ in range(100_000))
    b = list(a)
    for k in range(50):
        b[50_000 + k * 19] = "#"
    df = spark.createDataFrame([(a, "".join(b))], "a string, b string")
    assert df.select(edit_distance(F.col("a"), F.col("b")).alias("d")).first().d == 50


def test_equal_lists_are_not_counted(spark):
    lists = [(["a", "b", "a"], ["a", "b", "a"]), ([], []), (["b", "a", "a"], ["a", "b", "a"])]
    df = spark.createDataFrame(lists, "x array<string>, y array<string>")
    rows = df.select(sm.tfidf_cosine(F.col("x"), F.col("y")), sm.common_words(F.col("x"), F.col("y"))).collect()
    assert [r[1] for r in rows] == [3, 0, 3]
    assert [round(r[0], 12) for r in rows] == [1.0, 0.0, 1.0]


def _lists(rows):
    return [(a.split(), b.split()) for a, b in rows if a and b]


def test_lists_are_counted_by_digests(spark, rows):
    lists = _lists(rows) + [([x], [y, x, x]) for x in "abcdefgh" for y in "ijklmnop"]
    df = spark.createDataFrame(lists, "t1 array<string>, t2 array<string>")
    both = df.select("t1", "t2", sm._overlap(F.col("t1"), F.col("t2")).alias("x"))
    got = both.select("t1", "t2", sm._counted_cosine(F.col("t1"), F.col("t2")).alias("cosine"),
                      F.when(F.col("x.shared") > 0, sm._counted_common(F.col("x"))).alias("common")).collect()
    # A NULL would send a pair of lists to the slow count.
    assert [r.cosine for r in got] == pytest.approx([cosine(r.t1, r.t2) for r in got])
    hits = [sum(t in r.t2 for t in r.t1) for r in got]
    assert [r.common or 0 for r in got] == hits and all(r.common is not None for r, n in zip(got, hits, strict=True) if n)


def test_tokens_that_share_a_digest_are_told_apart(spark, rows, monkeypatch):
    monkeypatch.setattr(sm, "_digest", lambda t: F.length(t).cast("long"))
    df = spark.createDataFrame(_lists(rows), "t1 array<string>, t2 array<string>")
    got = df.select("t1", "t2", sm.tfidf_cosine(F.col("t1"), F.col("t2")).alias("cosine"),
                    sm.common_words(F.col("t1"), F.col("t2")).alias("common"),
                    sm._counted_cosine(F.col("t1"), F.col("t2")).alias("digests")).collect()
    assert [r.cosine for r in got] == pytest.approx([cosine(r.t1, r.t2) for r in got])
    assert [r.common for r in got] == [sum(t in r.t2 for t in r.t1) for r in got]
    assert any(r.digests is None for r in got)
