from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from pairloom.functions import text as tx

ODD = "ab Z9_é́İΣςß²¼漢😀 \u0085\u001c\u001f \t\n\r?.,-'​|"


def apply(spark, fn, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    return [r[1] for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 25))) for _ in range(400)] + ["", "nan", "NaN"]


def test_missing_words(spark):
    gone = ["", "NaN", "nan", "null", "NULL", "None", "NA", "N/A", "n/a", "<NA>", None]
    assert apply(spark, tx.na_to_null, gone) == [None] * len(gone)
    assert apply(spark, tx.na_to_null, ["nan?", " nan", "Null"]) == ["nan?", " nan", "Null"]
    assert apply(spark, lambda c: tx.as_text(tx.na_to_null(c)), ["NA", "x"]) == ["nan", "x"]


def test_whitespace_tokens_match_python(spark, texts):
    assert apply(spark, tx.whitespace_tokens, texts) == [t.split() for t in texts]


def test_trim_matches_python(spark, texts):
    assert apply(spark, tx.trim_blanks, texts) == [t.strip() for t in texts]


def test_cleaning_matches_python(spark, texts):
    def tfidf(t):
        low = t.lower()
        return re.sub(r"\W+", " ", "" if low == "nan" else low)

    def train(t):
        return re.sub(r"[^0-9a-zA-Z\s?.,]", " ", t).lower().strip()

    def test(t):
        return re.sub(r"[^0-9a-zA-Z\s]", "", t).lower().strip()

    assert apply(spark, tx.clean_tfidf, texts) == [tfidf(t) for t in texts]
    assert apply(spark, tx.clean_train, texts) == [train(t) for t in texts]
    assert apply(spark, tx.clean_test, texts) == [test(t) for t in texts]


def test_tfidf_tokens_have_two_characters(spark):
    assert apply(spark, tx.tfidf_tokens, ["A bb c-dd é 漢字", None, "nan"]) == [["bb", "dd", "漢字"], [], []]


def test_word_tokens(spark):
    cases = {
        "I cannot, gonna wanna!": ["i", "can", "not", ",", "gon", "na", "wan", "na"],
        "3.5 or 3,500 e.g. this... ok.": ["3.5", "or", "3,500", "e.g.", "this", "...", "ok", "."],
        "what?? a,b": ["what", "?", "?", "a", ",", "b"],
        "canno cannots": ["canno", "cannots"],
        "###": [],
    }
    assert apply(spark, tx.sequence_tokens, list(cases)) == list(cases.values())
    assert apply(spark, lambda c: tx.sequence_tokens(c, "delete"), ["it's 3.5, ok?"]) == [["its", "35", "ok"]]


def test_tokens_are_those_of_the_rewritten_text(spark):
    """Both paths of ``sequence_tokens`` agree beside every character, and beside bytes that are no UTF-8."""
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 97 == 0 or 0xFE00 <= c < 0x10000)]
    texts = [form.replace("#", c) for c in chars for form in ("a#B.#c. 1,#2", "#cannot can#not cannot#")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    pairs = spark.range(1 << 16).select(F.concat(
        F.encode(F.lit("Ab"), "utf-8"), F.unhex(F.lpad(F.hex("id"), 4, "0")), F.encode(F.lit("nC"), "utf-8")).cast("string").alias("t"))
    for rows in (df, pairs):
        rewritten = tx.word_tokens(tx._plain(F.col("t"), "blank"))
        assert rows.where(~tx.sequence_tokens(F.col("t")).eqNullSafe(rewritten)).limit(3).collect() == []


def test_undecodable_bytes_are_dropped(spark):
    df = spark.createDataFrame([(1, bytearray(b"ok")), (2, bytearray(b"\xff\xfe")), (3, None)], "i int, b binary")
    kept = df.select("i", F.col("b").cast("string").alias("t")).filter(tx.is_decodable(F.col("t")))
    assert [r.i for r in kept.orderBy("i").collect()] == [1, 3]
