"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is written to the ``noop`` sink twice; the second run counts.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from checks.queries import QUERIES, feature_table, vocabulary_table
from pairloom.constants import BASIC3
from pairloom.operators.regression import logistic_gd
from pairloom.sources.sample_pairs import train_pairs

HEADLINE = (
    "tfidf_cosine", "common_words", "edit_sigmoid", "features", "feature_set_basic3", "edit_distance",
    "tokens_word", "token_frequency", "term_frequency", "vocabulary", "vocab_encode", "sequence_prepare_train",
    "pooled_sum", "pair_distance", "encode_decay", "dense_head_forward", "relaxed_wmd",
    "row_index", "split_holdout", "dedupe_last", "predictions_csv_rows", "stream_score",
)
STEPS = 5


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            run(QUERIES[name](spark, sf_dir))
            seconds[name] = round(time.perf_counter() - start, 3)
    table = feature_table(spark, sf_dir)
    logistic_gd(table, BASIC3, epochs=1)
    start = time.perf_counter()
    logistic_gd(table, BASIC3, epochs=STEPS)
    seconds["logistic_gd_step"] = round((time.perf_counter() - start) / STEPS, 3)
    pairs = train_pairs(spark, sf_dir).count()
    rates = {q: round(pairs / seconds[q], 1) for q in ("features", "vocabulary", "vocab_encode", "pair_distance")}
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cpus, "pairs": pairs,
        "vocabulary_size": vocabulary_table(spark, sf_dir).count(), "pairs_per_second": rates,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
