"""Operators over documents beside plain Python, on whole small tables and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairloom.llm import context_tree, decontamination, mixing, near_duplicates, quality, sharding, token_counts, words
from pairloom.llm.graphs import connected_components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, key string"
LONG = "ab cd ef gh ij kl mn op qr st " * 3000
ODD = [
    (0, None, "en", "a", 0, None, "x"), (1, "", "en", None, 0, "h", "x"), (2, " \t\n ", "en", "a", 0, "h", None), (3, "one", "en", "b", 3, "h", "x"),
    (4, "one two three four five", "en", None, 3, "h", "x"), (5, "One two\tthree\nfour five", "en", "a", 3, "h", "x"),
    (6, LONG, "en", "a", 1, "h", "x"), (6, LONG, "en", "a", 1, "h", "x"), (None, "one two three four five six", "en", "a", 1, "h", "x"),
    (7, "é ü ß 中文 \x1c \u00a0 end", None, "b", 1, "h", "x"), (8, "# % <a> | $5 & *", "en", "b", 1, "h", "x"),
]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def items(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_words(spark, odd):
    for row in odd.select("text", words.word_count(F.col("text")).alias("n")).collect():
        assert row.n == len(split(row.text))


# --- quality ------------------------------------------------------------------

def plain_quality(text):
    w = split(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {p for i, x in enumerate(windows) if often[x] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if split(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_quality_counts(request, table):
    df = request.getfixturevalue(table)
    expected = Counter((d, *plain_quality(t)) for d, t in texts(df))
    got = quality.quality_rules(df).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == expected
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_quality_repeats_at_random(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))), "s") for k in range(200)]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {(r.doc_id, r.n_repeat_words) for r in got.collect()} == {(k, plain_quality(t)[4]) for k, t, _ in rows}


def test_quality_depleted_documents(spark):
    def own(k, n):
        return " ".join(f"w{k}x{j}" for j in range(n))

    notice = " ".join(f"n{j}" for j in range(70))
    rows = [(k, f"{own(k, 60)}\n{notice}", "h") for k in range(30)] + [(90, f"  {notice.upper()} \nlast {own(90, 3)}", "h"), (91, notice, "other")]
    rows += [(100 + k, own(7, 80), "copies") for k in range(60)]
    kept = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [k for k, v in kept.items() if not v] == [90]


@pytest.mark.parametrize("others", [0, 400])
def test_line_limit_is_the_same_for_small_and_hot_hosts(spark, others):
    """Eleven different texts with a line are too many and ten are not, in a host of any size; short lines stay."""
    def own(k):
        return " ".join(f"w{k}x{j}" for j in range(60))

    rows = [(k, f"{own(k)}\nshare this page\nread more", "h") for k in range(11)] + [(20 + k, f"{own(20 + k)}\nsee also these", "h") for k in range(10)]
    rows += [(20, rows[11][1], "h")] * 5 + [(1000 + k, own(1000 + k), "h") for k in range(others)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    cut = {r.doc_id: r.cut_chars for r in quality.quality_rules(df).collect()}
    assert {k for k, n in cut.items() if n} == set(range(11)) and cut[3] == len("share this page")


def test_clashing_names_and_no_words(spark):
    rows = [(1, " ".join("abcdefghij" * 9), "s", "x", "y", "z"), (2, " \n", "s", "x", "y", "z"), (None, None, None, "x", "y", "z"), (3, None, "s", None, "y", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, gone string, text_key string, row string")
    assert quality.cleaned_texts(df).columns == df.columns
    assert [tuple(r) for r in quality.cleaned_texts(df, max_documents=0).collect()] == [rows[2]]


def test_quality_writes_texts_without_frequent_lines(spark):
    def own(k, n=60):
        return " ".join(f"w{k}x{j}" for j in range(n))

    rows = [(k, f"{own(k)}\n\n All rights  reserved \n\tend {k}\nALL RIGHTS  RESERVED\n", "en", "h", 7) for k in range(21)]
    rows += [(30, f"{own(30)}\nall rights reserved", "en", "h", 7), (31, f"{own(31)}\nall rights  reserved", "en", "other", 7), (None, " all rights  reserved", "en", "h", 7)]
    rows += [(40 + k, f"all rights  reserved\n{own(40 + k)}", "en", None, 7) for k in range(22)] + [(90, None, "en", "h", 7), (91, "short", "en", "h", 7)]
    rows += [rows[0], (30, "short too", "en", "h", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wanted = []
    for d, text, lang, source, n in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if x.strip(" ").lower() != "all rights  reserved" or source == "other"]
        cleaned = "\n".join(left) if len(left) < len(lines) else text
        if d is None or len(split(text)) >= 50:
            wanted.append((d, cleaned, lang, source, n if cleaned == text else len(cleaned)))
    for got in (quality.cleaned_texts(df), corpus_pipeline.quality(spark, df, SF)):
        assert got.columns == df.columns and got.schema["n_chars"].dataType == df.schema["n_chars"].dataType
        assert Counter(map(tuple, got.collect())) == Counter(wanted)
    cut = {(r.doc_id, r.n_words): r.cut_chars for r in quality.quality_rules(df).collect()}
    assert cut[0, 68] == 42 and cut[40, 63] == 20 and cut[30, 63] == cut[31, 63] == 0


def test_texts_are_not_shuffled_for_few_verdicts(spark):
    """Small verdicts are broadcast because they were measured, whatever Spark's own limit."""
    rows = [(k, "shared line of words\n" + " ".join(f"w{k}x{i}" for i in range(60)), "a") for k in range(12)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = quality.cleaned_texts(spark.createDataFrame(rows, "doc_id long, text string, source string"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {r.text for r in got.collect()} == {t.split("\n")[1] for _, t, _ in rows}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# --- near duplicates ------------------------------------------------------------

def plain_groups(rows):
    sets = {}
    for d, t in rows:
        w = split(lower(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def family(seed, n, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("case", ["docs", "odd", "families"])
def test_near_duplicates(request, spark, case, monkeypatch):
    if case == "families":
        monkeypatch.setattr(near_duplicates, "FEW", 3)
        monkeypatch.setattr(near_duplicates, "MANY", 2)
        rows = list(enumerate([t for s in range(4) for t in family(s, 40, 7)] + ["the same text of six words"] * 30))
        df = spark.createDataFrame(rows, "doc_id long, text string")
    else:
        df = request.getfixturevalue(case)
    got = near_duplicates.near_duplicates(df).collect()
    expected = plain_groups([(d, t) for d, t in texts(df) if d is not None])
    assert len(got) == df.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_repeated_ids_have_the_links_of_all_their_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(150)) for x in "abc")
    rows = [(5, a), (5, b), (7, a + " z"), (8, b + " z"), (3, a), (9, c), (9, b + " y"), (11, c + " q"), (20, "p q r s t u"), (None, c), (20, None)]
    got = {(r.doc_id, r.component_id) for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 3), (7, 3), (8, 3), (3, 3), (9, 3), (11, 3), (20, 20), (None, None)}


def test_all_that_meet_across_components(spark, monkeypatch):
    """The last step alone, without the first links, finds every link of a bucket to another component."""
    monkeypatch.setattr(near_duplicates, "FEW", 2)
    monkeypatch.setattr(near_duplicates, "MANY", 3)
    rng = random.Random(6)
    rows = [(k, sorted(rng.sample(range(24), rng.randrange(1, 24))), rng.randrange(4)) for k in range(60)]
    rows += [(60 + k, sorted(set(range(20)) - {k}), k % 4) for k in range(20)]
    signs = spark.createDataFrame([(k, len(x), [0] * 8) for k, x, _ in rows], "id long, n_shingles long, bits array<long>")
    sets = spark.createDataFrame([(k, x) for k, x, _ in rows], "id long, items array<long>")
    mixed = spark.createDataFrame([(k % 2, k, 100 + c, 100) for k, _, c in rows], "key long, id long, component long, most long")
    got = {tuple(r) for r in near_duplicates._all_across(mixed, signs, sets, 75, 0.5).collect()}
    every = {(a, b) for a, x, c in rows for b, y, d in rows if a < b and a % 2 == b % 2 and c != d and 4 * len(set(x) & set(y)) >= 3 * len(set(x) | set(y))}
    assert got == every and len(every) > 30


def test_full_sets_are_not_written_for_each_bucket(spark, monkeypatch):
    """Documents that share ten buckets meet in one, and only those that low bits leave with a partner bring their sets, once."""
    written = []

    def stage(df, name, real=near_duplicates.stage):
        out = real(df, name)
        written.extend([out.count()] if "items" in out.columns else [])
        return out

    monkeypatch.setattr(near_duplicates, "stage", stage)
    sets = [(k, list(range(20)) if k < 4 else list(range(100 * k, 100 * k + 20))) for k in range(12)]
    signs = spark.createDataFrame(
        [(k, 20, [0] * 8 if k < 4 else np.random.default_rng(k).integers(1 << 62, size=8).tolist()) for k, _ in sets],
        "id long, n_shingles long, bits array<long>")
    mixed = spark.createDataFrame([(key, k, k, 11) for key in range(10) for k, _ in sets], "key long, id long, component long, most long")
    links = near_duplicates._all_across(mixed, signs, spark.createDataFrame(sets, "id long, items array<long>"), 75, 0.57)
    assert {tuple(r) for r in links.collect()} == {(a, b) for a in range(4) for b in range(a + 1, 4)}
    assert sum(written) <= 4


def test_estimate_follows_similarity(spark):
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(1 << 63, size=900, dtype=np.uint64))
    sets = [a, np.union1d(a[:600], rng.integers(1 << 63, size=300, dtype=np.uint64)), rng.integers(1 << 63, size=900, dtype=np.uint64)]
    bits = [x.tolist() for x in near_duplicates.packed_bits(near_duplicates.minima([np.sort(s) for s in sets]))]
    row = spark.createDataFrame([(bits[0], bits[1], bits[2])], "a array<long>, b array<long>, c array<long>").select(
        *(near_duplicates.estimate("a", x).alias(x) for x in "abc")).first()
    assert row.a == 1 and abs(row.b - 0.5) < 0.2 and abs(row.c) < 0.2


def test_components_of_paths_and_rings(spark):
    links = [(k, k + 1) for k in range(40)] + [(100 + k, 100 + (k + 1) % 7) for k in range(7)] + [(500, k) for k in range(501, 530)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(7)}, **{k: 500 for k in range(500, 530)}}


# --- decontamination ---------------------------------------------------------------

def plain_distance(pattern, text):
    last = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (c != d)))
        last = now
    return min(last)


def test_bit_parallel_distance():
    rng = random.Random(5)
    for _ in range(300):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (90, 120))
        best, end = decontamination.best_match(decontamination.masks(p), len(p), t)
        assert best == plain_distance(p, t)
        assert min(len(p), best) == best and (end == 0 or plain_distance(p, t[:end]) == best)


def test_contaminated_beside_plain_search(spark, items):
    rng = random.Random(8)
    known = [(r.item_id, r.text) for r in items.collect()]
    rows = []
    for k in range(60):
        item = " ".join(split(lower(rng.choice(known)[1])))
        for _ in range(rng.randint(0, len(item) // 12)):
            at = rng.randrange(len(item))
            item = item[:at] + rng.choice(["", "x", item[at] + "y"]) + item[at + 1 :]
        rows.append((k, f"Some words {item.upper() if k % 2 else item}\n\n and more"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontamination.contaminated(df, items, block_chars=3000).collect()}
    expected = {}
    for d, t in rows:
        text = " ".join(split(lower(t)))
        for i, item in known:
            item = " ".join(split(lower(item)))
            if any(piece in text for _, piece in decontamination.pieces(item)):
                n = plain_distance(item, text)
                if n <= len(item) // 20:
                    expected[d, i] = n
    assert got == expected and len(expected) > 20


def test_contaminated_odd_rows(spark, odd, empty, items):
    more = spark.createDataFrame([(900, None), (901, ""), (902, "one two"), (903, " ".join(split(LONG)[:20]))], "item_id long, text string")
    got = decontamination.contaminated(odd, more).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.distance) for r in got) == [(0, 902, 0), (4, 902, 0), (5, 902, 0), (6, 903, 0), (6, 903, 0)]
    assert decontamination.contaminated(empty, items).count() == 0
    assert decontamination.contaminated(odd, more.limit(0)).count() == 0


def test_short_items_are_whole_words(spark):
    items = [(1, "What is 7 times 8?"), (2, "cat"), (3, "b c"), (4, " \n"), (5, "ends here")]
    rows = [(10, "Ask: what is  7\ntimes 8? now"), (11, "the Cat sat"), (12, "concatenate"), (13, "cat"), (14, "a b cd"), (15, "a b c"), (16, "it ends here"), (17, "what is 7 times 8"), (18, "cat cat")]
    make = lambda x, c: spark.createDataFrame(x, f"{c} long, text string")
    got = decontamination.contaminated(make(rows, "doc_id"), make(items, "item_id")).collect()
    assert sorted((r.doc_id, r.item_id, r.distance, r.budget, r.found_end) for r in got) == [
        (10, 1, 0, 0, 23), (11, 2, 0, 0, 7), (13, 2, 0, 0, 3), (15, 3, 0, 0, 5), (16, 5, 0, 0, 12), (18, 2, 0, 0, 3)]


# --- mixing ---------------------------------------------------------------------------

def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_mix(request, table):
    df = request.getfixturevalue(table)
    sources = {}
    for r in df.collect():
        sources.setdefault(r.source, 0)
        sources[r.source] += len(split(r.text))
    target = plain_targets(sources)
    rows = mixing.mix_sources(df.withColumn("times", F.lit(9))).collect()
    assert len(rows) == df.count()
    assert sorted((r.size for r in rows)) == sorted(len(split(t)) for _, t in texts(df))
    per = defaultdict(list)
    for r in rows:
        per[r.source_size, round(r.target, 6)].append(r)
        assert r.taken in (0, r.size, 2 * r.size)
    wanted = Counter((n, round(target[s], 6)) for s, n in sources.items())
    assert set(per) == set(wanted)
    if table == "docs":
        for (whole, goal), own in per.items():
            passes, sums = round(goal) // whole, {0}
            for r in own:
                sums |= {x + r.size for x in sums if x + r.size <= round(goal) - passes * whole}
            assert sum(r.taken for r in own) == passes * whole + (max(sums) if passes < 2 else 0)
    again = mixing.mix_sources(df).collect()
    assert Counter(map(tuple, again)) == Counter(tuple(r) for r in rows)


def test_fit_counts():
    rng = random.Random(2)
    for _ in range(200):
        lengths = rng.sample(range(1, 60), rng.randint(1, 6))
        counts = [rng.randint(0, 5) for _ in lengths]
        total = sum(n * c for n, c in zip(lengths, counts))
        budget = rng.randint(0, total + 5)
        taken = mixing.fit_counts(lengths, counts, budget, span=rng.choice([50, 10**4]))
        words_taken = sum(n * t for n, t in zip(lengths, taken))
        assert all(0 <= t <= c for t, c in zip(taken, counts)) and words_taken <= budget
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {x + n * k for x in sums for k in range(c + 1)}
        assert words_taken == max(x for x in sums if x <= budget)


def test_long_documents_meet_their_budget():
    """Documents of 17,000 to 60,000 words: as near as any choice of them can come."""
    rng = random.Random(3)
    for _ in range(60):
        sizes = Counter(rng.randrange(17_000, 60_000) for _ in range(rng.randrange(2, 40)))
        lengths, counts = list(sizes), list(sizes.values())
        budget = rng.randrange(sum(sizes.elements()))
        reach = 1
        for n in sizes.elements():
            reach |= reach << n
        best = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
        assert sum(n * t for n, t in zip(lengths, mixing.fit_counts(lengths, counts, budget))) == best


def test_each_length_gives_its_share():
    rng = random.Random(4)
    sizes = Counter(int(math.exp(rng.uniform(2, 10))) for _ in range(6000))
    lengths, counts = list(sizes), list(sizes.values())
    whole = sum(n * c for n, c in sizes.items())
    taken = mixing.fit_counts(lengths, counts, whole // 2)
    assert sum(n * t for n, t in zip(lengths, taken)) == whole // 2
    for low, high in ((0, 50), (50, 800), (800, 5000), (5000, 30_000)):
        band = [k for k, n in enumerate(lengths) if low <= n < high]
        assert abs(sum(taken[k] for k in band) / sum(counts[k] for k in band) - 0.5) < 0.04
    assert any(mixing.fit_counts(lengths, counts, whole // 2, seed=k) != taken for k in (1, 2))


def test_documents_too_long_to_be_moved(monkeypatch):
    monkeypatch.setattr(mixing, "MOVED", 50)
    rng = random.Random(5)
    for _ in range(100):
        sizes = Counter([rng.randrange(1, 40) for _ in range(rng.randrange(30))] + [rng.randrange(2000, 90_000) for _ in range(rng.randrange(1, 9))])
        lengths, counts = list(sizes), list(sizes.values())
        budget = rng.randrange(sum(sizes.elements()) + 1)
        taken = mixing.fit_counts(lengths, counts, budget, span=10)
        used = sum(n * t for n, t in zip(lengths, taken))
        assert all(0 <= t <= c for t, c in zip(taken, counts)) and used <= budget


def test_alike_rows_are_taken_in_part(spark):
    """Forty rows alike in all columns, of which a source can use some; and rows of one id with different texts."""
    rows = [(7, "one two three", "x", "en")] * 40 + [(8, "four five six", "x", "en"), (None, None, "x", "en"), (9, "a b", "y", "en"), (9, "c d", "y", "de")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    decided = mixing.mix_sources(df).collect()
    assert len(decided) == len(rows) and Counter(r.doc_id for r in decided) == Counter(r[0] for r in rows)
    assert len({r.times for r in decided if r.doc_id == 7}) == 2
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns and set(map(tuple, out.collect())) <= set(rows)
    assert Counter(r.doc_id for r in out.collect()) == Counter({d: n for d, n in ((d, sum(r.times for r in decided if r.doc_id == d)) for d in (7, 8, 9, None)) if n})
    assert mixing.mixed_rows(df.limit(0)).count() == 0
    assert mixing.fit_counts([7, 5], [3, 3], 19) == [2, 1]


# --- sharding ------------------------------------------------------------------------------

def plain_capacity(sizes, n):
    low, high = max(sizes, default=0), sum(sizes)
    while low < high:
        mid, used, full = (low + high) // 2, 1, 0
        for s in sizes:
            if full + s > mid:
                used, full = used + 1, 0
            full += s
        low, high = (low, mid) if used <= n else (mid + 1, high)
    return low


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_shards(request, table):
    import hashlib

    df = request.getfixturevalue(table)
    rows = sharding.shard_documents(df.withColumn("shard", F.lit("x"))).collect()
    by = defaultdict(int)
    for _, t in texts(df):
        by[hashlib.md5((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
    full = Counter()
    for r in rows:
        full[r.shard] += r.size
    assert max(full.values()) == plain_capacity([by[k] for k in sorted(by)], 8)
    for s in full:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    text = defaultdict(set)
    for r in rows:
        text[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in text.values())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts(df))


# --- scores ------------------------------------------------------------------------------------

def plain_tree_score(train, text, depth=context_tree.DEPTH):
    """The tree by dictionaries and recursion, for one text."""
    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)

    def windows(raw):
        padded = b"\n" * depth + raw
        return [(padded[k - 1 : k - depth - 1 if k > depth else None : -1], padded[k]) for k in range(depth, len(padded))]

    for raw in train:
        for context, byte in windows(raw):
            for d in range(depth + 1):
                for k in range(8):
                    counts[context[:d], 1 << k | byte >> (8 - k)][byte >> (7 - k) & 1] += 1
                    if d:
                        children[context[: d - 1], 1 << k | byte >> (8 - k)].add(context[:d])

    def log_kt(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)

    known = {}

    def log_pw(context, prefix):
        if (context, prefix) not in known:
            own = log_kt(counts[context, prefix])
            if len(context) < depth:
                below = sum(log_pw(c, prefix) for c in children[context, prefix])
                own = np.logaddexp(own, below) - math.log(2)
            known[context, prefix] = own
        return known[context, prefix]

    total = 0.0
    for context, byte in windows(text):
        for k in range(8):
            prefix, p = 1 << k | byte >> (8 - k), None
            for d in range(depth, -1, -1):
                node = context[:d], prefix
                if node in counts and sum(counts[node]):
                    one = (counts[node][1] + 0.5) / (sum(counts[node]) + 1)
                    w = 1.0 if d == depth else math.exp(log_kt(counts[node]) - math.log(2) - log_pw(*node))
                    p = one if p is None else w * one + (1 - w) * p
            p = 0.5 if p is None else p
            total += math.log10(p if byte >> (7 - k) & 1 else 1 - p)
    return total


def plain_base(rows):
    train = Counter()
    for d, t in rows:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2:
            train.update([*split(lower(t)), "\n"])
    n, v = sum(train.values()), len(train)
    return n, [(len(split(lower(t))) + 1, sum(train[w] > 0 for w in [*split(lower(t)), "\n"]),
                sum(math.log10((train[w] + 1) / (n + v + 1)) for w in [*split(lower(t)), "\n"])) for _, t in rows]


def test_scores_beside_the_plain_tree(spark, monkeypatch):
    monkeypatch.setattr(context_tree, "BLOCK_BYTES", 300)
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["the", "cat", "Sat", "on", "é", "mat", "matter"]) for _ in range(rng.randint(0, 30)))) for k in range(40)]
    rows += [(40, None), (41, ""), (42, "x" * 700), (None, "The cat"), (3, rows[3][1])]
    got = context_tree.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    raw = {d: (" ".join(split(lower(t))) + "\n").encode() for d, t in rows}
    train = [(" ".join(split(lower(t))) + "\n").encode() for d, t in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2]
    n, base = plain_base(rows)
    expected = {d: x for (d, _), x in zip(rows, base)}
    assert len(got) == len(rows)
    for r in got:
        tokens, known, score = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
        assert math.isclose(r.base_score, score, rel_tol=1e-9)
        assert math.isclose(r.score, plain_tree_score(train, raw[r.doc_id]), rel_tol=1e-5)


def test_scores_of_unseen_texts_beat_even_bytes(docs):
    held = context_tree.score_texts(docs).where("held_out")
    assert held.agg(F.avg("bits_per_byte")).first()[0] < 3.5


def test_no_rows(empty):
    assert context_tree.score_texts(empty).count() == 0
    assert token_counts.token_counts(empty).count() == 0
    assert near_duplicates.near_duplicates(empty).count() == 0
    assert quality.quality_rules(empty).count() == 0
    assert mixing.mix_sources(empty).count() == 0
    assert sharding.shard_documents(empty).count() == 0


# --- token counts ------------------------------------------------------------------------------

def test_token_counts_beside_a_tokenizer(docs, odd):
    from tokenizers import Tokenizer, models

    pieces = token_counts.load_pieces(token_counts.VOCABULARY)
    whole = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], 0))
    whole_pieces = token_counts.Counter(pieces)
    lowest = min(0.0, *(s for _, s in pieces))
    assert whole_pieces.unknown == lowest - token_counts.UNKNOWN_PENALTY
    for df in (docs, odd):
        for r in token_counts.token_counts(df).join(df.select("doc_id", "text").dropDuplicates(), "doc_id").collect():
            own = [token_counts.SPACE + w for w in split(r.text)]
            assert r.n_words == len(own)
            assert r.n_tokens == sum(len(whole.encode(w).ids) for w in own)


def test_token_ties():
    from tokenizers import Tokenizer, models

    rng = random.Random(6)
    for _ in range(60):
        pieces = [(p, float(-rng.randint(1, 3))) for p in {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(12)}]
        model, own = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], 0)), token_counts.Counter(pieces)
        for _ in range(20):
            text = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 14)))
            assert own.word(text)[0] == len(model.encode(text).ids)


# --- pipeline -------------------------------------------------------------------------------------

def plain_cleaned(rows):
    """(doc_id, text) of the documents that stay, without the lines of eleven or more texts of their source."""
    normal = lambda x: x.strip(" ").lower()
    seen = defaultdict(set)
    for r in rows:
        for x in (r.text or "").split("\n"):
            if len(split(x)) >= 3:
                seen[r.source, normal(x)].add(r.text)
    out = set()
    for r in rows:
        n, _, _, _, repeats = plain_quality(r.text)
        if n < 50 or 100 * repeats > 50 * n:
            continue
        lines = r.text.split("\n")
        left = [x for x in lines if len(seen[r.source, normal(x)]) <= 10]
        whole, less = (sum(len(x) for x in own if split(x)) for own in (lines, left))
        if 100 * less >= 20 * whole:
            out.add((r.doc_id, "\n".join(left) if len(left) < len(lines) else r.text))
    return out


def test_pipeline_stages(spark, docs):
    sf, now = SF, docs
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        before, now = now, step(spark, now, sf)
        if name != "shard":
            assert now.columns == docs.columns
        rows, seen[name] = before.collect(), now.collect()
        ids = {r.doc_id for r in seen[name]}
        if name == "quality":
            assert {(r.doc_id, r.text) for r in seen[name]} == plain_cleaned(rows)
        if name == "near_dedup":
            groups = plain_groups([(r.doc_id, r.text) for r in rows])
            assert ids == {g for _, g in groups.values()}
        if name == "decontaminate":
            plain = {r.doc_id: " ".join(split(lower(r.text))) for r in rows}
            known = [" ".join(split(lower(r.text))) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            near = {d: [x for x in known if any(piece in t for _, piece in decontamination.pieces(x))] for d, t in plain.items()}
            hit = {d for d, found in near.items() if any(plain_distance(x, plain[d]) <= len(x) // 20 for x in found)}
            assert hit and ids == plain.keys() - hit
        if name == "mix":
            have, took = Counter(), Counter()
            for r in rows:
                have[r.source] += len(split(r.text))
            for r in seen[name]:
                took[r.source] += len(split(r.text))
            goals = plain_targets(have)
            for s, whole in have.items():
                passes, reach = min(round(goals[s]) // whole, 2) if whole else 0, 1
                for r in rows:
                    reach |= reach << len(split(r.text)) if r.source == s else 0
                rest = round(goals[s]) - passes * whole if passes < 2 else 0
                assert took[s] == passes * whole + (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
            assert max(Counter(r.doc_id for r in seen[name]).values()) <= 2
        if name == "shard":
            assert Counter(r.doc_id for r in seen[name]) == Counter(r.doc_id for r in rows)
            text = {r.doc_id: r.text for r in rows}
            groups = Counter()
            for r in seen[name]:
                groups[(text[r.doc_id] or ""), r.shard] += r.size
            assert len({t for t, _ in groups}) == len(groups)
            by_digest = sorted((hashlib.md5(t.encode()).hexdigest(), n, s) for (t, s), n in groups.items())
            assert [s for *_, s in by_digest] == sorted(s for *_, s in by_digest)
            filled = Counter()
            for _, n, s in by_digest:
                filled[s] += n
            assert max(filled.values()) == plain_capacity([n for _, n, _ in by_digest], sharding.SHARDS)
        now = spark.createDataFrame(seen[name], now.schema)


def test_pipeline_odd_rows(spark, odd, empty):
    for df in (odd, empty):
        now = df.select("doc_id", "text", "lang", "source", "n_chars")
        for name, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, now, SF)
            assert out.columns == now.columns
            ids = Counter(r.doc_id for r in out.collect())
            if df is empty:
                assert not ids
            elif name == "quality":
                assert ids == {None: 1}
            elif name == "near_dedup":
                assert ids == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 6: 1, 7: 1, 8: 1, None: 1}
            elif name == "decontaminate":
                assert ids == Counter(r[0] for r in ODD)
            else:
                assert ids[6] >= 2 and set(ids) <= {r[0] for r in ODD}
    kept = corpus_pipeline.near_dedup(spark, odd, SF)
    assert kept.where("doc_id = 6").count() == 1 and kept.where("doc_id is null").count() == 1


def test_mix_keeps_rows_without_an_id(spark):
    rows = [(None if k % 3 == 0 else k // 2, f"t{k} " + "w " * (k % 7), "en", "ab"[k % 2], k) for k in range(40)] + [(None, "x y", None, None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wanted = Counter()
    for r in mixing.mix_sources(df).collect():
        wanted[r.doc_id, r.size] += r.times
    out = corpus_pipeline.mix(spark, df, SF)
    got = [tuple(r) for r in out.collect()]
    assert out.columns == df.columns and set(got) <= set(rows)
    assert Counter((r[0], len(split(r[1]))) for r in got) == Counter({k: n for k, n in wanted.items() if n})
    assert sum(r[0] is None for r in got) > 0
