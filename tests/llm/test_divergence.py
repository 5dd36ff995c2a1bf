"""Source divergence beside a plain count, with and without digests that several terms share."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from checks.compare import connect, differences
from pairloom.llm import divergence
from pairloom.llm.sql import ORACLE

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, gid string, digest string, term string"
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def split(text):
    found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in found]


def plain(rows, least=3, top=200):
    """The contract over (text, lang, source), group by group and term by term."""
    rows = [(split(t), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == lang]
        documents = Counter(x for words, *_ in own for x in set(words))
        kept = [x for x, n in documents.items() if n >= least]
        whole = Counter(x for words, *_ in own for x in words)
        groups = {source: Counter(x for words, _, s in own if s == source for x in words) for source in {r[2] for r in own}}
        v = len(kept)

        def share(counts):
            n = sum(counts[x] for x in kept)
            return {x: 1 + 10**9 * (counts[x] + 1) // (n + v) for x in kept}

        every, each = share(whole), {s: share(c) for s, c in groups.items()}
        for s, p in each.items():
            pairs = [(sum((p[x] - q[x]) ** 2 // q[x] for x in kept), other) for other, q in each.items() if other != s]
            found = [((p[x] - every[x]) ** 2 // every[x], x) for x in kept if groups[s][x] and p[x] > every[x]]
            for part, values, most in (("pair", pairs, None), ("term", found, top)):
                ranked = sorted(values, key=lambda y: (-y[0], y[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def got(df, **options):
    out = divergence.source_divergence(df, **options)
    assert out.columns == COLUMNS and dict(out.dtypes)["value"] == "bigint" and dict(out.dtypes)["rank"] == "int"
    return sorted(tuple(r) for r in out.collect())


@pytest.fixture(scope="module")
def random_rows():
    rng = random.Random(4)
    words = ["the", "The", "naïve", "Été", "中文", "a", "zz", *(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120))]
    return [
        (" ".join(rng.choice(words[: rng.choice([5, 30, 127])]) + rng.choice(["", ".", "-x", "9"]) for _ in range(rng.randrange(40))),
         rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "", None, "é"])) for _ in range(400)]


def frame(spark, rows):
    return spark.createDataFrame([(k, *r, "x", "y", "z") for k, r in enumerate(rows)], SCHEMA)


def test_random_rows(spark, random_rows):
    assert got(frame(spark, random_rows).repartition(5)) == plain(random_rows)


@pytest.mark.parametrize("bits", [1, 4, 7])
def test_shared_digests(spark, random_rows, bits):
    """Narrow digests make terms share them; the result stays the same."""
    assert got(frame(spark, random_rows).repartition(3), bits=bits) == plain(random_rows)


def test_few_ranks_and_many_ties(spark):
    rows = [(" ".join(f"t{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)), "en", s) for s in ("a", "a", "a", "b")]
    rows += [("tazz other words here", "en", "b")] * 3
    assert got(frame(spark, rows), top=7) == plain(rows, top=7)
    assert got(frame(spark, rows), min_documents=4) == plain(rows, least=4)


def test_small_steps(spark, random_rows, monkeypatch):
    """Slices of a few rows, little memory and small expansions change nothing (in this process)."""
    kept = divergence.shares(np.array([0, 3, 10**12]), np.array([10, 10, 10**15]))
    assert kept.tolist() == [1 + 10**9 // 10, 1 + 4 * 10**9 // 10, 1 + 10**9 * (10**12 + 1) // 10**15]
    monkeypatch.setattr(divergence, "PAIRS", 3)
    size = np.array([2, 0, 5, 1, 1])
    items = [(int(i), int(k)) for a, b in divergence._expand(size) for i, k in zip(a, b)]
    assert items == [(i, k) for i, n in enumerate(size) for k in range(n)]
    sums = divergence._Sums(4)
    rng, want = random.Random(1), Counter()
    given = Counter()
    for _ in range(50):
        keys = np.array([rng.randrange(9) for _ in range(6)])
        values = np.array([rng.randrange(-5, 10**15) for _ in range(6)])
        for k, x in zip(keys.tolist(), values.tolist()):
            want[k] += x
        sums.add(keys, values)
        if sums.full():
            for k, x in zip(*map(np.ndarray.tolist, sums.take())):
                given[k] += x
    if sums.held:
        for k, x in zip(*map(np.ndarray.tolist, sums.take())):
            given[k] += x
    assert given == want


def test_terms_of_bytes():
    texts = ["AbÉc9x [y] 中\x00z", "", "@A`z{", "   "]
    rows, coded = divergence.terms(pa.array(texts).slice(0))
    assert [(int(r), x) for r, x in zip(rows, coded.to_pylist())] == [(k, x) for k, t in enumerate(texts) for x in split(t)]
    rows, coded = divergence.terms(pa.array(["junk", *texts]).slice(1))
    assert [(int(r), x) for r, x in zip(rows, coded.to_pylist())] == [(k, x) for k, t in enumerate(texts) for x in split(t)]


def test_odd_rows(spark):
    long = "ab cd ef " * 60_000
    rows = [(None, None, None), ("", "en", "a"), ("12 ;", "en", "b"), (long, "en", "a"), (long, "en", "a"), ("ab ab ab cd", "en", None), ("ab", "xx", "a"), (None, "yy", "only")]
    rows += [("Zz yy", "de", "a")] * 3
    assert got(frame(spark, rows)) == plain(rows)
    assert [r for r in plain(rows) if r[0] == "xx"] == [] and ("en", "b", "pair", "a") in {r[:4] for r in plain(rows)}
    assert got(frame(spark, [])) == [] and got(frame(spark, [(None, None, None)])) == []


def test_query_beside_sql(spark):
    out = divergence.source_divergence(spark.read.parquet(f"{SF}/documents.parquet"))
    result = connect(SF).execute(ORACLE["op13_source_divergence"])
    assert differences([tuple(r) for r in out.collect()], out.columns, result.fetchall(), [d[0] for d in result.description]) == ""
