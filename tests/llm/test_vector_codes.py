"""Codebooks over cover trees beside plain Lloyd rounds."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from pairloom.llm import vector_codes as vc

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, width string"


def plain(rows, parts=vc.PARTS, entries=vc.ENTRIES, rounds=vc.ROUNDS):
    """The contract, one vector after the other, in Python's whole numbers."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    cut = [[v[k * w : k * w + w] for k in range(parts)] for _, v, _ in kept]
    books = [[list(c[k]) for c in cut[:entries]] for k in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            members = {}
            for c in cut:
                members.setdefault(near(c[k], books[k])[1], []).append(c[k])
            for j, own in members.items():
                books[k][j] = [sum(x) // len(own) for x in zip(*own)]
    found = [[near(c[k], books[k]) for k in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{j:02x}" for _, j in f), e, by_label[label], digest) for (i, _, label), f, e in zip(kept, found, errors)]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r))


def clustered(rng, n, width, spread):
    centres = rng.integers(-400, 400, (12, width))
    return centres[rng.integers(12, size=n)] + rng.integers(-spread, spread + 1, (n, width))


@pytest.mark.parametrize("n, width, spread", [(1, 4, 3), (17, 1, 0), (300, 4, 40), (4000, 4, 4), (3000, 2, 500), (2000, 9, 200)])
def test_tree_covers_and_separates(n, width, spread):
    points = clustered(np.random.default_rng(n), n, width, spread)
    tree = vc.cover_tree(points)
    assert sorted(tree.order.tolist()) == list(range(n)) and (tree.start[0], tree.end[0]) == (0, n)
    for k in range(len(tree.start)):
        own = tree.order[tree.start[k] : tree.end[k]]
        assert ((points[own] - points[tree.centre[k]]) ** 2).sum(1).max() == tree.square[k]
        assert tree.centre[k] in own
        below = range(tree.child[k], tree.child[k] + tree.children[k])
        if below:
            assert [tree.start[c] for c in below] + [tree.end[k]] == [tree.start[k]] + [tree.end[c] for c in below]
            assert tree.centre[below[0]] == tree.centre[k]
            assert all(4 * tree.square[c] <= tree.square[k] for c in below[: vc.WIDEST])
            centres = points[[tree.centre[c] for c in below[: vc.WIDEST]]]
            apart = ((centres[:, None] - centres[None]) ** 2).sum(2) + np.eye(len(centres), dtype=int) * 10**9
            assert 4 * apart.min() > tree.square[k] - 4
        else:
            assert len(own) <= vc.LEAF or tree.square[k] == 0


@pytest.mark.parametrize("seed", range(12))
def test_assignment_beside_all_distances(seed):
    rng = np.random.default_rng(seed)
    points = clustered(rng, 3000, 4, (2, 30, 300)[seed % 3])
    book = points[rng.integers(len(points), size=64)] + rng.integers(-2, 3, (64, 4)) * (seed % 2)  # equal entries where the seed is even
    tree = vc._unpack(vc._pack(vc.cover_tree(points)))
    sums, counts, labels, single = vc.assign(tree, points, book)
    squares = ((points[:, None] - book[None]) ** 2).sum(2)
    assert (labels == squares.argmin(1)).all()
    assert (counts == np.bincount(labels, minlength=64)).all()
    assert all((sums[j] == points[labels == j].sum(0)).all() for j in range(64))
    assert single < len(points)


def test_whole_subtrees_spare_comparisons():
    """Far clusters are assigned without a look at their points; large values take the exact path."""
    rng = np.random.default_rng(2)
    points = clustered(rng, 20_000, 4, 3) * 1000
    book = np.unique(points, axis=0)[::500][:64]
    tree = vc.cover_tree(points)
    _, counts, labels, single = vc.assign(tree, points, np.array([points[0], points[0] + 10**7]))
    assert single == 0 and counts.tolist() == [20_000, 0]
    big = points * 100
    labels = vc.assign(vc.cover_tree(big), big, book * 100)[2]
    assert (labels == ((big[:, None] - book[None] * 100) ** 2).sum(2).argmin(1)).all()


def test_high_dimensions_and_deep_chains():
    rng = np.random.default_rng(3)
    for points in (rng.integers(-90, 90, (1500, 64)), np.stack([2 ** (np.arange(600) % 26), np.zeros(600, np.int64)], 1)):
        book = points[:20]
        labels = vc.assign(vc.cover_tree(points), points, book)[2]
        assert (labels == ((points[:, None] - book[None]) ** 2).sum(2).argmin(1)).all()


def table(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


def test_whole_table_beside_plain_rounds(spark, monkeypatch):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark).collect()]
    want = ordered(plain(rows))
    assert ordered(vc.vector_codes(table(spark)).collect()) == want
    other = table(spark).repartition(7)
    assert ordered(vc.vector_codes(other).collect()) == want


def test_blocks_of_any_size(spark, monkeypatch):
    rng = random.Random(1)
    vectors = [[rng.gauss(0, 0.3) for _ in range(8)] for _ in range(700)]
    rows = [(rng.randrange(10**6), np.float32(v).tolist(), rng.choice([1, 2, None])) for v in vectors]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = vc.vector_codes(df, parts=4, entries=16, rounds=3).collect()
    assert ordered(got) == ordered(plain(rows, 4, 16, 3))


def test_odd_rows(spark):
    rng = random.Random(2)
    make = lambda: np.float32([rng.gauss(0, 0.2) for _ in range(32)]).tolist()
    same = make()
    rows = [(k, make(), k % 3) for k in range(90)]
    rows += [(5, same, None), (5, same, 1), (5, make(), 1), (None, make(), 2), (None, same, None), (None, None, None)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [float("nan")] * 32, 1), (1003, [float("inf")] + [0.0] * 31, 1), (1004, [None] + [0.0] * 31, 1)]
    rows += [(-7, [0.0] * 16, 1), (-8, [0.5] * 31, 1), (1006, same, 1), (1006, same, 1)]
    df = spark.createDataFrame([(i, v, lab, "a", "b", "c") for i, v, lab in rows], SCHEMA)
    want = plain([r for r in rows if r[1] is None or len(r[1]) == 32])
    got = vc.vector_codes(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert ordered(got.collect()) == ordered(want) and len(want) == 97
    assert ordered(vc.vector_codes(df.where("vec_id < 3")).collect()) == ordered(plain([r for r in rows if r[0] is not None and 0 <= r[0] < 3]))
    for nothing in (df.where("vec_id = 1000"), df.where("vec_id = 1001"), df.limit(0)):
        assert vc.vector_codes(nothing).collect() == []
    with pytest.raises(Exception, match="64 bits"):
        vc.vector_codes(spark.createDataFrame([(1, [1e30] * 16, 1)], "vec_id long, embedding array<float>, label int"))
