"""Codes of vectors by product codebooks, fitted in whole numbers by Lloyd's rounds over cover trees.

Each block of vectors holds a cover tree for each part of the vectors, built
once. In a round a whole subtree goes to one entry where the triangle inequality
leaves no other, its sums being differences of running sums; the points of
subtrees that stay ambiguous down to a leaf are compared one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.words import column
from pairloom.operators.joins import lookup_join
from pairloom.sources.tables import stage

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block; a place in a block takes 16 bits.
BLOCK = 1 << 15
#: Points of a leaf; children of a node besides that of all the rest; levels. What isn't split further is compared point by point.
LEAF, WIDEST, DEEPEST = 16, 32, 24
#: Components below this keep squared distances and their sums within 64 bits.
LARGEST = 1 << 27
_CHUNK = 1 << 13
_SLACK = 1e-9
_BLOCK = "block long, width int, vec_ids array<long>, labels array<string>, narrow boolean, vectors binary, trees array<binary>"


class CoverTree(NamedTuple):
    """Nodes by level, the root first. A node has the points ``start`` to ``end`` of ``order``, all within its radius around ``centre``.

    A node's first child has its own centre, every child a radius of at most
    half of the node's, and centres of siblings are farther apart than that;
    only the child of the rest, after ``WIDEST`` others, may be wider.
    """

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    centre: np.ndarray
    square: np.ndarray
    child: np.ndarray
    children: np.ndarray


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of each range, one range after the other."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(size.sum())


def cover_tree(points: np.ndarray) -> CoverTree:
    """The tree of the rows of ``points``, built level by level for all nodes at once."""
    order = np.arange(len(points))
    level = [np.array([0]), np.array([len(points)]), np.array([0]), ((points - points[:1]) ** 2).sum(1).max(keepdims=True)]
    done: list[list[np.ndarray]] = []
    total = 1
    while True:
        start, end, centre, square = level
        child, children = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        done.append([*level, child, children])
        split = np.flatnonzero((end - start > LEAF) & (square > 0))
        if not len(split) or len(done) > DEEPEST:
            break
        size = end[split] - start[split]
        at, node = _ranges(start[split], size), np.repeat(np.arange(len(split)), size)
        rank, far = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        centres = np.zeros((WIDEST + 1, len(split)), np.int64)
        left = np.arange(len(at))
        for k in range(WIDEST + 1):
            own = node[left]
            if k:
                first = np.flatnonzero(np.diff(own, prepend=-1))
                centres[k, own[first]] = order[at[left[first]]]
            else:
                centres[0] = centre[split]
            d = ((points[order[at[left]]] - points[centres[k, own]]) ** 2).sum(1)
            hit = (d <= square[split][own] // 4) | (k == WIDEST)
            rank[left[hit]], far[left[hit]] = k, d[hit]
            left = left[~hit]
            if not len(left):
                break
        key = node * (WIDEST + 1) + rank
        sort = np.argsort(key, kind="stable")
        order[at] = order[at[sort]]
        key = key[sort]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        children[split] = np.bincount(key[first] // (WIDEST + 1), minlength=len(split))
        child[split] = total + np.cumsum(children[split]) - children[split]
        total += len(first)
        ends = np.append(first[1:], len(at))
        level = [at[first], at[ends - 1] + 1, centres[key[first] % (WIDEST + 1), key[first] // (WIDEST + 1)], np.maximum.reduceat(far[sort], first)]
    return CoverTree(order, *(np.concatenate(x) for x in zip(*done)))


def _squares(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of points to entries, exact."""
    largest = max(int(np.abs(points).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * largest * largest * points.shape[1] >= 1 << 53:
        return sum((points[:, k, None] - book[None, :, k]) ** 2 for k in range(points.shape[1]))
    a, b = points.astype(np.float64), book.astype(np.float64)
    return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)


def assign(tree: CoverTree, points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each entry the sum and number of its points, for each point its entry, and how many points were compared one by one.

    The nearest entry counts, of equally near ones the first.
    """
    first = np.sort(np.unique(book, axis=0, return_index=True)[1])  # an entry equal to an earlier one gets nothing
    few, far = book[first], np.iinfo(np.int64).max
    sums, counts = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
    labels = np.zeros(len(points), np.int64)
    ordered = points[tree.order]
    running = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(ordered, axis=0)])
    single = 0
    stack = [(np.array([0]), np.ones((1, len(few)), bool))]
    while stack:
        nodes, open_ = stack.pop()
        if len(nodes) > _CHUNK:
            stack += [(nodes[_CHUNK:], open_[_CHUNK:])]
            nodes, open_ = nodes[:_CHUNK], open_[:_CHUNK]
        square = np.where(open_, _squares(points[tree.centre[nodes]], few), far)
        best = square.argmin(1)
        reach = np.sqrt(square.min(1)) + 2 * np.sqrt(tree.square[nodes].astype(np.float64))
        open_ &= np.sqrt(square) <= (reach * (1 + _SLACK) + _SLACK)[:, None]
        whole = (open_.sum(1) == 1) | (tree.square[nodes] == 0)
        own, entry = nodes[whole], first[best[whole]]
        start, end = tree.start[own], tree.end[own]
        np.add.at(sums, entry, running[end] - running[start])
        np.add.at(counts, entry, end - start)
        labels[tree.order[_ranges(start, end - start)]] = np.repeat(entry, end - start)
        inner = ~whole & (tree.children[nodes] > 0)
        if inner.any():
            size = tree.children[nodes[inner]]
            stack.append((_ranges(tree.child[nodes[inner]], size), np.repeat(open_[inner], size, axis=0)))
        leaf = ~whole & ~inner
        size = tree.end[nodes[leaf]] - tree.start[nodes[leaf]]
        rows, of = tree.order[_ranges(tree.start[nodes[leaf]], size)], np.repeat(np.flatnonzero(leaf), size)
        single += len(rows)
        for at in range(0, len(rows), _CHUNK):
            some = rows[at : at + _CHUNK]
            near = np.where(open_[of[at : at + _CHUNK]], _squares(points[some], few), far).argmin(1)
            labels[some] = first[near]
            np.add.at(sums, first[near], points[some])
            np.add.at(counts, first[near], 1)
    return sums, counts, labels, single


def _pack(tree: CoverTree) -> bytes:
    nodes = np.stack([tree.start, tree.end, tree.centre, tree.child, tree.children]).astype(np.int32)
    return np.array([len(tree.order), len(tree.start)], np.int32).tobytes() + tree.order.astype(np.uint16).tobytes() + nodes.tobytes() + tree.square.tobytes()


def _unpack(packed: bytes) -> CoverTree:
    n, m = np.frombuffer(packed, np.int32, 2)
    at = 8 + 2 * n
    start, end, centre, child, children = np.frombuffer(packed, np.int32, 5 * m, at).astype(np.int64).reshape(5, m)
    return CoverTree(
        np.frombuffer(packed, np.uint16, n, 8).astype(np.int64), start, end, centre,
        np.frombuffer(packed[at + 20 * m :], np.int64), child, children)


def _part(vectors: np.ndarray, k: int, parts: int) -> np.ndarray:
    width = vectors.shape[1] // parts
    return np.ascontiguousarray(vectors[:, k * width : (k + 1) * width])


def _blocks(parts: int):
    """Vectors as whole numbers in blocks of one width, with their trees."""
    def block(number: int, width: int, rows: list[tuple]) -> pa.RecordBatch:
        ids, labels, vectors = (x for x in zip(*rows))
        vectors = np.concatenate(vectors)
        narrow = bool(np.abs(vectors).max(initial=0) < 1 << 15)
        trees = [_pack(cover_tree(_part(vectors, k, parts))) for k in range(parts)]
        return pa.RecordBatch.from_arrays([
            pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()), pa.array([width], pa.int32()),
            pa.array([pa.concat_arrays(ids)], pa.list_(pa.int64())), pa.array([pa.concat_arrays(labels)], pa.list_(pa.string())),
            pa.array([narrow]), pa.array([vectors.astype(np.int16 if narrow else np.int32).tobytes()], pa.binary()),
            pa.array([trees], pa.list_(pa.binary()))], ["block", "width", "vec_ids", "labels", "narrow", "vectors", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        size: dict[int, int] = {}
        number = 0
        for whole in batches:
            for low in range(0, len(whole), BLOCK):
                batch = whole.slice(low, BLOCK)
                vectors = column(batch, "vector")
                widths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                for width in np.unique(widths[(widths > 0) & (widths % parts == 0)]).tolist():
                    rows = np.flatnonzero(widths == width)
                    values = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
                    good = np.isfinite(values).all(1)
                    values = np.floor(values[good] * SCALE)
                    if np.abs(values).max(initial=0) >= LARGEST:
                        raise ValueError(f"a component of {LARGEST // SCALE} or more: errors would not fit 64 bits")
                    rows, values = rows[good], values.astype(np.int64)
                    while len(rows):
                        n = min(len(rows), BLOCK - size.get(width, 0))
                        some = pa.array(rows[:n])
                        held.setdefault(width, []).append((column(batch, "vec_id").take(some), column(batch, "label").take(some), values[:n]))
                        size[width] = size.get(width, 0) + n
                        rows, values = rows[n:], values[n:]
                        if size[width] == BLOCK:
                            yield block(number, width, held.pop(width))
                            number, size[width] = number + 1, 0
        for width, rows in held.items():
            yield block(number, width, rows)
            number += 1
    return run


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The blocks of some batches, their vectors as rows of 64-bit numbers."""
    for batch in batches:
        for k in range(len(batch)):
            row = {f.name: batch.column(j)[k] for j, f in enumerate(batch.schema)}
            kind = np.int16 if row["narrow"].as_py() else np.int32
            row["vectors"] = np.frombuffer(row["vectors"].as_py(), kind).reshape(-1, row["width"].as_py()).astype(np.int64)
            yield row


def _first_vectors(blocks: DataFrame, n: int) -> list[list[int]]:
    """The vectors of the ``n`` smallest ids, null ids last, equal ids by their vectors.

    The ids alone name a bound first; only vectors of ids within it are sorted.
    """
    ids = blocks.select(F.explode("vec_ids").alias("vec_id")).where("vec_id is not null")
    found = stage(ids.orderBy("vec_id").limit(n), "least").agg(F.count("*").alias("n"), F.max("vec_id").alias("bound")).first()
    bound = found.bound if found.n == n else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            rows = [
                (i is None, i or 0, v.tolist()) for i, v in zip(row["vec_ids"].values.to_pylist(), row["vectors"])
                if bound is None or (i is not None and i <= bound)]
            rows = sorted(rows)[:n]
            yield pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in rows], pa.bool_()), pa.array([x[1] for x in rows], pa.int64()),
                pa.array([x[2] for x in rows], pa.list_(pa.int64()))], ["none", "vec_id", "vector"])

    rows = blocks.select("width", "vec_ids", "narrow", "vectors").mapInArrow(run, "none boolean, vec_id long, vector array<long>")
    least = stage(rows.orderBy("none", "vec_id", "vector").limit(n), "first")
    return [r.vector for r in least.orderBy("none", "vec_id", "vector").collect()]


def _sums(books: np.ndarray):
    """Of each block: sums and numbers of the points that go to each entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            out = []
            for k, tree in enumerate(row["trees"].values.to_pylist()):
                sums, counts, _, _ = assign(_unpack(tree), _part(row["vectors"], k, len(books)), books[k])
                out += [(k, e, int(counts[e]), sums[e].tolist()) for e in np.flatnonzero(counts).tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["part", "entry", "n", "sums"])
    return run


def _codes(books: np.ndarray):
    """Code and error of every vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            n = len(row["vectors"])
            codes, error = np.zeros((n, len(books)), np.uint8), np.zeros(n, np.int64)
            for k, tree in enumerate(row["trees"].values.to_pylist()):
                points = _part(row["vectors"], k, len(books))
                labels = assign(_unpack(tree), points, books[k])[2]
                codes[:, k] = labels
                error += ((points - books[k][labels]) ** 2).sum(1)
            text = codes.tobytes().hex()
            step = 2 * len(books)
            yield pa.RecordBatch.from_arrays([
                row["vec_ids"].values, row["labels"].values, pa.array([text[k : k + step] for k in range(0, len(text), step)], pa.string()),
                pa.array(error)], ["vec_id", "label", "code", "error"])
    return run


def vector_codes(
    vectors: DataFrame, vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """Codes of the rows of ``vectors`` (vec_id, ``vector`` and ``label`` are read), one entry of a codebook for each part.

    Components become floor(256 * x). Codebooks start as the parts of the
    vectors with the smallest ids (at most 256 ``entries``); each round assigns
    every part to its nearest entry, ties to the first, and replaces an entry by
    the floor of its parts' mean. Returns vec_id, code (two hex digits a part),
    error (squared distances summed), label_error (errors of the label summed)
    and codebooks_sha256.

    Rows whose vector is null or empty, has a null or non-finite component, or
    isn't as wide as most (of such widths as ``parts`` divides; of equally
    frequent ones the widest) are dropped; a component of 2 ** 19 or more is a
    ValueError. Repeated rows count each; null ids come last in the start, equal
    ids by their vectors; null labels are one label. With fewer rows than
    entries the codebooks are smaller; without rows the result is empty.

    The trees are written once. A round sends the sums of each block, at most
    ``entries`` rows a part; the driver holds the codebooks alone.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits, so at most 256 entries")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"))
    blocks = stage(rows.mapInArrow(_blocks(parts), _BLOCK), "trees")
    widths = blocks.groupBy("width").agg(F.sum(F.size("vec_ids")).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    blocks = blocks.where(F.col("width") == (widths.width if widths else 0))
    first = _first_vectors(blocks, entries) if widths else []
    books = np.array(first, np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2) if first else np.zeros((parts, 0, 0), np.int64)
    for _ in range(rounds if first else 0):
        found = blocks.select("width", "narrow", "vectors", "trees").mapInArrow(_sums(books), "part int, entry int, n long, sums array<long>")
        found = found.select("part", "entry", "n", F.posexplode("sums").alias("at", "sum")).groupBy("part", "entry", "at")
        found = found.agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
        books = books.copy()
        for r in found.collect():
            books[r.part, r.entry, r["at"]] = int(r["sum"]) // r["n"]
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = blocks.select("width", "vec_ids", "labels", "narrow", "vectors", "trees").mapInArrow(
        _codes(books), "vec_id long, label string, code string, error long")
    key = F.coalesce(F.concat(F.lit("s"), "label"), F.lit("n"))
    coded = stage(coded.select("vec_id", key.alias("key"), "code", "error"), "codes")
    sums = stage(coded.groupBy("key").agg(F.sum("error").alias("label_error")), "errors")
    return lookup_join(coded, sums, "key", "inner", "code").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
