"""Context-tree weighting over bytes: counts of a corpus, mixed over all context depths, give the code length of texts.

A byte is eight binary decisions. In each context of 0 to 5 bytes each decision
has a Krichevsky-Trofimov estimate; a node's weighted probability is half its
own estimate and half the product of its children's. These depend on counts
only, so any order of the corpus and any split over tasks gives the same tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.words import column, plain_texts
from pairloom.sources.tables import stage

DEPTH = 5
HELD_OUT, FOLDS = 2, 7
#: Bytes of text that one task holds and asks for at once.
BLOCK_BYTES = 5 << 20
#: Parts of the tree: one for so many bytes of text, in these limits.
PART_BYTES, LEAST_PARTS, MOST_PARTS = 16 << 20, 8, 4096
END = "\n"
_U = np.uint64
_BLOCK = "block long, doc_ids array<long>, held array<boolean>, tokens array<long>, text binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as words with single spaces and an end, in blocks."""
    part, n, size = TaskContext.get().partitionId(), 0, 0
    ids: list = []
    held: list = []
    tokens: list[int] = []
    texts: list[str] = []

    def block() -> pa.RecordBatch:
        packed = zstandard.compress("".join(texts).encode("utf-8", "surrogatepass"), 3)
        return pa.RecordBatch.from_arrays([
            pa.array([part << 32 | n], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())),
            pa.array([tokens], pa.list_(pa.int64())), pa.array([packed], pa.binary())], ["block", "doc_ids", "held", "tokens", "text"])

    for whole in batches:
        for at in range(0, len(whole), 256):
            batch = whole.slice(at, 256)
            for doc, out, text, count in zip(
                column(batch, "doc_id").to_pylist(), column(batch, "held").to_pylist(), *plain_texts(column(batch, "text"))
            ):
                ids.append(doc)
                held.append(out)
                tokens.append(count + 1)
                texts.append(text + END)
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield block()
                    ids, held, tokens, texts = [], [], [], []
                    n, size = n + 1, 0
    if texts:
        yield block()


class _Text:
    """The windows of a block: for each byte and end the five bytes before it and itself, as one number."""

    def __init__(self, packed: bytes):
        raw = np.frombuffer(zstandard.decompress(packed), np.uint8)
        self.raw = raw
        self.ends = np.flatnonzero(raw == ord(END)) + 1
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.keys = raw.astype(_U)
        for d in range(1, DEPTH + 1):
            before = np.full(len(raw), ord(END), np.uint8)
            before[d:] = raw[:-d]
            early = (self.starts[:, None] + np.arange(d)).ravel()
            before[early[early < np.repeat(self.ends, d)]] = ord(END)
            wide = before.astype(_U)
            wide <<= _U(8 * (DEPTH + 1 - d))
            self.keys |= wide

    def per_document(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts) if len(self.starts) else np.empty(0)

    def words(self) -> pa.DictionaryArray:
        """All tokens in order, the end of a text as a token of its own."""
        spaced = self.raw.tobytes().decode("utf-8", "surrogatepass").replace(END, " " + END + " ")
        flat = pc.list_flatten(pc.split_pattern(pa.array([spaced], pa.string()), " "))
        return flat.filter(pc.not_equal(flat, "")).dictionary_encode()


def _part(values: np.ndarray, parts: int) -> np.ndarray:
    return ((values * _U(0x9E3779B97F4A7C15)) >> _U(33)) % _U(parts)


def _word_parts(words: pa.Array, parts: int) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) % _U(parts)


def _grouped(parts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(parts, kind="stable")
    return order, np.searchsorted(parts[order], np.arange(n + 1))


def _pack(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes(), 3)


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), kind)


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=_U(0))


def _ask(parts: int):
    """For each block and part of the tree: its windows and words, with their counts in texts that are learnt from."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = {c: column(batch, c)[k].as_py() for c in ("block", "held", "text", "tokens")}
                text = _Text(row["text"])
                learnt = np.repeat(~np.array(row["held"], bool), text.ends - text.starts)
                keys, counts = np.unique(text.keys[learnt], return_counts=True)
                every = np.union1d(keys, text.keys[~learnt])
                own = np.zeros(len(every), np.int64)
                own[np.searchsorted(every, keys)] = counts
                coded = text.words()
                seen = np.repeat(~np.array(row["held"], bool), row["tokens"])
                times = np.bincount(coded.indices.to_numpy()[seen], minlength=len(coded.dictionary))
                order, cuts = _grouped(_part(every >> _U(8 * (DEPTH - 1)), parts), parts)
                word_order, word_cuts = _grouped(_word_parts(coded.dictionary, parts), parts)
                names = coded.dictionary.take(pa.array(word_order)).to_pylist()
                rows = [(
                    row["block"], p, _pack(_steps(every[order[cuts[p]:cuts[p + 1]]])), _pack(own[order[cuts[p]:cuts[p + 1]]].astype(np.int32)),
                    zstandard.compress(" ".join(names[word_cuts[p]:word_cuts[p + 1]]).encode("utf-8", "surrogatepass"), 3),
                    _pack(times[word_order[word_cuts[p]:word_cuts[p + 1]]].astype(np.int32)),
                ) for p in range(parts)]
                types = (pa.int64(), pa.int64(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["block", "part", "keys", "counts", "words", "times"])
    return run


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift = sum(np.log(x + k) for k in range(8))
    z = x + 8.0
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of ``a`` zeros and ``b`` ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - np.log(np.pi)


def _nodes(keys: np.ndarray) -> np.ndarray:
    """Of contexts followed by a byte: the nodes of the byte's eight decisions, ``len(keys) x 8``."""
    byte = keys & _U(255)
    return np.stack([(keys >> _U(8) << _U(8)) | _U(1 << k) | (byte >> _U(8 - k)) for k in range(8)], axis=1)


def _ones(keys: np.ndarray) -> np.ndarray:
    return np.stack([(keys >> _U(7 - k)) & _U(1) for k in range(8)], axis=1).astype(bool)


def _shorter(keys: np.ndarray, depth: int) -> np.ndarray:
    """Windows with a context of ``depth`` bytes instead of ``DEPTH``."""
    return (keys >> _U(8 * (DEPTH - depth + 1)) << _U(8)) | (keys & _U(255))


def parents(ids: np.ndarray) -> np.ndarray:
    return (ids >> _U(16) << _U(8)) | (ids & _U(255))


class Level:
    """All nodes of one depth: zeros, ones, own weight in the mix, own estimate of a one."""

    def __init__(self, ids: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray | None):
        self.ids, self.a, self.b = ids, a, b
        own = log_kt(a, b)
        self.log_pw = own if below is None else np.logaddexp(own, below) - np.log(2.0)
        self.weight = np.ones(len(ids)) if below is None else np.exp(np.minimum(0.0, own - np.log(2.0) - self.log_pw))
        self.one = (b + 0.5) / (a + b + 1.0)

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each parent: zeros, ones, and the logarithm of the product of the children's probabilities."""
        up, where = np.unique(parents(self.ids), return_inverse=True)
        return up, *(np.bincount(where, x, len(up)) for x in (self.a, self.b, self.log_pw))

    def mix(self, ids: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """Probability of a one at nodes ``ids``, given that of their children (NaN: none seen); NaN where the node is not seen."""
        if not len(self.ids):
            return np.full(ids.shape, np.nan)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        one, w = self.one[at], self.weight[at]
        mixed = np.where(np.isnan(deeper), one, w * one + (1 - w) * deeper)
        return np.where(self.ids[at] == ids, mixed, np.nan)


def subtree(keys: np.ndarray, counts: np.ndarray) -> list[Level]:
    """The levels of depth 5 to 2 over windows with counts."""
    keys, counts = keys[counts > 0], counts[counts > 0]
    ids, where = np.unique(_nodes(keys), return_inverse=True)
    ones, each = _ones(keys).ravel(), np.repeat(counts, 8).astype(np.float64)
    a, b = (np.bincount(where.ravel(), each * flag, len(ids)) for flag in (~ones, ones))
    levels = [Level(ids, a, b, None)]
    for _ in range(DEPTH - 2):
        levels.append(Level(*levels[-1].sums()))
    return levels


def _merge(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Windows of all blocks with their counts, and the windows of each block."""
    asked = [np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in rows["keys"]]
    every, where = np.unique(np.concatenate(asked), return_inverse=True)
    counts = np.bincount(where, np.concatenate([_unpack(x, np.int32) for x in rows["counts"]]), len(every))
    return every, counts, asked


def _merge_words(rows: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """Counts of all words of a part, and for each block the places of its words among them."""
    texts = [zstandard.decompress(x).decode("utf-8", "surrogatepass") for x in rows["words"]]
    lists = [x.split(" ") if x else [] for x in texts]
    coded = pa.array([w for own in lists for w in own], pa.string()).dictionary_encode()
    where = coded.indices.to_numpy()
    times = np.bincount(where, np.concatenate([_unpack(x, np.int32) for x in rows["times"]]), len(coded.dictionary))
    return times, np.split(where, np.cumsum([len(x) for x in lists])[:-1])


def _top(rows: pd.DataFrame) -> pd.DataFrame:
    keys, counts, _ = _merge(rows)
    up, a, b, below = subtree(keys, counts)[-1].sums()
    times, _ = _merge_words(rows)
    return pd.DataFrame({
        "id": np.append(up.astype(np.int64), -1), "a": np.append(a, times.sum()), "b": np.append(b, (times > 0).sum()), "below": np.append(below, 0.0)})


def _answers(top: tuple[Level, Level]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts, asked = _merge(rows)
        one = np.full((len(keys), 8), np.nan)
        for depth, level in zip(range(DEPTH, -1, -1), [*subtree(keys, counts), *top]):
            one = level.mix(_nodes(_shorter(keys, depth)), one)
        one = np.where(np.isnan(one), 0.5, one)
        logs = np.log10(np.where(_ones(keys), one, 1.0 - one)).sum(axis=1)
        times, places = _merge_words(rows)
        return pd.DataFrame({
            "block": rows["block"], "part": rows["part"],
            "logs": [_pack(logs[np.searchsorted(keys, own)].astype(np.float32)) for own in asked],
            "times": [_pack(times[own].astype(np.int64)) for own in places],
        })
    return run


def _scores(parts: int, train_tokens: int, train_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = {c: column(batch, c)[k].as_py() for c in ("doc_ids", "held", "tokens", "text", "found")}
                found = sorted(row["found"], key=lambda x: x["part"])
                text = _Text(row["text"])
                every = np.unique(text.keys)
                order, _ = _grouped(_part(every >> _U(8 * (DEPTH - 1)), parts), parts)
                logs = np.empty(len(every))
                logs[order] = np.concatenate([_unpack(x["logs"], np.float32) for x in found])
                score = text.per_document(logs[np.searchsorted(every, text.keys)])
                coded = text.words()
                word_order, _ = _grouped(_word_parts(coded.dictionary, parts), parts)
                times = np.empty(len(coded.dictionary), np.int64)
                times[word_order] = np.concatenate([_unpack(x["times"], np.int64) for x in found])
                own = times[coded.indices.to_numpy()]
                starts = np.concatenate([[0], np.cumsum(row["tokens"])[:-1]])
                known = np.add.reduceat((own > 0).astype(np.int64), starts)
                tokens = np.array(row["tokens"], np.int64)
                base = np.add.reduceat(np.log10(own + 1.0), starts) - tokens * np.log10(train_tokens + train_words + 1.0)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(tokens), pa.array(known),
                    pa.array(np.full(len(tokens), train_tokens, np.int64)), pa.array(base), pa.array(score),
                    pa.array(-score / np.log10(2.0) / (text.ends - text.starts))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])
    return run


def score_texts(docs: DataFrame) -> DataFrame:
    """Code length of every row of ``docs`` (doc_id and text are read) under a tree of all texts outside the held-out fold.

    A text is scored as its words, A-Z lower-cased, with single spaces and an
    end. Returns doc_id, held_out (crc32 of the id as text, mod 7, is 2), n_tokens
    and n_known (words and one end; those learnt), train_tokens, base_score (add-one
    unigrams), score (log10 probability under the tree) and bits_per_byte. Null
    and empty texts are an end only. A null id hashes as an empty text and is
    learnt from. Repeated rows are learnt from and scored each. A context that
    was never seen gives its parent's estimate; a decision never seen is even.
    An empty table gives an empty result.

    Blocks of texts ask parts of the tree for their different windows and get
    log probabilities back, so neither the counts nor the tree are ever in one
    place; only the nodes of depth 0 and 1, at most 65,280, reach the driver.
    """
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT
    rows = docs.select(F.col("doc_id").cast("long"), held.alias("held"), F.col("text").cast("string"))
    blocks = stage(rows.mapInArrow(_blocks, _BLOCK), "blocks")
    size = blocks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(LEAST_PARTS, min(MOST_PARTS, size * 3 // PART_BYTES))
    asked = stage(blocks.mapInArrow(
        _ask(parts), "block long, part long, keys binary, counts binary, words binary, times binary"), "asked")
    sums = asked.groupBy("part").applyInPandas(_top, "id long, a double, b double, below double")
    top = sums.groupBy("id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("below").alias("below")).orderBy("id").toPandas()
    tokens, words = (int(top[c][top.id == -1].sum()) for c in ("a", "b"))
    top = top[top.id >= 0]
    first = Level(top.id.to_numpy().astype(np.uint64), top.a.to_numpy(), top.b.to_numpy(), top.below.to_numpy())
    answers = asked.groupBy("part").applyInPandas(_answers((first, Level(*first.sums()))), "block long, part long, logs binary, times binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("part", "logs", "times")).alias("found"))
    return blocks.join(answers, "block").mapInArrow(
        _scores(parts, tokens, words), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
