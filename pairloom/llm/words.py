"""Words as the operators share them: runs of characters other than space and ``\\x09`` to ``\\x0D``."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: Column) -> Column:
    """The words of a text, as an array (null text: null)."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[\\x20\\x09-\\x0D]+"))


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.size(words(text))).cast("long")


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def lower_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Of a batch of texts, A-Z lower-cased: where each text's words begin and end, and all words in a row.

    A text that is null or has no words has none.
    """
    filled = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_trim(pc.ascii_lower(filled), characters=SPACES))
    flat = pc.list_flatten(lists)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not real.all():
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        flat = flat.filter(pa.array(real))
    return ends.astype(np.int64), flat


def plain_texts(texts: pa.Array) -> tuple[list[str], list[int]]:
    """Each text as its words, A-Z lower-cased, with single spaces; and the number of words."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim(pc.ascii_lower(pc.fill_null(texts, "")), characters=SPACES))
    joined = pc.binary_join(lists, " ").to_pylist()
    return joined, [n if t else 0 for t, n in zip(joined, pc.list_value_length(lists).to_pylist())]


def word_hashes(flat: pa.Array) -> np.ndarray:
    """64 bits for each word."""
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    if not len(coded):
        return np.empty(0, np.uint64)
    each = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    return each[coded.indices.to_numpy()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """64 bits for each run of ``width`` neighbouring words, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = mix(out + _MIX) + hashes[k : k + n]
    return mix(out)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted set of word shingles of each text, as 64-bit hashes.

    With fewer words than ``width`` the whole sequence is one shingle; a text
    without words has none.
    """
    ends, flat = lower_words(texts)
    hashes = word_hashes(flat)
    every = runs(hashes, width)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(every[a : b - width + 1]))
        else:
            out.append(runs(hashes[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out
