"""Benchmark items inside documents, up to a share of edits: exact pieces find places, bit-parallel distances decide."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.words import column, plain_texts

#: One edit for so many characters of an item.
CHARS_PER_EDIT = 20
#: Shorter items have no edits and are found as whole words only.
WHOLE_WORDS_BELOW = 20
#: Characters of items that one pass over the documents looks for.
BLOCK_CHARS = 16 << 20


def normalised(texts: pa.Array) -> list[str]:
    """Words with A-Z lower-cased and one space between them."""
    return plain_texts(texts)[0]


def budget(chars: int) -> int:
    return chars // CHARS_PER_EDIT


def pieces(text: str) -> list[tuple[int, str]]:
    """One piece more than there may be edits, with their places: an occurrence leaves at least one of them whole."""
    n = budget(len(text)) + 1
    cuts = [len(text) * k // n for k in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << k
    return out


def best_match(at: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The least edit distance of a pattern of ``m`` characters to any part of ``text``, and where that part first ends.

    One column of the distance table is two whole numbers, the steps up and
    down; each character of the text takes a few operations on them.
    """
    every, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = every, 0, m
    best, end = m, 0
    for k, c in enumerate(text, 1):
        eq = at.get(c, 0)
        vertical = eq | down
        diagonal = (((eq & up) + up) ^ up) | eq
        rise, fall = down | ~(diagonal | up) & every, up & diagonal
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
            if score < best:
                best, end = score, k
        rise, fall = rise << 1, fall << 1
        up, down = (fall | ~(vertical | rise)) & every, rise & vertical & every
    return best, end


class Finder:
    """All items of a block: an automaton of their pieces, and their masks."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, t, masks(t)) for i, t in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(items):
            for start, piece in pieces(text):
                places.setdefault(piece, []).append((k, start))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """For each item in the text: least distance, end of the first part that has it."""
        seen, out = set(), {}
        for last, (length, found) in self.automaton.iter(text):
            for k, start in found:
                begin = last + 1 - length - start
                if (k, begin) in seen:
                    continue
                seen.add((k, begin))
                _, item, at = self.items[k]
                if len(item) < WHOLE_WORDS_BELOW:
                    end = begin + len(item)
                    if text[begin - 1 : begin] in ("", " ") and text[end : end + 1] in ("", " "):
                        out[k] = min(out.get(k, (0, end)), (0, end))
                    continue
                edits = budget(len(item))
                left = max(0, begin - edits)
                best, end = best_match(at, len(item), text[left : begin + len(item) + edits])
                if best <= edits:
                    out[k] = min(out.get(k, (best, left + end)), (best, left + end))
        return out


def _search(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value) if shared.value else None
        for batch in batches if finder else ():
            rows = [
                (doc, finder.items[k][0], best, budget(len(finder.items[k][1])), end)
                for doc, text in zip(column(batch, "doc_id").to_pylist(), normalised(column(batch, "text")))
                for k, (best, end) in sorted(finder.find(text).items())
            ]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "distance", "budget", "found_end"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, item_id long, distance long, budget long, found_end long")


def contaminated(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Which items (item_id, text) occur in which documents (doc_id, text), with at most one edit for 20 characters.

    Both are compared as words with A-Z lower-cased and single spaces. Returns
    one row for each row of ``docs`` and item found in it: doc_id, item_id,
    distance, budget, found_end (in the normalised text). Items are taken in
    blocks of at most ``block_chars`` characters; each block is one pass over
    the documents. Items of fewer than 20 characters have no edits and must stand
    as whole words; null items and those without a word are found nowhere. A
    null or empty document holds nothing; null ids stay null; repeated items
    and documents are found once for each row.
    """
    known = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    chars = known.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    found = None
    for block in range(n):
        rows = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).collect()
        texts = normalised(pa.array([r.text for r in rows], pa.string()))
        kept = [(r.item_id, t) for r, t in zip(rows, texts) if t]
        part = _search(docs, kept)
        found = part if found is None else found.union(part)
    return found
