"""Token counts of a unigram vocabulary without tokenising: an automaton enumerates matches, a best path carries its length."""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.words import SPACES, column

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Stands for the space before a word.
SPACE = "▁"
#: An unknown character scores so much less than the least piece.
UNKNOWN_PENALTY = 10.0
#: Words whose counts a task remembers; beyond it, it starts anew.
REMEMBERED = 500_000


def load_pieces(file: str) -> list[tuple[str, float]]:
    """Pieces with their scores; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=file)
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [(model.id_to_piece(k), float(model.get_score(k))) for k in range(model.get_piece_size()) if not any(f(k) for f in special)]


class Counter:
    """Piece counts of words by the best path, as a unigram tokenizer finds it.

    Ties as there: of paths to a place that score the same, the one whose last
    piece begins first is kept. A character that is no piece is unknown;
    neighbouring unknown characters are one token.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.seen: dict[str, tuple[int, float]] = {}

    def word(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best path over a whole text without breaks."""
        n = len(text)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if len(self.automaton):
            for last, found in self.automaton.iter(text):
                matches[last].append(found)
        score, count, open_ = [0.0] + [-math.inf] * n, [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            best, at, plain = -math.inf, 0, True
            for length, s in sorted(matches[end - 1], reverse=True):
                value = score[end - length] + s
                if value > best:
                    best, at, plain = value, end - length, True
            if text[end - 1] not in self.single and score[end - 1] + self.unknown > best:
                best, at, plain = score[end - 1] + self.unknown, end - 1, False
            score[end], open_[end] = best, not plain
            count[end] = count[at] + (1 if plain or not open_[at] else 0)
        return count[n], score[n]

    def remembered(self, word: str) -> tuple[int, float]:
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            found = self.seen[word] = self.word(SPACE + word)
        return found


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokens of every row of ``docs`` (doc_id and text are read) under the vocabulary file.

    Words are runs of characters other than space and \\x09 to \\x0D; each is
    counted with a space mark before it, and pieces don't reach over words.
    Returns doc_id, n_words, n_tokens and score (of all best paths). Null or
    empty texts have none. Repeated rows get equal rows; null ids stay. The
    driver reads the vocabulary once and broadcasts it; each different word of a
    batch is solved once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for whole in batches:
            counter = counter or Counter(shared.value)
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                lists = pc.ascii_split_whitespace(pc.ascii_trim(pc.fill_null(column(batch, "text"), ""), characters=SPACES))
                flat = pc.list_flatten(lists)
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
                coded = flat.dictionary_encode()
                coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
                each = [counter.remembered(w) if w else (0, 0.0) for w in coded.dictionary.to_pylist()]
                sums = []
                for values in ([1 if w else 0 for w in coded.dictionary.to_pylist()], [n for n, _ in each], [s for _, s in each]):
                    own = np.array(values, np.float64)[coded.indices.to_numpy()] if len(each) else np.empty(0)
                    total = np.concatenate([[0.0], np.cumsum(own)])
                    sums.append(total[ends[1:]] - total[ends[:-1]])
                yield pa.RecordBatch.from_arrays([
                    column(batch, "doc_id"), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2])],
                    ["doc_id", "n_words", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_words long, n_tokens long, score double")
