"""Encoding and decoding with a merge-type piece model, exactly as its library does, by backtracking instead of merging.

An automaton names the pieces that start at each place. Longest first, a piece
is taken where merging it anew together with the piece before it leaves both
as they are; the only such chain over a text is what merging the whole text
gives. Places that no piece leads on from are remembered as bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.words import column

SPACE = "▁"
UNKNOWN_SURFACE = " ⁇ "
#: Words, runs and pairs of pieces that a Python worker remembers each; beyond it, it starts anew.
REMEMBERED = 300_000
#: Longer words are not remembered.
REMEMBERED_CHARS = 64
#: Characters of a text that are cut into words at once, and of a word that are searched for pieces at once.
SCAN, WINDOW = 1 << 20, 1 << 12
#: Numbers from here on are characters that are no piece; a pair of numbers is one by this factor.
ALONE, TOGETHER = 1 << 21, 1 << 22
_ROWS = 256


@dataclass(frozen=True)
class PieceModel:
    """``scores`` and ``ids`` of the pieces that merging can form; ``byte_ids`` by byte; ``surfaces`` by id (None: a byte)."""

    scores: dict[str, float]
    ids: dict[str, int]
    byte_ids: list[int]
    begin: int
    end: int
    surfaces: list[bytes | None]
    silent: frozenset[int]


def load_model(file: str) -> PieceModel:
    """The model of a file, which must be of the merge type, with bytes for unknown characters and texts left as they are.

    Any other normalisation, pieces that are off, or missing bytes are a ValueError.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=file)
    every = range(model.get_piece_size())
    if model.normalize(" a  Ａ́ ") != "▁▁a▁▁Ａ́▁" or any(map(model.is_unused, every)):
        raise ValueError(f"{file}: only models that keep texts as they are, with one space before them, are supported")
    byte_ids = {int(model.id_to_piece(k)[1:-1], 16): k for k in every if model.is_byte(k)}
    if len(byte_ids) != 256:
        raise ValueError(f"{file}: pieces for all bytes are needed")
    normal = [k for k in every if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))]
    surfaces: list[bytes | None] = [None if model.is_byte(k) else b"" for k in every]
    for k in every:
        if model.is_unknown(k):
            surfaces[k] = UNKNOWN_SURFACE.encode()
    for k in normal:
        surfaces[k] = model.id_to_piece(k).replace(SPACE, " ").encode()
    return PieceModel(
        {model.id_to_piece(k): model.get_score(k) for k in normal}, {model.id_to_piece(k): k for k in normal},
        [byte_ids[b] for b in range(256)], model.bos_id(), model.eos_id(), surfaces,
        frozenset(k for k in every if model.is_control(k)))


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def merged(scores: dict[str, float], text: str, border: int = 0) -> list[str] | None:
    """What merging makes of a short text: best neighbours first, of equals the leftmost.

    None as soon as a merge would reach over the place ``border``.
    """
    parts = list(text)
    while True:
        best, at = None, 0
        for k in range(len(parts) - 1):
            score = scores.get(parts[k] + parts[k + 1])
            if score is not None and (best is None or score > best):
                best, at = score, k
        if best is None:
            return parts
        if at + 1 == border:
            return None
        border -= at + 1 < border
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Encoder:
    """Ids of texts under a model.

    Two neighbouring characters that stand together in no piece are never
    merged, so texts fall into words at spaces, and words into runs; each is
    solved by itself.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        names = [p for p in model.scores if len(p) == 1 or merged(model.scores, p) == [p]]
        self.names = dict(enumerate(names))
        self.packed = {k: _packed([model.ids[p]]) for k, p in enumerate(names)}
        self.longest = max(map(len, names), default=1)
        self.automaton = ahocorasick.Automaton()
        for k, p in enumerate(names):
            self.automaton.add_word(p, (len(p), k))
        self.automaton.make_automaton()
        self.together = {p[k : k + 2] for p in names for k in range(len(p) - 1)}
        inner = any(x[1] == SPACE != x[0] for x in self.together)
        #: Where some piece has a space after another character, a text is one word.
        self.words = re.compile("(?s).+" if inner else f"{SPACE}+[^{SPACE}]*")
        self.cuts = None if inner else re.compile(f"[^{SPACE}]{SPACE}")
        self.apart: dict[int, bool] = {}
        self.runs: dict[str, bytes] = {}
        self.seen: dict[str, bytes] = {}

    def _starts(self, run: str, low: int) -> list[list[tuple[int, int]]]:
        """For each place of the window from ``low`` on: length and number of the pieces that start there, shortest first.

        A character that is no piece stands for itself.
        """
        part = run[low : low + WINDOW + self.longest - 1] if len(run) > WINDOW else run
        found: list[list[tuple[int, int]]] = [[] for _ in part]
        for last, piece in self.automaton.iter(part):
            found[last + 1 - piece[0]].append(piece)
        for k, own in enumerate(found):
            if not own or own[0][0] > 1:
                own.insert(0, (1, ALONE + ord(part[k])))
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging both together leaves the two pieces."""
        a, b = (self.names.get(k) or chr(k - ALONE) for k in (left, right))
        return merged(self.model.scores, a + b, len(a)) is not None

    def pieces(self, run: str) -> list[int]:
        """The numbers of the pieces of a run.

        A chain of compatible pieces over the start of a run is the only one,
        so a place that doesn't lead on fails for good, and each place is
        entered once.
        """
        n, low, starts = len(run), 0, self._starts(run, 0)
        chain: list[int] = []
        untried: list[list[tuple[int, int]]] = []
        failed, apart = bytearray(n // 8 + 1), self.apart
        at, options = 0, starts[0] if n else []
        while at < n:
            while options:
                length, piece = options.pop()
                end = at + length
                if failed[end >> 3] >> (end & 7) & 1:
                    continue
                if chain:
                    key = chain[-1] * TOGETHER + piece
                    free = apart.get(key)
                    if free is None:
                        if len(apart) >= REMEMBERED:
                            apart.clear()
                        free = apart[key] = self.compatible(chain[-1], piece)
                    if not free:
                        continue
                chain.append(piece)
                untried.append(options)
                at = end
                if at < n:
                    if not low <= at < low + WINDOW:
                        low = at - at % WINDOW
                        starts = self._starts(run, low)
                    options = starts[at - low]
                break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                last = chain.pop()
                at -= len(self.names[last]) if last < ALONE else 1
                options = untried.pop()
        return chain

    def _run(self, run: str) -> bytes:
        found = self.runs.get(run)
        if found is None:
            packed, out = self.packed, []
            for k in self.pieces(run):
                if k >= ALONE and k not in packed:
                    packed[k] = _packed([self.model.byte_ids[b] for b in chr(k - ALONE).encode("utf-8")])
                out.append(packed[k])
            found = b"".join(out)
            if len(run) <= REMEMBERED_CHARS:
                if len(self.runs) >= REMEMBERED:
                    self.runs.clear()
                self.runs[run] = found
        return found

    def word(self, word: str) -> bytes:
        """The ids of a word as little-endian 32-bit numbers."""
        found = self.seen.get(word)
        if found is None:
            together, start, out = self.together, 0, []
            for k in range(1, len(word)):
                if word[k - 1 : k + 1] not in together:
                    out.append(self._run(word[start:k]))
                    start = k
            out.append(self._run(word[start:]))
            found = b"".join(out)
            if len(word) <= REMEMBERED_CHARS:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[word] = found
        return found

    def _parts(self, text: str) -> Iterator[str]:
        """A text in parts that begin where a word does."""
        low = 0
        while self.cuts and len(text) - low > SCAN:
            cut = self.cuts.search(text, low + SCAN)
            if cut is None:
                break
            yield text[low : cut.start() + 1]
            low = cut.start() + 1
        yield text[low:]

    def text(self, text: str) -> bytes:
        """The ids of a text, between begin and end."""
        out = [_packed([self.model.begin])]
        if text:
            get, word = self.seen.get, self.word
            for part in self._parts(SPACE + text.replace(" ", SPACE)):
                out.append(b"".join([get(w) or word(w) for w in self.words.findall(part)]))
        out.append(_packed([self.model.end]))
        return b"".join(out)


_last: list = []


def _encoder(model: PieceModel) -> Encoder:
    """The encoder of this worker, kept while tasks of one job follow one another."""
    if not _last or _last[0] is not model:
        _last[:] = [model, Encoder(model)]
    return _last[1]


class Decoder:
    """Texts of ids: spaces for their mark, bytes put together, control ids left out, the space before the text taken away."""

    def __init__(self, model: PieceModel):
        self.model = model
        raw = {k: bytes([b]) for b, k in enumerate(model.byte_ids)}
        self.raw = [raw.get(k, s) for k, s in enumerate(model.surfaces)]
        self.normal = [s is not None and s != UNKNOWN_SURFACE.encode() for s in model.surfaces]

    def text(self, array: np.ndarray) -> str:
        """Bytes in a row that are no character become U+FFFD each. An id beyond the model is an IndexError."""
        silent, ids = self.model.silent, array.tolist()
        first = next((k for k, i in enumerate(ids) if i not in silent), None)
        if first is None:
            return ""
        joined = b"".join([self.raw[i] for i in ids])
        drop = int(self.normal[ids[first]] and joined[:1] == b" ")
        if not any((array[1:-1] == i).any() for i in silent):  # a control id between bytes ends their row
            try:
                return joined[drop:].decode("utf-8")
            except UnicodeDecodeError:
                pass
        return self._broken(ids)[drop:]

    def _broken(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in [*ids, None]:
            surface = None if i is None else self.model.surfaces[i]
            if i is not None and surface is None:
                run += self.raw[i]
                continue
            at = 0
            while at < len(run):
                for width in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + width].decode("utf-8"))
                        at += width
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    at += 1
            run.clear()
            out.append((surface or b"").decode("utf-8"))
        return "".join(out)


def encode_texts(docs: DataFrame, file: str) -> DataFrame:
    """Ids of every row of ``docs`` (doc_id and text are read) under the piece model of ``file``, with begin and end.

    Returns doc_id, n_tokens and ids, little-endian unsigned 32-bit numbers in
    one binary value. Null texts are as empty ones: begin and end. Repeated rows
    get equal rows; null ids stay; other columns are not read; an empty table
    gives an empty result. The driver reads the file and broadcasts its pieces.
    A word of any length is searched in windows; each different word of up to 64
    characters is solved once a worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_model(file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for whole in batches:
            for at in range(0, len(whole), _ROWS):
                batch = whole.slice(at, _ROWS)
                ids = [encoder.text(t or "") for t in column(batch, "text").to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    column(batch, "doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids binary")


def decode_ids(rows: DataFrame, file: str) -> DataFrame:
    """The rows with their ``ids`` (as ``encode_texts`` gives them) replaced by ``decoded``, the text that they stand for.

    Null ids are a null text. A number of bytes that four doesn't divide, or an
    id beyond the model, is an error. Other columns stay, whatever their names.
    """
    shared = rows.sparkSession.sparkContext.broadcast(load_model(file))
    kept = [f for f in rows.schema.fields if f.name not in ("ids", "decoded")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for whole in batches:
            for at in range(0, len(whole), _ROWS):
                batch = whole.slice(at, _ROWS)
                texts = [None if x is None else decoder.text(np.frombuffer(x, "<u4")) for x in column(batch, "ids").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(column(batch, f.name) for f in kept), pa.array(texts, pa.string())], [*(f.name for f in kept), "decoded"])

    return rows.select(*(f"`{f.name}`" for f in kept), "ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, file: str) -> DataFrame:
    """Digests of the ids of every row and of the text that they decode to: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    encoded = encode_texts(docs, file).withColumn("ids_sha256", F.sha2("ids", 256))
    return decode_ids(encoded, file).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
