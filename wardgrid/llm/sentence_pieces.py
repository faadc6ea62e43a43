"""SentencePiece encoding and decoding by a table of prefixes.

A BPE model merges the neighbouring symbols whose joined piece has the highest score, leftmost first. A sequence of pieces
is what it gives for a text exactly if each two neighbours stay apart when they are encoded alone: merges inside a piece
see nothing of what lies beyond its neighbours. So each prefix of a text has one last piece: the one among the
pieces that end there (matches of an Aho-Corasick automaton) which may follow the last piece of the prefix before it.
The table holds that piece for each prefix; ids are recovered from the end. The time grows with the length of the text.

Two pieces may follow each other if no merge crosses the boundary between them. Each piece has a trace: the score of each
merge that builds it, with the symbols at its two edges by then. Both traces are read in the order in which the model
would merge; the pair fails once the symbols on both sides of the boundary form a piece that comes before the next merge
of either. Answers are kept for the life of a Python worker, up to KEPT.

Pieces hold the space mark at their front only, so a text can be cut before each run of marks, and at signs that no piece
holds, and the ids of a word can be kept; a model where that does not hold is read text by text. Characters that no piece holds become their UTF-8 bytes.
Supported: BPE models with byte fallback whose text is not normalised (a dummy space in front, spaces as marks); others
are an error. Null texts are empty and give no ids. One row per row, whatever the ids of documents; no shuffle.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values of the model format
BPE = 2
KEPT = 500_000  # words and pairs kept in a worker
WORD_CHARS = 64  # longer words are not kept
BLOCK_CHARS = 2_000_000
NONE = float("-inf")


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a message in the protocol buffer wire format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[at : at + size]
            at += size


class _Words(dict):
    """Ids of words, found when they are first asked for."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, word: str) -> list[int]:
        ids = self.find(word)
        if len(word) <= WORD_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[word] = ids
        return ids


def _bad_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("one-by-one", _bad_byte)


class PieceModel:
    """Encodes and decodes as the model file says."""

    def __init__(self, model: bytes):
        import ahocorasick

        top = list(fields(model))
        trainer = dict(chain.from_iterable(fields(v) for n, v in top if n == 2))
        normal = dict(chain.from_iterable(fields(v) for n, v in top if n == 3))
        self.dummy_prefix = bool(normal.get(3, 1))
        if trainer.get(3, 1) != BPE or not trainer.get(35, 0) or trainer.get(24, 0) or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError("only BPE models with byte fallback and without normalisation are supported")
        pieces = [dict(fields(v)) for n, v in top if n == 1]
        self.texts = [p[1].decode() for p in pieces]
        kinds = [p.get(3, NORMAL) for p in pieces]
        if set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        scores = [struct.unpack("<f", p.get(2, bytes(4)))[0] for p in pieces]
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, kinds, strict=True)) if k == NORMAL}
        self.score = {t: scores[i] for t, i in self.ids.items()}
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, kinds, strict=True)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.control = {i for i, k in enumerate(kinds) if k == CONTROL}
        surface = trainer.get(44, " ⁇ ".encode()).decode()
        self.shown = [surface if k == UNKNOWN else "" if k == CONTROL else t.replace(MARK, " ") for t, k in zip(self.texts, kinds, strict=True)]
        self.is_byte = np.array([k == BYTE for k in kinds])
        # characters inside pieces that are no piece themselves get numbers of their own, after all ids
        for c in sorted(set("".join(self.ids)) - set(self.ids)):
            self.ids[c] = len(self.texts)
            self.texts.append(c)
        self.sizes = [len(t) for t in self.texts]
        self.n_ids = len(kinds)
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        # words end before a run of marks and at the signs that no piece holds
        lost = "".join(re.escape(c) for c in map(chr, range(128)) if c not in self.ids)
        self.cut = None if any(MARK in t.lstrip(MARK) for t in self.ids) else re.compile(f"{MARK}+[^{MARK}{lost}]*|[{lost}]+|[^{MARK}{lost}]+")
        self.traces: dict[int, list[tuple[float, str, str]] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.words = _Words(self._ids_of)

    def _trace(self, token: int) -> list[tuple[float, str, str]] | None:
        """(score of the next merge, first symbol, last symbol) at each step; None if the text is not merged into the piece."""
        if token not in self.traces:
            symbols, steps = list(self.texts[token]), []
            while True:
                joined = [self.score.get(a + b, NONE) for a, b in zip(symbols, symbols[1:], strict=False)]
                best = max(joined, default=NONE)
                steps.append((best, symbols[0], symbols[-1]))
                if best == NONE:
                    break
                i = joined.index(best)
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            self.traces[token] = steps if len(symbols) == 1 else None
        return self.traces[token]

    def may_follow(self, before: int, token: int) -> bool:
        """Whether the two pieces stay as they are when their joined text is encoded."""
        left, right = self._trace(before), self._trace(token)
        if left is None or right is None:
            return False
        i = j = 0
        while True:
            (own, _, a), (other, b, _) = left[i], right[j]
            across = self.score.get(a + b)
            if across is not None and across > own and across >= other:
                return False
            if own == other == NONE:
                return True
            if own >= other:
                i += 1
            else:
                j += 1

    def _ids_of(self, text: str) -> list[int]:
        """Ids of a text with marks, by the table of its prefixes."""
        last = [-1] * (len(text) + 1)  # -1: a character that no piece holds
        sizes, pairs, width = self.sizes, self.pairs, len(self.texts)
        for end, token in self.automaton.iter(text):
            if last[end + 1] < 0:
                start = end + 1 - sizes[token]
                before = last[start] if start else -1
                if before < 0:
                    fits = self._trace(token) is not None
                else:
                    key = before * width + token
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) >= KEPT:
                            pairs.clear()
                        fits = pairs[key] = self.may_follow(before, token)
                if fits:
                    last[end + 1] = token
        found, at = [], len(text)
        while at:
            token = last[at]
            if 0 <= token < self.n_ids:
                found.append(token)
                at -= sizes[token]
            else:
                found.extend(self.bytes[b] for b in reversed(text[at - 1].encode()))
                at -= 1
        return found[::-1]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        marked = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        if self.cut is None:
            return self._ids_of(marked)
        return list(chain.from_iterable(map(self.words.__getitem__, self.cut.findall(marked))))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: marks are spaces again, the dummy space is taken off, bytes that are no UTF-8 become U+FFFD."""
        some = ids.tolist()
        at = next((k for k, i in enumerate(some) if i not in self.control), len(some))
        some = some[at:]
        if not some:
            return ""
        front = self.dummy_prefix and not self.is_byte[some[0]] and self.texts[some[0]].startswith(MARK)
        if not self.is_byte[ids].any():
            text = "".join(map(self.shown.__getitem__, some))
        else:
            parts, run = [], bytearray()
            for i in some:
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                else:
                    if run:
                        parts.append(run.decode(errors="one-by-one"))
                        run = bytearray()
                    parts.append(self.shown[i])
            parts.append(run.decode(errors="one-by-one"))
            text = "".join(parts)
        return text[1:] if front else text


_MODELS: dict[bytes, PieceModel] = {}


def piece_model(model: bytes) -> PieceModel:
    """The worker's model."""
    if model not in _MODELS:
        _MODELS[model] = PieceModel(model)
    return _MODELS[model]


def _file(path: str | None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode_pieces(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """(doc_id, ids) of each row's text. model_file is read once on the driver and sent with the task (half a MB)."""
    shared = docs.sparkSession.sparkContext.broadcast(_file(model_file))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(shared.value)
        for b in batches:
            held, size, first = [], 0, 0
            for i in range(len(b)):
                text = b.column(1)[i].as_py()
                held.append(np.array(model.encode(text), np.int32))
                size += len(text)
                if size >= BLOCK_CHARS or i == len(b) - 1:
                    ends = np.cumsum([0, *map(len, held)], dtype=np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held)))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(held)), ids], ["doc_id", "ids"])
                    held, size, first = [], 0, i + 1

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_pieces(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """(doc_id, ids, text): the text of each row's ids; null ids are none. An id outside the model is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(_file(model_file))
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(shared.value)
        for b in batches:
            ids = b.column(1)
            flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            size, first, held = 0, 0, []
            for i in range(len(b)):
                held.append(model.decode(flat[ends[i] : ends[i + 1]]))
                size += len(held[-1])
                if size >= BLOCK_CHARS or i == len(b) - 1:
                    yield pa.RecordBatch.from_arrays([c.slice(first, len(held)) for c in b.columns] + [pa.array(held, pa.string())], ["doc_id", "ids", "text"])
                    held, size, first = [], 0, i + 1

    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")


def round_trip(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row's text, encoded and decoded again."""
    both = decode_pieces(encode_pieces(docs, model_file), model_file)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
