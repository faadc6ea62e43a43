"""Token counts by compiled finite-state transducers.

Two transducers are compiled from the tokenizer's file. The first reads character classes and splits text into
pre-tokens: it has 12 states; each transition carries how many pre-tokens it emits, and where they start. Text is cut into
fixed chunks; a chunk becomes a state map (entry state -> exit state), chunk maps are composed by a parallel prefix scan,
and a replay from the known entry states gives every start.

The second reads the bytes of a pre-token: its state is the prefix read so far, as far as it matters: the last token of the
encoding of each of its own prefixes. A transition carries the change in the number of tokens. It is determinised on demand:
a prefix ends in the one vocabulary token that ends there and may follow the last token of what is left before it, where
two tokens may follow each other if the merge rules leave their joint text as these two. So its count is that of the
shorter prefix plus one. Whole pre-tokens that were read once are remembered with their sum.

Null text counts as empty (0 tokens); repeated rows give repeated results; a null doc_id is kept. The tokenizer's
special strings inside a text count one each, as the library does by default.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE, STMD, RV, E, L, END = range(11)
(START, IN_LETTER, IN_NUMBER, IN_OTHER, ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK, QUOTED, QUOTED_RV, QUOTED_L, CLOSED) = range(12)
STATES, WIDTH = 12, 16
HERE, BEFORE = 1, 2  # a pre-token starts at this symbol; one starts at the symbol before
CHUNK = 64
BLOCK_CHARS = 1_000_000
LEXICON_ENTRIES = 400_000
def _fresh(symbol: int) -> int:
    """State after a pre-token that starts with this symbol."""
    if symbol == NUMBER:
        return IN_NUMBER
    if symbol == OTHER:
        return IN_OTHER
    if symbol == QUOTE:
        return QUOTED
    return {SPACE: ONE_SPACE, BLANK: ONE_BLANK, END: START}.get(symbol, IN_LETTER)


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emission) by symbol * WIDTH + state."""
    nxt, emit = np.zeros(11 * WIDTH, np.uint8), np.zeros(11 * WIDTH, np.uint8)
    letters = {LETTER, STMD, RV, E, L}

    def step(state: int, x: int) -> tuple[int, int]:
        if x == END:
            return START, BEFORE if state in (QUOTED_RV, QUOTED_L) else 0
        if state == IN_LETTER and x in letters or state == IN_NUMBER and x == NUMBER or state == IN_OTHER and x in (OTHER, QUOTE):
            return state, 0
        if state in (ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK):
            if x in (SPACE, BLANK):
                return (RUN_SPACE if x == SPACE else RUN_BLANK), 0
            # the last blank of a run stands alone, or leads the next pre-token if it is a space
            late = BEFORE if state in (RUN_SPACE, RUN_BLANK) else 0
            if state in (ONE_SPACE, RUN_SPACE):
                return (IN_OTHER if x == QUOTE else _fresh(x)), late
            return _fresh(x), late | HERE
        if state == QUOTED:
            if x == STMD:
                return CLOSED, 0
            if x == RV:
                return QUOTED_RV, 0
            if x == L:
                return QUOTED_L, 0
            if x in (OTHER, QUOTE):
                return IN_OTHER, 0
        if state == QUOTED_RV and x == E or state == QUOTED_L and x == L:
            return CLOSED, 0
        if state in (QUOTED_RV, QUOTED_L):  # no contraction: the letter before started a pre-token of its own
            follow, emitted = (IN_LETTER, 0) if x in letters else (_fresh(x), HERE)
            return follow, emitted | BEFORE
        return _fresh(x), HERE

    for state in range(STATES):
        for x in range(11):
            nxt[x * WIDTH + state], emit[x * WIDTH + state] = step(state, x)
    return nxt, emit


def symbol_table() -> np.ndarray:
    """Symbol of every code point."""
    import regex

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every, at = "".join(map(chr, points)), np.array(points)
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, symbol in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", BLANK)):
        for m in regex.finditer(pattern, every):
            out[at[m.start() : m.end()]] = symbol
    for chars, symbol in ((" ", SPACE), ("'", QUOTE), ("stmd", STMD), ("rv", RV), ("e", E), ("l", L)):
        out[[ord(c) for c in chars]] = symbol
    return out


def emissions(symbols: np.ndarray, nxt: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Emission of each transition: chunk state maps, their prefix composition, then a replay of each chunk."""
    n, chunks = len(symbols), -(-len(symbols) // CHUNK)
    padded = np.full(chunks * CHUNK, END, np.uint8)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T) * np.uint8(WIDTH)
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (chunks, 1))
    for column in columns:
        maps = nxt[column[:, None] + maps]
    reach = 1
    while reach < chunks:
        later = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), axis=1)
        maps = np.concatenate([maps[:reach], later])
        reach *= 2
    state = np.concatenate([[START], maps[:-1, START]]).astype(np.uint8)
    out = np.empty((CHUNK, chunks), np.uint8)
    for j, column in enumerate(columns):
        at = column + state
        out[j], state = emit[at], nxt[at]
    return out.T.reshape(-1)[:n]


class Merges:
    """The byte transducer: numbers of tokens of pre-tokens, from the vocabulary and the merge rules alone.

    Tokens are numbered by the order of their rules: bytes first, then each rule's product.
    """

    def __init__(self, spec: dict):
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(c): c for c in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        pairs = [tuple(r.split(" ")) if isinstance(r, str) else tuple(r) for r in spec["model"]["merges"]]
        number = {c: byte_of[c] for c in byte_of}
        left, right = np.full(256 + len(pairs), -1, np.int64), np.full(256 + len(pairs), -1, np.int64)
        for i, (a, b) in enumerate(pairs):
            number.setdefault(a + b, 256 + i)
            left[256 + i], right[256 + i] = number[a], number[b]
        self.left, self.right = left, right
        # the rules by pair
        keys = left[256:] * self.SPAN + right[256:]
        self.pair_keys, first = np.unique(keys, return_index=True)
        self.pair_token = first + 256
        # the vocabulary as a trie, one edge a key: node * 256 + byte -> node
        edges: dict[int, int] = {}
        token_at = [-1]
        for text, token in number.items():
            node = 0
            for c in text:
                key = node * 256 + byte_of[c]
                if key not in edges:
                    edges[key] = len(token_at)
                    token_at.append(-1)
                node = edges[key]
            token_at[node] = token
        self.edge_keys = np.array(sorted(edges), np.int64)
        self.edge_to = np.array([edges[k] for k in self.edge_keys.tolist()], np.int64)
        self.token_at = np.array(token_at, np.int64)

    SPAN = 1 << 20

    def _found(self, keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return at, keys[at] == asked

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merge rules leave the joint text of tokens a and b as these two.

        Undo rules at the border of a and b, the later one first: if at any time a rule would have joined the two parts
        that meet there before the rules undone so far were used, it would have been used instead.

        A rule of the right part wins over an equal one that is found to its left only if it is earlier, so the limit on that
        side is one higher.
        """
        free = np.ones(len(a), bool)
        x, y = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            at, is_rule = self._found(self.pair_keys, x[live] * self.SPAN + y[live])
            joined = is_rule & (self.pair_token[at] < limit[live])
            free[live[joined]] = False
            live = live[~joined]
            u, v = x[live], y[live]
            # the part made by the later rule is taken apart; bytes stay
            take_left = (u > v) & (u >= 256) | (v < 256)
            whole = (u < 256) & (v < 256)
            live, take_left, u, v = live[~whole], take_left[~whole], u[~whole], v[~whole]
            limit[live] = np.where(take_left, u, v + 1)
            x[live] = np.where(take_left, self.right[u], u)
            y[live] = np.where(take_left, v, self.left[v])
        return free

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word, all words one byte further at a time."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        begin = np.cumsum(size) - size
        end_of = np.repeat(begin + size, size)
        # all vocabulary tokens that stand anywhere: walk the trie from every place
        place, node, length, hits = np.arange(len(text)), np.zeros(len(text), np.int64), 0, []
        while len(place):
            at, ok = self._found(self.edge_keys, node * 256 + text[place + length])
            place, node, length = place[ok], self.edge_to[at[ok]], length + 1
            token = self.token_at[node]
            is_token = token >= 0
            hits.append(np.stack([place[is_token] + length, place[is_token], token[is_token]]))
            more = place + length < end_of[place]
            place, node = place[more], node[more]
        ends, starts, tokens = np.concatenate(hits, 1) if hits else np.zeros((3, 0), np.int64)
        # a transition a byte: the words' prefixes of one length together
        depth = ends - begin[np.searchsorted(begin, starts, side="right") - 1] if len(ends) else ends
        order = np.argsort(depth, kind="stable")
        ends, starts, tokens, depth = ends[order], starts[order], tokens[order], depth[order]
        last, count = np.full(len(text) + 1, -1, np.int64), np.zeros(len(text) + 1, np.int64)
        first_of = np.zeros(len(text) + 1, bool)
        first_of[begin] = True
        cuts = np.searchsorted(depth, np.arange(1, (size.max() if len(size) else 0) + 2))
        state = np.zeros((2, len(text) + 1), np.int64)  # last token and count of the prefix that ends before each place
        state[0] = -1
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s == e:
                continue
            stop, start, token = ends[s:e], starts[s:e], tokens[s:e]
            opens = first_of[start]
            before = last[start]
            good = opens.copy()
            inner = np.flatnonzero(~opens)
            good[inner] = self.may_follow(before[inner], token[inner])
            stop, start, token, opens = stop[good], start[good], token[good], opens[good]
            state[0, stop], state[1, stop] = token, np.where(opens, 0, count[start]) + 1
            # the end of one word is the start of the next, so what a prefix leaves is kept apart from where words start
            inside = ~first_of[stop]
            last[stop[inside]], count[stop[inside]] = token[inside], state[1, stop[inside]]
        return state[1, begin + size]


class TokenCounter:
    """Counts tokens of texts; keeps what it has compiled for the life of a Python worker."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.merges = Merges(spec)
        self.nxt, self.emit = compile_splitter()
        self.symbols = symbol_table()
        self.lexicon: dict[str, int] = {}

    def _weights(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token; those that were not read yet go through the byte transducer."""
        found = np.fromiter(map(self.lexicon.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            if len(self.lexicon) > LEXICON_ENTRIES:
                self.lexicon = {}
            missing_words = [words[i] for i in missing.tolist()]
            new = list(set(missing_words))
            self.lexicon.update(zip(new, self.merges.counts([w.encode() for w in new]).tolist(), strict=True))
            found[missing] = [self.lexicon[w] for w in missing_words]
        return found

    def _block(self, pieces: list[str]) -> np.ndarray:
        text = "\0".join(pieces) + "\0"
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        symbols = self.symbols[points]
        symbols[ends] = END
        found = emissions(symbols, self.nxt, self.emit)
        starts = (found & HERE).astype(bool)
        starts[:-1] |= (found[1:] & BEFORE).astype(bool)
        starts[ends] = True  # closes the last pre-token of a piece, and is none itself
        at = np.flatnonzero(starts)
        first, last = at[:-1], at[1:]
        real = symbols[first] != END
        first, last = first[real], last[real]
        weights = self._weights([text[s:e] for s, e in zip(first.tolist(), last.tolist(), strict=True)])
        total = np.concatenate([[0], np.cumsum(weights)])
        edge = np.searchsorted(first, np.concatenate([[0], ends]))
        return total[edge[1:]] - total[edge[:-1]]

    def count(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        pieces: list[str] = []
        owner: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            parts = [text]
            for s in self.special:
                if s in text:
                    parts = [x for p in parts for x in p.split(s)]
            out[i] += len(parts) - 1
            pieces += parts
            owner += [i] * len(parts)
            size += len(text) + 1
            if size >= BLOCK_CHARS or i == len(texts) - 1:
                np.add.at(out, owner, self._block(pieces))
                pieces, owner, size = [], [], 0
        return out


_COUNTERS: dict[str, TokenCounter] = {}


def counter(tokenizer_json: str) -> TokenCounter:
    """The worker's counter for this tokenizer."""
    if tokenizer_json not in _COUNTERS:
        _COUNTERS[tokenizer_json] = TokenCounter(tokenizer_json)
    return _COUNTERS[tokenizer_json]


def count_tokens(docs: DataFrame, tokenizer_file: str | None = None, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of docs; no shuffle.

    tokenizer_file: a byte-level BPE file of the tokenizers library with the usual splitting pattern; read once on
    the driver and sent with the task (a few MB, whatever the corpus).
    """
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = public_tokenizers.path("byte_bpe_50k.json")
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(shared.value)
        for b in batches:
            texts = b.column(1)
            n = count.count(texts.to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
