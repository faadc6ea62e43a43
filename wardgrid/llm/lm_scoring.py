"""Language-model scores by a small causal self-attention model over subword ids.

Words are the space-free chunks of a text, with A-Z in lower case; each is spelled by the ids of a public byte-level
tokenizer, and one end id closes the text. The model attends from each id to the ids before it and mixes CLASSES
distributions over the next id, so a probability needs no sum over the vocabulary. Texts are read in windows of 2 * STRIDE ids
that overlap by half: the first half is context, each id is scored once, in the second half of one window, by masked
attention over a whole batch of windows.

The probability of a word where a word begins mixes three parts with fitted weights: its smoothed share of the training
words, (c + 1) / (N + V + 1); CLASSES distributions over the TOP most frequent training words, weighed by the attention
state; and its spelling: the product of its ids' probabilities, given that a word begins and that another begins after
it. All words that no training text holds count as one, as in the base score; its probability is at least its share and its
spelling's, which is what it gets. So the probabilities of the training words and of that one sum to at most 1.

All training rows (crc32(doc_id as text) mod 7 is not 2) are learnt from, whole: word counts in one pass, the model in
another. In that pass each task starts from the same model, reads its rows once, adds up expected counts of ids and words
for each class over every window, and takes gradient steps for the attention on every window, from one forward pass over both;
sums are then added and weights averaged over all tasks, by keys. The common start is a short fit on at most START_DOCS texts, of
long ones a stretch of START_CHARS, without which the classes of two tasks would not mean the same; none of its counts stays
in the model, and its texts are learnt from whole in the pass like all others. The share of rare words is joined in, never cut off:
HEAD only says how many frequent words are sent to all tasks, so that no key of that join is heavy.

Null text counts as empty (one token, the end). Repeated rows give repeated results and count as often in training;
a null doc_id counts as the text ''. An empty table gives no rows; without training rows each word has the same share.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardgrid.llm.common import fold, staged
from wardgrid.llm.packing import encoder

FOLDS, HELD_OUT = 7, 2
START_DOCS, START_CHARS = 500, 8_000  # texts that the common start is fitted on, and how much of one is read for it
HEAD = 100_000  # frequent words sent to all tasks; shares are the same for any number, the weights of the three parts are fitted on these
LEVELS = 16  # steps of frequency per doubling at which the frequent words may be cut off
TOP = 20_000  # words with a distribution per class
CLASSES, DEPTH = 32, 16
STRIDE = 16
EPOCHS = 2
PRIOR = 5.0  # ids that the share of all classes counts for in a class
WORD_PRIOR = 2000.0
RARE = pa.list_(pa.struct([("word", pa.string()), ("p", pa.float64())]))
RUN = 4  # windows in a row that a batch of gradient steps takes at a time: longer runs cost less, but batches are less mixed
LEARN_CHARS = 300_000  # texts that are learnt from at a time
COLUMNS = 48  # numbers in a row of sums: CLASSES + DEPTH
COUNT_CHARS = 8_000_000  # texts whose words are counted at a time
CACHE = 200_000
END_ID = 50256
END = b"\n"  # no word holds it


def words(text: str) -> list[bytes]:
    """bytes.lower() and bytes.split() know ASCII only, which is what is asked."""
    return text.encode().lower().split()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words() of all texts laid end to end, how many each text has); no text is null."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    flat = lists.flatten()
    empty = np.flatnonzero(pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False))  # a text without words is split into one empty word
    if len(empty):
        sizes[np.searchsorted(np.cumsum(sizes), empty, side="right")] -= 1
        flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
    return flat, sizes


class Lexicon:
    """Words by number, with their subword ids and their place among the frequent words; remembered for the life of a Python worker."""

    def __init__(self, tokenizer_json: str, place: dict[bytes, int]):
        self.coder, self.place = encoder(tokenizer_json).coder, place
        shown = [self.coder.decode_single_token_bytes(i) for i in range(END_ID)]
        self.width = np.array([*map(len, shown), 0])
        self.opens = np.array([*(b[:1] == b" " for b in shown), True])  # ids that begin a word
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.start, self.length, self.at = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.numbers([END])

    def spell(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has). The splitting pattern never joins two words, so one call spells them all."""
        texts = [w.decode() for w in new]
        line = " " + " ".join(texts)
        if END not in new and line.split() == texts:  # no white space beyond ASCII inside a word
            ids = np.array(self.coder.encode_ordinary(line), np.int32)
            ends = np.cumsum(self.width[ids])
            last = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)) + 1)
            at = np.searchsorted(ends, last)
            if (ends[at] == last).all():
                return ids, np.diff(at, prepend=-1)
        each = [[END_ID] if w == END else self.coder.encode_ordinary(" " + t) for w, t in zip(new, texts, strict=True)]
        return np.array([i for x in each for i in x], np.int32), np.fromiter(map(len, each), np.int64, len(each))

    def numbers(self, chunks: list[bytes]) -> np.ndarray:
        """The number of each word; new words are spelled first."""
        found = np.fromiter(map(self.number.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(found < 0).tolist()
        new = list(dict.fromkeys([chunks[i] for i in missing]))
        if not new:
            return found
        if len(self.number) + len(new) > CACHE:
            self.forget()
            missing, new = range(len(chunks)), [w for w in dict.fromkeys(chunks) if w != END]
        spelled, length = self.spell(new)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.start = np.append(self.start, len(self.ids) + np.cumsum(length) - length)
        self.length = np.append(self.length, length)
        self.ids = np.append(self.ids, spelled)
        self.at = np.append(self.at, np.fromiter(map(self.place.get, new, repeat(-1)), np.int64, len(new)))
        found[missing] = range(len(self.number) - len(new), len(self.number)) if len(new) == len(missing) else [self.number[chunks[i]] for i in missing]
        return found

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """(number of each word, words of each text; of each word its place in the last, distinct words) of texts that each end in END.
        A word is looked up once, however often it stands there."""
        flat, sizes = words_of(texts)
        coded = flat.dictionary_encode()
        distinct = pa.concat_arrays([coded.dictionary, pa.array([END.decode()], flat.type)])
        found = self.numbers(distinct.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist())
        code = np.full(len(flat) + len(sizes), len(distinct) - 1, np.int32)
        sizes += 1
        inside = np.ones(len(code), bool)
        inside[np.cumsum(sizes) - 1] = False
        code[inside] = coded.indices.to_numpy()
        return found.take(code), sizes, code, distinct

    def laid_out(self, numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(ids before, ids, ids of each text, first id of each word) of texts of `sizes` words laid end to end."""
        length = self.length[numbers]
        starts = np.cumsum(length) - length
        ids = self.ids[np.repeat(self.start[numbers] - starts, length) + np.arange(length.sum())]
        per = np.add.reduceat(length, np.cumsum(sizes) - sizes)
        before = np.concatenate([[END_ID], ids[:-1]]).astype(np.int32)
        before[np.cumsum(per) - per] = END_ID
        return before, ids, per, starts


def row_sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, sum of the values of each)."""
    order, edge, _ = groups(rows)
    return rows[order[edge]], group_sums(values, order, edge)


def group_sums(values: np.ndarray, order: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sums of the rows of each group. Two neighbouring floats are added as one complex number, which takes half the additions."""
    return np.add.reduceat(np.ascontiguousarray(values).view(np.complex64).take(order, 0), edge, axis=0).view(np.float32)


def groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stable order, where each distinct row begins in it, the number of each row among the distinct ones)."""
    order = np.argsort(rows.astype(np.uint16) if rows.max() < 1 << 16 else rows, kind="stable")  # 16 bits are sorted by radix
    ranked = rows.take(order)
    new = np.ones(len(rows), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    number = np.empty(len(rows), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number


def stepped(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid end to end, each padded to whole steps of STRIDE: (place of each position, whether a step begins a text)."""
    n = -(-sizes // STRIDE)
    place = np.arange(sizes.sum()) + np.repeat((np.cumsum(n) - n) * STRIDE - (np.cumsum(sizes) - sizes), sizes)
    first = np.zeros(n.sum(), bool)
    first[np.cumsum(n) - n] = True
    return place, first


def run_length(window: np.ndarray) -> int:
    """The largest number of windows that form a run, if all windows come in runs of one length; else 1."""
    breaks = np.flatnonzero((window[1:, :STRIDE] != window[:-1, STRIDE:]).any(1)) + 1
    run = int(breaks[0]) if len(breaks) else len(window)
    return run if len(window) % run == 0 and not (breaks % run).any() else 1


class AttentionModel:
    """p(next id | ids before): one attention head, then a mixture of id distributions.

    A window is a step of STRIDE ids and the step before it in the same text; the step's own ids are scored. Padding
    follows the last id of a text, so the causal mask hides it."""

    def __init__(self, vocabulary: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        make = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.w = {"q": make(DEPTH, DEPTH), "k": make(DEPTH, DEPTH), "v": make(DEPTH, DEPTH), "near": np.zeros(2 * STRIDE, np.float32), "out": make(DEPTH, CLASSES), "bias": np.zeros(CLASSES, np.float32), "embed": rng.normal(0, 0.5, (vocabulary, DEPTH)).astype(np.float32)}
        self.emit = rng.gamma(1.0, size=(vocabulary, CLASSES)).astype(np.float32)
        self.emit /= self.emit.sum(0, dtype=float).astype(np.float32)
        self.gap = (np.arange(STRIDE)[:, None] + STRIDE) - np.arange(2 * STRIDE)[None, :]  # from query to key
        self.unseen = np.where(self.gap < 0, np.float32(-1e4), np.float32(0))

    def project(self, x: np.ndarray) -> np.ndarray:
        """Of each row of embeddings: itself, query, key, value and a one, whose weighted sum is the sum of weights."""
        w, d = self.w, DEPTH
        out = np.empty((len(x), 4 * d + 1), np.float32)
        out[:, :d], out[:, 4 * d] = x, 1
        np.matmul(x, np.concatenate([w["q"] * np.float32(d**-0.5), w["k"], w["v"]], 1), out=out[:, d : 4 * d])
        return out

    def forward(self, windows: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """For projected windows, (..., 2 * STRIDE, 4 * DEPTH + 1), of which some begin a text. Weights stay unnormalised, as
        dividing DEPTH sums costs less. Scores are small sums of products, so exp() needs no shift; clips guard it."""
        w, d = self.w, DEPTH
        own, k, v = windows[..., STRIDE:, :], windows[..., 2 * d : 3 * d], windows[..., 3 * d :]
        q = own[..., d : 2 * d]
        scores = q @ k.swapaxes(-1, -2)
        scores += w["near"][np.maximum(self.gap, 0)] + self.unseen
        scores.reshape(-1, *self.gap.shape)[first, :, :STRIDE] = -1e4
        np.clip(scores, -1e4, 60, out=scores)
        np.exp(scores, out=scores)
        summed = scores @ v
        total = summed[..., d:] + np.float32(1e-30)
        attended = summed[..., :d] / total
        hidden = (own[..., :d] + attended).reshape(-1, d)
        # tanh(x) = 1 - 2 / (exp(2 * x) + 1)
        np.clip(hidden, -20, 20, out=hidden)
        hidden += hidden
        np.exp(hidden, out=hidden)
        hidden += np.float32(1)
        np.divide(np.float32(-2), hidden, out=hidden)
        hidden += np.float32(1)
        mix = hidden @ w["out"]
        mix += w["bias"]
        np.clip(mix, -60, 60, out=mix)
        np.exp(mix, out=mix)
        mix *= (np.float32(1) / (mix @ np.ones(CLASSES, np.float32)))[:, None]
        return {"q": q, "k": k, "v": v, "a": scores, "total": total, "attended": attended, "h": hidden, "mix": mix}

    def read(self, ids: np.ndarray, following: np.ndarray, sizes: np.ndarray, starts: np.ndarray, table: np.ndarray | None = None, batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Natural log of p(following[i] | ids up to i in its text), for texts laid end to end; the mixture at starts.
        table: project() of all embeddings."""
        table = self.project(self.w["embed"]) if table is None else table
        place, first = stepped(sizes)
        nxt = np.zeros(len(first) * STRIDE, np.int64)
        here = np.zeros(len(nxt) + STRIDE, np.int64)  # before the first step, which begins a text, lies an empty one
        here[place + STRIDE], nxt[place] = ids, following
        p, mixes, wanted = np.empty(len(nxt), np.float32), np.empty((len(starts), CLASSES), np.float32), place[starts]
        for i in range(0, len(first), batch):
            rows = table.take(here[i * STRIDE : (i + batch + 1) * STRIDE], 0)
            windows = np.lib.stride_tricks.sliding_window_view(rows, 2 * STRIDE, 0)[::STRIDE].transpose(0, 2, 1)
            mix = self.forward(windows, first[i : i + batch])["mix"]
            at = slice(i * STRIDE, i * STRIDE + len(mix))
            s, e = np.searchsorted(wanted, (at.start, at.stop))
            mixes[s:e] = mix.take(wanted[s:e] - at.start, 0)
            p[at] = np.einsum("nk,nk->n", mix, self.emit.take(nxt[at], 0))
        return np.log(p[place] + np.float32(1e-30)), mixes

    def gradient(self, window: np.ndarray, first: np.ndarray, nxt: np.ndarray, there: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of minus the mean log probability of the ids nxt that are there; rows and d_e are those of embeddings.
        Beside it, of each id of nxt: its probability p, the classes' mix before it, and their blame, the share of each in it.
        Where windows come in runs of one length, each beginning with the step that the one before it ends with, a step that
        two of them share is read once."""
        w, d = self.w, DEPTH
        run = run_length(window)
        runs = len(window) // run
        steps = np.empty((runs, run + 1, STRIDE), window.dtype)
        steps[:, 0], steps[:, 1:] = window[::run, :STRIDE], window[:, STRIDE:].reshape(runs, run, STRIDE)
        order, edge, number = groups(steps.ravel())
        rows = steps.ravel()[order[edge]]
        told = self.project(w["embed"].take(rows, 0)).take(number, 0)  # an id is projected once
        laid = told.reshape(runs, (run + 1) * STRIDE, -1)
        got = self.forward(np.lib.stride_tricks.sliding_window_view(laid, 2 * STRIDE, 1)[:, ::STRIDE].swapaxes(2, 3), first)
        blame = got["mix"] * self.emit.take(nxt, 0)
        p = blame @ np.ones(CLASSES, np.float32)
        blame *= (np.float32(1) / (p + np.float32(1e-30)))[:, None]
        d_mix = got["mix"] - blame
        away = np.flatnonzero(~there)
        blame[away] = d_mix[away] = 0
        d_mix *= np.float32(1 / max(len(there) - len(away), 1))
        grad = {"out": got["h"].T @ d_mix, "bias": np.ones(len(d_mix), np.float32) @ d_mix}
        d_in = got["h"] ** 2
        np.subtract(np.float32(1), d_in, out=d_in)
        d_in *= d_mix @ w["out"].T
        d_in = d_in.reshape(runs, run, STRIDE, d)
        # weights are unnormalised, so what comes back through them is divided by their sums; what the sums themselves give meets the values' ones
        both = np.empty((runs, run, STRIDE, d + 1), np.float32)
        back = np.divide(d_in, got["total"], out=both[..., :d])
        np.negative(np.einsum("rbqd,rbqd->rbq", back, got["attended"]), out=both[..., d])
        d_s = both @ got["v"].swapaxes(2, 3)
        d_s *= got["a"]
        grad["near"] = np.bincount(np.maximum(self.gap, 0).ravel(), np.ones(len(window), np.float32) @ d_s.reshape(len(window), -1), 2 * STRIDE).astype(np.float32)
        # got["q"] holds the scale already
        d_q = (d_s @ got["k"]).reshape(-1, d) * np.float32(d**-0.5)
        each = np.empty((runs, run, 2 * STRIDE, 2 * d), np.float32)
        np.matmul(d_s.swapaxes(2, 3), got["q"], out=each[..., :d])
        np.matmul(got["a"].swapaxes(2, 3), back, out=each[..., d:])
        d_kv = np.zeros((runs, run + 1, STRIDE, 2 * d), np.float32)
        d_kv[:, 1:] = each[:, :, STRIDE:]
        d_kv[:, :-1] += each[:, :, :STRIDE]
        d_kv = d_kv.reshape(-1, 2 * d)
        x = np.ascontiguousarray(told[:, :d])
        own = x.reshape(runs, -1, d)[:, STRIDE:].reshape(-1, d)
        grad |= {"q": own.T @ d_q, "k": x.T @ d_kv[:, :d], "v": x.T @ d_kv[:, d:]}
        d_x = (d_kv @ np.concatenate([w["k"].T, w["v"].T])).reshape(steps.shape + (d,))
        d_x[:, 1:] += d_in
        d_x[:, 1:] += (d_q @ w["q"].T).reshape(d_in.shape)
        return grad | {"rows": rows, "d_e": group_sums(d_x.reshape(-1, d), order, edge), "p": p, "mix": got["mix"], "blame": blame}


class Scorer:
    """The model of words, given the frequent ones with their training counts: scores texts, and learns from texts."""

    def __init__(self, tokenizer_json: str, head: list[tuple[str, int]], smoothed: float, top: int = TOP):
        self.lexicon = Lexicon(tokenizer_json, {w.encode(): i for i, (w, _) in enumerate(head)})
        counts = np.array([c for _, c in head] + [0], float)
        self.log_count, self.known, self.share = np.log10(counts + 1), counts > 0, (counts + 1) / smoothed
        self.without_self = np.maximum(counts, 1) / smoothed
        self.model, self.table = AttentionModel(END_ID + 1), None
        self.word_share = self.share[: min(top, len(head))] / max(self.share[: min(top, len(head))].sum(), 1e-30)
        self.take(np.zeros((END_ID + 1, CLASSES), np.float32), np.zeros((len(self.word_share), CLASSES), np.float32), np.ones(3), self.model.w)

    def take(self, seen: np.ndarray, word_seen: np.ndarray, weights: np.ndarray, w: dict[str, np.ndarray]) -> Scorer:
        """Probabilities from expected counts of ids and words for each class, and from the attention's weights."""
        model = self.model
        self.seen, self.word_seen, self.weight_sums, model.w = seen, word_seen, weights, w
        share = seen.sum(1, dtype=float) + 0.1
        share = (share / share.sum()).astype(np.float32)[:, None]
        if seen.any():
            model.emit = (seen + share * np.float32(PRIOR)) / (seen.sum(0, dtype=float) + PRIOR).astype(np.float32)
        by_class = word_seen + self.word_share[:, None].astype(np.float32) * np.float32(WORD_PRIOR)
        self.by_class = np.append(by_class / np.maximum(by_class.sum(0, dtype=float), 1e-30).astype(np.float32), np.zeros((1, CLASSES), np.float32), 0)  # the last row: other words
        self.weights = weights / weights.sum()
        self.opening = model.emit[self.lexicon.opens].sum(0, dtype=float).astype(np.float32)
        self.table = None
        return self

    def parts(self, split: list[list[bytes]], shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each word or -1, the three probabilities of each)."""
        return self.parts_of(self.lexicon.numbers([w for s in split for w in s]), np.array([len(s) for s in split]), shares)

    def parts_of(self, numbers: np.ndarray, sizes: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.table is None:
            self.table = self.model.project(self.model.w["embed"])
        before, ids, per, starts = self.lexicon.laid_out(numbers, sizes)
        log_p, mixes = self.model.read(before, ids, per, starts, self.table)
        at = self.lexicon.at[numbers]
        return at, self.chances(at, sizes, starts, log_p, mixes, shares)

    def chances(self, at: np.ndarray, sizes: np.ndarray, starts: np.ndarray, log_p: np.ndarray, mixes: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """The three probabilities of each word, from those of its ids and the mixture where it begins."""
        # given that a word begins here, and that another begins where it ends
        begins = np.log(np.maximum((mixes @ self.opening).astype(float), 1e-30))
        ends = np.append(begins[1:], 0.0)
        ends[np.cumsum(sizes) - 1] = 0.0
        spelled = np.exp(np.clip(np.add.reduceat(log_p.astype(float), starts) + ends - begins, -700, 0))
        return np.stack([shares[at], np.einsum("nk,nk->n", mixes, self.by_class[self.row(at)]), spelled], 1)

    def row(self, at: np.ndarray) -> np.ndarray:
        last = len(self.by_class) - 1
        return np.where((at >= 0) & (at < last), at, last)

    def learn(self, texts: list[str] | pa.Array, heat: dict[str, np.ndarray], rng: np.random.Generator, rate: float = 0.05, batch: int = 128) -> int:
        """Takes gradient steps on all windows of some texts, in batches of runs of RUN windows dealt at random, then adds the expected
        counts that the same passes gave. Returns how many windows there were."""
        numbers, sizes, _, _ = self.lexicon.read(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts)
        before, ids, per, starts = self.lexicon.laid_out(numbers, sizes)
        model, w = self.model, self.model.w
        place, first = stepped(per)
        here, nxt, real = np.zeros((len(first), STRIDE), np.int64), np.zeros((len(first), STRIDE), np.int64), np.zeros((len(first), STRIDE), bool)
        here.ravel()[place], nxt.ravel()[place], real.ravel()[place] = before, ids, True
        whole = len(first) // RUN
        order = np.append((rng.permutation(whole)[:, None] * RUN + np.arange(RUN)).ravel(), np.arange(whole * RUN, len(first)))
        # from here on all lie as they are dealt; the step before a text's first one is masked
        window, first, nxt, real = np.concatenate([here[order - 1], here[order]], 1), first[order], nxt[order].ravel(), real[order].ravel()
        dealt = np.empty(len(order), np.int64)
        dealt[order] = np.arange(len(order)) * STRIDE
        place = dealt[place // STRIDE] + place % STRIDE
        p, mix, blame = np.empty(len(nxt), np.float32), np.empty((len(nxt), CLASSES), np.float32), np.empty((len(nxt), CLASSES), np.float32)
        for i in range(0, len(order), batch):
            some = slice(i * STRIDE, (i + batch) * STRIDE)
            n = np.float32(max(real[some].sum(), 1))
            grad = model.gradient(window[i : i + batch], first[i : i + batch], nxt[some], real[some])
            p[some], mix[some], blame[some] = grad.pop("p"), grad.pop("mix"), grad.pop("blame")
            rows, d_e = grad.pop("rows"), grad.pop("d_e")
            d_e *= np.sqrt(n)
            hot = heat["embed"].take(rows, 0)
            hot += d_e**2
            heat["embed"][rows] = hot
            w["embed"][rows] -= np.float32(rate) * d_e / np.sqrt(hot)
            for name, g in grad.items():
                heat[name] += g * g
                w[name] -= np.float32(rate) * g / np.sqrt(heat[name])
        at = self.lexicon.at[numbers]
        wanted = place[starts]
        chances = self.chances(at, sizes, starts, np.log(p[place] + np.float32(1e-30)), mix.take(wanted, 0), self.without_self)
        due = chances * self.weights
        self.weight_sums = self.weight_sums + (due / np.maximum(due.sum(1, keepdims=True), 1e-300)).sum(0)
        rows, told = row_sums(nxt, blame)
        self.seen[rows] += told
        row = self.row(at)
        own = row < len(self.word_seen)
        if own.any():
            rows, told = row_sums(row[own], blame.take(wanted[own], 0))
            self.word_seen[rows] += told
        self.take(self.seen, self.word_seen, self.weight_sums, w)
        return len(first)

    def heat(self) -> dict[str, np.ndarray]:
        return {name: np.full_like(x, 1e-3) for name, x in self.model.w.items()}

    def start(self, texts: list[str]) -> Scorer:
        """The common start of all tasks."""
        rng, heat = np.random.default_rng(9), self.heat()
        if texts:
            numbers = self.lexicon.numbers([w for t in texts for w in words(t)])
            each = np.bincount(self.lexicon.ids[np.repeat(self.lexicon.start[numbers], self.lexicon.length[numbers])], minlength=END_ID + 1).astype(np.float32)
            noise = 0.5 + rng.random((END_ID + 1, CLASSES), np.float32)
            self.take(each[:, None] / max(each.sum(), 1) * noise * 50, self.word_seen, self.weight_sums, self.model.w)
        for epoch in range(EPOCHS):
            if epoch:  # what early, unfitted classes were given is worth little
                self.seen *= np.float32(0.2)
                self.word_seen *= np.float32(0.2)
            for s, e in blocks(pa.array(texts, pa.large_string()), 60_000):
                self.learn(texts[s:e], heat, rng)
        return self

    def state(self) -> tuple:
        return self.seen, self.word_seen, self.weight_sums, self.model.w

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of each text: tokens; known ones, sum of log10(count + 1), log10 probability of the frequent ones; the others, with the
        probability of their spelling."""
        numbers, sizes, code, distinct = self.lexicon.read(texts)
        at, p = self.parts_of(numbers, sizes, self.share)
        edge = np.cumsum(sizes) - sizes
        often = at >= 0
        known, base, score = (np.add.reduceat(np.where(often, x, 0), edge) for x in (self.known[at].astype(np.int64), self.log_count[at], np.log10(p @ self.weights)))
        others = np.flatnonzero(~often)
        rare = pa.StructArray.from_arrays([distinct.take(pa.array(code[others])).cast(pa.string()), pa.array(p[others, 2])], ["word", "p"])
        ends = np.append(0, np.cumsum(np.add.reduceat((~often).astype(np.int32), edge))).astype(np.int32)
        return sizes, known, base, score, pa.ListArray.from_arrays(pa.array(ends), rare)


_SCORERS: dict[int, Scorer] = {}


def blocks(texts: pa.Array, chars: int = 200_000) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of some `chars` bytes."""
    edges = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        end = min(int(np.searchsorted(edges, (edges[start - 1] if start else 0) + chars)) + 1, len(texts))
        yield start, end
        start = end


def count_words(rows: DataFrame) -> DataFrame:
    """(word, n_train, n_all) over the rows (text, train); the end is the word '\\n'. Each task sums COUNT_CHARS at a time first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, e in blocks(b.column(0), COUNT_CHARS):
                part = b.slice(s, e - s)
                for train in (False, True):
                    texts = part.column(0).filter(pc.equal(part.column(1), train))
                    if len(texts):
                        seen = words_of(texts)[0].value_counts()
                        word = pa.concat_arrays([seen.field(0).cast(pa.string()), pa.array([END.decode()])])
                        n = np.append(seen.field(1).to_numpy(), len(texts))
                        yield pa.RecordBatch.from_arrays([word, pa.array(n * train), pa.array(n)], ["word", "n_train", "n_all"])

    return rows.select("text", "train").mapInArrow(run, "word string, n_train long, n_all long").groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


DENSE = ("q", "k", "v", "near", "out", "bias")


def sum_rows(scorer: Scorer, begun: tuple, windows: int, visits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What one task has learnt, as rows (kind, id, n, c0, ...) to be summed by key: 0 an id's expected counts and its
    embedding n times, 1 a word's expected counts, 2 the attention's weights n times, 3 the weights of the parts."""
    seen, word_seen, weight_sums, w = scorer.state()
    ids, tops = np.flatnonzero(visits), np.flatnonzero((word_seen != begun[1]).any(1))
    dense = np.concatenate([w[name].ravel() for name in DENSE])
    dense = np.pad(dense, (0, -len(dense) % COLUMNS)).reshape(-1, COLUMNS)
    wide = lambda x: np.pad(x, ((0, 0), (0, COLUMNS - x.shape[1])))
    tables = [
        (0, ids, visits[ids], np.concatenate([seen[ids] - begun[0][ids], w["embed"][ids] * visits[ids, None]], 1)), (1, tops, np.ones(len(tops)), wide(word_seen[tops] - begun[1][tops])),
        (2, np.arange(len(dense)), np.full(len(dense), windows), dense * windows), (3, np.zeros(1, int), np.ones(1), wide((weight_sums - begun[2])[None])),
    ]
    for kind, key, n, values in tables:
        columns = [pa.array(np.ascontiguousarray(c, np.float32)) for c in values.T]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.astype(np.int32)), pa.array(np.asarray(n, float)), *columns], ["kind", "id", "n", *[f"c{i}" for i in range(COLUMNS)]])


def merged(scorer: Scorer, sums: pa.Table) -> Scorer:
    """The scorer with the summed counts and averaged weights of all tasks."""
    kind, key, n = (sums.column(c).to_numpy() for c in ("kind", "id", "n"))
    values = np.stack([sums.column(f"c{i}").to_numpy() for i in range(COLUMNS)], 1)
    if not len(kind):
        return scorer
    of = lambda k: (key[kind == k], n[kind == k], values[kind == k])
    w = {name: x.copy() for name, x in scorer.model.w.items()}
    seen, word_seen = np.zeros_like(scorer.seen), np.zeros_like(scorer.word_seen)
    ids, visits, v = of(0)
    seen[ids], w["embed"][ids] = v[:, :CLASSES], v[:, CLASSES : CLASSES + DEPTH] / visits[:, None]
    ids, _, v = of(1)
    word_seen[ids] = v[:, :CLASSES]
    ids, windows, v = of(2)
    flat, at = (v / windows[:, None])[np.argsort(ids)].ravel(), 0
    for name in DENSE:
        w[name] = flat[at : at + w[name].size].reshape(w[name].shape).astype(np.float32)
        at += w[name].size
    return scorer.take(seen, word_seen, of(3)[2][0, :3], w)


def learn_all(train: DataFrame, scorer: Scorer, words_told: Broadcast) -> Scorer:
    """One pass over all training texts: each task learns from the common start, then sums and averages meet by key."""
    shared = train.sparkSession.sparkContext.broadcast(scorer.state())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = shared.value
        own = worker_scorer(words_told)
        seen, word_seen, weight_sums, w = begun
        own.take(seen.copy(), word_seen.copy(), weight_sums.copy(), {name: x.copy() for name, x in w.items()})
        heat, rng, windows, visits = own.heat(), np.random.default_rng(11), 0, np.zeros(END_ID + 1)
        waiting: list[pa.Array] = []
        size = 0

        def flush() -> None:
            nonlocal windows, size
            before = own.seen.sum(1)
            windows += own.learn(pa.concat_arrays(waiting), heat, rng)
            visits[:] += np.maximum(own.seen.sum(1) - before, 0)
            waiting.clear()
            size = 0

        for b in batches:
            for s, e in blocks(b.column(0), LEARN_CHARS):
                waiting.append(b.column(0).slice(s, e - s))
                size += pc.sum(pc.binary_length(waiting[-1])).as_py()
                if size >= LEARN_CHARS:
                    flush()
        if waiting:
            flush()
        if windows:
            yield from sum_rows(own, begun, windows, visits)
            own.take(*begun)

    columns = [f"c{i}" for i in range(COLUMNS)]
    rows = train.select("text").mapInArrow(run, "kind int, id int, n double, " + ", ".join(f"{c} float" for c in columns))
    sums = staged(rows.groupBy("kind", "id").agg(F.sum("n").alias("n"), *[F.sum(c).cast("float").alias(c) for c in columns]), "sums")
    return merged(scorer, sums.toArrow())  # as many rows as the model has ids, words and weights


def worker_scorer(words_told: Broadcast) -> Scorer:
    """This Python worker's scorer for these words; it keeps the spelled words between tasks."""
    known = words_told.value
    mark = zlib.crc32(repr((known[2:], len(known[1]), known[1][:100])).encode())
    if mark not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[mark] = Scorer(*known)
    return _SCORERS[mark]


def score_texts(docs: DataFrame, tokenizer_file: str | None = None, top: int = TOP) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mean_score), one row per row of docs.

    mean_score is the score per token.
    """
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = public_tokenizers.path("byte_bpe_50k.json")
    with open(tokenizer_file, encoding="utf-8") as f:
        tokenizer_json = f.read()
    context = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (fold("doc_id", FOLDS) != HELD_OUT).alias("train"))
    counts = staged(count_words(rows), "words")
    total, distinct = (x or 0 for x in counts.agg(F.sum("n_train"), F.sum((F.col("n_train") > 0).cast("long"))).first())
    smoothed = total + distinct + 1
    # frequent words, also those of held-out rows alone: what is left for the join below has no heavy key
    level = F.floor(F.log2("n_all") * LEVELS)
    room, cut = HEAD, 64 * LEVELS
    for least, n in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        room -= n
        if room < 0:
            break
        cut = least
    frequent = counts.where(level >= cut).select("word", "n_train").toArrow()
    head = sorted(zip(*(c.to_pylist() for c in frequent.columns), strict=True), key=lambda x: (-x[1], x[0]))
    known = (tokenizer_json, head, smoothed, top)
    # the hashes first, so that only the chosen texts travel
    train, h = rows.where("train"), F.xxhash64("doc_id")
    # of a long text a stretch, from a place that its hash says: the start only fixes what classes mean, all is learnt from later
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.length("text") - START_CHARS + 1).cast("int") + 1
    piece = F.when(F.length("text") > START_CHARS, F.substring("text", place, F.lit(START_CHARS))).otherwise(F.col("text"))
    last = train.select(h.alias("h")).orderBy("h").limit(START_DOCS).agg(F.max("h")).first()[0]
    texts = [] if last is None else [r[0] for r in train.where(h <= last).orderBy(h, "text").limit(START_DOCS).select(piece).collect()]
    words_told = context.broadcast(known)
    scorer = learn_all(train, Scorer(*known).start(texts), words_told)
    shared = context.broadcast(scorer.state())
    weights = [float(x) for x in scorer.weights]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = worker_scorer(words_told).take(*shared.value)
        part, done = TaskContext.get().partitionId() << 40, 0
        for b in batches:
            texts = b.column(1)
            for s, e in blocks(texts):
                n, known_n, base, score, rare = own.score(texts.slice(s, e - s))
                row = part + done + np.arange(s, e)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), b.column(2).slice(s, e - s), pa.array(row), pa.array(n, pa.int64()), pa.array(known_n, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), rare.cast(RARE)], ["doc_id", "train", "row", "n_tokens", "known", "base", "score", "rare"])
            done += len(texts)

    scored = staged(rows.mapInArrow(run, f"doc_id {kind}, train boolean, row long, n_tokens long, known long, base double, score double, rare array<struct<word:string,p:double>>"), "scored")
    # words beyond the frequent ones: each text's own words meet the corpus's counts
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.p").join(counts.where("n_train > 0").select("word", "n_train"), "word", "left")
    share = (F.coalesce("n_train", F.lit(0)) + 1.0) / smoothed
    more = rare.groupBy("row").agg(F.count("n_train").alias("more"), F.sum(F.log10(F.coalesce("n_train", F.lit(0)) + 1.0)).alias("extra"), F.sum(F.log10(share * weights[0] + F.col("p") * weights[2])).alias("told"))
    base = F.col("base") + F.coalesce("extra", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(smoothed)))
    score = F.col("score") + F.coalesce("told", F.lit(0.0))
    return scored.drop("rare").join(more, "row", "left").select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"), (score / F.col("n_tokens")).alias("mean_score"),
    )
