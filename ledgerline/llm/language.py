"""Language-model scores of whole documents: a gated recurrent network with a class-factored softmax.

Token counts come from all training documents and stay a distributed table. The ``top`` most frequent words
are grouped into classes by frequency, and the probability of such a word is that of its class times that of
the word in it, both from the recurrent state. Every other word belongs to a tail class by its spelling (last
letter, letters beyond ASCII); its class is predicted from the state, and its share of the class comes from
the counts, smoothed like the base score, so every word, seen or not, has a probability. The end of a
document is a token and a class of its own.

Training is truncated backpropagation in numpy, on all training documents: every task trains a
replica on its rows, and the replicas are averaged by aggregation, weighted by the tokens that each learned from, ``rounds``
times, each round over every row and every token of it. The state is carried from window to window of a document and
reset between documents, in training and in scoring, so a score is the log-likelihood of the complete document.

Scoring deals documents to blocks of about ``block_bytes``; the distinct words of a block fetch their counts
by a join, and block and counts meet in one group, which is scored in parts of ``part_bytes``. No count table is
ever broadcast.

Words are known by 64-bit hashes. Defined results: null and empty texts hold the end token alone; rows with a
null id belong to the training documents; repeated rows count and score as often as they occur; without
training documents all counts are 0; of words with equal counts those of the smaller hash are in the top; a very
long text is one lane, learned and scored to its end; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import textvec
from ledgerline.llm.common import written

FOLDS, HELD = 7, 2
TAILS = 54
#: 1 to 26 for the bytes a to z.
LETTER = np.zeros(256, np.int64)
LETTER[97:123] = np.arange(1, 27)


@dataclass(frozen=True)
class Settings:
    top: int = 512
    classes: int = 16
    hidden: int = 16
    window: int = 24
    train_lanes: int = 192
    score_lanes: int = 384
    rate: float = 0.02
    rounds: int = 2
    train_share: float = 1.0  # of the training documents, the same in each round and at any size
    train_tokens: int = 1 << 20  # tokens laid out in lanes at once
    block_bytes: int = 32 << 20
    part_bytes: int = 6 << 20  # of a block that is scored at once

    @property
    def per_class(self) -> int:
        return -(-self.top // self.classes)

    @property
    def symbols(self) -> int:
        """Input symbols: the top words, the tail classes and the end."""
        return self.top + TAILS + 1

    @property
    def outputs(self) -> int:
        return self.classes + TAILS + 1


DEFAULT = Settings()


def tails(words: textvec.Words) -> np.ndarray:
    """The tail class of each word: its last letter (or that before a mark), and whether it leaves ASCII."""
    if not len(words.starts):
        return np.zeros(0, np.int64)
    last, before = (LETTER[words.data[at]] for at in (words.ends - 1, np.maximum(words.ends - 2, words.starts)))
    wide = np.zeros(len(last), bool)
    wide[np.searchsorted(words.starts, np.flatnonzero(words.data >= 128), "right") - 1] = True
    return np.where(last > 0, last, before) + 27 * wide


def tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a text column: first row, word hashes, tail classes and the first word of each row."""
    data, bounds = textvec.flat(column)
    for a, b in textvec.slices(bounds):
        words = textvec.Words(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], textvec.SPACE, lower=True)
        yield a, words.hashes, tails(words), words.first


def _summed(keys: np.ndarray, kinds: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    total = np.add.reduceat(counts[order], begin) if len(keys) else counts
    return keys[begin], kinds[order][begin], total


def count_words(texts: DataFrame) -> DataFrame:
    """Rows (h, tail, c) of the words of a text column, summed over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [_summed(h, t, np.ones(len(h), np.int64)) for _, h, t, _ in tokens(batch.column(0))]
            if held:
                h, t, c = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(t.astype(np.int32)), pa.array(c)], ["h", "tail", "c"])

    return texts.mapInArrow(run, "h long, tail int, c long").groupBy("h").agg(F.max("tail").alias("tail"), F.sum("c").alias("c"))


class Vocabulary:
    """The top words and the totals that smooth the rest; a few thousand numbers, whatever the corpus."""

    def __init__(self, top: list[tuple[int, int, int]], by_tail: dict[int, tuple[int, int]], docs: int, s: Settings):
        """``top``: rows (hash, tail, count), most frequent first; ``by_tail``: count and distinct words of each tail class."""
        self.docs = docs
        self.total = sum(c for c, _ in by_tail.values()) + docs
        self.distinct = sum(v for _, v in by_tail.values()) + (docs > 0)
        self.counts = np.zeros(s.top)
        hashes = np.array([h for h, _, _ in top], np.int64).view(np.uint64)
        self.counts[: len(top)] = [c for _, _, c in top]
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        rest = np.zeros((TAILS, 2))
        for t, pair in by_tail.items():
            rest[t] = pair
        for _, t, c in top:
            rest[t] -= (c, 1)
        self.tail_counts = rest[:, 0]
        self.tail_room = rest.sum(1) + 1

    def code(self, hashes: np.ndarray, kinds: np.ndarray, s: Settings) -> np.ndarray:
        """The input symbol of each word."""
        out = s.top + kinds
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == hashes, self.order[at], out)
        return out


class Network:
    """The parameters, as views of one vector, and the forward and backward passes over dense windows."""

    def __init__(self, s: Settings, values: np.ndarray | None = None):
        self.s = s
        h = s.hidden
        shapes = {"x": (s.symbols, 3 * h), "u": (h, 3 * h), "wc": (h, s.outputs), "bc": (s.outputs,), "ww": (s.classes, h, s.per_class), "bw": (s.classes, s.per_class)}
        size = sum(int(np.prod(v)) for v in shapes.values())
        self.values = np.zeros(size, np.float32) if values is None else values.astype(np.float32)
        at = 0
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            setattr(self, name, self.values[at : at + n].reshape(shape))
            at += n

    @classmethod
    def initial(cls, s: Settings, v: Vocabulary) -> Network:
        """Small random weights, and biases that state the counts."""
        made, g = cls(s), np.random.default_rng(7)
        for part, scale in ((made.x, 0.3), (made.u, 0.4), (made.wc, 0.1), (made.ww, 0.1)):
            part[:] = g.normal(0, scale / np.sqrt(s.hidden) if part is not made.x else scale, part.shape)
        counts = np.zeros(s.classes * s.per_class)
        counts[: s.top] = v.counts
        inside = counts.reshape(s.classes, s.per_class) + 0.5
        made.bw[:] = np.log(inside / inside.sum(1, keepdims=True))
        made.bc[:] = np.log(np.concatenate([inside.sum(1), v.tail_counts + 1, [v.docs + 1]]))
        made.bc -= np.log(np.exp(made.bc).sum())
        return made

    def outputs(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and place in the class (-1: none) of each symbol."""
        top = symbols < self.s.top
        return np.where(top, symbols // self.s.per_class, symbols - self.s.top + self.s.classes), np.where(top, symbols % self.s.per_class, -1)

    def _gates(self) -> tuple[np.ndarray, np.ndarray]:
        """Input and state weights as three tables of their own, those of the gates negated, as their exponentials ask."""
        h = self.s.hidden
        x, u = (np.ascontiguousarray(w.reshape(-1, 3, h).swapaxes(0, 1)) for w in (self.x, self.u))
        for part in (x, u):
            np.negative(part[:2], out=part[:2])
        return x, u

    def run(self, symbols: np.ndarray, fresh: np.ndarray, state: np.ndarray, keep: bool = False):
        """States before each token of a (time, lane) window; ``fresh`` marks first tokens of documents.

        The two gates and the new state are tables of their own, so each step works on contiguous memory. With
        ``keep`` these (part, time, lane, hidden) and the products of states and weights are returned too.
        """
        h, (steps, n) = self.s.hidden, symbols.shape
        x, weights = self._gates()
        parts = np.take(x, symbols, axis=1)
        products = np.empty((3, steps if keep else 1, n, h), np.float32)
        states, part = np.empty((steps + 1, n, h), np.float32), np.empty((n, h), np.float32)
        states[0] = state
        for t, begun in enumerate(_places(fresh)):
            before, after, u = states[t], states[t + 1], products[:, t if keep else 0]
            if len(begun):
                before[begun] = 0
            np.matmul(before, weights, out=u)
            gates, new = parts[:2, t], parts[2, t]
            gates += u[:2]
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            new += np.multiply(gates[1], u[2], out=part)
            np.tanh(new, out=new)
            np.subtract(before, new, out=after)
            after *= gates[0]
            after += new
        return states[:-1], states[-1], (parts, products)

    @staticmethod
    def _small(weights: np.ndarray, biases: np.ndarray) -> bool:
        """Whether no state, which lies between -1 and 1, can give an output whose exponential leaves the range of a float."""
        return bool((np.abs(weights).sum(-2) + np.abs(biases)).max() < 60)

    def log_probabilities(self, before: np.ndarray, symbols: np.ndarray, grads: Network | None = None, weight: np.ndarray | None = None, order: np.ndarray | None = None):
        """Natural log-probability of class and word-in-class of each token; with ``grads``, also the gradient of the states.

        Tokens are taken in the ``order`` of their symbols, so those of a class lie together. The biases are the weights
        of a state that is always 1.
        """
        s, h, n = self.s, self.s.hidden, len(symbols)
        order = np.argsort(symbols, kind="stable") if order is None else order
        symbols = symbols.take(order)
        kind, place = self.outputs(symbols)
        states = np.empty((n, h + 1), np.float32)
        states[:, :h], states[:, h] = before.take(order, 0), 1
        edges = np.searchsorted(symbols, np.minimum(np.arange(s.classes + 1) * s.per_class, s.top)).tolist()
        ranges = [(c, slice(a, b)) for c, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
        top = edges[-1]

        def softmax(out: np.ndarray, at: np.ndarray, small: bool) -> np.ndarray:
            """Log-probability of one output of each row; with ``grads``, its loss's gradient is left in ``out``."""
            if not small:
                out -= out.max(1, keepdims=True)
            at = at + np.arange(0, out.size, out.shape[1])
            own = out.ravel()[at]
            np.exp(out, out=out)
            total = out @ np.ones(out.shape[1], np.float32)
            if grads is not None:
                out.ravel()[at] -= total
                out *= (weight[: len(out)] / total)[:, None]
            return own - np.log(total)

        weight = None if weight is None else weight.take(order)
        logits = states @ np.vstack([self.wc, self.bc])
        logp = softmax(logits, kind, self._small(self.wc, self.bc))
        if grads is not None:
            found = logits.T @ states
            grads.wc += found[:, :h].T
            grads.bc += found[:, h]
            back = logits @ self.wc.T
        if top:
            inner, words = np.empty((top, s.per_class), np.float32), np.concatenate([self.ww, self.bw[:, None]], 1)
            for c, at in ranges:
                np.matmul(states[at], words[c], out=inner[at])
            logp[:top] += softmax(inner, place[:top], self._small(self.ww, self.bw))
            if grads is not None:
                into = np.empty((top, h), np.float32)
                for c, at in ranges:
                    found = inner[at].T @ states[at]
                    grads.ww[c] += found[:, :h].T
                    grads.bw[c] += found[:, h]
                    np.matmul(inner[at], self.ww[c].T, out=into[at])
                back[:top] += into
        place = np.empty_like(order)
        place[order] = np.arange(n)
        return logp.take(place), None if grads is None else back.take(place, 0)

    def add_gradients(self, grads: Network, symbols: np.ndarray, fresh: np.ndarray, weight: np.ndarray, state: np.ndarray, n: int = 1) -> tuple[np.ndarray, float]:
        """Adds the gradient of the weighted loss of a run of ``n`` windows, by backpropagation truncated at the start of each; the last state and the loss.

        The state passes through the windows in turn; then they are independent, and go back beside each other as lanes.
        """
        h = self.s.hidden
        before, after, (parts, products) = self.run(symbols, fresh, state, keep=True)
        if n > 1:
            symbols, fresh, weight, before = (_beside(a[None], n)[0] for a in (symbols, fresh, weight, before))
            parts, products = _beside(parts, n), _beside(products, n)
        steps, weight, flat = len(symbols), weight.astype(np.float32).ravel(), symbols.ravel()
        order = np.argsort(flat, kind="stable")
        logp, back = self.log_probabilities(before.reshape(-1, h), flat, grads, weight, order)
        back = back.reshape(before.shape)
        z, r, new = parts
        # What a state's gradient is multiplied by on its way to the three parts of a step; ``inner`` is the third behind its gate.
        outer, inner = products, np.empty_like(before)
        np.subtract(before, new, out=outer[0])
        outer[0] *= z
        left = 1 - z
        outer[0] *= left
        new *= new
        np.subtract(1, new, out=new)
        new *= left
        np.subtract(1, r, out=left)
        outer[1] = outer[2]
        outer[1] *= r
        outer[1] *= left
        outer[1] *= new
        outer[2] = new
        weights = np.ascontiguousarray(self.u.reshape(h, 3, h).transpose(1, 2, 0))
        dh, through = np.zeros_like(before[0]), np.empty_like(outer[:, 0])
        places = _places(fresh)
        for t in range(steps - 1, -1, -1):
            now = outer[:, t]
            now *= dh
            np.multiply(now[2], r[t], out=inner[t])
            np.matmul(now[:2], weights[:2], out=through[:2])
            np.matmul(inner[t], weights[2], out=through[2])
            dh *= z[t]
            dh += back[t]
            for part in through:
                dh += part
            if len(places[t]):
                dh[places[t]] = 0
        states = before.reshape(-1, h).T
        for k, part in enumerate((outer[0], outer[1], inner)):
            grads.u[:, k * h : (k + 1) * h] += states @ part.reshape(-1, h)
        own = flat[order]
        begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        rows = np.take(outer.reshape(3, -1, h), order, axis=1)
        if h % 2 == 0:
            rows = rows.view(np.complex64)  # two sums at once: the time goes by runs of symbols, not by their length
        sums = np.add.reduceat(rows, begin, axis=1).view(np.float32)
        grads.x.reshape(-1, 3, h)[own[begin]] += sums.swapaxes(0, 1)
        return after, float(-(logp * weight).sum())

    def gradients(self, symbols: np.ndarray, fresh: np.ndarray, live: np.ndarray, state: np.ndarray) -> tuple[Network, np.ndarray, float]:
        """Gradient of the mean loss of a window, the last state and the loss."""
        grads = Network(self.s)
        return grads, *self.add_gradients(grads, symbols, fresh, live / max(1, live.sum()), state)


def _places(fresh: np.ndarray) -> list[np.ndarray]:
    """The lanes that are marked at each time."""
    time, lane = np.nonzero(fresh)
    edges = np.searchsorted(time, np.arange(len(fresh) + 1)).tolist()
    return [lane[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _beside(table: np.ndarray, n: int) -> np.ndarray:
    """``n`` windows that follow each other along axis 1, laid beside each other along axis 2."""
    parts, steps, lanes, *rest = table.shape
    return table.reshape(parts, n, steps // n, lanes, *rest).swapaxes(1, 2).reshape(parts, steps // n, n * lanes, *rest)


def lanes(lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lane and the first place of each document, longest first to the shortest lane, and the sizes of the lanes, longest first."""
    n = max(1, min(n, len(lengths)))
    heap = [(0, k) for k in range(n)]
    lane, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for d in np.argsort(-lengths, kind="stable").tolist():
        size, k = heap[0]
        lane[d], place[d] = k, size
        heapq.heapreplace(heap, (size + int(lengths[d]), k))
    sizes = np.zeros(n, np.int64)
    sizes[[k for _, k in heap]] = [size for size, _ in heap]
    order = np.argsort(-sizes, kind="stable")
    return np.argsort(order)[lane], place, sizes[order]


class Stream:
    """Documents laid out in lanes as a (time, lane) table of symbols; a window holds the lanes that have begun.

    All lanes end together, so what is learned last comes from all lanes and not from the longest document alone.
    """

    def __init__(self, symbols: np.ndarray, first: np.ndarray, n: int, pad: int):
        lengths = np.diff(first)
        lane, place, sizes = lanes(lengths, n)
        shape = int(sizes[0]), len(sizes)
        self.begin = sizes[0] - sizes
        place += self.begin[lane]
        self.doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self.time = (np.arange(len(symbols)) - np.repeat(first[:-1] - place, lengths)).astype(np.int32)
        self.lane = lane.astype(np.int16)[self.doc]
        self.symbols = np.full(shape, pad, np.int16)
        self.symbols[self.time, self.lane] = symbols
        self.live = np.zeros(shape, bool)
        self.live[self.time, self.lane] = True
        self.fresh = np.zeros(shape, bool)
        self.fresh[place, lane] = True

    def windows(self, size: int, least: float = 0) -> Iterator[tuple[slice, slice, int, int]]:
        """Times, lanes, number and live cells of runs of windows.

        Without ``least`` every window is a run. With it, windows follow in one until they have that many live cells, with the
        runs before that had too few; a run ends, too, where the lanes more than double.
        """
        steps = len(self.symbols)
        live = np.add.reduceat(self.live.sum(1), np.arange(0, steps, size)).tolist()
        begin = held = cells = 0
        for k, count in enumerate(live):
            to, held, cells = (k + 1) * size, held + count, cells + count
            if cells < least and to + size <= steps and self._begun(to + size) <= 2 * self._begun(begin + size):
                continue
            yield slice(begin, to), slice(0, self._begun(to)), (to - begin) // size, held
            begin, held, cells = to, 0, 0 if cells >= least else cells

    def _begun(self, t: int) -> int:
        return int(np.searchsorted(self.begin, t, "left"))


class Adam:
    """The running moments of one replica."""

    def __init__(self, net: Network):
        self.mean, self.square, self.step = np.zeros_like(net.values), np.zeros_like(net.values), 0

    def move(self, net: Network, g: np.ndarray, rate: float) -> None:
        norm = float(np.sqrt(g @ g))
        if norm > 1:
            g = g / norm
        self.step += 1
        self.mean *= 0.9
        self.mean += 0.1 * g
        self.square *= 0.99
        square = g * g
        square *= 0.01
        self.square += square
        by = np.sqrt(self.square, out=square)
        by *= (1 - 0.99**self.step) ** -0.5
        by += 1e-6
        np.divide(self.mean, by, out=by)
        by *= rate * min(1, self.step / 20) / (1 - 0.9**self.step)
        net.values -= by


def train_replica(net: Network, symbols: np.ndarray, first: np.ndarray, done: float = 0.0, adam: Adam | None = None) -> tuple[Network, int]:
    """One pass of Adam over every token of some documents, and their number; ``done`` is the share of the rounds behind.

    Windows with few live cells, as the first ones of the longest documents, add up to a quarter of a full
    window before a step is taken, each token with the same weight; what is left takes a step as small as it is.
    """
    s = net.s
    adam = adam or Adam(net)
    stream = Stream(symbols, first, s.train_lanes, s.symbols - 1)
    rate, least = s.rate * (1 - 0.7 * done), s.window * s.train_lanes / 4
    state = np.zeros((stream.symbols.shape[1], s.hidden), np.float32)
    grads, cells, learned = Network(s), 0, 0
    for *part, n, live in stream.windows(s.window, least):
        part = tuple(part)
        state[part[1]], _ = net.add_gradients(grads, stream.symbols[part], stream.fresh[part], stream.live[part], state[part[1]], n)
        cells, learned = cells + live, learned + live
        if cells >= least:
            adam.move(net, grads.values / cells, rate)
            grads.values[:], cells = 0, 0
    if cells:
        adam.move(net, grads.values / cells, rate * cells / least)
    return net, learned


def score_stream(net: Network, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the natural log-probabilities of the symbols of each document."""
    s = net.s
    stream = Stream(symbols, first, s.score_lanes, s.symbols - 1)
    logp = np.zeros(stream.symbols.shape, np.float32)
    state = np.zeros((stream.symbols.shape[1], s.hidden), np.float32)
    for *part, _, _ in stream.windows(s.window, s.window * s.score_lanes / 2):
        part = tuple(part)
        before, state[part[1]], _ = net.run(stream.symbols[part], stream.fresh[part], state[part[1]])
        live = np.flatnonzero(stream.live[part])
        found, _ = net.log_probabilities(before.reshape(-1, s.hidden).take(live, 0), stream.symbols[part].ravel().take(live))
        logp[part][stream.live[part]] = found
    return np.add.reduceat(logp[stream.time, stream.lane].astype(np.float64), first[:-1])


def _coded(column: pa.Array, v: Vocabulary, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all documents with their ends, first symbols, and hashes (0 for ends)."""
    symbols, hashes, sizes = [], [], []
    for _, h, kinds, first in tokens(column):
        n = len(first) - 1
        row = textvec.row_of(first, len(h))
        at = np.arange(len(h)) + row
        ends = first[1:] + np.arange(n)
        symbol, key = np.full(len(h) + n, s.symbols - 1, np.int32), np.zeros(len(h) + n, np.uint64)
        symbol[at], key[at] = v.code(h, kinds, s), h
        symbols.append(symbol)
        hashes.append(key)
        sizes.append(np.diff(np.concatenate([[0], ends + 1])))
    if not sizes:
        return np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(symbols), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(hashes)


def _parts(column: pa.Array, v: Vocabulary, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols and first symbols of runs of whole documents of about ``train_tokens`` tokens."""
    sizes = np.diff(textvec.flat(column)[1])
    step = np.cumsum(sizes) // (6 * s.train_tokens)  # about six bytes a token
    edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(sizes)] if len(sizes) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        symbols, first, _ = _coded(column.slice(a, b - a), v, s)
        if len(symbols):
            yield symbols, first


def _averaged(sample: DataFrame, net: Network, v: Vocabulary, done: float) -> Network:
    """One round: replicas trained by the tasks of ``sample`` and averaged, weighted by what each learned from."""
    shared = sample.sparkSession.sparkContext.broadcast((net.values, v))
    s = net.s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, vocabulary = shared.value
        replica, weight = Network(s, values.copy()), 0
        adam = Adam(replica)
        for batch in batches:
            for symbols, first in _parts(batch.column(0), vocabulary, s):
                replica, learned = train_replica(replica, symbols, first, done, adam)
                weight += learned
        if weight:
            size = 256
            rows = [(k, float(weight), (replica.values[k : k + size].astype(np.float64) * weight).tolist()) for k in range(0, len(replica.values), size)]
            part, weights, lists = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(weights), pa.array(lists, pa.list_(pa.float64()))], ["part", "weight", "v"])

    replicas = sample.mapInArrow(run, "part int, weight double, v array<double>")
    sums = replicas.select("part", "weight", F.posexplode("v").alias("at", "value")).groupBy("part", "at").agg((F.sum("value") / F.sum("weight")).alias("value"))
    rows = sums.collect()  # one row a parameter
    if not rows:
        return net
    values = np.zeros_like(net.values)
    values[[r.part + r["at"] for r in rows]] = [r.value for r in rows]
    return Network(s, values)


def scored_part(net: Network, v: Vocabulary, column: pa.Array, keys: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Tokens, known tokens, training tokens, base score and score of some texts, given the sorted hashes and counts of the words known."""
    s = net.s
    symbols, first, hashes = _coded(column, v, s)
    end = symbols == s.symbols - 1
    known = np.zeros(len(hashes), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        known = np.where(keys[at] == hashes, counts[at], 0)
    known[end] = v.docs
    base = np.add.reduceat(np.log10(known + 1.0), first[:-1]) - np.diff(first) * np.log10(v.total + v.distinct + 1.0)
    tail = (symbols >= s.top) & ~end
    inside = np.zeros(len(symbols))
    inside[tail] = np.log((known[tail] + 1.0) / v.tail_room[symbols[tail] - s.top])
    total = score_stream(net, symbols, first) + np.add.reduceat(inside, first[:-1])
    n = len(first) - 1
    return [np.diff(first), np.add.reduceat((known > 0).astype(np.int64), first[:-1]), np.full(n, v.total, np.int64), base, total / np.log(10)]


def scores(docs: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score and score."""
    text = F.coalesce(F.col("text"), F.lit(""))
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    rows = docs.select("doc_id", text.alias("text"), F.coalesce(remainder == HELD, F.lit(False)).alias("held_out"), F.xxhash64("doc_id", text).alias("key"))
    training = rows.where("not held_out")
    counts = written(count_words(training.select("text")), "counts")
    n_docs, _ = training.agg(F.count("*"), F.lit(0)).first()
    by_tail = {r.tail: (r.c, r.v) for r in counts.groupBy("tail").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    top = [(r.h, r.tail, r.c) for r in counts.orderBy(F.desc("c"), "h").limit(s.top).collect()]
    v = Vocabulary(top, by_tail, n_docs, s)

    net = Network.initial(s, v)
    chosen = training if s.train_share >= 1 else training.where(F.pmod(F.col("key"), F.lit(1_000_000)) < int(1e6 * s.train_share))
    for k in range(s.rounds):
        net = _averaged(chosen.select("text"), net, v, k / s.rounds)

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // s.block_bytes) or 1
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).select("block", "doc_id", "held_out", "text").repartition("block")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy(zero_copy_only=False)
            held = [(block[a + textvec.row_of(first, len(h))], h) for a, h, _, first in tokens(batch.column(1))]
            own, h = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int32), np.zeros(0, np.uint64))
            for k in np.unique(own):
                distinct = np.sort(h[own == k])
                distinct = distinct[np.concatenate([[True], distinct[1:] != distinct[:-1]])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(distinct), k, np.int32)), pa.array(distinct.view(np.int64))], ["block", "h"])

    wanted = dealt.select("block", "text").mapInArrow(words, "block int, h long").distinct()
    known = wanted.join(counts.select("h", "c"), "h").select("block", "h", "c")
    shared = docs.sparkSession.sparkContext.broadcast((net.values, v))
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        values, vocabulary = shared.value
        net = Network(s, values)
        types = [left.schema.field("doc_id").type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        keys, c = right.column("h").to_numpy().view(np.uint64), right.column("c").to_numpy()
        order = np.argsort(keys)
        keys, c = keys[order], c[order]
        out = [pa.table({name: pa.array([], t) for name, t in zip(names, types, strict=True)})]
        if left.num_rows:
            text = left.column("text").combine_chunks()
            for a, b in textvec.slices(textvec.flat(text)[1], limit=s.part_bytes, docs=1 << 20):
                found = scored_part(net, vocabulary, text.slice(a, b - a), keys, c)
                arrays = [*(left.column(k).slice(a, b - a).combine_chunks() for k in ("doc_id", "held_out")), *found]
                out.append(pa.table(dict(zip(names, arrays, strict=True))))
        return pa.concat_tables(out)

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, schema)
