"""Language-model scoring: a gated recurrent network with a class-factored output, trained by truncated backpropagation in numpy.

Counts. The words of all training texts are counted. The ``HEAD`` commonest, a fixed number, go to every task; what rarer words
of a text count is found by a join on the word.

Model. The commonest words that together make up ``SHARE`` of the counted tokens, ``MODEL`` at least, have an embedding and an output row
of their own, so their number grows with the corpus, up to the ``HEAD`` words that every task holds. They are put into classes of about
equal root frequency, as many as make the two softmaxes of about equal cost, ``CLASSES`` at least; all other words fall into further
classes by their last two bytes. A token's probability is that of its class given the state, times that of the word within the class: a
second softmax for the modelled words, the add-one frequency within the class for others, so unseen words have one too.

Training. Every training text is read once. A hash of its id and words deals it to a round and to a learner, a sub-corpus of
``PER_PARAMETER`` tokens for each parameter, ``LEARN_TOKENS`` at least, in an order by that hash: what is learnt does not depend on how the
input is cut into partitions, and there are more learners, not longer ones, the more texts there are. Coded texts are written by round, so
that a round reads its own alone. In a round each learner starts from the same parameters, with the state carried from window to window of
a text, and their parameters are averaged, weighted by tokens, in two steps of bounded size. A learner sends eight bytes a parameter and
reads four a token, so the first step of averaging sends at most half of the bytes that the round reads, before compression and whatever the
vocabulary, and the second step no more than the first. Output biases start at the counted frequencies.

Scoring carries the state through each whole text, however long.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.common import ship, table, written

HEAD = 200_000
#: The share of tokens whose words are modelled, and the least numbers of modelled words and of their classes.
SHARE = 0.7
MODEL, CLASSES, REST = 2048, 32, 64
DIM = HIDDEN = 16
WINDOW, LANES, SCORE_LANES = 32, 256, 256
#: Scoring carries the state on from window to window, so its windows are as long as suits the machine.
SCORE_WINDOW = 64
ROUNDS = 4
#: Tokens that a learner sees in a round, about: so many for each parameter, and the least.
PER_PARAMETER, LEARN_TOKENS = 4, 500_000
RATE = 0.08
BLOCK = 4096
#: Numbers that a core's cache holds, about: larger arrays are gone through in blocks of so many.
CACHED = 1 << 16
CHUNK_TOKENS = 1 << 22
#: The end of a text among the words, none of which is empty.
END = b""
LOG10 = math.log(10)


#: Bytes of text that are cut into words at once; a longer text is handled by itself.
TEXT_BYTES = 1 << 21
SPACES = b" \t\n\v\f\r"
#: A-Z to lower case, and any space to a blank.
LOWER = bytes.maketrans(SPACES, b" " * len(SPACES)).lower()


def give_back() -> None:
    """Returns memory that Arrow holds for later to the machine: workers are used again, by tasks that need theirs elsewhere."""
    pa.default_memory_pool().release_unused()


def sized(texts: pa.BinaryArray, most: int = TEXT_BYTES) -> Iterator[slice]:
    """Cuts of the texts, none empty, of at most so many bytes or of one text."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(texts):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield slice(at, to)
        at = to


def tokens(texts: pa.BinaryArray) -> tuple[pa.BinaryArray, np.ndarray]:
    """The words of the texts one after the other, in lower case (A-Z only) and without ends, and how many each text has."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    first, last = int(offsets[0]), int(offsets[-1])
    if first == last:
        return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
    raw = texts.buffers()[2].slice(first, last - first).to_pybytes()
    word = np.frombuffer(raw.translate(LOWER), np.uint8) != 32
    # a word starts at a byte of it after a space or at the start of a text
    start = word.copy()
    np.greater(word[1:], word[:-1], out=start[1:])
    edges = offsets - first
    heads = edges[:-1][edges[:-1] < last - first]
    start[heads] = word[heads]
    per_text = np.diff(np.searchsorted(np.flatnonzero(start), edges))
    own = raw.translate(LOWER, SPACES)
    at = np.append(np.flatnonzero(start[word]), len(own)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(own)]), per_text


def rest_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % REST


#: The rest classes of words that end in two given bytes, and of words of one byte.
REST_OF_TWO = np.array([rest_class(bytes([a, b])) for a in range(256) for b in range(256)], np.int32).reshape(256, 256)
REST_OF_ONE = np.array([rest_class(bytes([a])) for a in range(256)], np.int32)


def rest_classes(words: pa.BinaryArray) -> np.ndarray:
    """``rest_class`` of each of the words, none of which is empty."""
    if not len(words):
        return np.zeros(0, np.int32)
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset)
    data, last = np.frombuffer(words.buffers()[2], np.uint8), offsets[1:] - 1
    return np.where(last > offsets[:-1], REST_OF_TWO[data[last - 1], data[last]], REST_OF_ONE[data[last]])


def modelled(counts: np.ndarray, total: int) -> int:
    """How many of the commonest words, given by falling count, the network knows: all up to SHARE of the tokens, MODEL at least."""
    return min(len(counts), max(MODEL, int(np.searchsorted(np.cumsum(counts), SHARE * total)) + 1))


class Vocabulary:
    """The commonest words with counts, ordered by falling count, and the totals that scores need."""

    def __init__(self, words: list[bytes], counts: list[int], total: int, distinct: int, rest: list[tuple[int, int]]):
        self.words = pa.array(words, pa.binary())
        self.count = np.array(counts, np.int64)
        self.total, self.distinct = total, distinct
        self.model = modelled(self.count, total)
        self.rows = max(MODEL, self.model)
        self.rest = np.array(rest, np.float64).reshape(REST, 2)
        mass = np.sqrt(self.count[: self.model].astype(np.float64))
        # with k classes a token costs about k columns of the first softmax and (sum of root frequencies)^2 / k of the second
        self.classes = max(CLASSES, round(float(mass.sum()) / math.sqrt(max(total, 1))))
        at = np.minimum((np.cumsum(mass) - mass) / max(mass.sum(), 1e-9) * self.classes, self.classes - 1).astype(np.int64)
        self.class_of = np.concatenate([at, np.array([self.classes + rest_class(w) for w in words[self.model :]], np.int64)])
        self.start = np.searchsorted(at, np.arange(self.classes + 1))

    def code(self, texts: pa.BinaryArray) -> tuple[pa.BinaryArray, pa.ListArray]:
        """For each text the ranks of its tokens (little-endian 32-bit integers), -1 - rest class where one is not among the commonest words,
        and those other words with how often they occur. Each distinct word is looked up once."""
        words, per_text = tokens(texts)
        coded = words.dictionary_encode()
        # the end is the last of the distinct words
        distinct = pa.concat_arrays([coded.dictionary, pa.array([END], pa.binary())])
        ranks = pc.fill_null(pc.index_in(distinct, self.words), -1).to_numpy()
        ranks = np.where(ranks < 0, -1 - np.append(rest_classes(coded.dictionary), np.int32(rest_class(END))), ranks)
        ends = np.concatenate(([0], np.cumsum(per_text + 1)))
        text = np.repeat(np.arange(len(texts)), per_text + 1)
        each = np.full(ends[-1], len(distinct) - 1, np.int32)
        is_word = np.ones(len(each), bool)
        is_word[ends[1:] - 1] = False
        each[is_word] = coded.indices.to_numpy()
        own = ranks[each].astype("<i4", copy=False)
        rare = np.flatnonzero(own < 0)
        pairs, n = np.unique(text[rare] * len(distinct) + each[rare], return_counts=True)
        found = distinct.take(pa.array(pairs % len(distinct)))
        counts = pa.StructArray.from_arrays([found, pa.array(n, pa.int32())], names=["word", "n"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs, np.arange(len(texts) + 1) * len(distinct)), pa.int32()), counts)
        return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(own)]), lists

    def inputs(self, ranks: np.ndarray) -> np.ndarray:
        """Input rows: a word's own if it is in the model, else its class's."""
        cls = np.concatenate([self.class_of, self.classes + np.arange(REST)[::-1]])[ranks]
        return np.where((ranks >= 0) & (ranks < self.model), ranks, self.rows + cls - self.classes).astype(np.int32), cls.astype(np.int32)


class Network:
    """Parameters as one flat vector, with views; SIZE is that of the smallest network."""

    @staticmethod
    def shapes(model: int = MODEL, classes: int = CLASSES) -> dict[str, tuple[int, ...]]:
        return {"emb": (model + REST + 1, DIM), "wx": (DIM, 3 * HIDDEN), "wh": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "cw": (HIDDEN + 1, classes + REST), "ow": (model, HIDDEN + 1)}

    @classmethod
    def size(cls, model: int = MODEL, classes: int = CLASSES) -> int:
        return sum(math.prod(s) for s in cls.shapes(model, classes).values())

    def __init__(self, flat: np.ndarray, model: int = MODEL, classes: int = CLASSES):
        self.flat, at = flat, 0
        for name, shape in self.shapes(model, classes).items():
            n = math.prod(shape)
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n
        # the last row and the last column of the output weights belong to a state that is always 1
        self.cb, self.ob = self.cw[HIDDEN], self.ow[:, HIDDEN]

    def bound(self) -> float:
        """What no logit exceeds, as states are within -1 and 1."""
        most, one, size = float(np.abs(self.cw).sum(0).max()), np.ones(HIDDEN + 1, np.float32), CACHED // (HIDDEN + 1)
        return max(most, *(float((np.abs(self.ow[a : a + size]) @ one).max()) for a in range(0, len(self.ow), size)))

    @classmethod
    def fresh(cls, v: Vocabulary, seed: int = 5) -> np.ndarray:
        rng = np.random.default_rng(seed)
        net = cls(np.zeros(cls.size(v.rows, v.classes), np.float32), v.rows, v.classes)
        net.emb[:] = rng.normal(0, 0.3, net.emb.shape)
        net.wx[:] = rng.normal(0, DIM**-0.5, net.wx.shape)
        net.wh[:] = rng.normal(0, 0.7 * HIDDEN**-0.5, net.wh.shape)
        own = v.count[: v.model].astype(np.float64)
        net.ob[: v.model] = np.log(np.maximum(own, 1))
        mass = np.concatenate([np.bincount(v.class_of[: v.model], own, v.classes), v.rest[:, 0] + 0.5])
        mass = np.maximum(mass, 1e-12 * mass.sum())  # a class without words takes nothing
        net.cb[:] = np.log(mass / mass.sum())
        return net.flat


Network.SIZE = Network.size()


#: What the gates' weights are multiplied by before use: ``_sigmoid`` takes half of its argument.
HALF = np.repeat(np.float32([0.5, 0.5, 1]), HIDDEN)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-2x)) as a tanh, which needs no bounds, in place."""
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


def _softmax(x: np.ndarray, at: np.ndarray, shift: bool, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The logit of each row at its place among all of x, and the row sums of exp(x), which x becomes: the log softmax is the former less the
    log of the latter. With ``shift``, where exp might leave the range of floats, rows are first moved to a maximum of 0."""
    if shift:
        x -= x.max(1, keepdims=True)
    own = x.reshape(-1).take(at)
    np.exp(x, out=x)
    return own, x @ ones


def _order(x: np.ndarray) -> np.ndarray:
    """A stable order of whole numbers from 0 on, sorted by 16 bits at a time, as numpy sorts those by counting."""
    low = np.argsort(x.astype(np.uint16), kind="stable")
    if not len(x) or x.max() < 1 << 16:
        return low
    return low[np.argsort((x >> 16).astype(np.uint16)[low], kind="stable")]


def pack(texts: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid one after the other into lanes of about equal length, longest lane first: text number and place, -1 where a lane has
    ended; time first."""
    lanes = min(lanes, max(1, len(texts)))
    sizes = np.array([len(t) for t in texts])
    held: list[list[int]] = [[] for _ in range(lanes)]
    import heapq

    heap = [(0, i) for i in range(lanes)]
    for t in np.argsort(-sizes, kind="stable").tolist():
        n, i = heap[0]
        held[i].append(t)
        heapq.heapreplace(heap, (n + int(sizes[t]), i))
    held.sort(key=lambda own: -sum(int(sizes[t]) for t in own))
    length = max(n for n, _ in heap)
    number, place = np.full((lanes, length), -1, np.int32), np.zeros((lanes, length), np.int32)
    for i, own in enumerate(held):
        at = 0
        for t in own:
            number[i, at : at + sizes[t]] = t
            place[i, at : at + sizes[t]] = np.arange(sizes[t])
            at += sizes[t]
    return np.ascontiguousarray(number.T), np.ascontiguousarray(place.T)


class Runner:
    """Runs a network over packed texts, window by window. Large arrays are kept from window to window, as fresh memory costs more than
    the sums in it."""

    def __init__(self, v: Vocabulary, flat: np.ndarray, squares: np.ndarray | None = None):
        self.v, self.net = v, Network(flat, v.rows, v.classes)
        self.squares = Network(squares, v.rows, v.classes) if squares is not None else None
        self.first = v.rows + REST
        self.held: dict[str, np.ndarray] = {}

    def buffer(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size, np.float32)
        return self.held[name][:size].reshape(shape)

    def run(self, texts: list[np.ndarray], lanes: int, rate: float = 0.0) -> np.ndarray:
        """Natural log probability of each text (given as ranks) without the share of words within rest classes; learns at a rate above 0."""
        if not texts:
            return np.zeros(0)
        number, place = pack(texts, lanes)
        flat = np.concatenate(texts).astype(np.int32)
        starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))[:-1].astype(np.int32)
        live = number >= 0
        keep = live & (place > 0)
        place += np.where(live, starts[number], 0)
        place[~live] = 0
        ins, cls = self.v.inputs(flat)
        x = np.where(keep, ins[place - keep], np.int32(self.first))
        y, c = flat[place], cls[place]
        del place, ins, cls, flat
        h = np.zeros((HIDDEN, number.shape[1]), np.float32)
        logs = np.zeros(number.shape, np.float32)
        most, steps = math.inf, WINDOW if rate else SCORE_WINDOW
        for at in range(0, len(number), steps):
            n = int(live[at].sum())
            s = (slice(at, at + steps), slice(0, n))
            if most > 60:
                most = self.net.bound()
            self.shift = most > 60
            h, logp = self.window(x[s], y[s], c[s], keep[s].astype(np.float32), live[s], h[:, :n], rate)
            logs[s] = logp.reshape(-1, n)
            most += (HIDDEN + 1) * rate  # a step moves no weight by more than the rate
        return np.bincount(number[live], logs[live].astype(np.float64), len(texts))

    def window(self, x, y, c, keep, live, h, rate):
        net, buffer = self.net, self.buffer
        steps, lanes = x.shape
        total_rows = steps * lanes
        emb = np.take(net.emb, x.ravel(), 0, out=buffer("emb", total_rows, DIM), mode="clip")
        # within the recurrence, features come before lanes: each gate is then one piece of memory
        gates = np.matmul((net.wx * HALF).T, emb.reshape(steps, lanes, DIM).transpose(0, 2, 1), out=buffer("gates", steps, 3 * HIDDEN, lanes))
        bias = (net.b * HALF)[:, None]
        hs, part = buffer("hs", steps + 1, HIDDEN, lanes), buffer("part", HIDDEN, lanes)
        # what learning goes back over is kept for each step
        stored = steps if rate else 1
        kept, inner = buffer("kept", stored, HIDDEN, lanes), buffer("inner", stored, 3 * HIDDEN, lanes)
        wh = np.ascontiguousarray((net.wh * HALF).T)
        hs[0] = h
        for t in range(steps):
            p, u, g, out = kept[t % stored], inner[t % stored], gates[t], hs[t + 1]
            np.multiply(hs[t], keep[t], out=p)
            np.matmul(wh, p, out=u)
            g += bias
            zr = g[: 2 * HIDDEN]
            zr += u[: 2 * HIDDEN]
            _sigmoid(zr)
            n = g[2 * HIDDEN :]
            n += np.multiply(g[HIDDEN : 2 * HIDDEN], u[2 * HIDDEN :], out=part)
            np.tanh(n, out=n)
            np.subtract(p, n, out=out)
            out *= g[:HIDDEN]
            out += n
        top = buffer("top", steps, lanes, HIDDEN + 1)
        top[:, :, :HIDDEN] = hs[1:].transpose(0, 2, 1)
        top[:, :, HIDDEN] = 1
        top = top.reshape(-1, HIDDEN + 1)
        live, y, c = live.ravel(), y.ravel(), c.ravel()
        rows, shift = np.arange(total_rows), self.shift
        # softmaxes are differentiated without going over all of them once more: what is divided by their sums are narrower factors
        # classes, in blocks of rows that stay in a core's cache from step to step
        classes, ow = self.v.classes, net.ow
        logp, back, dcw = np.empty(total_rows, np.float32), buffer("back", total_rows, HIDDEN), np.zeros((classes + REST, HIDDEN + 1), np.float32)
        across = np.ascontiguousarray(net.cw[:HIDDEN].T)
        size, ones = max(64, CACHED // (classes + REST)), np.ones(classes + REST, np.float32)
        for a in range(0, total_rows, size):
            s = slice(a, min(a + size, total_rows))
            at = rows[: s.stop - a] * (classes + REST) + c[s]
            logits = np.matmul(top[s], net.cw, out=buffer("logits", len(at), classes + REST))
            own, total = _softmax(logits, at, shift, ones)
            logp[s] = own - np.log(total)
            if rate:
                logits.reshape(-1)[at] -= total
                share = (live[s] / total)[:, None]
                np.matmul(logits, across, out=back[s])
                back[s] *= share
                dcw += logits.T @ (top[s] * share)
        # words within their class, class by class
        known = np.flatnonzero(live & (c < classes))
        known = known[_order(c[known])]
        edges = np.searchsorted(c[known], np.arange(classes + 1)).tolist()
        start = self.v.start.tolist()
        states = np.take(top, known, 0, out=buffer("states", len(known), HIDDEN + 1), mode="clip")
        inner_back, own, totals = buffer("inner_back", len(known), HIDDEN), np.zeros(len(known), np.float32), np.ones(len(known), np.float32)
        width, ones = np.diff(self.v.start), np.ones(max(len(ow), 1), np.float32)
        ck = c[known]
        places = (rows[: len(known)] - np.array(edges)[ck]) * width[ck] + (y[known] - self.v.start[ck])
        met: list[list[int]] = []
        if rate:
            inner_back[:], grad = 0, buffer("grad", *ow.shape)
        for k in range(classes):
            a, b = edges[k], edges[k + 1]
            lo, hi = start[k], start[k + 1]
            if a == b or hi - lo == 1:
                continue
            q = np.matmul(states[a:b], ow[lo:hi].T, out=buffer("q", b - a, hi - lo))
            at = places[a:b]
            own[a:b], total = _softmax(q, at, shift, ones[: hi - lo])
            totals[a:b] = total
            if rate:
                q.reshape(-1)[at] -= total
                np.matmul(q, ow[lo:hi, :HIDDEN], out=inner_back[a:b])
                np.matmul(q.T, states[a:b] / total[:, None], out=grad[lo:hi])
                if met and met[-1][1] == lo:
                    met[-1][1] = hi
                else:
                    met.append([lo, hi])
        logp[known] += own - np.log(totals)
        if rate:
            inner_back /= totals[:, None]
            back[known] += inner_back
            self._step("cw", np.ascontiguousarray(dcw.T), rate)
            for lo, hi in met:  # words of other classes have no gradient
                self._step("ow", grad[lo:hi], rate, slice(lo, hi))
            self._back(x, keep, back.reshape(steps, lanes, HIDDEN), emb, kept, gates, inner, rate)
        return hs[-1].copy(), logp

    def _back(self, x, keep, back, emb, kept, gates, inner, rate):
        net, buffer = self.net, self.buffer
        steps, lanes = x.shape
        ahead = buffer("ahead", steps, HIDDEN, lanes)
        ahead[:] = back.transpose(0, 2, 1)
        dgate, du = buffer("dgate", steps, 3 * HIDDEN, lanes), buffer("du", 3 * HIDDEN, lanes)
        dwh = np.zeros_like(net.wh)
        dh = np.zeros((HIDDEN, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            dh += ahead[t]
            p, u, g, d = kept[t], inner[t][2 * HIDDEN :], gates[t], dgate[t]
            z, r, n = g[:HIDDEN], g[HIDDEN : 2 * HIDDEN], g[2 * HIDDEN :]
            dz = dh * z
            dn = d[2 * HIDDEN :]
            dh -= dz
            np.multiply(dh, 1 - n * n, out=dn)
            np.multiply(dz * (1 - z), p - n, out=d[:HIDDEN])
            dr = np.multiply(dn, r, out=du[2 * HIDDEN :])
            np.multiply(dr * (1 - r), u, out=d[HIDDEN : 2 * HIDDEN])
            du[: 2 * HIDDEN] = d[: 2 * HIDDEN]
            dwh += p @ du.T
            dz += net.wh @ du
            dh = np.multiply(dz, keep[t], out=dz)
        flat = buffer("flat", steps, lanes, 3 * HIDDEN)
        flat[:] = dgate.transpose(0, 2, 1)
        flat = flat.reshape(-1, 3 * HIDDEN)
        demb = np.matmul(flat, net.wx.T, out=buffer("demb", steps * lanes, DIM))
        self._step("wx", emb.T @ flat, rate)
        self._step("b", np.ones(len(flat), np.float32) @ flat, rate)
        self._step("wh", dwh, rate)
        ids = x.ravel()
        order = _order(ids)
        edge = np.flatnonzero(np.concatenate(([True], np.diff(ids[order]) != 0)))
        moved = np.take(demb, order, 0, out=buffer("moved", steps * lanes, DIM), mode="clip")
        self._step("emb", np.add.reduceat(moved, edge), rate, ids[order][edge])

    def _step(self, name, g, rate, at=slice(None)):
        """Each weight moves by its gradient over the root of the sum of its squares so far."""
        w, s = getattr(self.net, name)[at], getattr(self.squares, name)[at]
        size = max(1, CACHED // math.prod(g.shape[1:]))
        for a in range(0, len(g), size):
            d, root = g[a : a + size], s[a : a + size]
            np.clip(d, -50, 50, out=d)
            own = np.multiply(d, d, out=self.buffer("own", *d.shape))
            root += own
            np.sqrt(root, out=own)
            d *= np.float32(rate)
            d /= own
            w[a : a + size] -= d
        if not isinstance(at, slice):
            getattr(self.net, name)[at], getattr(self.squares, name)[at] = w, s


def counted(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts of ``docs(text)``, with the end of each text as the empty word. Tasks count before rows are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed():
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])

        rows = 0
        for b in batches:
            held.append(pa.table({"word": pa.array([END], pa.binary()), "c": pa.array([b.num_rows], pa.int64())}))
            for s in sized(b.column(0)):
                words, c = tokens(b.column(0)[s])[0].value_counts().flatten()
                held.append(pa.table({"word": words, "c": c}))
                rows += len(words)
                if rows > 600_000:
                    held = [summed()]
                    rows = held[0].num_rows
                    if rows > 400_000:
                        yield from held[0].to_batches()
                        held, rows = [], 0
        if held:
            yield from summed().to_batches()
        held.clear()
        give_back()

    return docs.select(F.col("text").cast("binary")).mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0")


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The commonest words and totals; what comes to the driver has a fixed size."""
    n, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # the least count of a common word, from a histogram of at most some hundred rows: no task sends its own commonest words
    step = F.floor(F.log2("c") * 16).cast("int")
    bins = {r["b"]: r["n"] for r in counts.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, room = max(bins, default=0) + 1, HEAD
    for b in sorted(bins, reverse=True):
        if bins[b] > room:
            break
        least, room = b, room - bins[b]
    head = counts.where(step >= least).select("word", "c").toArrow()
    top = sorted(zip(head.column("c").to_pylist(), head.column("word").to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    rest = np.zeros((REST, 2))
    last2 = F.expr("substring(word, greatest(octet_length(word) - 1, 1), 2)")
    for k, c, d in counts.groupBy((F.crc32(last2) % REST).cast("int").alias("k")).agg(F.sum("c"), F.count(F.lit(1))).collect():
        rest[k] = c, d
    for c, w in top[: modelled(np.array([c for c, _ in top], np.int64), n)]:
        rest[rest_class(w)] -= c, 1
    return Vocabulary([w for _, w in top], [c for c, _ in top], n, distinct, rest.tolist())


#: A text as ranks (little-endian 32-bit integers), with the words that are not among the commonest and how often they occur.
CODED = "row long, doc_id long, learn boolean, ranks binary, rare array<struct<word:binary,n:int>>"
#: The round of texts that nothing is learnt from.
NO_ROUND = -1


def learners_of(v: Vocabulary, rounds: int = ROUNDS) -> int:
    """How many learners a round has."""
    return max(1, -(-v.total // (rounds * max(LEARN_TOKENS, PER_PARAMETER * Network.size(v.rows, v.classes)))))


def coded(docs: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> DataFrame:
    """Each row of ``docs(doc_id, learn, text)`` as CODED, with a number of its own, its round (NO_ROUND where nothing is learnt from it), its
    learner and a hash, written by round. Rows that repeat both id and words share a round and a learner."""
    held = docs.sparkSession.sparkContext.broadcast(v)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for whole in batches:
            for s in sized(whole.column(2)):
                b = whole.slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + b.num_rows)), b.column(0), b.column(1), *held.value.code(b.column(2))], names=["row", "doc_id", "learn", "ranks", "rare"])
                row += b.num_rows
            give_back()

    rows = docs.select("doc_id", "learn", F.col("text").cast("binary").alias("text")).mapInArrow(code, CODED)
    rows = rows.withColumn("h", F.xxhash64("doc_id", "ranks", F.lit(7)))
    rows = rows.withColumn("learner", F.pmod(F.shiftright("h", 20), F.lit(learners_of(v, rounds))).cast("int"))
    rows = rows.withColumn("turn", F.when(F.col("learn"), F.pmod("h", F.lit(rounds))).otherwise(NO_ROUND).cast("int")).drop("learn")
    found = written(rows, "coded", by="turn")
    held.destroy()
    return found


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Batches and their ranks in groups of about CHUNK_TOKENS tokens; a longer text is a group by itself."""
    rows: list[pa.RecordBatch] = []
    texts: list[np.ndarray] = []
    size = 0
    for whole in batches:
        for at in range(0, whole.num_rows, 100):
            b = whole.slice(at, 100)
            own = [np.frombuffer(x.as_buffer(), "<i4") for x in b.column(b.schema.names.index("ranks"))]
            rows.append(b)
            texts += own
            size += sum(map(len, own))
            if size >= CHUNK_TOKENS:
                yield rows, texts
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows (block, learner, weight, values) of one block and one learner % 16, or of one block, to their weighted mean, under the
    first learner's number."""
    at, weight, total = None, 0.0, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([weight]), pa.array([(total / max(weight, 1e-9)).astype("<f4").tobytes()], pa.binary())], names=["block", "learner", "weight", "values"])

    for b in batches:
        for k, who, w, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if at is None or k != at[0]:
                if at is not None:
                    yield row()
                at, weight, total = (k, who), 0.0, np.zeros(len(v) // 4)
            total += w * np.frombuffer(v, "<f4")
            weight += w
    if at is not None:
        yield row()


def train(rows: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters learnt from all ``rows(ranks, h, learner, turn)`` with a round, as ``coded`` gives them for as many rounds."""
    spark = rows.sparkSession
    flat = Network.fresh(v)
    size, lanes = len(flat), LANES
    state = np.concatenate([flat, np.full(size, 1.0, np.float32)])
    learners = learners_of(v, rounds)
    held = spark.sparkContext.broadcast(v)
    schema = "block int, learner int, weight double, values binary"
    for turn in range(rounds):
        now = spark.sparkContext.broadcast(state)
        rate = RATE * (1 - 0.7 * turn / rounds)

        def learn(batches: Iterator[pa.RecordBatch], now=now, rate=rate) -> Iterator[pa.RecordBatch]:
            give_back()
            own, seen, learner = None, 0, 0
            for rows, texts in _batched(batches):
                if own is None:
                    own, learner = now.value.copy(), rows[0].column(1)[0].as_py()
                    runner = Runner(held.value, own[:size], own[size:])
                seen += sum(map(len, texts))
                runner.run(texts, lanes, rate)
            if seen:
                blocks = [own[i : i + BLOCK].astype("<f4").tobytes() for i in range(0, len(own), BLOCK)]
                n = len(blocks)
                yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([learner] * n, pa.int32()), pa.array([float(seen)] * n), pa.array(blocks, pa.binary())], names=["block", "learner", "weight", "values"])

        # a partition for each learner, in a fixed order
        part = rows.where(F.col("turn") == turn).select("ranks", "h", "learner").repartitionById(int(learners), F.col("learner")).sortWithinPartitions("h").select("ranks", "learner")
        got = part.mapInArrow(learn, schema)
        got = got.repartition("block", F.col("learner") % 16).sortWithinPartitions(F.col("learner") % 16, "block", "learner").mapInArrow(_merge, schema)
        got = got.repartition("block").sortWithinPartitions("block", "learner").mapInArrow(_merge, schema)
        for r in got.select("block", "values").toLocalIterator():
            values = np.frombuffer(bytes(r["values"]), "<f4")
            state[r["block"] * BLOCK : r["block"] * BLOCK + len(values)] = values
        now.destroy()
    held.destroy()
    return state[:size].copy()


#: What scoring says of a row before rare words are looked up.
SCORED = "row long, doc_id long, n_tokens long, n_known long, base double, model double"


def _scorer(held, params):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        v = held.value
        runner = Runner(v, params.value)
        # for each rank, then each rest class from the end: what base and model add within a class
        seen = np.concatenate([np.log(v.count + 1.0), np.zeros(REST)])
        rest = np.log(v.rest.sum(1) + 1)
        within = np.concatenate([np.zeros(v.model), seen[v.model : len(v.count)] - rest[v.class_of[v.model :] - v.classes], -rest[::-1]])
        for rows, texts in _batched(batches):
            logs = runner.run(texts, SCORE_LANES)
            sizes = np.array([len(t) for t in texts], np.int64)
            known = np.array([int((t >= 0).sum()) for t in texts], np.int64)
            base = np.array([seen[t].sum() for t in texts])
            logs += np.array([within[t].sum() for t in texts])
            at = 0
            for b in rows:
                s = slice(at, at := at + b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes[s]), pa.array(known[s]), pa.array(base[s]), pa.array(logs[s])], names=["row", "doc_id", "n_tokens", "n_known", "base", "model"])

    return score


def score(docs: DataFrame, train_on: Column, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs(doc_id, text)``, learning from the rows
    where ``train_on`` is true.

    Null, empty and blank texts are the end token alone; repeated rows are scored each; with nothing to learn from, all words
    are unknown and the base score is 0; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), train_on.alias("learn"), F.coalesce("text", F.lit("")).alias("text"))
    counts = written(counted(own.where("learn")), "counts")
    v = vocabulary(counts)
    rows = coded(own, v, rounds)
    held = [spark.sparkContext.broadcast(x) for x in (v, train(rows, v, rounds))]
    scored = written(rows.select("row", "doc_id", "ranks").mapInArrow(_scorer(*held), SCORED), "scored")
    for x in held:
        x.destroy()
    rare = rows.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.n")
    found = rare.join(counts, "word").groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log(F.col("c") + 1.0)).alias("seen"))
    both = scored.join(found, "row", "left")
    more, seen = F.coalesce("more", F.lit(0)), F.coalesce("seen", F.lit(0.0))
    each = math.log(v.total + v.distinct + 1)
    return both.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + more).cast("long").alias("n_known"),
        F.lit(int(v.total)).cast("long").alias("train_tokens"),
        ((F.col("base") + seen - F.col("n_tokens") * each) / LOG10).alias("base_score"),
        ((F.col("model") + seen) / LOG10).alias("score"),
    )


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(table(spark, sf_dir, "documents").select("doc_id", "text"), ~_held_out())
    return found.select("doc_id", _held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op1_lm_scoring": op1_lm_scoring}
ORACLES: dict[str, str] = {}
