"""What op1_lm_scoring spends its time on: words cut and looked up by batch, and windows that touch no more of the network than they must."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from kmerloom.llm import lm

PIECES = [b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"A", b"b", b"\xc3\x84", b"\x1c", b"\x85", b"\xa0", b"\x00", b"Zz"]


def plain(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text or b""))


def some(rng):
    texts = [None if rng.random() < 0.05 else b"".join(rng.choices(PIECES, k=rng.choice([0, 1, 2, 5, 30]))) for _ in range(rng.choice([0, 1, 2, 9]))]
    return texts, pa.array([b"before x", *texts, b"y"], pa.binary())[1 : 1 + len(texts)]


def test_words_of_a_batch():
    rng = random.Random(1)
    for _ in range(200):
        texts, batch = some(rng)
        words, per_text = lm.tokens(batch)
        assert words.to_pylist() == [w for t in texts for w in plain(t)] and per_text.tolist() == [len(plain(t)) for t in texts]
        cuts = [batch[s] for s in lm.sized(batch, 7)]
        assert [t for c in cuts for t in c.to_pylist()] == texts and all(len(c) == 1 or sum(len(t or b"") for t in c.to_pylist()) <= 7 for c in cuts)


def test_codes_of_a_batch():
    """Ranks, rest classes and rare words as looked up word by word, with the end among the commonest words and not."""
    rng = random.Random(2)
    for head in ([b"a", b"b", lm.END, b"zz"], [b"b", b"zz"], []):
        v = lm.Vocabulary(head, [9] * len(head), 9 * len(head), len(head), [(1, 1)] * lm.REST)
        for _ in range(60):
            texts, batch = some(rng)
            ranks, rare = v.code(batch)
            for t, own, others in zip(texts, ranks.to_pylist(), rare.to_pylist(), strict=True):
                words = [*plain(t), lm.END]
                assert np.frombuffer(own, "<i4").tolist() == [head.index(w) if w in head else -1 - lm.rest_class(w) for w in words]
                assert {x["word"]: x["n"] for x in others} == Counter(w for w in words if w not in head) and len({x["word"] for x in others}) == len(others)


def test_orders_are_stable():
    rng = np.random.default_rng(3)
    for most in (1, 50, 1 << 16, 1 << 20):
        x = rng.integers(0, most, 3000).astype(np.int32)
        assert (lm._order(x) == np.argsort(x, kind="stable")).all()
    assert len(lm._order(np.zeros(0, np.int32))) == 0


def test_windows_touch_what_they_meet(monkeypatch):
    """A long text alone in its lane steps the words of the classes that it meets; the bound of logits is not taken for every window."""
    v = lm.Vocabulary([b"w%d" % i for i in range(5000)], [10_000 // (i + 10) for i in range(5000)], 200_000, 5000, [(1, 1)] * lm.REST)
    flat = lm.Network.fresh(v)
    state = np.concatenate([flat, np.ones(len(flat), np.float32)])
    run = lm.Runner(v, state[: len(flat)], state[len(flat) :])
    words, bounds = [], []
    step, bound = run._step, lm.Network.bound
    run._step = lambda name, g, *more: (words.append(len(g)) if name == "ow" else None, step(name, g, *more))
    monkeypatch.setattr(lm.Network, "bound", lambda net: bounds.append(bound(net)) or bounds[-1])
    text = np.tile(np.array([v.model - 1, 3], np.int32), 400)
    run.run([text], 1, 0.01)
    windows = len(text) // lm.WINDOW
    assert 0 < sum(words) < windows * v.model / 4
    assert 0 < len(bounds) < windows / 4 and bound(run.net) <= 60
    run.run([text], 1)
    assert 0 < len(bounds) < windows / 4
