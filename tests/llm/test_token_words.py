"""Words that go to the tokenizer without marks between them."""

import random

from kmerloom.llm import token_orc


def coder():
    return token_orc.Coder(token_orc._file())


def test_plain_words_need_no_marks(monkeypatch):
    """Letters of ASCII and Latin-1, with or without a tail, are asked as words alone, in lower case and once."""
    own, sent = coder(), []
    ids = own._ids
    monkeypatch.setattr(own, "_ids", lambda text: sent.append(text) or ids(text))
    own.encode(["Engeä. engeä ENGEÄ,; word Word. worn ß ÿ ÀÖØ"])
    assert sorted(x for s in sent if token_orc._MARK not in s for x in s.split()) == sorted(["engeä", "word", "worn", "ß", "ÿ", "àöø"])
    assert not any(c.isalpha() for s in sent if token_orc._MARK in s for c in s)


def test_ids_are_the_librarys():
    own, r = coder(), random.Random(3)
    parts = ["a", "Z", "ß", "Ä", "ÿ", "×", "÷", "µ", "ª", "İ", "Σ", "ς", "́", "Å", "क़", "'s", "'S", "'", "0", "12", "²", ".", "**", "#", "-", "é", "é", "中", "я", "<|endoftext|>", "­", "\x1c", "\xa0", "≠", "ﬁ", "ǅ", "word", "ing"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(1, 7))) for _ in range(4000)] + ["x" * 3000, "é" * 2000 + ".", ""]
    texts = [" ".join(texts[i : i + 7]) for i in range(0, len(texts), 7)]
    want = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [list(memoryview(x).cast("i")) for x in own.encode(texts)] == want


def test_words_without_an_end_are_asked_with_marks(monkeypatch):
    own, other = coder(), coder()
    own.last[:] = False
    other.last = None
    words = ["some words, of Letters alone", "and Größe again."]
    assert own.encode(words) == other.encode(words) == coder().encode(words)
