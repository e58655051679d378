"""Encoding by distinct units gives the ids of whole texts."""

import random

import pytest

from quoteflow.llm import common
from quoteflow.llm.common import Encoder, tokenizer

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
PARTS = [
    " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\ufeff",
    "\u200b", "\u180e", "a", "the", "Don't", "we'll", "'s", "12", "3", ".", "...", "!?", "\xe9", "e\u0301", "\u0301",
    "\xdf", "\u0130", "\u03a3", "\u03c2", "\u65e5\u672c", "\ud55c", "\u1100\u1161", "<|endoftext|>", "<|startoftext|>",
    "</w>", "\u0120", "\U0001f600", "\U0001f469\u200d\U0001f4bb", "\x00", "_", "-", "x" * 70]


@pytest.mark.parametrize("file", FILES)
def test_random_texts(file):
    r, e = random.Random(1), Encoder(tokenizer(file))
    texts = ["".join(r.choices(PARTS, k=r.randrange(0, 14))) for _ in range(6000)]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x80, 0x3000), r.randrange(0x10000, 0x1F000)])) for _ in range(30))
              for _ in range(1500)]
    whole = [x.ids for x in e.tok.encode_batch(texts, add_special_tokens=False)]
    got = [x.tolist() for x in e.encode(texts)]
    for t, a, b in zip(texts, got, whole):
        assert a == b, t
    assert all(len(u) <= common.LONGEST_UNIT for u in e.known)


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(common, "UNITS_HELD", 50)
    monkeypatch.setattr(common, "SLICE_CHARS", 200)
    e, r = Encoder(tokenizer(FILES[0])), random.Random(2)
    texts = [" ".join(f"w{r.randrange(500)}" for _ in range(30)) for _ in range(100)] + ["", "y" * 5000]
    for t, ids in zip(texts, e.encode(texts)):
        assert ids.tolist() == e.tok.encode(t, add_special_tokens=False).ids
        assert len(e.known) <= 50 + 31 * 30


@pytest.mark.parametrize("file", FILES)
def test_words_are_units_without_their_punctuation(file):
    e, r = Encoder(tokenizer(file)), random.Random(4)
    words, marks = [f"word{a}" for a in "abcdefghijklmnopqrst"] + ["\xe9t\xe9", "\u0434\u0430"], [".", ",", "!?", ");", "***", "'", "'s", "'ll,", ".'"]
    before = ["", "(", "\"", "'(", "--"]
    texts = [" ".join(r.choice(before) + r.choice(words) + r.choice(marks) + r.choice(["", "-the"]) for _ in range(60)) for _ in range(100)]
    for t, ids in zip(texts, e.encode(texts)):
        assert ids.tolist() == e.tok.encode(t, add_special_tokens=False).ids, t
    assert len(e.known) < 300        # over a thousand with each word's punctuation


@pytest.mark.parametrize("file", FILES)
def test_marks_between_all_kinds_of_characters(file):
    e, r = Encoder(tokenizer(file)), random.Random(5)
    kinds = [*"aZ9\xe9\u0434'.,(_-", "\u0301", "\u0338", "\u0345", "\xb2", "\u0660", "\u03a3", "\u1e9e", "\u0130", " ", "  ", "'s", "'LL", "\xaa", "\xd7", "\u0483", "\u2019"]
    texts = ["".join(r.choices(kinds, k=r.randrange(1, 9))) for _ in range(20000)]
    whole = [x.ids for x in e.tok.encode_batch(texts, add_special_tokens=False)]
    for t, a, b in zip(texts, e.encode(texts), whole):
        assert a.tolist() == b, t


@pytest.mark.parametrize("file", FILES)
def test_units_are_encoded_together(file):
    """A call of the tokenizer takes many units; the ids are those of each by itself."""
    class Counted:
        given: list = []

        def __init__(self, tok):
            self.tok, self.encode = tok, tok.encode

        def encode_batch_fast(self, texts, **more):
            self.given += texts
            return self.tok.encode_batch_fast(texts, **more)

    e = Encoder(Counted(tokenizer(file)))
    r = random.Random(6)
    plain = [p for p in PARTS if not common.RARE_SPACE.search(p)]
    texts = [" ".join(r.choice(plain) + f"w{r.randrange(3000)}" + r.choice(plain) for _ in range(40)) for _ in range(300)]
    texts += [" \0 a", "\0", " \0\0b \0", " x \0"]
    for t, ids in zip(texts, e.encode(texts)):
        assert ids.tolist() == e.tok.tok.encode(t, add_special_tokens=False).ids, t
    assert len(e.tok.given) < len(e.known) * 0.7
