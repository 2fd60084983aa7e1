import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import tokens

TEXT = st.text(alphabet=st.sampled_from("abAB \t\n\x0bé　 x,."), max_size=60)


def found(texts, lower=False):
    raw = [t.encode() for t in texts]
    bounds = np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    return data, tokens.words(data, bounds, lower)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_words_are_those_of_the_pattern(texts):
    data, words = found(texts)
    want = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert words.counts.tolist() == [len(w) for w in want]
    got = [data[b:e].tobytes().decode() for b, e in zip(words.begin, words.end, strict=True)]
    flat = [w for ws in want for w in ws]
    assert got == flat
    seen = {}
    for word, value in zip(flat, words.hash.tolist(), strict=True):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_small_blocks_give_the_same_words(monkeypatch):
    texts = ["ab cde " * 40, "", "x" * 100, " y ", "z"]
    _, whole = found(texts, lower=True)
    monkeypatch.setattr(tokens, "BLOCK", 16)
    _, cut = found(texts, lower=True)
    assert (whole.hash == cut.hash).all() and (whole.first == cut.first).all() and (whole.end == cut.end).all()


def test_lower_case_is_ascii_only():
    _, words = found(["Ab aB É é"], lower=True)
    assert words.hash[0] == words.hash[1] and words.hash[2] != words.hash[3]
