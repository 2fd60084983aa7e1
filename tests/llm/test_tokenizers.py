import array
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from assayer.llm import counts, packing

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    " ", "  ", "▁", "a", "the", "ing", "it's", "\n", "\t", "é", "é", "İ", "日本", "\U0001f600", "</s>", "<0x0A>",
    "<|endoftext|>", "\x00", "\x01", "12", "...", ",", "%%", "x" * 40, " " * 17, "The", "　",
]


@pytest.fixture(scope="module")
def merger():
    return counts.Merger(PIECES)


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_counts_equal_the_library(merger):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [*random_texts(1500, 1), "ab" * 3000, "the" * 2000, "=-" * 4000 + "hello" * 500]
    assert merger.count(texts) == [len(x) for x in library.encode(texts)]


def test_counts_of_odd_rows(spark, odd, crowded, nothing, odd_rows):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in odd_rows), key=repr)
    for table in (odd, crowded):
        assert sorted((tuple(r) for r in counts.token_counts(table, PIECES).collect()), key=repr) == want
    assert counts.token_counts(nothing, PIECES).count() == 0


def test_ids_equal_the_library():
    library, words = Tokenizer.from_file(WORDS), packing.WordIds(WORDS)
    texts = random_texts(1500, 2)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    raw = [t.encode() for t in texts]
    data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
    for _ in range(2):  # new words, then known ones
        ids, first = words.ids(data, bounds)
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == want


def one_by_one(lengths, capacity):
    room, placed = [], []
    for length in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= length]
        if not fits:
            room.append(capacity)
            fits = [(capacity, len(room) - 1)]
        at = min(fits)[1]
        placed.append((at, capacity - room[at], length))
        room[at] -= length
    return sorted(placed)


def test_plan_is_best_fit_decreasing_one_by_one():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([7, 16, 30, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        runs, got = packing.plan(histogram, capacity), []
        for length, count in histogram.items():
            for rank in range(count):
                _, first_rank, first, each, at = [r for r in runs if r[0] == length and r[1] <= rank][-1]
                more = rank - first_rank
                got.append((first + more // each, at + more % each * length, length))
        shape = lambda rows: sorted(sorted((o, n) for b, o, n in rows if b == i) for i in {r[0] for r in rows})
        assert shape(got) == shape(one_by_one(lengths, capacity))


def test_tightest_fit():
    tree = packing.TightestFit(10)
    for room in (3, 7, 10):
        tree.set(room, True)
    assert [tree.find(n) for n in (1, 3, 4, 8)] == [3, 3, 7, 10]
    tree.set(10, False)
    assert tree.find(8) is None


@pytest.mark.parametrize("window", [100_000, 3])
def test_packing_keeps_every_id(spark, odd, crowded, odd_rows, documents, window, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW_ROWS", window)
    library = Tokenizer.from_file(WORDS)
    for table, rows in ((odd, odd_rows), (crowded, odd_rows), (documents, [(r.doc_id, r.text) for r in documents.collect()])):
        got = packing.pack(table, WORDS).collect()
        want = []
        for doc, text in rows:
            ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
            for n, at in enumerate(range(0, len(ids), 2048)):
                cut = ids[at : at + 2048]
                want.append((doc, n, at, len(cut), zlib.crc32(array.array("I", cut).tobytes())))
        assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
        sequences = {}
        for r in got:
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        lengths = [w[3] for w in want]
        assert len(sequences) == len({b for b, _, _ in one_by_one(lengths, 2048)})


def test_packing_nothing(nothing):
    assert packing.pack(nothing, WORDS).count() == 0
