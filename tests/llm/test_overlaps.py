"""Decontamination, near-duplicates and repeated passages against brute force."""

import hashlib
import random
import re

import pytest

from assayer.llm import components, decontaminate, setsketch, substrings
from .conftest import plain

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"


def repeats(rows, window):
    first, out = {}, []
    for doc, text in rows:
        words = WORD.findall(text or "")
        for i in range(len(words) - window + 1):
            if doc is not None:
                key = tuple(words[i : i + window])
                first[key] = min(first.get(key, doc), doc)
    for doc, text in rows:
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            if doc is not None and first[tuple(words[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def small_texts(n, seed):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice("a b c".split()) for _ in range(rng.randint(0, 40)))
    return [(i, f"{line()}\n{line()}") for i in range(n)]


@pytest.mark.parametrize(("window", "flush"), [(13, 1 << 20), (5, 1 << 20), (6, 50)])
def test_repeats(spark, odd_rows, window, flush, monkeypatch):
    monkeypatch.setattr(substrings, "FLUSH", flush)
    rows = odd_rows + [(i + 20, t) for i, t in small_texts(50, window)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substrings.remove_repeats(docs, window).collect()]
    assert sorted(got, key=repr) == repeats(rows, window)


def test_repeat_spans_and_columns(spark, crowded, nothing):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, passage), (2, f"x {passage} y"), (3, passage)], SCHEMA)
    got = {r.doc_id: [(s.start, s.end) for s in r.repeats] for r in substrings.remove_repeats(docs).collect()}
    assert got == {1: [], 2: [(1, 21)], 3: [(0, 20)]}
    assert substrings.remove_repeats(crowded).columns == ["doc_id", "n_words", "n_removed", "kept", "repeats"]
    assert substrings.remove_repeats(nothing).count() == 0


def test_a_frequent_prefix_is_spread(spark):
    import numpy as np
    import pyarrow as pa

    from assayer.llm import tokens

    def hashed(text):
        return tokens.words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))

    def order(run):
        prefix = tokens.ngrams(hashed(run).hash, substrings.PREFIX, seed=7)
        return int(tokens.mix(prefix ^ np.uint64(0x5851F42D4C957F2D))[0])

    # A run that is the anchor of every window that holds it, and goes on differently in each text.
    start = min((" ".join(f"p{i}q{j}" for j in range(5)) for i in range(5_000)), key=order)
    texts = [f"{start} " + " ".join(f"t{i}w{j}" for j in range(8)) for i in range(400)]
    batch = pa.record_batch(
        {"key": pa.array(range(400), pa.int64()), "doc_id": pa.array(range(400), pa.int64()), "text": texts, "places": pa.array([[0]] * 400, pa.list_(pa.int32()))}
    )
    size = {}
    for sent in substrings._send_paths(13, 8)(iter([batch])):
        for bucket, paths in zip(sent.column("bucket").to_pylist(), sent.column("paths").to_pylist(), strict=True):
            size[bucket] = size.get(bucket, 0) + len(paths) // 8
    assert sum(size.values()) > 380 and len(size) == 8 and max(size.values()) < 100
    rows = [(i, f"{t} end") for i, t in enumerate([*texts, *texts[:50]])]
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=repr) == repeats(rows, 13)


def links(rows):
    sets, up = [], {doc: doc for doc, _ in rows}
    for _, text in rows:
        words = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()})

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, one in enumerate(sets):
        for j in range(i):
            both = len(one & sets[j])
            if one and sets[j] and 100 * both >= 75 * len(one | sets[j]):
                a, b = root(rows[i][0]), root(rows[j][0])
                up[max(a, b)] = min(a, b)
    return sorted((doc, len(s), root(doc), root(doc) == doc) for (doc, _), s in zip(rows, sets, strict=True))


def near_copies(n, seed):
    rng = random.Random(seed)
    base = [rng.choice("the of and xx yy".split()) + str(rng.randint(0, 30)) for _ in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(120)] = f"q{rng.randint(0, 50)}"
        rows.append((i * 3 + 20, (" " if i % 2 else "\n").join(words)))
    return rows


@pytest.mark.parametrize("cell_rows", [2_000, 15])
def test_near_duplicates(spark, odd_rows, cell_rows, monkeypatch):
    monkeypatch.setattr(setsketch, "CELL_ROWS", cell_rows)
    rows = [r for r in odd_rows if r[0] is not None] + near_copies(100, 4)
    got = setsketch.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(tuple(r) for r in got) == links(rows)


def test_near_duplicates_without_ids(spark, crowded, nothing):
    rows = [(None, "a b c d e f"), (3, "A b c d e f"), (None, "z"), (None, None), (9, None)]
    got = plain(setsketch.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == plain([(None, 2, 3, False), (3, 2, 3, True), (None, 1, None, True), (None, 0, None, True), (9, 0, 9, True)])
    assert setsketch.near_duplicates(nothing).count() == 0
    kept = setsketch.clean(crowded)
    assert kept.columns == crowded.columns
    assert {r.doc_id for r in kept.collect()} == {None, 1, 2, 3, 4, 5, 7, 8, 9, 11}


def test_registers_merge_and_estimate():
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(1, 1 << 63, 800, dtype=np.uint64)
    b = np.r_[a[:700], rng.integers(1, 1 << 63, 100, dtype=np.uint64)]
    both = np.unique(np.r_[a, b])
    one, other, all_ = (setsketch.registers(x, np.array([0, len(x)]))[0] for x in (a, b, both))
    assert (setsketch.union(one, other) == all_).all()
    more, less = (one > other).sum(), (one < other).sum()
    grid = np.linspace(0, 0.99, 100)
    best = grid[np.argmax([setsketch.log_likelihood(more, less, 800, 800, j) for j in grid])]
    assert abs(best - 700 / 900) < 0.12
    assert setsketch.may_link(one, 800, other[None], np.array([800]), 0.75).all()
    far = setsketch.registers(rng.integers(1, 1 << 63, 800, dtype=np.uint64), np.array([0, 800]))
    assert not setsketch.may_link(one, 800, far, np.array([800]), 0.75).any()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 3), (200, 200)]
    got = components.components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {tuple(r) for r in got} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100), (102, 100)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")


def test_verbatim_items_are_found(spark, benchmark, documents):
    items = {r.item_id: WORD.findall(r.text.translate(LOWER)) for r in benchmark.collect()}
    want = set()
    for row in documents.collect():
        text = " ".join(["", *WORD.findall((row.text or "").translate(LOWER)), ""])
        want |= {(row.doc_id, i) for i, words in items.items() if " ".join(["", *words, ""]) in text}
    got = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(documents, benchmark).collect()}
    assert want and want <= set(got)
    assert all(r.n_equal >= 10 for r in got.values())


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WORDS, 200])
def test_substituted_items_are_found(spark, benchmark, block):
    rng = random.Random(2)
    items = [(r.item_id, WORD.findall(r.text)) for r in benchmark.collect()]
    rows = []
    for n in range(200):
        item, words = rng.choice(items)
        words = [f"zz{rng.randint(0, 999)}" if rng.random() < 0.1 else w for w in words]
        rows.append((n, " ".join(["aa bb", *words, "dd"]), item))
    docs = spark.createDataFrame(rows, "doc_id long, text string, item long")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, benchmark, block_words=block).collect()}
    assert len({(n, item) for n, _, item in rows} & got) >= 190


def accepted(item, text):
    """Whether any alignment of the words has an overlap that counts, by brute force over all alignments."""
    for diagonal in range(1 - len(item), len(text)):
        score = top = equal = 0
        best = (0, 0)
        for i in range(max(0, -diagonal), min(len(item), len(text) - diagonal)):
            same = item[i] == text[i + diagonal]
            score += 1 if same else -2
            if score < 0:
                score = equal = length = 0
                continue
            equal, length = equal + same, length + 1
            if score > top:
                top, best = score, (equal, length)
        if best[0] >= min(10, -(-4 * len(item) // 5)) and best[0] >= 0.7 * best[1]:
            return True
    return False


def test_every_accepted_overlap_is_found(spark):
    rng = random.Random(5)
    items = [[f"i{n}w{j}" for j in range(size)] for n, size in enumerate([5, 6, 7, 9, 12, 15, 15, 15, 20, 30, 60] * 2)]
    texts = []
    for n, item in enumerate(items):
        for period in (3, 4, 5):
            for phase in range(period):
                texts.append((n, [f"z{j}" if j % period == phase else w for j, w in enumerate(item)]))
        for share in (0.1, 0.2, 0.3) * 15:
            texts.append((n, [f"z{j}" if rng.random() < share else w for j, w in enumerate(item)]))
    texts = [(n, ["y"] * rng.randint(0, 3) + words + ["x"]) for n, words in texts]
    want = {(doc, n) for doc, (n, words) in enumerate(texts) if accepted(items[n], words)}
    assert len(want) > len(texts) / 2
    docs = spark.createDataFrame([(doc, " ".join(words)) for doc, (_, words) in enumerate(texts)], SCHEMA)
    table = spark.createDataFrame([(n, " ".join(item)) for n, item in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, table).collect()} == want


def test_odd_rows_are_clean(spark, benchmark, odd, crowded, nothing):
    assert decontaminate.overlaps(odd, benchmark).count() == 0
    assert decontaminate.overlaps(nothing, benchmark).count() == 0
    assert decontaminate.overlaps(odd, benchmark.where("false")).count() == 0
    assert plain(decontaminate.clean(crowded, benchmark).collect()) == plain(crowded.collect())
    short = spark.createDataFrame([(1, "Ab CD ef gh ij"), (2, "x"), (None, "q q q q q q"), (3, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "zz ab cd ef gh ij zz"), (2, "x x x"), (3, "q q q q q q q")], SCHEMA)
    assert [tuple(r)[:2] for r in decontaminate.overlaps(docs, short).collect()] == [(1, 1)]
    assert [r.doc_id for r in decontaminate.clean(docs, short).collect()] == [2, 3]
