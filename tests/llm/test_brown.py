import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import brown

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


@pytest.mark.parametrize("head", [65_536, 50])
def test_base_score(spark, documents, odd_rows, head):
    rows = odd_rows + [(r.doc_id + 100, r.text) for r in documents.collect()]
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None]) for i, t in rows]
    count = Counter()
    for doc, own in words:
        if not held(doc):
            count.update(own)
    total, kinds = sum(count.values()), len(count)
    want = []
    for doc, own in words:
        base = sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in own)
        want.append((doc, held(doc), len(own), sum(count[w] > 0 for w in own), total, round(base, 4)))
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit(1)).withColumn("key", F.lit("x"))
    got = brown.score(table, fold(), brown.Settings(head=head, words=40)).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=repr) == sorted(want, key=repr)


def test_classes_beat_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = brown.score(docs, fold()).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_words_beyond_the_seed_are_clustered(spark):
    import random

    rng = random.Random(4)
    kinds = [[f"{k}{i}same" for i in range(100)] for k in "abc"]  # all end alike
    walk = lambda: " ".join(rng.choice(kinds[j % 3]) for j in range(60))
    docs = spark.createDataFrame([(i, walk()) for i in range(400)], "doc_id long, text string")
    rows = brown.score(docs, fold(), brown.Settings(words=60, classes=8, head=150)).where("held_out").collect()
    # A word of the next kind is one of 100, of all words one of 300.
    gain = sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows)
    assert gain > 0.3 * math.log10(3)


def test_every_word_has_a_class_from_all_its_neighbours(spark, documents):
    """Counts of words come back whole from the tasks that choose classes, and no word is left out."""
    settings = brown.Settings(words=40, classes=8, head=150, flush=300, share=500)
    counts = brown.word_counts(documents, settings).cache()
    lex = brown.lexicon(counts, settings)
    table = brown.unit_bigrams(documents, lex)
    label = brown.exchange(table, 8, 2)
    one = np.eye(8)[label]
    got = {r["hash"]: r["n"] for r in brown.further(documents, lex, label, one.T @ table @ one, settings, int(table.sum())).collect()}
    units = set(lex.hash[lex.unit > 0].view(np.int64).tolist())
    assert got == {r["hash"]: r["n"] for r in counts.collect() if r["hash"] not in units}


def test_nothing_to_learn_from(spark, odd, nothing):
    assert brown.score(nothing, fold()).count() == 0
    got = brown.score(odd, F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in got} == {(0, 0, 0.0)}
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def likelihood(table, label):
    classes = 10
    one = np.eye(classes)[label]
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    between = one.T @ table @ one
    return f(between) - f(between.sum(0)) - f(between.sum(1))


def test_exchange_ends_where_no_single_move_helps():
    rng = np.random.default_rng(3)
    for size, classes in ((31, 4), (25, 6)):
        kind = rng.integers(0, 3, size)
        rate = np.array([[1, 30, 1], [1, 1, 30], [30, 1, 1]])
        table = rng.poisson(rate[kind][:, kind])
        start, label = brown.exchange(table, classes, 0), brown.exchange(table, classes, 30)
        best = likelihood(table, label)
        assert label[0] == 0 and (label[1:] > 0).all() and best > likelihood(table, start)
        for unit in range(1, size):
            for other in range(1, classes):
                moved = label.copy()
                moved[unit] = other
                assert likelihood(table, moved) <= best + 1e-6


def test_the_model_sums_to_one():
    rng = np.random.default_rng(5)
    settings = brown.Settings(words=6, endings=4, classes=3)
    table = rng.integers(0, 9, (11, 11))
    kinds, mass = np.array([2, 0, 1, 3]), np.array([10, 0, 4, 7])
    label = brown.exchange(table, 3, 5)
    fitted = brown.model(table, label, kinds, mass, settings)
    emit = 10.0**fitted.emit
    # An ending's words have mass + kinds in all, and one more for the unseen.
    emit[7:] *= mass + kinds + 1
    for before in range(3):
        assert abs((10.0 ** fitted.step[before])[label] @ emit - 1) < 1e-9
