"""Language identification against plain counting of strings."""

import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from assayer.llm import language

SCHEMA = "doc_id long, text string, lang string"
VOWELS = {"aa": "aeio", "bb": "éàçu", "cc": "äöüß", "dd": "иоыя"}


def grams(text):
    words = "".join(
        (c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] == "L" else " " for c in text or ""
    ).split()
    found = Counter()
    for word in words:
        word = f" {word} "
        for size in (1, 2, 3):
            found.update(g for g in (word[i : i + size] for i in range(len(word) - size + 1)) if g != " ")
    return found


def top(found, size):
    return {g: i for i, g in enumerate(sorted(found, key=lambda g: (-found[g], len(g), g))[:size])}


def brute(rows, size):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    learned = {}
    for i, text, lang in rows:
        if lang is not None and not held(i):
            learned.setdefault(lang, Counter()).update(grams(text))
    known = {lang: top(found, size) for lang, found in learned.items() if found}
    out = []
    for i, text, _ in rows:
        mine = top(grams(text), size)
        ranks = {x: sum(abs(p[g] - r) if g in p else size for g, r in mine.items()) for x, p in known.items()}
        best = min(sorted(ranks), key=ranks.get) if ranks and mine else None
        out.append((i, held(i), best or "und", 1 - ranks[best] / (len(mine) * size) if best else 0.0))
    return sorted(out, key=repr)


def got(table, size):
    rows = language.language(table, size).collect()
    return sorted(((r["doc_id"], r["held_out"], r["lang_pred"], r["score"]) for r in rows), key=repr)


def prose(rng, lang, words):
    return " ".join("".join(rng.choice("bdklmnrst") + rng.choice(VOWELS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    rows = [(i, prose(rng, lang, rng.choice([1, 3, 40, 400])), lang) for i, lang in enumerate(list(VOWELS) * 25)]
    odd = [None, "", " 12 %\n", "x", "x", "É İ ß ŉ ſ ǅ ʰ", "中文 か한 \U0001f600a", "a\x00b", "w" * 3000, prose(rng, "cc", 30_000)]
    rows += [(1000 + i, text, None) for i, text in enumerate(odd)]
    return rows + [(None, "ba do", "aa"), (None, None, None), (5, "ba", "zz"), (5, "ba", "zz"), (7, "12", "none")]


@pytest.mark.parametrize("size", [7, 400])
def test_small_tables(spark, rows, size):
    assert got(spark.createDataFrame(rows, SCHEMA), size) == brute(rows, size)


def test_extra_columns_and_empty_tables(spark, rows):
    names = "row code n rank place distance most best score held_out lang_pred part".split()
    crowded = spark.createDataFrame([(*r, *range(len(names))) for r in rows], SCHEMA + "".join(f", {n} long" for n in names))
    assert got(crowded, 50) == brute(rows, 50)
    assert got(spark.createDataFrame([], SCHEMA), 50) == []
    unknown = [(1, "abc", None), (2, None, None)]
    assert got(spark.createDataFrame(unknown, SCHEMA), 50) == [(1, False, "und", 0.0), (2, False, "und", 0.0)]


def test_languages_in_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)
    assert got(spark.createDataFrame(rows, SCHEMA), 30) == brute(rows, 30)


def test_blocks_and_halves_count_alike(monkeypatch):
    rng = random.Random(9)
    texts = [prose(rng, "bb", 300) + " 中文" * 9, "", "é" * 700, " , ".join("ab" for _ in range(400)), "x" * 900 + " 1 " * 500]
    data = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    whole = np.frombuffer(b"".join(data), np.uint8)

    def named(found):
        name = lambda code: "".join(" " if p == 1 else chr(p - 2) for p in (code >> 42, code >> 21 & 2097151, code & 2097151) if p)
        return sorted((int(t), name(int(c)), int(n)) for t, c, n in zip(*found))

    want = sorted((i, g, n) for i, t in enumerate(texts) for g, n in grams(t).items())
    assert named(language.counts(whole, bounds)) == want
    monkeypatch.setattr(language, "BLOCK", 64)
    assert sorted((i, g, n) for i, d in enumerate(data) for _, g, n in named(language.counts(whole, bounds[i : i + 2]))) == want
    monkeypatch.setattr(language, "BLOCK", 1 << 20)
    monkeypatch.setattr(language, "ROOM", 20)
    assert named(language.counts(whole, bounds)) == want


def test_held_out_texts_of_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.language(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert rows.where("lang_pred = lang").count() >= 0.99 * rows.count()
