"""Language identification by rank-order profiles.

A text's letters (folded to lower case; everything else is a word boundary) give n-grams of one to three symbols,
boundaries included. A language's profile is the ranking of its ``size`` most frequent n-grams over all training
texts. A text's own ranking is compared with each profile by the out-of-place distance: the difference of an n-gram's two
ranks, or ``size`` where the profile lacks it, summed over the text's ``size`` most frequent n-grams. The language of the
least distance wins.

An n-gram is coded by its symbols, 21 bits each, so codes are exact and their order is that of the n-grams; ties of counts
are ranked by it. Counting sorts codes in numpy, over blocks of a long text, so memory follows the block and the
text's distinct n-grams. Training texts are counted by task and then grouped by (language, n-gram); ranking keeps
``size`` rows per task and language before the shuffle. The profiles of ``LANGUAGES`` languages are broadcast
together; should a table hold more values, they are compared in further blocks, each over all texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import tokens
from assayer.session import materialize

SIZE = 400
GRAM = 3
#: Languages whose profiles are broadcast at once: SIZE rows each.
LANGUAGES = 256
#: Bytes of a long text that are counted at once.
BLOCK = 1 << 20
#: n-gram counts of a task that are kept before they are handed on.
HELD = 1 << 19
UNDETERMINED = "und"
SYMBOL = 21
#: Bits of a number that holds a text and an n-gram.
ROOM = 63


def symbols(data: bytes) -> np.ndarray:
    """A symbol per character: its lower-case letter plus 2, or 1 for what is no letter."""
    points = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    present = np.bincount(points, minlength=1)
    folded = np.ones(len(present), np.int64)
    for point in np.flatnonzero(present).tolist():
        char = chr(point)
        if unicodedata.category(char)[0] == "L":
            lower = char.lower()
            folded[point] = ord(lower if len(lower) == 1 else char) + 2
    return folded[points]


def grams(line: np.ndarray, fresh: int) -> Iterator[tuple[int, np.ndarray]]:
    """(size, index of the last symbol) of the n-grams that end at ``fresh`` or later; none holds an inner boundary."""
    letter = line != 1
    for size in range(1, GRAM + 1):
        ends = np.arange(max(fresh, size - 1), len(line))
        good = np.ones(len(ends), bool)
        if size == 1:
            good = letter[ends]
        for inner in range(1, size - 1):
            good &= letter[ends - inner]
        yield size, ends[good]


def joined(line: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts side by side, each between boundaries, runs of boundaries as one; and the text of each symbol.

    ``bounds`` are the texts' ends in ``line``.
    """
    owner = np.searchsorted(bounds, np.arange(len(line)), "right")
    line = np.insert(line, np.concatenate([[0], bounds]), 1)
    owner = np.insert(owner, np.concatenate([[0], bounds]), np.concatenate([[0], np.arange(len(bounds))]))
    keep = np.ones(len(line), bool)
    keep[1:] = (line[1:] != 1) | (line[:-1] != 1)
    return line[keep], owner[keep]


def coded(line: np.ndarray, owner: np.ndarray, fresh: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, count) of the n-grams of ``line`` that end at ``fresh`` or later, in order."""
    alphabet = np.flatnonzero(np.bincount(line, minlength=1))
    bits = max(1, len(alphabet).bit_length())
    small = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.int64)
    small[alphabet] = np.arange(1, len(alphabet) + 1)
    small = small[line]
    many = int(owner[-1]) + 1 if len(owner) else 0
    if GRAM * bits + many.bit_length() > ROOM and many > 1:  # too many texts for one number: half of them at a time
        cut = int(np.searchsorted(owner, many // 2))
        edge = cut - 1 if cut and line[cut - 1] == 1 else cut
        left = coded(line[: edge + 1], owner[: edge + 1], fresh)
        right = coded(line[edge:], np.maximum(owner[edge:] - many // 2, 0), 0)
        return tuple(np.concatenate(pair) for pair in zip(left, (right[0] + many // 2, *right[1:])))
    keys = []
    for size, ends in grams(line, fresh):
        code = small[ends]
        for back in range(1, size):
            code = code + (small[ends - back] << (bits * back))
        # A boundary in front belongs to the text before: the n-gram is its last letter's, or the middle one's.
        middle = ends - 1 if size > 1 else ends
        text = np.where(line[ends] != 1, owner[ends], owner[middle])
        keys.append((text << (bits * GRAM)) + code)
    keys = np.sort(np.concatenate(keys))
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.append(edge, len(keys)))
    keys = keys[edge]
    code = np.zeros(len(keys), np.int64)
    for place in range(GRAM):
        digit = (keys >> (bits * place)) & ((1 << bits) - 1)
        code |= np.where(digit > 0, alphabet[np.maximum(digit, 1) - 1], 0) << (SYMBOL * place)
    return keys >> (bits * GRAM), code, count


def merged(code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, with its counts added."""
    found, at = np.unique(code, return_inverse=True)
    return found, np.bincount(at, count, len(found)).astype(np.int64)


def counts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, count) of the n-grams of the texts ``data[bounds[i]:bounds[i + 1]]``, in order."""
    if len(bounds) > 2 or bounds[-1] - bounds[0] <= BLOCK:
        part = data[bounds[0] : bounds[-1]]
        whole = symbols(part.tobytes())
        starts = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])  # characters before each byte
        ends = starts[bounds[1:] - bounds[0]]
        if len(whole) != starts[-1]:  # bytes that are no UTF-8: one text after the other
            texts = [symbols(data[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
            whole, ends = np.concatenate(texts), np.cumsum([len(t) for t in texts])
        return coded(*joined(whole, ends), 0)
    # One long text in blocks; the last symbols of a block stand before the next one.
    carry = np.ones(1, np.int64)
    code, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, last = int(bounds[0]), int(bounds[-1])
    while at < last:
        to = min(at + BLOCK, last)
        while to < last and data[to] & 0xC0 == 0x80:
            to += 1
        line = np.concatenate([carry, symbols(data[at:to].tobytes()), np.ones(int(to == last), np.int64)])
        keep = np.ones(len(line), bool)
        keep[1:] = (line[1:] != 1) | (line[:-1] != 1)
        line = line[keep]
        _, new, n = coded(line, np.zeros(len(line), np.int64), len(carry))
        code, count = merged(np.concatenate([code, new]), np.concatenate([count, n]))
        carry, at = line[-(GRAM - 1) :], to
    return np.zeros(len(code), np.int64), code, count


def texts(batches: Iterator[pa.RecordBatch]):
    """(rows, text, code, count) of parts of batches."""
    for part, data, bounds in tokens.slices(batches):
        yield part, *counts(data, bounds)


def ranked(text: np.ndarray, code: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, rank from 0) of each text's ``size`` most frequent n-grams; ties in the order of their codes."""
    order = np.lexsort((code, -count, text))
    text, code = text[order], code[order]
    begin = np.searchsorted(text, text, "left")
    rank = np.arange(len(text)) - begin
    top = rank < size
    return text[top], code[top], rank[top]


def held_out(fold: int = 0, folds: int = 5) -> Column:
    """Rows that no profile is learned from: crc32 of the id as text leaves ``fold``. A null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def profiles(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """lang, code, rank of the ``size`` most frequent n-grams of each language of ``docs`` (lang, text)."""

    def count(batches):
        held: dict = {}

        def flush():
            for lang, parts in held.items():
                code, n = merged(*(np.concatenate(p) for p in zip(*parts)))
                yield {"lang": pa.array([lang] * len(code), pa.string()), "code": pa.array(code), "n": pa.array(n)}
            held.clear()

        rows = 0
        for part, text, code, n in texts(batches):
            langs = part.column("lang").to_pylist()
            names = sorted(set(langs))
            number = {name: i for i, name in enumerate(names)}
            of = np.array([number[x] for x in langs], np.int64)[text]
            for i, name in enumerate(names):
                mine = of == i
                held.setdefault(name, []).append(merged(code[mine], n[mine]))
                rows += len(held[name][-1][0])
            if rows > HELD:
                for name, parts in held.items():
                    held[name] = [merged(*(np.concatenate(p) for p in zip(*parts)))]
                rows = sum(len(p[0][0]) for p in held.values())
                if rows > HELD // 2:
                    yield from tokens.blocks(flush())
                    rows = 0
        yield from tokens.blocks(flush())

    counted = (
        docs.where(F.col("lang").isNotNull())
        .select("lang", "text")
        .mapInArrow(count, "lang string, code long, n long")
        .groupBy("lang", "code")
        .agg(F.sum("n").alias("n"))
    )
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "code")
    return (
        counted.withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= size)
        .select("lang", "code", (F.col("place") - 1).alias("rank"))
    )


def distances(docs: DataFrame, table: list, size: int, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns, the least distance of ``docs`` to the languages of ``table``, that language, and the most possible.

    ``table`` lists (lang, code, rank) of a bounded number of languages. Texts without letters have no language.
    """
    names = sorted({row[0] for row in table})
    codes = np.unique(np.array([row[1] for row in table], np.int64))
    ranks = np.full((len(names), len(codes)), -1, np.int32)
    for lang, code, rank in table:
        ranks[names.index(lang), np.searchsorted(codes, code)] = rank
    shared = docs.sparkSession.sparkContext.broadcast((names, codes, ranks))  # LANGUAGES * size rows at most
    kept = docs.select(*keep, "text")

    def run(batches):
        names, codes, ranks = shared.value
        for part, text, code, count in texts(batches):
            text, code, rank = ranked(text, code, count, size)
            at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            known = codes[at] == code if len(codes) else np.zeros(len(code), bool)
            best = np.full(len(part), np.iinfo(np.int64).max)
            lang = np.full(len(part), -1)
            for i in range(len(names)):
                profile = np.where(known, ranks[i][at], -1)
                step = np.where(profile >= 0, np.abs(profile - rank), size)
                total = np.bincount(text, step, len(part)).astype(np.int64)
                nearer = total < best
                best[nearer], lang[nearer] = total[nearer], i
            most = np.bincount(text, minlength=len(part)) * size
            lang[most == 0] = -1
            yield pa.record_batch(
                {
                    **{name: part.column(name) for name in keep},
                    "lang_pred": pa.array([names[i] if i >= 0 else None for i in lang.tolist()], pa.string()),
                    "distance": pa.array(np.where(lang >= 0, best, 0), pa.int64()),
                    "most": pa.array(most, pa.int64()),
                }
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep)
    return kept.mapInArrow(run, f"{schema}, lang_pred string, distance long, most long")


def identify(docs: DataFrame, learn: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs``, by the languages of ``learn`` (lang, text).

    score is one less the distance's share of the greatest possible one. The first of equally near languages in
    their order wins. Null texts, and those without a letter, are ``und`` with score 0, as is every text where nothing was
    learned. Repeated rows are judged each; an empty table gives no row; other columns are not used.
    """
    table = materialize(profiles(learn, size), "language-profiles")
    many = table.agg(F.count_distinct("lang")).first()[0]
    parts = 1 if many <= LANGUAGES else -(-2 * many // LANGUAGES)  # about half full, by hash
    mine = F.pmod(F.xxhash64("lang"), F.lit(parts))
    rows = docs.select("doc_id", "text")
    if parts == 1:
        near = distances(rows, [tuple(r) for r in table.collect()], size, ("doc_id",))
    else:
        # Each row keeps a key of its own, as ids may repeat.
        rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "language-rows")
        near = None
        for part in range(parts):
            block = distances(rows, [tuple(r) for r in table.where(mine == part).collect()], size, ("doc_id", "row"))
            near = block if near is None else near.unionByName(block)
        first = F.min_by(F.struct("lang_pred", "distance", "most"), F.struct(F.col("lang_pred").isNull(), "distance", "lang_pred"))
        near = near.groupBy("row", "doc_id").agg(first.alias("best")).select("doc_id", "best.*")
    return near.select(
        "doc_id",
        F.coalesce("lang_pred", F.lit(UNDETERMINED)).alias("lang_pred"),
        F.when(F.col("lang_pred").isNull(), F.lit(0.0)).otherwise(1 - F.col("distance") / F.col("most")).alias("score"),
    )


def language(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; profiles are learned from the rows that are not held out."""
    named = identify(docs, docs.where(~held_out()), size)
    return named.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
