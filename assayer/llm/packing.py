"""Best-fit-decreasing packing of tokenised documents into training sequences.

1. Each document becomes token ids and an end id, cut into pieces of at most ``capacity`` ids. Only pieces longer
   than the capacity are cut. The pieces are written once to the shared folder.
2. Pieces of equal length are interchangeable, so the packing is decided on the histogram of lengths (at most
   ``capacity`` rows, whatever the corpus). ``plan`` walks it from the longest length down. Open bins are kept per
   remaining capacity; a segment tree over the remaining capacities finds the tightest that still holds the piece
   in logarithmic time. Bins that look alike are taken as one run, so the result is what placing the pieces one by
   one would give, and the plan has a few thousand runs at most.
3. Each piece gets its rank among the pieces of its length: ranks within (length, bucket) plus the pieces of
   the earlier buckets. The number of buckets follows the number of pieces, so no window grows with the data.
4. The run that covers the rank gives the sequence and the offset.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.llm import tokens
from assayer.session import materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Distinct words a task remembers before it starts anew; bounds memory, not results.
REMEMBERED = 600_000
#: Characters that end a word without touching what stands before them: none is part of a contraction or of the
#: marks of special tokens.
TAIL = ",.;:!?%*$#&"
#: Pieces per rank window, on average.
WINDOW_ROWS = 100_000


class WordIds:
    """Ids of a tokenizer that drops white space: each blank-separated word is encoded once per task.

    Such a tokenizer never joins characters across a blank, so the ids of a text are the ids of its words in order.
    Known words are a sorted array of hashes with their places in one array of ids. New words are encoded without
    their closing punctuation, and those of several pieces many at a time, with a separator of known id between them.
    """

    SEPARATOR = "\x01"

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if any(self.encode(f"a{blank}b") != self.encode("a") + self.encode("b") for blank in tokens.SPACES.decode()):
            raise ValueError("this tokenizer keeps white space")
        (self.mark,) = self.encode(self.SEPARATOR)
        letters = [c for c in map(chr, range(0x61, 0x250)) if c.isalpha() and c.lower() == c == unicodedata.normalize("NFC", c)]
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = frozenset(letters)
        self.spelling = str.maketrans({c: spell(c)[0][0] for c in letters})
        probes = ["a", "the", "straße", "élève", "ñandú", "zzzzqx", "".join(letters[:60]), *map("".join, zip(letters, letters[1:], letters[7:]))]
        if any(self.spelled(w) != self.encode(w) for w in probes):
            self.letters = frozenset()
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.held, self.used = np.zeros(1 << 16, np.uint32), 0

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def spelled(self, word: str) -> list[int]:
        """Ids of a word of known small letters: the steps before the merges leave it in one piece, spelled as bytes."""
        return [token.id for token in self.tokenizer.model.tokenize(word.translate(self.spelling))]

    def encode_words(self, new: list[str]) -> list[list[int]]:
        """Ids of new words: those of the word without its closing punctuation, then those of the punctuation.

        Punctuation is set apart only behind a letter that stays one when lower-cased, where the tokenizer cuts too.
        """
        cores = [word.rstrip(TAIL) for word in new]
        cores = [c if c[-1:].lower().isalpha() else w for c, w in zip(cores, new, strict=True)]
        tails = [w[len(c) :] for c, w in zip(cores, new, strict=True)]
        cores = [low if self.letters.issuperset(low := c.lower()) else c for c in cores]
        ids: dict[str, list[int]] = {"": []}
        rest = []
        for part in {*cores, *tails} - {""}:
            if self.letters.issuperset(part):
                ids[part] = self.spelled(part)
            else:
                rest.append(part)
        self.encode_all(rest, ids)
        return [ids[c] + ids[t] for c, t in zip(cores, tails, strict=True)]

    def encode_all(self, new: list[str], ids: dict[str, list[int]]) -> None:
        plain = [w for w in new if self.SEPARATOR not in w]
        for at in range(0, len(plain), 2_000):
            part = plain[at : at + 2_000]
            joined = self.encode(f" {self.SEPARATOR} ".join(part))
            cuts = [i for i, x in enumerate(joined) if x == self.mark]
            if len(cuts) != len(part) - 1:  # a word whose own ids hold the mark
                ids.update((w, self.encode(w)) for w in part)
                continue
            ids.update((w, joined[b:e]) for w, b, e in zip(part, [0, *(c + 1 for c in cuts)], [*cuts, len(joined)], strict=True))
        ids.update((w, self.encode(w)) for w in new if self.SEPARATOR in w)

    def learn(self, names: np.ndarray, words: list[str]) -> None:
        """``names``: sorted hashes of the new words."""
        found = self.encode_words(words)
        size = np.fromiter(map(len, found), np.int32, len(found))
        total = int(size.sum())
        if self.used + total > len(self.held):
            self.held = np.concatenate([self.held[: self.used], np.zeros(self.used + total, np.uint32)])
        self.held[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        start = self.used + np.cumsum(size, dtype=np.int64) - size
        self.used += total
        place = np.searchsorted(self.known, names)
        self.known, self.at, self.size = (
            np.insert(old, place, new) for old, new in ((self.known, names), (self.at, start), (self.size, size))
        )

    def ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """32-bit ids of all texts ``data[bounds[i]:bounds[i + 1]]`` and where each text's begin (and the last ends)."""
        found = tokens.words(data, bounds)
        names, at, row = np.unique(found.hash, return_index=True, return_inverse=True)
        if len(self.known) + len(names) > REMEMBERED:
            self.forget()
        place = np.searchsorted(self.known, names)
        new = np.flatnonzero(self.known[np.minimum(place, len(self.known) - 1)] != names) if len(self.known) else np.arange(len(names))
        if len(new):
            spans = zip(found.begin[at[new]].tolist(), found.end[at[new]].tolist(), strict=True)
            self.learn(names[new], [data[b:e].tobytes().decode() for b, e in spans])
            place = np.searchsorted(self.known, names)
        size = self.size[place][row].astype(np.int64)
        first = np.r_[0, np.cumsum(size)]
        source = np.arange(first[-1]) + np.repeat(self.at[place][row] - first[:-1], size)
        return self.held[source], first[found.first]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of each document: start, length and checksum of its ids. Null texts are the end id alone."""

    def run(batches):
        words = WordIds(tokenizer)
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for part, data, bounds in tokens.slices(batches):
            ids, first = words.ids(data, bounds)
            out: dict[str, list] = {name.split()[0]: [] for name in PIECES.split(", ")}
            for row, doc in enumerate(part.column("doc_id").to_pylist()):
                raw = ids[first[row] : first[row + 1]].astype("<u4").tobytes() + end
                for number, begin in enumerate(range(0, len(raw), step)):
                    cut = raw[begin : begin + step]
                    for name, value in zip(out, (doc, number, begin // 4, len(cut) // 4, zlib.crc32(cut)), strict=True):
                        out[name].append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch({k: pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=True)})
        del words
        tokens.give_back()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


class TightestFit:
    """A segment tree over remaining capacities; a leaf is set while bins with that much room are open."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, room: int, is_open: bool) -> None:
        at = room + self.size
        self.open[at] = is_open
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def find(self, need: int) -> int | None:
        """The smallest remaining capacity of at least ``need`` that an open bin has."""
        at = need + self.size
        if self.open[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over (length: pieces): (length, first rank, first bin, pieces per bin, offset) per run.

    Of bins with equal room the one opened first is taken. Placing a piece in a bin of the tightest room leaves
    a bin that is tighter still, so a bin is filled with pieces of one length until none fits, then the next.
    """
    tree = TightestFit(capacity)
    runs: dict[int, list[tuple[int, int]]] = {}  # room: (first bin, bins), ordered by bin
    bins, out = 0, []

    def put(room: int, first: int, count: int) -> None:
        if count and room:
            here = runs.setdefault(room, [])
            here.insert(bisect_left(here, (first, count)), (first, count))
            tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.find(length)
            if room is None:
                room, each = capacity, capacity // length
                first, count = bins, -(-left // each)
                bins += count
            else:
                first, count = runs[room].pop(0)
                each = room // length
                if not runs[room]:
                    tree.set(room, False)
            full, rest = min(count, left // each), 0
            if full < count:
                rest = min(each, left - full * each)
            out.append((length, rank, first, each, capacity - room))
            placed = full * each + rest
            left, rank = left - placed, rank + placed
            put(room - each * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            used = full + bool(rest)
            put(room, first + used, count - used)
    return out


def ranked(spark: SparkSession, rows: DataFrame, total: int) -> DataFrame:
    """Rank of each piece among those of its length, from 0."""
    buckets = max(1, total // WINDOW_ROWS)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("length", "bucket").agg(F.count("*").alias("size"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return (
        rows.withColumn("rank", F.row_number().over(inside) - 1)
        .join(sizes, ["length", "bucket"])
        .withColumn("rank", F.col("rank") + F.col("before"))
        .drop("bucket", "before")
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack every document; one row per piece with its sequence and its place there.

    Null texts are empty and give one piece, the end id. Null ids stay null, repeated rows are packed each, an empty
    table gives no row. Offsets are gapless from 0 in every sequence, sequences are numbered from 0. Ties are
    broken by doc_id and piece. ``tokenizer`` is a path that every executor has.
    """
    spark = docs.sparkSession
    rows = materialize(pieces(docs, tokenizer, capacity, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs: dict[int, list] = {}
    for length, *run in plan(histogram, capacity):
        runs.setdefault(length, []).append(run)
    # At most a few runs per length, and `capacity` lengths: bounded by the parameter, not by the corpus.
    table = spark.createDataFrame(
        [(length, [tuple(run) for run in found]) for length, found in runs.items()],
        "length long, runs array<struct<rank: long, first: long, each: long, at: long>>",
    )
    placed = (
        ranked(spark, rows, sum(histogram.values()))
        .join(F.broadcast(table), "length")
        .withColumn("run", F.expr("element_at(filter(runs, r -> r.rank <= rank), -1)"))
        .withColumn("rank", F.col("rank") - F.col("run.rank"))
    )
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("run.first") + F.floor(F.col("rank") / F.col("run.each"))).cast("long").alias("sequence_id"),
        (F.col("run.at") + (F.col("rank") % F.col("run.each")) * F.col("length")).cast("long").alias("offset"),
    )
