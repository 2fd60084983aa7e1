"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over a run of words; masked-out places may differ. Test items are hashed under every mask and the
training texts under the same masks at every word; equal hashes are hits. A hit fixes an alignment of item and text,
and the words are then compared one by one around it: matches count +1 and substitutions ``-PENALTY``, and the
best-scoring stretch is the overlap. So an item is found with some of its words replaced.

The masks miss no overlap that the comparison accepts. A best-scoring stretch has no beginning of negative score, as
it would score more without it. So up to its ``WEIGHT``-th equal word it is one of the few patterns that never have
more than 1 / ``PENALTY`` substitutions per equal word before any place; these patterns are the masks.

The hashes of the test items are sent to the tasks in blocks of at most ``block_words`` words of test text; a larger
benchmark is joined block by block, each time with all texts. Texts are scanned where they lie, nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import tokens

#: Equal words of a seed. Items that may be accepted with fewer are searched by that many.
WEIGHT = 5
#: An overlap has at least this many equal words, or all but a fifth of a shorter item,
MIN_EQUAL = 10
#: and at least this share of equal words.
MIN_SHARE = 0.7
PENALTY = 2
#: Items of fewer words are no passage; they are not searched.
MIN_ITEM = 5
BLOCK_WORDS = 500_000
#: Hits looked at together, and words of them compared at once; they bound memory, not results.
HITS = 1 << 18
CELLS = 1 << 20
SCHEMA = "item_id long, start int, end int, item_start int, n_equal int, n_item_words int"

_U = np.uint64


@dataclass
class Index:
    """Sorted seed hashes of a block of items and where they come from."""

    filter: np.ndarray
    hash: np.ndarray
    item: np.ndarray
    place: np.ndarray
    words: np.ndarray
    first: np.ndarray
    ids: np.ndarray
    seeds: list[tuple[int, ...]]


def seed_masks(weight: int) -> list[tuple[int, ...]]:
    """The places of the first ``weight`` equal words of any stretch without a beginning of negative score."""
    done, grow = [], [((), 0, 0)]
    while grow:
        places, at, total = grow.pop()
        if len(places) == weight:
            done.append(places)
            continue
        grow.append(((*places, at), at + 1, total + 1))
        if total >= PENALTY:
            grow.append((places, at + 1, total - PENALTY))
    return sorted(done)


def needed(n_words: np.ndarray) -> np.ndarray:
    """Equal words that an overlap with an item of ``n_words`` has at least."""
    return np.minimum(MIN_EQUAL, -(-4 * n_words // 5))


def seed_hashes(hashes: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """A hash of the words that the seed keeps, from every word on."""
    count = len(hashes) - seed[-1]
    if count <= 0:
        return np.zeros(0, np.uint64)
    factor = tokens.constants(len(seed), 1000 + sum(1 << i for i in seed) % 100_003)
    out = np.full(count, _U(sum(1 << min(i, 60) for i in seed)))
    for f, i in zip(factor, seed, strict=True):
        out += hashes[i : i + count] * f
    return tokens.mix(out)


def index(ids: list[int], texts: list[str]) -> Index | None:
    """The seeds of some items."""
    raw = [t.encode() for t in texts]
    found = tokens.words(
        np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64), lower=True
    )
    counts = found.counts
    weights = np.where(counts >= MIN_ITEM, np.minimum(WEIGHT, needed(counts)), 0)
    seeds, hashes, places, owner, room = [], [], [], found.owner(), found.room()
    for weight in np.unique(weights[weights > 0]).tolist():
        for seed in seed_masks(weight):
            own = seed_hashes(found.hash, seed)
            at = np.flatnonzero((room[: len(own)] > seed[-1]) & (weights[owner[: len(own)]] == weight))
            if len(at):
                seeds.append(seed)
                hashes.append(own[at])
                places.append(at)
    if not seeds:
        return None
    hashes, places = np.concatenate(hashes), np.concatenate(places)
    order = np.argsort(hashes, kind="stable")
    hashes, places = hashes[order], places[order]
    coarse = np.zeros(max(1 << 22, 1 << (4 * len(hashes)).bit_length()), bool)
    coarse[(hashes & _U(coarse.size - 1)).astype(np.int64)] = True
    item = owner[places]
    return Index(
        coarse, hashes, item.astype(np.int32), (places - found.first[item]).astype(np.int32), found.hash, found.first,
        np.array(ids, np.int64), seeds,
    )


def _hits(found: tokens.Words, ix: Index) -> Iterator[np.ndarray]:
    """(text, item, diagonal) of the hits; the diagonal is the place in the text less that in the item.

    They come in parts of about ``HITS`` at most, each once in its part.
    """
    room = found.room()
    for seed in ix.seeds:
        own = seed_hashes(found.hash, seed)
        at = np.flatnonzero(ix.filter[(own & _U(ix.filter.size - 1)).astype(np.int64)])
        at = at[room[at] > seed[-1]]
        left, right = np.searchsorted(ix.hash, own[at], "left"), np.searchsorted(ix.hash, own[at], "right")
        count = right - left
        at, left, count = at[count > 0], left[count > 0], count[count > 0]
        before = np.cumsum(count) - count
        cuts = np.flatnonzero(np.diff(before // HITS)) + 1
        for a, l, c in zip(np.split(at, cuts), np.split(left, cuts), np.split(count, cuts), strict=True):
            if len(a):
                entry = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(l, c)
                a = np.repeat(a, c)
                text = np.searchsorted(found.first, a, "right") - 1
                yield np.unique(np.stack([text, ix.item[entry], a - found.first[text] - ix.place[entry]], axis=1), axis=0)


def _best_stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and equal words of the best-scoring stretch of each row; of equal scores the first."""
    total = np.zeros((len(equal), equal.shape[1] + 1), np.int32)
    np.cumsum(np.where(equal, 1, -PENALTY), axis=1, out=total[:, 1:])
    low = np.minimum.accumulate(total, axis=1)
    end = np.argmax(total - low, axis=1)
    row = np.arange(len(equal))
    begin = np.argmax(total == low[row, end][:, None], axis=1)
    score = total[row, end] - total[row, begin]
    return begin, end, (score + PENALTY * (end - begin)) // (1 + PENALTY)


def _overlaps(found: tokens.Words, ix: Index) -> dict[tuple[int, int], tuple[int, int, int, int, int]]:
    """Per (text, item) the overlap with most equal words, then the first."""
    best: dict[tuple[int, int], tuple[int, int, int, int, int]] = {}
    for hits in _hits(found, ix):
        text, item, diagonal = hits.T
        size = np.diff(ix.first)[item]
        begin, stop = np.maximum(0, -diagonal), np.minimum(size, found.counts[text] - diagonal)
        order = np.argsort(stop - begin, kind="stable")
        # Rows of about one length are compared together, at most CELLS words at once.
        at = 0
        while at < len(order):
            length = int((stop - begin)[order[at]])
            to = at + max(1, CELLS // max(2 * length, 16))
            to = min(to, int(np.searchsorted((stop - begin)[order], max(2 * length, 16), "right")))
            rows = order[at:to]
            at = to
            width = int((stop - begin)[rows[-1]])
            place = begin[rows][:, None] + np.arange(width)
            inside = place < stop[rows][:, None]
            place = np.where(inside, place, begin[rows][:, None])
            equal = ix.words[ix.first[item[rows]][:, None] + place] == found.hash[(found.first[text[rows]] + diagonal[rows])[:, None] + place]
            b, e, n = _best_stretches(equal & inside)
            good = np.flatnonzero((n >= needed(size[rows])) & (n >= MIN_SHARE * (e - b)))
            item_start = begin[rows] + b
            start = item_start + diagonal[rows]
            values = np.stack([n, -start, start + e - b, item_start, size[rows]], axis=1)[good]
            for t, i, value in zip(text[rows[good]].tolist(), item[rows[good]].tolist(), values.tolist(), strict=True):
                best[t, i] = max(tuple(value), best.get((t, i), (-1,)))
    return best


def _items(benchmark: DataFrame, block_words: int):
    """The test items in blocks of about ``block_words`` words, equal texts once, under their smallest id.

    The number of blocks follows the words of the benchmark, so each one that comes to the driver is bounded.
    """
    items = (
        benchmark.where(F.col("item_id").isNotNull() & (F.trim("text") != ""))
        .groupBy("text")
        .agg(F.min("item_id").alias("item_id"))
        .withColumn("size", F.size(F.split("text", r"\s+")))
    )
    total = items.agg(F.sum("size")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    for number in range(blocks):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == number).orderBy("item_id").collect()
        found = index([r["item_id"] for r in part], [r["text"] for r in part])
        if found:
            yield found


def overlaps(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per text and test item that overlap, with the ``keep`` columns of the text.

    ``start`` and ``end`` are words of the text, ``item_start`` the word of the item that the overlap begins with,
    ``n_equal`` the equal words. Words are compared with A-Z lower-cased. Equal items count as the one of the
    smallest item_id. Null texts, items without an id and items under ``MIN_ITEM`` words overlap with nothing;
    repeated rows are searched each.
    """
    kept = docs.select(*keep, "text")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep]
    schema = ", ".join([*fields, SCHEMA])

    def scan(shared):
        def run(batches):
            ix = Index(**shared.value)
            for part, data, bounds in tokens.slices(batches):
                best = _overlaps(tokens.words(data, bounds, lower=True), ix)
                if best:
                    rows = pa.array([text for text, _ in best], pa.int64())
                    values = np.array(list(best.values()), np.int64)
                    columns = {
                        "start": -values[:, 1],
                        "end": values[:, 2],
                        "item_start": values[:, 3],
                        "n_equal": values[:, 0],
                        "n_item_words": values[:, 4],
                    }
                    yield pa.record_batch(
                        {
                            **{name: part.column(name).take(rows) for name in keep},
                            "item_id": pa.array(ix.ids[[item for _, item in best]]),
                            **{name: pa.array(v.astype(np.int32)) for name, v in columns.items()},
                        }
                    )

        return run

    context = docs.sparkSession.sparkContext
    found = None
    for ix in _items(benchmark, block_words):
        rows = kept.mapInArrow(scan(context.broadcast(vars(ix))), schema)
        found = rows if found is None else found.unionAll(rows)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that overlap with no test item, with all their columns; rows without a text stay."""
    context = docs.sparkSession.sparkContext

    def drop(shared):
        def run(batches):
            ix = Index(**shared.value)
            for part, data, bounds in tokens.slices(batches):
                stays = np.ones(len(part), bool)
                stays[[text for text, _ in _overlaps(tokens.words(data, bounds, lower=True), ix)]] = False
                yield part.filter(pa.array(stays))

        return run

    for ix in _items(benchmark, block_words):
        docs = docs.mapInArrow(drop(context.broadcast(vars(ix))), docs.schema)
    return docs
