"""Words of texts as numpy arrays: the common ground of the corpus operators.

A word is a run of bytes other than 0x20 and 0x09-0x0D. UTF-8 never uses those bytes inside another
character, so splitting bytes and splitting characters give the same words. Texts of an Arrow batch lie
in one buffer; words are found and hashed there without a Python object per word.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes hashed at once; bounds the temporary arrays, not the texts.
BLOCK = 1 << 18
#: Bytes of text handed to an operator at once, unless a single text is longer.
SLICE = 2 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


class Memo(dict):
    """Results that a process computes once; a pickled copy is empty, so tasks carry none of them."""

    def __reduce__(self):
        return Memo, ()


_MEMO = Memo()


def remembered(function):
    """``function`` of hashable arguments, computed once per process.

    A plain function, as those of the standard library are pickled by their module's name, which executors need not know.
    """
    name = function.__name__

    def recall(*arguments):
        key = (name, *arguments)
        if key not in _MEMO:
            _MEMO[key] = function(*arguments)
        return _MEMO[key]

    return recall


@remembered
def _tables(lower: bool, breaks: bytes):
    """Which bytes end a word, and a fixed random number per byte (the same for a letter's cases if ``lower``)."""
    ends = np.zeros(256, bool)
    ends[list(breaks)] = True
    value = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    if lower:
        value[65:91] = value[97:123]
    return ends, value


@remembered
def _powers(size: int):
    def ladder(x: int):
        out = np.full(size, _U(x))
        out[0] = _U(1)
        return np.multiply.accumulate(out)

    return ladder(_BASE), ladder(_BASE_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@remembered
def constants(count: int, seed: int) -> np.ndarray:
    """Fixed odd 64-bit factors."""
    return np.random.default_rng(seed).integers(1, 1 << 63, count, dtype=np.uint64) * _U(2) + _U(1)


@dataclass
class Words:
    """hash: a 64-bit hash per word; begin, end: its bytes; first: the first word of each text, and the end."""

    hash: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.hash)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def room(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self))


def words(data: np.ndarray, bounds: np.ndarray, lower: bool = False, breaks: bytes = SPACES) -> Words:
    """Words of the texts ``data[bounds[i]:bounds[i + 1]]``; ``breaks`` are the bytes between words."""
    ends, value = _tables(lower, breaks)
    begins, stops, hashes = [], [], []
    at, last = int(bounds[0]), int(bounds[-1])
    while at < last:
        to = min(at + BLOCK, last)
        if to < last:  # cut between two words
            cut = np.flatnonzero(ends[data[at:to]])
            edge = int(bounds[np.searchsorted(bounds, to, "right") - 1])
            if len(cut) or edge > at:
                to = max(at + int(cut[-1]) + 1 if len(cut) else 0, edge)
            else:  # a word longer than a block
                rest = np.flatnonzero(ends[data[to:last]])
                edge = int(bounds[np.searchsorted(bounds, to, "left")])
                to = min(to + int(rest[0]) + 1 if len(rest) else last, edge)
        part = data[at:to]
        inside = ~ends[part]
        edges = bounds[np.searchsorted(bounds, at, "left") : np.searchsorted(bounds, to, "right")] - at
        before = np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        before[edges[edges < len(part)]] = False
        begin = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:], after[:-1] = False, inside[1:]
        after[edges[edges > 0] - 1] = False
        stop = np.flatnonzero(inside & ~after) + 1
        power, inverse = _powers(1 << max(19, (len(part) + 1).bit_length()))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(value[part] * power[: len(part)], out=total[1:])
        hashes.append(mix((total[stop] - total[begin]) * inverse[begin] + (stop - begin).astype(np.uint64)))
        begins.append(begin + at)
        stops.append(stop + at)
        at = to
    empty = np.zeros(0, np.int64)
    begin = np.concatenate(begins) if begins else empty
    return Words(
        np.concatenate(hashes) if hashes else empty.astype(np.uint64),
        begin,
        np.concatenate(stops) if stops else empty,
        np.searchsorted(begin, bounds, "left"),
    )


def ngrams(hashes: np.ndarray, size: int, seed: int = 5) -> np.ndarray:
    """A hash for each run of ``size`` words, also for those that cross texts."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    factor = constants(size, seed)
    out = hashes[:count] * factor[0]
    for j in range(1, size):
        out += hashes[j : j + count] * factor[j]
    return mix(out)


def word_hash(word: bytes, lower: bool = False) -> int:
    """The hash that ``words`` gives one word."""
    return int(words(np.frombuffer(word, np.uint8), np.array([0, len(word)]), lower).hash[0])


def texts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of an Arrow string column; nulls are empty texts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, bounds, data = column.buffers()
    if bounds is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds


def steady() -> None:
    """Arrays of 8 MB and more come from the system and go back when they are freed, whatever their number.

    By default the C library raises the size from which it does so up to 32 MB and keeps what was freed below it.
    """
    if "steady" in _MEMO:
        return
    _MEMO["steady"] = True
    pa.set_memory_pool(pa.system_memory_pool())
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt:
        for parameter, value in ((-3, 8 << 20), (-1, 64 << 20), (-8, 2)):  # mmap and trim thresholds, arenas
            mallopt(parameter, value)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Python workers stay for tasks of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of batches with at most ``SLICE`` bytes of text (a single longer text comes alone)."""
    steady()
    for batch in batches:
        data, bounds = texts_of(batch.column(column))
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE, "right")) - 1)
            yield batch.slice(at, to - at), data, bounds[at : to + 1]
            at = to
    give_back()


def blocks(batches) -> Iterator[pa.RecordBatch]:
    """Record batches of at most 50,000 rows from dictionaries of equally long arrays."""
    for parts in batches:
        table = pa.table(parts)
        yield from table.to_batches(max_chunksize=50_000)
