"""Repeated passages across documents: suffixes partitioned by their prefixes, subtrees cut at the window depth.

Two documents share a passage of ``window`` words exactly when two suffixes share a path of that length in the suffix
tree of the corpus. The tree is built sparsely and in parts:

1. In every window the ``PREFIX``-word run of the smallest hash is its anchor; equal windows have equal anchors at equal
   places. Only suffixes that start at anchors (about a fifth) are grouped, by the hash of their prefix.
   A prefix that occurs in one text only cannot lead to a node shared by two, and its suffixes go no further.
2. For the prefixes that remain, each suffix is sent with the hashes of the paths (windows) through its anchor. A
   partition takes some of the paths, sorts them, and each run of equal paths is a node of depth
   ``window``; the smallest doc_id below it is the document that keeps the passage. Overlapping nodes are
   joined into maximal repeats when the texts are put together.

Groups fit into memory however often a passage occurs: a task sends at most two texts per prefix to the group of that
prefix, and one document per path to the group of that path, as the others are decided where they are. Paths are dealt by
their own hash, so a frequent prefix that goes on in many ways is spread over all partitions. What is exchanged are arrays packed per task and partition, not rows.

Texts are exchanged once, by row key, and that exchange is used by all three passes over them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import tokens
from assayer.llm.rows import row_key

PREFIX = 5
#: Suffixes collected by a task before it sends them; bounds memory, not results.
FLUSH = 1 << 20
#: Bits for the place of a prefix in a slice of texts; the others order prefixes.
PLACE_BITS = 28

_U = np.uint64
PACKED = "bucket int, suffixes binary, keys binary, places binary, paths binary, lengths binary, docs binary, sure boolean"


@dataclass
class Suffixes:
    """Anchors of some texts: text, place of the anchor (words), prefix hash, first window and number of windows."""

    text: np.ndarray
    place: np.ndarray
    prefix: np.ndarray
    first: np.ndarray
    count: np.ndarray


def _slide_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of ``size`` values."""
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out, have = np.minimum(out[:-step], out[step:]), have + step
    return out


def anchors(found: tokens.Words, window: int) -> Suffixes:
    """The anchors of all windows; windows with one anchor are neighbours, and each belongs to one anchor."""
    prefix = tokens.ngrams(found.hash, PREFIX, seed=7)
    spread = window - PREFIX + 1
    at = np.flatnonzero(found.room() >= window)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Suffixes(none, none, none.astype(np.uint64), none, none)
    if len(prefix) >> PLACE_BITS:
        raise ValueError("too many words in one slice")
    low = _U((1 << PLACE_BITS) - 1)
    order = (tokens.mix(prefix ^ _U(0x5851F42D4C957F2D)) & ~low) | np.arange(len(prefix), dtype=np.uint64)
    place = (_slide_min(order, spread)[at] & low).astype(np.int64)
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    place, first = place[new], at[new]
    text = np.searchsorted(found.first, place, "right") - 1
    return Suffixes(text, place, prefix[place], first, np.diff(np.r_[new, len(at)]))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (tokens.mix(hashes.astype(np.uint64) ^ _U(0xD6E8FEB86659FD93)) % _U(buckets)).astype(np.int64)


def _split(bucket: np.ndarray, **arrays: np.ndarray) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]])
    for begin, end in zip(cuts, [*cuts[1:], len(order)], strict=True):
        rows = order[begin:end]
        yield int(bucket[rows[0]]), {name: a[rows] for name, a in arrays.items()}


def _first_two(prefix: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes to send: those of the first two texts of each prefix. And which prefixes occur in two texts."""
    order = np.lexsort((key, prefix))
    p, k = prefix[order], key[order]
    new_prefix = np.r_[True, p[1:] != p[:-1]]
    new_text = new_prefix | np.r_[True, k[1:] != k[:-1]]
    group = np.cumsum(new_prefix) - 1
    seen = np.cumsum(new_text)
    nth = seen - seen[np.flatnonzero(new_prefix)][group]
    send, shared = np.empty(len(p), bool), np.empty(len(p), bool)
    send[order] = nth < 2
    shared[order] = np.bincount(group, nth > 0)[group] > 0
    return send, shared


def _pack(**arrays) -> dict:
    return {name: a.tobytes() for name, a in arrays.items()}


EMPTY = {"suffixes": b"", "keys": b"", "places": b"", "paths": b"", "lengths": b"", "docs": b"", "sure": False}


def _as_batch(rows: list[dict]) -> pa.RecordBatch:
    types = {"bucket": pa.int32(), "sure": pa.bool_()}
    names = [c.split()[0] for c in PACKED.split(", ")]
    return pa.record_batch({n: pa.array([r.get(n, EMPTY.get(n)) for r in rows], types.get(n, pa.binary())) for n in names})


def _gather(batches, kinds: dict[str, type]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The packed arrays of a partition: the open ones, and those decided by the sender."""
    parts: dict[bool, dict[str, list]] = {flag: {name: [] for name in kinds} for flag in (False, True)}
    for batch in batches:
        sure = batch.column("sure").to_pylist()
        for name, kind in kinds.items():
            for flag, value in zip(sure, batch.column(name), strict=True):
                parts[flag][name].append(np.frombuffer(value.as_py(), kind))
    return tuple(
        {name: np.concatenate(v) if v else np.zeros(0, kinds[name]) for name, v in parts[flag].items()}
        for flag in (False, True)
    )


def _send_prefixes(window: int, buckets: int):
    """Pass 1 over the texts: the suffixes of each partition, packed by the bucket of their prefix."""

    def flush(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        prefix, key, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        send, shared = _first_two(prefix, key)
        rows = [
            {**EMPTY, "bucket": b, **_pack(suffixes=x["prefix"], keys=x["key"], places=x["place"])}
            for b, x in _split(_bucket(prefix[send], buckets), prefix=prefix[send], key=key[send], place=place[send])
        ]
        rest = shared & ~send
        rows += [
            {**EMPTY, "bucket": b, "sure": True, **_pack(keys=x["key"], places=x["place"])}
            for b, x in _split(_bucket(key[rest], buckets), key=key[rest], place=place[rest])
        ]
        return _as_batch(rows)

    def run(batches):
        parts, held = [], 0
        for part, data, bounds in tokens.slices(batches):
            found = tokens.words(data, bounds)
            s = anchors(found, window)
            key = part.column("key").to_numpy()
            parts.append((s.prefix, key[s.text], (s.place - found.first[s.text]).astype(np.int32)))
            held += len(s.place)
            if held >= FLUSH:
                yield flush(parts)
                parts, held = [], 0
        if held:
            yield flush(parts)

    return run


def _shared_prefixes(batches):
    """The suffixes of a bucket whose prefix occurs in two texts."""
    kinds = {"suffixes": np.uint64, "keys": np.int64, "places": np.int32}
    is_open, sure = _gather(batches, kinds)
    prefix, key = is_open["suffixes"], is_open["keys"]
    keys, places = [sure["keys"]], [sure["places"]]
    if len(prefix):
        _, shared = _first_two(prefix, key)
        keys.append(key[shared])
        places.append(is_open["places"][shared])
    yield from tokens.blocks([{"key": np.concatenate(keys), "place": np.concatenate(places)}])


def _windows(found: tokens.Words, s: Suffixes, chosen: np.ndarray, hashes: np.ndarray):
    """(suffix, window) of all windows of the chosen suffixes."""
    count = s.count[chosen]
    suffix = np.repeat(chosen, count)
    start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + s.first[suffix]
    return suffix, start, hashes[start]


def _chosen(part: pa.RecordBatch, found: tokens.Words, s: Suffixes) -> np.ndarray:
    """The suffixes whose places the row lists."""
    places = part.column("places")
    lengths = np.asarray(places.value_lengths().fill_null(0))
    values = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    wanted = np.repeat(found.first[:-1], lengths) + values
    return np.flatnonzero(np.isin(s.place, wanted))


def _least(path: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each path's group and the smallest document of each group."""
    order = np.lexsort((doc, path))
    new = np.r_[True, path[order][1:] != path[order][:-1]]
    group = np.empty(len(path), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, doc[order][new]


def _masks(key: np.ndarray, place: np.ndarray, offset: np.ndarray) -> dict[str, np.ndarray]:
    """Removed windows as one bit mask per suffix; a window's bit is its distance from the anchor."""
    names, row = np.unique(np.stack([key, place.astype(np.int64)]), axis=1, return_inverse=True)
    mask = np.zeros(names.shape[1], np.int64)
    np.bitwise_or.at(mask, row.ravel(), np.int64(1) << offset.astype(np.int64))
    return {"key": names[0], "place": names[1].astype(np.int32), "mask": mask}


def _send_paths(window: int, buckets: int):
    """Pass 2 over the texts: the paths through shared prefixes. Texts without one send nothing."""

    def flush(parts) -> pa.RecordBatch:
        path, doc, key, place, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
        group, least = _least(path, doc)
        late = doc > least[group]
        rows = [
            {**EMPTY, "bucket": b, "sure": sure, **_pack(paths=x["path"], docs=x["doc"], keys=x["key"], places=x["place"], lengths=x["offset"])}
            for sure, at, home in ((False, ~late, path), (True, late, key))
            for b, x in _split(
                _bucket(home[at], buckets), path=path[at], doc=doc[at], key=key[at], place=place[at], offset=offset[at]
            )
        ]
        return _as_batch(rows)

    def run(batches):
        parts, held = [], 0
        for part, data, bounds in tokens.slices(batches):
            found = tokens.words(data, bounds)
            s = anchors(found, window)
            suffix, start, path = _windows(found, s, _chosen(part, found, s), tokens.ngrams(found.hash, window))
            text = s.text[suffix]
            key = part.column("key").to_numpy()
            doc = part.column("doc_id").to_numpy(zero_copy_only=False)
            if part.column("doc_id").null_count:  # a row without an id is compared with no other
                known = ~np.asarray(part.column("doc_id").is_null())[text]
                suffix, start, path, text = suffix[known], start[known], path[known], text[known]
                doc = part.column("doc_id").fill_null(0).to_numpy()
            place = (s.place[suffix] - found.first[text]).astype(np.int32)
            offset = (s.place[suffix] - start).astype(np.int8)
            parts.append((path, doc[text].astype(np.int64), key[text], place, offset))
            held += len(path)
            if held >= FLUSH:
                yield flush(parts)
                parts, held = [], 0
        if held:
            yield flush(parts)

    return run


def _late_paths(batches):
    """The windows of a bucket's paths that a smaller document holds too."""
    kinds = {"paths": np.uint64, "docs": np.int64, "keys": np.int64, "places": np.int32, "lengths": np.int8}
    is_open, sure = _gather(batches, kinds)
    group, least = _least(is_open["paths"], is_open["docs"]) if len(is_open["paths"]) else (np.zeros(0, np.int64),) * 2
    late = is_open["docs"] > least[group] if len(group) else np.zeros(0, bool)
    columns = [np.concatenate([is_open[name][late], sure[name]]) for name in ("keys", "places", "lengths")]
    if len(columns[0]):
        yield from tokens.blocks([_masks(*columns)])


def _put_together(window: int):
    """Pass 3 over the texts: the words that stay, and the maximal repeats that go."""

    def run(batches):
        for part, data, bounds in tokens.slices(batches):
            found = tokens.words(data, bounds)
            masks = part.column("masks")
            lengths = np.asarray(masks.value_lengths().fill_null(0))
            values = masks.flatten()
            base = np.repeat(found.first[:-1], lengths)
            place = base + values.field("place").to_numpy(zero_copy_only=False).astype(np.int64)
            mask = values.field("mask").to_numpy(zero_copy_only=False).astype(np.int64)
            edge = np.zeros(len(found) + 1, np.int64)
            for offset in range(window - PREFIX + 1):
                start = place[(mask >> offset) & 1 == 1] - offset
                np.add.at(edge, start, 1)
                np.add.at(edge, start + window, -1)
            gone = np.cumsum(edge)[:-1] > 0
            removed = np.diff(np.r_[0, np.cumsum(gone)][found.first])
            kept, spans = [], []
            for row in range(len(part)):
                words = data[bounds[row] : bounds[row + 1]].tobytes().split()
                lost = gone[found.first[row] : found.first[row + 1]]
                if removed[row]:
                    flips = np.flatnonzero(np.diff(np.r_[0, lost.astype(np.int8), 0]))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in flips.reshape(-1, 2)])
                    words = list(compress(words, (~lost).tolist()))
                else:
                    spans.append([])
                kept.append(b" ".join(words))
            yield pa.record_batch(
                {
                    "doc_id": part.column("doc_id"),
                    "n_words": pa.array(found.counts, pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()),
                    "kept": pa.array(kept, pa.binary()).cast(pa.string()),
                    "repeats": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                }
            )

    return run


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by a space) and repeats (maximal removed spans).

    A word goes if it lies in a window of ``window`` words that also starts in a document of smaller doc_id.
    Null texts have no words. A row without a doc_id has no smaller or larger document and stays whole. Rows
    with the same doc_id never remove each other's words, exact copies under other ids lose all of them (if they
    have ``window`` words). Other columns are not read; an empty table gives no row.
    """
    if not PREFIX <= window <= PREFIX + 62:
        raise ValueError(f"window must lie between {PREFIX} and {PREFIX + 62}")
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        row_key().alias("key"), "doc_id", text.alias("text")
    ).repartition("key")

    def exchanged(packed: DataFrame) -> DataFrame:
        return packed.repartitionById(buckets, "bucket")

    prefixes = exchanged(rows.mapInArrow(_send_prefixes(window, buckets), PACKED))
    places = prefixes.mapInArrow(_shared_prefixes, "key long, place int").groupBy("key").agg(F.collect_list("place").alias("places"))
    paths = exchanged(rows.join(places, "key").mapInArrow(_send_paths(window, buckets), PACKED))
    masks = (
        paths.mapInArrow(_late_paths, "key long, place int, mask long")
        .groupBy("key")
        .agg(F.collect_list(F.struct("place", "mask")).alias("masks"))
    )
    return rows.join(masks, "key", "left").mapInArrow(
        _put_together(window),
        "doc_id long, n_words long, n_removed long, kept string, repeats array<struct<start: int, end: int>>",
    )
