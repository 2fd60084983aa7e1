"""Near-duplicates with SetSketch registers: banded, estimated by likelihood, verified on full shingle sets.

A text is the set of its distinct five-word shingles. Register i of a sketch takes an exponential variate per shingle and
stores the smallest on an exponential scale, truncated to 16 bits; the sketch of a union is the register-wise maximum,
and two registers agree with a probability close to the Jaccard similarity of the sets.

1. Texts with equal sets are one class, named after its smallest doc_id. Copies meet in a grouped minimum and go no
   further; all later steps work on classes.
2. ``BANDS`` bands of ``ROWS`` registers put each class into buckets. A pair of similarity 0.75 shares none of them with a
   probability of 5e-6. The smallest class of a bucket is its pivot, and all buckets of a pivot form one cell, so a
   class comes once to each of its pivots, not once per bucket; no pair is ever written as a row.
3. In a cell, a class is compared with those that are not linked with it yet. The sizes are known, so the similarity
   is estimated by maximum likelihood from the registers that are larger, smaller and equal; pairs that are far
   less likely at the threshold than at their estimate are dropped, and the others are counted on the full sets.
   The cell returns the links of a spanning forest: at most one per class.
4. A cell over ``CELL_ROWS`` classes or ``CELL_SHINGLES`` shingles is dealt into blocks. After the blocks are linked, only
   classes outside the cell's main component can still be missing a link; they are compared with the other blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import tokens
from assayer.llm.components import components
from assayer.llm.rows import fresh, row_key
from assayer.session import materialize

SHINGLE = 5
#: Spacing, rate and largest value of the registers.
BASE, RATE, LARGEST = 1.001, 20.0, (1 << 16) - 2
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: A pair is dropped if twice the log-likelihood ratio against the threshold exceeds this (4e-8 for a true link).
DOUBT = 30.0
CELL_ROWS, CELL_SHINGLES = 2_000, 2_000_000

_U = np.uint64
SKETCHED = "key long, doc_id long, n_shingles long, k1 long, k2 long, registers binary, bands array<long>"


def shingles(found: tokens.Words, text: int, grams: np.ndarray) -> np.ndarray:
    """The distinct shingle hashes of one text, sorted; a text of fewer words is one shingle of all of them."""
    first, last = found.first[text], found.first[text + 1]
    if last - first >= SHINGLE:
        return np.unique(grams[first : last - SHINGLE + 1])
    if last == first:
        return np.zeros(0, np.uint64)
    return tokens.ngrams(found.hash[first:last], int(last - first), seed=40 + int(last - first))


def registers(elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Registers of the sets ``elements[first[i]:first[i + 1]]``, none of them empty."""
    out = np.empty((len(first) - 1, REGISTERS), np.uint16)
    factors = tokens.constants(2 * REGISTERS, 77)
    for i in range(REGISTERS):
        least = np.minimum.reduceat((elements ^ factors[2 * i]) * factors[2 * i + 1], first[:-1])
        smallest = -np.log1p(-(least.astype(np.float64) + 1) * 2.0**-64.0) / RATE
        value = np.floor(1 - np.log(np.maximum(smallest, 1e-300)) / np.log(BASE))
        out[:, i] = np.clip(value, 0, LARGEST + 1)
    return out


def union(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(one, other)


def _less(x: np.ndarray) -> np.ndarray:
    """Probability that a register of one set exceeds the other's, by the share x of the union that only it has."""
    return -np.log1p(-np.minimum(x, 1 - 1e-12) * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(more, less, sizes, other, similarity):
    """Of ``more`` registers larger and ``less`` smaller, for sets of known sizes and a Jaccard similarity."""
    u, v = sizes / (sizes + other), other / (sizes + other)
    p = np.clip(_less(np.maximum(u - v * similarity, 0)), 1e-9, 1)
    q = np.clip(_less(np.maximum(v - u * similarity, 0)), 1e-9, 1)
    return more * np.log(p) + less * np.log(q) + (REGISTERS - more - less) * np.log(np.clip(1 - p - q, 1e-9, 1))


def may_link(registers_: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the other sets can reach the threshold, by their sizes and by the likelihood of their registers."""
    fits = np.minimum(size, sizes) >= threshold * np.maximum(size, sizes)
    more = (registers_ > others).sum(axis=1)
    less = (registers_ < others).sum(axis=1)
    grid = np.linspace(0, threshold, 31)[:-1]
    best = np.max([log_likelihood(more, less, size, sizes, j) for j in grid], axis=0)
    return fits & (2 * (best - log_likelihood(more, less, size, sizes, threshold)) <= DOUBT)


def sketch(docs: DataFrame) -> DataFrame:
    """Size, 128-bit name, registers and bands of each row's shingle set; only the size for texts without words."""

    def run(batches):
        for part, data, bounds in tokens.slices(batches):
            found = tokens.words(data, bounds, lower=True)
            grams = tokens.ngrams(found.hash, SHINGLE, seed=45)
            sets = [shingles(found, text, grams) for text in range(len(part))]
            size = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(size)
            names, values, bands = np.zeros((2, len(part)), np.int64), np.zeros((len(part), REGISTERS), np.uint16), None
            if len(full):
                elements, first = np.concatenate(sets), np.r_[0, np.cumsum(size[full])]
                values[full] = registers(elements, first)
                for i, factor in enumerate(tokens.constants(2, 3)):
                    names[i, full] = np.add.reduceat(tokens.mix(elements ^ factor), first[:-1]).view(np.int64)
            wide = values.reshape(len(part), BANDS, ROWS).astype(np.uint64)
            bands = (wide << (_U(16) * np.arange(ROWS, dtype=np.uint64))).sum(axis=2, dtype=np.uint64).view(np.int64)
            yield pa.record_batch(
                {
                    "key": part.column("key"),
                    "doc_id": part.column("doc_id"),
                    "n_shingles": pa.array(size),
                    "k1": pa.array(names[0]),
                    "k2": pa.array(names[1]),
                    "registers": pa.array([r.tobytes() for r in values], pa.binary()),
                    "bands": pa.ListArray.from_arrays(
                        np.arange(0, BANDS * len(part) + 1, BANDS, dtype=np.int32), pa.array(bands.ravel())
                    ),
                }
            )

    return docs.select(row_key().alias("key"), "doc_id", "text").mapInArrow(run, SKETCHED)


def _full_sets(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """``cells`` with the full sets of their classes, from the texts; k1 tells the class among rows of one doc_id."""
    carried = [c for c in cells.columns if c != "k1"]

    def run(batches):
        for part, data, bounds in tokens.slices(batches):
            found = tokens.words(data, bounds, lower=True)
            grams = tokens.ngrams(found.hash, SHINGLE, seed=45)
            factor = tokens.constants(2, 3)[0]
            rows, sets = [], []
            for text, name in enumerate(part.column("k1").to_pylist()):
                own = shingles(found, text, grams)
                if len(own) and int(np.add.reduce(tokens.mix(own ^ factor)).view(np.int64)) == name:
                    rows.append(text)
                    sets.append(own.tobytes())
            at = pa.array(rows, pa.int64())
            yield pa.record_batch(
                {**{c: part.column(c).take(at) for c in carried}, "shingles": pa.array(sets, pa.binary())}
            )

    texts = docs.select(F.col("doc_id").alias("node"), "text").join(cells, "node")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema if f.name != "k1")
    return texts.select(*carried, "k1", "text").mapInArrow(run, f"{schema}, shingles binary")


def _cell_links(threshold: float):
    """Links of a spanning forest of one cell, given what is linked already."""

    def run(cell: pa.Table) -> pa.Table:
        tokens.steady()
        node, at = np.unique(cell.column("node").to_numpy(), return_index=True)
        cell = cell.take(pa.array(at))
        label = cell.column("label").to_numpy().copy()
        before = label.copy()
        values = np.frombuffer(b"".join(cell.column("registers").to_pylist()), np.uint16).reshape(len(node), REGISTERS)
        sets = [np.frombuffer(s, np.uint64) for s in cell.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets], np.int64)
        names, element = np.unique(np.concatenate(sets), return_inverse=True)
        first = np.r_[0, np.cumsum(size)]
        inside = np.zeros(len(names), bool)
        groups, count = np.unique(label, return_counts=True)
        main = groups[np.argmax(count)] if len(groups) < len(node) else None
        # The pivot, the smallest node, comes first: most of its cell is linked with it. Later rows of the main
        # component are passed over, as each other row is compared with all of it.
        for row in range(len(node)):
            if (label == label[0]).all():
                break
            if label[row] == main:
                continue
            apart = np.flatnonzero((label != label[row]) & ((np.arange(len(node)) > row) | (label == main)))
            apart = apart[may_link(values[row], size[row], values[apart], size[apart], threshold)]
            if len(apart):
                own = element[first[row] : first[row + 1]]
                inside[own] = True
                span = np.concatenate([element[first[i] : first[i + 1]] for i in apart])
                both = np.add.reduceat(inside[span], np.r_[0, np.cumsum(size[apart])[:-1]], dtype=np.int64)
                inside[own] = False
                linked = apart[100 * both >= round(100 * threshold) * (size[row] + size[apart] - both)]
                meeting = np.unique(np.append(label[linked], label[row]))
                label[np.isin(label, meeting)] = main if main in meeting else label[row]
            if main is None:
                main = label[row]
        least = np.full(int(len(node)), np.iinfo(np.int64).max)
        group = np.unique(label, return_inverse=True)[1]
        np.minimum.at(least, group, before)
        found = np.unique(np.stack([before, least[group]]), axis=1)
        found = found[:, found[0] != found[1]]
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return run


def _pivots(classes: DataFrame) -> DataFrame:
    """(pivot, node): each class with the smallest class of each bucket that it shares, the pivot with itself too."""
    placed = classes.select("node", F.posexplode("bands").alias("band", "value"))
    shared = (
        placed.groupBy("band", "value")
        .agg(F.min("node").alias("pivot"), F.max("node").alias("last"))
        .where("pivot < last")
        .drop("last")
    )
    return placed.join(shared, ["band", "value"]).select("pivot", "node").dropDuplicates()


def near_duplicates(docs: DataFrame, threshold: float = 0.75, keyed: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept per row; first its key if ``keyed``.

    Words are compared with A-Z lower-cased. Null and empty texts have the empty set and are linked with nothing. A row
    without a doc_id is sketched and named like its class but never names one; it is kept only if no row with a
    doc_id is linked with it. Rows of one doc_id count as one document. Other columns are not read; an empty table
    gives no row.
    """
    rows = materialize(sketch(docs), "sketches")
    classes = materialize(
        rows.where("n_shingles > 0 and doc_id is not null")
        .groupBy("k1", "k2")
        .agg(F.min_by(F.struct("registers", "bands"), "doc_id").alias("s"), F.min("doc_id").alias("node"), F.min("n_shingles").alias("n_shingles"))
        .select("node", "k1", "k2", "n_shingles", "s.registers", "s.bands"),
        "classes",
    )
    members = materialize(_pivots(classes).join(classes.select("node", "n_shingles"), "node"), "cells")
    blocks = members.groupBy("pivot").agg(
        F.greatest(F.ceil(F.count("*") / CELL_ROWS), F.ceil(F.sum("n_shingles") / CELL_SHINGLES)).cast("int").alias("blocks")
    )
    block = F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    )
    placed = members.join(blocks, "pivot").select("pivot", "node", "blocks", F.explode(block).alias("block"))
    sketches = classes.select("node", "k1", "registers")

    def compare(cells: DataFrame) -> DataFrame:
        """``cells``: cell (any columns), node, label."""
        keys = [c for c in cells.columns if c not in ("node", "label")]
        sets = _full_sets(docs, cells.join(sketches, "node"))
        return sets.groupBy(*keys).applyInArrow(_cell_links(threshold), "a long, b long")

    links = materialize(compare(placed.select("pivot", "block", "node", F.col("node").alias("label"))), "links")
    linked = materialize(components(links), "components")
    large = placed.where("blocks > 1")
    if not large.isEmpty():
        links = links.unionAll(materialize(compare(_unfinished(large, linked)), "links"))
        linked = materialize(components(links), "components")
    named = classes.select("k1", "k2", "node").join(linked, "node", "left").select(
        "k1", "k2", F.coalesce("component", "node").alias("component")
    )
    first = ["key"] if keyed else []
    joined = rows.select(*first, "doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return joined.select(*first, "doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    )


def clean(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; equal rows of one doc_id stay together."""
    found = near_duplicates(docs, threshold, keyed=True)
    key = fresh("row_key", docs.columns)
    dropped = materialize(found.where(~F.col("kept")).select(F.col("key").alias(key)).distinct(), "dropped")
    return docs.withColumn(key, row_key()).join(dropped, key, "left_anti").select(*docs.columns)


def _unfinished(large: DataFrame, linked: DataFrame) -> DataFrame:
    """Cells of blocks that may still miss a link: those outside the main component with all others."""
    labelled = large.join(linked, "node", "left").select(
        "pivot", "blocks", "block", "node", F.coalesce("component", "node").alias("label")
    )
    labelled = materialize(labelled, "blocks")
    sizes = labelled.groupBy("pivot", "label").agg(F.countDistinct("node").alias("n"))
    main = sizes.groupBy("pivot").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("main"), F.sum("n").alias("n"), F.max("n").alias("m"))
    main = main.where("n > m").select("pivot", "main", F.ceil((F.col("n") - F.col("m")) / CELL_ROWS).cast("int").alias("rest"))
    rows = labelled.join(main, "pivot").withColumn("outside", F.col("label") != F.col("main"))
    mine = F.pmod(F.xxhash64("node", F.lit("rest")), F.col("rest")).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    # Block i of the classes outside meets every block of the main component, and every block j >= i outside.
    inner = rows.where("not outside").select(
        "pivot", F.explode(upto(F.col("rest"))).alias("i"), F.lit("main").alias("side"), F.col("block").alias("j"), "node", "label"
    )
    outer = rows.where("outside").select("pivot", "blocks", "rest", mine.alias("i"), "node", "label").dropDuplicates(["pivot", "node"])
    to_main = outer.select("pivot", "i", F.lit("main").alias("side"), F.explode(upto(F.col("blocks"))).alias("j"), "node", "label")
    to_rest = outer.select("pivot", "node", "label", "i", F.explode(upto(F.col("rest"))).alias("k")).select(
        "pivot", F.least("i", "k").alias("i"), F.lit("rest").alias("side"), F.greatest("i", "k").alias("j"), "node", "label"
    )
    return inner.unionByName(to_main).unionByName(to_rest).dropDuplicates(["pivot", "i", "side", "j", "node"])
