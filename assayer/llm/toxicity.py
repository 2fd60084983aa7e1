"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Terms are runs of letters and digits (A-Z lower-cased). A text's features are its distinct terms, pairs of neighbours,
and pairs with one or two terms between them, hashed into ``buckets``; each feature is present or absent, so the
length of a text adds no weight by itself. Every coordinate has its own learning rate, and the L1 term
keeps all but the useful weights at exactly zero: the model is the list of non-zero weights.

The classifier is fitted on at most ``max_training`` labelled rows, those of the smallest hash of their id, in one task
that streams them ``epochs`` times; this bound is a parameter and does not depend on the table. All rows are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import tokens
from assayer.llm.rows import smallest

#: ASCII bytes that are neither letters nor digits.
BREAKS = bytes(b for b in range(128) if not chr(b).isalnum())
SKIPS = (1, 2, 3)


@dataclass(frozen=True)
class Settings:
    """alpha, beta: learning rate; l1, l2: penalties; max_training: labelled rows that the fit may use at most."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 1.0
    epochs: int = 3
    buckets: int = 1 << 20
    max_training: int = 16_384
    threshold: float = 0.3


def features(data: np.ndarray, bounds: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each feature of the texts, with repeats."""
    terms = tokens.words(data, bounds, lower=True, breaks=BREAKS)
    owner, room = terms.owner(), terms.room()
    texts, hashes = [owner], [tokens.mix(terms.hash)]
    for skip in SKIPS:
        at = np.flatnonzero(room > skip)
        factor = tokens.constants(2, 100 + skip)
        texts.append(owner[at])
        hashes.append(tokens.mix(terms.hash[at] * factor[0] + terms.hash[at + skip] * factor[1]))
    found = np.concatenate(hashes) & np.uint64(buckets - 1)
    return np.concatenate(texts), found.astype(np.int64)


def distinct(owner: np.ndarray, found: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Each (text, bucket) once, in order."""
    keys = np.unique(owner * buckets + found)
    return keys // buckets, keys % buckets


class Ftrl:
    """Per-coordinate FTRL-proximal with L1 and L2."""

    def __init__(self, settings: Settings):
        self.s = settings
        self.z, self.n = np.zeros(settings.buckets), np.zeros(settings.buckets)
        self.bias_z = self.bias_n = 0.0

    def weights(self, z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        s = self.s
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        s, z, n = self.s, self.z[at], self.n[at]
        w = self.weights(z, n, s.l1)
        bias = float(self.weights(np.float64(self.bias_z), np.float64(self.bias_n), 0.0))
        gradient = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - label
        square = gradient * gradient
        self.z[at] = z + gradient - (np.sqrt(n + square) - np.sqrt(n)) / s.alpha * w
        self.n[at] = n + square
        self.bias_z += gradient - (np.sqrt(self.bias_n + square) - np.sqrt(self.bias_n)) / s.alpha * bias
        self.bias_n += square

    def model(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and weights that are not zero; the bias is bucket -1."""
        w = self.weights(self.z, self.n, self.s.l1)
        at = np.flatnonzero(w)
        bias = self.weights(np.array([self.bias_z]), np.array([self.bias_n]), 0.0)
        return np.concatenate([[-1], at]), np.concatenate([bias, w[at]])


def training_rows(docs: DataFrame, labels: DataFrame, eligible, settings: Settings) -> DataFrame:
    """(text, toxic, order) of the labelled rows that the fit uses. Rows without an id or a 0/1 label are none.

    An id labelled twice counts once, as toxic if any label says so.
    """
    chosen = smallest(
        labels.where(eligible & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("order", F.xxhash64("doc_id")),
        "order",
        settings.max_training,
    )
    # At most max_training rows of three numbers: a bound set by the parameter.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", "order")


def fit(docs: DataFrame, labels: DataFrame, eligible, settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """Weights learned from the labelled rows for which ``eligible`` (a condition on doc_id) holds."""
    buckets = settings.buckets

    def extract(batches):
        for part, data, bounds in tokens.slices(batches):
            owner, found = distinct(*features(data, bounds, buckets), buckets)
            offsets = np.searchsorted(owner, np.arange(len(part) + 1)).astype(np.int32)
            yield pa.record_batch(
                {
                    "toxic": part.column("toxic"),
                    "order": part.column("order"),
                    "found": pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.astype(np.int32))),
                }
            )

    def learn(batches):
        model = Ftrl(settings)
        for batch in batches:
            found, label = batch.column("found"), batch.column("toxic").to_pylist()
            values, offsets = found.values.to_numpy(), found.offsets.to_numpy()
            for row, toxic in enumerate(label):
                model.learn(values[offsets[row] : offsets[row + 1]], toxic)
        at, weight = model.model()
        yield pa.record_batch({"bucket": pa.array(at, pa.int64()), "weight": pa.array(weight, pa.float64())})

    rows = training_rows(docs, labels, eligible, settings).mapInArrow(
        extract, "toxic int, order long, found array<int>"
    )
    epochs = F.explode(F.array(*(F.lit(e) for e in range(settings.epochs)))).alias("epoch")
    one = (
        rows.select("*", epochs)
        .repartition(1)
        .sortWithinPartitions("epoch", "order")
        .select("toxic", "found")
        .mapInArrow(learn, "bucket long, weight double")
        .toPandas()  # the non-zero weights, at most `buckets`
    )
    return one["bucket"].to_numpy(np.int64), one["weight"].to_numpy(np.float64)


def margins(data: np.ndarray, bounds: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    """Log-odds of each text: the bias and the weight of each distinct feature."""
    owner, found = features(data, bounds, len(table))
    hit = np.flatnonzero(table[found])
    owner, found = distinct(owner[hit], found[hit], len(table))
    return bias + np.bincount(owner, table[found], len(bounds) - 1)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], settings: Settings = Settings(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, score and predicted class of every row. Empty and null texts score as the bias alone."""
    buckets = settings.buckets
    at, weight = model
    bias = float(weight[at < 0].sum())
    at, weight = at[at >= 0].astype(np.int32), weight[at >= 0].astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((at, weight))  # bounded by `buckets`
    kept = docs.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]):
        table = np.zeros(buckets, np.float32)
        table[shared.value[0]] = shared.value[1]
        for part, data, bounds in tokens.slices(batches):
            value = 1 / (1 + np.exp(-np.clip(margins(data, bounds, table, bias), -35, 35)))
            yield pa.record_batch(
                {
                    **{name: part.column(name) for name in keep},
                    "score": pa.array(value),
                    "predicted": pa.array((value >= settings.threshold).astype(np.int32)),
                }
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep)
    return kept.mapInArrow(run, f"{schema}, score double, predicted int")


def held_out(fold: int = 2, folds: int = 4):
    """Rows that the fit never sees: crc32 of the id as text leaves ``fold``. A null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Repeated rows are scored each; without any labelled row every score is one half. Other columns are not used.
    """
    model = fit(docs, labels, ~held_out(), settings)
    return score(docs, model, settings).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def clean(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with all their columns."""
    at, weight = fit(docs, labels, ~held_out(), settings)
    bias = float(weight[at < 0].sum())
    shared = docs.sparkSession.sparkContext.broadcast((at[at >= 0], weight[at >= 0]))
    limit = np.log(settings.threshold / (1 - settings.threshold))

    def run(batches):
        table = np.zeros(settings.buckets, np.float32)
        table[shared.value[0]] = shared.value[1]
        for part, data, bounds in tokens.slices(batches):
            yield part.filter(pa.array(margins(data, bounds, table, bias) < limit))

    return docs.mapInArrow(run, docs.schema)
