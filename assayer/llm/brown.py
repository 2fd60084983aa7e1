"""Language-model scores by a class-based bigram model with exchange clustering.

P(word | word before) = P(class | class before) * P(word | class). Every word of the training texts gets a class of its own
accord, however large the vocabulary; only words that none of them has take the class of a group of words that end alike.

1. Words of all training texts are counted, in the tasks first, then by a shuffle on their hash.
2. Seed: the ``words`` most frequent words, the groups of other words that end alike, and the end of a text are units.
   Neighbouring units are counted over all training texts, and exchange clustering moves each unit in turn to the class
   that raises the likelihood of the class bigrams most, until a sweep moves few.
3. Every other word: the classes of its neighbours are counted, packed per task and shuffled by
   the word's hash, and it gets the class whose neighbours explain them best (the first-order gain of the likelihood).
4. Class bigrams are counted anew over all training texts with these classes. Transitions are smoothed by Witten-Bell with
   the class frequencies, those and emissions by adding one. A class is left for its clustered words or one of its
   endings; a word has the share of its count, plus one, there; all unseen words of an ending share a place.
5. Counts and classes of the ``head`` most frequent words go with the task; those of the other words of a text are joined
   by hash and brought to the text. What is kept of a text then is a class or an ending per word, used twice.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import tokens
from assayer.llm.rows import row_key
from assayer.session import settle

_U = np.uint64
END = 0
CODED = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, seen double, units binary"
SUMMED = "doc_id long, held_out boolean, n_tokens long, n_known long, seen double, total double"
PACKED = "bucket int, hashes binary, contexts binary, counts binary"


@dataclass(frozen=True)
class Settings:
    """words: seed units of one word; endings: units of words that end alike; classes (up to 128); head: counts that
    tasks hold."""

    words: int = 1_024
    endings: int = 256
    classes: int = 64
    head: int = 65_536
    sweeps: int = 6
    #: Distinct words that a task counts before it hands them on.
    flush: int = 500_000
    #: Tokens whose neighbours a task takes to choose classes.
    share: int = 4_000_000


def endings(data: np.ndarray, found: tokens.Words, count: int) -> np.ndarray:
    """The ending of each word: a number for its last two bytes, A-Z lower-cased."""
    lower = np.arange(256)
    lower[65:91] += 32
    last, before = lower[data[found.end - 1]], lower[data[np.maximum(found.end - 2, found.begin)]]
    return (tokens.mix((last * 256 + before).astype(np.uint64)) % _U(count)).astype(np.int64)


def word_counts(docs: DataFrame, settings: Settings) -> DataFrame:
    """(hash, ending, n) of every word of ``docs``."""

    def run(batches):
        kept: list[tuple[np.ndarray, ...]] = []

        def total():
            hashes, ending, n = (np.concatenate(x) for x in zip(*kept, strict=True))
            names, at, group = np.unique(hashes, return_index=True, return_inverse=True)
            return names, ending[at], np.bincount(group, n).astype(np.int64)

        def batch(names, ending, n):
            return tokens.blocks([{"hash": names.view(np.int64), "ending": ending.astype(np.int32), "n": n}])

        for part, data, bounds in tokens.slices(batches):
            found = tokens.words(data, bounds, lower=True)
            names, at, n = np.unique(found.hash, return_index=True, return_counts=True)
            kept.append((names, endings(data, found, settings.endings)[at], n))
            if sum(len(k[0]) for k in kept) > settings.flush:
                kept = [total()]
                if len(kept[0][0]) > settings.flush:
                    yield from batch(*kept.pop())
        if kept:
            yield from batch(*total())

    return (
        docs.select("text")
        .mapInArrow(run, "hash long, ending int, n long")
        .groupBy("hash")
        .agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))
    )


@dataclass
class Lexicon:
    """Sorted hashes of the head words with their counts and units; unit numbers of endings start at ``words + 1``."""

    hash: np.ndarray
    count: np.ndarray
    unit: np.ndarray
    words: int
    endings: int

    @property
    def units(self) -> int:
        return self.words + 1 + self.endings

    def look_up(self, data: np.ndarray, found: tokens.Words) -> tuple[np.ndarray, np.ndarray]:
        """Unit of each word, and its count if it is a head word (else -1)."""
        unit = endings(data, found, self.endings) + self.words + 1
        if not len(self.hash):
            return unit, np.full(len(found), -1)
        at = np.minimum(np.searchsorted(self.hash, found.hash), len(self.hash) - 1)
        hit = self.hash[at] == found.hash
        unit = np.where(hit & (self.unit[at] > 0), self.unit[at], unit)
        return unit, np.where(hit, self.count[at], -1)


def lexicon(counts: DataFrame, settings: Settings) -> Lexicon:
    """The most frequent words, at most ``head`` of them.

    A histogram of the counts (on a scale of a few thousand steps) gives the least count that still fits; words
    of equal steps are taken together or not at all. So no task or driver sees more than ``head`` words of others.
    """
    step = F.floor(F.log("n") * 200).cast("int")
    total, least = 0, None
    for row in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        total += row["count"]
        if total > settings.head:
            break
        least = row["step"]
    top = counts.where(step >= least if least is not None else F.lit(False)).select("hash", "n").toPandas()
    top = top.sort_values(["n", "hash"], ascending=[False, True])
    hashes, n = top["hash"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    unit = np.where(np.arange(len(top)) < settings.words, np.arange(len(top)) + 1, 0)
    order = np.argsort(hashes)
    return Lexicon(hashes[order], n[order], unit[order], settings.words, settings.endings)


def with_ends(unit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit before, unit) of every token of the texts, each text ending with END and following one."""
    count = np.diff(first)
    out = np.full(len(unit) + len(count), END)
    out[np.arange(len(unit)) + np.repeat(np.arange(len(count)), count)] = unit
    before = np.r_[END, out[:-1]]
    return before, out


def unit_bigrams(docs: DataFrame, lex: Lexicon) -> np.ndarray:
    """Counts of neighbouring units over ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(lex))  # at most `head` entries

    def pairs(batches):
        own = Lexicon(**shared.value)
        for _, data, bounds in tokens.slices(batches):
            found = tokens.words(data, bounds, lower=True)
            yield with_ends(own.look_up(data, found)[0], found.first)

    return bigrams(docs.select("text"), pairs, lex.units)


def bigrams(rows: DataFrame, pairs, size: int) -> np.ndarray:
    """Sum of the neighbours that ``pairs`` gives for batches of ``rows``."""

    def count(batches):
        table = np.zeros(size * size, np.int64)
        for before, unit in pairs(batches):
            table += np.bincount(before * size + unit, minlength=size * size)
        rows = table.reshape(size, size)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.record_batch(
            {"unit": pa.array(used, pa.int32()), "after": pa.array([rows[u].tobytes() for u in used], pa.binary())}
        )

    def add(batches):
        rows: dict[int, np.ndarray] = {}
        for batch in batches:
            for unit, after in zip(batch.column("unit").to_pylist(), batch.column("after").to_pylist(), strict=True):
                rows[unit] = rows.get(unit, 0) + np.frombuffer(after, np.int64)
        yield pa.record_batch(
            {"unit": pa.array(list(rows), pa.int32()), "after": pa.array([r.tobytes() for r in rows.values()], pa.binary())}
        )

    schema = "unit int, after binary"
    table = np.zeros((size, size), np.int64)
    for row in rows.mapInArrow(count, schema).repartition("unit").mapInArrow(add, schema).toLocalIterator():
        table[row["unit"]] = np.frombuffer(row["after"], np.int64)
    return table


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(table: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Class of each unit. END keeps class 0 for itself; units that never occur stay where they start."""
    size = len(table)
    table = table.astype(np.float64)
    weight = table.sum(axis=0)
    label = np.zeros(size, np.int64)
    by_weight = np.argsort(-weight[1:], kind="stable") + 1
    label[by_weight] = np.arange(size - 1) % (classes - 1) + 1
    one = np.zeros((size, classes))
    one[np.arange(size), label] = 1
    between = one.T @ table @ one
    for _ in range(sweeps):
        moved = 0
        for unit in by_weight:
            if not weight[unit]:
                continue
            own, twice = label[unit], table[unit, unit]
            right, left = table[unit] @ one, table[:, unit] @ one
            right[own] -= twice
            left[own] -= twice
            between[own] -= right
            between[:, own] -= left
            between[own, own] -= twice
            to, come = between.sum(axis=1), between.sum(axis=0)
            gain_row, gain_column = _f(between + right) - _f(between), _f(between + left[:, None]) - _f(between)
            diagonal = np.diag(between)
            gain = gain_row.sum(axis=1) - np.diag(gain_row) + gain_column.sum(axis=0) - np.diag(gain_column)
            gain += _f(diagonal + right + left + twice) - _f(diagonal)
            gain -= _f(to + right.sum() + twice) - _f(to) + _f(come + left.sum() + twice) - _f(come)
            gain[0] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[own] + 1e-9:
                best = own
            between[best] += right
            between[:, best] += left
            between[best, best] += twice
            if best != own:
                one[unit, own], one[unit, best] = 0, 1
                label[unit] = best
                moved += 1
        if moved <= size // 200:
            break
    return label


@dataclass
class Model:
    """label: class of each unit; step: log10 P(class | class before); emit: log10 of what a unit adds in its class."""

    label: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def model(table: np.ndarray, label: np.ndarray, kinds: np.ndarray, mass: np.ndarray, settings: Settings) -> Model:
    """``kinds``, ``mass``: distinct words and tokens per ending, without the words that are units."""
    classes = settings.classes
    one = np.zeros((len(label), classes))
    one[np.arange(len(label)), label] = 1
    between = one.T @ table @ one
    frequency = between.sum(axis=0)
    plain = (frequency + 1) / (frequency.sum() + classes)
    total, kinds_after = between.sum(axis=1, keepdims=True), (between > 0).sum(axis=1, keepdims=True)
    share = np.where(total > 0, kinds_after / np.maximum(total + kinds_after, 1), 1.0)
    step = (1 - share) * between / np.maximum(total, 1) + share * plain
    count = table.sum(axis=0)
    emit = np.log10((count + 1) / (frequency + one.sum(axis=0))[label])
    emit[END] = 0.0
    emit[settings.words + 1 :] -= np.log10(mass + kinds + 1)
    return Model(label, np.log10(step), emit)


def explained(right: np.ndarray, left: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Class of each word from the counts of the classes after (``right``) and before it: the largest first-order gain."""
    log = np.log(between + 0.5)
    gain = right @ log.T + left @ log
    gain -= right.sum(axis=1, keepdims=True) * np.log(between.sum(axis=1) + 0.5)
    gain -= left.sum(axis=1, keepdims=True) * np.log(between.sum(axis=0) + 0.5)
    gain[:, END] = -np.inf
    return np.argmax(gain, axis=1)


def further(train: DataFrame, lex: Lexicon, label: np.ndarray, between: np.ndarray, settings: Settings, total: int) -> DataFrame:
    """(hash, class, n) of the words that are no units. total: tokens of ``train``."""
    spark, classes = train.sparkSession, settings.classes
    # a task that chooses takes the neighbours of so many tokens at most, on average
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // settings.share))
    shared = spark.sparkContext.broadcast((vars(lex), label, between))

    def add_up(hashes, context, n):
        order = np.lexsort((context, hashes))
        hashes, context, n = hashes[order], context[order], n[order]
        new = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (context[1:] != context[:-1])][: len(hashes)])
        # sums keep the type of the counts, as they are sent as bytes
        return hashes[new], context[new], np.add.reduceat(n, new, dtype=n.dtype) if len(new) else n

    def send(batches):
        own, kinds = Lexicon(**shared.value[0]), shared.value[1]
        kept = []

        def flush():
            hashes, context, n = kept.pop()
            bucket = (tokens.mix(hashes) % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
            rows = [r for r in rows if len(r)]
            packed = lambda x: pa.array([x[r].tobytes() for r in rows], pa.binary())
            numbers = pa.array([int(bucket[r[0]]) for r in rows], pa.int32())
            return pa.record_batch({"bucket": numbers, "hashes": packed(hashes), "contexts": packed(context), "counts": packed(n)})

        for _, data, bounds in tokens.slices(batches):
            found = tokens.words(data, bounds, lower=True)
            unit, _ = own.look_up(data, found)
            before, token = with_ends(unit, found.first)
            at = np.flatnonzero(unit > own.words)
            place = at + found.owner()[at]
            context = np.r_[kinds[before[place]], classes + kinds[token[place + 1]]].astype(np.uint8)
            kept.append(add_up(np.r_[found.hash[at], found.hash[at]], context, np.ones(2 * len(at), np.int32)))
            if sum(len(k[0]) for k in kept) > 4 * settings.flush:
                kept = [add_up(*(np.concatenate(x) for x in zip(*kept, strict=True)))]
                if len(kept[0][0]) > 2 * settings.flush:
                    yield flush()
        if kept:
            kept = [add_up(*(np.concatenate(x) for x in zip(*kept, strict=True)))]
            yield flush()

    def choose(batches):
        parts = [
            [np.frombuffer(v.as_py(), kind) for v in batch.column(name)]
            for batch in batches
            for name, kind in (("hashes", np.uint64), ("contexts", np.uint8), ("counts", np.int32))
        ]
        if not parts:
            return
        hashes, context, n = add_up(*(np.concatenate([x for p in parts[i::3] for x in p]) for i in range(3)))
        first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)])
        edge = np.r_[first, len(hashes)]
        for at in range(0, len(first), 8_192):
            own = edge[at : at + 8_193]
            rows = slice(own[0], own[-1])
            counts = np.zeros((len(own) - 1, 2 * classes))
            counts[np.repeat(np.arange(len(own) - 1), np.diff(own)), context[rows]] = n[rows]
            left, right = counts[:, :classes], counts[:, classes:]
            best = explained(right, left, shared.value[2])
            yield from tokens.blocks(
                [{"hash": hashes[own[:-1]].view(np.int64), "class": best.astype(np.int32), "n": left.sum(axis=1).astype(np.int64)}]
            )
        tokens.give_back()

    return train.select("text").mapInArrow(send, PACKED).repartitionById(buckets, "bucket").mapInArrow(choose, "hash long, class int, n long")


def coded(rows: DataFrame, lex: Lexicon, kind: np.ndarray, words: DataFrame, settings: Settings, ends: int) -> DataFrame:
    """Each text as its units: a class, or ``classes`` + ending. ``kind``: class of the head words, -1 for their ending."""
    shared = rows.sparkSession.sparkContext.broadcast((vars(lex), kind))

    def rare(batches):
        own = Lexicon(**shared.value[0])
        for part, data, bounds in tokens.slices(batches):
            found = tokens.words(data, bounds, lower=True)
            at = np.flatnonzero(own.look_up(data, found)[1] < 0)
            keys = part.column("key").to_numpy()[found.owner()[at]]
            order = np.lexsort((found.hash[at], keys))
            keys, hashes = keys[order], found.hash[at][order]
            new = np.r_[True, (keys[1:] != keys[:-1]) | (hashes[1:] != hashes[:-1])][: len(keys)]
            yield from tokens.blocks([{"key": keys[new], "hash": hashes[new].view(np.int64)}])

    notes = rows.select("key", "text").mapInArrow(rare, "key long, hash long").join(words, "hash")
    notes = notes.groupBy("key").agg(F.collect_set(F.struct("hash", "n", "class")).alias("notes"))

    def code(batches):
        own, kinds = Lexicon(**shared.value[0]), shared.value[1]
        for part, data, bounds in tokens.slices(batches):
            found = tokens.words(data, bounds, lower=True)
            unit = endings(data, found, own.endings) + settings.classes
            _, count = own.look_up(data, found)
            text, head = found.owner(), np.flatnonzero(count >= 0)
            own_class = np.full(len(found), -1)
            own_class[head] = kinds[np.searchsorted(own.hash, found.hash[head])]
            lists = part.column("notes")
            size = np.asarray(lists.value_lengths().fill_null(0))
            values = lists.flatten()
            name, n, cls = (values.field(f).to_numpy(zero_copy_only=False) for f in ("hash", "n", "class"))
            # A word of a text is found by both numbers in one sorted hash.
            salt = tokens.mix(np.arange(len(part), dtype=np.uint64) + _U(1))
            known = np.repeat(salt, size) ^ name.astype(np.int64).view(np.uint64)
            order = np.argsort(known)
            at = np.flatnonzero(count < 0)
            if len(order) and len(at):
                wanted = salt[text[at]] ^ found.hash[at]
                place = np.minimum(np.searchsorted(known[order], wanted), len(order) - 1)
                hit = known[order][place] == wanted
                count[at[hit]], own_class[at[hit]] = n[order][place[hit]], cls[order][place[hit]]
            unit = np.where(own_class >= 0, own_class, unit).astype(np.uint16)
            seen = np.where(count >= 0, np.log10(np.maximum(count, 0) + 1.0), 0.0)
            yield pa.record_batch(
                {
                    "key": part.column("key"),
                    "doc_id": part.column("doc_id"),
                    "held_out": part.column("held_out"),
                    "n_tokens": pa.array(found.counts + 1, pa.int64()),
                    "n_known": pa.array(np.bincount(text, count >= 0, len(part)).astype(np.int64) + (ends > 0)),
                    "seen": pa.array(np.bincount(text, seen, len(part))),
                    "units": pa.array([unit[a:b].tobytes() for a, b in zip(found.first[:-1], found.first[1:], strict=True)], pa.binary()),
                }
            )

    return rows.join(notes, "key", "left").mapInArrow(code, CODED)


def _units(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit before, unit, text) of every token of coded texts."""
    data, bounds = tokens.texts_of(part.column("units"))
    unit = data[bounds[0] : bounds[-1]].view(np.uint16).astype(np.int64)
    first = (bounds - bounds[0]) // 2
    return *with_ends(unit, first), np.repeat(np.arange(len(part)), np.diff(first) + 1)


def score(docs: DataFrame, held_out, settings: Settings = Settings()) -> DataFrame:
    """Scores of all rows of ``docs``, learned from those for which ``held_out`` (a condition on doc_id) is not true.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity. A null text is one end
    token; a null id is not held out; repeated rows are learned from and scored each. Without training rows
    every word is unknown and the model is the smoothing alone. Other columns are not read.
    """
    out = F.coalesce(held_out, F.lit(False))
    train = docs.where(~out)
    counts = settle(word_counts(train, settings), "word-counts")
    ends = train.count()
    sums = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_train, n_kinds = sums[1] + ends, sums[0] + (ends > 0)
    lex = lexicon(counts, settings)
    table = unit_bigrams(train, lex)
    label = exchange(table, settings.classes, settings.sweeps)
    one = np.eye(settings.classes)[label]
    others = settle(further(train, lex, label, one.T @ table @ one, settings, n_train), "classes")

    kind = np.where(lex.unit > 0, label[lex.unit], -1)
    if len(lex.hash):  # the head holds all words from its least count on
        top = others.where(F.col("n") >= int(lex.count.min())).select("hash", "class").toPandas()
        kind[np.searchsorted(lex.hash, top["hash"].to_numpy(np.int64).view(np.uint64))] = top["class"].to_numpy(np.int64)
    words = others.where(F.col("n") < int(lex.count.min())) if len(lex.hash) else others
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(row_key().alias("key"), "doc_id", out.alias("held_out"), text.alias("text"))
    rows = settle(coded(rows, lex, kind, words, settings, ends), "coded")

    # Units are now the end, the words of each class, and the endings of words that were not seen.
    size, first = settings.classes + settings.endings, settings.classes
    pairs = lambda batches: (_units(part)[:2] for part in batches)
    table = bigrams(rows.where(~F.col("held_out")).select("units"), pairs, size)
    kinds = np.bincount(label[lex.unit[lex.unit > 0]], minlength=first).astype(float)
    for r in others.groupBy("class").count().collect():
        kinds[r["class"]] += r["count"]
    mass = table.sum(axis=0)
    fitted = model(table, np.r_[np.arange(first), label[lex.words + 1 :]], np.zeros(settings.endings), mass[first:], replace(settings, words=first - 1))
    fitted.emit[1:first] -= np.log10(np.maximum(mass[1:first] + kinds[1:], 1))
    model_of = docs.sparkSession.sparkContext.broadcast(vars(fitted))

    def run(batches):
        classes = Model(**model_of.value)
        for part in batches:
            before, unit, text = _units(part)
            step = classes.step[classes.label[before], classes.label[unit]] + classes.emit[unit]
            names = ("doc_id", "held_out", "n_tokens", "n_known", "seen")
            yield pa.record_batch({**{n: part.column(n) for n in names}, "total": pa.array(np.bincount(text, step, len(part)))})

    space = float(np.log10(n_train + n_kinds + 1))
    return rows.mapInArrow(run, SUMMED).select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("seen") + float(np.log10(ends + 1.0)) - space * F.col("n_tokens")).alias("base_score"),
        (F.col("total") + F.col("seen")).alias("score"),
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
