"""Filter interaction audit: what each of five filters removes, in each order in which they may be applied.

A document is, for this purpose, the set of filters that it fails: one of 32 masks. In the 120 orders, ranked
lexicographically (Lehmer rank), the orders that begin with given filters are one interval of ranks, (5 - k)! long for k
filters. So the orders in which a mask is removed at step k by filter f are the intervals of those beginnings of length k that
hold no filter of the mask but f at their end; likewise for orders that keep it, or that reach one of its filters too late.
``INTERVALS``, built by that rule, lists them for every mask. Documents are counted by (part, mask, labels); each count is
added where an interval begins and subtracted where it ends, and one running sum over the 120 ranks gives every total.

Documents meet only in grouped counts. Equal texts are found by a 128-bit digest: the least doc_id per digest is a
grouped minimum, and it is joined back on (digest, doc_id), so the copies of one text stay spread over all tasks.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.session import materialize

FILTERS = "ABCDE"
WORD_BREAK = r"[\x20\x09-\x0D]+"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def beginnings() -> dict[str, tuple[int, int]]:
    """The interval of ranks, end exclusive, of the orders with each beginning."""
    found: dict[str, tuple[int, int]] = {}
    for rank, order in enumerate(ORDERS):
        for size in range(1, len(order) + 1):
            low, _ = found.get(order[:size], (rank, rank))
            found[order[:size]] = (low, rank + 1)
    return found


def intervals() -> list[tuple[int, int, str, int, int]]:
    """(mask, step, count, low, high): ranks at which a document of that mask adds to a count of that step."""
    out = []
    for mask in range(1 << len(FILTERS)):
        fails = {f for i, f in enumerate(FILTERS) if mask >> i & 1}
        for start, (low, high) in beginnings().items():
            step, last, earlier = len(start), start[-1], bool(fails & set(start[:-1]))
            kinds = []
            if not fails & set(start):
                kinds.append("kept")
            if last in fails:
                kinds.append("redundant" if earlier else "removed")
            if fails == {last}:
                kinds.append("unique_fails")
            out += [(mask, step, kind, low, high) for kind in kinds]
    return out


INTERVALS = intervals()


def failures(text: Column) -> Column:
    """The filters, but for repeated texts, that a text fails, as bits of a mask."""
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    sized = F.transform(
        F.array(words),
        lambda w: F.when(F.size(w) < 50, 1).otherwise(0)
        + F.when(100 * F.size(F.array_distinct(w)) < 65 * F.size(w), 2).otherwise(0),
    )
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return (
        F.get(sized, F.lit(0))
        + F.when(100 * capitals > 5 * F.length(text), 4).otherwise(0)
        + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)
    )


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by what they fail, and those labelled.

    A text repeats another if a smaller doc_id has it; without a doc_id nothing is smaller. An id labelled twice is
    good, or toxic, if any of its labels says so.
    """
    text = F.coalesce("text", F.lit(""))
    rows = materialize(
        docs.select(
            "doc_id",
            F.coalesce("source", F.lit("")).alias("part"),
            F.md5(text).alias("digest"),
            failures(text).alias("failed"),
        )
        .groupBy("doc_id", "digest", "part", "failed")
        .agg(F.count("*").alias("n")),
        "audit-rows",
    )
    least = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = least.withColumn("first", F.lit(True))
    judged = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    repeats = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 16).otherwise(0)
    return (
        rows.join(first, ["digest", "doc_id"], "left")
        .groupBy("doc_id", "part", (F.col("failed") + repeats).alias("mask"))
        .agg(F.sum("n").alias("n"))  # an id, or none, that many rows share meets its labels once
        .join(judged, "doc_id", "left")
        .groupBy("part", "mask")
        .agg(
            F.sum("n").alias("n"),
            F.coalesce(F.sum(F.when(F.col("good"), F.col("n"))), F.lit(0)).alias("good"),
            F.coalesce(F.sum(F.when(F.col("toxic"), F.col("n"))), F.lit(0)).alias("toxic"),
        )
    )


def totals(counted: DataFrame) -> DataFrame:
    """The audit of ``counted`` (part, mask, n, good, toxic): one row per part, order and step."""
    spark = counted.sparkSession
    edges = [
        (mask, step, rank, kind, sign)
        for mask, step, kind, low, high in INTERVALS
        for rank, sign in ((low, 1), (high, -1))
        if rank < len(ORDERS)
    ]
    table = spark.createDataFrame(edges, "mask int, step int, rank int, kind string, sign int")
    # Fixed by the five filters: under 20,000 rows whatever the tables.
    steps = (
        counted.join(F.broadcast(table), "mask")
        .withColumn("signed", F.col("sign") * F.col("n"))
        .groupBy("part", "step", "rank")
        .agg(
            *(F.sum(F.when(F.col("kind") == k, F.col("signed"))).alias(k) for k in COUNTS[:4]),
            F.sum(F.when(F.col("kind") == "removed", F.col("sign") * F.col("good"))).alias("good_lost"),
            F.sum(F.when(F.col("kind") == "removed", F.col("sign") * F.col("toxic"))).alias("toxic_lost"),
        )
    )
    # Every part has its 600 rows, also where nothing changes.
    grid = (
        counted.select("part")
        .distinct()
        .withColumns({"rank": F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) - 1)))})
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
        .withColumn("filter_order", F.get(F.lit(ORDERS), F.col("rank")))
        .withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    )
    so_far = Window.partitionBy("part", "step").orderBy("rank")
    summed = grid.join(steps, ["part", "step", "rank"], "left").select(
        "part", "filter_order", "step", "filter", *(F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(c) for c in COUNTS)
    )
    return summed.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of that step, for every source and all 120 orders of the filters.

    A: under 50 words; B: under 65 % of the words distinct; C: over 5 % capitals A-Z; D: holds one of ``#$%&*|``;
    E: the text of a smaller doc_id. kept: documents left after the step; removed: by it; redundant: fail it but were
    removed earlier; unique_fails: fail it alone; good_lost, toxic_lost: removed by it though labelled good, or toxic;
    shapley: removed by the step's filter, summed over all orders.

    Null texts are empty and repeat each other, a null source is the part of the empty string, repeated rows count each,
    rows without a doc_id repeat nothing and have no label; an empty table has no part; other columns are not used.
    """
    return totals(materialize(masks(docs, labels), "audit-masks"))
