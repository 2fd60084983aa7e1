"""Names for rows and columns."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_key() -> Column:
    """A hash of doc_id and text: equal rows have equal keys, also those without an id."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")))


def fresh(name: str, taken: Collection[str]) -> str:
    """A column name that is not taken."""
    taken = {t.lower() for t in taken}
    while name in taken:
        name += "_"
    return name


def smallest(rows: DataFrame, order: str, count: int) -> DataFrame:
    """The ``count`` rows of the smallest hash ``order``.

    Where there are many more, a cut through the range of the hash leaves about twice as many first, so that what
    the tasks hand on to be ordered is bounded too.
    """
    total = rows.count()
    if total > 2 * count:
        rows = rows.where(F.col(order) < int(-(2**63) + 2**64 * (2 * count / total)))
    return rows.orderBy(order).limit(count)
