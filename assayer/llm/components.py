"""Connected components of a link table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.session import materialize


def _linked(pairs: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller node."""
    return (
        pairs.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .dropDuplicates()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b: long); a component is named after its smallest node.

    Alternates two rewritings of the links until nothing changes: every node hands its larger neighbours to its
    smallest neighbour, then its smaller ones too. What remains are stars around the smallest nodes; the rounds
    grow with the logarithm of the longest path. Both are a grouped minimum and a join on the node, so no
    neighbourhood is ever collected. Each round is written to the shared folder.
    """
    links = materialize(_linked(links), "links")
    while True:
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(
            links.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        least = both.groupBy("node").agg(F.min("other").alias("least"))
        least = least.select("node", F.least("node", "least").alias("least"))
        large = both.where("other > node").join(least, "node").select(F.col("other").alias("a"), F.col("least").alias("b"))
        large = materialize(_linked(large), "links")
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a")
        moved = small.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        changed = materialize(_linked(moved.unionAll(least.select("a", F.col("least").alias("b")))), "links")
        # A star has every node linked to one smaller node and no such node linked further.
        roots = changed.select(F.col("b").alias("a")).distinct()
        deep = changed.groupBy("a").count().where("count > 1").select("a").unionAll(changed.join(roots, "a", "left_semi").select("a"))
        links = changed
        if deep.isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
                links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
