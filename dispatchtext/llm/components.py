"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on directed pairs (a, b). Large: larger neighbours point to the least of all; small: the rest do.

    Per node only a minimum is gathered, so no task holds a node's neighbours; the join by node can be
    split by adaptive execution when one node has very many links.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable) for every node that has a link to another.

    Each round is written to the shared folder. Only two sums per round reach the driver. Stops when a
    round changes nothing; the number of rounds grows with the logarithm of the largest component.
    """
    edges = materialize(
        links.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).filter("a <> b").distinct(),
        "components",
    )

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        edges = materialize(_star(_star(edges, True), False), "components")
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
