"""Connected components of a link table, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MAX_ROUNDS = 60


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """One star step on links (a, b) with a > b. Large star (``both``): the larger
    neighbours of a node link to its smallest neighbour. Small star: a node's
    smaller neighbours, and itself, link to the smallest of them. The smallest
    is found by a partial aggregate and joined back, so no group of
    neighbours is gathered."""
    if both:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    else:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    met = around.join(least, "u")
    out = met.where(F.col("v") > F.col("u")) if both else met
    out = out.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not both:
        out = out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a > b").distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(
        F.count(F.lit(1)),
        F.expr("bit_xor(xxhash64(a, b))"),
        F.expr("bit_xor(xxhash64(b, a, 7))"),
    ).first()
    return tuple(r)


def connected(links: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for each node of the links (a, b).

    Each round works on the link table as a whole and writes it to the shared
    folder; the rounds grow with the logarithm of the longest chain. Links from a
    node to itself are passed over (such a node has no row unless it has another
    link). No links: no rows.
    """
    edges = written(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links"
    )
    before = _state(edges)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        edges = written(_star(written(_star(edges, True), "large"), False), "small")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
