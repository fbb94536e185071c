"""Connected components of links between ids, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import stage


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Hook neighbours to the smallest one: the larger ones (`both`) or the smaller ones.

    The smallest neighbour is an aggregate that combines before its shuffle; the join with it has one
    row per node on its small side, so a node with very many links is split by adaptive execution.
    """
    sides = edges.select("a", "b")
    if both:
        sides = sides.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = sides.groupBy("a").agg(F.min("b").alias("least"))
    least = least.withColumn("least", F.least("a", "least"))
    joined = sides.join(least, "a")
    if both:
        made = joined.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        made = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))
        )
    return made.filter("a > b").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest id reachable, for every id that has a link.

    Alternates large and small stars until nothing changes; a star of any size takes one round.  The
    edges of each round are written, so a lost executor costs a re-read.
    """
    pairs = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct()
    edges = stage(pairs, "links")
    state = _state(edges)
    while state[0]:
        edges = stage(_star(_star(edges, True), False), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    hooked = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return hooked.unionByName(roots)
