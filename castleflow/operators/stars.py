"""Connected components of an undirected graph, by alternating large and small stars.

(Kiveris et al., "Connected Components in MapReduce and Beyond", SoCC 2014.) Every step is a
minimum for each node and a join, so that a node with very many neighbours is never collected, and
a chain takes a logarithm of its length in rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castleflow.operators.shared import settle


def components(edges: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """(*key, node, component): the smallest node that can be reached, of each node that an edge (*key, a, b) names and that isn't smallest itself.

    Graphs with different ``key`` are apart. Null nodes are none.
    """
    columns, at = [*key, "a", "b"], [*key, "a"]

    def large(links: DataFrame) -> DataFrame:
        both = links.unionByName(links.select(*key, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*at).agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.where("b > a").join(low, at).where("b != m").select(*key, F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    def small(links: DataFrame) -> DataFrame:
        down = links.select(*key, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy(*at).agg(F.min("b").alias("m"))
        moved = down.join(low, at).where("b != m").select(*key, F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(low.select(*at, F.col("m").alias("b"))).distinct()

    held = settle(edges.where("a != b").select(*columns).distinct(), "stars")
    seen = None
    while True:
        mark = held.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
        if mark == seen:
            return held.select(*key, F.col("a").alias("node"), F.col("b").alias("component"))
        seen = mark
        held = settle(small(large(held)), "stars")
