"""Opponent graphs: bounded breadth-first crawls, reachability and components.

A crawl goes level by level. All users of a level are expanded by one join, and those that are
known are taken out by an anti join; each level is written down before the next one, so that
plans stay short. Known means enqueued, not seen: with a cap, edges to users beyond it are
still recorded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from castleflow.operators import stars
from castleflow.operators.shared import settle


@dataclass(frozen=True)
class Bounds:
    depth: int
    max_users: int | None = None
    max_jobs: int | None = None

    def __post_init__(self) -> None:
        if self.depth < 0:
            raise ValueError("depth must be >= 0")
        if any(cap is not None and cap <= 0 for cap in (self.max_users, self.max_jobs)):
            raise ValueError("caps must be > 0")

    @property
    def most(self) -> int | None:
        caps = [c for c in (self.max_users, self.max_jobs) if c is not None]
        return min(caps, default=None)


def crawl(neighbours: DataFrame, seeds: DataFrame, bounds: Bounds) -> tuple[DataFrame, DataFrame]:
    """(edges, visited) of a crawl from ``seeds`` (provider, user_id).

    ``neighbours`` has provider, user_id, opponent_id, opponent_username, via_game_id and
    game_count. Edges add depth; visited has provider, user_id and depth. With a cap, new users
    are taken by the order of their first parent, then by games and name, as a queue would.
    """
    start = seeds.select("provider", "user_id").distinct().select("provider", "user_id", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("turn"))
    visited = settle(start, "visited")
    frontier, used = visited, visited.count() if bounds.most is not None else 0
    levels = []
    for depth in range(1, bounds.depth + 1):
        reached = frontier.select("provider", "user_id", "turn").join(neighbours, ["provider", "user_id"])
        known = visited.select("provider", F.col("user_id").alias("opponent_id"))
        level = settle(reached.join(known, ["provider", "opponent_id"], "left_anti").withColumn("depth", F.lit(depth)), "level")
        levels.append(level)
        turn = F.struct("turn", (-F.col("game_count")).alias("games"), F.col("opponent_username").alias("name"))
        fresh = level.groupBy("provider", F.col("opponent_id").alias("user_id")).agg(F.min(turn).alias("first"))
        if bounds.most is None:
            fresh = fresh.select("provider", "user_id", F.lit(depth).alias("depth"), F.lit(0).cast("bigint").alias("turn"))
        else:  # at most as many rows as the cap leaves are ordered in one place
            order = [F.col("first"), F.col("provider"), F.col("user_id")]
            room = max(0, bounds.most - used)
            fresh = fresh.orderBy(*order).limit(room).select("provider", "user_id", F.lit(depth).alias("depth"), F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("turn"))
        frontier = settle(fresh, "frontier")
        grown = frontier.count()
        used += grown
        visited = visited.unionByName(frontier)
        if not grown:
            break
    columns = ["provider", F.col("user_id").alias("from_user_id"), F.col("opponent_id").alias("to_user_id"), "via_game_id", "game_count", "depth"]
    if not levels:
        empty = neighbours.withColumn("depth", F.lit(0)).where("false")
        return empty.select(*columns), visited.drop("turn")
    edges = levels[0]
    for level in levels[1:]:
        edges = edges.unionByName(level)
    return edges.select(*columns), visited.drop("turn")


def reachable(neighbours: DataFrame, seeds: DataFrame) -> DataFrame:
    """(provider, user_id, depth) of all users that can be reached; as many levels as it takes."""
    visited = settle(seeds.select("provider", "user_id").distinct().withColumn("depth", F.lit(0)), "visited")
    frontier, depth = visited, 0
    links = neighbours.select("provider", "user_id", "opponent_id")
    while True:
        depth += 1
        next_ = frontier.select("provider", "user_id").join(links, ["provider", "user_id"]).select("provider", F.col("opponent_id").alias("user_id")).distinct()
        frontier = settle(next_.join(visited.select("provider", "user_id"), ["provider", "user_id"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            return visited
        visited = settle(visited.unionByName(frontier), "visited")


def components(neighbours: DataFrame) -> DataFrame:
    """(provider, user_id, component): the smallest user that links lead to, over links in either direction."""
    links = neighbours.select("provider", F.col("user_id").alias("a"), F.col("opponent_id").alias("b"))
    nodes = neighbours.select("provider", "user_id").unionByName(neighbours.select("provider", F.col("opponent_id").alias("user_id"))).distinct()
    named = stars.components(links, ("provider",)).withColumnRenamed("node", "user_id")
    return nodes.join(named, ["provider", "user_id"], "left").withColumn("component", F.coalesce("component", "user_id"))
