"""Derived frames that reports and graphs share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seats(games: DataFrame) -> DataFrame:
    """One row for each game and colour: all but the seats of the game, ``color``, ``me`` and ``other`` (structs).

    Both sides come from the one row, so that "my seat against the other's" is no join.
    """
    side = lambda color, me, other: F.struct(F.lit(color).alias("color"), F.col(me).alias("me"), F.col(other).alias("other"))
    rest = [c for c in games.columns if c not in ("white", "black")]
    both = F.explode(F.array(side("white", "white", "black"), side("black", "black", "white"))).alias("side")
    return games.select(*rest, both).select(*rest, "side.*")


def game_participants(games: DataFrame) -> DataFrame:
    """The long table of seats."""
    s = seats(games)
    return s.select(F.col("id").alias("game_id"), "color", F.col("me.user_id").alias("provider_user_id"), F.col("me.username").alias("username_normalized"), "me.result_raw", "me.is_winner", "me.is_ai")


def ratings_at_game(games: DataFrame) -> DataFrame:
    return seats(games).select(F.col("id").alias("game_id"), "color", "me.rating", "me.rating_diff", "me.rd")


def with_states(payloads: DataFrame, states: DataFrame) -> DataFrame:
    """Payloads with the latest of their states; a payload without one keeps what it was landed with."""
    last = states.groupBy(F.col("payload").alias("id")).agg(F.max_by(F.struct("parser_version", "normalization_status", "normalized_at"), "normalized_at").alias("_state"))
    held = payloads.join(last, "id", "left")
    return held.select(*[F.coalesce(f"_state.{c}", c).alias(c) if c in ("parser_version", "normalization_status", "normalized_at") else c for c in payloads.columns])


def count_if(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def within(ended: Column, since: int | None, until: int | None) -> Column:
    """Half-open window that games without an end pass; a bound that is not set is no condition at all."""
    held = F.lit(True)
    if since is not None:
        held = held & (ended.isNull() | (ended >= since))
    if until is not None:
        held = held & (ended.isNull() | (ended < until))
    return held
