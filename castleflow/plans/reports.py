"""The read side: lookups and reports over the archive's tables.

Each takes the tables it needs and returns a lazy frame. A user who is not known gives an
empty frame; a known user without games gives a row of zeros where the report is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castleflow.functions import codes
from castleflow.plans.views import count_if, seats, within


def _user(users: DataFrame, provider: str, username: str) -> DataFrame:
    return users.where((F.col("provider") == provider) & (F.col("username_normalized") == username.strip().lower()))


def _score(color: Column, outcome: Column, prefix: str = "") -> list[Column]:
    return [
        count_if(codes.wins(color, outcome), f"{prefix}wins"),
        count_if(outcome == "draw", "draws"),
        count_if(codes.losses(color, outcome), f"{prefix}losses"),
        count_if(outcome.isNull(), "unfinished"),
    ]


def user_lookup(users: DataFrame, games: DataFrame, snapshots: DataFrame, provider: str, username: str) -> DataFrame:
    """Nine columns of one user, with the numbers of snapshots and of seats in games."""
    me = _user(users, provider, username)
    own = F.broadcast(me.select("id"))  # a name is one user of its provider
    held = snapshots.select(F.col("provider_user_id").alias("id")).join(own, "id").groupBy("id").agg(F.count(F.lit(1)).alias("snapshots"))
    played = seats(games.where(F.col("provider") == provider)).select(F.col("me.user_id").alias("id")).join(own, "id").groupBy("id").agg(F.count(F.lit(1)).alias("games"))
    found = me.join(held, "id", "left").join(played, "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return found.select("id", "provider", "provider_user_id", F.col("username_normalized").alias("username"), "display_username", "account_status", "title", zero("snapshots"), zero("games"))


def game_lookup(games: DataFrame, variants: DataFrame, controls: DataFrame, provider: str, ref: str) -> DataFrame:
    """Twelve columns of the game with the lowest id whose provider id, address or content hash is ``ref``."""
    found = games.where((F.col("provider") == provider) & ((F.col("provider_game_id") == ref) | (F.col("canonical_url") == ref) | (F.col("content_hash") == ref)))
    return (
        with_names(found.orderBy("id").limit(1), variants, controls)
        .select("id", "provider", "provider_game_id", "canonical_url", "outcome", "is_live", "status_raw", "ended_at", "variant", "time_class", F.col("white.username").alias("white"), F.col("black.username").alias("black"))
    )


def with_names(games: DataFrame, variants: DataFrame, controls: DataFrame) -> DataFrame:
    """Games with the names of their variant and time control. Both dictionaries are small; Spark sees their size and broadcasts them."""
    v = variants.select(F.col("id").alias("variant_id"), F.col("canonical_name").alias("variant"), F.col("provider_native_name").alias("variant_raw"))
    c = controls.select(F.col("id").alias("time_control_id"), "time_class", F.col("raw_label").alias("time_control"))
    return games.join(v, "variant_id").join(c, "time_control_id")


def raw_recent(raw: DataFrame, provider: str, limit: int) -> DataFrame:
    """Ten columns of the latest payloads, without their bodies."""
    columns = ["id", "provider", "endpoint_type", "canonical_source_key", "response_status", "content_type", "body_hash", "body_bytes", "normalization_status", "fetched_at"]
    return raw.where(F.col("provider") == provider).select(*columns).orderBy(F.desc("fetched_at"), F.desc("id")).limit(limit)


def provider_summary(providers: DataFrame, users: DataFrame, games: DataFrame) -> DataFrame:
    """Users and games of each provider; each side is counted by itself, so that nothing fans out."""
    u = users.groupBy("provider").agg(F.count("id").alias("users"))
    g = games.groupBy("provider").agg(F.count("id").alias("games"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    every = providers.select(F.col("key").alias("provider"))
    return every.join(u, "provider", "left").join(g, "provider", "left").select("provider", zero("users"), zero("games")).orderBy("provider")


def counts_by(table: DataFrame, *keys: str) -> DataFrame:
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).orderBy(*keys)


def user_game_summary(users: DataFrame, games: DataFrame, provider: str, username: str) -> DataFrame:
    """Fifteen columns of one user: always one row for a known user. A game against oneself counts for both seats."""
    me = _user(users, provider, username).select(F.col("id").alias("user_id"), "provider", F.col("username_normalized").alias("username"), "display_username", "account_status")
    own = F.broadcast(me.select("provider", "user_id"))  # one row: only the user's seats are aggregated
    return me.join(_summaries(games.where(F.col("provider") == provider), own), ["provider", "user_id"], "left").select(*_summary())


def user_summaries(users: DataFrame, games: DataFrame) -> DataFrame:
    """The summary of every user at once, by one aggregation over seats."""
    every = users.select(F.col("id").alias("user_id"), "provider", F.col("username_normalized").alias("username"), "display_username", "account_status")
    return every.join(_summaries(games), ["provider", "user_id"], "left").select(*_summary())


def _summary() -> list[Column | str]:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    counts = [zero(c) for c in ("games", "rated_games", "unrated_games", "wins", "draws", "losses", "unfinished")]
    return ["user_id", "provider", "username", "display_username", "account_status", *counts, "first_game_ts", "last_game_ts", zero("distinct_opponents")]


def _summaries(games: DataFrame, own: DataFrame | None = None) -> DataFrame:
    mine = seats(games.select("id", "provider", "outcome", "rated", "ended_at", "white", "black")).where("me.user_id is not null").withColumn("user_id", F.col("me.user_id"))
    if own is not None:
        mine = mine.join(own, ["provider", "user_id"])
    outcome, color = F.col("outcome"), F.col("color")
    return mine.groupBy("provider", "user_id").agg(
        F.count("id").alias("games"), count_if(F.col("rated"), "rated_games"), count_if(~F.col("rated"), "unrated_games"), *_score(color, outcome),
        F.min("ended_at").alias("first_game_ts"), F.max("ended_at").alias("last_game_ts"), F.count_distinct("other.user_id").alias("distinct_opponents"),
    )


def opponent_report(users: DataFrame, games: DataFrame, provider: str, username: str) -> DataFrame:
    """Eight columns for each opponent with a user row, most games first."""
    me = _user(users, provider, username).select(F.col("id").alias("user_id"))
    mine = _sides(games.where(F.col("provider") == provider)).join(F.broadcast(me), "user_id")  # one row
    return _opponents(mine, users.where(F.col("provider") == provider), []).orderBy(F.desc("games"), "opponent_username")


def opponent_reports(users: DataFrame, games: DataFrame) -> DataFrame:
    """The opponents of every user at once, with ``user_id`` ahead."""
    return _opponents(_sides(games), users, ["user_id"])


def _sides(games: DataFrame) -> DataFrame:
    s = seats(games.select("id", "provider", "outcome", "ended_at", "white", "black"))
    return s.select("id", "provider", "outcome", "ended_at", "color", F.col("me.user_id").alias("user_id"), F.col("other.user_id").alias("opponent_id")).where("user_id is not null and opponent_id is not null")


def _opponents(sides: DataFrame, users: DataFrame, ahead: list[str]) -> DataFrame:
    scored = sides.groupBy(*ahead, "provider", "opponent_id").agg(F.count(F.lit(1)).alias("games"), *_score(F.col("color"), F.col("outcome"), "my_"))
    names = users.select("provider", F.col("id").alias("opponent_id"), F.col("username_normalized").alias("opponent_username"), F.col("display_username").alias("opponent_display"))
    return scored.join(names, ["provider", "opponent_id"]).select(*ahead, "provider", "opponent_username", "opponent_display", "games", "my_wins", "draws", "my_losses", "unfinished")


def games_by_month(games: DataFrame, provider: str) -> DataFrame:
    """Six columns for each month in UTC, ``unknown`` for games without an end."""
    outcome = F.col("outcome")
    return (
        games.where(F.col("provider") == provider)
        .groupBy(codes.month_of(F.col("ended_at")).alias("month"))
        .agg(F.count(F.lit(1)).alias("games"), count_if(outcome == "white_win", "white_wins"), count_if(outcome == "black_win", "black_wins"), count_if(outcome == "draw", "draws"), count_if(outcome.isNull(), "unfinished"))
        .orderBy("month")
    )


def opponents_of(users: DataFrame, games: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """(provider, user_id, opponent_id, opponent_username, via_game_id, game_count) of all users: the crawl's neighbours.

    Games against oneself do not count here.
    """
    sides = _sides(games).where(within(F.col("ended_at"), since, until) & (F.col("user_id") != F.col("opponent_id")))
    grouped = sides.groupBy("provider", "user_id", "opponent_id").agg(F.min("id").alias("via_game_id"), F.count_distinct("id").alias("game_count"))
    names = users.select("provider", F.col("id").alias("opponent_id"), F.col("username_normalized").alias("opponent_username"))
    return grouped.join(names, ["provider", "opponent_id"]).select("provider", "user_id", "opponent_id", "opponent_username", "via_game_id", "game_count")


def game_count_for_targets(games: DataFrame, targets: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """Distinct games of each provider in which a target (provider, target) sits, by folded name."""
    wanted = targets.select("provider", F.lower("target").alias("username")).distinct()
    mine = seats(games.where(within(F.col("ended_at"), since, until)).select("id", "provider", "white", "black"))
    return mine.select("id", "provider", F.col("me.username").alias("username")).join(wanted, ["provider", "username"]).groupBy("provider").agg(F.count_distinct("id").alias("games"))


def export_games(games: DataFrame, variants: DataFrame, controls: DataFrame, provider: str | None = None) -> DataFrame:
    """Fifteen columns of each game, flags as 0 and 1."""
    chosen = games if provider is None else games.where(F.col("provider") == provider)
    named = with_names(chosen, variants, controls)
    flag = lambda c: F.col(c).cast("int").alias(c)
    ordered = named.orderBy("provider", "ended_at", "provider_game_id", "id")
    return ordered.select("provider", "provider_game_id", "canonical_url", "outcome", flag("is_live"), "status_raw", flag("rated"), "created_at", "ended_at", "variant", "variant_raw", "time_class", "time_control", F.col("white.username").alias("white_username"), F.col("black.username").alias("black_username"))


def export_users(users: DataFrame, provider: str | None = None) -> DataFrame:
    chosen = users if provider is None else users.where(F.col("provider") == provider)
    return chosen.select("provider", "provider_user_id", "username_normalized", "display_username", "account_status", "title", "first_seen_at", "updated_at").orderBy("provider", "username_normalized")


def export_graph(edges: DataFrame, users: DataFrame, provider: str | None = None) -> DataFrame:
    """Ten columns of each edge; an edge whose ends have no user row of its provider does not show."""
    chosen = edges if provider is None else edges.where(F.col("provider") == provider)
    name = lambda end: users.select("provider", F.col("id").alias(f"{end}_user_id"), F.col("username_normalized").alias(f"{end}_username"))
    named = chosen.join(name("from"), ["provider", "from_user_id"]).join(name("to"), ["provider", "to_user_id"])
    return named.select("provider", "crawl_run_id", "from_username", "to_username", "from_user_id", "to_user_id", "via_game_id", "game_count", "depth", "edge_kind").orderBy("provider", "depth", "from_username", "to_username")
