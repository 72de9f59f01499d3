"""Requests as frames: addresses and source keys for any number of users at once.

Columns: provider, endpoint_type, url, source_key. The same rules as ``providers`` has for one
request; a fetch loop takes these rows in order and paces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castleflow.functions import codes
from castleflow.sources.providers import PROVIDERS

_CC, _LI = (PROVIDERS[k].base_url for k in ("chess.com", "lichess"))


def _name() -> Column:
    return F.lower(F.trim("username"))


def _rows(users: DataFrame, provider: str, endpoint: str, url: list, key: list) -> DataFrame:
    text = lambda parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    own = users.where(F.col("provider") == provider)
    return own.select("provider", F.lit(endpoint).alias("endpoint_type"), text(url).alias("url"), text(key).alias("source_key"))


def profiles(users: DataFrame) -> DataFrame:
    """The profile of each user (provider, username)."""
    name, path = _name(), codes.percent_encoded(_name())
    first = _rows(users, "chess.com", "user_profile", [f"{_CC}/player/", path], ["chess.com/player/", name, "/profile"])
    return first.unionByName(_rows(users, "lichess", "user_profile", [f"{_LI}/user/", path], ["lichess/user/", name, "/profile"]))


def stats(users: DataFrame) -> DataFrame:
    return _rows(users, "chess.com", "user_stats", [f"{_CC}/player/", codes.percent_encoded(_name()), "/stats"], ["chess.com/player/", _name(), "/stats"])


def indexes(users: DataFrame) -> DataFrame:
    return _rows(users, "chess.com", "archives_index", [f"{_CC}/player/", codes.percent_encoded(_name()), "/games/archives"], ["chess.com/player/", _name(), "/games/archives"])


def months(users: DataFrame) -> DataFrame:
    """A month's games for each month that the user's window (since, until) touches."""
    every = users.withColumn("_day", F.explode(codes.months_between(F.col("since"), F.col("until"))))
    unit = F.date_format("_day", "'/games/'yyyy/MM")
    return _rows(every, "chess.com", "monthly_archive", [f"{_CC}/player/", codes.percent_encoded(_name()), unit], ["chess.com/player/", _name(), unit])


def windows(users: DataFrame) -> DataFrame:
    """One bounded stream for each user's window (since, until, limit); a bound that is null is open. Without a positive limit there is none."""
    asked = [("since", F.col("since") * 1000), ("until", F.col("until") * 1000), ("max", F.col("limit")), ("pgnInJson", F.lit("true")), ("opening", F.lit("true")), ("clocks", F.lit("false")), ("evals", F.lit("false"))]
    query = F.concat_ws("&", *[F.concat(F.lit(f"{n}="), v.cast("string")) for n, v in asked])
    unit = codes.range_unit(F.col("since"), F.col("until"), F.col("limit"))
    return _rows(users.where("limit > 0"), "lichess", "user_games_stream", [f"{_LI}/games/user/", codes.percent_encoded(_name()), "?", query], ["lichess/games/user/", _name(), "/", unit])


def games(ids: DataFrame) -> DataFrame:
    """Single games (provider, game_id) of the provider that has them by id."""
    ref = F.trim("game_id")
    return _rows(ids, "lichess", "game", [f"{_LI}/game/", codes.percent_encoded(ref)], ["lichess/game/", ref])


def archive_units(raw: DataFrame) -> DataFrame:
    """payload, username, unit_id and url of every month that an index payload (canonical_source_key, body) lists."""
    urls = raw.where("endpoint_type = 'archives_index'").select("payload", codes.username_of_key(F.col("canonical_source_key")).alias("username"), F.explode(F.from_json("body", "archives array<string>")["archives"]).alias("url"))
    at = codes.archive_month(F.col("url"))
    return urls.select("payload", "username", F.format_string("%04d/%02d", at["year"], at["month"]).alias("unit_id"), "url")
