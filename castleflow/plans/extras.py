"""Reports beyond the basic ones: distributions, coverage and windows over games."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castleflow.functions import codes
from castleflow.plans.reports import opponent_reports, with_names
from castleflow.plans.views import count_if, seats


def repeated_opponents(users: DataFrame, games: DataFrame, least: int) -> DataFrame:
    """Pairs with at least ``least`` games against each other, from each side."""
    return opponent_reports(users, games).where(F.col("games") >= least)


def rating_bands(games: DataFrame, width: int = 100) -> DataFrame:
    """Seats by provider and band of the opponent's rating."""
    other = F.col("other.rating")
    return seats(games).where(other.isNotNull()).groupBy("provider", (F.floor(other / width) * width).cast("bigint").alias("band")).agg(F.count(F.lit(1)).alias("seats"))


def share_of(count: Column, over: list[str]) -> Column:
    return F.round(100.0 * count / F.sum(count).over(Window.partitionBy(*over)), 2)


def time_control_distribution(games: DataFrame, variants: DataFrame, controls: DataFrame) -> DataFrame:
    return with_names(games, variants, controls).groupBy("provider", "time_class", "time_control").agg(F.count(F.lit(1)).alias("games"))


def variant_distribution(games: DataFrame, variants: DataFrame, controls: DataFrame) -> DataFrame:
    counted = with_names(games, variants, controls).groupBy("provider", "variant").agg(F.count(F.lit(1)).alias("games"))
    return counted.withColumn("percent", share_of(F.col("games"), ["provider"]))


def results_by_color(games: DataFrame) -> DataFrame:
    """Wins, draws and losses by colour and user, with the score over decided games, null without any."""
    s = seats(games).where("me.user_id is not null")
    outcome, color = F.col("outcome"), F.col("color")
    counted = s.groupBy("provider", F.col("me.user_id").alias("user_id"), "color").agg(
        F.count(F.lit(1)).alias("games"), count_if(codes.wins(color, outcome), "wins"), count_if(outcome == "draw", "draws"), count_if(codes.losses(color, outcome), "losses")
    )
    points, decided = F.col("wins") + F.col("draws") / 2, F.col("wins") + F.col("draws") + F.col("losses")
    return counted.withColumn("score_percent", F.round(F.try_divide(100.0 * points, decided.cast("double")), 2))


def termination_distribution(games: DataFrame) -> DataFrame:
    return games.groupBy("provider", "status_raw", "outcome").agg(F.count(F.lit(1)).alias("games"))


def latest_status(snapshots: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """Each status's share of the entities ``key`` by their latest row."""
    last = snapshots.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"))
    return last.groupBy("status").agg(F.count(F.lit(1)).alias("entities")).withColumn("percent", share_of(F.col("entities"), []))


def games_by_period(games: DataFrame, pattern: str = "yyyy") -> DataFrame:
    period = F.coalesce(F.date_format(codes.at(F.col("ended_at")), pattern), F.lit("unknown"))
    return games.groupBy("provider", period.alias("period")).agg(F.count(F.lit(1)).alias("games"))


def depth_frontier(jobs: DataFrame, states: tuple[str, ...] = ("pending", "in_progress", "done", "error", "skipped", "blocked")) -> DataFrame:
    """Jobs of each depth by state, one column for each."""
    return jobs.groupBy("depth").agg(*[count_if(F.col("state") == s, s) for s in states])


def month_coverage(games: DataFrame, since: int, until: int) -> DataFrame:
    """Each month of the window for each provider, with its games; 0 where none were stored."""
    spark = games.sparkSession
    months = spark.range(1).select(F.explode(codes.months_between(F.lit(since).cast("bigint"), F.lit(until).cast("bigint"))).alias("day")).select(F.date_format("day", "yyyy-MM").alias("month"))
    every = spark.createDataFrame([(p,) for p in codes.PROVIDERS], "provider string").join(F.broadcast(months))
    stored = games.where(F.col("ended_at").isNotNull()).groupBy("provider", codes.month_of(F.col("ended_at")).alias("month")).agg(F.count(F.lit(1)).alias("games"))
    return every.join(stored, ["provider", "month"], "left").select("provider", "month", F.coalesce("games", F.lit(0).cast("bigint")).alias("games"), F.coalesce(F.col("games") > 0, F.lit(False)).cast("int").alias("covered"))


def coverage_gaps(ranges: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """Gaps between merged half-open ranges of each key."""
    w = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return ranges.withColumn("gap_start", reach).where(F.col(start) > F.col("gap_start")).select(*key, "gap_start", F.col(start).alias("gap_end"))


def rating_change(games: DataFrame, seconds: int) -> DataFrame:
    """Each user's rating against the lowest in the ``seconds`` before. A neutral figure: it says nothing about anyone's conduct."""
    s = seats(games).where("me.user_id is not null and me.rating is not null and ended_at is not null")
    w = Window.partitionBy("provider", F.col("me.user_id")).orderBy("ended_at").rangeBetween(-seconds, Window.currentRow)
    s = s.withColumn("gain", F.col("me.rating") - F.min("me.rating").over(w))
    return s.groupBy("provider", F.col("me.user_id").alias("user_id")).agg(F.max("gain").alias("largest_gain"), F.count(F.lit(1)).alias("rated_seats"))


def score_against_higher(games: DataFrame, gap: int) -> DataFrame:
    """Each user's score in decided games against opponents rated at least ``gap`` higher. A neutral figure; ``games`` says how few it may rest on."""
    s = seats(games).where("me.user_id is not null and outcome is not null and other.rating >= me.rating + " + str(int(gap)))
    outcome, color = F.col("outcome"), F.col("color")
    points = F.count_if(codes.wins(color, outcome)) + F.count_if(outcome == "draw") / 2
    return s.groupBy("provider", F.col("me.user_id").alias("user_id")).agg(F.count(F.lit(1)).alias("games"), F.round(100.0 * points / F.count(F.lit(1)), 2).alias("score_percent"))


def neighbour_labels(neighbours: DataFrame, status: DataFrame) -> DataFrame:
    """How many of a user's opponents carry a label of the provider's. Counts of labels only: being an opponent says nothing about anyone."""
    labelled = F.count_if(F.col("account_status").isNotNull())
    held = neighbours.join(status, ["provider", "opponent_id"])
    return held.groupBy("provider", "user_id").agg(F.count(F.lit(1)).alias("neighbours"), labelled.alias("labelled"), F.round(100.0 * labelled / F.count(F.lit(1)), 2).alias("percent"))
