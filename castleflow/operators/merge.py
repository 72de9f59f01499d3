"""Keyed merges with a policy for each column, as one aggregation over current rows and a batch.

The rows that a table holds stand before all rows of a batch; a merge then is one reduction of
their union by key. Nothing depends on the order in which partitions arrive, merging the same
batch twice changes nothing, and partial aggregation runs before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castleflow.operators.shared import settle
from castleflow.operators.stars import components

POLICIES = ("first", "last", "first_non_null", "last_non_null", "min", "max")

#: Merge policies of the archive's tables, by column.
USERS = {"provider_user_id": "last_non_null", "display_username": "last", "account_status": "last_non_null", "title": "last_non_null", "first_seen_at": "first", "updated_at": "last"}
GAMES = {
    "provider_game_id": "last_non_null", "canonical_url": "last_non_null", "content_hash": "last", "variant_id": "last", "time_control_id": "last", "rated": "last", "outcome": "last", "is_live": "last",
    "status_raw": "last", "created_at": "last_non_null", "ended_at": "last_non_null", "ply_count": "last_non_null", "eco": "last_non_null", "opening_name": "last_non_null", "opening_ply": "last_non_null",
    "tournament_ref": "last_non_null", "first_seen_at": "first",
}
SEATS = {"provider_user_id": "last_non_null", "username_normalized": "last_non_null", "result_raw": "last_non_null", "is_winner": "last", "is_ai": "last"}
RATINGS = {"rating": "last", "rating_diff": "last", "rd": "last"}
SNAPSHOTS = {
    "captured_at": "last", "raw_payload_id": "last", "observed_username": "first", "status": "first", "title": "first", "country": "first", "followers": "first", "patron": "first",
    "count_all": "first", "count_rated": "first", "count_win": "first", "count_loss": "first", "count_draw": "first", "perfs_or_stats": "first",
}
EDGES = {"crawl_run_id": "first_non_null", "game_count": "max", "depth": "min", "via_game_id": "first_non_null", "edge_kind": "first", "first_seen_at": "first"}
VARIANTS = {"canonical_name": "first", "mapped": "first"}


def _pick(column: str, policy: str, order: Column) -> Column:
    c = F.col(column)
    # an order of null is passed over, which is how nulls are left out
    held = F.when(c.isNotNull(), order)
    picked = {
        "first": lambda: F.min_by(c, order),
        "last": lambda: F.max_by(c, order),
        "first_non_null": lambda: F.min_by(c, held),
        "last_non_null": lambda: F.max_by(c, held),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
    }[policy]()
    return picked.alias(column)


def reduce_by(rows: DataFrame, key: list[str], order: Column, policies: dict[str, str], last: Column | None = None) -> DataFrame:
    """One row for each key (null is a key like any other), each column picked by its policy along ``order``.

    A row may stand for several equal ones, of which ``order`` is the first place and ``last`` the last.
    """
    return rows.groupBy(*key).agg(*[_pick(c, p, last if last is not None and p.startswith("last") else order) for c, p in policies.items()])


def merge(current: DataFrame, batch: DataFrame, key: list[str], sequence: list[str], policies: dict[str, str]) -> DataFrame:
    """``current`` after ``batch``, whose rows follow one another by ``sequence``; more policies apply to ``current``'s id."""
    columns = [*key, *policies]
    late = F.struct(*sequence)
    kind = batch.select(late.alias("s")).schema["s"].dataType
    old = current.select(*columns, F.lit(0).alias("_age"), F.lit(None).cast(kind).alias("_at"))
    new = batch.select(*columns, F.lit(1).alias("_age"), late.alias("_at"))
    return reduce_by(old.unionByName(new), key, F.struct("_age", "_at"), policies)


def first_of(rows: DataFrame, key: list[str], sequence: list[str]) -> DataFrame:
    """The whole first row of each key along ``sequence``."""
    whole = F.struct(*[c for c in rows.columns if c not in key])
    return rows.groupBy(*key).agg(F.min_by(whole, F.struct(*sequence)).alias("_row")).select(*key, "_row.*")


def latest_of(rows: DataFrame, key: list[str], sequence: list[str]) -> DataFrame:
    whole = F.struct(*[c for c in rows.columns if c not in key])
    return rows.groupBy(*key).agg(F.max_by(whole, F.struct(*sequence)).alias("_row")).select(*key, "_row.*")


def insert_absent(current: DataFrame, batch: DataFrame, key: list[str], sequence: list[str]) -> DataFrame:
    """Rows of ``batch``, the first of each key, whose key ``current`` lacks. Keys compare null-safe."""
    return absent(current, first_of(batch, key, sequence), key)


def absent(current: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``batch`` whose key ``current`` lacks."""
    same = [batch[k].eqNullSafe(current[k]) for k in key]
    return batch.join(current.select(*key), same, "left_anti")


def number_from(rows: DataFrame, order: list[str], start: int, name: str = "id") -> DataFrame:
    """``rows`` with consecutive numbers from ``start`` along ``order``.

    Rows are dealt by range, sorted and numbered within their partition as they are written; only
    the partitions' sizes reach the driver.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the partition stands in the bits above
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_place": place})
    dealt = settle(dealt, "numbered")
    sizes = dealt.groupBy("_part").count().orderBy("_part").collect()
    offsets, at = [], start
    for r in sizes:
        offsets.append((r["_part"], at))
        at += r["count"]
    if not offsets:
        return rows.withColumn(name, F.lit(None).cast("bigint"))
    # one entry for each partition, not for each row
    begin = F.create_map(*[F.lit(x) for pair in offsets for x in pair])
    return dealt.withColumn(name, (F.element_at(begin, F.col("_part")) + F.col("_place")).cast("bigint")).drop("_part", "_place")


def ties(records: DataFrame, record: str, tokens: Column) -> DataFrame:
    """(record, entity) of the records that share any of their ``tokens`` (an array) with a smaller one: the entity is the smallest.

    Each token ties its records to the smallest of them; the entities are the components of these ties.
    """
    pairs = settle(records.select(F.col(record).alias("record"), F.explode(F.array_compact(tokens)).alias("token")), "tokens")
    low = pairs.groupBy("token").agg(F.min("record").alias("low"), F.max("record").alias("high")).where("low != high")
    met = pairs.join(low, "token").where("record != low").select(F.col("record").alias("a"), F.col("low").alias("b"))
    return components(met).select(F.col("node").alias("record"), F.col("component").alias("entity"))


def identities(records: DataFrame, record: str, tokens: Column) -> DataFrame:
    """(record, entity) of all records; those that are tied to no other are entities of their own."""
    named = ties(records, record, tokens)
    return records.select(F.col(record).alias("record")).join(named, "record", "left").select("record", F.coalesce("entity", "record").alias("entity"))


def missing_references(rows: DataFrame, column: str, other: DataFrame, key: str) -> DataFrame:
    """Rows whose reference names nothing; null refers to nothing and passes."""
    known = other.select(F.col(key).alias("_key")).distinct()
    return rows.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_key"), "left_anti")


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
