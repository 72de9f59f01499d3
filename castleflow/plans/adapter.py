"""The archive's tables over the driver's synthetic tables, so that every report can run on them.

Games are orders paired with their successor, users are customers (one for each provider),
jobs and payloads come from events and documents. The rules are plain expressions; ``SQL`` says
the same for the oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castleflow.functions import codes


class Model:
    """Lazy frames of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def providers(self) -> DataFrame:
        return self.spark.createDataFrame([(p,) for p in codes.PROVIDERS], "key string")

    @cached_property
    def games(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
        nxt = orders.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("black_id"))
        g = orders.join(nxt, "o_orderkey")
        p, s, k = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderkey")
        undecided = p == "5-LOW"
        outcome = F.when(~undecided, F.when(s == "F", "white_win").when(s == "O", "black_win").when(s == "P", "draw"))
        ended = F.when(p != "4-NOT SPECIFIED", codes.epoch_of(F.col("o_orderdate")))
        g = g.select(
            k.alias("id"), F.when(k % 3 == 0, codes.PROVIDERS[0]).otherwise(codes.PROVIDERS[1]).alias("provider"), F.concat(F.lit("g"), k).alias("provider_game_id"),
            F.concat(F.lit("https://games.example/"), k).alias("canonical_url"), codes.sha(F.concat(F.lit("g"), k)).alias("content_hash"), (k % 5).alias("variant_id"), (k % 7).alias("time_control_id"),
            p.isin("1-URGENT", "2-HIGH").alias("rated"), outcome.alias("outcome"), (undecided & (s == "O")).alias("is_live"), s.alias("status_raw"), codes.epoch_of(F.col("o_orderdate")).alias("created_at"), ended.alias("ended_at"),
            F.col("o_custkey").alias("white_id"), "black_id",
        )
        seat = lambda c: F.struct(F.col(f"{c}_id").alias("user_id"), F.concat(F.lit("customer#"), F.lpad(F.col(f"{c}_id").cast("string"), 9, "0")).alias("username"), codes.is_winner(F.lit(c), F.col("outcome")).alias("is_winner")).alias(c)
        return g.select(*[c for c in g.columns if c not in ("white_id", "black_id")], seat("white"), seat("black"))

    @cached_property
    def rated_games(self) -> DataFrame:
        """Games whose seats carry a rating from the customer's balance."""
        rating = self.table("customer").select(F.col("c_custkey").alias("user_id"), (1000 + F.floor(F.col("c_acctbal") / 10)).cast("bigint").alias("rating"))
        g = self.games
        for c in ("white", "black"):
            r = rating.select(F.col("user_id").alias("_user"), F.col("rating").alias("_rating"))
            g = g.join(r, g[f"{c}.user_id"] == r["_user"], "left").withColumn(c, F.col(c).withField("rating", F.col("_rating"))).drop("_user", "_rating")
        return g

    @cached_property
    def users(self) -> DataFrame:
        c = self.table("customer")
        every = c.select("*", F.explode(F.array(*map(F.lit, codes.PROVIDERS))).alias("provider"))
        return every.select(
            F.col("c_custkey").alias("id"), "provider", F.concat(F.lit("p"), F.col("c_custkey")).alias("provider_user_id"), F.lower("c_name").alias("username_normalized"), F.col("c_name").alias("display_username"),
            F.when(F.col("c_mktsegment") == "BUILDING", "closed").alias("account_status"), F.when(F.col("c_nationkey") == 0, "NM").alias("title"), F.col("c_nationkey").cast("bigint").alias("first_seen_at"), (F.col("c_nationkey") + 1).cast("bigint").alias("updated_at"),
        )

    @cached_property
    def variants(self) -> DataFrame:
        names = ["standard", "chess960", "atomic", "horde", "antichess"]
        return self.spark.createDataFrame([(i, n, n.upper()) for i, n in enumerate(names)], "id bigint, canonical_name string, provider_native_name string")

    @cached_property
    def controls(self) -> DataFrame:
        rows = [(0, "bullet", "60"), (1, "blitz", "300+2"), (2, "rapid", "600"), (3, "classical", "1800"), (4, "correspondence", "1/86400"), (5, "blitz", "180"), (6, "bullet", "60+1")]
        return self.spark.createDataFrame(rows, "id bigint, time_class string, raw_label string")

    @cached_property
    def snapshots(self) -> DataFrame:
        """One for each user and day of events."""
        e = self.table("events")
        return e.select(F.col("user_id").alias("provider_user_id"), codes.epoch_of(F.col("ts")).alias("captured_at"), "event_id", F.col("event_type").alias("status"), codes.sha(F.concat_ws("|", "user_id", "event_type")).alias("content_hash"))

    @cached_property
    def raw(self) -> DataFrame:
        d = self.table("documents")
        body = F.col("text")
        return d.select(
            F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, codes.PROVIDERS[0]).otherwise(codes.PROVIDERS[1]).alias("provider"), F.col("lang").alias("endpoint_type"), F.col("source").alias("canonical_source_key"), F.lit(200).cast("bigint").alias("response_status"),
            F.lit("application/json").alias("content_type"), codes.sha(body).alias("body_hash"), F.octet_length(body).cast("bigint").alias("body_bytes"), F.when(F.col("n_chars") % 4 == 0, "skipped").otherwise("parsed").alias("normalization_status"), (F.col("doc_id") % 97).alias("fetched_at"),
        )

    @cached_property
    def jobs(self) -> DataFrame:
        e = self.table("events")
        k = F.get_json_object("props", "$.k").cast("bigint")
        states = F.array(*map(F.lit, ["pending", "in_progress", "done", "error", "skipped", "blocked"]))
        return e.select(
            F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("crawl_run_id"), F.when(F.col("user_id") % 3 == 0, codes.PROVIDERS[0]).otherwise(codes.PROVIDERS[1]).alias("provider"), F.col("event_type").alias("kind"),
            F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("target"), F.get(states, (k % 6).cast("int")).alias("state"), k.alias("priority"), (k % 4).alias("depth"), codes.epoch_of(F.col("ts")).alias("enqueued_at"),
        )


#: The same tables for the oracle: common table expressions ahead of a query.
SQL = r"""
games AS (SELECT o.o_orderkey AS id, CASE WHEN o.o_orderkey % 3 = 0 THEN 'chess.com' ELSE 'lichess' END AS provider, 'g' || o.o_orderkey AS provider_game_id,
  'https://games.example/' || o.o_orderkey AS canonical_url, 'sha256:' || sha256('g' || o.o_orderkey) AS content_hash, o.o_orderkey % 5 AS variant_id, o.o_orderkey % 7 AS time_control_id,
  o.o_orderpriority IN ('1-URGENT', '2-HIGH') AS rated, CASE WHEN o.o_orderpriority = '5-LOW' THEN NULL WHEN o.o_orderstatus = 'F' THEN 'white_win' WHEN o.o_orderstatus = 'O' THEN 'black_win' WHEN o.o_orderstatus = 'P' THEN 'draw' END AS outcome,
  o.o_orderpriority = '5-LOW' AND o.o_orderstatus = 'O' AS is_live, o.o_orderstatus AS status_raw, CAST(epoch(o.o_orderdate) AS BIGINT) AS created_at,
  CASE WHEN o.o_orderpriority <> '4-NOT SPECIFIED' THEN CAST(epoch(o.o_orderdate) AS BIGINT) END AS ended_at, o.o_custkey AS white_id, n.o_custkey AS black_id
  FROM orders o JOIN orders n ON n.o_orderkey = o.o_orderkey + 1),
seats AS (SELECT *, 'white' AS color, white_id AS me, black_id AS other FROM games UNION ALL SELECT *, 'black' AS color, black_id AS me, white_id AS other FROM games),
scored AS (SELECT *, (color = 'white' AND outcome = 'white_win') OR (color = 'black' AND outcome = 'black_win') AS won, (color = 'white' AND outcome = 'black_win') OR (color = 'black' AND outcome = 'white_win') AS lost FROM seats),
providers AS (SELECT unnest(['chess.com', 'lichess']) AS key),
users AS (SELECT c_custkey AS id, key AS provider, 'p' || c_custkey AS provider_user_id, lower(c_name) AS username_normalized, c_name AS display_username, CASE WHEN c_mktsegment = 'BUILDING' THEN 'closed' END AS account_status,
  CASE WHEN c_nationkey = 0 THEN 'NM' END AS title, CAST(c_nationkey AS BIGINT) AS first_seen_at, CAST(c_nationkey + 1 AS BIGINT) AS updated_at FROM customer, providers),
variants AS (SELECT * FROM (VALUES (0, 'standard'), (1, 'chess960'), (2, 'atomic'), (3, 'horde'), (4, 'antichess')) v(id, canonical_name)),
controls AS (SELECT * FROM (VALUES (0, 'bullet', '60'), (1, 'blitz', '300+2'), (2, 'rapid', '600'), (3, 'classical', '1800'), (4, 'correspondence', '1/86400'), (5, 'blitz', '180'), (6, 'bullet', '60+1')) c(id, time_class, raw_label)),
snapshots AS (SELECT user_id AS provider_user_id, CAST(floor(epoch(ts)) AS BIGINT) AS captured_at, event_id, event_type AS status, 'sha256:' || sha256(user_id || '|' || event_type) AS content_hash FROM events),
raw AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'chess.com' ELSE 'lichess' END AS provider, lang AS endpoint_type, source AS canonical_source_key, CAST(200 AS BIGINT) AS response_status, 'application/json' AS content_type,
  'sha256:' || sha256(text) AS body_hash, CAST(octet_length(encode(text)) AS BIGINT) AS body_bytes, CASE WHEN n_chars % 4 = 0 THEN 'skipped' ELSE 'parsed' END AS normalization_status, doc_id % 97 AS fetched_at FROM documents),
jobs AS (SELECT event_id AS id, user_id % 10 AS crawl_run_id, CASE WHEN user_id % 3 = 0 THEN 'chess.com' ELSE 'lichess' END AS provider, event_type AS kind, 'CUSTOMER#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS target,
  ['pending', 'in_progress', 'done', 'error', 'skipped', 'blocked'][CAST(json_extract_string(props, '$.k') AS BIGINT) % 6 + 1] AS state, CAST(json_extract_string(props, '$.k') AS BIGINT) AS priority,
  CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS depth, CAST(floor(epoch(ts)) AS BIGINT) AS enqueued_at FROM events)
"""


def oracle(query: str, *more: str) -> str:
    """A query over the tables above, with further expressions between."""
    return "WITH RECURSIVE " + ",\n".join([SQL.strip(), *more]) + "\n" + query
