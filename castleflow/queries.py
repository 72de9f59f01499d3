"""The registered queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castleflow.functions import codes
from castleflow.operators import ingest, merge
from castleflow.plans import extras, graph, jobs, reports
from castleflow.plans.adapter import Model
from castleflow.registry import query

USER = "customer#000000007"
SINCE, UNTIL = 852076800, 883612800  # the year 1997

SCORES = "CAST(count(*) FILTER (won) AS BIGINT) AS {p}wins, CAST(count(*) FILTER (outcome = 'draw') AS BIGINT) AS draws, CAST(count(*) FILTER (lost) AS BIGINT) AS {p}losses, CAST(count(*) FILTER (outcome IS NULL) AS BIGINT) AS unfinished"
MY_SCORES, ALL_SCORES = SCORES.format(p="my_"), SCORES.format(p="")
SUMMARY = (
    "u.id AS user_id, u.provider, u.username_normalized AS username, u.display_username, u.account_status, CAST(count(s.id) AS BIGINT) AS games, CAST(count(*) FILTER (s.rated) AS BIGINT) AS rated_games, CAST(count(*) FILTER (NOT s.rated) AS BIGINT) AS unrated_games, "
    "CAST(count(*) FILTER (won) AS BIGINT) AS wins, CAST(count(*) FILTER (outcome = 'draw') AS BIGINT) AS draws, CAST(count(*) FILTER (lost) AS BIGINT) AS losses, CAST(count(*) FILTER (s.id IS NOT NULL AND outcome IS NULL) AS BIGINT) AS unfinished, "
    "min(s.ended_at) AS first_game_ts, max(s.ended_at) AS last_game_ts, CAST(count(DISTINCT other) AS BIGINT) AS distinct_opponents "
    "FROM users u LEFT JOIN scored s ON s.me = u.id AND s.provider = u.provider {where} GROUP BY ALL"
)

# --- reports ------------------------------------------------------------------------------


@query(
    f"SELECT u.provider, u.username_normalized AS opponent_username, u.display_username AS opponent_display, count(*) AS games, {MY_SCORES} FROM scored s JOIN users me ON me.id = s.me AND me.provider = s.provider JOIN users u ON u.id = s.other AND u.provider = s.provider "
    f"WHERE s.provider = 'lichess' AND me.username_normalized = '{USER}' GROUP BY ALL"
)
def opponent_report(m: Model) -> DataFrame:
    return reports.opponent_report(m.users, m.games, "lichess", USER)


@query(f"SELECT s.me AS user_id, u.provider, u.username_normalized AS opponent_username, u.display_username AS opponent_display, count(*) AS games, {MY_SCORES} FROM scored s JOIN users u ON u.id = s.other AND u.provider = s.provider GROUP BY ALL")
def opponent_reports_all(m: Model) -> DataFrame:
    return reports.opponent_reports(m.users, m.games)


@query("SELECT " + SUMMARY.format(where=f"WHERE u.provider = 'lichess' AND u.username_normalized = '{USER}'"))
def user_game_summary(m: Model) -> DataFrame:
    return reports.user_game_summary(m.users, m.games, "lichess", USER)


@query("SELECT " + SUMMARY.format(where=""))
def user_game_summaries_all(m: Model) -> DataFrame:
    return reports.user_summaries(m.users, m.games)


@query(
    "SELECT u.id, u.provider, u.provider_user_id, u.username_normalized AS username, u.display_username, u.account_status, u.title, (SELECT count(*) FROM snapshots s WHERE s.provider_user_id = u.id) AS snapshots, "
    f"(SELECT count(*) FROM seats g WHERE g.me = u.id AND g.provider = u.provider) AS games FROM users u WHERE u.provider = 'chess.com' AND u.username_normalized = '{USER}'"
)
def user_lookup(m: Model) -> DataFrame:
    return reports.user_lookup(m.users, m.games, m.snapshots, "chess.com", f"  {USER.upper()} ")


_GAME = (
    "SELECT g.id, g.provider, provider_game_id, canonical_url, outcome, is_live, status_raw, ended_at, v.canonical_name AS variant, c.time_class, 'customer#' || lpad(CAST(white_id AS VARCHAR), 9, '0') AS white, 'customer#' || lpad(CAST(black_id AS VARCHAR), 9, '0') AS black "
    "FROM games g JOIN variants v ON v.id = variant_id JOIN controls c ON c.id = time_control_id WHERE {where}"
)


@query(_GAME.format(where="g.id = 100"))
def game_lookup(m: Model) -> DataFrame:
    return reports.game_lookup(m.games, m.variants, m.controls, "lichess", "https://games.example/100")


@query(
    "SELECT coalesce(strftime(make_timestamp(ended_at * 1000000), '%Y-%m'), 'unknown') AS month, CAST(count(*) AS BIGINT) AS games, CAST(count(*) FILTER (outcome = 'white_win') AS BIGINT) AS white_wins, "
    "CAST(count(*) FILTER (outcome = 'black_win') AS BIGINT) AS black_wins, CAST(count(*) FILTER (outcome = 'draw') AS BIGINT) AS draws, CAST(count(*) FILTER (outcome IS NULL) AS BIGINT) AS unfinished FROM games WHERE provider = 'lichess' GROUP BY ALL"
)
def games_by_month(m: Model) -> DataFrame:
    return reports.games_by_month(m.games, "lichess")


@query("SELECT id, provider, endpoint_type, canonical_source_key, response_status, content_type, body_hash, body_bytes, normalization_status, fetched_at FROM raw WHERE provider = 'lichess' ORDER BY fetched_at DESC, id DESC LIMIT 25")
def raw_recent(m: Model) -> DataFrame:
    return reports.raw_recent(m.raw, "lichess", 25)


@query("SELECT key AS provider, (SELECT count(*) FROM users u WHERE u.provider = key) AS users, (SELECT count(*) FROM games g WHERE g.provider = key) AS games FROM providers")
def provider_summary(m: Model) -> DataFrame:
    return reports.provider_summary(m.providers, m.users, m.games)


@query("SELECT state, count(*) AS count FROM jobs GROUP BY state")
def job_state_counts(m: Model) -> DataFrame:
    return reports.counts_by(m.jobs, "state")


@query("SELECT kind, state, depth, count(*) AS count FROM jobs GROUP BY ALL")
def job_kind_state_depth(m: Model) -> DataFrame:
    return reports.counts_by(m.jobs, "kind", "state", "depth")


_STATUS = "CASE WHEN bool_or(state IN ('pending', 'in_progress')) THEN 'running' WHEN bool_or(state = 'blocked') THEN 'paused' WHEN bool_or(state = 'error') THEN 'failed' ELSE 'done' END"


def _short_runs(m: Model) -> DataFrame:
    """All jobs, dealt to so many runs that these differ in what they hold."""
    return m.jobs.withColumn("crawl_run_id", F.col("id") % 4999)


@query(f"SELECT id % 4999 AS crawl_run_id, {_STATUS} AS status FROM jobs GROUP BY 1")
def derive_run_status(m: Model) -> DataFrame:
    return jobs.run_status(_short_runs(m))


@query(f"SELECT status, count(*) AS count FROM (SELECT id % 4999 AS run, {_STATUS} AS status FROM jobs GROUP BY 1) GROUP BY status")
def run_status_counts(m: Model) -> DataFrame:
    return reports.counts_by(jobs.run_status(_short_runs(m)), "status")


@query(
    "SELECT crawl_run_id, count(*) AS jobs_total, count(DISTINCT lower(target)) AS users_seen, " + ", ".join(f"count(*) FILTER (state = '{s}') AS jobs_{s}" for s in ("pending", "in_progress", "done", "error", "skipped", "blocked"))
    + ", (SELECT count(*) FROM games g WHERE g.id % 12 = crawl_run_id) AS edges FROM jobs GROUP BY crawl_run_id"
)
def run_counters(m: Model) -> DataFrame:
    return jobs.run_counters(m.jobs, m.games.select((F.col("id") % 12).alias("crawl_run_id")))


@query("SELECT id, crawl_run_id, provider, kind, target, state, priority, depth, enqueued_at FROM jobs WHERE state = 'pending' AND crawl_run_id = 3 ORDER BY priority, depth, enqueued_at, id LIMIT 1")
def next_job(m: Model) -> DataFrame:
    return jobs.next_job(m.jobs, 3)


@query("SELECT id, crawl_run_id, provider, kind, target, state, priority, depth, enqueued_at FROM jobs ORDER BY id LIMIT 100")
def list_jobs(m: Model) -> DataFrame:
    return jobs.list_jobs(m.jobs, 100)


@query("SELECT crawl_run_id, provider, lower(target) AS username, min(depth) AS depth FROM jobs GROUP BY ALL")
def known_crawl_depth(m: Model) -> DataFrame:
    return jobs.known_depths(m.jobs)


@query(
    "SELECT provider, provider_game_id, canonical_url, outcome, CAST(is_live AS INTEGER) AS is_live, status_raw, CAST(rated AS INTEGER) AS rated, created_at, ended_at, v.canonical_name AS variant, upper(v.canonical_name) AS variant_raw, c.time_class, c.raw_label AS time_control, "
    "'customer#' || lpad(CAST(white_id AS VARCHAR), 9, '0') AS white_username, 'customer#' || lpad(CAST(black_id AS VARCHAR), 9, '0') AS black_username FROM games g JOIN variants v ON v.id = variant_id JOIN controls c ON c.id = time_control_id"
)
def export_games(m: Model) -> DataFrame:
    return reports.export_games(m.games, m.variants, m.controls)


@query("SELECT provider, provider_user_id, username_normalized, display_username, account_status, title, first_seen_at, updated_at FROM users WHERE provider = 'lichess'")
def export_users(m: Model) -> DataFrame:
    return reports.export_users(m.users, "lichess")


_NEIGHBOURS = "neighbours AS (SELECT s.provider, me AS user_id, other AS opponent_id, username_normalized AS opponent_username, min(s.id) AS via_game_id, count(DISTINCT s.id) AS game_count FROM seats s JOIN users u ON u.id = other AND u.provider = s.provider WHERE me <> other GROUP BY ALL)"
_WINDOW = _NEIGHBOURS.replace("WHERE me <> other", f"WHERE me <> other AND (ended_at IS NULL OR (ended_at >= {SINCE} AND ended_at < {UNTIL}))")


@query("SELECT * FROM neighbours", _WINDOW)
def opponents_of_user(m: Model) -> DataFrame:
    return reports.opponents_of(m.users, m.games, SINCE, UNTIL)


@query(f"SELECT g.provider, count(DISTINCT g.id) AS games FROM seats g JOIN (SELECT DISTINCT provider, lower(target) AS name FROM jobs WHERE crawl_run_id = 3) t ON t.provider = g.provider AND t.name = 'customer#' || lpad(CAST(me AS VARCHAR), 9, '0') WHERE ended_at IS NULL OR (ended_at >= {SINCE} AND ended_at < {UNTIL}) GROUP BY g.provider")
def game_count_for_targets(m: Model) -> DataFrame:
    return reports.game_count_for_targets(m.games, m.jobs.where("crawl_run_id = 3"), SINCE, UNTIL)


@query(
    "SELECT provider, greatest(0, 500 - count(DISTINCT id)) AS remaining FROM (SELECT g.provider, g.id FROM seats g JOIN (SELECT DISTINCT provider, lower(target) AS name FROM jobs WHERE crawl_run_id = 3) t ON t.provider = g.provider AND t.name = 'customer#' || lpad(CAST(me AS VARCHAR), 9, '0')) GROUP BY provider"
)
def remaining_game_budget(m: Model) -> DataFrame:
    counted = reports.game_count_for_targets(m.games, m.jobs.where("crawl_run_id = 3"))
    return counted.select("provider", F.greatest(F.lit(0).cast("bigint"), 500 - F.col("games")).alias("remaining"))


# --- scalar rules -------------------------------------------------------------------------


@query("SELECT doc_id, nullif(lower(regexp_replace('  ' || text || chr(10), '^\\s+|\\s+$', '', 'g')), '') AS username FROM documents")
def norm_username(m: Model) -> DataFrame:
    return m.table("documents").select("doc_id", codes.username(F.concat(F.lit("  "), "text", F.lit("\n"))).alias("username"))


@query("SELECT p_partkey, CASE t WHEN 'daily' THEN 'correspondence' WHEN 'ultrabullet' THEN 'bullet' ELSE t END AS time_class FROM (SELECT p_partkey, lower(trim(['Daily', ' ultraBullet', 'Blitz', 'custom', 'correspondence'][p_size % 5 + 1])) AS t FROM part)")
def norm_time_class(m: Model) -> DataFrame:
    label = F.get(F.array(*map(F.lit, ["Daily", " ultraBullet", "Blitz", "custom", "correspondence"])), F.col("p_size") % 5)
    return m.table("part").select("p_partkey", codes.time_class(label).alias("time_class"))


_NATIVE = ["chess", "kingOfTheHill", "kingofthehill", "Bughouse", "", "threeCheck"]


@query(
    f"SELECT p_partkey, CASE WHEN n = '' THEN 'standard' WHEN lichess THEN CASE n WHEN 'kingOfTheHill' THEN 'kingofthehill' WHEN 'threeCheck' THEN 'threecheck' ELSE lower(n) END ELSE CASE n WHEN 'chess' THEN 'standard' ELSE lower(n) END END AS canonical, "
    f"CAST(n <> '' AND CASE WHEN lichess THEN n IN ('kingOfTheHill', 'threeCheck') ELSE n IN ('chess', 'kingofthehill') END AS INTEGER) AS mapped FROM (SELECT p_partkey, {_NATIVE!r}[p_size % 6 + 1] AS n, p_partkey % 2 = 0 AS lichess FROM part)"
)
def map_variant(m: Model) -> DataFrame:
    native = F.get(F.array(*map(F.lit, _NATIVE)), F.col("p_size") % 6)
    v = codes.variant(F.when(F.col("p_partkey") % 2 == 0, "lichess").otherwise("chess.com"), native)
    return m.table("part").select("p_partkey", v["canonical"].alias("canonical"), v["mapped"].cast("int").alias("mapped"))


_RESULTS = ["win", "checkmated", "agreed", "", "none", "50move", "Win "]


@query(
    f"SELECT p_partkey, CASE WHEN w = 'win' THEN 'white_win' WHEN b = 'win' THEN 'black_win' WHEN w IN ('agreed', '50move') OR b IN ('agreed', '50move') THEN 'draw' END AS outcome, CAST(w IN ('', 'none') AND b IN ('', 'none') AS INTEGER) AS is_live FROM (SELECT p_partkey, lower(trim({_RESULTS!r}[p_size % 7 + 1])) AS w, lower(trim({_RESULTS!r}[p_partkey % 7 + 1])) AS b FROM part)"
)
def outcome_two_seat(m: Model) -> DataFrame:
    pick = lambda i: F.get(F.array(*map(F.lit, _RESULTS)), (i % 7).cast("int"))
    o = codes.outcome_of_seats(pick(F.col("p_size")), pick(F.col("p_partkey")))
    return m.table("part").select("p_partkey", o["outcome"].alias("outcome"), o["is_live"].cast("int").alias("is_live"))


_STATUSES = ["mate", "created", "draw", "aborted", "Draw", "started", "variantEnd"]


@query(
    f"SELECT p_partkey, CASE WHEN w = 'white' THEN 'white_win' WHEN w = 'black' THEN 'black_win' WHEN s IN ('mate', 'draw', 'variantEnd') THEN 'draw' END AS outcome, CAST(coalesce(w, '') = '' AND s IN ('created', 'started') AS INTEGER) AS is_live FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'white' WHEN 1 THEN 'black' END AS w, {_STATUSES!r}[p_size % 7 + 1] AS s FROM part)"
)
def outcome_winner_status(m: Model) -> DataFrame:
    k = F.col("p_partkey") % 3
    o = codes.outcome_of_status(F.when(k == 0, "white").when(k == 1, "black"), F.get(F.array(*map(F.lit, _STATUSES)), F.col("p_size") % 7))
    return m.table("part").select("p_partkey", o["outcome"].alias("outcome"), o["is_live"].cast("int").alias("is_live"))


@query(
    "SELECT p_partkey, CASE k WHEN 0 THEN 'clock' WHEN 1 THEN 'clock' WHEN 4 THEN 'clock' ELSE 'correspondence' END AS kind, CASE k WHEN 0 THEN p_size * 60 WHEN 1 THEN p_size * 30 END AS initial_seconds, CASE k WHEN 0 THEN 0 WHEN 1 THEN p_size % 9 END AS increment_seconds, "
    "CASE k WHEN 2 THEN greatest(1, p_size // 4) WHEN 3 THEN 1 END AS days FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, p_partkey % 6 AS k FROM part)"
)
def parse_time_control(m: Model) -> DataFrame:
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("bigint")
    label = F.when(k == 0, (size * 60).cast("string")).when(k == 1, F.concat((size * 30).cast("string"), F.lit("+"), (size % 9).cast("string"))).when(k == 2, F.concat(F.lit("1/"), (size * 21600).cast("string"))).when(k == 3, "1/x").when(k == 4, "blitz")
    t = codes.time_control(label, F.when(k == 5, "correspondence").otherwise("blitz"))
    return m.table("part").select("p_partkey", *[t[c].alias(c) for c in ("kind", "initial_seconds", "increment_seconds", "days")])


@query("SELECT o_orderkey, strftime(unnest(generate_series(date_trunc('month', o_orderdate), date_trunc('month', o_orderdate + INTERVAL (o_orderkey % 90 + 1) DAY - INTERVAL 1 SECOND), INTERVAL 1 MONTH)), '%Y-%m') AS month FROM orders")
def months_between(m: Model) -> DataFrame:
    since = codes.epoch_of(F.col("o_orderdate"))
    until = since + (F.col("o_orderkey") % 90 + 1) * 86400
    return m.table("orders").select("o_orderkey", F.explode(codes.months_between(since, until)).alias("day")).select("o_orderkey", F.date_format("day", "yyyy-MM").alias("month"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def epoch_month(m: Model) -> DataFrame:
    return m.table("orders").select("o_orderkey", codes.month_of(codes.epoch_of(F.col("o_orderdate"))).alias("month"))


@query("SELECT o_orderkey, CAST(floor((o_orderkey - 500) * 777 / 1000.0) AS BIGINT) AS seconds FROM orders")
def ms_to_s(m: Model) -> DataFrame:
    return m.table("orders").select("o_orderkey", codes.ms_to_s((F.col("o_orderkey") - 500) * 777).alias("seconds"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS value FROM events")
def int_or_null(m: Model) -> DataFrame:
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(F.lit(" +"), F.col("event_id").cast("string"))).when(k == 1, F.get_json_object("props", "$.k")).when(k == 2, F.concat(F.col("value").cast("string"), F.lit("x")))
    return m.table("events").select("event_id", codes.int_or_null(text).alias("value"))


@query("SELECT event_id, 'sha256:' || sha256('{\"kind\":\"' || event_type || '\",\"none\":null,\"user\":' || user_id || '}') AS content_hash FROM events")
def content_hash(m: Model) -> DataFrame:
    return m.table("events").select("event_id", codes.canonical_hash(user=F.col("user_id"), none=F.lit(None).cast("string"), kind=F.col("event_type")).alias("content_hash"))


# --- payloads, merges, references ---------------------------------------------------------


@query("SELECT user_id, CAST(i AS INTEGER) AS position, '/games/' || i AS json_pointer, event_id FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events) WHERE event_type <> 'error'")
def explode_json_records(m: Model) -> DataFrame:
    from castleflow.operators.normalize import explode_records

    one = F.struct("event_id", F.col("event_type").alias("kind"))
    body = F.to_json(F.struct(F.array_sort(F.collect_list(one)).alias("games")))
    payloads = m.table("events").groupBy("user_id").agg(body.alias("body"))
    rows = explode_records(payloads, "body", "games", "struct<event_id: bigint, kind: string>", "/games/")
    # positions count the records that are left out
    return rows.where("record.kind != 'error'").select("user_id", "position", "json_pointer", "record.event_id")


@query(
    "SELECT user_id, nullif(sum(w), 0)::BIGINT AS count_win, nullif(sum(l), 0)::BIGINT AS count_loss, nullif(sum(d), 0)::BIGINT AS count_draw, nullif(sum(w + l + d), 0)::BIGINT AS count_all FROM (SELECT user_id, event_type, count(*) AS w, CAST(sum(event_id % 3) AS BIGINT) AS l, CAST(0 AS BIGINT) AS d FROM events WHERE event_type <> 'view' GROUP BY ALL) GROUP BY user_id"
)
def stats_fold(m: Model) -> DataFrame:
    from castleflow.operators.normalize import fold_stats

    each = m.table("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("win"), F.sum(F.col("event_id") % 3).alias("loss"), F.lit(0).alias("draw"))
    # one kind has no record, which the fold passes over
    record = F.when(F.col("event_type") != "view", F.struct("win", "loss", "draw"))
    entry = F.concat(F.to_json(F.array("event_type")).substr(F.lit(2), F.length("event_type") + 2), F.lit(":"), F.to_json(F.struct(record.alias("record"), F.lit(1).alias("last"))))
    bodies = each.groupBy("user_id").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ","), F.lit("}")).alias("body"))
    fold = fold_stats(F.col("body"))
    return bodies.select("user_id", *[fold[c].alias(c) for c in ("count_win", "count_loss", "count_draw", "count_all")])


@query("SELECT id AS game_id, color, me AS provider_user_id, 'customer#' || lpad(CAST(me AS VARCHAR), 9, '0') AS username_normalized, CAST(CASE WHEN outcome IN ('white_win', 'black_win') THEN outcome = color || '_win' END AS INTEGER) AS is_winner FROM seats")
def seat_unpivot(m: Model) -> DataFrame:
    from castleflow.plans.views import seats

    return seats(m.games).select(F.col("id").alias("game_id"), "color", F.col("me.user_id").alias("provider_user_id"), F.col("me.username").alias("username_normalized"), F.col("me.is_winner").cast("int").alias("is_winner"))


@query("SELECT provider, endpoint_type, canonical_source_key, body_hash, arg_min(fetched_at, id) AS fetched_at, min(id) AS id FROM raw GROUP BY ALL")
def raw_dedup(m: Model) -> DataFrame:
    key = ["provider", "endpoint_type", "canonical_source_key", "body_hash"]
    return merge.first_of(m.raw.select(*key, "id", "fetched_at"), key, ["id"])


@query("SELECT DISTINCT ON (provider, endpoint_type, canonical_source_key, body_hash) provider, endpoint_type, canonical_source_key, body_hash, id FROM raw r WHERE id >= 300 AND NOT EXISTS (SELECT 1 FROM raw o WHERE o.id < 300 AND o.provider = r.provider AND o.endpoint_type = r.endpoint_type AND o.canonical_source_key = r.canonical_source_key AND o.body_hash = r.body_hash) ORDER BY ALL")
def raw_insert_absent(m: Model) -> DataFrame:
    key = ["provider", "endpoint_type", "canonical_source_key", "body_hash"]
    rows = m.raw.select(*key, "id")
    return merge.insert_absent(rows.where("id < 300"), rows.where("id >= 300"), key, ["id"]).select(*key, "id")


@query("SELECT user_id AS canonical_source_key, max_by(event_type, struct_pack(ts := ts, id := event_id)) AS etag, max_by(json_extract_string(props, '$.k'), struct_pack(ts := ts, id := event_id)) AS last_modified FROM events GROUP BY user_id")
def latest_validators(m: Model) -> DataFrame:
    headers = F.to_json(F.create_map(F.lit("etag"), F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "last-modified").otherwise("last_modified"), F.get_json_object("props", "$.k")))
    e = m.table("events").select(F.col("user_id").alias("canonical_source_key"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("id"), headers.alias("response_headers"))
    return ingest.latest_validators(e)


@query("SELECT CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 5 END AS days, p_type AS time_class, CAST(min(p_partkey) AS BIGINT) AS p_partkey FROM part GROUP BY ALL")
def dim_get_or_create(m: Model) -> DataFrame:
    rows = m.table("part").select(F.when(F.col("p_size") % 5 != 0, F.col("p_size") % 5).alias("days"), F.col("p_type").alias("time_class"), "p_partkey")
    return merge.first_of(rows, ["days", "time_class"], ["p_partkey"])


@query("SELECT user_id AS entity_id, event_type AS entity_type, min(event_id) AS first_seen FROM events GROUP BY ALL")
def provenance_dedup(m: Model) -> DataFrame:
    rows = m.table("events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("entity_type"), F.col("event_id").alias("first_seen"))
    return merge.first_of(rows, ["entity_id", "entity_type"], ["first_seen"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)")
def fk_violations(m: Model) -> DataFrame:
    return merge.missing_references(m.table("orders").select("o_orderkey", "o_custkey"), "o_custkey", m.table("customer").where("c_nationkey != 3"), "c_custkey")


@query("SELECT source, count(*) AS rows FROM documents GROUP BY source HAVING count(*) > 1")
def repeated_keys(m: Model) -> DataFrame:
    return merge.repeated_keys(m.table("documents"), ["source"])


@query(
    "SELECT event_id, CASE WHEN s IN (200, 304) THEN 'done' WHEN s IN (404, 410) THEN 'skipped' WHEN s = 429 THEN 'blocked' ELSE 'error' END AS state, CASE s WHEN 304 THEN 'unchanged since it was last stored' WHEN 404 THEN 'the provider has nothing here (404)' WHEN 410 THEN 'the provider has removed this (410)' WHEN 429 THEN 'the provider asks to wait (429)' ELSE 'unexpected answer ' || s END AS message FROM (SELECT event_id, [200, 304, 404, 410, 429, 500, 0][event_id % 7 + 1] AS s FROM events)"
)
def status_to_state(m: Model) -> DataFrame:
    status = F.get(F.array(*map(F.lit, [200, 304, 404, 410, 429, 500, 0])), (F.col("event_id") % 7).cast("int"))
    return m.table("events").select("event_id", codes.job_state(status).alias("state"), codes.status_note(status).alias("message"))


@query("SELECT doc_id, (SELECT min(d.doc_id) FROM documents d WHERE d.text = x.text) AS entity FROM documents x")
def game_identity(m: Model) -> DataFrame:
    rows = m.table("documents").select("doc_id", F.array(codes.sha(F.col("text")), F.concat(F.lit("id:"), F.col("doc_id").cast("string"))).alias("tokens"))
    return merge.identities(rows, "doc_id", F.col("tokens")).select(F.col("record").alias("doc_id"), "entity")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) + 99 AS id FROM events")
def surrogate_ids(m: Model) -> DataFrame:
    return merge.number_from(m.table("events").select("event_id", "ts"), ["ts", "event_id"], 100).select("event_id", "id")


# --- graphs -------------------------------------------------------------------------------

_BFS = (
    "v0 AS (SELECT 'lichess' AS provider, CAST(7 AS BIGINT) AS user_id, 0 AS depth)",
    "e1 AS (SELECT n.*, 1 AS depth FROM neighbours n JOIN v0 USING (provider, user_id) WHERE (n.provider, opponent_id) NOT IN (SELECT (provider, user_id) FROM v0))",
    "v1 AS (SELECT * FROM v0 UNION ALL SELECT DISTINCT provider, opponent_id, 1 FROM e1)",
    "e2 AS (SELECT n.*, 2 AS depth FROM neighbours n JOIN v1 ON v1.provider = n.provider AND v1.user_id = n.user_id AND v1.depth = 1 WHERE (n.provider, opponent_id) NOT IN (SELECT (provider, user_id) FROM v1))",
    "v2 AS (SELECT * FROM v1 UNION ALL SELECT DISTINCT provider, opponent_id, 2 FROM e2)",
)
_EDGE = "provider, user_id AS from_user_id, opponent_id AS to_user_id, via_game_id, game_count, depth"


def _neighbours(m: Model) -> DataFrame:
    return reports.opponents_of(m.users, m.games)


def _seed(m: Model) -> DataFrame:
    return m.users.where(f"provider = 'lichess' and username_normalized = '{USER}'").select("provider", F.col("id").alias("user_id"))


@query(f"SELECT {_EDGE} FROM e1 UNION ALL SELECT {_EDGE} FROM e2", _NEIGHBOURS, *_BFS)
def bfs_edges(m: Model) -> DataFrame:
    return graph.crawl(_neighbours(m), _seed(m), graph.Bounds(2))[0]


@query("SELECT * FROM v2", _NEIGHBOURS, *_BFS)
def bfs_depths(m: Model) -> DataFrame:
    return graph.crawl(_neighbours(m), _seed(m), graph.Bounds(2))[1]


@query("SELECT provider, user_id, depth FROM v0 UNION ALL (SELECT provider, opponent_id, 1 FROM e1 ORDER BY game_count DESC, opponent_username LIMIT 9)", _NEIGHBOURS, *_BFS)
def frontier_capped(m: Model) -> DataFrame:
    return graph.crawl(_neighbours(m), _seed(m), graph.Bounds(1, max_users=10))[1]


@query(
    "SELECT provider, from_username, to_username, crawl_run_id, from_user_id, to_user_id, via_game_id, game_count, depth, 'opponent' AS edge_kind FROM (SELECT e.provider, f.username_normalized AS from_username, t.username_normalized AS to_username, CAST(1 AS BIGINT) AS crawl_run_id, e.user_id AS from_user_id, opponent_id AS to_user_id, via_game_id, game_count, depth FROM e1 e JOIN users f ON f.id = e.user_id AND f.provider = e.provider JOIN users t ON t.id = opponent_id AND t.provider = e.provider)",
    _NEIGHBOURS,
    *_BFS,
)
def export_graph(m: Model) -> DataFrame:
    edges = graph.crawl(_neighbours(m), _seed(m), graph.Bounds(1))[0]
    return reports.export_graph(edges.withColumns({"crawl_run_id": F.lit(1).cast("bigint"), "edge_kind": F.lit("opponent")}), m.users)


@query("SELECT provider, count(DISTINCT user_id) AS users FROM r GROUP BY provider", "r AS (SELECT 'lichess' AS provider, CAST(7 AS BIGINT) AS user_id UNION SELECT s.provider, s.other FROM r JOIN seats s ON s.provider = r.provider AND s.me = r.user_id)")
def reachable_count(m: Model) -> DataFrame:
    return graph.reachable(_neighbours(m), _seed(m)).groupBy("provider").agg(F.count(F.lit(1)).alias("users"))


@query(
    "SELECT provider, user_id, min(reached) AS component FROM r GROUP BY ALL",
    "links AS (SELECT DISTINCT provider, me, other FROM seats)",
    # a number spreads over larger ones only: the smallest of a component still gets everywhere
    "r AS (SELECT DISTINCT provider, me AS user_id, me AS reached FROM links UNION SELECT l.provider, l.other, r.reached FROM r JOIN links l ON l.provider = r.provider AND l.me = r.user_id WHERE r.reached < l.other)",
)
def user_components(m: Model) -> DataFrame:
    return graph.components(_neighbours(m))


# --- further reports ----------------------------------------------------------------------


@query(f"SELECT s.me AS user_id, u.provider, u.username_normalized AS opponent_username, u.display_username AS opponent_display, count(*) AS games, {MY_SCORES} FROM scored s JOIN users u ON u.id = s.other AND u.provider = s.provider GROUP BY ALL HAVING count(*) >= 2")
def repeated_opponents(m: Model) -> DataFrame:
    return extras.repeated_opponents(m.users, m.games, 2)


@query("SELECT provider, CAST(floor((1000 + floor(c_acctbal / 10)) / 100) * 100 AS BIGINT) AS band, count(*) AS seats FROM seats JOIN customer ON c_custkey = other GROUP BY ALL")
def rating_bands(m: Model) -> DataFrame:
    return extras.rating_bands(m.rated_games)


@query("SELECT provider, time_class, raw_label AS time_control, count(*) AS games FROM games JOIN controls c ON c.id = time_control_id GROUP BY ALL")
def time_control_dist(m: Model) -> DataFrame:
    return extras.time_control_distribution(m.games, m.variants, m.controls)


@query("SELECT *, round(100.0 * games / sum(games) OVER (PARTITION BY provider), 2) AS percent FROM (SELECT provider, canonical_name AS variant, count(*) AS games FROM games JOIN variants v ON v.id = variant_id GROUP BY ALL)")
def variant_dist_pct(m: Model) -> DataFrame:
    return extras.variant_distribution(m.games, m.variants, m.controls)


@query(
    "SELECT provider, me AS user_id, color, count(*) AS games, count(*) FILTER (won) AS wins, count(*) FILTER (outcome = 'draw') AS draws, count(*) FILTER (lost) AS losses, round(100.0 * (count(*) FILTER (won) + count(*) FILTER (outcome = 'draw') / 2) / nullif(count(outcome), 0), 2) AS score_percent FROM scored GROUP BY ALL"
)
def wdl_by_color(m: Model) -> DataFrame:
    return extras.results_by_color(m.games)


@query("SELECT provider, status_raw, outcome, count(*) AS games FROM games GROUP BY ALL")
def termination_dist(m: Model) -> DataFrame:
    return extras.termination_distribution(m.games)


@query("SELECT status, count(*) AS entities, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM (SELECT provider_user_id, arg_max(status, captured_at * 1000000 + event_id) AS status FROM snapshots GROUP BY 1) GROUP BY status")
def latest_status_pct(m: Model) -> DataFrame:
    return extras.latest_status(m.snapshots, "provider_user_id", ["captured_at", "event_id"], "status")


@query("SELECT provider, coalesce(strftime(make_timestamp(ended_at * 1000000), '%Y'), 'unknown') AS period, count(*) AS games FROM games GROUP BY ALL")
def games_by_period(m: Model) -> DataFrame:
    return extras.games_by_period(m.games)


@query("SELECT depth, " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ("pending", "in_progress", "done", "error", "skipped", "blocked")) + " FROM jobs GROUP BY depth")
def depth_frontier(m: Model) -> DataFrame:
    return extras.depth_frontier(m.jobs)


@query(
    "SELECT *, CAST(games > 0 AS INTEGER) AS covered FROM (SELECT key AS provider, month, count(g.id) AS games FROM (SELECT key, strftime(unnest(generate_series(TIMESTAMP '1996-06-01', TIMESTAMP '1998-01-01', INTERVAL 1 MONTH)), '%Y-%m') AS month FROM providers) m LEFT JOIN games g ON g.provider = key AND strftime(make_timestamp(g.ended_at * 1000000), '%Y-%m') = month GROUP BY key, month)"
)
def month_coverage(m: Model) -> DataFrame:
    return extras.month_coverage(m.games, 833587200 + 86400 * 5, 883612800 + 3600)


@query(
    "SELECT user_id, gap_start, s AS gap_end FROM (SELECT user_id, s, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_start FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + 14400 AS e FROM events)) WHERE s > gap_start"
)
def coverage_gaps(m: Model) -> DataFrame:
    start = codes.epoch_of(F.col("ts"))
    ranges = m.table("events").select("user_id", start.alias("s"), (start + 14400).alias("e"))
    return extras.coverage_gaps(ranges, ["user_id"], "s", "e")


@query(
    "SELECT provider, me AS user_id, max(gain) AS largest_gain, count(*) AS rated_seats FROM (SELECT provider, me, r - min(r) OVER (PARTITION BY provider, me ORDER BY ended_at RANGE BETWEEN 7776000 PRECEDING AND CURRENT ROW) AS gain FROM (SELECT provider, me, ended_at, CAST(1000 + floor(c_acctbal / 10) AS BIGINT) AS r FROM seats JOIN customer ON c_custkey = me WHERE ended_at IS NOT NULL)) GROUP BY ALL"
)
def rating_change(m: Model) -> DataFrame:
    return extras.rating_change(m.rated_games, 90 * 86400)
