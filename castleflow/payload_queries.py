"""Registered queries of everything between an answer and the model: requests, parsing, merges, jobs, ingest, crawls."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castleflow.functions import codes
from castleflow.operators import ingest, merge, normalize
from castleflow.operators.archive import Archive
from castleflow.operators.shared import settle, shared_dir
from castleflow.plans import extras, jobs, payloads, reports, views
from castleflow.plans.adapter import Model
from castleflow.plans.runner import Ingested, Runner, Service
from castleflow.registry import query
from castleflow.sources import http, planning, providers

_FLAT = "SELECT * FROM {}"

# --- requests -----------------------------------------------------------------------------

_WINDOW = "w AS (SELECT key AS provider, c_name AS username, lower(c_name) AS name, url_encode(lower(c_name)) AS path, c_custkey AS k, CASE WHEN c_custkey % 7 <> 0 THEN 852076800 + c_custkey * 3600 END AS since, CASE WHEN c_custkey % 5 <> 0 THEN 852076800 + c_custkey * 3600 + 86400 * (c_custkey % 100 + 1) END AS until, c_custkey % 4 AS lim FROM customer, providers)"


def _windows(m: Model) -> DataFrame:
    k = F.col("id")
    since, until = F.lit(852076800).cast("bigint") + k * 3600, F.lit(852076800).cast("bigint") + k * 3600 + 86400 * (k % 100 + 1)
    return m.users.select("provider", F.concat(F.lit(" "), "display_username").alias("username"), F.when(k % 7 != 0, since).alias("since"), F.when(k % 5 != 0, until).alias("until"), (k % 4).alias("limit"), k.alias("k"))


@query("SELECT provider, 'user_profile' AS endpoint_type, CASE provider WHEN 'lichess' THEN 'https://lichess.org/api/user/' || path ELSE 'https://api.chess.com/pub/player/' || path END AS url, CASE provider WHEN 'lichess' THEN 'lichess/user/' ELSE 'chess.com/player/' END || name || '/profile' AS source_key FROM w", _WINDOW)
def profile_requests(m: Model) -> DataFrame:
    return planning.profiles(_windows(m))


@query("SELECT provider, e AS endpoint_type, 'https://api.chess.com/pub/player/' || path || tail AS url, 'chess.com/player/' || name || tail AS source_key FROM w, (VALUES ('user_stats', '/stats'), ('archives_index', '/games/archives')) x(e, tail) WHERE provider = 'chess.com'", _WINDOW)
def stats_and_index_requests(m: Model) -> DataFrame:
    return planning.stats(_windows(m)).unionByName(planning.indexes(_windows(m)))


@query(
    "SELECT provider, 'monthly_archive' AS endpoint_type, 'https://api.chess.com/pub/player/' || path || unit AS url, 'chess.com/player/' || name || unit AS source_key FROM (SELECT *, strftime(unnest(generate_series(date_trunc('month', make_timestamp(since * 1000000)), date_trunc('month', make_timestamp((until - 1) * 1000000)), INTERVAL 1 MONTH)), '/games/%Y/%m') AS unit FROM w WHERE provider = 'chess.com' AND since IS NOT NULL AND until IS NOT NULL)",
    _WINDOW,
)
def month_requests(m: Model) -> DataFrame:
    return planning.months(_windows(m))


_DAY = "coalesce(strftime(make_timestamp({} * 1000000), '%Y-%m-%d'), 'open')"


@query(
    "SELECT provider, 'user_games_stream' AS endpoint_type, 'https://lichess.org/api/games/user/' || path || '?' || coalesce('since=' || since * 1000 || '&', '') || coalesce('until=' || until * 1000 || '&', '') || 'max=' || lim || '&pgnInJson=true&opening=true&clocks=false&evals=false' AS url, "
    f"'lichess/games/user/' || name || '/' || {_DAY.format('since')} || '..' || {_DAY.format('until')} || '-limit-' || lim AS source_key FROM w WHERE provider = 'lichess' AND lim > 0",
    _WINDOW,
)
def window_requests(m: Model) -> DataFrame:
    return planning.windows(_windows(m))


@query("SELECT 'lichess' AS provider, 'game' AS endpoint_type, 'https://lichess.org/api/game/' || url_encode('Ab*' || o_orderkey || '~/é') AS url, 'lichess/game/Ab*' || o_orderkey || '~/é' AS source_key FROM orders")
def game_requests(m: Model) -> DataFrame:
    return planning.games(m.table("orders").select(F.lit("lichess").alias("provider"), F.concat(F.lit(" Ab*"), "o_orderkey", F.lit("~/é ")).alias("game_id")))


@query("SELECT DISTINCT c AS payload, lower(cn) AS username, strftime(make_timestamp(t * 1000000), '%Y/%m') AS unit_id, 'https://api.chess.com/pub/player/' || lower(cn) || strftime(make_timestamp(t * 1000000), '/games/%Y/%m') AS url FROM pairs WHERE k % 3 = 0", payloads.SQL.strip())
def archive_units(m: Model) -> DataFrame:
    return planning.archive_units(payloads.indexes(m))


@query("SELECT p_partkey, coalesce(strftime(make_timestamp(a * 1000000), '%Y-%m-%d'), 'open') || '..' || coalesce(strftime(make_timestamp(b * 1000000), '%Y-%m-%d'), 'open') || coalesce('-limit-' || l, '') AS unit FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey * 100000 END AS a, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey * 200000 END AS b, CASE WHEN p_size % 2 = 0 THEN p_size END AS l FROM part)")
def range_unit(m: Model) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return m.table("part").select("p_partkey", codes.range_unit(F.when(k % 3 != 0, k * 100000), F.when(k % 4 != 0, k * 200000), F.when(size % 2 == 0, size)).alias("unit"))


_GRID = [(p, s, a, n) for p in ("chess.com", "lichess") for s in (None, 429, 500, 503) for a in (None, 0, 3, 90) for n in (1, 2, 3)]


@query(
    "SELECT *, CASE WHEN status = 429 THEN CASE provider WHEN 'lichess' THEN 60.0 ELSE greatest(1.0, coalesce(asked, 0)) END ELSE greatest(CASE provider WHEN 'lichess' THEN 1.5 ELSE 1.0 END * CAST(pow(2, tries - 1) AS DOUBLE), coalesce(asked, 0)) END::DOUBLE AS pause "
    "FROM (SELECT key AS provider, unnest([NULL, 429, 500, 503])::BIGINT AS status FROM providers), (SELECT unnest([NULL, 0, 3, 90])::BIGINT AS asked), (SELECT unnest([1, 2, 3])::BIGINT AS tries)"
)
def retry_pauses(m: Model) -> DataFrame:
    """The fetch loop's pauses; they are a rule of the driver, over a grid of its cases."""
    rows = [(p, s, a, n, float(providers.PROVIDERS[p].pace.pause(s, a, n))) for p, s, a, n in _GRID]
    return m.spark.createDataFrame(rows, "provider string, status bigint, asked bigint, tries bigint, pause double")


@query(
    "SELECT * FROM (VALUES ('chess.com', 'Accept', 'application/json'), ('chess.com', 'If-Modified-Since', 'Mon'), ('chess.com', 'If-None-Match', 'e'), ('chess.com', 'User-Agent', 'castleflow/0.1.0 (+contact: a@b.example)'), "
    "('lichess', 'Accept', 'application/json'), ('lichess', 'Authorization', 'Bearer t'), ('lichess', 'User-Agent', 'castleflow/0.1.0 (+contact: a@b.example)'), ('kept', 'etag', 'x'), ('kept', 'retry-after', '5')) v(provider, header, value)"
)
def request_headers(m: Model) -> DataFrame:
    """Headers that are sent with a profile's request, and those of an answer that are kept."""
    settings = providers.Settings.from_env({"CASTLEFLOW_CONTACT": "a@b.example", "CASTLEFLOW_LICHESS_TOKEN": "t"})
    sent = [(k, h, v) for k in providers.PROVIDERS for h, v in http.sent_headers(providers.user_profile(k, "x").headers(settings, "e", "Mon") | {"Cookie": "c"}).items()]
    kept = [("kept", h, v) for h, v in http.kept_headers({"ETag": "x", "Set-Cookie": "s", "Retry-After": "5", "Authorization": "z"}).items()]
    return m.spark.createDataFrame(sent + kept, "provider string, header string, value string")


@query("SELECT * FROM (VALUES ('chess.com', 'Chess.com', 'https://api.chess.com/pub', 0, 'seconds', 1.0::DOUBLE, 3), ('lichess', 'Lichess', 'https://lichess.org/api', 1, 'milliseconds', 1.5::DOUBLE, 3)) v(key, name, base_url, single_games, clock, apart, retries)")
def provider_registry(m: Model) -> DataFrame:
    return providers.providers_frame(m.spark).withColumn("single_games", F.col("single_games").cast("int")).drop("docs_url")


# --- scalar rules -------------------------------------------------------------------------


@query("SELECT event_id, nullif(['', 'x', CAST(event_id AS VARCHAR), NULL][event_id % 4 + 1], '') AS value FROM events")
def text_or_null(m: Model) -> DataFrame:
    k = F.col("event_id")
    value = F.when(k % 4 == 0, "").when(k % 4 == 1, "x").when(k % 4 == 2, k.cast("string"))
    return m.table("events").select("event_id", codes.text_or_null(value).alias("value"))


@query("SELECT p_partkey, CASE WHEN shut IS NULL OR shut IN ('false', '', '0') THEN status ELSE CASE WHEN coalesce(status, '') = '' THEN 'closed' ELSE 'closed:' || status END END AS status FROM (SELECT p_partkey, ['premium', '', NULL, 'basic'][p_partkey % 4 + 1] AS status, [NULL, 'false', 'true', '', 'fair_play', '0', '1'][p_size % 7 + 1] AS shut FROM part)")
def closed_status(m: Model) -> DataFrame:
    status, shut = payloads.pick(["premium", "", None, "basic"], F.col("p_partkey") % 4), payloads.pick([None, "false", "true", "", "fair_play", "0", "1"], F.col("p_size") % 7)
    return m.table("part").select("p_partkey", codes.closed_status(status, shut).alias("status"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 <> 0 THEN p_size * 60 END || '+' || CASE WHEN p_partkey % 4 <> 0 THEN p_size % 7 END, 'blitz') AS label FROM part")
def clock_label(m: Model) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return m.table("part").select("p_partkey", codes.clock_label(F.when(k % 3 != 0, size * 60), F.when(k % 4 != 0, size % 7), F.lit("blitz")).alias("label"))


@query(
    "SELECT o_orderkey, CAST(epoch(CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) ELSE date_trunc('month', o_orderdate) END) AS BIGINT) AS since, CAST(epoch(CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) ELSE date_trunc('month', o_orderdate) + INTERVAL 1 MONTH END) AS BIGINT) AS until FROM orders"
)
def date_bounds(m: Model) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    return m.table("orders").select("o_orderkey", codes.date_bound(text).alias("since"), codes.date_bound(text, is_until=True).alias("until"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN greatest(0, event_id - 500) WHEN 1 THEN 7 END AS seconds FROM events")
def retry_after(m: Model) -> DataFrame:
    k = F.col("event_id")
    text = F.when(k % 4 == 0, (k - 500).cast("string")).when(k % 4 == 1, " 7 ").when(k % 4 == 2, "soon")
    return m.table("events").select("event_id", codes.retry_after(text).alias("seconds"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE lower(c_name) END AS username FROM customer")
def username_of_key(m: Model) -> DataFrame:
    key = F.when(F.col("c_custkey") % 5 == 0, "short").otherwise(F.concat(F.lit("chess.com/player/"), F.lower("c_name"), F.lit("/stats")))
    return m.table("customer").select("c_custkey", codes.username_of_key(key).alias("username"))


@query("SELECT user_id, event_id, '{\"a\":' || user_id || ',\"k\":' || json_extract_string(props, '$.k') || ',\"z\":{\"b\":null,\"c\":\"' || event_type || '\"}}' AS params FROM events")
def canonical_params(m: Model) -> DataFrame:
    text = F.concat(F.lit('{ "z": {"c" : "'), "event_type", F.lit('", "b":null}, "k": '), F.get_json_object("props", "$.k"), F.lit(', "a": '), "user_id", F.lit(" }"))
    return m.table("events").select("user_id", "event_id", codes.canonical_json(text).alias("params"))


# --- parsing ------------------------------------------------------------------------------


@query(_FLAT.format("cc"), payloads.SQL.strip())
def parse_month_games(m: Model) -> DataFrame:
    return payloads.flat(normalize.games_of(payloads.months(m)))


@query(_FLAT.format("li"), payloads.SQL.strip())
def parse_stream_games(m: Model) -> DataFrame:
    return payloads.flat(normalize.games_of(payloads.streams(m)))


def _every(m: Model) -> DataFrame:
    out = payloads.months(m)
    for part in (payloads.streams, payloads.singles, payloads.profiles, payloads.stats, payloads.indexes):
        out = out.unionByName(part(m))
    return out


@query(
    "SELECT 'chess.com' AS provider, 'monthly_archive' AS endpoint_type, count(*) AS games, count(DISTINCT payload) AS payloads FROM cc UNION ALL SELECT 'lichess', 'user_games_stream', count(*), count(DISTINCT payload) FROM li UNION ALL SELECT 'lichess', 'game', count(*), count(*) FROM pairs WHERE k % 50 = 1 AND k % 3 <> 0",
    payloads.SQL.strip(),
)
def dispatch_game_payloads(m: Model) -> DataFrame:
    """Each payload goes to the parser of its provider and endpoint; others have no games."""
    staged = normalize.games_of(_every(m))
    return staged.groupBy("provider", "endpoint_type").agg(F.count(F.lit(1)).alias("games"), F.count_distinct("payload").alias("payloads"))


_USER = "payload, provider, provider_user_id, username_normalized, display_username, account_status, title, content_hash, count_all, count_draw, count_loss, count_rated, count_win, country, followers, patron, perfs_or_stats"


def _users(m: Model, raw: DataFrame) -> DataFrame:
    return normalize.users_of(raw).withColumn("patron", F.col("patron").cast("int")).select(*_USER.split(", "))


@query(
    f"SELECT {_USER} FROM (SELECT c_custkey AS payload, 'chess.com' AS provider, CAST(c_custkey AS VARCHAR) AS provider_user_id, lower(c_name) AS username_normalized, c_name AS display_username, st AS account_status, title, 'sha256:' || sha256(body) AS content_hash, CAST(NULL AS BIGINT) AS count_all, CAST(NULL AS BIGINT) AS count_draw, CAST(NULL AS BIGINT) AS count_loss, CAST(NULL AS BIGINT) AS count_rated, CAST(NULL AS BIGINT) AS count_win, country, c_custkey % 50 AS followers, CAST(NULL AS INTEGER) AS patron, body AS perfs_or_stats "
    "FROM (SELECT *, CAST(to_json({'country': country, 'created_at': c_custkey + 1000, 'followers': c_custkey % 50, 'kind': 'profile', 'status': st, 'title': title, 'username': c_name}) AS VARCHAR) AS body FROM (SELECT *, 'https://c.example/' || c_nationkey AS country, CASE WHEN c_nationkey = 0 THEN 'NM' END AS title, CASE WHEN c_mktsegment = 'BUILDING' THEN 'closed:' ELSE '' END || CASE WHEN c_custkey % 2 = 0 THEN 'premium' ELSE 'basic' END AS st FROM customer))) "
    f"UNION ALL SELECT {_USER} FROM (SELECT c_custkey AS payload, 'lichess' AS provider, lower(c_name) AS provider_user_id, lower(c_name) AS username_normalized, c_name AS display_username, st AS account_status, title, "
    "'sha256:' || sha256(CAST(to_json({'count': {'all': k % 90, 'draw': NULL, 'loss': k % 20, 'rated': k % 80, 'win': k % 30}, 'country': country, 'kind': 'profile', 'patron': patron, 'perfs': perfs, 'status': st, 'title': title, 'username': c_name}) AS VARCHAR)) AS content_hash, "
    "k % 90 AS count_all, CAST(NULL AS BIGINT) AS count_draw, k % 20 AS count_loss, k % 80 AS count_rated, k % 30 AS count_win, country, CAST(NULL AS BIGINT) AS followers, CAST(patron AS INTEGER) AS patron, '{\"perfs\":' || perfs || '}' AS perfs_or_stats "
    "FROM (SELECT *, c_custkey AS k, 'C' || c_nationkey AS country, CASE WHEN c_nationkey = 0 THEN 'NM' END AS title, CASE WHEN c_mktsegment = 'BUILDING' THEN 'tosViolation' END AS st, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 2 = 0 END AS patron, '{\"blitz\":{\"games\":' || c_custkey % 9 || '}}' AS perfs FROM customer))"
)
def parse_profiles(m: Model) -> DataFrame:
    return _users(m, payloads.profiles(m))


@query(
    f"SELECT {_USER} FROM (SELECT k AS payload, 'chess.com' AS provider, CAST(NULL AS VARCHAR) AS provider_user_id, n AS username_normalized, n AS display_username, CAST(NULL AS VARCHAR) AS account_status, CAST(NULL AS VARCHAR) AS title, 'sha256:' || sha256('{{\"kind\":\"stats\",\"stats\":' || body || ',\"username\":\"' || n || '\"}}') AS content_hash, "
    "nullif(w + l, 0) AS count_all, CAST(NULL AS BIGINT) AS count_draw, nullif(l, 0) AS count_loss, nullif(w + l, 0) AS count_rated, nullif(w, 0) AS count_win, CAST(NULL AS VARCHAR) AS country, CAST(NULL AS BIGINT) AS followers, CAST(NULL AS INTEGER) AS patron, body AS perfs_or_stats "
    "FROM (SELECT c_custkey AS k, lower(c_name) AS n, c_custkey % 7 + CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 5 ELSE 0 END AS w, c_custkey % 3 * CASE WHEN c_custkey % 4 <> 0 THEN 2 ELSE 1 END AS l, "
    "'{' || CASE WHEN c_custkey % 4 <> 0 THEN '\"chess_blitz\":{\"record\":{\"draw\":0,\"loss\":' || c_custkey % 3 || ',\"win\":' || c_custkey % 5 || '}},' ELSE '' END || '\"chess_rapid\":{\"record\":{\"draw\":0,\"loss\":' || c_custkey % 3 || ',\"win\":' || c_custkey % 7 || '}},\"tactics\":{\"best\":5}}' AS body FROM customer))".replace("{{", "{").replace("}}}}", "}}}}")
)
def parse_stats(m: Model) -> DataFrame:
    return _users(m, payloads.stats(m))


@query(
    "SELECT payload, provider, endpoint_type, CASE WHEN bad THEN 'pending' WHEN n > 0 THEN 'parsed' ELSE 'skipped' END AS normalization_status, CASE WHEN NOT bad THEN 77 END AS normalized_at FROM (SELECT c AS payload, 'chess.com' AS provider, 'monthly_archive' AS endpoint_type, c % 10 = 0 AS bad, (SELECT count(*) FROM cc WHERE cc.payload = c) AS n FROM (SELECT DISTINCT c FROM cc0) "
    "UNION ALL SELECT DISTINCT c, 'chess.com', 'archives_index', c % 10 = 0, 0 FROM cc0)",
    payloads.SQL.strip(),
)
def payload_states(m: Model) -> DataFrame:
    """What becomes of payloads after a batch; every tenth customer's can't be read and wait."""
    raw = payloads.months(m).unionByName(payloads.indexes(m))
    held = raw.withColumn("id", F.when(F.col("endpoint_type") == "archives_index", -F.col("payload")).otherwise(F.col("payload")))
    useful = normalize.games_of(held.withColumn("payload", F.col("id"))).select("payload")
    bad = held.where("payload % 10 = 0").select(F.col("id").alias("payload"))
    states = ingest.next_states(held.select(F.col("id").alias("payload")), bad, useful, 77)
    landed = held.select("id", "payload", "provider", "endpoint_type", F.lit(None).cast("string").alias("parser_version"), F.lit("pending").alias("normalization_status"), F.lit(None).cast("bigint").alias("normalized_at"))
    return views.with_states(landed, states).select("payload", "provider", "endpoint_type", "normalization_status", "normalized_at")


@query("SELECT id, CASE WHEN id % 9 <> 0 THEN 1 ELSE 0 END AS intact FROM raw")
def stored_payloads_intact(m: Model) -> DataFrame:
    body = F.encode("text", "UTF-8")
    rows = m.table("documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 9 != 0, body).otherwise(F.concat(body, F.lit(b"!"))).alias("raw_body"), codes.sha(body).alias("body_hash"))
    return rows.select("id", ingest.intact().cast("int").alias("intact"))


@query(
    "SELECT id AS game_id, color, CASE WHEN color = 'white' THEN r ELSE r2 END AS rating, CAST(NULL AS BIGINT) AS rating_diff, CAST(NULL AS BIGINT) AS rd FROM (SELECT s.id, s.color, CAST(1000 + floor(w.c_acctbal / 10) AS BIGINT) AS r, CAST(1000 + floor(b.c_acctbal / 10) AS BIGINT) AS r2 FROM seats s JOIN customer w ON w.c_custkey = s.white_id JOIN customer b ON b.c_custkey = s.black_id)"
)
def seat_ratings(m: Model) -> DataFrame:
    games = m.rated_games
    for c in ("white", "black"):
        games = games.withColumn(c, F.col(c).withField("rating_diff", F.lit(None).cast("bigint")).withField("rd", F.lit(None).cast("bigint")))
    return views.ratings_at_game(games)


# --- merges -------------------------------------------------------------------------------

_PICKED = {"first": "arg_min_null({0}, event_id)", "last": "arg_max_null({0}, event_id)", "first_non_null": "arg_min({0}, event_id)", "last_non_null": "arg_max({0}, event_id)", "min": "min({0})", "max": "max({0})"}


def _merge_query(name: str, policies: dict[str, str]) -> None:
    """Register a merge of all columns of a table, each with gaps of its own, in two batches and the second one twice."""
    columns = list(policies)
    value = lambda i: f"CASE WHEN (event_id + {i}) % 3 <> 0 THEN event_id * 31 % 1009 + {i} END"
    sql = "SELECT user_id, " + ", ".join(f"{_PICKED[policies[c]].format(value(i))} AS {c}" for i, c in enumerate(columns)) + " FROM events GROUP BY user_id"

    def merged(m: Model) -> DataFrame:
        k = F.col("event_id")
        rows = m.table("events").select("user_id", "event_id", *[F.when((k + i) % 3 != 0, k * 31 % 1009 + i).alias(c) for i, c in enumerate(columns)])
        current, batch = merge.reduce_by(rows.where("event_id < 700"), ["user_id"], k, policies), rows.where("event_id >= 700")
        for _ in range(2):
            current = merge.merge(current, batch, ["user_id"], ["event_id"], policies)
        return current

    merged.__name__ = name
    query(sql)(merged)


for _name, _policies in (("merge_users", merge.USERS), ("merge_games", merge.GAMES), ("merge_participants", merge.SEATS), ("merge_ratings", merge.RATINGS), ("merge_snapshots", merge.SNAPSHOTS), ("merge_edges", merge.EDGES), ("merge_variants", merge.VARIANTS)):
    _merge_query(_name, _policies)


@query("SELECT o_orderkey AS record, min(o_orderkey) OVER (PARTITION BY o_orderkey - o_orderkey % 6, o_orderkey % 6 = 5) AS entity FROM orders")
def identity_chains(m: Model) -> DataFrame:
    """Records that share a token only with the next one, in chains of five: the label travels along."""
    k = F.col("o_orderkey")
    chain = F.array(F.when(k % 6 < 4, F.concat(F.lit("a"), k)), F.when((k % 6 > 0) & (k % 6 < 5), F.concat(F.lit("a"), k - 1)))
    return merge.identities(m.table("orders").select("o_orderkey", chain.alias("tokens")), "o_orderkey", F.col("tokens"))


# --- attempts -----------------------------------------------------------------------------

_STATUS = "[200, 304, 404, 410, 429, 500, 0][event_id % 7 + 1]"


@query(
    f"SELECT event_id AS seq, provider, 'https://x.example/' || event_id AS url, event_type AS endpoint_type, 'http_' || s AS error_kind, CAST(s AS BIGINT) AS status_code, 'HTTP ' || s AS message, event_id + 5 AS occurred_at, CAST(0 AS BIGINT) AS retry_count, CAST(s <> 429 AS INTEGER) AS is_dead FROM (SELECT *, {_STATUS} AS s, CASE WHEN user_id % 2 = 0 THEN 'lichess' ELSE 'chess.com' END AS provider FROM events) WHERE s IN (404, 410, 429)"
)
def errors_of_attempts(m: Model) -> DataFrame:
    k = F.col("event_id")
    status = F.get(F.array(*map(F.lit, [200, 304, 404, 410, 429, 500, 0])), (k % 7).cast("int")).cast("bigint")
    attempts = m.table("events").select(k.alias("seq"), F.when(F.col("user_id") % 2 == 0, "lichess").otherwise("chess.com").alias("provider"), F.concat(F.lit("https://x.example/"), k).alias("url"), F.col("event_type").alias("endpoint_type"), status.alias("status_code"), (k + 5).alias("attempted_at"))
    return ingest.error_of_attempts(attempts).withColumn("is_dead", F.col("is_dead").cast("int"))


# --- jobs in bulk -------------------------------------------------------------------------

_JOBS = (
    "j AS (SELECT id, crawl_run_id, provider, kind, target, state, priority, depth, enqueued_at, id % 4 AS attempts, CASE WHEN state = 'in_progress' THEN enqueued_at + id % 500 END AS started_at, CASE WHEN state IN ('done', 'error', 'skipped') THEN enqueued_at + 9 END AS done_at, CASE WHEN id % 3 = 0 THEN 'r' || id END AS reason, '{\"a\":' || depth || ',\"b\":null}' AS params FROM jobs)",
)
_SHOWN = "id, state, attempts, started_at, done_at, reason"


def _jobs(m: Model) -> DataFrame:
    k, at = F.col("id"), F.col("enqueued_at")
    held = m.jobs.withColumns({"attempts": k % 4, "started_at": F.when(F.col("state") == "in_progress", at + k % 500), "done_at": F.when(F.col("state").isin("done", "error", "skipped"), at + 9), "reason": F.when(k % 3 == 0, F.concat(F.lit("r"), k))})
    return held.withColumn("params_json", F.concat(F.lit('{"b": null, "a": '), "depth", F.lit("}")))


@query("SELECT id, 'sha256:' || sha256(concat_ws(chr(31), provider, kind, lower(target), CAST(crawl_run_id AS VARCHAR), params)) AS dedup_key FROM j", *_JOBS)
def job_keys(m: Model) -> DataFrame:
    return jobs.job_keys(_jobs(m).withColumn("target", F.concat(F.lit(" "), "target"))).select("id", "dedup_key")


@query(
    "SELECT dedup_key, min(id) AS seq FROM (SELECT id, concat_ws('|', provider, kind, lower(target), params) AS k, 'sha256:' || sha256(concat_ws(chr(31), provider, kind, lower(target), CAST(crawl_run_id AS VARCHAR), params)) AS dedup_key FROM j WHERE id % 2 = 1) b WHERE dedup_key NOT IN (SELECT 'sha256:' || sha256(concat_ws(chr(31), provider, kind, lower(target), CAST(crawl_run_id AS VARCHAR), params)) FROM j WHERE id % 2 = 0 AND state IN ('pending', 'in_progress', 'blocked')) GROUP BY dedup_key",
    *_JOBS,
)
def enqueue_jobs(m: Model) -> DataFrame:
    """Odd jobs asked for anew where the even ones stand: those without a live job of their key."""
    keyed = jobs.job_keys(_jobs(m))
    return jobs.enqueued(keyed.where("id % 2 = 0"), keyed.where("id % 2 = 1").withColumnRenamed("id", "seq")).select("dedup_key", "seq")


@query(
    "SELECT id, CASE WHEN mine THEN 'in_progress' ELSE state END AS state, attempts + CAST(mine AS INTEGER) AS attempts, CASE WHEN mine THEN 99 ELSE started_at END AS started_at, done_at, CASE WHEN NOT mine THEN reason END AS reason FROM (SELECT *, id = (SELECT id FROM j WHERE state = 'pending' AND crawl_run_id = 3 ORDER BY priority, depth, enqueued_at, id LIMIT 1) AS mine FROM j)",
    *_JOBS,
)
def claim_job(m: Model) -> DataFrame:
    return jobs.claimed(_jobs(m), 99, 3).select(*_SHOWN.split(", "))


@query(
    "SELECT id, CASE WHEN id % 5 = 0 THEN 'done' WHEN id % 5 = 1 THEN 'blocked' ELSE state END AS state, attempts, started_at, CASE WHEN id % 5 = 0 THEN 99 ELSE done_at END AS done_at, CASE WHEN id % 5 = 0 THEN 'ok' WHEN id % 5 = 1 THEN NULL ELSE reason END AS reason FROM j",
    *_JOBS,
)
def mark_jobs(m: Model) -> DataFrame:
    held = _jobs(m)
    marks = held.where("id % 5 < 2").select("id", F.when(F.col("id") % 5 == 0, "done").otherwise("blocked").alias("state"), F.when(F.col("id") % 5 == 0, "ok").alias("reason"))
    return jobs.marked(held, marks, 99).select(*_SHOWN.split(", "))


_REOPENED = "SELECT id, CASE WHEN {0} THEN 'pending' ELSE state END AS state, attempts, CASE WHEN NOT {0} THEN started_at END AS started_at, done_at, CASE WHEN {0} THEN coalesce(reason, '{1}') ELSE reason END AS reason FROM j"


@query(_REOPENED.format("(state = 'in_progress' AND started_at <= (SELECT CAST(median(started_at) AS BIGINT) FROM j))", jobs.RESUMED), *_JOBS)
def resume_stale_jobs(m: Model) -> DataFrame:
    held = _jobs(m)
    middle = int(held.agg(F.median("started_at")).first()[0])
    return jobs.resumed(held, middle + 60, 60).select(*_SHOWN.split(", "))


@query(_REOPENED.format("(state = 'in_progress')", jobs.RESUMED), *_JOBS)
def resume_all_jobs(m: Model) -> DataFrame:
    return jobs.resumed(_jobs(m), 0).select(*_SHOWN.split(", "))


@query(_REOPENED.format("(state = 'blocked')", jobs.UNBLOCKED), *_JOBS)
def unblock_jobs(m: Model) -> DataFrame:
    return jobs.unblocked(_jobs(m)).select(*_SHOWN.split(", "))


# --- the archive --------------------------------------------------------------------------


def _archive(m: Model) -> Archive:
    archive = Archive(m.spark, f"{shared_dir(m.spark)}/archive-{uuid.uuid4().hex}")
    archive.init(providers.providers_frame(m.spark), 1)
    return archive


@query("SELECT CAST(1 AS BIGINT) AS schema_version, CAST(16 AS BIGINT) AS tables, 'chess.com,lichess' AS providers, CAST(1 AS BIGINT) AS commit")
def archive_summary(m: Model) -> DataFrame:
    s = _archive(m).summary()
    return m.spark.createDataFrame([(s["schema_version"], s["tables"], ",".join(s["providers"]), s["commit"])], "schema_version bigint, tables bigint, providers string, commit bigint")


def _landed(raw: DataFrame) -> DataFrame:
    """Payloads as answers that were landed."""
    none = F.lit(None).cast("string")
    return raw.select(
        F.col("payload").alias("seq"), "provider", "endpoint_type", F.concat(F.lit("https://x.example/"), "canonical_source_key").alias("provider_url"), "canonical_source_key", none.alias("request_params"), F.lit(200).cast("bigint").alias("response_status"),
        none.alias("response_headers"), F.lit("application/json").alias("content_type"), "fetched_at", F.encode("body", "UTF-8").alias("raw_body"),
    )


def _ingested(m: Model) -> tuple[Archive, list[tuple[int, int]]]:
    """An archive after three batches: months, streams and profiles; some games by id, which have ended by then; the first batch again."""
    archive = _archive(m)
    first = settle(payloads.months(m).unionByName(payloads.streams(m)).unionByName(payloads.profiles(m)).unionByName(payloads.indexes(m)), "answers")
    late = payloads.singles(m).withColumn("fetched_at", F.col("payload") + 10_000_000)
    done = []
    for now, batch in enumerate((first, late, first)):
        stored = ingest.land(archive, _landed(batch))
        done.append((stored, ingest.normalize_pending(archive, now) if stored else 0))
    return archive, done


#: Games after all batches: the later sighting of a game wins, but for gaps.
_MERGED = """
late AS (SELECT * FROM shaped WHERE k % 50 = 1 AND k % 3 <> 0),
after_all AS (SELECT g.provider, g.provider_game_id, g.canonical_url, g.variant, g.variant_raw, g.rated, CASE WHEN l.k IS NULL THEN g.outcome ELSE 'white_win' END AS outcome, CASE WHEN l.k IS NULL THEN g.is_live ELSE 0 END AS is_live, CASE WHEN l.k IS NULL THEN g.status_raw ELSE 'mate' END AS status_raw,
  CASE WHEN l.k IS NULL THEN g.ended_at ELSE l.t END AS ended_at, g.created_at, g.eco, g.kind, g.initial_seconds, g.increment_seconds, g.days, g.time_class, g.raw_label, g.white_username, g.black_username, g.white_rating, g.black_rating, g.black_ai, g.payload + 1000 AS first_seen_at,
  CASE WHEN l.k IS NULL THEN g.white_result ELSE 'win' END AS white_result, l.k IS NOT NULL AS late, CASE WHEN l.k IS NULL THEN g.rated ELSE CAST(l.k % 13 <> 0 AS INTEGER) END AS rated_now FROM (SELECT * FROM cc UNION ALL SELECT * FROM li) g LEFT JOIN late l ON g.provider_game_id = 'l' || l.k)
"""
_KEPT = "provider, provider_game_id, canonical_url, variant, variant_raw, outcome, is_live, status_raw, ended_at, created_at, eco, kind, initial_seconds, increment_seconds, days, time_class, raw_label, white_username, black_username, white_rating, black_rating, black_ai, first_seen_at, white_result"


@query(f"SELECT {_KEPT}, rated_now AS rated FROM after_all", payloads.SQL.strip(), _MERGED.strip())
def ingest_games(m: Model) -> DataFrame:
    """Games of an archive after landing, parsing and merging of three batches."""
    archive, _ = _ingested(m)
    games = archive.table("games")
    v = archive.table("variants").select(F.col("id").alias("variant_id"), F.col("canonical_name").alias("variant"), F.col("provider_native_name").alias("variant_raw"))
    c = archive.table("time_controls").withColumnRenamed("id", "time_control_id")
    flag = lambda n, c: F.col(c).cast("int").alias(n)
    named = games.join(v, "variant_id").join(c, "time_control_id")
    plain = ["provider", "provider_game_id", "canonical_url", "variant", "variant_raw", "outcome", "status_raw", "ended_at", "created_at", "eco", "kind", "initial_seconds", "increment_seconds", "days", "time_class", "raw_label", "first_seen_at"]
    seats = [F.col(f"{c}.{f}").alias(f"{c}_{f}") for c in ("white", "black") for f in ("username", "rating")]
    return named.select(*plain, flag("rated", "rated"), flag("is_live", "is_live"), *seats, flag("black_ai", "black.is_ai"), F.col("white.result_raw").alias("white_result"))


@query(
    "SELECT * FROM (SELECT 'provider_users' AS name, (SELECT count(*) FROM users) AS rows UNION ALL SELECT 'games', (SELECT count(*) FROM after_all) UNION ALL SELECT 'user_snapshots', (SELECT count(*) FROM users) "
    "UNION ALL SELECT 'raw_payloads', (SELECT count(DISTINCT c) * 2 FROM cc0) + (SELECT count(DISTINCT c) FROM li0) + (SELECT count(*) FROM late) + (SELECT count(*) FROM users) "
    "UNION ALL SELECT 'source_records', 3 * ((SELECT count(*) FROM after_all) + (SELECT count(*) FROM late)) + 2 * (SELECT count(*) FROM users) "
    "UNION ALL SELECT 'variants', (SELECT count(DISTINCT provider || variant_raw) FROM after_all) UNION ALL SELECT 'time_controls', (SELECT count(*) FROM (SELECT DISTINCT kind, initial_seconds, increment_seconds, days, time_class, raw_label FROM after_all)) "
    "UNION ALL SELECT 'stored in batch 1', (SELECT count(DISTINCT c) * 2 FROM cc0) + (SELECT count(DISTINCT c) FROM li0) + (SELECT count(*) FROM users) UNION ALL SELECT 'stored in batch 2', (SELECT count(*) FROM late) UNION ALL SELECT 'stored in batch 3', 0 "
    "UNION ALL SELECT 'games in batch 1', (SELECT count(*) FROM after_all) UNION ALL SELECT 'games in batch 2', (SELECT count(*) FROM late) UNION ALL SELECT 'games in batch 3', 0)",
    payloads.SQL.strip(),
    _MERGED.strip(),
)
def ingest_counts(m: Model) -> DataFrame:
    """Rows of the archive's tables after three batches, and what each batch stored; the last one brings nothing new."""
    archive, done = _ingested(m)
    names = ("provider_users", "games", "user_snapshots", "raw_payloads", "source_records", "variants", "time_controls")
    rows = [(n, archive.stored(n).count()) for n in names]
    rows += [(f"{what} in batch {i}", n) for i, pair in enumerate(done, 1) for what, n in zip(("stored", "games"), pair, strict=True)]
    return m.spark.createDataFrame(rows, "name string, rows bigint")


# --- crawls -------------------------------------------------------------------------------

_CRAWL = (
    "hub AS (SELECT 'lichess' AS provider, me AS id, count(*) AS n FROM seats WHERE provider = 'lichess' GROUP BY me ORDER BY n DESC, me LIMIT 1)",
    "near AS (SELECT s.other AS id, 'customer#' || lpad(CAST(s.other AS VARCHAR), 9, '0') AS name, count(DISTINCT s.id) AS game_count, min(s.id) AS via FROM seats s JOIN hub ON hub.id = s.me WHERE s.provider = 'lichess' AND s.other <> s.me GROUP BY s.other)",
    "taken AS (SELECT * FROM near ORDER BY game_count DESC, name LIMIT 3)",
)


def _crawled(m: Model) -> tuple[Archive, dict, object]:
    """A crawl of the user with most games, one level deep, of four users at most; every fetch finds what is stored."""
    archive = _archive(m)
    hub = views.seats(m.games.where("provider = 'lichess'")).groupBy(F.col("me.user_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").first()["id"]
    users = m.users.where("provider = 'lichess'")
    none = lambda kind: F.lit(None).cast(kind)
    seat = lambda c: F.struct(F.col(f"{c}.user_id").alias("user_id"), F.col(f"{c}.username").alias("username"), none("string").alias("result_raw"), F.col(f"{c}.is_winner").alias("is_winner"), F.lit(False).alias("is_ai"), none("bigint").alias("rating"), none("bigint").alias("rating_diff"), none("bigint").alias("rd")).alias(c)
    held = m.games.where("provider = 'lichess'")
    extra = {"ply_count": "bigint", "eco": "string", "opening_name": "string", "opening_ply": "bigint", "tournament_ref": "string", "first_seen_at": "bigint"}
    games = held.select(*[c for c in held.columns if c not in ("white", "black")], *[none(k).alias(c) for c, k in extra.items()], seat("white"), seat("black"))
    archive.commit({"provider_users": users, "games": games}, check=False)
    service = Service(archive, client=None, clock=lambda: 5000)
    control = service.load()
    name = users.where(F.col("id") == hub).first()["display_username"]
    run, _ = jobs.create_crawl(control, "lichess", name, jobs.Limits(0, 4_000_000_000, 1, 4, 10_000_000, 9))
    tally = Runner(service, lambda job, params, left: Ingested(job.provider, "user_games_stream", 200, 0, 0, "stored")).run(run=run)
    return archive, service.load().runs[run], tally


@query("SELECT 'lichess' AS provider, hub.id AS from_user_id, near.id AS to_user_id, via AS via_game_id, game_count, CAST(1 AS BIGINT) AS depth FROM near, hub", *_CRAWL)
def crawl_edges(m: Model) -> DataFrame:
    archive, _, _ = _crawled(m)
    return archive.table("discovery_edges").select("provider", "from_user_id", "to_user_id", "via_game_id", "game_count", "depth")


@query(
    "SELECT 'customer#' || lpad(CAST(id AS VARCHAR), 9, '0') AS target, 'done' AS state, CAST(0 AS BIGINT) AS depth, CAST(10 AS BIGINT) AS priority, CAST(1 AS BIGINT) AS attempts, CAST(5000 AS BIGINT) AS done_at FROM hub UNION ALL SELECT name, 'done', 1, 11, 1, 5000 FROM taken",
    *_CRAWL,
)
def crawl_jobs(m: Model) -> DataFrame:
    archive, _, _ = _crawled(m)
    return archive.table("discovery_jobs").select("target", "state", "depth", "priority", "attempts", "done_at")


@query("SELECT 'done' AS status, '{\"edges\":' || (SELECT count(*) FROM near) || ',\"jobs_done\":4,\"jobs_total\":4,\"users_seen\":4}' AS counters, CAST(4 AS BIGINT) AS claimed, CAST(4 AS BIGINT) AS done, CAST(0 AS BIGINT) AS failed, CAST(5000 AS BIGINT) AS finished_at", *_CRAWL)
def crawl_run(m: Model) -> DataFrame:
    _, run, tally = _crawled(m)
    return m.spark.createDataFrame([(run.status, run.counters, tally.claimed, tally.done, tally.error + tally.skipped + tally.blocked, run.finished_at)], "status string, counters string, claimed bigint, done bigint, failed bigint, finished_at bigint")


# --- neutral signals ----------------------------------------------------------------------


@query(
    "SELECT provider, me AS user_id, count(*) AS games, round(100.0 * (count(*) FILTER (won) + count(*) FILTER (outcome = 'draw') / 2) / count(*), 2) AS score_percent FROM (SELECT s.*, CAST(1000 + floor(a.c_acctbal / 10) AS BIGINT) AS mine, CAST(1000 + floor(b.c_acctbal / 10) AS BIGINT) AS theirs FROM scored s JOIN customer a ON a.c_custkey = me JOIN customer b ON b.c_custkey = other) WHERE outcome IS NOT NULL AND theirs >= mine + 150 GROUP BY ALL"
)
def score_against_higher_rated(m: Model) -> DataFrame:
    return extras.score_against_higher(m.rated_games, 150)


@query(
    "SELECT provider, user_id, count(*) AS neighbours, count(*) FILTER (account_status IS NOT NULL) AS labelled, round(100.0 * count(*) FILTER (account_status IS NOT NULL) / count(*), 2) AS percent FROM (SELECT DISTINCT s.provider, me AS user_id, other FROM seats s WHERE me <> other) n JOIN (SELECT id, provider, account_status FROM users) u ON u.id = n.other AND u.provider = n.provider GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY n.provider, user_id").replace("SELECT provider,", "SELECT n.provider,")
)
def neighbour_labels(m: Model) -> DataFrame:
    return extras.neighbour_labels(reports.opponents_of(m.users, m.games), m.users.select("provider", F.col("id").alias("opponent_id"), "account_status"))


