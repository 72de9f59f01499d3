"""Landing, normalization, merges: raw first, once only, by the stated policies."""

import json

import pytest
from pyspark.sql import functions as F

from castleflow.operators import ingest, merge, normalize
from castleflow.operators.archive import Archive, Invalid
from castleflow.plans import reports
from castleflow.sources import providers
from castleflow.sources.http import Answer, Attempt

NOW = 1_683_700_000


def answer(request, body, status=200, headers=None, at=NOW):
    raw = None if body is None else body if isinstance(body, bytes) else json.dumps(body).encode()
    attempt = Attempt(request.provider, request.endpoint_type, request.url, "GET", status, at, 1, headers or {})
    return Answer(request, status, at, headers or {}, raw, (attempt,))


def cc_game(uuid, white="Marigold", black="Tamarind", results=("win", "checkmated"), **more):
    game = {
        "uuid": uuid, "url": f"https://www.chess.com/game/live/{uuid}", "pgn": "1. e4", "time_control": "300+2", "end_time": 1683677100, "rated": True, "time_class": "blitz", "rules": "chess",
        "white": {"rating": 1510, "result": results[0], "username": white}, "black": {"rating": 1490, "result": results[1], "username": black},
    }
    return game | more


def li_game(gid, white="marigold", black="quillwort", **more):
    seat = lambda n: {"user": {"id": n.lower(), "name": n}, "rating": 1700, "ratingDiff": -6}
    return {"id": gid, "rated": True, "variant": "standard", "speed": "blitz", "createdAt": 1683676800000, "lastMoveAt": 1683677100000, "status": "mate", "winner": "black", "players": {"white": seat(white), "black": seat(black)}, "clock": {"initial": 300, "increment": 0}, "opening": {"eco": "C20", "name": "King's Pawn Game", "ply": 2}, "pgn": "1. e4"} | more


MONTH = providers.monthly_archive("Marigold", 2023, 5)
STREAM = providers.user_games("Marigold", None, None, 10)


def take(archive, *answers):
    stored = ingest.land(archive, ingest.landed(archive.spark, answers))
    return stored, ingest.normalize_pending(archive, NOW)


@pytest.fixture
def archive(spark, tmp_path):
    a = Archive(spark, f"file://{tmp_path}/archive")
    assert a.init(providers.providers_frame(spark), NOW) == ["0001_init"]
    assert a.init(providers.providers_frame(spark), NOW) == []
    return a


def rows(df, *order):
    return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]


def test_month_and_stream(archive):
    lines = "\n".join(["", json.dumps(li_game("sumac7")), "   ", json.dumps(li_game("live1", status="started", winner=None, lastMoveAt=None)), ""]).encode()
    month = {"games": [cc_game("u1"), cc_game("u2", rules="bughouse"), cc_game("u3", black="Marigold", results=("agreed", "agreed"))]}
    assert take(archive, answer(MONTH, month), answer(STREAM, lines)) == (2, 4)
    games = rows(archive.table("games"), "id")
    assert [(g["provider"], g["provider_game_id"], g["outcome"], g["is_live"], g["ended_at"]) for g in games] == [("chess.com", "u1", "white_win", False, 1683677100), ("chess.com", "u3", "draw", False, 1683677100), ("lichess", "sumac7", "black_win", False, 1683677100), ("lichess", "live1", None, True, None)]
    assert games[0]["white"]["rating"] == 1510 and games[0]["white"]["is_winner"] is True and games[1]["white"]["is_winner"] is None
    pointers = rows(archive.table("source_records").where("entity_type = 'game'"), "id")
    assert [p["json_pointer"] for p in pointers] == ["/games/0", "/games/2", "/0", "/1"]  # the one left out keeps its place
    assert archive.table("game_participants").count() == 8
    # the same name with two providers is two users
    assert archive.table("provider_users").where("username_normalized = 'marigold'").count() == 2
    assert {r["normalization_status"] for r in rows(archive.table("raw_payloads"), "id")} == {"parsed"}

    summary = reports.user_game_summary(archive.table("provider_users"), archive.table("games"), "lichess", " MARIGOLD ").first()
    assert (summary["games"], summary["wins"], summary["losses"], summary["draws"], summary["unfinished"]) == (2, 0, 1, 0, 1)
    against = reports.opponent_report(archive.table("provider_users"), archive.table("games"), "chess.com", "marigold").collect()
    assert [(r["opponent_username"], r["games"]) for r in against] == [("marigold", 2), ("tamarind", 1)]  # a game against oneself shows from both seats

    before = {t: rows(archive.table(t), "id") for t in ("games", "provider_users", "source_records", "variants", "time_controls")}
    assert take(archive, answer(MONTH, month), answer(STREAM, lines)) == (0, 0)
    assert before == {t: rows(archive.table(t), "id") for t in before}


def test_late_observation_updates_the_game(archive):
    take(archive, answer(STREAM, json.dumps(li_game("g1", status="started", winner=None, lastMoveAt=None)).encode()))
    later = providers.game("g1")
    take(archive, answer(later, li_game("g1", opening=None), at=NOW + 5))
    (game,) = rows(archive.table("games"), "id")
    assert (game["id"], game["outcome"], game["is_live"], game["ended_at"], game["eco"], game["first_seen_at"]) == (1, "black_win", False, 1683677100, "C20", NOW)
    assert archive.table("source_records").where("entity_type = 'game'").count() == 2


def test_profiles_stats_and_renames(archive):
    profile = {"username": "Marigold", "player_id": 70707, "title": "NM", "followers": 42, "country": "US", "joined": 1, "status": "premium"}
    stats = {"chess_blitz": {"record": {"win": 10, "loss": 5, "draw": 2}}, "chess_rapid": {"record": {"win": 3, "loss": 1, "draw": 1}}, "fide": 0}
    user, stat = providers.user_profile("chess.com", "Marigold"), providers.user_stats("Marigold")
    assert take(archive, answer(user, profile), answer(stat, stats)) == (2, 0)
    (u,) = rows(archive.table("provider_users"), "id")
    assert (u["provider_user_id"], u["username_normalized"], u["account_status"], u["title"]) == ("70707", "marigold", "premium", "NM")
    counts = [(s["followers"], s["count_all"], s["count_win"], s["count_loss"], s["count_draw"]) for s in rows(archive.table("user_snapshots"), "id")]
    assert counts == [(42, None, None, None, None), (None, 22, 13, 6, 3)]
    # same id, new name, no title: the row follows the name and keeps the title
    take(archive, answer(providers.user_profile("chess.com", "Saffron"), profile | {"username": "Saffron", "title": None}, at=NOW + 9))
    (u,) = rows(archive.table("provider_users"), "id")
    assert (u["id"], u["username_normalized"], u["title"], u["first_seen_at"], u["updated_at"]) == (1, "saffron", "NM", NOW, NOW + 9)
    # the same content again only refreshes the time
    li = {"id": "marigold", "username": "Marigold", "patron": True, "count": {"all": 100, "win": 40}, "perfs": {"blitz": {"games": 20}}}
    take(archive, answer(providers.user_profile("lichess", "marigold"), li))
    take(archive, answer(providers.user_profile("lichess", "marigold"), li | {"seenAt": 5}, at=NOW + 7))
    own = [s for s in rows(archive.table("user_snapshots"), "id") if s["patron"]]
    assert [(s["captured_at"], s["count_all"], s["count_win"], s["patron"]) for s in own] == [(NOW + 7, 100, 40, True)]


def test_unreadable_payloads_stay_pending_and_others_go_through(archive):
    odd = answer(MONTH, {"games": [cc_game("ok"), cc_game("odd", time_class="custom")]})
    broken = answer(providers.monthly_archive("Marigold", 2023, 6), b"{not json")
    empty = answer(providers.monthly_archive("Marigold", 2023, 7), {"games": []})
    good = answer(STREAM, json.dumps(li_game("fine")).encode())
    assert take(archive, odd, broken, empty, good) == (4, 1)
    status = {r["canonical_source_key"].rsplit("/", 1)[1]: r["normalization_status"] for r in rows(archive.table("raw_payloads"), "id")}
    assert status == {"05": "pending", "06": "pending", "07": "skipped", "open..open-limit-10": "parsed"}
    assert archive.table("errors").count() == 2 and archive.table("games").count() == 1


def test_attempts_errors_and_validators(archive):
    headers = {"etag": '"a"', "last-modified": "Mon"}
    gone = answer(providers.user_profile("chess.com", "gone"), None, 410)
    slow = answer(providers.user_profile("lichess", "slow"), None, 429)
    ok = answer(MONTH, {"games": []}, headers=headers)
    ingest.log_attempts(archive, [gone, slow, ok], 1, 2)
    assert [(e["error_kind"], e["is_dead"]) for e in rows(archive.table("errors"), "id")] == [("http_410", True), ("http_429", False)]
    assert [(f["status_code"], f["etag"], f["error_ref"]) for f in rows(archive.table("fetch_logs"), "id")] == [(410, None, 1), (429, None, 2), (200, '"a"', None)]
    take(archive, ok)
    (v,) = rows(ingest.latest_validators(archive.table("raw_payloads")), "canonical_source_key")
    assert (v["etag"], v["last_modified"]) == ('"a"', "Mon")


def test_commits_are_checked_and_atomic(archive, spark):
    users = archive.table("provider_users")
    bad = spark.createDataFrame([(1, "nowhere", None, "x", "x", None, None, 1, 1)], users.schema)
    version = archive.manifest()["version"]
    with pytest.raises(Invalid):
        archive.commit({"provider_users": bad})
    twice = spark.createDataFrame([(i, "lichess", None, "x", "x", None, None, 1, 1) for i in (1, 2)], users.schema)
    with pytest.raises(Invalid):
        archive.commit({"provider_users": twice})
    edge = spark.createDataFrame([(1, None, "lichess", 8, 9, None, 1, 1, "opponent", 1)], archive.table("discovery_edges").schema)
    with pytest.raises(Invalid):
        archive.commit({"discovery_edges": edge})
    assert archive.manifest()["version"] == version
    assert archive.vacuum() >= 0 and archive.summary()["providers"] == ["chess.com", "lichess"] and archive.summary()["tables"] == 16


def test_corrupted_body_is_an_error(archive):
    ingest.land(archive, ingest.landed(archive.spark, [answer(MONTH, {"games": []})]))
    raw = archive.table("raw_payloads").withColumn("raw_body", F.lit(b"x"))
    archive.commit({"raw_payloads": raw})
    with pytest.raises(ingest.Corrupt):
        ingest.normalize_pending(archive, NOW)


def test_policies_and_order(spark):
    data = [("k", 3, None, 5), ("k", 1, "a", 7), ("k", 2, "b", 6), (None, 1, "n", 1), (None, 2, None, 2)]
    df = spark.createDataFrame(data, "key string, seq int, x string, y int").select("*", *[F.col("x").alias(p) for p in merge.POLICIES[:4]])
    for parts in (1, 5):  # the order of arrival plays no part
        got = rows(merge.reduce_by(df.repartition(parts), ["key"], F.col("seq"), {"first": "first", "last": "last", "first_non_null": "first_non_null", "last_non_null": "last_non_null", "y": "min"}), "key")
        assert got == [{"key": None, "first": "n", "last": None, "first_non_null": "n", "last_non_null": "n", "y": 1}, {"key": "k", "first": "a", "last": None, "first_non_null": "a", "last_non_null": "b", "y": 5}]


def test_identities_join_over_any_token(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, ["b", "c"]), (4, ["c", "a"]), (5, [None]), (6, ["z"])], "r long, t array<string>")
    assert {r["record"]: r["entity"] for r in merge.identities(df, "r", F.col("t")).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6}


def test_records_are_parsed_once(spark):
    """Each text is parsed inside its generator; a filter or a column that parses it again shows up elsewhere in the plan."""
    raw = spark.createDataFrame([], "payload bigint, provider string, endpoint_type string, canonical_source_key string, fetched_at bigint, body string").repartition(2)
    plan = normalize.games_of(raw, unread=True)._jdf.queryExecution().optimizedPlan().toString()
    assert [("Generate" in line, line.count("from_json")) for line in plan.splitlines() if "from_json" in line] == [(True, 1)] * 3


def test_equal_sightings_are_one_row_between_two_places(spark):
    df = spark.createDataFrame([(1, 5, 1, "a", None), (2, 4, 1, "b", "x"), (3, 3, 1, "c", None)], "first long, last long, key long, name string, title string")
    got = merge.reduce_by(df, ["key"], F.col("first"), {"title": "last_non_null", "name": "last"}, F.col("last")).first()
    assert (got["name"], got["title"]) == ("a", "x")


def test_numbers_are_dense_and_ordered(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("x"))
    got = merge.number_from(df, ["x"], 5).orderBy("x").collect()
    assert [r["id"] for r in got] == list(range(5, 1005))
    assert merge.number_from(df.where("x < 0"), ["x"], 5).count() == 0


def test_payloads_are_read_by_id_and_never_rewritten(archive):
    take(archive, answer(MONTH, {"games": [cc_game("u1")]}), answer(providers.archives_index("Marigold"), {"archives": []}))
    held = ingest.read_payload(archive, 1)
    assert json.loads(held["raw_body"])["games"][0]["uuid"] == "u1" and held["normalization_status"] == "parsed" and held["normalized_at"] == NOW
    assert ingest.read_payload(archive, 2)["normalization_status"] == "skipped"
    with pytest.raises(KeyError):
        ingest.read_payload(archive, 9)
    folders = archive.manifest()["tables"]["raw_payloads"]
    take(archive, answer(STREAM, json.dumps(li_game("g1")).encode()))
    after = archive.manifest()["tables"]["raw_payloads"]
    assert after[: len(folders)] == folders and len(after) == len(folders) + 1
    archive.compact("raw_payloads")
    assert archive.table("raw_payloads").count() == 3 and len(archive.manifest()["tables"]["raw_payloads"]) == 1
