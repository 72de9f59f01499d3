"""Payloads to rows: typed parsing of landed JSON into staged games, seats, users and snapshots.

Schemas are explicit, so that types never change from run to run; fields that are not named are
ignored here and stay in the raw bytes. Numbers are read as text first: a field of the wrong
type becomes null instead of making the record unreadable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castleflow.functions import codes

_CC_SEAT = "struct<username: string, rating: string, result: string>"
CHESSCOM_GAME = f"struct<uuid: string, url: string, pgn: string, time_control: string, end_time: string, start_time: string, rated: string, time_class: string, rules: string, eco: string, white: {_CC_SEAT}, black: {_CC_SEAT}>"
_LI_SEAT = "struct<user: struct<id: string, name: string>, rating: string, ratingDiff: string, aiLevel: string>"
LICHESS_GAME = (
    f"struct<id: string, rated: string, variant: string, speed: string, perf: string, createdAt: string, lastMoveAt: string, status: string, winner: string, url: string, "
    f"players: struct<white: {_LI_SEAT}, black: {_LI_SEAT}>, clock: struct<initial: string, increment: string>, opening: struct<eco: string, name: string, ply: string>, pgn: string>"
)
CHESSCOM_USER = "struct<username: string, player_id: string, title: string, followers: string, country: string, joined: string, last_online: string, status: string, closed: string, is_verified: string>"
LICHESS_USER = "struct<id: string, username: string, title: string, createdAt: string, seenAt: string, patron: string, tosViolation: string, profile: struct<country: string>, count: struct<all: string, rated: string, win: string, loss: string, draw: string>, perfs: string>"


def explode_records(payloads: DataFrame, body: str, field: str, schema: str, pointer: str) -> DataFrame:
    """One row for each record of the array ``field``, with its position and JSON pointer; a missing array has none."""
    parsed = F.from_json(F.col(body), f"{field} array<{schema}>")
    rest = [c for c in payloads.columns if c != body]
    rows = payloads.select(*rest, F.posexplode(parsed[field]).alias("position", "record"))
    return rows.withColumn("json_pointer", F.concat(F.lit(pointer), F.col("position").cast("string")))


def explode_lines(payloads: DataFrame, body: str, schema: str) -> DataFrame:
    """One row for each line that isn't blank; positions count these lines. A line that is no JSON gives a null record."""
    lines = F.filter(F.split(F.col(body), r"\r\n|\r|\n"), lambda x: x.rlike(r"\S"))
    rest = [c for c in payloads.columns if c != body]
    # parsed inside the generator: filters on a record's fields would each parse its line again
    rows = payloads.select(*rest, F.posexplode(F.transform(lines, lambda x: F.from_json(x, schema))).alias("position", "record"))
    return rows.select(*rest, "position", "record", F.concat(F.lit("/"), F.col("position").cast("string")).alias("json_pointer"))


def fold_stats(body: Column) -> Column:
    """struct(count_win, count_loss, count_draw, count_all) over all entries that hold a record; 0 becomes null."""
    # entries are read one by one: what is no object has no record
    entries = F.transform(F.map_values(F.from_json(body, "map<string, string>")), lambda e: F.from_json(e, "struct<record: struct<win: bigint, loss: bigint, draw: bigint>>"))
    total = lambda part: F.aggregate(entries, F.lit(0).cast("bigint"), lambda a, e: a + F.coalesce(e["record"][part], F.lit(0).cast("bigint")))
    none_if_0 = lambda c: F.nullif(c, F.lit(0).cast("bigint"))
    win, loss, draw = total("win"), total("loss"), total("draw")
    return F.struct(none_if_0(win).alias("count_win"), none_if_0(loss).alias("count_loss"), none_if_0(draw).alias("count_draw"), none_if_0(win + loss + draw).alias("count_all"))


# --- games --------------------------------------------------------------------------------


def _number(text: Column) -> Column:
    """JSON as it was: whole numbers stay numbers in a hash."""
    return codes.int_or_null(text)


def _seat(color: str, user_id: Column, name: Column, display: Column, result: Column, ai: Column, rating: Column, diff: Column, outcome: Column) -> Column:
    return F.struct(
        user_id.alias("provider_user_id"), name.alias("username"), display.alias("display"), result.alias("result_raw"), codes.is_winner(F.lit(color), outcome).alias("is_winner"),
        ai.alias("is_ai"), codes.int_or_null(rating).alias("rating"), codes.int_or_null(diff).alias("rating_diff"), F.lit(None).cast("bigint").alias("rd"),
    ).alias(color)


def _truth(text: Column) -> Column:
    return F.coalesce(~F.lower(text).isin("false", "0", "", "null"), F.lit(False))


def chesscom_games(rows: DataFrame) -> DataFrame:
    """Staged games of rows with ``record``; other columns are kept."""
    g = F.col("record")
    text = lambda name: codes.text_or_null(g[name])
    result = lambda c: codes.text_or_null(g[c]["result"])
    # what several columns need is computed once, in a projection of its own
    rows = rows.withColumns({"_outcome": codes.outcome_of_seats(result("white"), result("black")), "_class": codes.time_class(F.coalesce(text("time_class"), F.lit("rapid")))})
    o, klass = F.col("_outcome"), F.col("_class")
    native = F.coalesce(text("rules"), F.lit("chess"))
    flag = F.when(g["rated"].isNotNull(), _truth(g["rated"]))
    hashed = lambda c: F.struct(_number(g[c]["rating"]).alias("rating"), g[c]["result"].alias("result"), g[c]["username"].alias("username"))
    content = codes.canonical_hash(
        provider=F.lit("chess.com"), uuid=g["uuid"], url=g["url"], end_time=_number(g["end_time"]), rated=flag, rules=g["rules"], time_control=g["time_control"], white=hashed("white"), black=hashed("black"), pgn=g["pgn"]
    )
    none = F.lit(None).cast("string")
    seat = lambda c: _seat(c, none, codes.username(g[c]["username"]), codes.text_or_null(g[c]["username"]), result(c), F.lit(False), g[c]["rating"], none, o["outcome"])
    return _staged(
        rows, "chess.com", text("uuid"), text("url"), content, native, F.coalesce(text("time_control"), klass), klass, g["rated"], o,
        F.concat(F.lit("white:"), F.coalesce(result("white"), F.lit("")), F.lit(";black:"), F.coalesce(result("black"), F.lit(""))),
        codes.int_or_null(g["start_time"]), codes.int_or_null(g["end_time"]), text("eco"), none, F.lit(None).cast("bigint"), seat("white"), seat("black"),
    )


def lichess_games(rows: DataFrame) -> DataFrame:
    g = F.col("record")
    text = lambda name: codes.text_or_null(g[name])
    winner = text("winner")
    rows = rows.withColumns({"_outcome": codes.outcome_of_status(winner, text("status")), "_speed": F.coalesce(text("speed"), text("perf"), F.lit("rapid"))})
    o, speed = F.col("_outcome"), F.col("_speed")
    native = F.coalesce(text("variant"), F.lit("standard"))
    label = codes.clock_label(codes.int_or_null(g["clock"]["initial"]), codes.int_or_null(g["clock"]["increment"]), speed)
    player = lambda c: g["players"][c]
    hashed = lambda c: F.struct(player(c)["user"]["id"].alias("id"), player(c)["user"]["name"].alias("name"), _number(player(c)["rating"]).alias("rating"), _number(player(c)["ratingDiff"]).alias("ratingDiff")).alias(c)
    content = codes.canonical_hash(
        provider=F.lit("lichess"), id=g["id"], rated=F.when(g["rated"].isNotNull(), _truth(g["rated"])), variant=g["variant"], speed=g["speed"], createdAt=_number(g["createdAt"]), lastMoveAt=_number(g["lastMoveAt"]),
        status=g["status"], winner=g["winner"], players=F.struct(hashed("black"), hashed("white")), pgn=g["pgn"],
    )

    def seat(c: str) -> Column:
        user = player(c)["user"]
        name = F.coalesce(codes.text_or_null(user["name"]), codes.text_or_null(user["id"]))
        result = F.when(winner == c, "win").when(winner.isin("white", "black"), "loss")
        return _seat(c, codes.text_or_null(user["id"]), codes.username(F.coalesce(codes.text_or_null(user["id"]), name)), name, result, player(c)["aiLevel"].isNotNull(), player(c)["rating"], player(c)["ratingDiff"], o["outcome"])

    url = F.coalesce(text("url"), F.concat(F.lit("https://lichess.org/"), text("id")))
    return _staged(
        rows, "lichess", text("id"), url, content, native, label, codes.time_class(speed), g["rated"], o, text("status"), codes.ms_to_s(codes.int_or_null(g["createdAt"])), codes.ms_to_s(codes.int_or_null(g["lastMoveAt"])),
        g["opening"]["eco"], g["opening"]["name"], codes.int_or_null(g["opening"]["ply"]), seat("white"), seat("black"),
    )


def _staged(rows, provider, game_id, url, content, native, label, klass, rated, o, status, created, ended, eco, opening, ply, white, black) -> DataFrame:
    rest = [c for c in rows.columns if c not in ("record", "provider", "_outcome", "_class", "_speed")]
    parsed = rows.where("record is not null or unread" if "unread" in rest else "record is not null").select(
        *rest, F.lit(provider).alias("provider"), game_id.alias("provider_game_id"), url.alias("canonical_url"), content.alias("content_hash"), native.alias("variant_raw"), label.alias("_label"), klass.alias("_class"),
        _truth(rated).alias("rated"), o["outcome"].alias("outcome"), o["is_live"].alias("is_live"), status.alias("status_raw"), created.alias("created_at"), ended.alias("ended_at"),
        F.lit(None).cast("bigint").alias("ply_count"), eco.alias("eco"), opening.alias("opening_name"), ply.alias("opening_ply"), F.lit(None).cast("string").alias("tournament_ref"), white, black,
    )
    named = parsed.withColumns({"_variant": codes.variant(F.lit(provider), F.col("variant_raw")), "control": codes.time_control(F.col("_label"), F.col("_class"))})
    staged = named.withColumns({"variant": F.col("_variant.canonical"), "mapped": F.col("_variant.mapped")}).drop("_variant", "_label", "_class")
    # after the positions are given: later games keep theirs
    return staged.where("variant != 'bughouse' or unread" if "unread" in rest else "variant != 'bughouse'")


def games_of(raw: DataFrame, *, unread: bool = False) -> DataFrame:
    """Staged games of all game payloads in ``raw`` (id, provider, endpoint_type, body as text, ...).

    With ``unread``, a column of that name marks lines of a stream that are no game with an id; all of them are rows.
    """
    month = raw.where("provider = 'chess.com' and endpoint_type = 'monthly_archive'")
    stream = raw.where("provider = 'lichess' and endpoint_type = 'user_games_stream'")
    single = raw.where("provider = 'lichess' and endpoint_type = 'game'")
    one = single.select(*[c for c in raw.columns if c != "body"], F.posexplode(F.array(F.from_json("body", LICHESS_GAME))).alias("position", "record"), F.lit("/0").alias("json_pointer"))
    months, lines = explode_records(month, "body", "games", CHESSCOM_GAME, "/games/"), explode_lines(stream, "body", LICHESS_GAME)
    if unread:
        months, lines, one = months.withColumn("unread", F.lit(False)), lines.withColumn("unread", F.col("record.id").isNull()), one.withColumn("unread", F.lit(False))
    return chesscom_games(months).unionByName(lichess_games(lines)).unionByName(lichess_games(one))


def valid_controls(staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(games with a known time class, the others). An unknown class is put aside, never dropped in silence."""
    known = F.col("control.time_class").isin(*codes.TIME_CLASSES)
    return staged.where(known), staged.where(~F.coalesce(known, F.lit(False)))


# --- users --------------------------------------------------------------------------------


def users_of(raw: DataFrame) -> DataFrame:
    """Staged users with their snapshot, of profile and stats payloads."""
    return _chesscom_users(raw).unionByName(_lichess_users(raw)).unionByName(_chesscom_stats(raw))


_COUNTS = ("count_all", "count_rated", "count_win", "count_loss", "count_draw")


def _user(rows: DataFrame, provider: str, user_id: Column, display: Column, status: Column, title: Column, **snapshot: Column) -> DataFrame:
    rest = [c for c in rows.columns if c not in ("record", "body", "provider")]
    none = {c: F.lit(None).cast("bigint") for c in ("followers", *_COUNTS)} | {"country": F.lit(None).cast("string"), "patron": F.lit(None).cast("boolean")}
    held = none | snapshot
    return rows.select(
        *rest, F.lit(provider).alias("provider"), user_id.alias("provider_user_id"), F.coalesce(codes.username(display), F.lit("")).alias("username_normalized"), display.alias("display_username"), status.alias("account_status"), title.alias("title"),
        *[held[c].alias(c) for c in sorted(held)],
    )


def _chesscom_users(raw: DataFrame) -> DataFrame:
    rows = raw.where("provider = 'chess.com' and endpoint_type = 'user_profile'").withColumn("record", F.from_json("body", CHESSCOM_USER)).where("record is not null")
    r = F.col("record")
    name = F.coalesce(r["username"], F.lit(""))
    status = codes.closed_status(r["status"], r["closed"])
    payload = {"kind": F.lit("profile"), "username": name, "status": status, "title": r["title"], "country": r["country"], "followers": _number(r["followers"]), "created_at": codes.int_or_null(r["joined"])}
    body = F.to_json(F.struct(*[payload[k].alias(k) for k in sorted(payload)]), {"ignoreNullFields": "false"})
    return _user(rows, "chess.com", r["player_id"], name, status, r["title"], country=r["country"], followers=codes.int_or_null(r["followers"]), perfs_or_stats=body, content_hash=codes.canonical_hash(**payload))


def _lichess_users(raw: DataFrame) -> DataFrame:
    rows = raw.where("provider = 'lichess' and endpoint_type = 'user_profile'").withColumn("record", F.from_json("body", LICHESS_USER)).where("record is not null")
    r = F.col("record")
    name = F.coalesce(codes.text_or_null(r["username"]), r["id"], F.lit(""))
    status = F.when(_truth(r["tosViolation"]), "tosViolation")
    patron = F.when(r["patron"].isNotNull(), _truth(r["patron"]))
    count = {c: codes.int_or_null(r["count"][c.removeprefix("count_")]) for c in _COUNTS}
    perfs = F.coalesce(r["perfs"], F.lit("{}"))
    counted = F.struct(*[count[c].alias(c.removeprefix("count_")) for c in sorted(_COUNTS)])
    content = codes.canonical_hash(kind=F.lit("profile"), username=name, status=status, title=r["title"], country=r["profile"]["country"], patron=patron, count=counted, perfs=perfs)
    user_id = F.coalesce(codes.text_or_null(r["id"]), codes.username(name), F.lit(""))
    return _user(rows, "lichess", user_id, name, status, r["title"], country=r["profile"]["country"], patron=patron, perfs_or_stats=F.concat(F.lit('{"perfs":'), perfs, F.lit("}")), content_hash=content, **count)


def _chesscom_stats(raw: DataFrame) -> DataFrame:
    rows = raw.where("provider = 'chess.com' and endpoint_type = 'user_stats'")
    name = codes.username_of_key(F.col("canonical_source_key"))
    fold = fold_stats(F.col("body"))
    # any JSON has one canonical text as a variant: keys in order, no spaces
    stats = F.to_json(F.parse_json("body"))
    content = codes.sha(F.concat(F.lit('{"kind":"stats","stats":'), stats, F.lit(',"username":'), F.to_json(F.array(name)).substr(F.lit(2), F.length(F.to_json(F.array(name))) - 2), F.lit("}")))
    none = F.lit(None).cast("string")
    return _user(
        rows, "chess.com", none, name, none, none, perfs_or_stats=stats, content_hash=content, count_all=fold["count_all"], count_rated=fold["count_all"], count_win=fold["count_win"], count_loss=fold["count_loss"], count_draw=fold["count_draw"]
    )
