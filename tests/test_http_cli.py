"""The HTTP client and the command line, without a network."""

import json

import pytest
from test_ingest import MONTH, answer, cc_game, li_game

from castleflow import cli
from castleflow.plans.runner import Service
from castleflow.sources import clients, providers
from castleflow.sources.http import Client


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def client(*answers, token=None):
    clock, asked, left = Clock(), [], list(answers)

    def transport(url, headers, timeout):
        asked.append((url, dict(headers)))
        got = left.pop(0)
        if got is TimeoutError:
            raise TimeoutError
        return got

    return Client(providers.Settings("me@example.invalid", lichess_token=token), transport=transport, sleep=clock.sleep, clock=clock), clock, asked


PROFILE, GAMES = providers.user_profile("chess.com", " Some/One "), providers.user_games("Me", 0, 86400, 5)


def test_addresses_and_keys():
    assert PROFILE.url == "https://api.chess.com/pub/player/some%2Fone" and PROFILE.source_key == "chess.com/player/some/one/profile"
    assert MONTH.url.endswith("/marigold/games/2023/05") and GAMES.source_key == "lichess/games/user/me/1970-01-01..1970-01-02-limit-5"
    assert dict(GAMES.params)["until"] == "86400000" and GAMES.accept == "application/x-ndjson"
    with pytest.raises(ValueError):
        providers.monthly_archive("x", 2024, 13)
    with pytest.raises(providers.UnknownProvider):
        providers.provider("other")


def test_backoff_doubles_and_heeds_retry_after():
    c, clock, asked = client((500, {}, b""), (503, {"Retry-After": "9"}, b""), (429, {"Retry-After": "3"}, b""), (200, {"ETag": "x", "Set-Cookie": "s"}, b"{}"))
    got = c.fetch(PROFILE, etag="old")
    assert got.status == 200 and clock.slept == [1.0, 9.0, 3.0] and got.headers == {"etag": "x"} and got.body == b"{}"
    assert [a.status_code for a in got.attempts] == [500, 503, 429, 200] and asked[0][1]["If-None-Match"] == "old"


def test_fixed_wait_timeouts_and_pace():
    c, clock, asked = client((429, {"Retry-After": "3"}, b""), TimeoutError, TimeoutError, TimeoutError, (304, {}, b""), token="secret")
    got = c.fetch(GAMES, etag="ignored")
    assert got.status == 0 and got.body is None and clock.slept == [60.0, 3.0, 6.0]
    assert asked[0][1]["Authorization"] == "Bearer secret" and "If-None-Match" not in asked[0][1] and "secret" not in repr(got.attempts)
    assert c.fetch(GAMES).attempts[0].from_cache and clock.slept[-1] == 1.5


def test_final_answers_are_not_retried():
    for status in (404, 410, 403):
        c, clock, _ = client((status, {}, b"x"))
        assert c.fetch(PROFILE).status == status and not clock.slept


class Stub:
    """Answers by source key."""

    def __init__(self, bodies):
        self.bodies = bodies

    def fetch(self, request, etag=None, last_modified=None):
        body = self.bodies.get(request.source_key)
        return answer(request, body, 200 if body is not None else 404)


@pytest.fixture
def app(spark, tmp_path, monkeypatch):
    bodies = {
        "chess.com/player/marigold/games/2023/05": {"games": [cc_game("u1"), cc_game("u2", results=("", ""))]},
        "lichess/user/marigold/profile": {"id": "marigold", "username": "Marigold"},
        "lichess/games/user/marigold/2023-05-01..2023-06-01-limit-9": json.dumps(li_game("l1")).encode(),
        "lichess/games/user/quillwort/2023-05-01..2023-06-01-limit-8": json.dumps(li_game("l1")).encode(),
    }
    monkeypatch.chdir(tmp_path)
    made = cli.App(lambda: spark, lambda archive: Service(archive, client=Stub(bodies), clock=lambda: 1_683_700_000))
    return lambda *argv: cli.run([*argv, *([] if argv[0] == "provider" else ["--archive", f"file://{tmp_path}/archive"])], made)


def test_workflow(app, capsys, tmp_path):
    assert app("query", "user", "lichess", "marigold") == 1  # nothing is made by reading
    assert app("init") == 0 and "Applied migrations: 0001_init" in capsys.readouterr().out
    assert app("provider", "list") == 0 and "lichess" in capsys.readouterr().out
    assert app("fetch", "games", "chess.com", "Marigold", "--month", "2023-05") == 0
    assert app("fetch", "user", "lichess", "Marigold") == 0 and app("fetch", "user", "lichess", "nobody") == 1
    assert app("fetch", "games", "lichess", "Marigold") == 2 and app("query", "raw", "--provider", "lichess", "--limit", "0") == 2
    capsys.readouterr()
    assert app("query", "game", "chess.com", "u1") == 0 and "outcome: white_win" in capsys.readouterr().out
    assert app("query", "game", "chess.com", "zz") == 1
    assert app("report", "opponents", "chess.com", "marigold") == 0 and "tamarind" in capsys.readouterr().out
    assert app("report", "opponents", "chess.com", "nobody") == 1
    assert app("report", "games-by-month", "--provider", "chess.com") == 0 and "2023-05" in capsys.readouterr().out
    crawl = ["crawl", "opponents", "lichess", "Marigold", "--depth", "1", "--max-users", "5", "--max-games", "9", "--max-jobs", "5", "--since", "2023-05", "--until", "2023-05"]
    assert app(*crawl) == 0 and "done 2" in capsys.readouterr().out
    assert app("jobs", "status") == 0 and app("jobs", "list") == 0 and app("jobs", "show", "1") == 0 and app("jobs", "show", "99") == 1 and app("jobs", "resume") == 0
    capsys.readouterr()
    assert app("report", "summary") == 0 and "raw payloads: 4" in capsys.readouterr().out
    games, graph = tmp_path / "out" / "games.jsonl", tmp_path / "graph.csv"
    assert app("export", "games", "--format", "jsonl", "--output", str(games)) == 0
    found = [json.loads(x) for x in games.read_text().splitlines()]
    assert len(found) == 3 and list(found[0]) == sorted(found[0]) and found[0]["rated"] == 1 and {g["outcome"] for g in found} == {"white_win", None, "black_win"}
    assert app("export", "graph", "--format", "csv", "--output", str(graph)) == 0
    capsys.readouterr()
    assert app("export", "games", "--format", "jsonl", "--folder", f"file://{tmp_path}/many") == 0 and "exported games" in capsys.readouterr().out
    assert sum(len(f.read_text().splitlines()) for f in (tmp_path / "many").glob("part-*")) == 3
    head, line = graph.read_text().splitlines()
    assert head.startswith("provider,crawl_run_id,from_username") and line.startswith("lichess,1,marigold,quillwort")
    assert app("export", "users", "--format", "jsonl", "--provider", "lichess") == 0 and '"username_normalized":"marigold"' in capsys.readouterr().out


def test_stream_takes_each_file_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from castleflow.operators.archive import Archive
    from castleflow.streaming.landing import land_stream

    archive = Archive(spark, f"file://{tmp_path}/archive")
    archive.init(providers.providers_frame(spark), 1)
    folder = tmp_path / "in"
    folder.mkdir()
    key = F.concat(F.lit("lichess/games/user/"), F.regexp_extract("path", r"([^/]+)\.ndjson$", 1), F.lit("/all"))

    def run():
        q = land_stream(archive, str(folder), f"{tmp_path}/checkpoint", provider="lichess", endpoint_type="user_games_stream", key=key, fetched_at=lambda: 5)
        q.awaitTermination()
        return archive.table("raw_payloads").count(), archive.table("games").count()

    (folder / "a.ndjson").write_text(json.dumps(li_game("g1")))
    (folder / "b.ndjson").write_text(json.dumps(li_game("g2")) + "\n" + json.dumps(li_game("g1")))
    assert run() == (2, 2) and run() == (2, 2)
    (folder / "c.ndjson").write_text(json.dumps(li_game("g3")))
    assert run() == (3, 3)


def test_clients_list_units_and_walk_them():
    asked = []

    class Books:
        def fetch(self, request, etag=None, last_modified=None):
            asked.append(request.source_key)
            return answer(request, {"archives": ["https://x.example/games/2023/05", "https://x.example/games/2023/11/"]})

    cc, li = (clients.client(k, Books()) for k in ("chess.com", "lichess"))
    assert isinstance(cc, clients.Source) and isinstance(li, clients.Source) and cc.info().key == "chess.com"
    assert [u.unit_id for u in cc.units(" Marigold ", 1, 2)] == ["2023/05", "2023/11"]
    assert len(list(cc.games("Marigold"))) == 2 and asked[-1] == "chess.com/player/marigold/games/2023/11"
    assert [u.unit_id for u in li.units("Marigold", 0, None)] == ["1970-01-01..open"]
    assert len(list(li.games("Marigold", 0, 86400, 5))) == 1 and asked[-1] == "lichess/games/user/marigold/1970-01-01..1970-01-02-limit-5"
    li.game("AbC"), li.statistics("Marigold"), cc.statistics("Marigold"), cc.profile("Marigold")
    assert asked[-4:] == ["lichess/game/AbC", "lichess/user/marigold/profile", "chess.com/player/marigold/stats", "chess.com/player/marigold/profile"]
    with pytest.raises(ValueError):
        list(li.games("Marigold"))
    with pytest.raises(NotImplementedError):
        cc.game("x")
    with pytest.raises(providers.UnknownProvider):
        clients.client("other", Books())


def test_settings_name_each_providers_pace():
    s = providers.Settings.from_env({"CASTLEFLOW_DELAY_LICHESS": "4.5", "CASTLEFLOW_RETRIES_CHESS_COM": "1", "CASTLEFLOW_CONTACT": "a@b.example"})
    assert (s.pace("lichess").apart, s.pace("lichess").penalty, s.pace("chess.com").retries, s.pace("chess.com").apart) == (4.5, 60.0, 1, 1.0)
    assert "a@b.example" in s.agent and providers.Settings().pace("lichess").apart == 1.5
