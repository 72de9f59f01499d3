"""Crawls and the job control table."""

import pytest
from pyspark.sql import functions as F

from castleflow.operators.archive import Archive
from castleflow.plans import graph, jobs
from castleflow.plans.runner import Ingested, Runner, Service, months
from castleflow.schemas import TABLES
from castleflow.sources import providers

NAMES = "abcde"


def neighbours(spark, links):
    rows = [("lichess", NAMES.index(a), NAMES.index(b), b, 10 * NAMES.index(a) + i, n) for a, found in links.items() for i, (b, n) in enumerate(found)]
    return spark.createDataFrame(rows, "provider string, user_id long, opponent_id long, opponent_username string, via_game_id long, game_count long")


def crawl(spark, links, **bounds):
    seeds = spark.createDataFrame([("lichess", 0)], "provider string, user_id long")
    edges, visited = graph.crawl(neighbours(spark, links), seeds, graph.Bounds(**bounds))
    e = sorted((NAMES[r["from_user_id"]], NAMES[r["to_user_id"]], r["depth"]) for r in edges.collect())
    return e, {NAMES[r["user_id"]]: r["depth"] for r in visited.collect()}


LINKS = {"a": [("b", 2), ("c", 1)], "b": [("a", 2)], "c": [("a", 1), ("d", 1)], "d": [("c", 1)]}


def test_levels(spark):
    assert crawl(spark, LINKS, depth=2) == ([("a", "b", 1), ("a", "c", 1), ("c", "d", 2)], {"a": 0, "b": 1, "c": 1, "d": 2})
    assert crawl(spark, LINKS, depth=0) == ([], {"a": 0})
    assert crawl(spark, {"e": [("a", 1)]}, depth=3) == ([], {"a": 0})


def test_edges_beyond_a_cap_are_recorded(spark):
    edges, visited = crawl(spark, {"a": [("b", 1), ("c", 5), ("d", 1)], "c": [("e", 1), ("b", 1)]}, depth=2, max_users=2)
    assert visited == {"a": 0, "c": 1} and edges == [("a", "b", 1), ("a", "c", 1), ("a", "d", 1), ("c", "b", 2), ("c", "e", 2)]


def test_bounds_are_checked():
    with pytest.raises(ValueError):
        graph.Bounds(-1)
    with pytest.raises(ValueError):
        graph.Bounds(1, max_users=0)


def test_reach_and_components(spark):
    n = neighbours(spark, LINKS | {"e": [("e", 1)]})
    seeds = spark.createDataFrame([("lichess", 3)], "provider string, user_id long")
    assert {NAMES[r["user_id"]]: r["depth"] for r in graph.reachable(n, seeds).collect()} == {"d": 0, "c": 1, "a": 2, "b": 3}
    assert {NAMES[r["user_id"]]: NAMES[r["component"]] for r in graph.components(n).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e"}


def test_control_table():
    c = jobs.Control(clock=lambda: 100)
    one, new = c.enqueue("lichess", "fetch_user_games", " Me ", params={"b": 1, "a": 2})
    assert new and c.enqueue("lichess", "fetch_user_games", "me", params={"a": 2, "b": 1}) == (one, False)
    two, _ = c.enqueue("lichess", "fetch_game_by_id", "AbC", priority=5)
    assert c.enqueue("lichess", "fetch_game_by_id", "abc")[1]  # ids mind the case
    assert c.claim().id == two and c.jobs[two].attempts == 1
    c.mark(two, "blocked", "wait")
    assert not c.enqueue("lichess", "fetch_game_by_id", "AbC")[1]  # a blocked job is live
    assert c.unblock() == 1 and c.jobs[two].reason == "wait"
    c.claim()
    assert c.resume_stale(stale_seconds=50) == 0 and c.resume_stale() == 1
    c.mark(two, "done")
    assert c.jobs[two].done_at == 100 and c.enqueue("lichess", "fetch_game_by_id", "AbC")[1]  # an ended one is not
    for kind, provider in (("fetch_user_stats", "lichess"), ("fetch_game_by_id", "chess.com"), ("other", "lichess")):
        with pytest.raises(ValueError):
            c.enqueue(provider, kind, "x")
    for bad in ({"depth": -1}, {"users": 0}, {"games": 0}, {"jobs": 0}, {"since": 9}):
        with pytest.raises(ValueError):
            jobs.Limits(**({"since": 1, "until": 2, "depth": 1, "users": 1, "games": 1, "jobs": 1} | bad))


def test_months():
    assert months(1701388800, 1706745600) == [(2023, 12), (2024, 1)] and months(1701388800, 1701388801) == [(2023, 12)]


LINKED = {"a": ["b", "c"], "c": ["d"]}


@pytest.fixture
def service(spark, tmp_path):
    a = Archive(spark, f"file://{tmp_path}/archive")
    a.init(providers.providers_frame(spark), 1)
    spec = spark.createDataFrame([(1, "standard", "lichess", "standard", True)], TABLES["variants"].schema)
    control = spark.createDataFrame([(1, "clock", 300, 0, None, "blitz", "300+0")], TABLES["time_controls"].schema)
    users = spark.createDataFrame([(i, "lichess", n, n, n, None, None, 1, 1) for i, n in enumerate(NAMES, 1)], TABLES["provider_users"].schema)
    games = []
    for me, found in LINKED.items():
        for other in found:
            seat = lambda n: (NAMES.index(n) + 1, n, None, None, False, None, None, None)
            games.append((len(games) + 1, "lichess", f"g{len(games)}", None, f"h{len(games)}", 1, 1, True, "white_win", False, "mate", 1, 1683676800, None, None, None, None, None, 1, seat(me), seat(other)))
    a.commit({"variants": spec, "time_controls": control, "provider_users": users, "games": spark.createDataFrame(games, TABLES["games"].schema)})
    return Service(a, client=None, clock=lambda: 1000)


def start(service, **caps):
    held = service.load()
    run, _ = jobs.create_crawl(held, "lichess", "A", jobs.Limits(1683676800 - 86400, 1683676800 + 86400, **({"depth": 2, "users": 9, "games": 99, "jobs": 99} | caps)))
    return run


def fetched(order):
    def fetch(job, params, left):
        order.append(job.target)
        return Ingested(job.provider, "user_games_stream", 404 if job.target == "b" else 200, 0, 0, "ok")

    return fetch


def test_runner_walks_breadth_first(service):
    order = []
    run = start(service)
    tally = Runner(service, fetched(order)).run(run=run, max_jobs=2)
    assert (tally.claimed, service.load().runs[run].status) == (2, "running")
    Runner(service, fetched(order)).run(run=run)
    assert order == ["a", "b", "c", "d"]
    edges = service.archive.table("discovery_edges").orderBy("id").collect()
    assert [(NAMES[e["from_user_id"] - 1], NAMES[e["to_user_id"] - 1], e["depth"]) for e in edges] == [("a", "b", 1), ("a", "c", 1), ("c", "d", 2)]
    held = service.load()
    assert [j.state for j in held.jobs.values()] == ["done", "skipped", "done", "done"] and held.runs[run].status == "done" and held.runs[run].finished_at == 1000


def test_caps_and_failures(service):
    order = []
    run = start(service, games=1, depth=1)
    Runner(service, fetched(order)).run(run=run)
    # two games of the root are stored already, so that the cap holds from the start
    assert order == [] and [j.state for j in service.load().jobs.values()] == ["skipped"]

    def broken(job, params, left):
        raise RuntimeError("boom")

    run = start(service, users=2)
    tally = Runner(service, broken).run(run=run)
    assert tally.error == 1 and service.load().runs[run].status == "failed"
    assert service.archive.table("errors").where(F.col("message") == "boom").count() == 1
