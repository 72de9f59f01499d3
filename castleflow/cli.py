"""Command line over an archive folder. Reading verbs want an archive that exists; writing verbs make one.

Exit codes: 0 done, 1 not found or fetch failed, 2 wrong arguments, 4 stopped with open work, 5 ended with errors.
"""

from __future__ import annotations

import argparse
import datetime as dt
import re
import sys
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castleflow import __version__
from castleflow.operators import export
from castleflow.operators.archive import Archive
from castleflow.plans import jobs as control
from castleflow.plans import reports
from castleflow.plans.runner import Runner, Service
from castleflow.sources import providers

KEYS = tuple(sorted(providers.PROVIDERS))
DEFAULT = "castleflow-archive"


class Usage(Exception):
    """Arguments that parse, but make no sense."""


def bound(text: str, *, until: bool = False) -> int:
    """Epoch seconds of YYYY-MM-DD, or of YYYY-MM: its first day, as an upper bound that of the next month."""
    if m := re.fullmatch(r"(\d{4})-(\d{2})", text):
        year, month = int(m[1]), int(m[2])
        if until:
            year, month = year + month // 12, month % 12 + 1
        text = f"{year:04d}-{month:02d}-01"
    try:
        return int(dt.datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=dt.UTC).timestamp())
    except ValueError as e:
        raise Usage(f"not a date: {text}") from e


def month(text: str) -> tuple[int, int]:
    m = re.fullmatch(r"(\d{4})-(\d{2})", text)
    if not m or not 1 <= int(m[2]) <= 12:
        raise Usage(f"not a month: {text}")
    return int(m[1]), int(m[2])


def positive(value: int | None, name: str) -> int:
    if value is None or value <= 0:
        raise Usage(f"{name} must be a positive number")
    return value


class App:
    """What the verbs need: a session, made when first used, and a service over the archive."""

    def __init__(self, session: Callable[[], SparkSession], service: Callable[[Archive], Service] = Service) -> None:
        self._session, self._service = session, service

    def archive(self, args: argparse.Namespace, *, make: bool = False) -> Archive:
        held = Archive(self._session(), args.archive)
        if make:
            held.init(providers.providers_frame(held.spark), int(time.time()))
        elif not held.exists():
            raise FileNotFoundError(f"{args.archive} holds no archive; `init` makes one")
        return held

    def service(self, args: argparse.Namespace) -> Service:
        return self._service(self.archive(args, make=True))


def _show(df: DataFrame) -> int:
    rows = [tuple(r) for r in df.collect()]
    print(export.text_table([c.upper() for c in df.columns], rows))
    return len(rows)


def _one(df: DataFrame, missing: str) -> int:
    row = df.first()
    if row is None:
        print(missing, file=sys.stderr)
        return 1
    for name, value in row.asDict().items():
        print(f"{name}: {'' if value is None else value}")
    return 0


# verbs ------------------------------------------------------------------------------------


def init(app: App, args: argparse.Namespace) -> int:
    held = Archive(app._session(), args.archive)
    applied = held.init(providers.providers_frame(held.spark), int(time.time()))
    s = held.summary()
    print(f"Archive: {args.archive}\nSchema version: {s['schema_version']}\nApplied migrations: {', '.join(applied) or 'none'}\nProviders: {', '.join(s['providers'])}")
    return 0


def provider_list(app: App, args: argparse.Namespace) -> int:
    rows = [(p.key, p.base_url, "game or window" if p.single_games else "month", "validators" if p.pace.validators else "body hash", f"{p.pace.apart:g} s", "as asked" if p.pace.penalty is None else f"{p.pace.penalty:g} s") for p in providers.PROVIDERS.values()]
    print(export.text_table(["PROVIDER", "ADDRESS", "FETCHED BY", "UNCHANGED BY", "APART", "WAIT AFTER 429"], rows))
    return 0


def db_info(app: App, args: argparse.Namespace) -> int:
    s = app.archive(args).summary()
    print(f"Archive: {args.archive}\nSchema version: {s['schema_version']}\nTables: {s['tables']}\nProviders: {', '.join(s['providers'])}")
    return 0


def _fetch(request: Callable[[argparse.Namespace], providers.Request]):
    def verb(app: App, args: argparse.Namespace) -> int:
        wanted = request(args)
        got = app.service(args).fetch(wanted)
        print(f"{got.provider} {got.endpoint_type}: HTTP {got.status}; {got.message}")
        return 0 if got.status in (200, 304) else 1

    return verb


def _games_request(args: argparse.Namespace) -> providers.Request:
    if args.provider == "chess.com":
        if not args.month:
            raise Usage("chess.com games need --month YYYY-MM")
        return providers.monthly_archive(args.username, *month(args.month))
    if not (args.since and args.until and args.limit):
        raise Usage("lichess games need --since, --until and --limit")
    return providers.user_games(args.username, bound(args.since), bound(args.until, until=True), positive(args.limit, "--limit"))


def query_user(app: App, args: argparse.Namespace) -> int:
    a = app.archive(args)
    return _one(reports.user_lookup(a.table("provider_users"), a.table("games"), a.table("user_snapshots"), args.provider, args.username), f"User not found: {args.provider}/{args.username}")


def query_game(app: App, args: argparse.Namespace) -> int:
    a = app.archive(args)
    return _one(reports.game_lookup(a.table("games"), a.table("variants"), a.table("time_controls"), args.provider, args.game_id), f"Game not found: {args.provider}/{args.game_id}")


def query_raw(app: App, args: argparse.Namespace) -> int:
    _show(reports.raw_recent(app.archive(args).table("raw_payloads"), args.provider, positive(args.limit, "--limit")))
    return 0


def crawl_opponents(app: App, args: argparse.Namespace) -> int:
    since, until = bound(args.since), bound(args.until, until=True)
    service = app.service(args)
    held = service.load()
    try:
        run, _ = control.create_crawl(held, args.provider, args.username, control.Limits(since, until, args.depth, args.max_users, args.max_games, args.max_jobs))
    except ValueError as e:
        raise Usage(str(e)) from e
    tally = Runner(service).run(run=run)
    ended = service.load().runs[run]
    print(f"run {run}: {ended.status}; claimed {tally.claimed}, done {tally.done}, skipped {tally.skipped}, blocked {tally.blocked}, errors {tally.error}")
    return {"done": 0, "failed": 5}.get(ended.status, 4)


def jobs_status(app: App, args: argparse.Namespace) -> int:
    a = app.archive(args)
    held = a.table("discovery_jobs") if args.run is None else a.table("discovery_jobs").where(F.col("crawl_run_id") == args.run)
    _show(reports.counts_by(held, "depth", "kind", "state"))
    runs = a.table("crawl_runs") if args.run is None else a.table("crawl_runs").where(F.col("id") == args.run)
    _show(runs.select("id", "provider", "seed_spec", "status", "counters").orderBy("id"))
    return 0


def jobs_list(app: App, args: argparse.Namespace) -> int:
    _show(control.list_jobs(app.archive(args).table("discovery_jobs"), positive(args.limit, "--limit")))
    return 0


def jobs_show(app: App, args: argparse.Namespace) -> int:
    return _one(app.archive(args).table("discovery_jobs").where(F.col("id") == args.job_id), f"Job not found: {args.job_id}")


def jobs_resume(app: App, args: argparse.Namespace) -> int:
    if args.max_jobs is not None:
        positive(args.max_jobs, "--max-jobs")
    app.archive(args)
    service = app.service(args)
    t = Runner(service).run(run=args.run, max_jobs=args.max_jobs, resume_stale=True, unblock=True)
    print(f"resumed {t.stale_resumed}, unblocked {t.unblocked}; claimed {t.claimed}, done {t.done}, skipped {t.skipped}, blocked {t.blocked}, errors {t.error}")
    states = [j.state for j in service.load().jobs.values() if args.run is None or j.crawl_run_id == args.run]
    return 5 if t.error else 4 if {"pending", "in_progress", "blocked"} & set(states) else 0


def report_summary(app: App, args: argparse.Namespace) -> int:
    a = app.archive(args)
    _show(reports.provider_summary(a.table("providers"), a.table("provider_users"), a.table("games")))
    print(f"raw payloads: {a.table('raw_payloads').count()}")
    _show(reports.counts_by(a.table("crawl_runs"), "status"))
    _show(reports.counts_by(a.table("discovery_jobs"), "state"))
    return 0


def report_user(app: App, args: argparse.Namespace) -> int:
    a = app.archive(args)
    return _one(reports.user_game_summary(a.table("provider_users"), a.table("games"), args.provider, args.username), f"User not found: {args.provider}/{args.username}")


def report_opponents(app: App, args: argparse.Namespace) -> int:
    a = app.archive(args)
    users = a.table("provider_users")
    if reports._user(users, args.provider, args.username).isEmpty():
        print(f"User not found: {args.provider}/{args.username}", file=sys.stderr)
        return 1
    _show(reports.opponent_report(users, a.table("games"), args.provider, args.username))
    return 0


def report_months(app: App, args: argparse.Namespace) -> int:
    _show(reports.games_by_month(app.archive(args).table("games"), args.provider))
    return 0


def _export(kind: str, frame: Callable[[Archive, str | None], DataFrame]):
    def verb(app: App, args: argparse.Namespace) -> int:
        if args.folder:
            export.write_folder(frame(app.archive(args), args.provider), args.folder, args.format)
            print(f"exported {kind} to {args.folder}")
            return 0
        n = export.write_file(frame(app.archive(args), args.provider), args.output, args.format)
        if args.output:
            print(f"exported {n} {kind} to {args.output}")
        return 0

    return verb


EXPORTS = {
    "games": ("jsonl", lambda a, p: reports.export_games(a.table("games"), a.table("variants"), a.table("time_controls"), p)),
    "users": ("jsonl", lambda a, p: reports.export_users(a.table("provider_users"), p)),
    "graph": ("csv", lambda a, p: reports.export_graph(a.table("discovery_edges"), a.table("provider_users"), p)),
}

# arguments --------------------------------------------------------------------------------


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="castleflow", description="A local archive of public chess games.")
    top.add_argument("--version", action="version", version=f"castleflow {__version__}")
    groups = top.add_subparsers(dest="group", required=True)

    def verb(parent, name: str, run: Callable[[App, argparse.Namespace], int], about: str, *options: tuple, archive: bool = True) -> None:
        p = parent.add_parser(name, help=about)
        for flags, kw in options:
            p.add_argument(*flags, **kw)
        if archive:
            p.add_argument("--archive", default=DEFAULT, help="archive folder")
        p.set_defaults(run_verb=run)

    def group(name: str, about: str):
        return groups.add_parser(name, help=about).add_subparsers(dest="verb", required=True)

    opt = lambda *flags, **kw: (flags, kw)
    any_provider, username = opt("provider", choices=KEYS), opt("username")
    first_only = opt("provider", choices=("chess.com",))

    verb(groups, "init", init, "make or migrate an archive")
    verb(group("provider", "the providers"), "list", provider_list, "list providers", archive=False)
    verb(group("db", "the archive itself"), "info", db_info, "schema and providers")
    g = group("fetch", "fetch public data")
    verb(g, "user", _fetch(lambda a: providers.user_profile(a.provider, a.username)), "a profile", any_provider, username)
    verb(g, "stats", _fetch(lambda a: providers.user_stats(a.username)), "public stats", first_only, username)
    verb(g, "archives", _fetch(lambda a: providers.archives_index(a.username)), "the index of months", first_only, username)
    verb(g, "games", _fetch(_games_request), "bounded games", any_provider, username, opt("--month"), opt("--since"), opt("--until"), opt("--limit", type=int))
    g = group("query", "look things up")
    verb(g, "user", query_user, "one user", any_provider, username)
    verb(g, "game", query_game, "one game by id, address or hash", any_provider, opt("game_id"))
    verb(g, "raw", query_raw, "latest raw payloads", opt("--provider", choices=KEYS, required=True), opt("--limit", type=int, default=10))
    need = {"required": True}
    verb(group("crawl", "bounded discovery"), "opponents", crawl_opponents, "crawl opponents", any_provider, username, *[opt(f, type=int, **need) for f in ("--depth", "--max-users", "--max-games", "--max-jobs")], opt("--since", **need), opt("--until", **need))
    g = group("jobs", "jobs and runs")
    run = opt("--run", type=int)
    verb(g, "status", jobs_status, "counts", run)
    verb(g, "list", jobs_list, "jobs by id", opt("--limit", type=int, default=100))
    verb(g, "show", jobs_show, "one job", opt("job_id", type=int))
    verb(g, "resume", jobs_resume, "go on", run, opt("--max-jobs", type=int))
    g = group("report", "reports")
    verb(g, "summary", report_summary, "the whole archive")
    verb(g, "user", report_user, "one user's results", any_provider, username)
    verb(g, "opponents", report_opponents, "one user's opponents", any_provider, username)
    verb(g, "games-by-month", report_months, "games of each month", opt("--provider", choices=KEYS, required=True))
    g = group("export", "exports")
    for name, (kind, frame) in EXPORTS.items():
        verb(g, name, _export(name, frame), f"{name} as {kind}", opt("--format", choices=(kind,), required=True), opt("--output", type=Path), opt("--folder", help="write many files in parallel to this folder"), opt("--provider", choices=KEYS))
    return top


def _session() -> SparkSession:
    return SparkSession.builder.appName("castleflow").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def run(argv: list[str] | None = None, app: App | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run_verb(app or App(_session), args)
    except Usage as e:
        print(e, file=sys.stderr)
        return 2
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 1


def main() -> None:
    raise SystemExit(run())


if __name__ == "__main__":
    main()
