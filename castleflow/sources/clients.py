"""A provider as one object: what can be asked of it, over any fetcher."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from castleflow.sources import providers
from castleflow.sources.http import Answer


@dataclass(frozen=True)
class Unit:
    """A stretch of a user's games that is fetched at once: a month, or a window of days."""

    provider: str
    username: str
    unit_id: str
    url: str | None = None
    since: int | None = None
    until: int | None = None


@runtime_checkable
class Source(Protocol):
    """What every provider's client offers."""

    key: str

    def info(self) -> providers.Provider: ...
    def profile(self, username: str) -> Answer: ...
    def statistics(self, username: str) -> Answer: ...
    def units(self, username: str, since: int | None = None, until: int | None = None) -> list[Unit]: ...
    def games(self, username: str, since: int | None = None, until: int | None = None, limit: int | None = None) -> Iterator[Answer]: ...
    def unit(self, unit: Unit, limit: int | None = None) -> Answer: ...
    def game(self, ref: str) -> Answer: ...
    def close(self) -> None: ...


class _Client:
    key = ""

    def __init__(self, fetcher: providers.Fetcher) -> None:
        self.fetcher = fetcher

    def info(self) -> providers.Provider:
        return providers.PROVIDERS[self.key]

    def profile(self, username: str) -> Answer:
        return self.fetcher.fetch(providers.user_profile(self.key, username))

    def close(self) -> None:
        """Requests are single; nothing stays open."""


class ChessCom(_Client):
    key = "chess.com"

    def statistics(self, username: str) -> Answer:
        return self.fetcher.fetch(providers.user_stats(username))

    def units(self, username: str, since: int | None = None, until: int | None = None) -> list[Unit]:
        """All months of the index, whatever the window."""
        body = self.fetcher.fetch(providers.archives_index(username)).body
        listed = json.loads(body)["archives"] if body else []
        ends = [(url, re.search(r"/(\d+)/(\d+)/*$", url)) for url in listed]
        return [Unit(self.key, username.strip().lower(), f"{int(m[1]):04d}/{int(m[2]):02d}", url) for url, m in ends if m]

    def unit(self, unit: Unit, limit: int | None = None) -> Answer:
        year, month = map(int, unit.unit_id.split("/"))
        return self.fetcher.fetch(providers.monthly_archive(unit.username, year, month))

    def games(self, username: str, since: int | None = None, until: int | None = None, limit: int | None = None) -> Iterator[Answer]:
        return (self.unit(u) for u in self.units(username, since, until))

    def game(self, ref: str) -> Answer:
        raise NotImplementedError("this provider gives games by the month only")


class Lichess(_Client):
    key = "lichess"

    def statistics(self, username: str) -> Answer:
        """Part of the profile."""
        return self.profile(username)

    def units(self, username: str, since: int | None = None, until: int | None = None) -> list[Unit]:
        return [Unit(self.key, username.strip().lower(), providers.range_unit(since, until), None, since, until)]

    def unit(self, unit: Unit, limit: int | None = None) -> Answer:
        return self.fetcher.fetch(providers.user_games(unit.username, unit.since, unit.until, limit or 0))

    def games(self, username: str, since: int | None = None, until: int | None = None, limit: int | None = None) -> Iterator[Answer]:
        """One stream, which has to be bounded by ``limit``."""
        (whole,) = self.units(username, since, until)
        yield self.unit(whole, limit)

    def game(self, ref: str) -> Answer:
        return self.fetcher.fetch(providers.game(ref))


def client(key: str, fetcher: providers.Fetcher) -> Source:
    known = {c.key: c for c in (ChessCom, Lichess)}
    if key not in known:
        raise providers.UnknownProvider(key)
    return known[key](fetcher)
