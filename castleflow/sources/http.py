"""A serial HTTP client for the providers. It keeps to their pace and leaks no secrets into records."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from castleflow.sources.providers import Request, Settings

KEPT_HEADERS = ("etag", "last-modified", "content-type", "content-length", "retry-after")


@dataclass(frozen=True)
class Attempt:
    provider: str
    endpoint_type: str
    url: str
    method: str
    status_code: int | None
    attempted_at: int
    attempt: int
    response_headers: Mapping[str, str] = field(default_factory=dict)
    retry_after: int | None = None
    bytes: int | None = None
    duration_ms: int | None = None
    from_cache: bool = False


@dataclass(frozen=True)
class Answer:
    """Status 0 stands for a timeout. There is a body with status 200 only."""

    request: Request
    status: int
    fetched_at: int
    headers: Mapping[str, str]
    body: bytes | None
    attempts: tuple[Attempt, ...]


#: (url, headers, timeout) to (status, headers, body); raises TimeoutError.
Transport = Callable[[str, Mapping[str, str], float], tuple[int, Mapping[str, str], bytes]]


class _NoRedirects(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def over_network(url: str, headers: Mapping[str, str], timeout: float) -> tuple[int, Mapping[str, str], bytes]:
    opener = urllib.request.build_opener(_NoRedirects)
    try:
        with opener.open(urllib.request.Request(url, headers=dict(headers)), timeout=timeout) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()
    except urllib.error.URLError as e:
        if isinstance(e.reason, TimeoutError):
            raise e.reason from e
        raise


def kept_headers(headers: Mapping[str, str]) -> dict[str, str]:
    return {k.lower(): v for k, v in headers.items() if k.lower() in KEPT_HEADERS}


def sent_headers(headers: Mapping[str, str]) -> dict[str, str]:
    """Never a cookie or a key of someone's."""
    return {k: v for k, v in headers.items() if k.lower() not in ("cookie", "x-api-key")}


def retry_after(headers: Mapping[str, str]) -> int | None:
    try:
        return max(0, int(headers["retry-after"]))
    except (KeyError, ValueError):
        return None


class Client:
    def __init__(self, settings: Settings | None = None, *, transport: Transport = over_network, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.time, timeouts: Mapping[str, float] | None = None) -> None:
        self.settings, self.transport, self.sleep, self.clock = settings or Settings.from_env(), transport, sleep, clock
        self.timeouts = timeouts or {"chess.com": 30.0, "lichess": 60.0}
        self._last: dict[str, float] = {}

    def _pace(self, key: str, delay: float) -> None:
        if key in self._last and (wait := delay - (self.clock() - self._last[key])) > 0:
            self.sleep(wait)
        self._last[key] = self.clock()

    def fetch(self, request: Request, etag: str | None = None, last_modified: str | None = None) -> Answer:
        pace = self.settings.pace(request.provider)
        headers = sent_headers(request.headers(self.settings, etag, last_modified))
        attempts: list[Attempt] = []
        for n in range(1, pace.retries + 2):
            self._pace(request.provider, pace.apart)
            began = self.clock()
            try:
                status, got, body = self.transport(request.url, headers, self.timeouts[request.provider])
            except TimeoutError:
                status, got, body = None, {}, b""
            held = kept_headers(got)
            wait = retry_after(held)
            body = body if status == 200 else None
            took = int(max(0.0, self.clock() - began) * 1000)
            attempts.append(Attempt(request.provider, request.endpoint_type, request.url, "GET", status, int(began), n, held, wait, None if body is None else len(body), took, status == 304))
            again = status is None or status == 429 or 500 <= status <= 599
            if not again or n > pace.retries:
                return Answer(request, status or 0, int(began), held, body, tuple(attempts))
            self.sleep(pace.pause(status, wait, n))
        raise AssertionError("the last attempt returns")
