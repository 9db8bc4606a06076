"""Requests of pages over HTTP, with the standard library alone."""

from __future__ import annotations

import base64
import datetime
import gzip
import time
import urllib.error
import urllib.parse
import urllib.request
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


@dataclass
class Requester:
    """Requests one address after another; a host is not asked again before ``delay`` seconds have passed.

    ``logins`` gives (user, password) by host; they are sent with the first request.  Bodies are taken up to ``max_bytes``,
    unpacked if they come packed.  Redirects are followed up to ``max_redirects`` times.
    """

    agent: str = "corpusloom"
    timeout: float = 15.0
    max_redirects: int = 7
    delay: float = 0.0
    max_bytes: int = 50_000_000
    logins: dict[str, tuple[str, str]] = field(default_factory=dict)
    delays: dict[str, float] = field(default_factory=dict)  # seconds by host, from robots.txt
    _last: dict[str, float] = field(default_factory=dict)
    _opener: urllib.request.OpenerDirector | None = None

    def __call__(self, url: str) -> dict:
        out: dict = {"fetched_at": datetime.datetime.now(datetime.UTC).replace(tzinfo=None), "redirects": 0}
        target = url
        while True:
            self._wait(urllib.parse.urlsplit(target).hostname or "")
            began = time.perf_counter()
            try:
                with self._open(target) as answer:
                    out["response_ms"] = (time.perf_counter() - began) * 1000
                    status, headers = answer.status, answer.headers
                    raw = answer.read(self.max_bytes + 1)
            except urllib.error.HTTPError as problem:
                out["response_ms"] = (time.perf_counter() - began) * 1000
                status, headers, raw = problem.code, problem.headers, problem.read(self.max_bytes + 1)
            except (OSError, ValueError) as problem:
                reason = getattr(problem, "reason", problem)
                return out | {"error": f"{type(problem).__name__}: {reason}", "final_url": target}
            location = headers.get("Location")
            if status in (301, 302, 303, 307, 308) and location:
                if out["redirects"] >= self.max_redirects:
                    return out | {"status": status, "error": "too many redirects", "final_url": target}
                out["redirects"] += 1
                target = urllib.parse.urljoin(target, location)
                continue
            out["download_ms"] = (time.perf_counter() - began) * 1000 - out["response_ms"]
            out |= {"status": status, "content_type": headers.get("Content-Type"), "retry_after": headers.get("Retry-After"), "final_url": target}
            if len(raw) > self.max_bytes:
                return out | {"error": "too large", "content_bytes": len(raw)}
            body = _unpacked(raw, headers.get("Content-Encoding"))
            return out | {"body": body, "content_bytes": len(body)}

    def _open(self, url: str):
        if self._opener is None:
            self._opener = urllib.request.build_opener(_NoRedirect)
        request = urllib.request.Request(url, headers={"User-Agent": self.agent, "Accept": "*/*", "Accept-Encoding": "gzip, deflate"})
        login = self.logins.get(urllib.parse.urlsplit(url).hostname or "")
        if login:
            request.add_header("Authorization", "Basic " + base64.b64encode(":".join(login).encode()).decode())
        return self._opener.open(request, timeout=self.timeout)

    def _wait(self, host: str) -> None:
        pause = max(self.delay, self.delays.get(host, 0.0))
        last = self._last.get(host)
        if pause and last is not None:
            time.sleep(max(0.0, last + pause - time.monotonic()))
        self._last[host] = time.monotonic()


def _unpacked(body: bytes, encoding: str | None) -> bytes:
    try:
        if encoding == "gzip":
            return gzip.decompress(body)
        if encoding == "deflate":
            try:
                return zlib.decompress(body)
            except zlib.error:
                return zlib.decompress(body, -zlib.MAX_WBITS)
    except (OSError, EOFError, zlib.error):
        return body
    return body


def requesters(**options) -> Callable[[], Requester]:
    """A maker of requesters, one a task."""
    return lambda: Requester(**options)
