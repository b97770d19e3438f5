"""A polite client for landing files, outside Spark jobs: rate limit, retries, budget."""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path


class NotFound(Exception):
    """The server has no such file; not to be asked for again."""


class Refused(Exception):
    """The server refuses the client; more requests would not help."""


class RateLimiter:
    """Spaces the calls of all threads evenly."""

    def __init__(self, per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep = 1 / per_second, clock, sleep
        self.lock, self.due = threading.Lock(), float("-inf")

    def wait(self) -> None:
        with self.lock:
            now = self.clock()
            pause = max(0.0, self.due - now)
            self.due = max(now, self.due) + self.gap
        if pause:
            self.sleep(pause)


def _fetch(url: str, headers: dict) -> tuple[int, dict, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), b""


@dataclass
class Client:
    """GETs with a limit and exponential backoff; ``Retry-After`` is obeyed."""

    agent: str
    limiter: RateLimiter
    transport: Callable[[str, dict], tuple[int, dict, bytes]] = _fetch
    sleep: Callable[[float], None] = time.sleep
    tries: int = 6
    requests: int = 0
    retries: int = 0
    bytes: int = 0

    def get(self, url: str) -> bytes:
        for attempt in range(self.tries):
            self.limiter.wait()
            self.requests += 1
            try:
                status, headers, body = self.transport(url, {"User-Agent": self.agent, "Accept-Encoding": "gzip"})
            except OSError:
                status, headers, body = 0, {}, b""
            if status == 200:
                self.bytes += len(body)
                return body
            if status == 404:
                raise NotFound(url)
            if status == 403:
                raise Refused(url)
            if attempt + 1 < self.tries:
                self.retries += 1
                after = str({k.lower(): v for k, v in headers.items()}.get("retry-after", ""))
                self.sleep(float(after) if after.isdigit() else 2.0**attempt)
        raise OSError(f"no answer from {url}")


@dataclass
class Budget:
    """Symbols a month and requests an hour that a price source allows, kept in a file."""

    path: Path
    monthly: int = 480
    hourly: int = 45
    state: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.path.exists():
            self.state = json.loads(self.path.read_text())

    def allows(self, symbol: str, month: str, now: float) -> bool:
        """Whether a request for the symbol may be made now."""
        if self.state.get("month") != month:
            self.state.update(month=month, symbols=[])
        recent = [t for t in self.state.get("times", []) if now - t < 3600]
        self.state["times"] = recent
        return len(recent) < self.hourly and (symbol in self.state["symbols"] or len(self.state["symbols"]) < self.monthly)

    def spend(self, symbol: str, now: float) -> None:
        if symbol not in self.state["symbols"]:
            self.state["symbols"].append(symbol)
        self.state.setdefault("times", []).append(now)
        temporary = self.path.with_suffix(".part")
        temporary.write_text(json.dumps(self.state))
        temporary.replace(self.path)
