"""Calls to a service: kept connections, time-outs of their own for connecting and reading, and a rate the service sets.

One client serves all threads of a Python worker.  Standard library only; proxies
of the environment are not used.
"""

from __future__ import annotations

import http.client
import threading
import time
from collections.abc import Callable
from urllib.parse import urlsplit

#: What a service answers when it has too much to do.
PUSHED_BACK = frozenset({429, 500, 502, 503, 504})
#: The longest wait that a service may ask for before the next try.
MAX_WAIT_S = 60.0


class ServiceError(Exception):
    """An answer other than success."""

    def __init__(self, status: int, text: str):
        super().__init__(f"HTTP {status}: {text[:200]}")
        self.status = status


class Gate:
    """Lets as many calls run at once as the service bears, ``most`` and one at least.

    A call that was pushed back halves the number, once for all calls that were under
    way then; as many good answers as there may be calls add one again.
    """

    def __init__(self, most: int):
        self.most, self.limit, self.running, self._halvings = most, float(most), 0, 0
        self._change = threading.Condition()

    def enter(self) -> int:
        with self._change:
            self._change.wait_for(lambda: self.running < int(self.limit))
            self.running += 1
            return self._halvings

    def leave(self, since: int, good: bool | None) -> None:
        """``good`` is None where the answer says nothing of the load."""
        with self._change:
            self.running -= 1
            if good:
                self.limit = min(float(self.most), self.limit + 1 / self.limit)
            elif good is False and since == self._halvings:
                self.limit, self._halvings = max(1.0, self.limit / 2), self._halvings + 1
            self._change.notify_all()


class Client:
    """Posts to one service over at most ``most`` connections at once, of which ``kept`` stay open between calls."""

    def __init__(
        self, url: str, connect_s: float = 15.0, read_s: float = 60.0, most: int = 32, kept: int = 16, retries: int = 2, wait_s: float = 0.5, sleep: Callable[[float], None] = time.sleep
    ):
        parts = urlsplit(url)
        if parts.scheme not in ("http", "https") or not parts.hostname:
            raise ValueError(f"no http address: {url}")
        self._kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
        self._host, self._port, self.target = parts.hostname, parts.port, (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
        self.connect_s, self.read_s, self.kept, self.retries, self.wait_s, self.sleep = connect_s, read_s, kept, retries, wait_s, sleep
        self.gate, self._idle, self._lock = Gate(most), [], threading.Lock()

    def _connection(self) -> tuple[http.client.HTTPConnection, bool]:
        """(a connection, whether it was used before)."""
        with self._lock:
            if self._idle:
                return self._idle.pop(), True
        new = self._kind(self._host, self._port, timeout=self.connect_s)
        new.connect()
        new.sock.settimeout(self.read_s)
        return new, False

    def _give_back(self, used: http.client.HTTPConnection) -> None:
        with self._lock:
            if used.sock is not None and len(self._idle) < self.kept:
                self._idle.append(used)
                return
        used.close()

    def _once(self, method: str, target: str, body: bytes | None, headers: dict[str, str]) -> tuple[int, dict[str, str], bytes]:
        while True:
            connection, before = self._connection()
            try:
                connection.request(method, target, body, headers)
                answer = connection.getresponse()
                found = answer.status, {k.lower(): v for k, v in answer.getheaders()}, answer.read()
            except (http.client.RemoteDisconnected, ConnectionResetError, BrokenPipeError):
                connection.close()
                if before:  # closed by the service while it was idle: nothing was answered
                    continue
                raise
            except BaseException:
                connection.close()
                raise
            self._give_back(connection)
            return found

    def send(self, method: str, body: bytes | None = None, headers: dict[str, str] | None = None, target: str | None = None) -> bytes:
        """The body of a good answer.  Tries again where the service pushed back, after the seconds that it names if it does."""
        for attempt in range(self.retries + 1):
            since, good = self.gate.enter(), None
            try:
                status, told, text = self._once(method, target or self.target, body, headers or {})
                good = True if status < 300 else False if status in PUSHED_BACK else None
            finally:
                self.gate.leave(since, good)
            if good:
                return text
            if good is None or attempt == self.retries:
                raise ServiceError(status, text.decode("utf-8", "replace"))
            named = told.get("retry-after", "")
            self.sleep(min(float(named) if named.isdigit() else self.wait_s * 2**attempt, MAX_WAIT_S))
        raise ValueError("retries must not be negative")

    def reachable(self) -> bool:
        """Whether anything answers at the address, whatever it says."""
        try:
            self._once("GET", "/", None, {})
        except (OSError, http.client.HTTPException):
            return False
        return True

    def close(self) -> None:
        with self._lock:
            idle, self._idle = self._idle, []
        for c in idle:
            c.close()
