import json
import socket
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from scriptorium.plans.client import Client, Gate, ServiceError


class Service:
    """Counts connections and calls at once; bears ``room`` calls, and answers what ``script`` holds first."""

    def __init__(self, room=100, script=(), idle_s=None):
        self.connections, self.calls, self.now, self.most, self.refused, self.room, self.script = 0, 0, 0, 0, 0, room, list(script)
        service, lock = self, threading.Lock()

        class Handler(BaseHTTPRequestHandler):
            protocol_version = "HTTP/1.1"
            timeout = idle_s

            def setup(self):
                super().setup()
                with lock:
                    service.connections += 1

            def do_POST(self):  # noqa: N802
                body = self.rfile.read(int(self.headers["Content-Length"]))
                with lock:
                    service.calls += 1
                    service.now += 1
                    service.most = max(service.most, service.now)
                    status, headers = service.script.pop(0) if service.script else ((429, {}) if service.now > service.room else (200, {}))
                    service.refused += status != 200
                time.sleep(0.02)
                with lock:
                    service.now -= 1
                self.send_response(status)
                for k, v in {**headers, "Content-Length": str(len(body))}.items():
                    self.send_header(k, v)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *a):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.server.daemon_threads = True
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}/v1?x=1"


@pytest.fixture
def service():
    made = []

    def make(*a, **k):
        made.append(Service(*a, **k))
        return made[-1]

    yield make
    for s in made:
        s.server.shutdown()


def ask(client, n):
    return json.loads(client.send("POST", json.dumps(n).encode()))


def test_connections_are_kept(service):
    s = service()
    client = Client(s.url, most=4, kept=4)
    with ThreadPoolExecutor(16) as pool:
        assert list(pool.map(lambda n: ask(client, n), range(80))) == list(range(80))
    assert s.calls == 80 and s.most <= 4 and s.connections <= 4
    client.close()
    few = Client(s.url, most=4, kept=0)
    assert [ask(few, n) for n in range(3)] == [0, 1, 2] and s.connections >= 4


def test_a_connection_that_the_service_closed_is_made_anew(service):
    s = service(idle_s=0.2)
    client = Client(s.url)
    assert ask(client, 1) == 1
    time.sleep(0.6)
    assert ask(client, 2) == 2 and s.connections == 2 and s.calls == 2


def test_fewer_calls_where_the_service_pushes_back(service):
    s = service(room=3)
    client = Client(s.url, most=16, kept=16, retries=30, wait_s=0.001, sleep=lambda w: time.sleep(min(w, 0.01)))
    with ThreadPoolExecutor(16) as pool:
        assert list(pool.map(lambda n: ask(client, n), range(150))) == list(range(150))
    assert s.refused and client.gate.limit < 10 and s.refused < 150
    s.room = 100
    with ThreadPoolExecutor(16) as pool:
        list(pool.map(lambda n: ask(client, n), range(400)))
    assert client.gate.limit == 16  # recovered


def test_waits_as_told_and_gives_up(service):
    waited = []
    s = service(script=[(503, {}), (429, {"Retry-After": "7"}), (200, {}), (503, {}), (503, {}), (429, {"Retry-After": "9999"}), (400, {})])
    client = Client(s.url, retries=2, wait_s=0.5, sleep=waited.append)
    assert ask(client, 1) == 1 and waited == [0.5, 7.0]
    with pytest.raises(ServiceError, match="HTTP 429") as e:
        ask(client, 2)
    assert e.value.status == 429 and len(waited) == 4
    with pytest.raises(ServiceError, match="HTTP 400"):
        ask(client, 3)  # no other try can help
    assert len(waited) == 4 and client.gate.running == 0


def test_time_outs():
    with socket.create_server(("127.0.0.1", 0)) as silent:
        client = Client(f"http://127.0.0.1:{silent.getsockname()[1]}", connect_s=5, read_s=0.2)
        began = time.perf_counter()
        with pytest.raises(TimeoutError):
            ask(client, 1)
        assert time.perf_counter() - began < 3 and client.gate.running == 0
    assert not Client("http://127.0.0.1:9").reachable()
    with pytest.raises(ValueError, match="no http address"):
        Client("file:///etc/passwd")


def test_calls_under_way_halve_once():
    gate = Gate(8)
    under_way = [gate.enter() for _ in range(8)]
    for since in under_way:
        gate.leave(since, False)
    assert gate.limit == 4
    gate.leave(gate.enter(), None)
    assert gate.limit == 4
    for _ in range(3):
        gate.leave(gate.enter(), False)
    assert gate.limit == 1 and gate.running == 0
