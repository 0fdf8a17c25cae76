"""Fetching from a local server with slow, failing and wrong-typed pages."""

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from texloom.sources import fetch


class Pages(BaseHTTPRequestHandler):
    asked: list[tuple[str, float]] = []

    def do_GET(self):  # noqa: N802
        Pages.asked.append((self.path, time.monotonic()))
        tries = sum(p == self.path for p, _ in Pages.asked)
        if self.path == "/drip":
            self.send_response(200)
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            try:
                for _ in range(100):
                    self.wfile.write(b"<p>")
                    time.sleep(0.2)
            except OSError:
                return
            return
        if self.path == "/slow":
            time.sleep(4)
        code = 500 if self.path == "/broken" or self.path == "/again" and tries == 1 else 404 if self.path == "/none" else 200
        body = "größe".encode("latin-1")
        self.send_response(code)
        self.send_header("Content-Type", "image/png" if self.path == "/image" else "text/html; charset=iso-8859-1")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    made = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    Pages.asked.clear()
    yield f"http://127.0.0.1:{made.server_port}"
    made.shutdown()


def test_fetched(spark, server):
    paths = ["/good", "/good", "/again", "/broken", "/none", "/image", "/slow", "/drip"]
    rows = [(server + p,) for p in paths] + [(None,), ("no url at all",), ("http://127.0.0.1:1/refused",)]
    began = time.monotonic()
    got = {r.url: r for r in fetch.fetched(spark.createDataFrame(rows, "url string"), delay=0.3, deadline=2.0).collect()}
    assert len(got) == 9 and time.monotonic() - began < 30
    at = lambda p: got[server + p]
    assert (at("/good").status, at("/good").body, at("/good").attempts, at("/good").error) == (200, "größe", 1, None)
    assert (at("/again").body, at("/again").attempts) == ("größe", 2)
    assert at("/broken").body is None and at("/broken").error == "status 500" and at("/broken").attempts > 1
    assert (at("/none").error, at("/none").attempts) == ("status 404", 1)
    assert (at("/image").body, at("/image").error) == (None, "type image/png")
    assert at("/slow").body is None and at("/drip").body is None and at("/drip").error
    assert got["no url at all"].error and got["http://127.0.0.1:1/refused"].error
    first = {}
    for path, when in Pages.asked:
        first.setdefault(path, when)
    times = sorted(first.values())
    assert all(b - a >= 0.29 for a, b in zip(times, times[1:]))  # one task, one page after the other
    assert fetch.fetched(spark.createDataFrame([], "url string")).count() == 0
