"""The data source against a server of our own on this machine, which fails for one query and refuses another."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from ledgerline.sources import fetching
from ledgerline.sources.parsers import parse_newsdata


@pytest.fixture(scope="module")
def server():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
            asked.append(q)
            status = {"broken": 500, "refused": 429}.get(q["q"], 200)
            body = json.dumps({"status": "success", "results": [{"title": f"News of {q['q']}", "link": f"https://e.com/{q['since']}", "pubDate": "2024-05-01 10:00:00"}]})
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *a):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/?q={{query}}&k={{key}}&since={{since}}&until={{until}}", asked
    s.shutdown()


QUERIES = ["a & b", "broken", "é", "refused", "after"]


def _ask(spark, address, **options):
    fetching.register(spark)
    return {r["query"]: r for r in fetching.fetched(spark, "any", QUERIES, address=address, key="secret", times="%Y%m%d", since=0, until=86_400, **options).collect()}


def test_one_lane_stops_at_a_refusal(spark, server):
    address, asked = server
    asked.clear()
    got = _ask(spark, address, lanes=1)
    assert {q: r["error"] for q, r in got.items()} == {"a & b": None, "broken": "status 500", "é": None, "refused": "status 429"}
    assert [q["q"] for q in asked] == QUERIES[:4] and {(q["k"], q["since"], q["until"]) for q in asked} == {("secret", "19700101", "19700102")}


def test_a_lane_a_query(spark, server):
    got = _ask(spark, server[0])
    assert set(got) == set(QUERIES) and got["after"]["error"] is None
    rows = parse_newsdata(spark.createDataFrame(list(got.values()), fetching.SCHEMA)).collect()
    assert sorted(r["title"] for r in rows) == ["News of a & b", "News of after", "News of é"]


def test_a_service_that_cannot_be_reached(spark):
    got = _ask(spark, "http://127.0.0.1:9/?k={key}", lanes=2)
    assert {r["error"] for r in got.values()} == {"URLError"} and len(got) == len(QUERIES)
    assert {r["error"] for r in _ask(spark, "file:///etc/{query}").values()} == {"not a web address"}
    assert fetching.fetched(spark, "any", [], address="http://127.0.0.1:9/").count() == 0


def test_a_stream_asks_for_whole_spans(spark, server, tmp_path):
    address, asked = server
    asked.clear()
    fetching.register(spark)
    since, now = int(time.time()) - 3 * 86_400 - 60, int(time.time())
    for _ in range(2):  # the second start finds no new span
        landed = fetching.stream(spark, "any", ["x", "refused"], since, address=address, every=86_400, times="%Y%m%d%H%M%S")
        q = landed.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start(str(tmp_path / "out"))
        until = time.time() + 60
        while time.time() < until and not (q.lastProgress and not q.status["isTriggerActive"]):
            time.sleep(0.5)
        q.stop()
        assert q.exception() is None
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    stamp = lambda t: time.strftime("%Y%m%d%H%M%S", time.gmtime(t))
    assert sorted((r["query"], r["error"]) for r in rows) == [("refused", "status 429"), ("x", None)]
    assert {(q["since"], q["until"]) for q in asked} == {(stamp(since), stamp(since + 3 * 86_400))} and now > since
