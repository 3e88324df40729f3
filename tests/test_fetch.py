import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from loomspark.operators.visited import Visited
from loomspark.streaming import fetch
from loomspark.streaming.fetch import Manners, Response, fetch_all, http_fetch, open_requests, request_log, shortest_gaps, slots


def plain_slots(rows, delay):
    """The slots of one domain by a loop: in order, when due and free."""
    out, free = {}, 0.0
    for due, url in sorted(rows):
        out[url] = max(due, free)
        free = out[url] + delay
    return out


def test_slots_of_a_domain(spark):
    dues = [("u1", 0.0), ("u2", 0.0), ("u3", 9.5), ("u4", 10.0), ("u5", 30.0), ("u6", 0.0)]
    rows = spark.createDataFrame([(u, "d", u, 0, 1, 100.0 + t) for u, t in dues], "url string, domain string, target string, hop int, attempt int, due double")
    manners = Manners(delay=2.0)
    want = plain_slots([(t, u) for u, t in dues], 2.0)
    assert {r.url: r.slot for r in slots(rows, None, manners, 100.0).collect()} == pytest.approx(want)
    log = spark.createDataFrame([("d", 101.0), ("e", 400.0)], "domain string, requested_at double")
    want = plain_slots([(max(t, 3.0), u) for u, t in dues], 2.0)
    got = {r.url: r.slot for r in slots(rows, log, manners, 100.0).collect()}
    assert min(got.values()) == pytest.approx(3.0) and sorted(got.values()) == pytest.approx(sorted(want.values()))
    assert slots(rows, None, Manners(round_requests=2), 100.0).count() == 2
    assert slots(rows.limit(0), None, manners, 100.0).count() == 0


def test_open_requests_from_the_log(spark):
    urls = spark.createDataFrame([("http://a/1",), ("http://a/1",), (None,), ("http://a/2",), ("http://a/3",), ("http://a/4",), ("http://a/5",), ("x",)], "url string")
    log = spark.createDataFrame(
        [("http://a/1", "http://a/1", 0, 1, 5.0, 301, "http://b/1"), ("http://a/2", "http://a/2", 0, 1, 5.0, 503, None), ("http://a/2", "http://a/2", 0, 2, 9.0, 503, None), ("http://a/3", "http://a/3", 0, 3, 9.0, 0, None), ("http://a/4", "http://b/4", 2, 1, 9.0, 302, "http://c/4")],
        "url string, target string, hop int, attempt int, requested_at double, status int, location string",
    )
    got = {r.url: tuple(r)[1:] for r in open_requests(urls, log, Manners(attempts=3, pause=4.0, redirects=2)).select("url", "target", "hop", "attempt", "due", "domain").collect()}
    assert got == {"http://a/1": ("http://b/1", 1, 1, 0.0, "b"), "http://a/2": ("http://a/2", 0, 3, 17.0, "a"), "http://a/5": ("http://a/5", 0, 1, 0.0, "a"), "x": ("x", 0, 1, 0.0, "")}
    assert open_requests(urls.limit(0), log, Manners()).count() == 0


def test_delay_is_kept_over_runs_and_a_hot_domain_blocks_no_other(spark, tmp_path):
    hot = [f"http://hot.org/{i}" for i in range(24)]
    rest = [f"http://d{i}.org/{j}" for i in range(12) for j in range(2)]
    asked = lambda xs: spark.createDataFrame([(x,) for x in xs], "url string")
    manners = Manners(delay=0.15, attempts=2, pause=0.1, round_requests=16)

    def fetch(u):
        if u.endswith("/3"):
            raise OSError("none")
        return Response(302, location="/moved/1") if u.endswith("/5") else Response(404) if u.endswith("/7") else Response(200, f"got {u}")

    spark.conf.set("spark.sql.shuffle.partitions", "1")  # all domains are one task's
    try:
        path = str(tmp_path / "log")
        fetch_all(asked(hot[:12]), fetch, path, manners)
        before = request_log(spark, path).count()
        got = {r.url: r for r in fetch_all(asked(hot + rest), fetch, path, manners).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert set(got) == {*hot, *rest} and before == 14
    assert (got[hot[3]].status, got[hot[3]].requests) == (0, 2) and (got[hot[7]].status, got[hot[7]].body) == (404, None)
    assert (got[hot[5]].final_url, got[hot[5]].hops, got[hot[5]].body) == ("http://hot.org/moved/1", 1, "got http://hot.org/moved/1")
    log = request_log(spark, path)
    assert log.groupBy("target", "attempt").count().filter("count > 1").count() == 0  # nothing is asked twice
    gaps = {r.domain: r.gap for r in shortest_gaps(log).collect()}
    assert len(gaps) == 13 and min(gaps.values()) >= 0.1499
    last_of_rest = log.filter("domain <> 'hot.org'").agg(F.max("requested_at")).first()[0]
    assert log.filter(F.col("requested_at") > last_of_rest).filter("domain = 'hot.org'").count() >= 6


def test_rounds_grow_with_the_logarithm(spark, tmp_path, monkeypatch):
    rounds = []
    monkeypatch.setattr(fetch, "slots", lambda *a: rounds.append(a[2].round_requests) or slots(*a))
    urls = spark.createDataFrame([(f"http://a/{i}",) for i in range(30)], "url string")
    manners = Manners(delay=0.001, attempts=2, pause=0.0, round_requests=1)
    answer = lambda u: Response(503) if u == "http://a/0" else Response(200, u)
    got = fetch_all(urls, answer, str(tmp_path / "log"), manners)
    assert got.filter("status = 200 and requests = 1").count() == 29 and got.filter("status = 503 and requests = 2").count() == 1
    assert rounds == [1, 2, 4, 8, 16]


def test_http(spark, tmp_path):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            status = {"/a": 301, "/none": 404}.get(self.path, 200)
            self.send_response(status)
            if status == 301:
                self.send_header("Location", "/b")
            self.send_header("Content-Type", "text/html; charset=latin-1")
            self.end_headers()
            self.wfile.write(f"é {self.headers['X-Who']}".encode("latin-1"))

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        urls = spark.createDataFrame([(f"{base}/a",), (f"{base}/none",), ("no address",)], "url string")
        got = {r.url: r for r in fetch_all(urls, http_fetch({"X-Who": "me"}, 5.0), str(tmp_path / "log"), Manners(delay=0.01, attempts=1)).collect()}
    finally:
        server.shutdown()
        server.server_close()
    moved = got[f"{base}/a"]
    assert (moved.final_url, moved.status, moved.hops, moved.body) == (f"{base}/b", 200, 1, "é me")
    assert got[f"{base}/none"].status == 404 and got["no address"].status == 0


def test_visited_keys(spark):
    keys = lambda xs: spark.createDataFrame([(x,) for x in xs], "key string")
    seen = Visited(spark, buckets=3)
    assert seen.unseen(keys(["a", "a", None])).count() == 1
    batches = [[f"k{i}" for i in range(a, a + n)] for a, n in ((0, 5000), (5000, 40), (5040, 1))]
    for b in batches:
        assert seen.add(keys([*b, None])) == len(b)
    held = {k for b in batches for k in b}
    asked = [*sorted(held)[::7], *(f"new{i}" for i in range(5000))]
    maybe = {r.key: r.maybe for r in seen.maybe(keys(asked)).collect()}
    assert all(maybe[k] for k in asked if k in held)  # a filter forgets nothing
    assert sum(m for k, m in maybe.items() if k not in held) < 250
    unseen = seen.unseen(keys(asked + asked))
    assert sorted(r.key for r in unseen.collect()) == sorted(k for k in asked if k not in held)
    assert seen.add(keys([])) == 0
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = seen.unseen(keys(asked))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # the asked keys alone are shuffled
    seen.close()
