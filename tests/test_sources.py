"""Sources, sinks, runs and streams on small files."""

import datetime as dt
import http.server
import threading
import time

import pytest
from pyspark.sql import functions as F

from recordloom.sources import files as S
from recordloom.sources import rss
from recordloom.streaming import pipeline as P
from recordloom.streaming import stories

RSS = b"""<rss><channel><item><guid>1</guid><link>http://a/1</link><title>One</title><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item>
<item><link>http://a/2</link><title>Two</title><pubDate>2024-01-01T10:00:00</pubDate></item></channel></rss>"""


def test_feeds(spark, tmp_path):
    (tmp_path / "good.xml").write_bytes(RSS)
    (tmp_path / "bad.xml").write_text("<rss><channel>")
    spark.dataSource.register(rss.FeedSource)
    paths = f"{tmp_path}/good.xml,{tmp_path}/bad.xml,{tmp_path}/none.xml"
    rows = spark.read.format("feeds").option("paths", paths).load().collect()
    assert sorted(r.external_id for r in rows if not r.error) == ["1", "http://a/2"]
    assert sum(r.error is not None for r in rows) == 2
    seen = '{"%s": "%s"}' % (f"{tmp_path}/good.xml", next(r.validator for r in rows if r.validator))
    assert spark.read.format("feeds").option("paths", f"{tmp_path}/good.xml").option("seen", seen).load().count() == 0


class _Server:
    """Feeds on a local port; counts requests in flight and keeps what was asked for."""

    def __init__(self):
        self.feeds, self.asked, self.now, self.most, self.lock = {}, [], 0, 0, threading.Lock()
        outer = self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                with outer.lock:
                    outer.now += 1
                    outer.most = max(outer.most, outer.now)
                    outer.asked.append((self.path, self.headers.get("If-None-Match"), self.headers.get("If-Modified-Since")))
                time.sleep(0.05)
                body, headers = outer.feeds[self.path]
                same = headers and all(self.headers.get(rss.CONDITIONS[k]) == v for k, v in headers.items())
                with outer.lock:
                    outer.now -= 1
                self.send_response(304 if same else 500 if body is None else 200)
                for k, v in headers.items():
                    self.send_header(k, v)
                self.end_headers()
                if body is not None and not same:
                    self.wfile.write(body)

            def log_message(self, *args):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


def _item(guid):
    return f"<rss><channel><item><guid>{guid}</guid><title>t</title></item></channel></rss>".encode()


def test_collector_asks_on_condition(spark, tmp_path):
    """200, 304 and 500; a poll without news makes no batch; a restart goes on from the offsets."""
    server = _Server()
    for i in range(20):
        server.feeds[f"/{i}"] = (_item(f"a{i}"), {"ETag": f'"{i}"'} if i % 2 else {"Last-Modified": f"Mon, 01 Jan 2024 10:00:{i:02d} GMT"})
    server.feeds["/5"] = (None, {})
    server.feeds["/6"] = (b"<rss><chan", {})
    server.feeds["/7"] = (_item("a7"), {})  # no validators: told by its content
    spark.dataSource.register(rss.FeedSource)
    batches = []

    def poll():
        del server.asked[:], batches[:]
        stream = spark.readStream.format("feeds").option("paths", ",".join(server.url + p for p in server.feeds)).load()
        keep = lambda df, n: batches.extend((r.feed.rpartition("/")[2], r.external_id, r.error) for r in df.collect())
        stream.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
        return sorted((f, i) for f, i, e in batches if not e), sorted(f for f, _, e in batches if e)

    good, wrong = poll()
    assert good == sorted((str(i), f"a{i}") for i in range(20) if i not in (5, 6)) and wrong == ["5", "6"]
    assert 1 < server.most <= rss.AT_ONCE and all(a[1:] == (None, None) for a in server.asked)
    good, wrong = poll()
    assert good == [] and wrong == ["5", "6"]
    told = {p: (etag, since) for p, etag, since in server.asked}
    assert told["/1"] == ('"1"', None) and told["/2"] == (None, "Mon, 01 Jan 2024 10:00:02 GMT") and told["/5"] == (None, None)
    server.feeds["/1"] = (_item("b1"), {"ETag": '"new"'})
    server.feeds["/2"] = (None, {})  # fails now: what it last answered with stays
    server.feeds["/5"] = (_item("a5"), {"ETag": '"5"'})
    server.feeds["/6"] = (_item("a6"), {"ETag": '"6"'})
    assert poll() == ([("1", "b1"), ("5", "a5"), ("6", "a6")], ["2"])
    server.feeds["/2"] = (_item("a2"), {"Last-Modified": "Mon, 01 Jan 2024 10:00:02 GMT"})
    assert poll() == ([], [])
    assert ("/2", None, "Mon, 01 Jan 2024 10:00:02 GMT") in server.asked
    server.server.shutdown()


def test_collector_takes_turns():
    c = rss.FeedCollector({"paths": "a,b,c,d,e", "feedsPerBatch": "2"})
    asked = []
    c._ask = lambda p, seen: (asked.append(p) or [], seen)
    at = c.initialOffset()
    for _ in range(3):
        at = c.read(at)[1]
    assert sorted(asked[:2]) == ["a", "b"] and sorted(asked[2:4]) == ["c", "d"] and sorted(asked[4:]) == ["a", "e"] and at["told"] == 0
    assert list(rss.FeedCollector({}).read(c.initialOffset())[0]) == []


def test_entry_dates():
    assert rss.entry_date("2024-01-01T00:00:00").utcoffset() == dt.timedelta(hours=5, minutes=30)
    assert rss.entry_date("no date") is None and rss.entry_date(None) is None


def test_fixture_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2020, 1, 1)), (2, dt.datetime(2020, 1, 3))], "id long, at timestamp")
    S.export_fixture(df, f"{tmp_path}/f")
    back = S.load_fixture(spark, f"{tmp_path}/f", df.schema, "at", "2024-01-10 00:00:00")
    assert sorted(r.at for r in back.collect()) == [dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 10)]


def test_csv_and_jsonl(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "n long, s string")
    S.export_csv(df, f"{tmp_path}/c", ["s", "n"], ["n"])
    assert [tuple(r) for r in S.read_csv(spark, f"{tmp_path}/c", "s string, n long").collect()] == [("a", 1), ("b", 2)]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert S.read_jsonl(spark, f"{tmp_path}/x.jsonl", "a long").count() == 2


def test_upsert(spark):
    t = spark.createDataFrame([("A", 1, 1), ("B", 1, 1)], "k string, v long, at long")
    c = spark.createDataFrame([("B", 5, 2), ("B", 4, 1), ("C", 7, 1)], "k string, v long, at long")
    assert sorted(map(tuple, S.upsert(t, c, ["k"], "at").collect())) == [("A", 1, 1), ("B", 5, 2), ("C", 7, 1)]


def test_runs_publish_once(spark, tmp_path):
    runs = S.Runs(spark, f"file://{tmp_path}/runs")
    df = spark.range(3)
    version, run = runs.current()
    assert (version, run) == (0, None)
    first = runs.publish(df, 0)
    assert first and runs.publish(df, 0) is None
    assert runs.read().count() == 3
    with pytest.raises(ValueError):
        runs.publish(df.limit(0), 1)
    runs.publish(df, 1)
    assert runs.prune(keep=1) == 1


def test_debounce_fires_once_per_quiet_start(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([(1, at(0)), (1, at(10)), (1, at(89)), (1, at(200)), (2, at(5)), (3, at(5000))], "k long, at timestamp")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = P.files(spark, f"{tmp_path}/in", df.schema).withWatermark("at", "1 second")
    got = {(r.k, r.n) for r in P.drain(P.debounce(stream, "k", "at")).collect()}
    assert (1, 3) in got


def test_staged_stream_splits_bad_payloads(spark, tmp_path):
    spark.createDataFrame([('{"a": 1}',), ("oops",), ('{"a": "x"}',)], "value string").write.parquet(f"{tmp_path}/p")
    good, dead = P.staged(P.files(spark, f"{tmp_path}/p", "value string"), "a long")
    assert [r.a for r in P.drain(good).collect()] == [1]
    assert P.drain(dead).count() == 2
    assert P.given_up(spark.createDataFrame([(1,), (1,), (1,), (2,)], "k long"), "k").collect()[0].k == 1


def test_batches_are_bounded_and_keep_their_numbers(spark, tmp_path):
    for n in range(5):
        spark.range(n, n + 1).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
    sizes = []
    stream = P.files(spark, f"{tmp_path}/in/part=*", "id long", per_trigger=2)
    assert P.drain(stream, each=lambda batch, n: sizes.append((n, batch.count()))).count() == 5
    assert [n for n, _ in sizes] == [0, 1, 2] and max(k for _, k in sizes) <= 2


def test_shadow_batches_stay_out_of_sight(spark, tmp_path):
    sinks = [P.routed(f"{tmp_path}/live", f"{tmp_path}/shadow", live) for live in (True, False)]
    for again in range(2):
        sinks[0](spark.range(3), 0)
        sinks[1](spark.range(7 + again), 0)
    assert spark.read.parquet(f"{tmp_path}/live/batch=*").count() == 3 and spark.read.parquet(f"{tmp_path}/shadow/batch=*").count() == 8


def test_periodic_job_goes_on_from_its_checkpoint(spark, tmp_path):
    seen = []
    for n in range(2):
        spark.range(10 * n, 10 * n + 4).write.mode("append").parquet(f"{tmp_path}/in")
        query = P.every(P.files(spark, f"{tmp_path}/in", "id long"), "1 second", lambda batch, k: seen.extend(r.id for r in batch.collect()), f"{tmp_path}/state")
        query.processAllAvailable()
        query.stop()
    assert sorted(seen) == [0, 1, 2, 3, 10, 11, 12, 13]


def test_trim_never_cuts_a_batch(spark):
    topic = spark.createDataFrame([(b, i) for b in range(5) for i in range(10)], "batch long, i long")
    assert sorted({r.batch for r in P.trimmed(topic, "batch", 15).collect()}) == [3, 4] and P.trimmed(topic, "batch", 10).count() == 10


def test_quiet_claims_are_reclaimed(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, 7, at(0), False), (1, 7, at(50), False), (2, 7, at(0), False), (2, 8, at(10), True), (3, 7, at(0), False), (4, 1, at(0), False), (4, 2, at(1), False), (4, 3, at(2), False), (5, 1, at(100), False)]
    got = P.reclaimed(spark.createDataFrame(rows, "item long, worker long, at timestamp, done boolean"), "item", "worker", "at", "done", 60).collect()
    assert {(r.item, r.worker, r.fate) for r in got} == {(3, 7, "reclaim"), (4, 3, "dead")}


def test_scratch_refuses_a_machine_folder_on_a_cluster():
    from types import SimpleNamespace

    from recordloom import storage

    context = SimpleNamespace(applicationId="remote-1", master="spark://host:7077", getConf=lambda: {}, _jsc=None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.scratch_root(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))


def test_clear_scratch_is_repeatable(spark):
    from recordloom import storage

    kept = storage.stored(spark.range(2))
    assert kept.agg(F.sum("id")).first()[0] == 1
    storage.clear_scratch(spark)
    storage.clear_scratch(spark)


def test_story_life_with_late_rows(spark, tmp_path):
    """Dormant by a timer without rows of its own, woken, late rows too late or not, and a restart in between."""
    key, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    at = lambda h: t0 + dt.timedelta(hours=h)
    schema = "story long, at timestamp, slug string"
    batches = [
        [(1, at(0), "first"), (1, at(5), "other")], [(2, at(32), "two")],  # the watermark is at 31: story 1 slept from 29
        [(1, at(28), "too late"), (3, at(31.5), "late, but not too late")], [(1, at(33), "again"), (2, at(31.5), "earlier")], [(4, at(60), "end")],
    ]
    turns = []
    spark.conf.set(key, provider)
    try:
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
            stream = P.files(spark, f"{tmp_path}/in/*", schema)
            keep = lambda df, _: turns.append(sorted((r.story, r.status, (r.at.replace(tzinfo=dt.timezone.utc) - t0).total_seconds() / 3600, r.slug) for r in df.select("story", "status", F.col("at").cast("timestamp_ntz").alias("at"), "slug").collect()))
            stories.story_life(stream, "1 hour").writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    finally:
        spark.conf.unset(key)
    assert sorted(t for some in turns for t in some) == sorted([
        (1, "born", 0, "first"), (2, "born", 32, "two"), (1, "dormant", 29, "first"), (3, "born", 31.5, "late, but not too late"), (1, "woken", 33, "first"),
        (4, "born", 60, "end"), (2, "dormant", 56, "two"), (3, "dormant", 55.5, "late, but not too late"), (1, "dormant", 57, "first"),
    ])
