"""Datasets, evaluation runs, logs, speech, jobs, streams and files on small tables."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from audiolake.operators import catalog, datasets, metrics, monitoring, speech
from audiolake.session import shared_folder
from audiolake.sources import files
from audiolake.streaming import events
from tests.conftest import rows


def test_draws_follow_the_weights(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(3000)], "key string")
    items = spark.createDataFrame([(1, 600), (2, 300), (3, 100), (4, 0), (5, None)], "id long, weight long")
    got = datasets.weighted_draws(keys, "key", items, 2, 1, "x", buckets=16)
    share = {r.id: r["count"] / 6000 for r in got.groupBy("id").count().collect()}
    assert set(share) == {1, 2, 3} and all(abs(share[i] - w) < 0.03 for i, w in ((1, 0.6), (2, 0.3), (3, 0.1)))
    assert rows(got) == rows(datasets.weighted_draws(keys.repartition(5), "key", items.repartition(3), 2, 1, "x", buckets=16))
    assert datasets.weighted_draws(keys, "key", items.limit(0), 2, 1, "x").count() == 0


def test_mixed_negatives(spark):
    ex = spark.createDataFrame([("e", 1, "t")], "example_id string, positive_id long, source string")
    side = lambda ids: spark.createDataFrame([("e", x, i) for i, x in enumerate(ids, 1)], "example_id string, negative_id long, place int")
    got = datasets.mixed_negatives(ex, side([9, 8, 7]), side([8, 6, 5]), side([1, 9, 4, 3]), 5, 2, 2).orderBy("place").collect()
    assert [(r.negative_id, r.source) for r in got] == [(9, "hard"), (8, "hard"), (6, "popular"), (4, "uniform"), (3, "uniform")]


def test_numbers_without_gaps(spark):
    rng = random.Random(2)
    data = [(rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(data, "v int, id long").repartition(7)
    got = [(r.v, r.id) for r in datasets.numbered(df, [F.col("v"), F.col("id")], "at").orderBy("at").collect()]
    assert got == sorted(data)
    assert sorted(r["at"] for r in datasets.numbered(df, [F.col("v"), F.col("id")], "at").collect()) == list(range(3000))
    assert datasets.numbered(df.limit(0), [F.col("v")], "at").count() == 0


def test_canonical_digest_ignores_the_layout(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "x", i) for i in range(2500)], "id long, a string, b long")
    one = datasets.canonical_digest(df, "id", ["b", "a"]).first()
    assert one == datasets.canonical_digest(df.repartition(9), "id", ["a", "b"]).first() and one.rows == 2500
    assert one.digest != datasets.canonical_digest(df.filter("id <> 77"), "id", ["a", "b"]).first().digest
    assert datasets.strict_columns(df, {"id": "bigint", "a": "int", "c": "int"}) == ["missing c", "extra b", "a is string, not int"]


def test_regressions_and_reproduction(spark):
    v = spark.createDataFrame([("base", "t", "x", 0.5, 20), ("base", "t", "y", 0.5, 20), ("b2", "t", "x", 0.3, 20), ("new", "t", "x", 0.44, 20), ("new", "t", "y", 0.2, 5), ("old", "t", "y", 0.2, 0)], "system string, section string, cohort string, value double, queries long")
    assert [(r.system, r.cohort, r.baseline, r.delta) for r in metrics.regressions(v, ["base", "b2"]).orderBy("system").collect()] == [("new", "x", "base", -0.06), ("old", "y", "base", -0.3)]
    have = spark.createDataFrame([("a", "m", 0.5), ("b", "m", 0.5), ("c", "m", 0.5)], "system string, metric string, value double")
    want = spark.createDataFrame([("a", "m", 0.505), ("b", "m", 0.6), ("b", "n", 0.1), ("a", "n", 0.1)], "system string, metric string, value double")
    got = {(r.system, r.metric): r.problem for r in metrics.reproduced(have, want, ["m", "n"], 0.01).collect()}
    assert got == {("b", "m"): "0.500, expected 0.600", ("a", "n"): "missing", ("b", "n"): "missing", ("c", "m"): "no recorded expectation", ("c", "n"): "no recorded expectation"}


def test_pool_ranks(spark):
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("r", [0.0, 1.0])], "query_id string, embedding array<float>")
    pool = spark.createDataFrame([(1, [2.0, 0.1]), (2, [1.0, 1.0]), (3, [0.0, 3.0])], "id long, embedding array<float>")
    sims = metrics.pool_similarities(q, pool, per_block=1)
    assert sims.count() == 6
    positives = spark.createDataFrame([("q", 2), ("r", 3), ("s", 1)], "query_id string, positive_id long")
    assert rows(metrics.split_ranks(positives, sims)) == [("q", 2), ("r", 1)]


def test_summary_and_drift(spark):
    schema = "ordering string, bundle string, mode string, legs map<string,string>, timings map<string,double>, results array<struct<score:double,sources:array<string>>>, n int"
    log = lambda data: spark.createDataFrame(data, schema)
    base = monitoring.search_summary(log([("ranker", "a", None, {"lexical": "ok"}, {"total": 10.0}, [(2.0, ["lexical"])], 1)] * 4))
    now = monitoring.search_summary(log([("rrf", "b", "voice", {"lexical": "timeout"}, {"total": 50.0, "x": None}, [], 1), (None, None, None, None, None, None, 1)]))
    got = {(r.measure, r.name): r.value for r in now.collect()}
    assert got["total", "zero_result_rate"] == 1.0 and got["total", "rrf_rate"] == 1.0 and got["total", "top_score_mean"] is None
    assert got["leg", "lexical:timeout"] == 0.5 and got["stage", "total:p95"] == 50.0 and got["bundle", "unknown"] == 1 and got["mode", "voice"] == 1
    rules = [("total", "zero_result_rate", "delta", 0.2, 0.0, "warning"), ("stage", "*", "ratio", 2.0, 20.0, "warning"), ("bundle", "*", "new", 0.0, 0.0, "info"), ("leg", "lexical:timeout", "above", 0.6, 0.0, "critical")]
    assert {(r.name, r.severity) for r in monitoring.drift(base, now, rules).collect()} == {("zero_result_rate", "warning"), ("total:p50", "warning"), ("total:p95", "warning"), ("b", "info"), ("unknown", "info")}
    assert monitoring.search_summary(log([])).filter("name = 'searches'").first().value == 0


def test_signed_means_and_load(spark):
    df = spark.createDataFrame([("f", 2.0), ("f", -1.0), ("f", float("nan")), ("f", None), ("g", float("inf"))], "feature string, value double")
    assert [tuple(r) for r in monitoring.signed_means(df).collect()] == [("f", 2, 2.0, 1.0, 1, 0.5)]
    samples = spark.createDataFrame([("search", 200, None), ("search", 500, None), ("event", 200, True), ("event", 200, False), ("event", None, True)], "kind string, status int, stored boolean")
    assert tuple(monitoring.load_report(samples).first()) == (2, 1, 0.5, 2, 1, 0.5)
    assert tuple(monitoring.load_report(samples.limit(0)).first()) == (0, 0, 0.0, 0, 0, None)


def test_speech(spark):
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("xyz") for _ in range(rng.randrange(6))] for _ in range(2))
        best: dict = {(0, 0): (0, 0, 0, 0)}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                options = [best[0, 0]] if i == j == 0 else []
                if i and j:
                    c, s, d, n = best[i - 1, j - 1]
                    options.append((c + (a[i - 1] != b[j - 1]), s + (a[i - 1] != b[j - 1]), d, n))
                if i:
                    c, s, d, n = best[i - 1, j]
                    options.append((c + 1, s, d + 1, n))
                if j:
                    c, s, d, n = best[i, j - 1]
                    options.append((c + 1, s, d, n + 1))
                best[i, j] = min(options)
        assert speech.edit_operations(a, b) == best[len(a), len(b)][1:]
    assert speech.spoken("Straße im Café, N°5 москва") == ["stra", "e", "im", "cafe", "n", "5"]
    df = spark.createDataFrame([("Ana Lopes", "we met anna lopes today"), ("Jo", "jo"), ("Jo", None), ("", "x")], "e string, h string").withColumns({"pe": speech.plain(F.col("e")), "ph": speech.plain(F.col("h"))})
    got = [tuple(r.m) for r in df.withColumn("m", speech.entity_match(F.col("pe"), F.col("ph"))).collect()]
    assert [(f, c, round(x, 3)) for f, c, x in got] == [(False, "anna lopes", 0.111), (True, "jo", 0.0), (False, "", 1.0), (False, "x", 1.0)]
    bins = spark.createDataFrame([(0.0,), (0.1,), (0.25,), (0.4,), (3.0,)], "v double").select(speech.value_bin(F.col("v"), (0.25, 0.5)).alias("b")).collect()
    assert [r.b for r in bins] == ["0", "(0, 0.25]", "(0, 0.25]", "(0.25, 0.5]", "> 0.5"]


def test_jobs_and_references(spark):
    jobs = spark.createDataFrame([("k", "a"), ("k", None)], "kind string, key string")
    asked = spark.createDataFrame([(1, "k", "a"), (2, "k", "b"), (3, "k", "b"), (4, "l", "a"), (5, "k", None), (6, "k", None)], "position long, kind string, key string")
    assert sorted(r.position for r in catalog.enqueue(jobs, asked).collect()) == [2, 4, 5, 6]
    t = datetime(2024, 1, 1)
    state = spark.createDataFrame([(1, "running", 1, 3, t), (2, "running", 3, 3, t), (3, "running", 1, 3, None), (4, "pending", 1, 3, t)], "id long, status string, attempts int, most int, lease_expires_at timestamp")
    assert rows(catalog.reaped(state, F.lit(datetime(2024, 1, 2)))) == [(1, "pending", None), (2, "dead", "lease expired after final attempt")]
    j = spark.createDataFrame([("q", 1), ("x", 1), (None, 9)], "query_id string, episode_id long")
    got = catalog.unknown_references(j, {"query_id": spark.createDataFrame([("q",)], "query_id string"), "episode_id": spark.createDataFrame([(1,)], "episode_id long")})
    assert rows(got) == sorted([("query_id", "x", 1), ("query_id", None, 1), ("episode_id", "9", 1)], key=str)
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c"), (3, None)], "k long, v string")
    assert rows(catalog.merge_replace(old, new, ["k"])) == [(1, "a"), (2, "c"), (3, None)]


def test_alerts_and_batches(spark):
    folder = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rules = [("all", "1 hour", "1 hour", "true", "event_type = 'error'", 0.0, 1), ("none", "1 hour", "1 hour", "event_type = 'absent'", "true", 0.0, 1)]
    got = events.alerts(e, "ts", rules)
    want = e.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count_if(F.col("event_type") == "error").alias("bad")).filter("bad > 0").count()
    assert got.filter("rule = 'all'").count() == want and got.filter("rule = 'none'").count() == 0
    stream = events.stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    later = events.drain(events.alerts(stream, "ts", rules[:1], "10 minutes"), "alerts")
    assert 0 <= want - later.count() <= 3  # the last windows stay open under the watermark
    done = events.split_batches(events.stream(spark, folder, "events"), {"a": lambda b: b.select("event_id"), "b": lambda b: b.filter("event_id % 2 = 0").select("event_id")}, "t")
    assert done["a"].count() == e.count() and done["b"].count() == e.filter("event_id % 2 = 0").count()


def test_files(spark, tmp_path):
    xml = """<rss xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd" xmlns:podcast="https://podcastindex.org/namespace/1.0"><channel><title>S</title><link> http://s </link><itunes:author>Ana</itunes:author><itunes:image href="http://i"/>
    <item><title>One</title><link>http://e</link><itunes:image href="http://j"/><podcast:transcript url="http://t.vtt" type="text/vtt" language="en"/><podcast:transcript type="text/srt"/></item></channel></rss>"""
    r = files.parse_feeds(spark.createDataFrame([(1, xml)], "id long, doc string"), "id", "doc").first()
    assert (r.feed_publisher, r.feed_image, r.feed_link, r.image, r.link) == ("Ana", "http://i", "http://s", "http://j", "http://e")
    assert [tuple(t) for t in r.transcripts] == [("http://t.vtt", "text/vtt", "en")]
    df = spark.createDataFrame([(2, None), (1, "a")], "id long, v string")
    files.write_lines(df, f"{tmp_path}/x.jsonl")
    assert rows(files.read_any(spark, f"{tmp_path}/x.jsonl").select("id", "v")) == rows(df)
    name = files.write_snapshot(spark, {"t": (df, "id")}, str(tmp_path))
    assert files.write_snapshot(spark, {"t": (df.repartition(3), "id")}, str(tmp_path)) == name and files.latest(spark, str(tmp_path)).endswith(name)
    other = files.write_snapshot(spark, {"t": (df.limit(1), "id")}, str(tmp_path))
    assert other != name and [r.id for r in spark.read.parquet(files.latest(spark, str(tmp_path)) + "/t.parquet").collect()] == [2]


def test_no_machine_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext = Context()  # noqa: N815

    with pytest.raises(RuntimeError):
        shared_folder(Session())
