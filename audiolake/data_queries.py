"""Queries of datasets, evaluation runs, contracts, logs, jobs and events over the test tables, and the SQL that states the same results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from audiolake.functions import numbers, text
from audiolake.operators import candidates, catalog, contract, datasets, metrics, monitoring, retrieval, speech, vectors
from audiolake.queries import _DIVERSE, _SYNTHETIC, _examples, _neighbours, _qrels
from audiolake.queries import _QRELS as QRELS
from audiolake.registry import hex_number, norm, query, words
from audiolake.search_queries import _SYSTEMS, FOUND, VECTORS, _lexical, _vector_leg, catalogue, system_rows
from audiolake.session import read_table, store
from audiolake.streaming import events as streams

NOW = datetime(2026, 10, 1)
NOW_US = "epoch_us(TIMESTAMP '2026-10-01')"


# --- scans and catalogue ---------------------------------------------------------------------------------------


@query("""SELECT t.episode_id, h AS excerpt_hash, CASE WHEN was IS NULL THEN 'missing' ELSE 'stale' END AS reason FROM (SELECT episode_id, substr(sha256(left(content, 2000)), 1, 32) AS h FROM transcripts WHERE trim(content) <> '') t
LEFT JOIN (SELECT episode_id, max(content_hash) AS was FROM episode_embeddings WHERE model = 'e5' GROUP BY 1) d ON d.episode_id = t.episode_id WHERE was IS NULL OR was <> h""")
def transcript_pending(spark, d):
    return catalog.excerpts_pending(read_table(spark, d, "transcripts"), read_table(spark, d, "episode_embeddings").filter("model = 'e5'"), 2000)


@query("""SELECT e.id, row_number() OVER (ORDER BY e.id) - 1 AS position, t.c IS NOT NULL AS has_transcript, coalesce(t.c, 0) AS transcript_chars FROM episodes e LEFT JOIN (SELECT episode_id, max(length(coalesce(content, ''))) AS c FROM transcripts GROUP BY 1) t ON t.episode_id = e.id""")
def catalog_snapshot(spark, d):
    done = catalog.snapshot(read_table(spark, d, "episodes"), read_table(spark, d, "transcripts"))
    return done.select("id", "position", "has_transcript", "transcript_chars")


@query("""SELECT id, podcast_id FROM episodes WHERE podcast_id % 7 <> 0""")
def episodes_after_delete(spark, d):
    gone = read_table(spark, d, "podcasts").filter(F.col("id") % 7 == 0).select(F.col("id").alias("podcast_id"))
    return catalog.without(gone, read_table(spark, d, "episodes"), "podcast_id").select("id", "podcast_id")


@query("""SELECT episode_id, model, CASE WHEN n.h IS NOT NULL THEN n.h ELSE o.h END AS content_hash FROM (SELECT episode_id, model, max(content_hash) AS h FROM episode_embeddings GROUP BY 1, 2) o FULL JOIN (SELECT id AS episode_id, 'e5' AS model, content_hash AS h FROM episodes WHERE id % 3 = 0 AND content_hash IS NOT NULL) n USING (episode_id, model)""")
def upsert_replace(spark, d):
    old = read_table(spark, d, "episode_embeddings").groupBy("episode_id", "model").agg(F.max("content_hash").alias("content_hash"))
    new = read_table(spark, d, "episodes").filter("id % 3 = 0 AND content_hash IS NOT NULL").select(F.col("id").alias("episode_id"), F.lit("e5").alias("model"), "content_hash")
    return catalog.merge_replace(old, new, ["episode_id", "model"])


@query("""SELECT 'query_id' AS reference, query_id AS value, count(*) AS rows FROM judgments WHERE query_id IS NULL OR query_id NOT IN (SELECT query_id FROM relevance_queries) GROUP BY 2
UNION ALL SELECT 'episode_id', CAST(episode_id AS VARCHAR), count(*) FROM judgments WHERE episode_id IS NULL OR episode_id NOT IN (SELECT id FROM episodes) GROUP BY 2""")
def unknown_references(spark, d):
    known = {"query_id": read_table(spark, d, "relevance_queries"), "episode_id": read_table(spark, d, "episodes").select(F.col("id").alias("episode_id"))}
    return catalog.unknown_references(read_table(spark, d, "judgments"), known)


@query(f"""SELECT m AS model, coalesce(n, 0) AS n, round(({NOW_US} - newest) / 1000000.0, 3) AS age_seconds FROM (SELECT unnest(['e5', 'two-tower:a1', 'e5-transcript']) AS m) LEFT JOIN (SELECT model, count(*) AS n, epoch_us(max(created_at)) AS newest FROM episode_embeddings GROUP BY 1) c ON c.model = m""")
def index_ages(spark, d):
    return catalog.freshness(read_table(spark, d, "episode_embeddings"), ["e5", "two-tower:a1", "e5-transcript"], F.lit(NOW)).withColumn("age_seconds", F.round("age_seconds", 3))


@query("""SELECT id, 'feed:' || CAST(id AS VARCHAR) || ':' || CAST(epoch(TIMESTAMP '2026-10-01')::BIGINT // 3600 AS VARCHAR) AS key FROM (SELECT id, CASE WHEN id % 5 <> 0 THEN created_at + INTERVAL 1500 DAY END AS next_at FROM podcasts) WHERE next_at IS NULL OR next_at <= TIMESTAMPTZ '2026-10-01 00:00:00+00' ORDER BY next_at NULLS FIRST, id LIMIT 500""")
def due_feeds(spark, d):
    feeds = read_table(spark, d, "podcasts").select("id", F.when(F.col("id") % 5 != 0, F.col("created_at") + F.expr("INTERVAL 1500 DAY")).alias("next_at"))
    return catalog.due(feeds, "next_at", F.lit(NOW), 3600)


@query("""WITH a AS (SELECT event_id AS position, event_type AS kind, CASE WHEN event_id % 4 <> 0 THEN CAST(user_id AS VARCHAR) END AS key FROM events), j AS (SELECT DISTINCT kind, key FROM a WHERE position % 10 = 0 AND key IS NOT NULL)
SELECT kind, key, position FROM a WHERE key IS NULL UNION ALL SELECT kind, key, min(position) FROM a WHERE key IS NOT NULL AND (kind, key) NOT IN (SELECT (kind, key) FROM j) GROUP BY 1, 2""")
def enqueue_once(spark, d):
    asked = read_table(spark, d, "events").select(F.col("event_id").alias("position"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 4 != 0, F.col("user_id").cast("string")).alias("key"))
    return catalog.enqueue(asked.filter("position % 10 = 0"), asked).select("kind", "key", "position")


@query("""SELECT event_id AS id, CASE WHEN user_id % 6 >= 4 THEN 'dead' ELSE 'pending' END AS status, CASE WHEN user_id % 6 >= 4 THEN 'lease expired after final attempt' END AS last_error FROM events WHERE event_type = 'error' AND ts < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def reap_leases(spark, d):
    e = read_table(spark, d, "events")
    newest = e.agg(F.max("ts")).first()[0]
    jobs = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "running").otherwise("completed").alias("status"), (F.col("user_id") % 6).alias("attempts"), F.lit(4).alias("most"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("lease_expires_at"))
    return catalog.reaped(jobs, F.lit(newest))


@query("""SELECT event_id AS id, user_id % 6 + 1 AS attempts FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 50""")
def claim_jobs(spark, d):
    e = read_table(spark, d, "events")
    jobs = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "pending").otherwise("completed").alias("status"), (F.col("user_id") % 6).alias("attempts"), F.col("ts").cast("timestamp").alias("run_at"))
    return streams.claim(jobs, datetime(2100, 1, 1), 50).select("id", "attempts")


# --- popularity, coverage and lists ----------------------------------------------------------------------------

_TOP = "top AS (SELECT id AS podcast_id, popularity FROM podcasts WHERE popularity > 0 AND popularity >= (SELECT min(popularity) FROM (SELECT popularity FROM podcasts ORDER BY popularity DESC NULLS LAST LIMIT (SELECT greatest(count(*) // 10 - 1, 0) + 1 FROM podcasts))))"


@query(f"WITH {_TOP} SELECT (SELECT count(*) FROM top) AS shows, count(*) AS episodes, round(count(*) FILTER (podcast_id IN (SELECT podcast_id FROM top)) / count(*), 6) AS top_decile_share FROM episodes")
def catalog_stats(spark, d):
    top = metrics.top_decile(read_table(spark, d, "podcasts")).withColumn("hit", F.lit(1))
    e = read_table(spark, d, "episodes").join(top.select("podcast_id", "hit"), "podcast_id", "left")
    return e.agg(F.count(F.lit(1)).alias("episodes"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("top_decile_share")).crossJoin(top.agg(F.count(F.lit(1)).alias("shows"))).select("shows", "episodes", "top_decile_share")  # one row each


@query(f"""WITH {_DIVERSE}, {_TOP}, l AS (SELECT s.*, {norm('e.title')} AS name FROM shown s JOIN episodes e ON e.id = s.id)
SELECT source_id, count(*) AS n, round(count(*) FILTER (show <> source_show) / count(*), 6) AS novelty, count(DISTINCT show) AS shows, round((count(*) - count(DISTINCT name)) / count(*), 6) AS repetition, round(count(*) FILTER (show IN (SELECT podcast_id FROM top)) / count(*), 6) AS top_decile_share, round(avg(1 - distance), 6) AS sim_mean, round(min(1 - distance), 6) AS sim_min FROM l GROUP BY 1""")
def similar_lists(spark, d):
    rows = retrieval.diversify(_neighbours(spark, d), 10).withColumn("similarity", 1 - F.col("distance"))
    rows = rows.join(read_table(spark, d, "episodes").select("id", "title"), "id")
    return metrics.list_report(rows, metrics.top_decile(read_table(spark, d, "podcasts")))


@query(f"""WITH {_DIVERSE}, p AS (SELECT a.source_id, list_dot_product(x.v, y.v) / (x.l * y.l) AS s FROM shown a JOIN shown b ON a.source_id = b.source_id AND a.id < b.id JOIN u x ON x.id = a.id JOIN u y ON y.id = b.id)
SELECT n.source_id, vectors, CASE WHEN vectors > 1 THEN round(1 - m, 6) END AS diversity FROM (SELECT source_id, count(*) AS vectors FROM shown GROUP BY 1) n LEFT JOIN (SELECT source_id, avg(s) AS m FROM p GROUP BY 1) q ON q.source_id = n.source_id""")
def list_diversity(spark, d):
    lists = retrieval.diversify(_neighbours(spark, d), 10).select("source_id", F.col("id").alias("episode_id"))
    return vectors.list_diversity(lists, "source_id", vectors.of_model(read_table(spark, d, "episode_embeddings"), "e5"))


@query(f"""WITH {_SYSTEMS}, h AS (SELECT podcast_id FROM (SELECT podcast_id, row_number() OVER (ORDER BY count(*) DESC, podcast_id) AS place FROM episodes GROUP BY 1) WHERE place <= (SELECT greatest(1, floor(count(DISTINCT podcast_id) * 0.1)) FROM episodes))
SELECT system, count(*) AS results, count(DISTINCT episode_id) AS distinct_items, round(count(DISTINCT episode_id) / (SELECT count(*) FROM episodes), 6) AS catalog_coverage, round(count(*) FILTER (podcast_id NOT IN (SELECT podcast_id FROM h)) / count(*), 4) AS tail_coverage FROM runs JOIN episodes e ON e.id = runs.episode_id GROUP BY 1""".replace("h AS (SELECT podcast_id", "hs AS (SELECT podcast_id").replace("FROM h))", "FROM hs))"))
def system_coverage(spark, d):
    e = read_table(spark, d, "episodes")
    head = metrics.head_shows(e.groupBy("podcast_id").agg(F.count(F.lit(1)).alias("episodes")), 0.1)
    return metrics.coverage(system_rows(spark, d), e.select("id", "podcast_id"), head)


# --- evaluation of several systems -----------------------------------------------------------------------------

_SYSTEM_METRICS = f"""{_SYSTEMS}, {QRELS}, base AS (SELECT query_id, count(*) FILTER (grade >= 1) AS relevant, sum(CASE WHEN i <= 10 THEN (power(2.0, grade) - 1) / log2(i + 1) ELSE 0 END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, episode_id) AS i FROM qrels) GROUP BY 1 HAVING count(*) FILTER (grade >= 1) > 0),
jr AS (SELECT r.system, r.query_id, r.rank, q.grade, CAST(coalesce(q.grade >= 1, false) AS INTEGER) AS rel FROM runs r LEFT JOIN qrels q ON q.query_id = r.query_id AND q.episode_id = r.episode_id),
fr AS (SELECT system, query_id, sum(rel) AS n, min(rank) FILTER (rel = 1) AS first, sum(CASE WHEN grade IS NOT NULL THEN (power(2.0, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg FROM jr GROUP BY 1, 2),
sm AS (SELECT s.system, b.query_id, round(coalesce(n, 0) / relevant, 6) AS recall_10, round(coalesce(dcg / nullif(ideal, 0), 0), 6) AS ndcg_10, round(coalesce(1.0 / first, 0), 6) AS mrr FROM base b CROSS JOIN (SELECT DISTINCT system FROM runs) s LEFT JOIN fr ON fr.system = s.system AND fr.query_id = b.query_id)"""


def _system_metrics(spark, d):
    """(system, query_id, recall_10, ndcg_10, mrr) of all systems in one plan: a system's query is a query of its own.

    Runs and metrics, a few rows for each query, are stored: both are read several times, and a plan with all that made them would hold it as often.
    """
    runs, q = store(system_rows(spark, d), "runs"), _qrels(spark, d)
    key = lambda c="system": F.concat_ws("|", c, "query_id")
    systems = F.explode(F.array(*[F.lit(s) for s in sorted(candidates.SYSTEMS)])).alias("system")
    graded = q.select("*", systems).select(key().alias("query_id"), "episode_id", "grade")
    per = metrics.per_query(runs.select(key().alias("query_id"), "episode_id", "rank"), graded, (10,))
    return store(per.select(F.split("query_id", r"\|")[0].alias("system"), F.split("query_id", r"\|")[1].alias("query_id"), "recall_10", "ndcg_10", "mrr"), "metrics")


@query(f"WITH {_SYSTEM_METRICS} SELECT system, count(*) AS queries, round(avg(ndcg_10), 4) AS ndcg_10, round(avg(mrr), 4) AS mrr, round(avg(recall_10), 4) AS recall_10 FROM sm GROUP BY 1")
def compare_systems(spark, d):
    mean = lambda c: F.round(F.avg(c), 4).alias(c)
    return _system_metrics(spark, d).groupBy("system").agg(F.count(F.lit(1)).alias("queries"), mean("ndcg_10"), mean("mrr"), mean("recall_10"))


_COHORTS = f"{_SYSTEM_METRICS}, vals AS (SELECT system, query_type AS cohort, round(avg(ndcg_10), 6) AS value, count(*) AS queries FROM sm JOIN relevance_queries q USING (query_id) GROUP BY 1, 2)"


@query(f"WITH {_COHORTS} SELECT v.system, 'query type' AS section, v.cohort, b.system AS baseline, v.value, b.value AS base, round(v.value - b.value, 4) AS delta FROM vals v JOIN vals b ON b.cohort = v.cohort AND b.system IN ('lexical', 'rrf3') WHERE v.system NOT IN ('lexical', 'rrf3') AND v.queries >= 10 AND v.value < b.value - 0.05")
def cohort_regressions(spark, d):
    """Query types in which a system falls short of the lexical or the fused one."""
    rows = _system_metrics(spark, d).join(read_table(spark, d, "relevance_queries").select("query_id", "query_type"), "query_id")
    vals = rows.groupBy("system", F.col("query_type").alias("cohort")).agg(F.round(F.avg("ndcg_10"), 6).alias("value"), F.count(F.lit(1)).alias("queries")).withColumn("section", F.lit("query type"))
    return metrics.regressions(vals, ["lexical", "rrf3"])


@query(f"""WITH {_SYSTEM_METRICS}, v AS (SELECT system, unnest([{{'m': 'ndcg_10', 'v': round(avg(ndcg_10), 4)}}, {{'m': 'mrr', 'v': round(avg(mrr), 4)}}]) AS s FROM sm GROUP BY 1), e AS (SELECT * FROM (VALUES ('lexical', 'ndcg_10', 2.0), ('lexical', 'mrr', 0.5), ('e5', 'ndcg_10', 0.0)) t(system, metric, want))
SELECT v.system, s.m AS metric, CASE WHEN v.system NOT IN (SELECT system FROM e) THEN 'no recorded expectation' WHEN want IS NULL THEN 'missing' ELSE 'off' END AS problem FROM v LEFT JOIN e ON e.system = v.system AND e.metric = s.m WHERE v.system NOT IN (SELECT system FROM e) OR want IS NULL OR abs(s.v - want) > 1""")
def reproduction_problems(spark, d):
    """Metrics against recorded ones, of which some are planted too far off or missing."""
    means = _system_metrics(spark, d).groupBy("system").agg(*[F.round(F.avg(c), 4).alias(c) for c in ("ndcg_10", "mrr")])
    long = means.select("system", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("ndcg_10", "mrr")])).alias("s")).select("system", "s.*")
    want = spark.createDataFrame([("lexical", "ndcg_10", 2.0), ("lexical", "mrr", 0.5), ("e5", "ndcg_10", 0.0)], "system string, metric string, value double")
    found = metrics.reproduced(long, want, ["ndcg_10", "mrr"], 1.0)
    return found.withColumn("problem", F.when(F.col("problem").contains("expected"), "off").otherwise(F.col("problem")))


@query(f"WITH {_SYSTEM_METRICS}, p AS (SELECT a.query_id, round(a.ndcg_10 - b.ndcg_10, 9) AS difference FROM sm a JOIN sm b USING (query_id) WHERE a.system = 'rrf3' AND b.system = 'lexical') SELECT count(*) AS queries, count(*) FILTER (difference > 0) AS wins, count(*) FILTER (difference = 0) AS ties, count(*) FILTER (difference < 0) AS losses, round(avg(difference), 6) AS mean FROM p")
def paired_wins(spark, d):
    m = _system_metrics(spark, d)
    return metrics.wins(metrics.paired(m.filter("system = 'rrf3'"), m.filter("system = 'lexical'"), "ndcg_10"))


@query()
def bootstrap_paired(spark, d):
    """Interval of the paired difference; tested on fixtures, since SQL cannot draw the same weights."""
    m = _system_metrics(spark, d)
    return metrics.bootstrap(metrics.paired(m.filter("system = 'rrf3'"), m.filter("system = 'lexical'"), "ndcg_10"))


_SYN_Q = lambda part: part.replace("relevance_queries", "sq")
_SYN_LEGS = f"""{_SYNTHETIC}, sq AS (SELECT example_id AS query_id, query_text, '' AS filter_language, 0 AS filter_max_seconds FROM syn), {_SYN_Q(FOUND)}, {_SYN_Q(_lexical(30, 'l30'))}, {_SYN_Q(VECTORS)}, {_SYN_Q(_vector_leg('e5', 30, 'v30'))}"""


def _example_catalogue(spark, d):
    ex = store(_examples(spark, d), "examples")  # every plan of the catalogue reads them
    c = catalogue(spark, d)
    asked = ex.select(F.col("example_id").alias("query_id"), "query_text", F.lit("").alias("filter_language"), F.lit(0).alias("filter_max_seconds"))
    return ex, candidates.Catalogue(c.episodes, c.podcasts, c.transcripts, c.embeddings, asked)


_MINED = f"""{_SYN_LEGS}, hits AS (SELECT 'lexical' AS system, query_id, episode_id, rank FROM l30 UNION ALL SELECT 'e5', query_id, episode_id, rank FROM v30),
mined AS (SELECT example_id, h.episode_id, min(rank) AS best_rank, array_to_string(list_sort(list(system || ':' || CAST(rank AS VARCHAR))), ',') AS sources FROM hits h JOIN syn ON syn.example_id = h.query_id JOIN episodes e ON e.id = h.episode_id WHERE h.episode_id <> positive_id AND e.podcast_id <> show GROUP BY 1, 2)"""


def _mined(spark, d):
    ex, c = _example_catalogue(spark, d)
    runs = candidates.run("lexical", c, 30).withColumn("system", F.lit("lexical")).unionByName(candidates.run("e5", c, 30).withColumn("system", F.lit("e5")))
    return ex, datasets.mined(ex, runs, c.episodes.select("id", "podcast_id"))


@query(f"WITH {_MINED} SELECT * FROM mined")
def hard_negative_mining(spark, d):
    """What two systems find for titles as queries, without the episode and its show."""
    return _mined(spark, d)[1]


_DRAWS = f"""w AS (SELECT id, (count(*) OVER (PARTITION BY podcast_id))::BIGINT AS weight FROM episodes), cw AS (SELECT id, (sum(weight) OVER (ORDER BY id) - weight)::DOUBLE AS lo, sum(weight) OVER (ORDER BY id)::DOUBLE AS hi FROM w), wsum AS (SELECT sum(weight)::DOUBLE AS total FROM w),
draws AS (SELECT example_id, k, id FROM (SELECT example_id, k, {hex_number("sha256('42:pop:' || example_id || ':' || CAST(k AS VARCHAR))", 1, 12)}::DOUBLE / 281474976710656.0 AS x FROM syn, (SELECT unnest(range(4)) AS k)) JOIN wsum ON true JOIN cw ON x >= lo / total AND x < hi / total)"""


def _weighted(spark, d, ex):
    e = read_table(spark, d, "episodes").select("id", "podcast_id")
    sizes = e.groupBy("podcast_id").agg(F.count(F.lit(1)).alias("weight"))
    return datasets.weighted_draws(ex.select("example_id"), "example_id", e.join(sizes, "podcast_id").select("id", "weight"), 4, 42, "pop")


@query(f"WITH {_SYNTHETIC}, {_DRAWS} SELECT example_id, CAST(k AS INTEGER) AS k, id AS episode_id FROM draws")
def popularity_weighted_negatives(spark, d):
    """Draws in proportion to the size of an episode's show."""
    return _weighted(spark, d, _examples(spark, d)).withColumnRenamed("id", "episode_id")


@query(f"""WITH {_MINED}, {_DRAWS}, ring AS (SELECT id AS negative_id, row_number() OVER (ORDER BY sha256('42:ring:' || CAST(id AS VARCHAR)), id) - 1 AS spot FROM episodes), c AS (SELECT count(*) AS size FROM ring),
dd AS (SELECT example_id, positive_id, size, {hex_number("sha256('42:neg:' || example_id)", 1, 13)} AS s, 1 + {hex_number("sha256('42:stride:' || example_id)", 1, 13)} % greatest(1, (size - 1) // 8) AS t FROM syn, c),
uni AS (SELECT example_id, negative_id, row_number() OVER (PARTITION BY example_id ORDER BY k) AS p FROM (SELECT example_id, positive_id, k, (s + k * t) % size AS spot FROM dd, (SELECT unnest(range(9)) AS k)) JOIN ring USING (spot) WHERE negative_id <> positive_id QUALIFY p <= 8),
alls AS (SELECT example_id, episode_id AS negative_id, 0 AS o, 'hard' AS source, best_rank AS p FROM mined WHERE best_rank <= 3 UNION ALL SELECT example_id, id, 1, 'popular', k + 1 FROM draws WHERE k < 2 UNION ALL SELECT example_id, negative_id, 2, 'uniform', p FROM uni),
one AS (SELECT a.example_id, negative_id, min({{'o': o, 'p': p, 'source': source}}) AS b FROM alls a JOIN syn ON syn.example_id = a.example_id WHERE negative_id <> positive_id GROUP BY 1, 2)
SELECT example_id, negative_id, b.source AS source, row_number() OVER (PARTITION BY example_id ORDER BY b.o, b.p, negative_id) AS place FROM one QUALIFY place <= 8""")
def mixed_negatives(spark, d):
    """Hard, popular and uniform negatives in this order, eight for each example."""
    ex, hard = _mined(spark, d)
    hard = hard.select("example_id", F.col("episode_id").alias("negative_id"), F.col("best_rank").alias("place"))
    popular = _weighted(spark, d, ex).select("example_id", F.col("id").alias("negative_id"), (F.col("k") + 1).alias("place"))
    uniform = datasets.negatives(ex, read_table(spark, d, "episodes").select("id"), 8, 42)
    return datasets.mixed_negatives(ex, hard, popular, uniform, 8, 3, 2)


@query(f"""WITH {_SYN_LEGS}, pool AS (SELECT episode_id, v, l FROM vec WHERE m = 'e5' AND episode_id IN (SELECT positive_id FROM syn)), sm AS (SELECT query_id, s.episode_id AS id, s.s FROM sims s JOIN pool USING (episode_id) WHERE m = 'e5'),
r AS (SELECT a.query_id, 1 + count(*) FILTER (a.s > t.s) AS place FROM sm a JOIN (SELECT query_id, s FROM sm JOIN syn ON syn.example_id = sm.query_id AND syn.positive_id = sm.id) t USING (query_id) GROUP BY 1)
SELECT count(*) AS queries, (SELECT count(*) FROM pool) AS pool, round(avg(1.0 / place), 4) AS mrr, round(avg(CASE WHEN place <= 1 THEN 1.0 ELSE 0 END), 4) AS recall_1, round(avg(CASE WHEN place <= 10 THEN 1.0 ELSE 0 END), 4) AS recall_10 FROM r""")
def split_scores(spark, d):
    """Ranks of the positives among the shared pool of all examples' positives."""
    ex, c = _example_catalogue(spark, d)
    pool = vectors.of_model(c.embeddings, "e5").join(ex.select(F.col("positive_id").alias("episode_id")).distinct(), "episode_id", "left_semi").withColumnRenamed("episode_id", "id")
    asked = vectors.encoded_queries(c.queries, ["e5"]).select("query_id", "embedding")
    places = metrics.split_ranks(ex.select(F.col("example_id").alias("query_id"), "positive_id"), metrics.pool_similarities(asked, pool))
    hit = lambda k: F.round(F.avg((F.col("place") <= k).cast("double")), 4).alias(f"recall_{k}")
    return places.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(1.0 / F.col("place")), 4).alias("mrr"), hit(1), hit(10)).crossJoin(pool.agg(F.count(F.lit(1)).alias("pool"))).select("queries", "pool", "mrr", "recall_1", "recall_10")  # one row each


@query(f"""WITH {_SYSTEMS}, {QRELS}, pl AS (SELECT query_id, episode_id, min(rank) AS rank, array_to_string(list_sort(list_distinct(list(system))), '+') AS src FROM runs GROUP BY 1, 2), g AS (SELECT pl.*, grade FROM pl JOIN qrels USING (query_id, episode_id)),
k AS (SELECT grade, unnest([{{'g': 'all', 'v': ''}}, {{'g': 'rank', 'v': CASE WHEN rank <= 5 THEN '1-5' WHEN rank <= 10 THEN '6-10' WHEN rank <= 20 THEN '11-20' ELSE '21+' END}}, {{'g': 'source', 'v': src}}, {{'g': 'grade', 'v': CAST(grade AS VARCHAR)}}]) AS s FROM g)
SELECT s.g AS "grouping", s.v AS value, count(*) AS pairs, round(avg(CASE WHEN grade >= 2 THEN 1.0 ELSE 0 END), 3) AS relevant_share FROM k GROUP BY 1, 2""")
def audit_shares(spark, d):
    """How many of the pooled, judged pairs are relevant, by rank and by the systems that found them."""
    rows = store(system_rows(spark, d), "runs").groupBy("query_id", "episode_id").agg(F.min("rank").alias("rank"), F.collect_set("system").alias("sources"))  # a set of system names
    return monitoring.audit_shares(rows.join(_qrels(spark, d), ["query_id", "episode_id"]))


@query("""WITH q AS (SELECT query_id FROM (SELECT DISTINCT query_id FROM judgments WHERE query_id IS NOT NULL) ORDER BY sha256('42:audit:' || query_id), query_id LIMIT 20)
SELECT query_id, episode_id, place FROM (SELECT query_id, episode_id, row_number() OVER (PARTITION BY query_id ORDER BY sha256('42:auditpair:' || query_id || ':' || CAST(episode_id AS VARCHAR)), episode_id) AS place FROM (SELECT DISTINCT query_id, episode_id FROM judgments) JOIN q USING (query_id)) WHERE place <= 5""")
def audit_sample(spark, d):
    """Twenty queries in digest order, five judged pairs of each."""
    from audiolake.functions.hashing import order_key
    from pyspark.sql.window import Window

    pairs = read_table(spark, d, "judgments").select("query_id", "episode_id").filter("query_id IS NOT NULL").distinct()
    asked = pairs.select("query_id").distinct().orderBy(order_key(42, "audit", F.col("query_id")), "query_id").limit(20)
    w = Window.partitionBy("query_id").orderBy(order_key(42, "auditpair", F.concat_ws(":", "query_id", F.col("episode_id").cast("string"))), "episode_id")
    return pairs.join(asked, "query_id").withColumn("place", F.row_number().over(w)).filter("place <= 5")


@query(f"WITH {QRELS} SELECT query_id || ' 0 ' || CAST(episode_id AS VARCHAR) || ' ' || CAST(grade AS VARCHAR) AS line, row_number() OVER (ORDER BY query_id, episode_id) - 1 AS position FROM qrels")
def judgment_export(spark, d):
    """The lines of the judgments' text form in their order."""
    line = F.concat_ws(" ", "query_id", F.lit("0"), F.col("episode_id").cast("string"), F.col("grade").cast("string"))
    return datasets.numbered(_qrels(spark, d), [F.col("query_id"), F.col("episode_id")], "position").select(line.alias("line"), "position")


# --- dataset contracts -----------------------------------------------------------------------------------------

_EX = "ex AS (SELECT id AS positive_id, CASE WHEN id % 9 = 0 THEN '' ELSE title END AS query_text, CAST(id % 4 AS INTEGER) AS negatives, CASE id % 4 WHEN 0 THEN 'synthetic_query' WHEN 1 THEN 'topic_similarity' WHEN 2 THEN 'random_negative' ELSE 'human_judgment' END AS label_source FROM episodes)"
_CLASSES = {"synthetic_query": "synthetic", "topic_similarity": "weak", "random_negative": "weak", "human_judgment": "human", "search_play": "real"}


def _labelled(spark, d):
    kind = F.element_at(F.array(*[F.lit(s) for s in ("synthetic_query", "topic_similarity", "random_negative", "human_judgment")]), (F.col("id") % 4 + 1).cast("int"))
    return read_table(spark, d, "episodes").select(F.col("id").alias("positive_id"), F.when(F.col("id") % 9 == 0, "").otherwise(F.col("title")).alias("query_text"), (F.col("id") % 4).cast("int").alias("negatives"), kind.alias("label_source"), F.col("published_at").alias("event_time"))


_DIST = f"""{_EX}, tot AS (SELECT count(*)::DOUBLE AS examples, count(DISTINCT positive_id)::DOUBLE AS distinct_positives, count(DISTINCT nullif(coalesce(query_text, ''), ''))::DOUBLE AS distinct_queries, round(avg(CASE WHEN coalesce(query_text, '') = '' THEN 1.0 ELSE 0 END), 6) AS empty_query_share, min(negatives)::DOUBLE AS negatives_min, round(avg(negatives), 2) AS negatives_mean, max(negatives)::DOUBLE AS negatives_max,
 round(avg(CASE WHEN label_source = 'human_judgment' THEN 1.0 ELSE 0 END), 4) AS human_share, 0.0::DOUBLE AS real_share, round(avg(CASE WHEN label_source = 'synthetic_query' THEN 1.0 ELSE 0 END), 4) AS synthetic_share, round(avg(CASE WHEN label_source IN ('topic_similarity', 'random_negative') THEN 1.0 ELSE 0 END), 4) AS weak_share FROM ex),
rep AS (SELECT 'total' AS measure, name, value FROM (UNPIVOT tot ON COLUMNS(*) INTO NAME name VALUE value) UNION ALL SELECT 'source', label_source, count(*)::DOUBLE FROM ex GROUP BY 2)"""


@query(f"WITH {_DIST} SELECT * FROM rep")
def dataset_distribution(spark, d):
    return datasets.distribution(_labelled(spark, d), _CLASSES)


_LEAST, _MOST = {"examples": 100, "distinct_positives": 10, "real_share": 0.1, "negatives_min": 1}, {"weak_share": 0.4, "synthetic_share": 0.9, "empty_query_share": 0.05}


@query(f"""WITH {_DIST}, b AS (SELECT * FROM (VALUES {', '.join([f"('{n}', {v}::DOUBLE, 'min')" for n, v in _LEAST.items()] + [f"('{n}', {v}::DOUBLE, 'max')" for n, v in _MOST.items()])}) t(name, bound, kind)) SELECT b.name, value, bound, kind FROM rep JOIN b ON b.name = rep.name WHERE measure = 'total' AND (kind = 'min' AND value < bound OR kind = 'max' AND value > bound)""")
def dataset_distribution_failures(spark, d):
    return datasets.distribution_failures(datasets.distribution(_labelled(spark, d), _CLASSES), {k: float(v) for k, v in _LEAST.items()}, {k: float(v) for k, v in _MOST.items()})


_RULES = {
    "example_id": "id % 50 <> 0", "positive": "id % 41 <> 0", "strength": "id % 7 <> 0", "source": "id % 11 <> 0", "version": "id % 13 <> 0", "negatives_listed": "id % 17 <> 0", "history_listed": "true", "positive_not_negative": "id % 19 <> 0", "positive_not_in_history": "id % 23 <> 0", "not_in_future": "coalesce(published_at <= TIMESTAMPTZ '2024-01-01 00:00:00+00', false)",
}


@query(f"""WITH e AS (SELECT id, CASE WHEN id % 41 = 0 THEN -id ELSE id END AS positive, * EXCLUDE (id) FROM episodes), r AS (SELECT id, unnest([{', '.join(f"CASE WHEN NOT ({c}) THEN '{n}' END" for n, c in _RULES.items())}]) AS rule FROM e)
SELECT n AS rule, coalesce(c, 0) AS violations FROM (SELECT unnest(['{"', '".join([*_RULES, "unique"])}']) AS n) LEFT JOIN (SELECT rule, count(*) AS c FROM r WHERE rule IS NOT NULL GROUP BY 1) x ON x.rule = n""")
def example_contract(spark, d):
    """Counts of broken rules over examples with planted faults."""
    i = F.col("id")
    odd = lambda n, bad, good: F.when(i % n == 0, bad).otherwise(good)
    rows = read_table(spark, d, "episodes").select(
        i.alias("key"), odd(50, F.lit(""), F.concat(F.lit("syn:"), i.cast("string"))).alias("example_id"), odd(41, -i, i).alias("positive_id"), odd(7, F.lit(1.5), F.lit(0.5)).alias("label_strength"), odd(11, F.lit("guess"), F.lit("synthetic_query")).alias("label_source"), odd(13, F.lit("v1"), F.lit("1.0")).alias("dataset_version"),
        F.when(i % 17 == 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.array(i + 1)).alias("n"), F.when(i % 23 == 0, F.array(odd(41, -i, i))).otherwise(F.array().cast("array<bigint>")).alias("history"), F.col("published_at").alias("event_time"),
    )
    rows = rows.withColumn("negative_ids", F.when(F.col("key") % 19 == 0, F.concat("n", F.array(F.col("positive_id")))).otherwise(F.col("n"))).drop("n")
    rows = rows.withColumn("negative_ids", F.when((F.col("key") % 17 != 0) & (F.col("key") % 19 == 0) & (F.col("positive_id") < 0), F.array(F.col("positive_id"))).otherwise(F.col("negative_ids")))
    rules = datasets.example_rules(["synthetic_query", "topic_similarity"], F.lit("2024-01-01 00:00:00+00:00").cast("timestamp"))
    rules["negatives_listed"] = F.forall("negative_ids", lambda x: (x > 0) | (x == F.col("positive_id")))
    rules["history_listed"] = F.forall("history", lambda x: (x > 0) | (x == F.col("positive_id")))
    return datasets.contract(rows, "key", rules).select("rule", "violations")


@query("""WITH l AS (SELECT row_number() OVER (ORDER BY id, line) - 1 AS spot, line FROM (SELECT id, '{"id":' || CAST(id AS VARCHAR) || ',"podcast_id":' || CAST(podcast_id AS VARCHAR) || '}' AS line FROM episodes)), p AS (SELECT spot // 1000 AS piece, sha256(string_agg(line, chr(10) ORDER BY spot)) AS d, count(*) AS n FROM l GROUP BY 1), q AS (SELECT piece // 1000 AS part, sha256(string_agg(d, chr(10) ORDER BY piece)) AS d, sum(n) AS n FROM p GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(d, chr(10) ORDER BY part)) AS digest FROM q""")
def canonical_digest(spark, d):
    return datasets.canonical_digest(read_table(spark, d, "episodes"), "id", ["id", "podcast_id"])


_ORG = ", ".join(f"'{w}'" for w in contract.ORGANISATION_WORDS)
_PERSON = f"(coalesce(regexp_full_match(publisher, '[A-Z][a-z]+( [A-Z][a-z]+){{1,2}}'), false) AND NOT list_has_any(string_split(lower(coalesce(publisher, '')), ' '), [{_ORG}]))"


@query(f"SELECT id, {_PERSON} AS person FROM podcasts")
def person_publishers(spark, d):
    return read_table(spark, d, "podcasts").select("id", contract.looks_like_person(F.col("publisher")).alias("person"))


@query(f"""WITH s AS (SELECT p.*, coalesce(n, 0) AS n FROM podcasts p LEFT JOIN (SELECT podcast_id, count(*) AS n FROM episodes GROUP BY 1) c ON c.podcast_id = p.id WHERE starts_with(lower(coalesce(language, '')), 'en')),
t AS (SELECT q, max({{'n': n, 'i': -id}}) AS b FROM (SELECT {norm('title')} AS q, n, id FROM s) WHERE length(q) >= 3 GROUP BY 1 ORDER BY b DESC, q LIMIT 40),
o AS (SELECT q, max({{'n': n, 'i': -id}}) AS b FROM (SELECT {norm('publisher')} AS q, n, id FROM s WHERE {_PERSON}) WHERE length(q) >= 3 GROUP BY 1 ORDER BY b DESC, q LIMIT 60)
SELECT 'q' || substr(sha256(k || ':' || q), 1, 8) AS query_id, q AS query_text, k AS query_type FROM (SELECT q, 'navigational' AS k FROM t UNION ALL SELECT q, 'entity' FROM o WHERE q NOT IN (SELECT q FROM t))""")
def relevance_set(spark, d):
    return datasets.relevance_queries(read_table(spark, d, "episodes"), read_table(spark, d, "podcasts"), 40, 20)


# --- feature contract and speech -------------------------------------------------------------------------------

_CODE = "CASE string_split(replace(lower(trim(coalesce(language, ''))), '_', '-'), '-')[1] WHEN 'english' THEN 'en' WHEN 'spanish' THEN 'es' WHEN 'french' THEN 'fr' WHEN 'german' THEN 'de' WHEN 'portuguese' THEN 'pt' WHEN 'italian' THEN 'it' WHEN 'dutch' THEN 'nl' ELSE string_split(replace(lower(trim(coalesce(language, ''))), '_', '-'), '-')[1] END"
_CAT = "regexp_replace(lower(trim(c)), '\\s+', ' ', 'g')"


@query(f"""WITH lv AS (SELECT value, row_number() OVER (ORDER BY n DESC, value) AS id FROM (SELECT {_CODE} AS value, count(*) AS n FROM episodes GROUP BY 1) WHERE n >= 100 AND value <> ''),
cv AS (SELECT value, row_number() OVER (ORDER BY n DESC, value) - 1 AS id FROM (SELECT {_CAT} AS value, count(DISTINCT id) AS n FROM (SELECT id, unnest(categories) AS c FROM podcasts) GROUP BY 1) WHERE n >= 3 AND value <> ''),
pc AS (SELECT id, array_to_string(list_sort(list_distinct(list(cid))), ',') AS ids FROM (SELECT p.id, cv.id AS cid FROM (SELECT id, unnest(categories) AS c FROM podcasts) p JOIN cv ON cv.value = {_CAT}) GROUP BY 1)
SELECT e.id, coalesce(lv.id, 0) AS language_id, coalesce(pc.ids, '') AS category_ids, CASE WHEN duration_seconds IS NULL OR duration_seconds < 0 THEN 0 WHEN duration_seconds <= 300 THEN 1 WHEN duration_seconds <= 900 THEN 2 WHEN duration_seconds <= 1800 THEN 3 WHEN duration_seconds <= 2700 THEN 4 WHEN duration_seconds <= 3600 THEN 5 WHEN duration_seconds <= 5400 THEN 6 WHEN duration_seconds <= 7200 THEN 7 ELSE 8 END AS duration_bucket,
 CASE WHEN a IS NULL THEN 0 WHEN a <= 7 THEN 1 WHEN a <= 30 THEN 2 WHEN a <= 90 THEN 3 WHEN a <= 365 THEN 4 WHEN a <= 1095 THEN 5 ELSE 6 END AS age_bucket FROM (SELECT *, {_CODE} AS code, greatest(0.0, ({NOW_US} - epoch_us(published_at)) / 86400000000.0) AS a FROM episodes) e LEFT JOIN lv ON lv.value = e.code LEFT JOIN pc ON pc.id = e.podcast_id""".replace("(SELECT id, unnest(categories) AS c FROM podcasts) p JOIN cv ON cv.value = " + _CAT, "(SELECT id, unnest(categories) AS c FROM podcasts) p JOIN cv ON cv.value = " + _CAT.replace("(c)", "(p.c)")))
def feature_contract_ids(spark, d):
    """Vocabulary ids and buckets of every episode."""
    e, p = read_table(spark, d, "episodes").withColumn("code", contract.language_code(F.col("language"))), read_table(spark, d, "podcasts")
    languages = contract.vocabulary(e, "code", 100)
    named = p.select("id", F.explode("categories").alias("c")).select("id", contract.category_name(F.col("c")).alias("value")).distinct()
    known = contract.vocabulary(named, "value", 3).agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "value"))), lambda s: s["value"]).alias("known"))  # a vocabulary of shows' categories
    cats = p.crossJoin(F.broadcast(known)).select(F.col("id").alias("podcast_id"), F.array_join(contract.ids_of(F.col("categories"), F.col("known")).cast("array<string>"), ",").alias("category_ids"))  # one row
    rows = e.join(languages.select(F.col("value").alias("code"), F.col("id").alias("language_id")), "code", "left").join(cats, "podcast_id", "left")
    return rows.select("id", F.coalesce("language_id", F.lit(0)).alias("language_id"), F.coalesce("category_ids", F.lit("")).alias("category_ids"), numbers.bucket(F.col("duration_seconds") / 60.0, contract.DURATION_MINUTES).alias("duration_bucket"), numbers.bucket(numbers.age_days(F.col("published_at"), NOW), contract.AGE_DAYS).alias("age_bucket"))


@query("""SELECT query_id, 'query: ' || trim(coalesce(query_text, '')) AS passage, CASE WHEN trim(coalesce(filter_language, '')) <> '' THEN 1.0 ELSE 0.0 END AS has_language, CASE WHEN coalesce(filter_max_seconds, 0) <> 0 THEN 1.0 ELSE 0.0 END AS has_max_duration, 0.0 AS has_published_after, 0.0 AS no_explicit FROM relevance_queries""")
def query_features(spark, d):
    q = read_table(spark, d, "relevance_queries")
    flags = contract.intent_flags(F.col("filter_language"), F.col("filter_max_seconds"), F.lit(None).cast("date"), F.lit(False))
    return q.select("query_id", F.concat(F.lit(contract.QUERY_PREFIX), contract.tidy(F.col("query_text"))).alias("passage"), *flags)


@query("""SELECT id, CASE WHEN len(parts) > 0 THEN 'passage: ' || array_to_string(parts, '. ') ELSE '' END AS passage FROM (SELECT e.id, list_filter([nullif(trim(coalesce(p.title, '')), ''), nullif(trim(coalesce(e.title, '')), ''), 'Categories: ' || nullif(array_to_string(list_filter(list_transform(coalesce(p.categories, []), lambda c: trim(coalesce(c, ''))), lambda c: c <> ''), ', '), ''),
 'Publisher: ' || nullif(trim(coalesce(p.publisher, '')), ''), nullif(left(trim(coalesce(e.description, '')), 1000), '')], lambda x: x IS NOT NULL) AS parts FROM episodes e JOIN podcasts p ON p.id = e.podcast_id)""")
def episode_passages(spark, d):
    p = read_table(spark, d, "podcasts").select(F.col("id").alias("podcast_id"), F.col("title").alias("show_title"), "publisher", "categories")
    e = read_table(spark, d, "episodes").join(p, "podcast_id")
    return e.select("id", contract.passage(*(F.col(c) for c in ("show_title", "title", "description", "publisher", "categories"))).alias("passage"))


@query(f"""WITH t AS (SELECT query_id, {words('query_text')} AS w FROM relevance_queries), r AS (SELECT query_id, len(w) AS total, i, n, array_to_string(w[i:i + n - 1], ' ') AS run FROM t, (SELECT unnest(range(1, 30)) AS i), (SELECT unnest(range(1, 30)) AS n) WHERE i + n - 1 <= len(w)),
names AS (SELECT DISTINCT ' ' || {norm('x')} || ' ' AS name FROM (SELECT title AS x FROM podcasts UNION ALL SELECT publisher FROM podcasts)), hit AS (SELECT * FROM r WHERE EXISTS (SELECT 1 FROM names WHERE contains(name, ' ' || run || ' '))), best AS (SELECT query_id, arg_max(run, {{'n': n, 'i': -i}}) AS run, max(n) AS n FROM hit GROUP BY 1)
SELECT t.query_id, CASE WHEN run IS NULL OR (n = 1 AND len(w) > 1) THEN array_to_string(w, ' ') ELSE run END AS span FROM t LEFT JOIN best ON best.query_id = t.query_id""")
def entity_spans(spark, d):
    p = read_table(spark, d, "podcasts")
    return contract.entity_spans(read_table(spark, d, "relevance_queries"), p.select(F.col("title").alias("name")).union(p.select("publisher")))


_HEARD = "CASE WHEN e.id % 3 = 0 THEN e.title WHEN e.id % 3 = 1 THEN regexp_replace(e.title, '^(\\S+) \\S+', '\\1') ELSE regexp_replace(e.title, '^(\\S)', 'x') END"


def _heard(spark, d):
    """Titles as spoken, and as heard: unchanged, without the second word, or with another first letter."""
    i = F.col("id")
    heard = F.when(i % 3 == 0, F.col("title")).when(i % 3 == 1, F.regexp_replace("title", r"^(\S+) \S+", "$1")).otherwise(F.regexp_replace("title", r"^(\S)", "x"))
    return read_table(spark, d, "episodes").select("id", "language", "title", heard.alias("heard"))


@query()
def speech_degradation(spark, d):
    """Word errors, entity errors and the loss of title coverage by language, word error class and entity outcome; tested on fixtures against hand-made values."""
    rows = _heard(spark, d).withColumn("e", speech.word_errors(F.col("title"), F.col("heard"))).withColumns({"named": speech.plain(F.substring_index("title", ":", 1)), "said": speech.plain(F.col("heard"))})
    rows = rows.withColumn("m", F.array(speech.entity_match(F.col("named"), F.col("said"))))
    cover = lambda c: text.coverage(text.words(F.col("title")), text.words(F.col(c)))
    rows = rows.select("*", F.col("e.wer").alias("wer"), (~F.col("m")[0]["found"]).cast("double").alias("entity_error"), cover("title").alias("reference_coverage"), cover("heard").alias("heard_coverage"))
    groups = {"all": F.lit("all"), "language": contract.language_code(F.col("language")), "wer": speech.value_bin(F.col("wer"), (0.25, 0.5)), "entity": speech.entity_outcome(F.col("m"))}
    return speech.degradation(rows, groups, "coverage")


# --- serving logs ----------------------------------------------------------------------------------------------

_LOG = """lg AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'rrf' ELSE 'ranker' END AS ordering, CASE WHEN user_id % 2 = 0 THEN 'b1' ELSE 'b2' END AS bundle, CASE WHEN user_id % 5 = 0 THEN 'voice' ELSE 'text' END AS mode, CASE WHEN event_type = 'error' THEN 'timeout' ELSE 'ok' END AS lex, value, CAST(event_id % 4 AS INTEGER) AS n FROM events WHERE half)"""


def _log(spark, d, half=None):
    e = read_table(spark, d, "events")
    e = e if half is None else e.filter(F.col("event_id") % 2 == half)
    bad = F.col("event_type") == "error"
    n = (F.col("event_id") % 4).cast("int")
    sources = lambda i: F.when(i % 2 == 0, F.array(F.lit("lexical"), F.lit("e5"))).otherwise(F.array(F.lit("two_tower")))
    results = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.struct((F.col("value") / i).alias("score"), sources(i).alias("sources")))).otherwise(F.array().cast("array<struct<score:double,sources:array<string>>>"))
    return e.select(F.when(bad, "rrf").otherwise("ranker").alias("ordering"), F.when(F.col("user_id") % 2 == 0, "b1").otherwise("b2").alias("bundle"), F.when(F.col("user_id") % 5 == 0, "voice").otherwise("text").alias("mode"), F.create_map(F.lit("lexical"), F.when(bad, "timeout").otherwise("ok")).alias("legs"), F.create_map(F.lit("total"), F.col("value")).alias("timings"), results.alias("results"))


def _summary_sql(name: str, half: str) -> str:
    return f"""{_LOG.replace('lg AS', name + '_lg AS').replace('half', half)}, {name}_n AS (SELECT count(*) AS c FROM {name}_lg), {name}_src AS (SELECT unnest(CASE WHEN i % 2 = 0 THEN ['lexical', 'e5'] ELSE ['two_tower'] END) AS name FROM {name}_lg, (SELECT unnest(range(1, 4)) AS i) WHERE i <= n),
{name} AS (SELECT 'total' AS measure, 'searches' AS name, count(*)::DOUBLE AS value FROM {name}_lg UNION ALL SELECT 'total', 'zero_result_rate', round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0 END), 6) FROM {name}_lg UNION ALL SELECT 'total', 'rrf_rate', round(avg(CASE WHEN ordering = 'rrf' THEN 1.0 ELSE 0 END), 6) FROM {name}_lg UNION ALL SELECT 'total', 'top_score_mean', round(avg(value) FILTER (n > 0), 6) FROM {name}_lg
 UNION ALL SELECT 'leg', 'lexical:' || lex, round(count(*) / (SELECT c FROM {name}_n)::DOUBLE, 6) FROM {name}_lg GROUP BY 2 UNION ALL SELECT 'source', name, round(count(*) / (SELECT count(*) FROM {name}_src)::DOUBLE, 6) FROM {name}_src GROUP BY 2
 UNION ALL SELECT 'stage', 'total:p50', round(quantile_cont(value, 0.5), 6) FROM {name}_lg UNION ALL SELECT 'stage', 'total:p95', round(quantile_cont(value, 0.95), 6) FROM {name}_lg UNION ALL SELECT 'stage', 'total:n', count(value)::DOUBLE FROM {name}_lg
 UNION ALL SELECT 'bundle', bundle, count(*)::DOUBLE FROM {name}_lg GROUP BY 2 UNION ALL SELECT 'mode', mode, count(*)::DOUBLE FROM {name}_lg GROUP BY 2)"""


@query(f"WITH {_summary_sql('s', 'true')} SELECT * FROM s")
def search_log_summary(spark, d):
    return monitoring.search_summary(_log(spark, d))


_DRIFT_RULES = [("total", "zero_result_rate", "delta", 0.0001, 0.0, "warning"), ("leg", "lexical:timeout", "above", 0.05, 0.0, "critical"), ("stage", "total:p95", "ratio", 1.0, 1.0, "warning"), ("total", "top_score_mean", "shift", 0.001, 0.001, "warning"), ("bundle", "*", "new", 0.0, 0.0, "info")]


@query(f"""WITH {_summary_sql('b', 'event_id % 2 = 0')}, {_summary_sql('c', 'event_id % 2 = 1')}, j AS (SELECT c.measure, c.name, b.value AS baseline, c.value AS current FROM c LEFT JOIN b ON b.measure = c.measure AND b.name = c.name)
SELECT measure, name, kind, baseline, current, round("limit", 6) AS "limit", severity FROM (
 SELECT *, 'delta' AS kind, baseline + 0.0001 AS "limit", 'warning' AS severity FROM j WHERE name = 'zero_result_rate' AND current > coalesce(baseline, 0) + 0.0001 UNION ALL SELECT *, 'above', 0.05, 'critical' FROM j WHERE name = 'lexical:timeout' AND current > 0.05
 UNION ALL SELECT *, 'ratio', baseline * 1.0, 'warning' FROM j WHERE name = 'total:p95' AND current > 1 AND current > baseline * 1.0 UNION ALL SELECT *, 'shift', 0.001, 'warning' FROM j WHERE name = 'top_score_mean' AND abs(current - baseline) / greatest(abs(baseline), 0.001) > 0.001 UNION ALL SELECT *, 'new', 0.0, 'info' FROM j WHERE measure = 'bundle' AND baseline IS NULL)""")
def drift_comparison(spark, d):
    """Findings of one half of a log against the other under a table of rules."""
    return monitoring.drift(monitoring.search_summary(_log(spark, d, 0)), monitoring.search_summary(_log(spark, d, 1)), _DRIFT_RULES)


@query("""WITH v AS (SELECT event_type AS feature, value - 20 AS x FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY) SELECT feature, count(x) AS n, round(sum(CASE WHEN x > 0 THEN x ELSE 0 END), 4) AS positive, round(sum(CASE WHEN x < 0 THEN -x ELSE 0 END), 4) AS negative, CAST(0 AS BIGINT) AS nan, round((round(sum(CASE WHEN x > 0 THEN x ELSE 0 END), 4) - round(sum(CASE WHEN x < 0 THEN -x ELSE 0 END), 4)) / count(x), 6) AS mean FROM v GROUP BY 1 HAVING count(x) > 0""")
def signed_feature_means(spark, d):
    """Means from sums kept apart by sign, over the last week of the log."""
    e = read_table(spark, d, "events")
    newest = e.agg(F.max("ts")).first()[0]
    recent = e.filter(F.col("ts") >= F.lit(newest) - F.expr("INTERVAL 7 DAY"))
    return monitoring.signed_means(recent.select(F.col("event_type").alias("feature"), (F.col("value") - 20).alias("value")))


@query("""SELECT count(*) FILTER (s) AS requests, count(*) FILTER (s AND ok) AS ok, round(count(*) FILTER (s AND ok) / greatest(count(*) FILTER (s), 1), 6) AS availability, count(*) FILTER (NOT s AND ok) AS sent, count(*) FILTER (NOT s AND ok AND st) AS stored, round(count(*) FILTER (NOT s AND ok AND st) / count(*) FILTER (NOT s AND ok), 6) AS persistence FROM (SELECT event_id % 2 = 0 AS s, event_type <> 'error' AS ok, event_id % 101 <> 0 AS st FROM events)""")
def load_report(spark, d):
    e = read_table(spark, d, "events")
    return monitoring.load_report(e.select(F.when(F.col("event_id") % 2 == 0, "search").otherwise("event").alias("kind"), F.when(F.col("event_type") != "error", 200).otherwise(500).alias("status"), (F.col("event_id") % 101 != 0).alias("stored")))


# --- events ----------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT event_id % 500 AS query_id, min(event_id) AS rank, event_id AS episode_id, value AS score FROM events WHERE event_type = 'view' GROUP BY ALL), p AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_id % 500 END AS query_id, CASE WHEN event_id % 7 = 0 THEN -1 WHEN event_id % 5 = 0 THEN event_id - 1 ELSE event_id END AS episode_id FROM events)
SELECT p.event_id, p.query_id, p.episode_id, CASE WHEN p.episode_id NOT IN (SELECT event_id FROM events) THEN 'rejected' WHEN p.query_id IS NULL THEN 'unattributed' WHEN s.rank IS NULL THEN 'rejected' ELSE 'attributed' END AS outcome FROM p LEFT JOIN s ON s.query_id = p.query_id AND s.episode_id = p.episode_id""")
def playback_attribution(spark, d):
    e = read_table(spark, d, "events")
    i = F.col("event_id")
    served = e.filter("event_type = 'view'").select((i % 500).alias("query_id"), i.alias("episode_id"), i.alias("rank"), F.col("value").alias("score"))
    played = e.select(i.alias("event_id"), F.when(i % 3 != 0, i % 500).alias("query_id"), F.when(i % 7 == 0, -1).when(i % 5 == 0, i - 1).otherwise(i).alias("episode_id"))
    return streams.attributed_playbacks(played, served, e.select(i.alias("episode_id"))).select("event_id", "query_id", "episode_id", "outcome")


@query("""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'view' DESC, ts, event_id) AS place, CASE WHEN event_type = 'view' THEN 'search' ELSE 'event' END AS kind, event_id FROM events WHERE user_id % 10 = 0""")
def session_export(spark, d):
    e = read_table(spark, d, "events").withColumn("search", F.col("event_type") == "view")
    wanted = e.filter(F.col("user_id") % 10 == 0).select("user_id")
    return streams.exported(e, "user_id", wanted, "ts").select("user_id", "place", "kind", "event_id")


@query("""SELECT table_name, deleted FROM (SELECT 'searches' AS table_name, count(*) FILTER (event_type = 'view') AS deleted FROM events WHERE user_id % 10 = 0 UNION ALL SELECT 'events', count(*) FILTER (event_type <> 'view') FROM events WHERE user_id % 10 = 0)""")
def session_delete_counts(spark, d):
    e = read_table(spark, d, "events")
    gone = e.filter(F.col("user_id") % 10 == 0).select("user_id")
    return catalog.cascade_counts(gone, {"searches": e.filter("event_type = 'view'"), "events": e.filter("event_type <> 'view'")}, "user_id")


@query("""SELECT 'searches' AS output, event_id FROM events WHERE event_type = 'view' UNION ALL SELECT 'log', event_id FROM events WHERE event_type IN ('view', 'error')""")
def search_records(spark, d):
    """Two results of every micro-batch: the searches, and the log of searches and errors."""
    outputs = {"searches": lambda b: b.filter("event_type = 'view'").select("event_id"), "log": lambda b: b.filter("event_type IN ('view', 'error')").select("event_id")}
    done = streams.split_batches(streams.stream(spark, d, "events"), outputs, "records")
    return done["searches"].select(F.lit("searches").alias("output"), "event_id").unionByName(done["log"].select(F.lit("log").alias("output"), "event_id"))


_ALERTS = [
    ("errors", "1 hour", "30 minutes", "true", "event_type = 'error'", 0.2, 5), ("slow", "1 hour", "30 minutes", "true", "value > 50", 0.1, 5), ("clicks_of_views", "2 hours", "1 hour", "event_type IN ('view', 'click')", "event_type = 'click'", 0.5, 5), ("signups", "2 hours", "1 hour", "true", "event_type = 'signup'", 0.0, 1),
]


def _alert_sql(name, width, slide, of, bad, limit, least):
    unit = {"30 minutes": "INTERVAL 30 minutes", "1 hour": "INTERVAL 1 hour"}[slide]
    return f"SELECT '{name}' AS rule, epoch_us(s) AS start_us, count(*) AS n, count(*) FILTER ({bad}) AS bad, round(count(*) FILTER ({bad}) / count(*), 6) AS ratio FROM (SELECT *, unnest([time_bucket({unit}, ts), time_bucket({unit}, ts) - {unit}]) AS s FROM events) WHERE {of} GROUP BY s HAVING count(*) >= {least} AND count(*) FILTER ({bad}) > {limit} * count(*)"


@query(" UNION ALL ".join(_alert_sql(*r) for r in _ALERTS))
def alert_rules(spark, d):
    """A table of ratio rules over sliding windows."""
    rows = streams.alerts(read_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", _ALERTS)
    return rows.select("rule", F.unix_micros("start").alias("start_us"), "n", "bad", "ratio")


@query("""SELECT e.id, coalesce(nullif(trim(e.title), ''), p.title) AS heading, left(coalesce(e.description, ''), 300) AS excerpt, coalesce(e.explicit, false) OR coalesce(p.explicit, false) AS explicit FROM episodes e JOIN podcasts p ON p.id = e.podcast_id""")
def display_fields(spark, d):
    p = read_table(spark, d, "podcasts").select(F.col("id").alias("podcast_id"), F.col("title").alias("show_title"), F.col("explicit").alias("show_explicit"))
    e = read_table(spark, d, "episodes").join(p, "podcast_id")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return e.select("id", F.coalesce(catalog.blank_to_null(F.col("title")), F.col("show_title")).alias("heading"), F.left(F.coalesce("description", F.lit("")), F.lit(300)).alias("excerpt"), (yes("explicit") | yes("show_explicit")).alias("explicit"))


@query("""SELECT id, array_to_string(list_transform(range(1, 9), lambda j: CAST(CAST(round(1000 * (list_sum(list_transform(range(0, 4), lambda i: embedding[2 * i * 8 + j]::DOUBLE)) / 4)) AS BIGINT) AS VARCHAR)), ',') AS pooled FROM (SELECT vec_id AS id, embedding FROM embeddings)""")
def pooled_vectors(spark, d):
    """Each vector as eight token vectors, of which the mask keeps every other one."""
    e = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (1 - i % 2).cast("double"))
    return e.select("id", F.array_join(F.transform(vectors.mean_pool(tokens, mask), lambda x: F.round(1000 * x).cast("bigint").cast("string")), ",").alias("pooled"))
