"""Queries of the core package over the test tables, and the SQL that states the same results."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from audiolake.functions import hashing, numbers, text
from audiolake.plans.guards import above
from audiolake.operators import catalog, datasets, metrics, monitoring, retrieval, speech, timestamps, understand
from audiolake.registry import hex_number as _hex
from audiolake.registry import norm as _norm
from audiolake.registry import query
from audiolake.search_queries import LEXICAL as _LEXICAL
from audiolake.search_queries import TWO_LEGS as _LEGS
from audiolake.search_queries import lexical_run as _lexical
from audiolake.search_queries import two_legs as _legs
from audiolake.session import read_table
from audiolake.sources import files
from audiolake.streaming import events as streams

EXACT_FORM = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
NOW = datetime(2026, 10, 1)
_QRELS = """qrels AS (SELECT query_id, episode_id, CAST(arg_max(grade, {'a': CASE WHEN starts_with(lower(trim(judge)), 'llm:') THEN 0 ELSE 1 END, 'b': coalesce(judged_at, ''), 'c': grade}) AS INTEGER) AS grade
  FROM judgments WHERE grade BETWEEN 0 AND 3 GROUP BY 1, 2)"""

# --- timestamps ------------------------------------------------------------------------------------------------


def _items_with_zone(spark: SparkSession, d: str) -> DataFrame:
    zones = read_table(spark, d, "podcasts").select(F.col("id").alias("podcast_id"), "time_zone")
    return read_table(spark, d, "feed_items").select("item_id", "podcast_id", "pub_date", "fetched_at").join(zones, "podcast_id", "left")


@query()
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    items = _items_with_zone(spark, d).filter(~F.col("pub_date").rlike(EXACT_FORM))
    done = timestamps.normalise_timestamps(items, "pub_date", F.col("time_zone"))
    return done.filter(above(F.col("instant").isNotNull())).select("item_id", F.unix_micros("instant").alias("published_us")).distinct()


def _estimated(items: DataFrame) -> DataFrame:
    """Zones of the feeds without a stated one, the usual delay measured on all feeds."""
    delay = timestamps.usual_delay(items, "pub_date", "fetched_at")
    return timestamps.estimate_zones(items.filter(F.col("time_zone").isNull()), "podcast_id", "pub_date", "fetched_at", delay=delay)


@query()
def p6_zone_estimates(spark: SparkSession, d: str) -> DataFrame:
    """The likeliest zone of every feed without a stated one."""
    return _estimated(_items_with_zone(spark, d))


@query()
def p6_converted(spark: SparkSession, d: str) -> DataFrame:
    """The instant of every item, local times of feeds without a stated zone by the estimated one."""
    items = _items_with_zone(spark, d)
    done = timestamps.normalise_timestamps(items, "pub_date", F.col("time_zone"), estimated=_estimated(items), source="podcast_id")
    return done.filter(above(F.col("instant").isNotNull())).select("item_id", F.unix_micros("instant").alias("published_us"))


# --- retrieval -------------------------------------------------------------------------------------------------


@query("""SELECT config, count(*) AS n FROM (SELECT CASE string_split(replace(lower(trim(coalesce(language, ''))), '_', '-'), '-')[1] WHEN 'en' THEN 'english' WHEN 'de' THEN 'german'
 WHEN 'fr' THEN 'french' WHEN 'es' THEN 'spanish' WHEN 'pt' THEN 'portuguese' WHEN 'it' THEN 'italian' WHEN 'nl' THEN 'dutch' ELSE 'simple' END AS config FROM episodes) GROUP BY 1""")
def ts_config_counts(spark, d):
    return read_table(spark, d, "episodes").groupBy(text.ts_config(F.col("language")).alias("config")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM n)
SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM (
 SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v) / (a.l * b.l) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, b.v) / (a.l * b.l), 9) DESC, b.vec_id) AS rank
 FROM u a JOIN u b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 10""")
def vector_topk(spark, d):
    e = read_table(spark, d, "embeddings")
    asked = e.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    near = retrieval.vector_top(e.select(F.col("vec_id").alias("id"), "embedding"), asked, 11, 64).filter(F.col("query_id") != F.col("id"))
    best = retrieval.top(near.drop("rank"), "query_id", [F.desc(F.round("similarity", 9)), F.asc("id")], 10)
    return best.select("query_id", F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"), "rank")


_E5 = """v AS (SELECT episode_id AS id, any_value(list_transform(embedding, lambda x: x::DOUBLE)) AS v FROM episode_embeddings
  WHERE model = 'e5' AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
u AS (SELECT id, podcast_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM v JOIN episodes USING (id)),
near AS (SELECT * FROM (SELECT a.id AS source_id, a.podcast_id AS source_show, b.id, b.podcast_id AS show, round(1 - list_dot_product(a.v, b.v) / (a.l * b.l), 9) AS distance,
  row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.v, b.v) / (a.l * b.l), 9) DESC, b.id) AS r FROM u a JOIN u b ON a.id % 50 = 0 AND a.id <> b.id) WHERE r <= 200)"""


def _e5(spark, d):
    e = read_table(spark, d, "episode_embeddings").filter(F.col("model") == "e5").filter(numbers.usable_vector(F.col("embedding"), 64))
    shows = read_table(spark, d, "episodes").select("id", "podcast_id")
    return e.groupBy(F.col("episode_id").alias("id")).agg(F.first("embedding").alias("embedding")).join(shows, "id")


def _neighbours(spark, d):
    e = _e5(spark, d)
    asked = e.filter(F.col("id") % 50 == 0)
    near = retrieval.vector_top(e, asked.select(F.col("id").alias("query_id"), "embedding"), 201, 64).filter(F.col("query_id") != F.col("id"))
    near = retrieval.top(near.drop("rank"), "query_id", [F.desc(F.round("similarity", 9)), F.asc("id")], 200)
    source = asked.select(F.col("id").alias("query_id"), F.col("podcast_id").alias("source_show"))
    rows = near.join(e.select("id", F.col("podcast_id").alias("show")), "id").join(source, "query_id")
    return rows.select(F.col("query_id").alias("source_id"), "source_show", "id", "show", F.round(1 - F.col("similarity"), 9).alias("distance"))


_DIVERSE = f"""{_E5}, shown AS (SELECT source_id, source_show, id, show, pass, place, distance FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY pass, distance, id) AS place FROM (
  SELECT *, CASE WHEN n <= 2 AND show <> source_show THEN 0 WHEN n <= 2 THEN 1 ELSE 2 END AS pass FROM (SELECT *, row_number() OVER (PARTITION BY source_id, show ORDER BY distance, id) AS n FROM near))) WHERE place <= 10)"""


@query(f"WITH {_DIVERSE} SELECT source_id, id AS episode_id, show AS podcast_id, pass, place FROM shown")
def similar_diversified(spark, d):
    return retrieval.diversify(_neighbours(spark, d), 10).select("source_id", F.col("id").alias("episode_id"), F.col("show").alias("podcast_id"), "pass", "place")


@query(f"""WITH {_DIVERSE} SELECT source_id, count(*) AS n, count(DISTINCT show) AS shows, CAST(sum(CASE WHEN show = source_show THEN 1 ELSE 0 END) AS BIGINT) AS own,
 CAST(sum(CASE WHEN pass = 2 THEN 1 ELSE 0 END) AS BIGINT) AS uncapped, round(avg(1 - distance), 6) AS similarity FROM shown GROUP BY 1""")
def similar_report(spark, d):
    rows = retrieval.diversify(_neighbours(spark, d), 10)
    return rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("show").alias("shows"), F.count_if(F.col("show") == F.col("source_show")).alias("own"), F.count_if(F.col("pass") == 2).alias("uncapped"), F.round(F.avg(1 - F.col("distance")), 6).alias("similarity"))


def _popular_base(spark, d):
    shows = read_table(spark, d, "podcasts").select(F.col("id").alias("podcast_id"), "popularity", "categories")
    return read_table(spark, d, "episodes").select("id", "podcast_id", "published_at").join(shows, "podcast_id")


@query("SELECT e.id AS episode_id, p.popularity FROM episodes e JOIN podcasts p ON p.id = e.podcast_id ORDER BY p.popularity DESC, e.published_at DESC NULLS LAST, e.id LIMIT 50")
def popularity_global(spark, d):
    return retrieval.popular(_popular_base(spark, d), 50).select(F.col("id").alias("episode_id"), "popularity")


@query("""SELECT category, episode_id, place FROM (SELECT category, e.id AS episode_id, row_number() OVER (PARTITION BY category ORDER BY popularity DESC, published_at DESC NULLS LAST, e.id) AS place
 FROM (SELECT id AS pid, popularity, unnest(list_distinct(categories)) AS category FROM podcasts) p JOIN episodes e ON e.podcast_id = p.pid) WHERE place <= 10""")
def popularity_category(spark, d):
    rows = _popular_base(spark, d).withColumn("category", F.explode(F.array_distinct("categories")))
    return retrieval.popular(rows, 10, ["category"]).select("category", F.col("id").alias("episode_id"), F.col("rank").alias("place"))


@query("SELECT DISTINCT unnest(categories) AS category FROM podcasts")
def category_vocabulary(spark, d):
    return read_table(spark, d, "podcasts").select(F.explode("categories").alias("category")).distinct()


@query("""WITH m AS (SELECT *, row_number() OVER (ORDER BY popularity DESC, title, publisher) AS row FROM podcasts WHERE starts_with(lower(title), 'br') OR contains(lower(title), ' br') OR starts_with(lower(publisher), 'br') OR contains(lower(publisher), ' br')),
x AS (SELECT row, 0 AS slot, title AS text FROM m WHERE row <= 40 UNION ALL SELECT row, 1, publisher FROM m WHERE row <= 40),
y AS (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY row, slot) AS n FROM x WHERE starts_with(lower(text), 'br') OR contains(lower(text), ' br'))
SELECT text, CASE slot WHEN 0 THEN 'show' ELSE 'publisher' END AS kind, place FROM (SELECT *, row_number() OVER (ORDER BY row, slot) AS place FROM y WHERE n = 1) WHERE place <= 8""")
def suggest_prefix(spark, d):
    return retrieval.suggest(read_table(spark, d, "podcasts"), "br")


# --- scalar functions ------------------------------------------------------------------------------------------


@query(f"SELECT id, {_norm('title')} AS title FROM episodes")
def normalize_titles(spark, d):
    return read_table(spark, d, "episodes").select("id", text.normalize(F.col("title")).alias("title"))


@query("""SELECT id, sha256(coalesce(title, '') || chr(0) || coalesce(description, '') || chr(0) || coalesce(CAST(CAST(duration_seconds AS BIGINT) AS VARCHAR), '') || chr(0) || coalesce(strftime(published_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ'), '') || chr(0) || CASE WHEN explicit THEN 'true' ELSE 'false' END || chr(0) || coalesce(enclosure_url, '') || chr(0)) AS digest FROM episodes""")
def content_hash(spark, d):
    e = read_table(spark, d, "episodes")
    return e.select("id", hashing.item_hash(*(F.col(c) for c in ("title", "description", "duration_seconds", "published_at", "explicit", "enclosure_url"))).alias("digest"))


@query("""SELECT podcast_id, id AS episode_id, place FROM (SELECT podcast_id, id, row_number() OVER (PARTITION BY podcast_id ORDER BY sha256('42:sample:' || CAST(id AS VARCHAR)), id) AS place FROM episodes) WHERE place <= 3""")
def stable_order_sample(spark, d):
    w = Window.partitionBy("podcast_id").orderBy(hashing.order_key(42, "sample", F.col("id")), "id")
    return read_table(spark, d, "episodes").select("podcast_id", F.col("id").alias("episode_id"), F.row_number().over(w).alias("place")).filter("place <= 3")


@query(f"""SELECT query_id, 'q' || substr(sha256(query_type || ':' || query_text), 1, 8) AS derived, {_hex("h", 7, 2)} * 16777216 + {_hex("h", 5, 2)} * 65536 + {_hex("h", 3, 2)} * 256 + {_hex("h", 1, 2)} AS low_word, {_hex("h", 61, 4)} % 8 AS shard
FROM (SELECT *, sha256(query_text) AS h FROM relevance_queries)""")
def query_hashes(spark, d):
    q = read_table(spark, d, "relevance_queries")
    return q.select("query_id", hashing.query_id(F.col("query_type"), F.col("query_text")).alias("derived"), hashing.low_word(F.col("query_text")).alias("low_word"), hashing.shard(F.col("query_text"), 8).alias("shard"))


@query(r"""SELECT id, CASE WHEN regexp_matches(u, '^([a-zA-Z]+)://([^/?#:]+)(:[0-9]+)?([^#]*)(#.*)?$') AND lower(regexp_extract(u, '^([a-zA-Z]+)://', 1)) IN ('http', 'https') THEN
 lower(regexp_extract(u, '^([a-zA-Z]+)://([^/?#:]+)', 1)) || '://' || lower(regexp_extract(u, '^([a-zA-Z]+)://([^/?#:]+)', 2)) || CASE WHEN (lower(regexp_extract(u, '^([a-zA-Z]+)://', 1)), regexp_extract(u, '^[a-zA-Z]+://[^/?#:]+(:[0-9]+)?', 1)) IN (('http', ':80'), ('https', ':443')) THEN '' ELSE regexp_extract(u, '^[a-zA-Z]+://[^/?#:]+(:[0-9]+)?', 1) END || regexp_extract(u, '^[a-zA-Z]+://[^/?#:]+(?::[0-9]+)?([^#]*)', 1) END AS url
FROM (SELECT id, trim(source_url) AS u FROM transcripts)""")
def url_canonical(spark, d):
    return read_table(spark, d, "transcripts").select("id", text.canonical_url(F.col("source_url")).alias("url"))


@query(r"""SELECT item_id, CASE WHEN regexp_matches(s, '^[0-9]{1,9}(:[0-9]{1,9}){0,2}$') THEN list_reduce(list_transform(string_split(s, ':'), lambda x: CAST(x AS BIGINT)), lambda a, b: a * 60 + b) END AS seconds, coalesce(lower(trim(explicit)) IN ('yes', 'true', 'explicit'), false) AS explicit
FROM (SELECT item_id, trim(duration) AS s, explicit FROM feed_items)""")
def duration_parse(spark, d):
    return read_table(spark, d, "feed_items").select("item_id", text.duration_seconds(F.col("duration")).alias("seconds"), text.is_yes(F.col("explicit")).alias("explicit"))


@query("""SELECT id, CASE WHEN duration_seconds IS NULL OR duration_seconds < 0 THEN 0 WHEN duration_seconds <= 600 THEN 1 WHEN duration_seconds <= 1800 THEN 2 WHEN duration_seconds <= 3600 THEN 3 ELSE 4 END AS duration_bucket,
 CASE WHEN a IS NULL THEN 0 WHEN a <= 7 THEN 1 WHEN a <= 30 THEN 2 WHEN a <= 365 THEN 3 ELSE 4 END AS age_bucket FROM (SELECT id, duration_seconds, greatest(0.0, (epoch_us(TIMESTAMP '2026-10-01') - epoch_us(published_at)) / 86400000000.0) AS a FROM episodes)""")
def bucketize_features(spark, d):
    e = read_table(spark, d, "episodes")
    return e.select("id", numbers.bucket(F.col("duration_seconds"), [600, 1800, 3600]).alias("duration_bucket"), numbers.bucket(numbers.age_days(F.col("published_at"), NOW), [7, 30, 365]).alias("age_bucket"))


@query("""SELECT podcast_id, CASE WHEN a IS NULL THEN 6 WHEN a < 1 THEN 1 WHEN a < 3 THEN 3 WHEN a < 7 THEN 6 WHEN a < 30 THEN 12 ELSE 24 END AS hours FROM (
 SELECT podcast_id, greatest(0.0, (epoch_us(TIMESTAMP '2026-10-01') - epoch_us(max(published_at))) / 86400000000.0) AS a FROM episodes GROUP BY 1)""")
def poll_interval(spark, d):
    newest = read_table(spark, d, "episodes").groupBy("podcast_id").agg(F.max("published_at").alias("newest"))
    return newest.select("podcast_id", numbers.poll_hours(numbers.age_days(F.col("newest"), NOW)).alias("hours"))


# --- catalogue -------------------------------------------------------------------------------------------------


@query("""SELECT e.id, CASE WHEN w.was IS NULL THEN 'missing' ELSE 'stale' END AS reason FROM episodes e LEFT JOIN (SELECT episode_id, max(content_hash) AS was FROM episode_embeddings WHERE model = 'e5' GROUP BY 1) w ON w.episode_id = e.id WHERE w.was IS NULL OR w.was IS DISTINCT FROM e.content_hash""")
def pending_reembed(spark, d):
    return catalog.pending(read_table(spark, d, "episodes"), read_table(spark, d, "episode_embeddings"), "e5")


@query("SELECT model, count(*) AS n, epoch_us(max(created_at)) AS newest_us FROM episode_embeddings GROUP BY 1")
def index_freshness(spark, d):
    return read_table(spark, d, "episode_embeddings").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.max("created_at")).alias("newest_us"))


@query("""WITH c AS (SELECT podcast_id, count(*) AS episodes FROM episodes GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY episodes DESC, podcast_id) AS place FROM c)
SELECT podcast_id, episodes FROM r WHERE place <= (SELECT greatest(1, floor(count(*) * 0.1)) FROM c)""")
def head_shows(spark, d):
    return metrics.head_shows(read_table(spark, d, "episodes").groupBy("podcast_id").agg(F.count(F.lit(1)).alias("episodes")), 0.1)


@query("""WITH st AS (SELECT id, podcast_id, nullif(trim(rss_guid), '') AS g, nullif(trim(enclosure_url), '') AS u, nullif(trim(content_hash), '') AS h, content_hash AS raw FROM episodes WHERE id % 3 <> 0),
i0 AS (SELECT id AS position, podcast_id, nullif(trim(rss_guid), '') AS g, nullif(trim(enclosure_url), '') AS u, nullif(trim(content_hash), '') AS h FROM episodes WHERE coalesce(nullif(trim(rss_guid), ''), nullif(trim(enclosure_url), ''), nullif(trim(content_hash), '')) IS NOT NULL),
i AS (SELECT * FROM i0 QUALIFY row_number() OVER (PARTITION BY coalesce('g:' || g, 'u:' || u, 'h:' || h), podcast_id ORDER BY position) = 1),
mg AS (SELECT podcast_id, g, min(id) AS id, arg_min(raw, id) AS raw FROM st WHERE g IS NOT NULL GROUP BY 1, 2), mu AS (SELECT podcast_id, u, min(id) AS id, arg_min(raw, id) AS raw FROM st WHERE u IS NOT NULL GROUP BY 1, 2), mh AS (SELECT podcast_id, h, min(id) AS id FROM st WHERE h IS NOT NULL GROUP BY 1, 2)
SELECT i.position, coalesce(mg.id, mu.id, mh.id) AS stored_id, CASE WHEN mg.id IS NOT NULL THEN 'guid' WHEN mu.id IS NOT NULL THEN 'enclosure' WHEN mh.id IS NOT NULL THEN 'hash' END AS matched_by,
 CASE WHEN coalesce(mg.id, mu.id, mh.id) IS NULL THEN 'insert' WHEN mg.id IS NOT NULL AND mg.raw IS DISTINCT FROM i.h THEN 'update' WHEN mg.id IS NULL AND mu.id IS NOT NULL AND mu.raw IS DISTINCT FROM i.h THEN 'update' ELSE 'unchanged' END AS action
FROM i LEFT JOIN mg ON mg.podcast_id = i.podcast_id AND mg.g = i.g LEFT JOIN mu ON mu.podcast_id = i.podcast_id AND mu.u = i.u LEFT JOIN mh ON mh.podcast_id = i.podcast_id AND mh.h = i.h""")
def upsert_identity(spark, d):
    e = read_table(spark, d, "episodes")
    return catalog.upsert_actions(e.filter(F.col("id") % 3 != 0), e.withColumnRenamed("id", "position"))


@query("SELECT id, max(p) AS popularity FROM (SELECT id, popularity AS p FROM podcasts UNION ALL SELECT id, round(1 - popularity, 6) FROM podcasts WHERE id % 2 = 0) GROUP BY 1")
def upsert_greatest(spark, d):
    p = read_table(spark, d, "podcasts").select("id", "popularity")
    return catalog.merge_greatest(p, p.filter(F.col("id") % 2 == 0).withColumn("popularity", F.round(1 - F.col("popularity"), 6)), "id", "popularity")


@query("""SELECT 'episodes' AS table_name, count(*) AS deleted FROM episodes WHERE podcast_id % 7 = 0 UNION ALL SELECT 'feed_items', count(*) FROM feed_items WHERE podcast_id % 7 = 0 AND podcast_id IN (SELECT id FROM podcasts)
UNION ALL SELECT 'transcripts', count(*) FROM transcripts t JOIN episodes e ON e.id = t.episode_id WHERE e.podcast_id % 7 = 0""")
def cascade_delete_counts(spark, d):
    gone = read_table(spark, d, "podcasts").filter(F.col("id") % 7 == 0).select(F.col("id").alias("podcast_id"))
    e = read_table(spark, d, "episodes")
    t = read_table(spark, d, "transcripts").join(e.select(F.col("id").alias("episode_id"), "podcast_id"), "episode_id")
    return catalog.cascade_counts(gone, {"episodes": e, "feed_items": read_table(spark, d, "feed_items"), "transcripts": t}, "podcast_id")


@query("SELECT podcast_id, g AS guid, item_id FROM (SELECT podcast_id, trim(guid) AS g, min(item_id) AS item_id FROM feed_items WHERE trim(guid) <> '' GROUP BY 1, 2) WHERE (podcast_id, g) NOT IN (SELECT (podcast_id, trim(rss_guid)) FROM episodes WHERE trim(rss_guid) <> '')")
def insert_absent_items(spark, d):
    key = lambda c: F.concat_ws(":", F.col("podcast_id").cast("string"), F.trim(c))
    new = read_table(spark, d, "feed_items").filter(F.trim("guid") != "").select("podcast_id", F.trim("guid").alias("guid"), "item_id", key("guid").alias("key"))
    old = read_table(spark, d, "episodes").filter(F.trim("rss_guid") != "").select(key("rss_guid").alias("key"))
    return catalog.insert_absent(old, new, "key", "item_id").drop("key")


@query("""SELECT id, CAST(sum(s) AS BIGINT) AS sources FROM (SELECT DISTINCT id, 1 AS s FROM episodes WHERE contains(lower(title), 'night market') UNION SELECT id, 2 FROM episodes WHERE contains(lower(description), 'night market') UNION SELECT episode_id, 4 FROM transcripts WHERE contains(lower(content), 'night market')) GROUP BY 1""")
def union_distinct_matches(spark, d):
    has = lambda c: F.contains(F.lower(c), F.lit("night market"))
    e, t = read_table(spark, d, "episodes"), read_table(spark, d, "transcripts")
    rows = e.filter(has("title")).select("id", F.lit(1).alias("s")).union(e.filter(has("description")).select("id", F.lit(2))).union(t.filter(has("content")).select("episode_id", F.lit(4))).distinct()
    return rows.groupBy("id").agg(F.sum("s").alias("sources"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'completed' WHEN 'error' THEN CASE WHEN a >= 5 THEN 'dead' ELSE 'pending' END WHEN 'signup' THEN 'dead' WHEN 'click' THEN CASE WHEN a >= 5 THEN 'dead' ELSE 'pending' END ELSE 'running' END AS state, least(300.0, 5 * power(2, a - 1)) AS wait
FROM (SELECT event_id, event_type, user_id % 7 + 1 AS a FROM events)""")
def job_state_transitions(spark, d):
    e = read_table(spark, d, "events").withColumn("a", F.col("user_id") % 7 + 1)
    outcome = F.when(F.col("event_type") == "view", "done").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "permanent")
    return e.select("event_id", catalog.job_step(F.lit("running"), F.col("a"), F.lit(5), outcome, F.col("event_type") == "click").alias("state"), numbers.backoff(F.col("a"), 5, 300).alias("wait"))


@query("""SELECT id, mime_type, CASE WHEN m = 'text/plain' THEN 'text' WHEN m IN ('application/srt', 'text/srt', 'application/x-subrip') THEN 'srt' WHEN m = 'text/vtt' THEN 'vtt' WHEN m = 'application/json' THEN 'json' WHEN t = 'txt' THEN 'text' WHEN t IN ('srt', 'vtt', 'json') THEN t ELSE '' END AS format
FROM (SELECT id, mime_type, trim(string_split(lower(coalesce(mime_type, '')), ';')[1]) AS m, lower(regexp_extract(coalesce(source_url, ''), '\\.([A-Za-z]+)(?:[?#].*)?$', 1)) AS t FROM transcripts)""".replace("\\\\", "\\"))
def transcript_formats(spark, d):
    return read_table(spark, d, "transcripts").select("id", "mime_type", files.transcript_format(F.col("mime_type"), F.col("source_url")).alias("format"))


@query()
def transcript_texts(spark, d):
    t = read_table(spark, d, "transcripts")
    return t.select("id", files.transcript_text(F.col("content"), files.transcript_format(F.col("mime_type"), F.col("source_url"))).alias("speech"))


# --- evaluation ------------------------------------------------------------------------------------------------


def _qrels(spark, d):
    j = read_table(spark, d, "judgments")
    return catalog.effective_grades(j, ~F.startswith(F.lower(F.trim("judge")), F.lit("llm:")))


@query(f"WITH {_QRELS} SELECT * FROM qrels")
def qrels_effective(spark, d):
    return _qrels(spark, d)


def _metric_sql(ks=(5, 10, 100)) -> str:
    ideal = ", ".join(f"sum(CASE WHEN i <= {k} THEN (power(2.0, grade) - 1) / log2(i + 1) ELSE 0 END) AS ideal{k}" for k in ks)
    found = ", ".join([f"sum(CASE WHEN rank <= {k} THEN rel ELSE 0 END) AS n{k}" for k in ks] + [f"sum(CASE WHEN rank <= {k} AND grade IS NOT NULL THEN (power(2.0, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg{k}" for k in ks])
    out = ", ".join([f"round(coalesce(n{k}, 0) / relevant, 6) AS recall_{k}" for k in ks] + [f"CAST(coalesce(n{k}, 0) > 0 AS INTEGER) AS hit_{k}" for k in ks] + [f"round(coalesce(dcg{k} / nullif(ideal{k}, 0), 0), 6) AS ndcg_{k}" for k in ks])
    return f"""{_LEXICAL}, {_QRELS},
base AS (SELECT query_id, count(*) FILTER (grade >= 1) AS relevant, {ideal} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, episode_id) AS i FROM qrels) GROUP BY 1 HAVING count(*) FILTER (grade >= 1) > 0),
j AS (SELECT l.query_id, l.rank, q.grade, CAST(coalesce(q.grade >= 1, false) AS INTEGER) AS rel FROM lexical l LEFT JOIN qrels q ON q.query_id = l.query_id AND q.episode_id = l.episode_id),
h AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM j),
f AS (SELECT query_id, {found}, min(rank) FILTER (rel = 1) AS first, sum(CASE WHEN rank <= 10 AND rel = 1 THEN hits / rank ELSE 0 END) AS ap, count(*) FILTER (rank <= 10 AND grade IS NOT NULL) AS judged, max(rank) AS length FROM h GROUP BY 1),
per AS (SELECT base.query_id, relevant, {out}, round(coalesce(1.0 / first, 0), 6) AS mrr, round(coalesce(ap, 0) / least(relevant, 10), 6) AS map_10, round(coalesce(n5, 0) / 5, 6) AS p_5, round(coalesce(n10, 0) / 10, 6) AS p_10,
  round(coalesce(judged, 0) / greatest(least(coalesce(length, 0), 10), 1), 6) AS judged_10 FROM base LEFT JOIN f ON f.query_id = base.query_id)"""


@query(f"WITH {_metric_sql()} SELECT * FROM per")
def eval_metrics_per_query(spark, d):
    return metrics.per_query(_lexical(spark, d), _qrels(spark, d))


@query(f"""WITH {_metric_sql()}, g AS (SELECT per.*, unnest([{{'grouping': 'all', 'value': ''}}, {{'grouping': 'query_type', 'value': coalesce(nullif(query_type, ''), 'none')}}, {{'grouping': 'filter_language', 'value': coalesce(nullif(filter_language, ''), 'none')}}]) AS s FROM per JOIN relevance_queries r ON r.query_id = per.query_id)
SELECT s.grouping AS "grouping", s.value AS value, count(*) AS queries, round(avg(ndcg_10), 4) AS ndcg_10, round(avg(mrr), 4) AS mrr, round(avg(recall_100), 4) AS recall_100 FROM g GROUP BY 1, 2""")
def eval_metrics_grouped(spark, d):
    per = metrics.per_query(_lexical(spark, d), _qrels(spark, d))
    return metrics.grouped(per, read_table(spark, d, "relevance_queries"), ["query_type", "filter_language"], ["ndcg_10", "mrr", "recall_100"])


@query(f"""WITH {_LEXICAL}, {_QRELS}, c AS (SELECT id AS episode_id, CASE WHEN has_transcript THEN 'transcript' ELSE 'no_transcript' END AS cohort FROM episodes UNION ALL SELECT id, CASE WHEN podcast_id = 1 THEN 'head' ELSE 'tail' END FROM episodes),
p AS (SELECT cohort, q.query_id, count(l.rank) / count(*) AS r FROM qrels q JOIN c ON c.episode_id = q.episode_id LEFT JOIN lexical l ON l.query_id = q.query_id AND l.episode_id = q.episode_id AND l.rank <= 100 WHERE grade >= 1 GROUP BY 1, 2)
SELECT cohort, count(*) AS queries, round(avg(r), 6) AS recall FROM p GROUP BY 1""")
def eval_cohorts(spark, d):
    e = read_table(spark, d, "episodes")
    cohorts = e.select(F.col("id").alias("episode_id"), F.explode(F.array(F.when(F.col("has_transcript"), "transcript").otherwise("no_transcript"), F.when(F.col("podcast_id") == 1, "head").otherwise("tail"))).alias("cohort"))
    return metrics.cohort_recall(_lexical(spark, d), _qrels(spark, d), cohorts, 100)


def _scored(spark, d):
    e = read_table(spark, d, "episodes").select(F.col("id").alias("episode_id"), F.length("description").cast("double").alias("score"))
    return _qrels(spark, d).join(e, "episode_id")


@query(f"""WITH {_QRELS}, s AS (SELECT query_id, episode_id, grade, length(description) AS score FROM qrels JOIN episodes ON id = episode_id)
SELECT a.query_id, count(*) AS pairs, CAST(sum(CAST(a.score > b.score AS INTEGER)) AS BIGINT) AS "right", round(sum(CAST(a.score > b.score AS INTEGER)) / count(*), 6) AS accuracy FROM s a JOIN s b ON a.query_id = b.query_id AND a.grade > b.grade GROUP BY 1""")
def pairwise_accuracy(spark, d):
    return metrics.pairwise_accuracy(_scored(spark, d))


@query(f"""WITH {_QRELS}, s AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY length(description) DESC, episode_id) AS r, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, episode_id) AS i FROM qrels JOIN episodes ON id = episode_id)
SELECT query_id, round(coalesce(sum(CASE WHEN r <= 10 THEN grade / log2(r + 1) ELSE 0 END) / nullif(sum(CASE WHEN i <= 10 THEN grade / log2(i + 1) ELSE 0 END), 0), 0), 6) AS ndcg FROM s GROUP BY 1""")
def pool_ndcg_linear(spark, d):
    return metrics.pool_ndcg(_scored(spark, d), 10)


@query(f"""WITH {_LEGS}, a AS (SELECT query_id, episode_id, rank FROM legs WHERE leg = 'lexical' AND rank <= 10), b AS (SELECT query_id, episode_id, rank FROM legs WHERE leg = 'e5' AND rank <= 10)
SELECT query_id, round(count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) / count(*), 6) AS jaccard, bool_and(ra IS NOT DISTINCT FROM rb) AS same_top FROM (
 SELECT coalesce(a.query_id, b.query_id) AS query_id, a.rank AS ra, b.rank AS rb FROM a FULL JOIN b ON a.query_id = b.query_id AND a.episode_id = b.episode_id) GROUP BY 1""")
def parity_jaccard(spark, d):
    legs = _legs(spark, d)
    return metrics.jaccard(legs.filter("leg = 'lexical'"), legs.filter("leg = 'e5'"), 10)


@query("""WITH b AS (SELECT event_type AS name, round(avg(value), 6) AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1), c AS (SELECT event_type AS name, round(avg(value), 6) AS value FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT *, coalesce(value >= floor, false) AS passed FROM (SELECT coalesce(c.name, b.name) AS name, CASE WHEN coalesce(c.name, b.name) IN ('view', 'click') THEN 'primary' ELSE 'cohort' END AS gate, c.value, round(b.value - CASE WHEN coalesce(c.name, b.name) IN ('view', 'click') THEN 0 ELSE 0.05 END, 6) AS floor FROM c FULL JOIN b ON b.name = c.name)""")
def gates_and_regressions(spark, d):
    e = read_table(spark, d, "events")
    mean = lambda r: e.filter(F.col("event_id") % 2 == r).groupBy(F.col("event_type").alias("name")).agg(F.round(F.avg("value"), 6).alias("value"))
    return metrics.gates(mean(1), mean(0), ("view", "click"))


# --- monitoring ------------------------------------------------------------------------------------------------


@query("""SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS linear_50, round(quantile_cont(value, 0.95), 6) AS linear_95, quantile_disc(value, 0.5) AS nearest_50, quantile_disc(value, 0.95) AS nearest_95,
 list_sort(list(value))[least(count(value), CAST(floor(count(value) * 0.5) AS BIGINT) + 1)] AS floor_50, list_sort(list(value))[least(count(value), CAST(floor(count(value) * 0.95) AS BIGINT) + 1)] AS floor_95 FROM events WHERE value IS NOT NULL GROUP BY 1""")
def latency_percentiles(spark, d):
    return monitoring.percentiles(read_table(spark, d, "events"), "event_type", "value")


_HIST = """c AS (SELECT event_type AS grp, CAST(least(greatest(floor((value - 0) / 5.0), 0), 19) AS INTEGER) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
hist AS (SELECT g.grp, b.bin, coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / greatest(t, 1), 6) AS share FROM (SELECT grp, sum(n) AS t FROM c GROUP BY 1) g CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(20)) b LEFT JOIN c ON c.grp = g.grp AND c.bin = b.bin)"""


@query(f"WITH {_HIST} SELECT * FROM hist")
def score_histogram(spark, d):
    return monitoring.histogram(read_table(spark, d, "events"), "value", 0.0, 5.0, 20, "event_type")


@query(f"WITH {_HIST}, x AS (SELECT greatest(e.share, 1e-4) AS e, greatest(a.share, 1e-4) AS a FROM hist e JOIN hist a ON a.bin = e.bin WHERE e.grp = 'view' AND a.grp = 'purchase') SELECT round(sum((a - e) * ln(a / e)), 6) AS psi FROM x")
def psi_drift(spark, d):
    h = monitoring.histogram(read_table(spark, d, "events"), "value", 0.0, 5.0, 20, "event_type")
    return monitoring.psi(h.filter("grp = 'view'"), h.filter("grp = 'purchase'"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, CAST(0 AS BIGINT) AS nan, round(avg({c}), 6) AS mean FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def feature_means(spark, d):
    return monitoring.feature_means(read_table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("""WITH s AS (SELECT event_type AS name, event_id % 2 AS half, round(avg(value), 6) AS v FROM events GROUP BY 1, 2), j AS (SELECT b.name, b.v AS baseline, c.v AS current, round(c.v - b.v, 6) AS change FROM s b JOIN s c ON c.name = b.name AND b.half = 0 AND c.half = 1)
SELECT *, CASE WHEN name = 'error' THEN 'alert' ELSE 'warn' END AS severity FROM j WHERE name IN ('view', 'click', 'error', 'purchase') AND abs(change) > 0.01""")
def drift_findings(spark, d):
    e = read_table(spark, d, "events")
    mean = lambda r: e.filter(F.col("event_id") % 2 == r).groupBy(F.col("event_type").alias("name")).agg(F.round(F.avg("value"), 6).alias("value"))
    return monitoring.findings(mean(0), mean(1), {"view": (0.01, "warn"), "click": (0.01, "warn"), "error": (0.01, "alert"), "purchase": (0.01, "warn")})


# --- datasets --------------------------------------------------------------------------------------------------

_ELIGIBLE = "published_at IS NOT NULL AND trim(title) <> '' AND starts_with(lower(language), 'en')"
_SYNTHETIC = f"""syn AS (SELECT 'synthetic_query-' || CAST(id AS VARCHAR) AS example_id, q AS query_text, id AS positive_id, podcast_id AS show, published_at FROM (SELECT *, {_norm('title')} AS q FROM episodes WHERE {_ELIGIBLE}) WHERE length(q) >= 3 ORDER BY sha256('42:synthetic_query:' || CAST(id AS VARCHAR)), id LIMIT 200)"""


def _examples(spark, d):
    return datasets.synthetic_queries(read_table(spark, d, "episodes"), 200, 42)


@query(f"WITH {_SYNTHETIC} SELECT example_id, query_text, positive_id, show, epoch_us(published_at) AS event_us FROM syn")
def synthetic_query_examples(spark, d):
    return _examples(spark, d).select("example_id", "query_text", "positive_id", "show", F.unix_micros("event_time").alias("event_us"))


@query(f"""WITH {_SYNTHETIC}, ring AS (SELECT id AS negative_id, row_number() OVER (ORDER BY sha256('42:ring:' || CAST(id AS VARCHAR)), id) - 1 AS spot FROM (SELECT DISTINCT id FROM episodes)), c AS (SELECT count(*) AS size FROM ring),
d AS (SELECT example_id, positive_id, size, {_hex("sha256('42:neg:' || example_id)", 1, 13)} AS s, 1 + {_hex("sha256('42:stride:' || example_id)", 1, 13)} % greatest(1, (size - 1) // 3) AS t FROM syn, c),
p AS (SELECT example_id, positive_id, k, (s + k * t) % size AS spot FROM d, (SELECT unnest(range(4)) AS k))
SELECT example_id, negative_id, place FROM (SELECT example_id, negative_id, row_number() OVER (PARTITION BY example_id ORDER BY k) AS place FROM p JOIN ring USING (spot) WHERE negative_id <> positive_id) WHERE place <= 3""")
def sampled_negatives(spark, d):
    return datasets.negatives(_examples(spark, d), read_table(spark, d, "episodes").select("id"), 3, 42)


@query(f"""WITH t AS (SELECT id AS pid, unnest(list_distinct(categories)) AS category FROM podcasts), r AS (SELECT e.id, category FROM episodes e JOIN t ON t.pid = e.podcast_id WHERE {_ELIGIBLE})
SELECT category, id AS positive_id FROM r WHERE category IN (SELECT category FROM r GROUP BY 1 HAVING count(*) >= 10) QUALIFY row_number() OVER (PARTITION BY category ORDER BY sha256('42:topic:' || CAST(id AS VARCHAR)), id) <= 15""")
def topic_similarity_examples(spark, d):
    return datasets.topic_examples(read_table(spark, d, "episodes"), read_table(spark, d, "podcasts"), 15, 10, 42)


@query(f"""WITH r AS (SELECT id, podcast_id AS show, row_number() OVER (PARTITION BY podcast_id ORDER BY sha256('42:name:' || CAST(id AS VARCHAR)), id) AS n FROM episodes)
SELECT show, CASE WHEN n <= 2 THEN 'show' ELSE 'publisher' END AS kind, q AS query_text, episode_id FROM (SELECT show, n, r.id AS episode_id, CASE WHEN n <= 2 THEN {_norm('p.title')} ELSE {_norm('p.publisher')} END AS q FROM r JOIN podcasts p ON p.id = r.show WHERE n <= 4) WHERE length(q) >= 3""")
def name_queries(spark, d):
    return datasets.name_queries(read_table(spark, d, "episodes"), read_table(spark, d, "podcasts"), 2, 42)


@query("""WITH s AS (SELECT query_type, count(*) AS size FROM relevance_queries GROUP BY 1), o AS (SELECT query_type, coalesce(sum(size) OVER (ORDER BY query_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s)
SELECT query_id, CAST((row_number() OVER (PARTITION BY q.query_type ORDER BY sha256('42:' || query_id), query_id) - 1 + off) % 5 AS INTEGER) AS fold FROM relevance_queries q JOIN o ON o.query_type = q.query_type""")
def fold_assignment(spark, d):
    return datasets.folds(read_table(spark, d, "relevance_queries"), "query_type", "query_id", 5, 42)


@query("SELECT CASE WHEN published_at < TIMESTAMPTZ '2023-01-01 00:00:00+00' THEN 'train' WHEN published_at < TIMESTAMPTZ '2025-01-01 00:00:00+00' THEN 'validation' WHEN published_at IS NOT NULL THEN 'test' END AS split, count(*) AS n FROM episodes GROUP BY 1")
def dataset_time_split(spark, d):
    rows = datasets.split_by_time(read_table(spark, d, "episodes"), "published_at", "2023-01-01 00:00:00", "2025-01-01 00:00:00")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH b AS (SELECT id, 'title' AS rule FROM episodes WHERE NOT coalesce(trim(title) <> '', false) UNION ALL SELECT id, 'dated' FROM episodes WHERE published_at IS NULL UNION ALL SELECT id, 'duration' FROM episodes WHERE NOT coalesce(duration_seconds > 0, false)
UNION ALL SELECT id, 'unique' FROM episodes GROUP BY id HAVING count(*) > 1)
SELECT r.rule, coalesce(n, 0) AS violations, coalesce(e, '') AS examples FROM (SELECT unnest(['title', 'dated', 'duration', 'unique']) AS rule) r LEFT JOIN (SELECT rule, count(*) AS n FROM b GROUP BY 1) c ON c.rule = r.rule
LEFT JOIN (SELECT rule, array_to_string(list_sort(list(CAST(id AS VARCHAR))), ',') AS e FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY id) AS n FROM b) WHERE n <= 20 GROUP BY 1) x ON x.rule = r.rule""")
def dataset_contract_report(spark, d):
    rules = {"title": F.trim("title") != "", "dated": F.col("published_at").isNotNull(), "duration": F.col("duration_seconds") > 0}
    return datasets.contract(read_table(spark, d, "episodes"), "id", rules)


@query(f"""SELECT count(*) AS rows, sha256({" || ':' || ".join(f"CAST(sum({_hex('d', 1 + 12 * i, 12)}) AS VARCHAR)" for i in range(4))}) AS digest FROM (SELECT sha256(concat_ws('|', CAST(id AS VARCHAR), coalesce(title, '~'), coalesce(content_hash, '~'))) AS d FROM episodes)""")
def dataset_digest(spark, d):
    return datasets.table_hash(read_table(spark, d, "episodes"), ["id", "title", "content_hash"])


@query(f"""SELECT id AS podcast_id, draw_rank FROM (SELECT id, row_number() OVER (ORDER BY round(-ln(({_hex("sha256('42:weighted:' || CAST(id AS VARCHAR))", 1, 12)} + 1) / 281474976710657.0) / n, 9), id) AS draw_rank FROM podcasts p JOIN (SELECT podcast_id, count(*) AS n FROM episodes GROUP BY 1) c ON c.podcast_id = p.id) WHERE draw_rank <= 20""")
def popularity_weighted_draw(spark, d):
    sizes = read_table(spark, d, "episodes").groupBy("podcast_id").agg(F.count(F.lit(1)).alias("n"))
    drawn = datasets.weighted_order(sizes, "podcast_id", F.col("n"), 42, "weighted").orderBy(F.round("draw", 9), "podcast_id").limit(20)
    return drawn.select("podcast_id", F.row_number().over(Window.orderBy(F.round("draw", 9), "podcast_id")).alias("draw_rank"))


@query()
def query_understanding(spark, d):
    forms = F.explode(F.array(F.lit(" under 45 minutes"), F.lit(" in spanish from this year"), F.lit(" since 2022 no explicit please"))).alias("tail")
    rows = read_table(spark, d, "relevance_queries").select("query_id", "query_text", forms).withColumn("asked", F.concat("query_text", "tail"))
    return rows.withColumn("u", understand.understood(F.col("asked"), date(2026, 10, 1))).select("query_id", "asked", "u.*")


@query()
def wer_report(spark, d):
    """Titles against themselves without their second word, by language."""
    e = read_table(spark, d, "episodes").select("language", "title").withColumn("heard", F.regexp_replace("title", r"^(\S+) \S+", "$1"))
    e = e.withColumn("e", speech.word_errors(F.col("title"), F.col("heard"))).withColumn("cer", speech.character_error_rate(F.col("title"), F.col("heard")))
    return e.groupBy(text.primary_subtag(F.col("language")).alias("language")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("e.wer"), 4).alias("wer"), F.round(F.avg("cer"), 4).alias("cer"), F.sum("e.deletions").alias("deletions"))


# --- streams ---------------------------------------------------------------------------------------------------


@query("SELECT epoch_us(time_bucket(INTERVAL 1 hour, ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, d):
    rows = streams.tumbling(read_table(spark, d, "events"), "ts", "1 hour", "event_type")
    return rows.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "event_type", "n", "total")


@query("""WITH w AS (SELECT unnest([time_bucket(INTERVAL 30 minutes, ts), time_bucket(INTERVAL 30 minutes, ts) - INTERVAL 30 minutes]) AS s, event_type FROM events)
SELECT epoch_us(s) AS start_us, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS ratio FROM w GROUP BY s HAVING count(*) >= 5 AND count(*) FILTER (event_type = 'error') > 0.2 * count(*)""")
def sliding_ratio_alert(spark, d):
    rows = streams.ratio_alerts(read_table(spark, d, "events"), "ts", "1 hour", "30 minutes", "event_type = 'error'", 0.2, 5)
    return rows.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "n", "bad", "ratio")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 hours THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n FROM s GROUP BY user_id, k""")
def sessionize(spark, d):
    rows = streams.sessions(read_table(spark, d, "events"), "user_id", "ts", "4 hours")
    return rows.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end_at").cast("timestamp")).alias("end_us"), "n")


@query("SELECT DISTINCT event_id, event_type FROM events")
def stream_dedup_watermark(spark, d):
    e = streams.stream(spark, d, "events")
    return streams.drain(streams.deduplicated(e.withColumn("ts", F.col("ts").cast("timestamp")), "event_id", "ts").select("event_id", "event_type"), "dedup")


@query("""SELECT c.event_id AS click_id, v.event_id AS view_id, c.user_id FROM events c JOIN events v ON c.event_type = 'click' AND v.event_type = 'view' AND v.user_id = c.user_id AND v.ts <= c.ts AND v.ts >= c.ts - INTERVAL 1 hour""")
def stream_attribution(spark, d):
    side = lambda kind: streams.stream(spark, d, "events").filter(F.col("event_type") == kind).withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.drain(streams.attributed_stream(side("click"), side("view")), "attribution")


@query("""WITH served AS (SELECT event_id % 500 AS query_id, event_id AS episode_id FROM events WHERE event_type = 'view'), i AS (SELECT event_id // 20 AS batch_id, event_id % 500 AS query_id, CASE WHEN event_id % 97 = 0 THEN -1 ELSE event_id END AS episode_id FROM events WHERE event_type = 'view')
SELECT batch_id, count(*) AS items, bool_and(s.episode_id IS NOT NULL) AS accepted FROM i LEFT JOIN served s ON s.query_id = i.query_id AND s.episode_id = i.episode_id GROUP BY 1""")
def impression_attribution(spark, d):
    v = read_table(spark, d, "events").filter(F.col("event_type") == "view")
    served = v.select((F.col("event_id") % 500).alias("query_id"), F.col("event_id").alias("episode_id"), F.lit(1).alias("rank"), F.col("value").alias("score"), F.lit("v1").alias("version"))
    seen = v.select(F.floor(F.col("event_id") / 20).alias("batch_id"), (F.col("event_id") % 500).alias("query_id"), F.when(F.col("event_id") % 97 == 0, -1).otherwise(F.col("event_id")).alias("episode_id"))
    good, bad = streams.attributed(seen, served)
    count = lambda x, ok: x.groupBy("batch_id").agg(F.count(F.lit(1)).alias("items"), F.lit(ok).alias("accepted"))
    return count(good, True).unionByName(count(bad, False))


@query("""SELECT event_id AS id, event_type AS type, CASE WHEN user_id % 12 >= 10 THEN 'dead' WHEN event_type IN ('view', 'click') THEN 'handled' ELSE 'consumed' END AS outcome FROM events WHERE event_id % 3 <> 0""")
def outbox_drain(spark, d):
    e = read_table(spark, d, "events")
    box = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), (F.col("user_id") % 12).alias("attempts"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("processed_at"))
    return streams.drain_outbox(box, {"view": lambda x: None, "click": lambda x: None})


# --- scans and vocabularies ------------------------------------------------------------------------------------


@query("SELECT id, title FROM episodes WHERE id > 500 ORDER BY id LIMIT 100")
def keyset_page(spark, d):
    """One page of a resumable scan: rows after a key, in key order."""
    return read_table(spark, d, "episodes").filter(F.col("id") > 500).orderBy("id").limit(100).select("id", "title")


@query("""SELECT kind, value, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) AS place FROM (SELECT 'category' AS kind, lower(trim(c)) AS value, count(DISTINCT id) AS n FROM (SELECT id, unnest(categories) AS c FROM podcasts) WHERE trim(c) <> '' GROUP BY 2
UNION ALL SELECT 'language', string_split(replace(lower(trim(coalesce(language, ''))), '_', '-'), '-')[1], count(*) FROM podcasts GROUP BY 2) WHERE n >= 3 AND value <> ''""")
def vocabularies(spark, d):
    """Values by falling frequency, then name, of at least three shows."""
    p = read_table(spark, d, "podcasts")
    cats = p.select("id", F.explode("categories").alias("c")).select(F.lit("category").alias("kind"), F.lower(F.trim("c")).alias("value"), "id").distinct()
    langs = p.select(F.lit("language").alias("kind"), text.primary_subtag(F.col("language")).alias("value"), "id")
    rows = cats.unionByName(langs).filter("value <> ''").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "value")))


@query(f"""WITH {_QRELS}, c AS (SELECT e.id AS episode_id, CASE WHEN m.episode_id IS NOT NULL THEN 'seen' WHEN e.podcast_id IN (SELECT podcast_id FROM episodes JOIN (SELECT DISTINCT episode_id FROM episode_embeddings WHERE model = 'e5') v ON v.episode_id = id) THEN 'known_podcast' ELSE 'unseen_podcast' END AS cohort
 FROM episodes e LEFT JOIN (SELECT DISTINCT episode_id FROM episode_embeddings WHERE model = 'e5') m ON m.episode_id = e.id)
SELECT cohort, count(*) AS judged, count(DISTINCT query_id) AS queries FROM qrels JOIN c USING (episode_id) GROUP BY 1""")
def cold_start(spark, d):
    """Judged items by whether their episode, or only their show, has vectors."""
    e = read_table(spark, d, "episodes").select(F.col("id").alias("episode_id"), "podcast_id")
    seen = read_table(spark, d, "episode_embeddings").filter(F.col("model") == "e5").select("episode_id").distinct().withColumn("has", F.lit(True))
    marked = e.join(seen, "episode_id", "left")
    shows = marked.filter("has").select("podcast_id").distinct().withColumn("known", F.lit(True))
    cohort = F.when(F.col("has"), "seen").when(F.col("known"), "known_podcast").otherwise("unseen_podcast")
    rows = _qrels(spark, d).join(marked.join(shows, "podcast_id", "left").select("episode_id", cohort.alias("cohort")), "episode_id")
    return rows.groupBy("cohort").agg(F.count(F.lit(1)).alias("judged"), F.count_distinct("query_id").alias("queries"))


@query("""WITH l AS (SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'lexical' ELSE 'vector' END AS leg, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'ok' END AS status FROM events)
SELECT leg, status, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM l GROUP BY 1, 2""")
def leg_outcomes(spark, d):
    """Status of each retrieval leg over a serving log built from the events."""
    e = read_table(spark, d, "events")
    leg = F.when(F.col("event_type").isin("view", "click"), "lexical").otherwise("vector")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "skipped").otherwise("ok")
    log = e.select(F.create_map(leg, F.struct(status.alias("status"), F.lit(1).alias("count"))).alias("legs"))
    return monitoring.leg_status(log).withColumn("share", F.round("share", 6))


# --- relational base -------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, d):
    rows = read_table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n")
    )


@query("""SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2""")
def local_supplier_revenue(spark, d):
    t = lambda n: read_table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    j = j.join(t("supplier"), (F.col("s_suppkey") == F.col("l_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def order_rollup(spark, d):
    rows = read_table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return rows.select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n", "total")
