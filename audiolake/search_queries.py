"""Queries of retrieval and ranking over the test tables, and the SQL that states the same results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from audiolake.operators import candidates, lexical, ranking, retrieval, vectors, websearch
from audiolake.registry import hex_number, norm, query, words
from audiolake.session import read_table

NOW = datetime(2026, 10, 1)


def catalogue(spark: SparkSession, d: str) -> candidates.Catalogue:
    return candidates.Catalogue(*(read_table(spark, d, n) for n in ("episodes", "podcasts", "transcripts", "episode_embeddings", "relevance_queries")))


# --- SQL parts -------------------------------------------------------------------------------------------------


def _squares(n: str) -> str:
    return f"coalesce(list_sum(list_transform(range(1, ({n}) + 1), lambda i: 1.0::DOUBLE / (i * i))), 0)"


def _term(*counts: tuple[str, float]) -> str:
    """Score of a term from (count, weight) by falling weight."""
    parts, before = [], ""
    for c, w in counts:
        now = f"{before} + {c}" if before else c
        parts.append(f"{w} * ({_squares(now)}{' - ' + _squares(before) if before else ''})")
        before = now
    return f"({' + '.join(parts)}) * (6 / (pi() * pi()))"


def _fields(table: str, key: str, fields: dict[str, str]) -> str:
    every = " UNION ALL ".join(f"SELECT {key} AS id, '{letter}' AS f, unnest({words(c)}) AS term FROM {table}" for letter, c in fields.items())
    return f"SELECT id, term, {', '.join(f"count(*) FILTER (f = '{letter}') AS {letter}" for letter in fields)} FROM ({every}) WHERE term IN (SELECT term FROM terms) GROUP BY 1, 2"


FOUND = f"""
terms AS (SELECT query_id, len(t) AS need, unnest(t) AS term FROM (SELECT query_id, list_distinct({words('query_text')}) AS t FROM relevance_queries)),
ew AS ({_fields('episodes', 'id', {'A': 'title', 'B': 'left(description, 100000)'})}),
tw AS ({_fields('transcripts', 'episode_id', {'D': 'left(content, 500000)', 'O': 'left(content, 8000)'})}),
pw AS ({_fields('podcasts', 'id', {'A': 'title', 'B': "concat_ws(' ', publisher, array_to_string(categories, ' '))", 'C': 'left(description, 50000)'})}),
le AS (SELECT query_id, id AS episode_id, sum({_term(('A', 1.0), ('B', 0.4))}) / any_value(need) AS lex_episode FROM ew JOIN terms USING (term) GROUP BY 1, 2 HAVING count(*) = any_value(need)),
lt AS (SELECT query_id, id AS episode_id, sum({_term(('D', 0.1))}) / any_value(need) AS lex_transcript, sum({_term(('O', 0.1))}) / any_value(need) AS lex_opening FROM tw JOIN terms USING (term) GROUP BY 1, 2 HAVING count(*) = any_value(need)),
lp AS (SELECT query_id, id AS podcast_id, sum({_term(('A', 1.0), ('B', 0.4), ('C', 0.2))}) / any_value(need) AS lex_podcast FROM pw JOIN terms USING (term) GROUP BY 1, 2 HAVING count(*) = any_value(need)),
ok AS (SELECT q.query_id, e.id AS episode_id, e.podcast_id, e.published_at FROM relevance_queries q JOIN episodes e ON (coalesce(q.filter_language, '') = '' OR coalesce(starts_with(lower(e.language), lower(q.filter_language)), false))
  AND (coalesce(q.filter_max_seconds, 0) <= 0 OR coalesce(e.duration_seconds <= q.filter_max_seconds, false)))"""


def _lexical(k: int, name: str) -> str:
    cut = lambda c: f"QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round({c}, 9) DESC, published_at DESC NULLS LAST, episode_id) <= {k}"
    return f"""
{name}_u AS (SELECT * FROM (SELECT query_id, episode_id, podcast_id, published_at FROM ok JOIN le USING (query_id, episode_id) {cut('lex_episode')})
 UNION SELECT * FROM (SELECT query_id, episode_id, podcast_id, published_at FROM ok JOIN lt USING (query_id, episode_id) {cut('lex_opening')})
 UNION SELECT * FROM (SELECT query_id, episode_id, podcast_id, published_at FROM ok JOIN lp USING (query_id, podcast_id) {cut('lex_podcast')})),
{name} AS (SELECT query_id, episode_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, published_at DESC NULLS LAST, episode_id) AS rank FROM (
  SELECT u.*, coalesce(lex_episode, 0) + coalesce(lex_opening, 0) + 0.5 * coalesce(lex_podcast, 0) AS s FROM {name}_u u LEFT JOIN le USING (query_id, episode_id) LEFT JOIN lt USING (query_id, episode_id) LEFT JOIN lp USING (query_id, podcast_id))) WHERE rank <= {k})"""


LEXICAL = f"{FOUND}, {_lexical(100, 'lexical')}"

VECTORS = f"""
qi AS (SELECT query_id, m, {hex_number('h', 1, 6)} % 64 + 1 AS i, CASE WHEN {hex_number('h', 9, 1)} < 8 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS x FROM (
  SELECT query_id, m, sha256(m || ':' || w) AS h FROM (SELECT query_id, unnest({words('query_text')}) AS w FROM relevance_queries), (SELECT unnest(['e5', 'two-tower:']) AS m))),
qv AS (SELECT query_id, m, i, sum(x) AS x FROM qi GROUP BY ALL),
ql AS (SELECT query_id, m, sqrt(sum(x * x)) AS l FROM qv GROUP BY ALL HAVING sum(x * x) > 0),
vec AS (SELECT episode_id, m, v, sqrt(list_sum(list_transform(v, lambda y: y * y))) AS l FROM (SELECT episode_id, CASE WHEN model = 'e5' THEN 'e5' WHEN starts_with(model, 'two-tower:') THEN 'two-tower:' END AS m, any_value(list_transform(embedding, lambda y: y::DOUBLE)) AS v
  FROM episode_embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0 GROUP BY 1, 2) WHERE m IS NOT NULL),
sims AS (SELECT qv.query_id, vec.episode_id, qv.m, round(sum(x * v[i]) / (any_value(ql.l) * any_value(vec.l)), 9) AS s FROM qv JOIN ql ON ql.query_id = qv.query_id AND ql.m = qv.m JOIN vec ON vec.m = qv.m GROUP BY 1, 2, 3)"""


def _vector_leg(m: str, k: int, name: str) -> str:
    return f"{name} AS (SELECT query_id, episode_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, episode_id) AS rank FROM sims JOIN ok USING (query_id, episode_id) WHERE m = '{m}' QUALIFY rank <= {k})"


THREE = f"""{FOUND}, {_lexical(50, 'lex50')}, {VECTORS}, {_vector_leg('e5', 50, 'e50')}, {_vector_leg('two-tower:', 50, 't50')},
legs AS (SELECT query_id, 'lexical' AS leg, episode_id, rank FROM lex50 UNION ALL SELECT query_id, 'e5', episode_id, rank FROM e50 UNION ALL SELECT query_id, 'two_tower', episode_id, rank FROM t50)"""


def _rrf(legs: str, weight: str = "1.0::DOUBLE") -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, legs DESC, episode_id) AS rank FROM (SELECT query_id, episode_id, round(sum({weight} / (60 + rank)), 12) AS rrf_score, count(DISTINCT leg) AS legs FROM {legs} GROUP BY 1, 2)"""


# --- full text -------------------------------------------------------------------------------------------------


def lexical_run(spark: SparkSession, d: str, k: int = 100) -> DataFrame:
    c = catalogue(spark, d)
    return lexical.ranked(c.episodes, c.found(), c.queries, 100).filter(F.col("rank") <= k)


@query(f"WITH {LEXICAL} SELECT * FROM lexical WHERE rank <= 20")
def lexical_topk(spark, d):
    return lexical_run(spark, d, 20)


@query(f"""WITH {LEXICAL} SELECT query_id, episode_id, round(coalesce(lex_episode, 0), 6) AS lex_episode, round(coalesce(lex_transcript, 0), 6) AS lex_transcript, round(coalesce(lex_podcast, 0), 6) AS lex_podcast
FROM (SELECT DISTINCT query_id, episode_id FROM judgments WHERE query_id IS NOT NULL) j JOIN episodes e ON e.id = j.episode_id LEFT JOIN le USING (query_id, episode_id) LEFT JOIN lt USING (query_id, episode_id) LEFT JOIN lp ON lp.query_id = j.query_id AND lp.podcast_id = e.podcast_id""")
def lexical_evidence(spark, d):
    """Scores by source of every judged pair, whatever found it."""
    c = catalogue(spark, d)
    pairs = read_table(spark, d, "judgments").select("query_id", "episode_id").filter("query_id IS NOT NULL").distinct().join(c.episodes.select(F.col("id").alias("episode_id"), "podcast_id"), "episode_id")
    return lexical.evidence(pairs, c.found()).select("query_id", "episode_id", *[F.round(n, 6).alias(n) for n in ("lex_episode", "lex_transcript", "lex_podcast")])


@query(f"WITH {FOUND} SELECT query_id, podcast_id, round(lex_podcast, 6) AS score FROM lp")
def podcast_matches(spark, d):
    return catalogue(spark, d).found()[2].select("query_id", "podcast_id", F.round("lex_podcast", 6).alias("score"))


_WEB = f"""ask AS (SELECT query_id, w[1] AS a, w[2] AS b FROM (SELECT query_id, {words('query_text')} AS w FROM relevance_queries) WHERE len(w) >= 2),
doc AS (SELECT id, ' ' || {norm('title')} || ' ' AS t, ' ' || {norm('description')} || ' ' AS x FROM episodes),
has AS (SELECT query_id, id, contains(t, ' ' || a || ' ') OR contains(x, ' ' || a || ' ') AS ha, contains(t, ' ' || b || ' ') OR contains(x, ' ' || b || ' ') AS hb, contains(t, ' ' || a || ' ' || b || ' ') OR contains(x, ' ' || a || ' ' || b || ' ') AS hp FROM ask, doc)"""


@query(f"""WITH {_WEB} SELECT query_id || ':phrase' AS query_id, id AS episode_id FROM has WHERE hp UNION ALL SELECT query_id || ':either', id FROM has WHERE ha OR hb UNION ALL SELECT query_id || ':without', id FROM has WHERE ha AND NOT hb UNION ALL SELECT query_id || ':both', id FROM has WHERE ha AND hp""")
def websearch_matches(spark, d):
    """Every query of two words or more as a phrase, as alternatives, with its second word excluded, and as word and phrase."""
    w = F.filter(F.split(F.trim(F.regexp_replace(F.lower("query_text"), "[^0-9a-z]+", " ")), " "), lambda x: x != "")
    q = read_table(spark, d, "relevance_queries").withColumn("w", w).filter(F.size("w") >= 2).select("query_id", F.col("w")[0].alias("a"), F.col("w")[1].alias("b"))
    form = lambda name, pattern, *parts: F.struct(F.concat("query_id", F.lit(f":{name}")).alias("query_id"), F.format_string(pattern, *parts).alias("query_text"))
    forms = F.array(form("phrase", '"%s %s"', "a", "b"), form("either", "%s or %s", "a", "b"), form("without", "%s -%s", "a", "b"), form("both", '%s "%s %s"', "a", "a", "b"))
    asked = q.select(F.explode(forms).alias("f")).select("f.*")
    return websearch.match(read_table(spark, d, "episodes"), "id", ["title", "description"], asked).select("query_id", F.col("id").alias("episode_id"))


# --- vectors, systems and fusion -------------------------------------------------------------------------------


@query(f"WITH {FOUND}, {VECTORS}, {_vector_leg('e5', 20, 'v')} SELECT query_id, episode_id, round(s, 6) AS similarity, rank FROM v")
def vector_leg(spark, d):
    """Filtered exact top 20 of the encoded queries under one model."""
    c = catalogue(spark, d)
    return vectors.leg(c.embeddings, c.episodes, c.queries, "e5", 20).withColumn("similarity", F.round("similarity", 6))


@query("""SELECT episode_id, model, v AS vector_text, round(n, 6) AS length, abs(n - 1) <= 0.001 AS is_unit FROM (SELECT episode_id, model, '[' || array_to_string(list_transform(embedding, lambda x: CAST(round(x::DOUBLE * 1000) AS BIGINT)), ',') || ']' AS v,
 sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM (SELECT DISTINCT episode_id, model, embedding FROM episode_embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0))""")
def vector_checks(spark, d):
    """Text form (in thousandths, written and read again), length and unit check of every usable vector."""
    from audiolake.functions.numbers import norm as length
    from audiolake.functions.numbers import usable_vector

    e = read_table(spark, d, "episode_embeddings").filter(usable_vector(F.col("embedding"), 64)).select("episode_id", "model", "embedding").distinct()
    written = vectors.to_text(F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("bigint")))
    again = vectors.to_text(F.transform(vectors.from_text(written), lambda x: x.cast("bigint")))
    return e.select("episode_id", "model", again.alias("vector_text"), F.round(length(F.col("embedding")), 6).alias("length"), vectors.is_unit(F.col("embedding")).alias("is_unit"))


TWO_LEGS = f"""{LEXICAL}, {VECTORS}, {_vector_leg('e5', 100, 'ev')},
legs AS (SELECT query_id, 'lexical' AS leg, episode_id, rank FROM lexical WHERE rank <= 50 UNION ALL SELECT query_id, 'e5', episode_id, rank FROM ev WHERE rank <= 50)"""


def two_legs(spark, d):
    """(query_id, leg, episode_id, rank): first 50 of the lexical and the e5 leg of depth 100."""
    c = catalogue(spark, d)
    return c.legs(("lexical", "e5"), 100).filter("rank <= 50")


@query(f"""WITH {TWO_LEGS} SELECT query_id, episode_id, round(rrf_score, 9) AS rrf_score, legs, lexical_rank, e5_rank, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, legs DESC, episode_id) AS rank FROM (
 SELECT query_id, episode_id, round(sum(CASE leg WHEN 'lexical' THEN 1.0 ELSE 0.5 END::DOUBLE / (60 + rank)), 12) AS rrf_score, count(DISTINCT leg) AS legs, min(rank) FILTER (leg = 'lexical') AS lexical_rank, min(rank) FILTER (leg = 'e5') AS e5_rank FROM legs GROUP BY 1, 2)""")
def rrf_fusion(spark, d):
    return retrieval.rrf(two_legs(spark, d), "episode_id", {"lexical": 1.0, "e5": 0.5}).withColumn("rrf_score", F.round("rrf_score", 9))


_POPULAR = f"""cats AS (SELECT category, list_distinct({words('category')}) AS cw FROM (SELECT DISTINCT unnest(categories) AS category FROM podcasts)),
named AS (SELECT query_id, list(category) AS c FROM relevance_queries, cats WHERE len(cw) > 0 AND len(list_filter(cw, lambda x: NOT list_contains({words('query_text')}, x))) = 0 GROUP BY 1),
pc AS (SELECT query_id, episode_id, row_number() OVER (PARTITION BY query_id ORDER BY popularity DESC, ok.published_at DESC NULLS LAST, episode_id) AS rank FROM ok JOIN podcasts p ON p.id = ok.podcast_id LEFT JOIN named USING (query_id) WHERE named.c IS NULL OR list_has_any(p.categories, named.c) QUALIFY rank <= 10),
pg AS (SELECT query_id, episode_id, row_number() OVER (PARTITION BY query_id ORDER BY popularity DESC, ok.published_at DESC NULLS LAST, episode_id) AS rank FROM ok JOIN podcasts p ON p.id = ok.podcast_id QUALIFY rank <= 10)"""
_SYSTEMS = f"""{FOUND}, {_lexical(10, 'l10')}, {_lexical(200, 'l200')}, {_lexical(50, 'lex50')}, {VECTORS}, {_vector_leg('e5', 10, 'e10')}, {_vector_leg('two-tower:', 10, 't10')}, {_vector_leg('e5', 200, 'e200')}, {_vector_leg('e5', 50, 'e50')}, {_vector_leg('two-tower:', 50, 't50')},
legs AS (SELECT query_id, 'lexical' AS leg, episode_id, rank FROM lex50 UNION ALL SELECT query_id, 'e5', episode_id, rank FROM e50 UNION ALL SELECT query_id, 'two_tower', episode_id, rank FROM t50),
h AS (SELECT query_id, 'lexical' AS leg, episode_id, rank FROM l200 UNION ALL SELECT query_id, 'e5', episode_id, rank FROM e200), {_POPULAR},
runs AS (SELECT 'lexical' AS system, query_id, episode_id, rank FROM l10 UNION ALL SELECT 'e5', query_id, episode_id, rank FROM e10 UNION ALL SELECT 'two-tower', query_id, episode_id, rank FROM t10
 UNION ALL SELECT 'hybrid-rrf', query_id, episode_id, rank FROM ({_rrf('h')}) WHERE rank <= 10 UNION ALL SELECT 'rrf3', query_id, episode_id, rank FROM ({_rrf('legs')}) WHERE rank <= 10
 UNION ALL SELECT 'popularity-global', query_id, episode_id, rank FROM pg UNION ALL SELECT 'popularity-category', query_id, episode_id, rank FROM pc)"""


def system_rows(spark, d, k: int = 10) -> DataFrame:
    """(system, query_id, episode_id, rank) of every system."""
    return candidates.runs(tuple(sorted(candidates.SYSTEMS)), catalogue(spark, d), k)


@query(f"WITH {_SYSTEMS} SELECT * FROM runs")
def system_runs(spark, d):
    """First ten of every registered system for every query."""
    return system_rows(spark, d)


@query(f"""WITH {_SYSTEMS} SELECT query_id, episode_id, min(rank) AS best_rank, array_to_string(list_sort(list(system || ':' || CAST(rank AS VARCHAR))), ',') AS sources FROM runs GROUP BY 1, 2""")
def judgment_pool(spark, d):
    """Pairs to judge: the union of the systems' first ten with their ranks."""
    return candidates.pooled(catalogue(spark, d), tuple(sorted(candidates.SYSTEMS)), 10)


@query(f"WITH {THREE} SELECT q.query_id, leg, CASE WHEN len({words('query_text')}) > 0 THEN 'ok' ELSE 'skipped' END AS status, coalesce(n, 0) AS n FROM relevance_queries q CROSS JOIN (SELECT unnest(['lexical', 'e5', 'two_tower']) AS leg) l LEFT JOIN (SELECT query_id, leg, count(*) AS n FROM legs GROUP BY 1, 2) c USING (query_id, leg)")
def leg_statuses(spark, d):
    return candidates.leg_report(catalogue(spark, d))


# --- candidates and features -----------------------------------------------------------------------------------

_SIM = lambda m: f"coalesce((SELECT max(s) FROM sims WHERE sims.query_id = k.query_id AND sims.episode_id = k.episode_id AND m = '{m}'), 0.0)"
CANDIDATES = f"""{THREE},
k0 AS (SELECT query_id, episode_id, min(rank) FILTER (leg = 'lexical') AS lexical_rank, min(rank) FILTER (leg = 'e5') AS e5_rank, min(rank) FILTER (leg = 'two_tower') AS two_tower_rank FROM legs GROUP BY 1, 2),
cand AS (SELECT k.query_id, k.episode_id, lexical_rank, e5_rank, two_tower_rank, coalesce(lex_episode, 0) AS lex_episode, coalesce(lex_transcript, 0) AS lex_transcript, coalesce(lex_podcast, 0) AS lex_podcast,
 coalesce(se.s, 0.0) AS e5_sim, coalesce(st.s, 0.0) AS two_tower_sim, e.title, left(e.description, 1000) AS description, e.duration_seconds, e.published_at, p.title AS podcast_title, p.publisher, p.popularity, q.query_text, q.filter_language AS wanted_language, q.filter_max_seconds AS wanted_seconds,
 (SELECT count(*) FROM episodes x WHERE x.podcast_id = e.podcast_id) AS show_episodes, e.id IN (SELECT episode_id FROM transcripts) AS has_transcript, coalesce(e.explicit, false) OR coalesce(p.explicit, false) AS shown_explicit
 FROM k0 k JOIN episodes e ON e.id = k.episode_id JOIN podcasts p ON p.id = e.podcast_id JOIN relevance_queries q ON q.query_id = k.query_id LEFT JOIN le ON le.query_id = k.query_id AND le.episode_id = k.episode_id
 LEFT JOIN lt ON lt.query_id = k.query_id AND lt.episode_id = k.episode_id LEFT JOIN lp ON lp.query_id = k.query_id AND lp.podcast_id = e.podcast_id
 LEFT JOIN sims se ON se.query_id = k.query_id AND se.episode_id = k.episode_id AND se.m = 'e5' LEFT JOIN sims st ON st.query_id = k.query_id AND st.episode_id = k.episode_id AND st.m = 'two-tower:'),
named AS (SELECT *, {norm('query_text')} AS q, {words('query_text')} AS qw, {norm('podcast_title')} AS show_n, {norm('title')} AS title_n, {norm('publisher')} AS by_n, lex_episode + lex_transcript + 0.5 * lex_podcast AS lex FROM cand)"""


def _holds(hay: str, needle: str) -> str:
    return f"(length({needle}) >= 3 AND contains(' ' || {hay} || ' ', ' ' || {needle} || ' '))"


def _cover(c: str) -> str:
    return f"CASE WHEN len(qw) = 0 THEN 0 ELSE len(list_filter(qw, lambda w: list_contains({words(c)}, w))) / len(qw) END"


_ONE = {
    "two_tower_sim": "two_tower_sim", "two_tower_sim_gap": "two_tower_sim - max(two_tower_sim) OVER w", "e5_sim": "e5_sim", "e5_sim_gap": "e5_sim - max(e5_sim) OVER w", "transcript_sim": "0.0",
    "lex_score": "lex", "lex_score_rel": "CASE WHEN max(lex) OVER w > 0 THEN lex / max(lex) OVER w ELSE 0 END", "lex_episode": "lex_episode", "lex_transcript": "lex_transcript", "lex_podcast": "lex_podcast",
    "lexical_rr": "coalesce(1.0 / lexical_rank, 0)", "e5_rr": "coalesce(1.0 / e5_rank, 0)", "two_tower_rr": "coalesce(1.0 / two_tower_rank, 0)",
    "legs": "(lexical_rank IS NOT NULL)::INT + (e5_rank IS NOT NULL)::INT + (two_tower_rank IS NOT NULL)::INT", "rrf_score": "coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + e5_rank), 0) + coalesce(1.0::DOUBLE / (60 + two_tower_rank), 0)",
    "show_exact": "(show_n <> '' AND q = show_n)::INT", "show_in_query": f"{_holds('q', 'show_n')}::INT", "query_in_show": f"{_holds('show_n', 'q')}::INT", "show_coverage": _cover("podcast_title"),
    "publisher_exact": "(by_n <> '' AND q = by_n)::INT", "publisher_in_query": f"{_holds('q', 'by_n')}::INT", "publisher_coverage": _cover("publisher"), "query_in_title": f"{_holds('title_n', 'q')}::INT", "title_coverage": _cover("title"), "description_coverage": _cover("description"), "query_tokens": "len(qw)",
    "log_age_days": "ln(1 + coalesce(greatest(0.0, (epoch_us(TIMESTAMP '2026-10-01') - epoch_us(published_at)) / 86400000000.0), 3650.0))", "log_duration": "ln(1 + greatest(0, coalesce(duration_seconds, 0)))", "log_show_episodes": "ln(1 + show_episodes)", "popularity": "coalesce(popularity, 0)", "has_transcript": "has_transcript::INT",
}


@query(f"WITH {CANDIDATES} SELECT query_id, episode_id, {', '.join(f'round(({e})::DOUBLE, 6) + 0.0 AS {n}' for n, e in _ONE.items())} FROM named WINDOW w AS (PARTITION BY query_id)")
def candidate_features(spark, d):
    """The 31 features of the three legs' candidates."""
    done = ranking.features(candidates.candidates(catalogue(spark, d)), NOW)
    return done.select("query_id", "episode_id", *[(F.round(n, 6) + F.lit(0.0)).alias(n) for n in ranking.FEATURES])


@query(f"WITH {THREE} SELECT query_id, episode_id, rrf_score, legs, rank FROM ({_rrf('legs')}) WHERE rank <= 20")
def rrf_three_legs(spark, d):
    c = catalogue(spark, d)
    return retrieval.rrf(c.legs(candidates.LEGS, 50), "episode_id").filter("rank <= 20").select("query_id", "episode_id", "rrf_score", "legs", "rank")


_STOP = ", ".join(f"'{w}'" for w in ranking.STOP_WORDS)
_SHARED = lambda c: f"list_filter(list_distinct_in_order, lambda w: list_contains({words(c)}, w))".replace("list_distinct_in_order", "uq")
_QUOTE = lambda c: f"array_to_string(CASE WHEN len({c}) > 4 THEN list_concat(list_transform({c}[1:4], lambda w: '“' || w || '”'), ['…']) ELSE list_transform({c}, lambda w: '“' || w || '”') END, ', ')"


@query(f"""WITH {CANDIDATES},
u AS (SELECT *, list_filter(list_transform(list_filter(list_zip(qw, range(1, len(qw) + 1)), lambda p: list_position(qw, p[1]) = p[2]), lambda p: p[1]), lambda w: length(w) >= 2 AND NOT list_contains([{_STOP}], w)) AS uq FROM named),
m AS (SELECT *, {_SHARED('title')} AS tw, {_SHARED('description')} AS dw FROM u),
a AS (SELECT *, list_filter([CASE WHEN q <> '' AND q = show_n THEN 'Show name matches “' || podcast_title || '”' WHEN {_holds('q', 'show_n')} THEN 'Show “' || podcast_title || '” is named in your search' WHEN {_holds('show_n', 'q')} THEN 'Show name contains “' || query_text || '”' END,
 CASE WHEN q <> '' AND by_n <> '' AND (q = by_n OR {_holds('q', 'by_n')}) THEN 'Published by ' || publisher END, CASE WHEN len(tw) > 0 THEN 'Episode title mentions ' || {_QUOTE('tw')} END], lambda x: x IS NOT NULL) AS first FROM m),
b AS (SELECT *, list_concat(first, list_filter([CASE WHEN len(first) = 0 AND len(dw) > 0 THEN 'Description mentions ' || {_QUOTE('dw')} END, CASE WHEN lex_transcript > 0 THEN 'Transcript mentions your search terms' END,
 CASE WHEN coalesce(wanted_language, '') <> '' THEN 'In ' || coalesce(CASE wanted_language WHEN 'en' THEN 'English' WHEN 'es' THEN 'Spanish' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'pt' THEN 'Portuguese' END, '') END,
 CASE WHEN coalesce(wanted_seconds, 0) > 0 AND duration_seconds IS NOT NULL THEN CAST((CAST(duration_seconds AS BIGINT) + 59) // 60 AS VARCHAR) || ' min (under ' || CAST(wanted_seconds // 60 AS VARCHAR) || ')' END], lambda x: x IS NOT NULL)) AS every FROM a)
SELECT query_id, episode_id, CASE WHEN len(every) > 0 THEN array_to_string(every, '; ') ELSE 'Found by ' || CASE WHEN lexical_rank IS NOT NULL AND (e5_rank IS NOT NULL OR two_tower_rank IS NOT NULL) THEN 'keyword search and semantic search' WHEN lexical_rank IS NOT NULL THEN 'keyword search' ELSE 'semantic search' END || ' (no exact word match)' END AS reasons FROM b""")
def explain_reasons(spark, d):
    return ranking.explain(candidates.candidates(catalogue(spark, d)))


@query(f"""WITH {CANDIDATES}, s AS (SELECT query_id, episode_id, round(0.5 * e5_sim + 0.3 * two_tower_sim + 0.2 * lex, 9) AS score, (coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + e5_rank), 0) + coalesce(1.0::DOUBLE / (60 + two_tower_rank), 0)) AS rrf, popularity FROM named),
f AS (SELECT *, CASE WHEN bool_and(popularity > 0) OVER (PARTITION BY query_id) THEN 'ranker' ELSE 'rrf' END AS ordering FROM s)
SELECT query_id, episode_id, ordering, row_number() OVER (PARTITION BY query_id ORDER BY round(CASE ordering WHEN 'ranker' THEN score ELSE rrf END, 9) DESC, episode_id) AS place FROM f QUALIFY place <= 10""")
def ranker_with_fallback(spark, d):
    """A linear ranker over the features that has no score for shows of unknown popularity; such queries keep the fused order."""
    f = ranking.features(candidates.candidates(catalogue(spark, d)), NOW)
    score = F.when(F.col("popularity") > 0, F.round(0.5 * F.col("e5_sim") + 0.3 * F.col("two_tower_sim") + 0.2 * F.col("lex_score"), 9))
    return candidates.scored(f.withColumn("score", score), "score", "rrf_score").filter("place <= 10").select("query_id", "episode_id", "ordering", "place")
