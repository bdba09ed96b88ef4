"""Full text, vectors, systems, candidates, features and reasons on small tables."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from audiolake import data_queries
from audiolake.operators import candidates, contract, lexical, ranking, retrieval, vectors
from tests.conftest import rows

E = "id long, podcast_id long, title string, description string, language string, duration_seconds int, published_at timestamp, explicit boolean, query_text string"
P = "id long, title string, publisher string, categories array<string>, description string, popularity double, explicit boolean, score double"
Q = "query_id string, query_text string, filter_language string, filter_max_seconds int, title string"


@pytest.fixture(scope="module")
def tables(spark):
    day = lambda n: datetime(2024, 1, n)
    episodes = [
        (1, 7, "Salt and sea", "a salt mine near the sea", "en", 600, day(1), False, "x"),
        (2, 7, "Bread", "bread and salt", "en-US", 1200, day(2), True, "x"),
        (3, 8, "Whales", None, "de", 300, day(3), None, "x"),
        (4, 8, None, "", None, None, None, False, "x"),
        (5, 9, "Salt", "salt salt", "en", 9000, day(5), False, "x"),
    ]
    podcasts = [(7, "Kitchen Stories", "Ana Lopes", ["Food"], "about salt", 0.5, False, 1.0), (8, "Ocean Hour", "Blue Media", ["True Crime", "Science"], None, 0.9, True, 1.0), (9, None, None, None, None, 0.1, None, 1.0)]
    told = [(1, "nothing here"), (3, "the salt of the sea " * 3), (4, None)]
    rng = np.random.default_rng(1)
    vec = [(e, m, [float(x) for x in rng.standard_normal(64)], "h") for e in (1, 2, 3, 5) for m in ("e5", "two-tower:a")]
    vec += [vec[0], (4, "e5", None, "h"), (4, "two-tower:a", [0.0] * 64, "h"), (2, "other", [1.0] * 64, "h"), (3, "e5", [float("nan")] * 64, "h")]
    asked = [("a", "salt", "", 0, "t"), ("b", "Salt Sea", None, None, "t"), ("c", "true crime salt", "en", 1500, "t"), ("d", "", "", 0, "t"), ("e", None, "", 0, "t"), ("f", "zebra", "de", 0, "t"), ("a", "salt", "", 0, "t")]
    make = lambda data, schema: spark.createDataFrame(data, schema)
    return [make(episodes, E), make(podcasts, P), make(told, "episode_id long, content string"), make(vec, "episode_id long, model string, embedding array<float>, query_id string"), make(asked, Q)]


def test_scores_by_hand(spark, tables):
    c = candidates.Catalogue(*tables)
    e, t, p = c.found()
    s = 6 / math.pi**2
    got = {(r.query_id, r.episode_id): r.lex_episode for r in e.collect()}
    assert set(got) == {("a", 1), ("a", 2), ("a", 5), ("b", 1)}
    assert abs(got["a", 1] - s * (1 + 0.4 / 4)) < 1e-9 and abs(got["a", 2] - s * 0.4) < 1e-9 and abs(got["a", 5] - s * (1 + 0.4 / 4 + 0.4 / 9)) < 1e-9
    assert abs(got["b", 1] - s * (1 + 0.4 / 4)) < 1e-9
    assert {(r.query_id, r.episode_id): round(r.lex_transcript, 9) for r in t.collect()} == {(q, 3): round(0.1 * s * (1 + 1 / 4 + 1 / 9), 9) for q in "ab"}
    assert {(r.query_id, r.podcast_id): round(r.lex_podcast, 9) for r in p.collect()} == {("a", 7): round(0.2 * s, 9)}


def test_only_queries_are_broadcast(spark, tables):
    """The files of words and scores are small, the rows are not: of them nothing is built in the driver."""
    episodes, _, _, _, asked = tables
    terms = lexical.term_scores(episodes.withColumnRenamed("id", "episode_id"), "episode_id", {"A": F.col("title"), "B": F.col("description")}, asked)
    held = rows(lexical.match(terms, "episode_id", asked).select("query_id", "episode_id"))
    assert held == [("a", 1), ("a", 2), ("a", 5), ("b", 1)]
    found = tuple(spark.createDataFrame([], f"query_id string, {k} long, {s} double") for k, s in (("episode_id", "lex_episode"), ("episode_id", "lex_transcript"), ("podcast_id", "lex_podcast")))
    pairs = spark.createDataFrame([("a", 1, 7)], "query_id string, episode_id long, podcast_id long")
    for df in (lexical.match(terms, "episode_id", asked), lexical.evidence(pairs, (found[0], found[1].withColumn("lex_opening", F.lit(0.0)), found[2]))):
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
        assert any("SortMergeJoin" in x for x in lines)
        depth = lambda x: len(x) - len(x.lstrip(" :+-"))
        for i, x in enumerate(lines):
            if "BroadcastExchange" in x:
                below = lines[i + 1 : next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(x)), len(lines))]
                assert not any("collect_list" in y or "score" in y or "lex_" in y for y in below)


def test_lexical_ranking_unites_sources(spark, tables):
    c = candidates.Catalogue(*tables)
    got = [(r.query_id, r.episode_id, r["rank"]) for r in c.leg("lexical", 10).orderBy("query_id", "rank").collect()]
    assert got == [("a", 1, 1), ("a", 5, 2), ("a", 2, 3), ("a", 3, 4), ("b", 1, 1), ("b", 3, 2)]
    empty = [t.limit(0) for t in tables]
    assert candidates.run("rrf3", candidates.Catalogue(*empty), 5).count() == 0
    assert candidates.run("hybrid-rrf", candidates.Catalogue(*empty[:4], tables[4]), 5).count() == 0


def test_systems_share_the_deepest_leg(spark, tables, monkeypatch):
    """Of a leg that systems take to several depths one is computed; each system still has the ranking it has alone."""
    made = []
    for at, name in ((lexical, "pool"), (vectors, "leg"), (candidates, "popular")):
        monkeypatch.setattr(at, name, lambda *a, real=getattr(at, name), name=name, **k: made.append(name) or real(*a, **k))
    names = tuple(sorted(candidates.SYSTEMS))
    got = rows(candidates.runs(names, candidates.Catalogue(*tables), 1))
    assert sorted(made) == ["leg", "leg", "pool", "popular"]
    assert {r[0] for r in got} == set(names)
    for n in ("lexical", "e5", "popularity-category"):
        assert [r[1:] for r in got if r[0] == n] == rows(candidates.run(n, candidates.Catalogue(*tables), 1).select("query_id", "episode_id", "rank"))


def test_pool_of_a_depth_is_part_of_the_deeper(spark, tables):
    """Episode 1 of query a is second in its sources, so that it is no candidate of depth 1, though its sum is the best."""
    episodes, _, _, _, asked = tables
    found = candidates.Catalogue(*tables).found()
    deep = lexical.pool(episodes, found, asked, 10)
    assert {(r.query_id, r.episode_id): r["first"] for r in deep.collect()} == {("a", 1): 2, ("a", 2): 1, ("a", 3): 1, ("a", 5): 1, ("b", 1): 1, ("b", 3): 1}
    for k in (1, 2):
        assert rows(lexical.cut(deep, k)) == rows(lexical.ranked(episodes, found, asked, k))
    assert ("a", 1) not in {r[:2] for r in rows(lexical.cut(deep, 1))}


def test_vector_leg_is_exact_under_filters(spark, tables):
    episodes, _, _, vec, asked = tables
    asked = asked.union(spark.createDataFrame([("g", "salt sea", "en", 1300, "t")], Q))
    got = {}
    for r in vectors.leg(vec, episodes, asked, "e5", 2).collect():
        got.setdefault(r.query_id, {})[r.episode_id] = r.similarity
    v = {r.episode_id: np.array(r.embedding, float) for r in vec.filter("model = 'e5' AND embedding IS NOT NULL AND NOT isnan(embedding[0])").collect()}
    for r in vectors.encoded_queries(asked, ["e5"]).collect():
        q = np.array(r.embedding)
        fine = {"c": {1, 2}, "g": {1, 2}, "f": {3}}.get(r.query_id, {1, 2, 3, 5})
        cos = {e: v[e] @ q / np.linalg.norm(v[e]) / np.linalg.norm(q) for e in fine}
        want = dict(sorted(cos.items(), key=lambda x: -x[1])[:2])
        assert got[r.query_id].keys() == want.keys() and all(abs(got[r.query_id][e] - want[e]) < 1e-6 for e in want)
    assert not got.keys() & {"d", "e"}


def test_popularity_by_named_category(spark, tables):
    c = candidates.Catalogue(*tables)
    got = {}
    for r in candidates.run("popularity-category", c, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.episode_id)
    assert got["a"] == [3, 4, 2] and got["f"] == [3]  # no category: all, by popularity and date
    assert "c" not in got  # the named category has no episode in English
    with pytest.raises(ValueError):
        candidates.run("magic", c, 3)


def test_candidates_have_every_evidence(spark, tables):
    c = candidates.Catalogue(*tables)
    got = {(r.query_id, r.episode_id): r for r in candidates.candidates(c).collect()}
    assert {e for q, e in got if q == "a"} == {1, 2, 3, 5}
    r = got["a", 3]
    assert r.lexical_rank == 4 and r.e5_rank and r.lex_transcript > 0 and r.lex_episode == 0 and r.has_transcript and r.shown_explicit and r.transcript_sim == 0
    f = {(x.query_id, x.episode_id): x for x in ranking.features(candidates.candidates(c), datetime(2024, 1, 11)).collect()}
    x = f["b", 1]
    assert list(x.asDict())[2:] == ranking.FEATURES and len(ranking.FEATURES) == 31
    assert (x.title_coverage, x.description_coverage, x.query_tokens, x.legs, x.lexical_rr) == (1.0, 1.0, 2.0, 3.0, 1.0) and abs(x.log_age_days - math.log(11)) < 1e-9
    best = max(v.e5_sim for (q, _), v in f.items() if q == "b")
    assert abs(x.e5_sim_gap - (x.e5_sim - best)) < 1e-12 and x.lex_score_rel == 1.0
    assert {(r.leg, r.status, r.n) for r in candidates.leg_report(c).filter("query_id = 'd'").collect()} == {(n, "skipped", 0) for n in candidates.LEGS}


def test_reasons(spark):
    schema = "query_id string, episode_id long, query_text string, podcast_title string, publisher string, title string, description string, lex_transcript double, wanted_language string, wanted_seconds int, duration_seconds int, lexical_rank int, e5_rank int, two_tower_rank int, words string"
    base = ("q", 1, "the salt road", "Roads", "Ana Lopes", "A title", "of salt", 0.0, "", 0, 61, 1, None, None, "w")
    def say(**change):
        names = [f.split(" ")[0] for f in schema.split(", ")]
        return ranking.explain(spark.createDataFrame([tuple(change.get(n, v) for n, v in zip(names, base))], schema)).first().reasons
    assert say() == "Description mentions “salt”"
    assert say(podcast_title="The Salt Road!") == "Show name matches “The Salt Road!”"
    assert say(podcast_title="Salt Road") == "Show “Salt Road” is named in your search"
    assert say(podcast_title="On the salt road again") == "Show name contains “the salt road”"
    assert say(publisher="salt", title="Road and salt") == "Published by salt; Episode title mentions “salt”, “road”"
    assert say(description=None) == "Found by keyword search (no exact word match)"
    assert say(description=None, lexical_rank=None, e5_rank=3, two_tower_rank=1) == "Found by semantic search (no exact word match)"
    assert say(description=None, lex_transcript=0.2, wanted_language="de", wanted_seconds=600) == "Transcript mentions your search terms; In German; 2 min (under 10)"
    assert say(query_text="a b c1 d2 e3 f4 g5", title="g5 f4 e3 d2 c1") == "Episode title mentions “c1”, “d2”, “e3”, “f4”, …"


def test_scores_with_fallback(spark):
    df = spark.createDataFrame([("q", 1, 0.5, 0.1), ("q", 2, 0.9, 0.2), ("r", 1, None, 0.1), ("r", 2, 0.9, 0.2), ("s", 1, float("nan"), 0.3), ("s", 2, 1.0, 0.3)], "query_id string, episode_id long, score double, rrf double")
    got = {(r.query_id, r.place): (r.episode_id, r.ordering) for r in candidates.scored(df, "score", "rrf").collect()}
    assert got == {("q", 1): (2, "ranker"), ("q", 2): (1, "ranker"), ("r", 1): (2, "rrf"), ("r", 2): (1, "rrf"), ("s", 1): (1, "rrf"), ("s", 2): (2, "rrf")}


def test_vector_functions(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first().x
    assert one(vectors.from_text(F.lit(" [1, -2.5] "))) == [1.0, -2.5] and one(vectors.from_text(F.lit("[1,x]"))) is None and one(vectors.from_text(F.lit("1,2"))) is None
    assert one(vectors.to_text(F.array(F.lit(1.0), F.lit(2.5)))) == "[1.0,2.5]"
    assert one(vectors.is_unit(F.array(F.lit(0.6), F.lit(0.8)))) and not one(vectors.is_unit(F.array(F.lit(0.6), F.lit(0.9))))
    assert one(vectors.unit(F.array(F.lit(0.0), F.lit(0.0)))) == [None, None]
    tokens = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(5.0), F.lit(6.0)))
    assert one(vectors.mean_pool(tokens, F.array(F.lit(0.0), F.lit(1.0)))) == [5.0, 6.0] and one(vectors.mean_pool(tokens, F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(vectors.encode(F.array().cast("array<string>"), "m")) is None
    lists = spark.createDataFrame([("l", 1), ("l", 2), ("l", 3), ("one", 1), ("l", 1)], "k string, episode_id long")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0])], "episode_id long, embedding array<float>")
    got = {r.k: (r.vectors, r.diversity) for r in vectors.list_diversity(lists, "k", v).collect()}
    assert got["one"] == (1, None) and got["l"][0] == 3 and abs(got["l"][1] - (1 - (0 + math.sqrt(0.5) * 2) / 3)) < 1e-6


def test_sources_share_one_plan(spark, tables, monkeypatch):
    written, store = [], lexical.store
    monkeypatch.setattr(lexical, "store", lambda df, label, **kw: written.append(label) or store(df, label, **kw))
    episodes, podcasts, told, _, asked = tables
    e, t, p = lexical.matches(episodes, podcasts, told, asked)
    assert written == ["terms", "asked", "lex"]
    # transcripts and shows have ids in common with episodes, but terms, scores and matches of their own
    assert {r[:2] for r in rows(t)} == {("a", 3), ("b", 3)} and {r[:2] for r in rows(p)} == {("a", 7)}
    alone = lexical.term_scores(episodes.withColumnRenamed("id", "episode_id"), "episode_id", {"A": F.col("title"), "B": F.col("description")}, asked)
    assert rows(lexical.match(alone, "episode_id", asked)) == rows(e)


@pytest.mark.parametrize("name", ["reproduction_problems", "bootstrap_paired", "audit_shares"])
def test_runs_are_stored_before_they_are_read(spark, name):
    assert not any("episodes.parquet" in f for f in entry.queries()[name](spark, entry.SMOKE).inputFiles())


def test_examples_are_stored_before_they_are_searched(spark):
    assert not any("episodes.parquet" in f for f in data_queries._example_catalogue(spark, entry.SMOKE)[1].queries.inputFiles())


def test_contract_functions(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first().x
    assert one(contract.language_code(F.lit(" German "))) == "de" and one(contract.language_code(F.lit("pt-BR"))) == "pt" and one(contract.language_code(F.lit(None).cast("string"))) == ""
    assert one(contract.feed_language(F.lit(" EN-us-x-aaaaaaaaaaaaaaaa"))) == "en-us-x-aaaaaaaa"
    assert one(contract.ids_of(F.array(F.lit(" True  Crime "), F.lit("food"), F.lit("x"), F.lit("food")), F.array(F.lit("food"), F.lit("true crime")))) == [0, 1]
    assert [one(contract.looks_like_person(F.lit(n))) for n in ("Ana Lopes", "Ana Maria Lopes", "Ana", "Blue Media", "ana lopes", "Jo B", None)] == [True, True, False, False, False, False, False]
    text = [F.lit(x) for x in (" Show ", None, "d" * 1200, "")]
    assert one(contract.passage(text[0], text[1].cast("string"), text[2], text[3], F.array(F.lit(" a "), F.lit("")))) == "passage: Show. Categories: a. " + "d" * 1000
    assert one(contract.passage(*[F.lit(None).cast("string")] * 4, F.lit(None).cast("array<string>"))) == ""
    assert [one(contract.fine_session(F.lit(s))) for s in ("a", "", "x" * 129, None)] == [True, False, False, False]
    assert [contract.clamp(n, 20, 100) for n in (None, 0, -1, 5, 500)] == [20, 20, 20, 5, 100]
    for bad in ({"language": "x" * 9}, {"seconds": -1}, {"after": "2024-13-01"}):
        with pytest.raises(ValueError):
            contract.fine_filters(**bad)
    with pytest.raises(ValueError):
        contract.clamp(51, 10, 50, strict=True)
    q = spark.createDataFrame([("1", "the ana lopes talk"), ("2", "lopes talk"), ("3", "zebra"), ("4", "salt"), ("5", None)], "query_id string, query_text string")
    names = spark.createDataFrame([("Ana Lopes",), ("Lopes & Co",), ("Salt",), (None,)], "name string")
    assert {r.query_id: r.span for r in contract.entity_spans(q, names).collect()} == {"1": "ana lopes", "2": "lopes talk", "3": "zebra", "4": "salt", "5": ""}


def test_rrf_has_no_row_without_legs(spark):
    df = spark.createDataFrame([], "query_id string, leg string, episode_id long, rank int")
    assert rows(retrieval.rrf(df, "episode_id", {"a": 1.0})) == []


def test_inverse_squares(spark):
    got = spark.createDataFrame([(0,), (1,), (3,), (50_000,)], "n long").select(lexical.inverse_squares(F.col("n")).alias("x")).collect()
    assert [round(r.x, 9) for r in got] == [0, 1, round(1 + 1 / 4 + 1 / 9, 9), round(sum(1 / i**2 for i in range(1, 50_001)), 9)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_systems_are_ranked_in_one_plan(spark, tables):
    """Seven systems: one ranking of the texts at their depths, one fusion, two of popular episodes; each as alone."""
    names = tuple(sorted(candidates.SYSTEMS))
    df = candidates.runs(names, candidates.Catalogue(*tables), 2)
    assert plan(df).count(" Window [") <= 4
    got, c = rows(df), candidates.Catalogue(*tables)
    for n in names:
        assert [r[1:] for r in got if r[0] == n] == rows(candidates.run(n, c, 2).select("query_id", "episode_id", "rank"))


def test_words_are_looked_up_and_joined_at_one_place(spark, tables, monkeypatch):
    """One look-up of words for three sources, two joins for the evidence of three."""
    written, store = {}, lexical.store
    monkeypatch.setattr(lexical, "store", lambda df, label, **kw: written.update({label: df}) or store(df, label, **kw))
    found = candidates.Catalogue(*tables).found()
    assert plan(written["terms"]).count("Join LeftSemi") == 1
    pairs = spark.createDataFrame([("a", 1, 7), ("a", 1, 7), ("a", 3, 8), ("b", 3, None), ("x", 1, 7)], "query_id string, episode_id long, podcast_id long")
    got = lexical.evidence(pairs, found)
    assert plan(got).count("Join ") == 2
    held = sorted((r.query_id, r.episode_id, r.lex_episode > 0, r.lex_transcript > 0, r.lex_opening > 0, r.lex_podcast > 0) for r in got.collect())
    assert held == [("a", 1, True, False, False, True)] * 2 + [("a", 3, False, True, True, False), ("b", 3, False, True, True, False), ("x", 1, False, False, False, False)]


def test_pool_ranks_its_sources_once(spark, tables):
    assert plan(lexical.pool(tables[0], candidates.Catalogue(*tables).found(), tables[4], 10)).count(" Window [") == 1


def test_queries_are_encoded_before_the_legs(spark, tables, monkeypatch):
    written, store = {}, candidates.store
    monkeypatch.setattr(candidates, "store", lambda df, label, **kw: written.update({label: df}) or store(df, label, **kw))
    candidates.Catalogue(*tables).legs(candidates.LEGS, 5)
    assert set(written) == {"leg-lexical", "leg-e5", "leg-two_tower"} and not any("sha2" in plan(df) for df in written.values())
