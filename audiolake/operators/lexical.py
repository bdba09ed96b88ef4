"""Full text over three sources for a batch of queries: scored terms, rarest-term entry, one ranked list.

Each source keeps one row per (record, query term) with the term's score, so that the words of a record are read once
whatever the number of queries. A query enters by its rarest term only: the records that hold it are looked at, and
the query's other terms are looked up in the same record, so frequent words never form a list of their own. A record's
terms are put together once, whatever the number of queries that enter it.

Stored rows of words and scores take a few bytes each as files and a hundred in memory, so that the size of the files says little
about a broadcast: joins with what grows with the records are merges.

The score of a term takes its weights in falling order, sum of w_i / i**2 scaled by 6 / pi**2; a query's score is the mean
over its terms. Stemming is not applied; words are those of the ``simple`` configuration in every language.

Defined results: NULL text is empty text; queries without words and queries with a word that no record holds match nothing;
an active filter excludes NULL durations; ties go to the later date, then the smaller id; repeated queries are one query.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from audiolake.functions import text
from audiolake.plans.guards import spread
from audiolake.operators.retrieval import WEIGHTS, passes, top
from audiolake.session import store

#: Characters indexed of an episode's description, a show's description and a transcript, and of the opening that ranks.
DESCRIPTION, SHOW, TRANSCRIPT, OPENING = 100_000, 50_000, 500_000, 8_000
#: Queries that are broadcast at most, a few hundred bytes each.
FEW = 20_000


def inverse_squares(n: Column) -> Column:
    """1 + 1/4 + ... + 1/n**2; 0 for n < 1."""
    step = lambda s, i: s + 1.0 / (i.cast("double") * i)
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(0.0), step)).otherwise(0.0)


def term_score(counts: dict[str, Column]) -> Column:
    """Score of a term from its counts by weight letter."""
    total, before, seen = F.lit(0.0), F.lit(0.0), F.lit(0)
    for letter in sorted(counts):
        seen = seen + counts[letter]
        now = inverse_squares(seen)
        total, before = total + WEIGHTS[letter] * (now - before), now
    return total * (6 / math.pi**2)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, terms): the distinct words of each query that has any."""
    rows = queries.select("query_id", F.array_distinct(text.words(F.col("query_text"))).alias("terms")).filter(F.size("terms") > 0)
    return rows.dropDuplicates(["query_id"])


def texts_of(df: DataFrame, key: str, fields: dict[str, Column], opening: Column | None = None) -> DataFrame:
    """(key, texts): the fields of a record as an array of (t, f); ``f``: the weight letter, or ``opening``."""
    parts = [F.struct(t.alias("t"), F.lit(letter).alias("f")) for letter, t in fields.items()]
    parts += [F.struct(opening.alias("t"), F.lit("opening").alias("f"))] if opening is not None else []
    return spread(df, key).select(key, F.array(*parts).alias("texts"))


def found_words(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, f): every word of the texts."""
    return texts.select(*keys, F.explode("texts").alias("p")).select(*keys, F.explode(text.words(F.col("p.t"))).alias("term"), F.col("p.f").alias("f"))


def scores_of(words: DataFrame, keys: list[str], letters: Sequence[str], queries: DataFrame, opened: bool) -> DataFrame:
    """(keys, term, score), stored: the query terms among ``words`` (keys, term, f). A letter without words adds nothing."""
    vocabulary = queries.select(F.explode(text.words(F.col("query_text"))).alias("term")).distinct()
    found = words.join(vocabulary, "term", "left_semi").groupBy(*keys, "term").agg(*[F.count_if(F.col("f") == letter).alias(letter) for letter in letters], F.count_if(F.col("f") == "opening").alias("o"))
    out = [term_score({letter: F.col(letter) for letter in letters}).alias("score")]
    out += [(WEIGHTS[max(letters)] * 6 / math.pi**2 * inverse_squares(F.col("o"))).alias("opened")] if opened else []
    return store(found.select(*keys, "term", *out), "terms")


def term_scores(df: DataFrame, key: str, fields: dict[str, Column], queries: DataFrame, opening: Column | None = None) -> DataFrame:
    """(key, term, score), stored: the query terms of every record. ``fields``: weight letter -> text.

    ``opening`` adds the column ``opened``: the score in that text alone, under the last weight.
    """
    return scores_of(found_words(texts_of(df, key, fields, opening), [key]), [key], list(fields), queries, opening is not None)


def match(table: DataFrame, key: str | Sequence[str], queries: DataFrame, scores: tuple[str, ...] = ("score",)) -> DataFrame:
    """(query_id, key, scores…) of the records that hold every word of a query.

    A key of several columns ends with the record; those before tell sources apart, each with rarest terms of its own.
    """
    key = [key] if isinstance(key, str) else list(key)
    by = key[:-1]
    held = table.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("n"))
    asked = query_terms(queries).select("query_id", F.size("terms").alias("need"), F.explode("terms").alias("term")).join(held, "term")
    asked = asked.groupBy(*by, "query_id", "need").agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("n", "term")).alias("entry"), F.sort_array(F.collect_set("term")).alias("terms"))
    asked = store(asked.filter(F.col("found") == F.col("need")).select(*by, "query_id", F.col("entry.term").alias("term"), "terms"), "asked")
    asked = F.broadcast(asked) if asked.count() <= FEW else asked.hint("merge")
    record = F.map_from_entries(F.collect_list(F.struct("term", F.struct(*scores).alias("s"))))
    records = table.groupBy(*key).agg(record.alias("m"))
    entered = table.select(*key, "term").join(asked, [*by, "term"]).select(*key, "query_id", "terms")
    met = entered.join(records.hint("merge"), key).filter(F.forall("terms", lambda t: F.map_contains_key("m", t)))
    mean = lambda s: F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + F.try_element_at("m", t)[s]) / F.size("terms")
    return met.select("query_id", *key, *[mean(s).alias(s) for s in scores])


def matches(episodes: DataFrame, podcasts: DataFrame, transcripts: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What matches in each source: (query_id, episode_id, lex_episode), (…, episode_id, lex_transcript, lex_opening) and (…, podcast_id, lex_podcast).

    The sources go through one plan, a column telling them apart: three would be compiled and held in the driver's memory at once. They
    are united as texts, so that words are split, and looked up among those of the queries, at one place of the plan.
    """
    e, t = episodes.select("id", "title", "description"), transcripts.select(F.col("episode_id").alias("id"), "content")
    p = podcasts.select("id", "title", "publisher", "categories", "description")
    names = F.concat_ws(" ", "publisher", F.array_join("categories", " "))
    parts = [
        texts_of(e, "id", {"A": F.col("title"), "B": F.left("description", F.lit(DESCRIPTION))}),
        texts_of(t, "id", {"D": F.left("content", F.lit(TRANSCRIPT))}, F.left("content", F.lit(OPENING))),
        texts_of(p, "id", {"A": F.col("title"), "B": names, "C": F.left("description", F.lit(SHOW))}),
    ]
    first, second, third = (x.withColumn("source", F.lit(n)) for n, x in enumerate(parts))
    words = found_words(first.unionByName(second).unionByName(third), ["source", "id"])
    terms = scores_of(words, ["source", "id"], list(WEIGHTS), queries, True)
    found = store(match(terms, ["source", "id"], queries, ("score", "opened")), "lex", by="source")
    of = lambda n, key, *scores: found.filter(F.col("source") == n).select("query_id", F.col("id").alias(key), *scores)
    score, opened = F.col("score"), F.col("opened")
    return of(0, "episode_id", score.alias("lex_episode")), of(1, "episode_id", score.alias("lex_transcript"), opened.alias("lex_opening")), of(2, "podcast_id", score.alias("lex_podcast"))


def evidence(pairs: DataFrame, found: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """``pairs`` (query_id, episode_id, podcast_id, …) with the score of every source, 0 where it does not match.

    Episodes and transcripts, with one key, are put together before they are joined.
    """
    e, t, p = found
    names = ["lex_episode", "lex_transcript", "lex_opening"]
    own = e.unionByName(t, allowMissingColumns=True).groupBy("query_id", "episode_id").agg(*[F.max(n).alias(n) for n in names])
    rows = pairs.join(own.hint("merge"), ["query_id", "episode_id"], "left").join(p.hint("merge"), ["query_id", "podcast_id"], "left")
    return rows.na.fill(0.0, ["lex_episode", "lex_transcript", "lex_opening", "lex_podcast"])


def order(score: str) -> list[Column]:
    return [F.desc(F.round(score, 9)), F.desc_nulls_last("published_at"), F.asc("episode_id")]


def pool(episodes: DataFrame, found: tuple[DataFrame, DataFrame, DataFrame], queries: DataFrame, depth: int) -> DataFrame:
    """(query_id, episode_id, published_at, score, first): each source's best ``depth`` under the query's filters, united.

    ``first`` is the best place that a source gives, so that the pool of any smaller depth is a filter of this one. A transcript
    matches as a whole and ranks by its opening; a show counts half and matches for all its episodes. One join and one ranking serve
    all sources: an episode is there once for each, under the key that the source has for it.
    """
    sources = list(zip(found, ("episode_id", "episode_id", "podcast_id"), ("lex_episode", "lex_opening", "lex_podcast"), strict=True))
    e = episodes.select(F.col("id").alias("episode_id"), "podcast_id", "language", "duration_seconds", "published_at")
    e = e.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("source"), F.col(on).alias("key")) for n, (_, on, _) in enumerate(sources)])).alias("s")).select("*", "s.*").drop("s")
    asked = queries.dropDuplicates(["query_id"]).select("query_id", "filter_language", "filter_max_seconds")
    ok = passes(F.col("language"), F.col("filter_language"), F.col("duration_seconds"), F.col("filter_max_seconds"))
    first, second, third = (rows.select("query_id", F.lit(n).alias("source"), F.col(on).alias("key"), F.col(score).alias("score")) for n, (rows, on, score) in enumerate(sources))
    kept = first.unionByName(second).unionByName(third).hint("merge").join(e, ["source", "key"]).join(asked, "query_id").filter(ok)
    best = top(kept, ["source", "query_id"], order("score"), depth, "place")
    every = best.groupBy("query_id", "episode_id", "podcast_id", "published_at").agg(F.min("place").alias("first"))
    total = F.col("lex_episode") + F.col("lex_opening") + 0.5 * F.col("lex_podcast")
    return evidence(every, found).select("query_id", "episode_id", "published_at", total.alias("score"), "first")


def cuts(pooled: DataFrame, depths: dict[str, int]) -> DataFrame:
    """(system, query_id, episode_id, rank): the pool at the depth of each system, ranked by the sum, in one plan. ``pooled``: of these depths or more."""
    taken = F.explode(F.array(*[F.struct(F.lit(n).alias("system"), F.lit(k).alias("depth")) for n, k in depths.items()]))
    rows = pooled.select("*", taken.alias("s")).select("*", "s.*").filter(F.col("first") <= F.col("depth"))
    return top(rows, ["system", "query_id"], order("score"), max(depths.values())).filter(F.col("rank") <= F.col("depth")).select("system", "query_id", "episode_id", "rank")


def cut(pooled: DataFrame, k: int) -> DataFrame:
    """(query_id, episode_id, score, rank): the pool of depth ``k``, ranked by the sum. ``pooled``: of that depth or more."""
    return top(pooled.filter(F.col("first") <= k), "query_id", order("score"), k).select("query_id", "episode_id", F.round("score", 6).alias("score"), "rank")


def ranked(episodes: DataFrame, found: tuple[DataFrame, DataFrame, DataFrame], queries: DataFrame, k: int) -> DataFrame:
    """(query_id, episode_id, score, rank): each source's best ``k`` under the query's filters, united and ranked by the sum."""
    return cut(pool(episodes, found, queries, k), k)
