"""Ranking features of candidates and the reasons for a result: column expressions and three window maxima, no UDF.

Defined results: NULL and NaN numbers count as 0, a missing date as 3,650 days, a date in the future as 0 days; names
shorter than three characters are contained nowhere; an empty query has no matches and coverage 0.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from audiolake.functions import text
from audiolake.functions.numbers import age_days

MISSING_AGE = 3650.0
LEGS = ("lexical", "e5", "two_tower")
# Names of the features, in the order of the matrix.
FEATURES = (
    "two_tower_sim two_tower_sim_gap e5_sim e5_sim_gap transcript_sim lex_score lex_score_rel lex_episode lex_transcript lex_podcast "
    "lexical_rr e5_rr two_tower_rr legs rrf_score "
    "show_exact show_in_query query_in_show show_coverage publisher_exact publisher_in_query publisher_coverage query_in_title title_coverage description_coverage query_tokens "
    "log_age_days log_duration log_show_episodes popularity has_transcript"
).split()
# Words that explain nothing.
STOP_WORDS = "a an the of and or in on for to with about is how what de la el en y le der die das und do da e o".split()
# Names of languages.
LANGUAGE_NAMES = {"en": "English", "es": "Spanish", "fr": "French", "de": "German", "pt": "Portuguese"}


def clean(value: Column, default: float = 0.0) -> Column:
    """NULL and NaN become ``default``."""
    value = value.cast("double")
    return F.coalesce(F.nanvl(value, F.lit(default)), F.lit(default))


def features(candidates: DataFrame, now: datetime) -> DataFrame:
    """(query_id, episode_id, the 31 features) of the rows of :func:`audiolake.operators.candidates.candidates`."""
    query = Window.partitionBy("query_id")
    c = candidates.select("*", text.normalize(F.col("query_text")).alias("q"), text.words(F.col("query_text")).alias("qw"))
    c = c.withColumns({"show": text.normalize(F.col("podcast_title")), "named": text.normalize(F.col("title")), "by": text.normalize(F.col("publisher"))})
    number = {n: clean(F.col(n)) for n in ("two_tower_sim", "e5_sim", "transcript_sim", "lex_episode", "lex_transcript", "lex_podcast", "popularity")}
    c = c.withColumn("lex", number["lex_episode"] + number["lex_transcript"] + 0.5 * number["lex_podcast"])
    one = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    share = lambda name: text.coverage(F.col("qw"), text.words(F.col(name)))
    best = F.max("lex").over(query)
    rank = {leg: F.col(f"{leg}_rank") for leg in LEGS}
    gap = lambda n: number[n] - F.max(number[n]).over(query)
    same = lambda name: one((F.col(name) != "") & (F.col("q") == F.col(name)))
    values = {
        **number,
        "two_tower_sim_gap": gap("two_tower_sim"),
        "e5_sim_gap": gap("e5_sim"),
        "lex_score": F.col("lex"),
        "lex_score_rel": F.when(best > 0, F.col("lex") / best).otherwise(0.0),
        **{f"{leg}_rr": F.coalesce(1.0 / r, F.lit(0.0)) for leg, r in rank.items()},
        "legs": sum((r.isNotNull().cast("double") for r in rank.values()), F.lit(0.0)),
        "rrf_score": sum((F.coalesce(1.0 / (60 + r), F.lit(0.0)) for r in rank.values()), F.lit(0.0)),
        "show_exact": same("show"),
        "show_in_query": one(text.holds(F.col("q"), F.col("show"))),
        "query_in_show": one(text.holds(F.col("show"), F.col("q"))),
        "show_coverage": share("podcast_title"),
        "publisher_exact": same("by"),
        "publisher_in_query": one(text.holds(F.col("q"), F.col("by"))),
        "publisher_coverage": share("publisher"),
        "query_in_title": one(text.holds(F.col("named"), F.col("q"))),
        "title_coverage": share("title"),
        "description_coverage": share("description"),
        "query_tokens": F.size("qw").cast("double"),
        "log_age_days": F.log1p(F.coalesce(age_days(F.col("published_at"), now), F.lit(MISSING_AGE))),
        "log_duration": F.log1p(F.greatest(F.lit(0.0), clean(F.col("duration_seconds")))),
        "log_show_episodes": F.log1p(clean(F.col("show_episodes"))),
        "has_transcript": one(F.col("has_transcript")),
    }
    return c.select("query_id", "episode_id", *[values[n].alias(n) for n in FEATURES])


def _quoted(words: Column) -> Column:
    """Words in quotation marks, at most four and then an ellipsis."""
    marked = F.transform(words, lambda w: F.concat(F.lit("“"), w, F.lit("”")))
    return F.array_join(F.when(F.size(words) > 4, F.concat(F.slice(marked, 1, 4), F.array(F.lit("…")))).otherwise(marked), ", ")


def explain(c: DataFrame) -> DataFrame:
    """(query_id, episode_id, reasons): why a candidate was found, joined by ``; ``.

    What the words of the query match comes first (the description only where nothing before it did), then the filters
    it passes, and the kinds of search that found it if there is nothing else.
    """
    q, show, named, by = (text.normalize(F.col(x)) for x in ("query_text", "podcast_title", "title", "publisher"))
    c = c.withColumns({"_q": q, "_show": show, "_by": by})
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    shared = lambda name: F.filter(F.array_intersect(F.split("_q", " "), text.words(F.col(name))), lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w))
    c = c.withColumns({"_t": shared("title"), "_d": shared("description")})
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    q, show, by = F.col("_q"), F.col("_show"), F.col("_by")
    matched = F.array_compact(
        F.array(
            F.when((q != "") & (q == show), say("Show name matches “", F.col("podcast_title"), "”"))
            .when(text.holds(q, show), say("Show “", F.col("podcast_title"), "” is named in your search"))
            .when(text.holds(show, q), say("Show name contains “", F.col("query_text"), "”")),
            F.when((q != "") & (by != "") & ((q == by) | text.holds(q, by)), say("Published by ", F.col("publisher"))),
            F.when(F.size("_t") > 0, say("Episode title mentions ", _quoted(F.col("_t")))),
        )
    )
    c = c.withColumn("_m", matched)
    names = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    wanted = F.coalesce(F.col("wanted_language"), F.lit(""))
    seconds = F.col("duration_seconds").cast("long")
    rest = F.array_compact(
        F.array(
            F.when((F.size("_m") == 0) & (F.size("_d") > 0), say("Description mentions ", _quoted(F.col("_d")))),
            F.when(clean(F.col("lex_transcript")) > 0, F.lit("Transcript mentions your search terms")),
            F.when(wanted != "", say("In ", F.coalesce(F.try_element_at(names, wanted), F.lit("")))),
            F.when((F.coalesce(F.col("wanted_seconds"), F.lit(0)) > 0) & seconds.isNotNull(), say(F.floor((seconds + 59) / 60).cast("string"), " min (under ", F.floor(F.col("wanted_seconds") / 60).cast("string"), ")")),
        )
    )
    kinds = F.array_distinct(F.array_compact(F.array(F.when(F.col("lexical_rank").isNotNull(), F.lit("keyword search")), F.when(F.col("e5_rank").isNotNull() | F.col("two_tower_rank").isNotNull(), F.lit("semantic search")))))
    source = F.array(say("Found by ", F.when(F.size(kinds) > 0, F.array_join(kinds, " and ")).otherwise("search"), " (no exact word match)"))
    every = F.concat(F.col("_m"), rest)
    return c.select("query_id", "episode_id", F.array_join(F.when(F.size(every) > 0, every).otherwise(source), "; ").alias("reasons"))
