"""Feature contract: vocabularies' ids, intent flags, passages, names of persons; validation of caller's filters and sessions.

Defined results: values outside a vocabulary have id 0 (languages) or no id (categories); NULL reads as missing; empty parts leave no
separator behind; an empty passage has no prefix.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from audiolake.functions import text

# English names that stand for language codes.
LANGUAGE_ALIASES = {"dutch": "nl", "english": "en", "french": "fr", "german": "de", "italian": "it", "portuguese": "pt", "spanish": "es"}
# Words of names of organisations.
ORGANISATION_WORDS = "media network networks studios studio productions production radio news podcasts podcast entertainment company public press audio broadcasting inc llc".split()
# Upper edges of the buckets, in minutes and days, and the limits of passages in characters.
DURATION_MINUTES, AGE_DAYS = (5, 15, 30, 45, 60, 90, 120), (7, 30, 90, 365, 1095)
DESCRIPTION_CHARS, TRANSCRIPT_CHARS = 1000, 2000
QUERY_PREFIX, PASSAGE_PREFIX = "query: ", "passage: "


def language_code(value: Column) -> Column:
    """Primary subtag of a language, English names read as their codes."""
    code = text.primary_subtag(value)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGE_ALIASES.items() for x in kv]), code), code)


def feed_language(value: Column) -> Column:
    """Language as a feed states it: lower case, trimmed, at most 16 characters."""
    return F.left(F.lower(F.trim(F.coalesce(value, F.lit("")))), F.lit(16))


def category_name(value: Column) -> Column:
    """Lower case, trimmed, runs of blanks as one."""
    return F.regexp_replace(F.lower(F.trim(value)), r"\s+", " ")


def vocabulary(values: DataFrame, column: str, least: int) -> DataFrame:
    """(value, id): distinct values by falling count, then name, numbered from 1, of at least ``least`` rows. A vocabulary is small by its threshold."""
    counted = values.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least) & (F.col("value") != ""))
    return counted.select("value", F.row_number().over(Window.orderBy(F.desc("n"), "value")).alias("id"))


def ids_of(values: Column, known: Column) -> Column:
    """Sorted ids (places in ``known``, from 0) of the values that it has, each once."""
    places = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.array_position(known, category_name(v)) - 1)
    return F.array_sort(F.array_distinct(F.filter(places, lambda p: p >= 0)))


def intent_flags(language: Column, seconds: Column, after: Column, clean_only: Column) -> list[Column]:
    """Whether each filter is set, as numbers."""
    one = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return [one(F.trim(language) != "").alias("has_language"), one(seconds != 0).alias("has_max_duration"), one(after.isNotNull()).alias("has_published_after"), one(clean_only).alias("no_explicit")]


def tidy(value: Column) -> Column:
    """Trimmed text, '' for NULL."""
    return F.trim(F.coalesce(value, F.lit("")))


def passage(show: Column, title: Column, description: Column, publisher: Column, categories: Column) -> Column:
    """The text of an episode for an encoder: show, title, categories, publisher and the head of the description."""
    names = F.filter(F.transform(F.coalesce(categories, F.array().cast("array<string>")), tidy), lambda c: c != "")
    some = lambda c, prefix="": F.when(c != "", F.concat(F.lit(prefix), c))
    parts = F.array_compact(F.array(some(tidy(show)), some(tidy(title)), some(F.array_join(names, ", "), "Categories: "), some(tidy(publisher), "Publisher: "), some(F.left(tidy(description), F.lit(DESCRIPTION_CHARS)))))
    return F.when(F.size(parts) > 0, F.concat(F.lit(PASSAGE_PREFIX), F.array_join(parts, ". "))).otherwise("")


def looks_like_person(name: Column) -> Column:
    """Two or three capitalised words, none of an organisation."""
    shape = F.coalesce(name.rlike("^[A-Z][a-z]+( [A-Z][a-z]+){1,2}$"), F.lit(False))
    return shape & ~F.arrays_overlap(F.split(F.lower(F.coalesce(name, F.lit(""))), " "), F.array(*[F.lit(w) for w in ORGANISATION_WORDS]))


def fine_session(session: Column) -> Column:
    """A session id of 1 to 128 characters."""
    return F.coalesce(F.length(session).between(1, 128), F.lit(False))


def fine_filters(language: str = "", seconds: int = 0, after: str = "") -> None:
    """Raise for a language of more than 8 characters, a negative duration or a date that is none."""
    if len(language) > 8:
        raise ValueError(f"language {language!r} is longer than 8 characters")
    if seconds < 0:
        raise ValueError("the duration is negative")
    if after:
        date.fromisoformat(after)


def clamp(limit: int | None, default: int, most: int, strict: bool = False) -> int:
    """A caller's limit: the default for none or 0 and below, at most ``most``, beyond which a strict one is an error."""
    if strict and (limit or 0) > most:
        raise ValueError(f"limit is above {most}")
    return default if not limit or limit < 0 else min(limit, most)


def entity_spans(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, span): the longest run of a query's words, then the first, that is in a name as whole words.

    ``queries``: query_id, query_text; ``names``: name. A single word of a longer query and a query without such a run
    give the whole query. Runs of names and of queries meet by equality, so names are read once.
    """
    tokens = queries.dropDuplicates(["query_id"]).select("query_id", text.words(F.col("query_text")).alias("w"))
    runs = lambda df, *keep: df.select(*keep, F.col("w"), F.posexplode("w").alias("i", "_")).select(*keep, "i", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("i")), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("w", F.col("i") + 1, n), " ").alias("run")))).alias("r")).select(*keep, "i", "r.n", "r.run")
    own = runs(tokens, "query_id")
    longest = tokens.agg(F.max(F.size("w"))).first()[0] or 0
    known = names.select(text.words(F.col("name")).alias("w")).distinct()
    known = runs(known.filter(F.size("w") > 0)).filter(F.col("n") <= longest).select("run").distinct()
    best = own.join(known, "run", "left_semi").groupBy("query_id").agg(F.max_by("run", F.struct("n", -F.col("i"))).alias("run"), F.max("n").alias("n"))
    whole = F.array_join("w", " ")
    return tokens.join(best, "query_id", "left").select("query_id", F.when(F.col("run").isNull() | ((F.col("n") == 1) & (F.size("w") > 1)), whole).otherwise(F.col("run")).alias("span"))
