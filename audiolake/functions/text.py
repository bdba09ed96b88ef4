"""Text expressions: normalisation, tokens, containment, configuration by language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages with a text-search configuration, by primary subtag.
CONFIGS = {"en": "english", "de": "german", "fr": "french", "es": "spanish", "pt": "portuguese", "it": "italian", "nl": "dutch"}


def normalize(text: Column) -> Column:
    """Lower case; every run outside [0-9a-z] is one blank; trimmed. NULL reads as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^0-9a-z]+", " "))


def words(text: Column) -> Column:
    """Normalised tokens in order, without empty ones."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^0-9a-z]+"), lambda w: w != "")


def holds(haystack: Column, needle: Column, least: int = 3) -> Column:
    """Whole-token containment of normalised ``needle``; needles shorter than ``least`` never match."""
    return (F.length(needle) >= least) & F.contains(F.concat(F.lit(" "), haystack, F.lit(" ")), F.concat(F.lit(" "), needle, F.lit(" ")))


def coverage(query_words: Column, text_words: Column) -> Column:
    """Share of the query's tokens, with repeats, that occur in the text; 0 for an empty query."""
    return F.coalesce(F.try_divide(F.size(F.filter(query_words, lambda w: F.array_contains(text_words, w))), F.size(query_words)), F.lit(0.0))


def primary_subtag(language: Column) -> Column:
    """Part of a language tag before '-' or '_', lower-cased and trimmed; '' for NULL."""
    return F.split(F.translate(F.lower(F.trim(F.coalesce(language, F.lit("")))), "_", "-"), "-")[0]


def ts_config(language: Column) -> Column:
    """Text-search configuration of a language tag, ``simple`` if there is none."""
    pairs = [F.lit(x) for kv in CONFIGS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), primary_subtag(language)), F.lit("simple"))


def canonical_url(url: Column) -> Column:
    """http(s) URL with lower-case scheme and host, without default port and fragment; NULL for anything else."""
    shape = r"^([a-zA-Z]+)://([^/?#:]+)(:[0-9]+)?([^#]*)(#.*)?$"
    text = F.trim(url)
    scheme, port = F.lower(F.regexp_extract(text, shape, 1)), F.regexp_extract(text, shape, 3)
    default = ((scheme == "http") & (port == ":80")) | ((scheme == "https") & (port == ":443"))
    full = F.concat(scheme, F.lit("://"), F.lower(F.regexp_extract(text, shape, 2)), F.when(default, F.lit("")).otherwise(port), F.regexp_extract(text, shape, 4))
    return F.when(text.rlike(shape) & scheme.isin("http", "https"), full)


def duration_seconds(text: Column) -> Column:
    """Seconds of ``S``, ``M:S`` or ``H:M:S``; NULL for more parts, signs or anything else."""
    clean = F.trim(text)
    parts = F.split(clean, ":")
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc * 60 + F.coalesce(p.try_cast("bigint"), F.lit(0)))
    return F.when(clean.rlike(r"^[0-9]{1,9}(:[0-9]{1,9}){0,2}$"), total)


def is_yes(text: Column) -> Column:
    """True for yes, true and explicit in any case; NULL reads as false."""
    return F.coalesce(F.lower(F.trim(text)).isin("yes", "true", "explicit"), F.lit(False))
