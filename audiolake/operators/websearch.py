"""Web-search syntax over records: words, "phrases", ``or`` between words, ``-excluded`` words.

A query is clauses that must all hold, each a list of alternatives, each a run of words; excluded clauses must not
hold. It enters by the clause that the fewest records can meet, through the rarest word of each alternative; the rest is
looked up in the record's own positions.

Defined results: NULL text is empty text; queries without a required word match nothing; an unclosed quotation mark
opens a phrase to the end; repeated queries are one query; fields are apart, so no phrase spans two.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from audiolake.functions import text
from audiolake.plans.guards import spread
from audiolake.session import store

_CLAUSES = "array<struct<excluded:boolean,options:array<array<string>>>>"
#: Distance in positions between the fields of a record.
APART = 10_000_000


def parse(raw: str | None) -> list[tuple[bool, list[list[str]]]]:
    """(excluded, alternatives) of each clause, alternatives as runs of normalised words."""
    out: list[tuple[bool, list[list[str]]]] = []
    either = False
    for minus, quoted, bare in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', raw or ""):
        if bare.lower() == "or" and not minus:
            either = bool(out)
            continue
        run = re.sub(r"[^0-9a-z]+", " ", (quoted or bare).lower()).split()
        if not run:
            continue
        if minus:
            out.append((True, [run]))
        elif either and out and not out[-1][0]:
            out[-1][1].append(run)
        else:
            out.append((False, [run]))
        either = False
    return out


def parsed(queries: DataFrame) -> DataFrame:
    """(query_id, clauses) of (query_id, query_text)."""

    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda q: [{"excluded": e, "options": o} for e, o in parse(q)])

    udf = F.pandas_udf(run, _CLAUSES)
    return queries.dropDuplicates(["query_id"]).select("query_id", udf("query_text").alias("clauses"))


def match(df: DataFrame, key: str, fields: list[str], queries: DataFrame) -> DataFrame:
    """(query_id, key) of the records that meet a query."""
    asked = store(parsed(queries), "parsed")
    words = F.flatten(F.flatten(F.transform("clauses", lambda c: c["options"])))
    vocabulary = asked.select(F.explode(words).alias("term")).distinct()
    parts = F.array(*[F.struct(text.words(F.col(f)).alias("w"), F.lit(i * APART).alias("at")) for i, f in enumerate(fields)])
    places = spread(df.select(key, *fields), key).select(key, F.explode(parts).alias("p")).select(key, F.posexplode("p.w").alias("i", "term"), F.col("p.at").alias("at"))
    places = places.join(vocabulary, "term", "left_semi").groupBy(key, "term").agg(F.sort_array(F.collect_list(F.col("i") + F.col("at"))).alias("at"))
    places = store(places, "places")
    held = places.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    options = asked.select("query_id", F.posexplode("clauses").alias("clause", "c")).filter(~F.col("c.excluded")).select("query_id", "clause", F.posexplode("c.options").alias("option", "run"))
    rarest = options.select("query_id", "clause", "option", F.explode("run").alias("term")).join(held, "term", "left").groupBy("query_id", "clause", "option").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")).alias("r"))
    entry = rarest.groupBy("query_id", "clause").agg(F.sum("r.n").alias("n"), F.collect_list("r.term").alias("terms")).groupBy("query_id").agg(F.min(F.struct("n", "clause", "terms")).alias("e"))
    entry = entry.select("query_id", F.explode(F.array_distinct("e.terms")).alias("term")).join(asked, "query_id")
    records = places.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "at"))).alias("m"))
    met = records.select(key, "m", F.explode(F.map_keys("m")).alias("term")).join(entry, "term")
    at = lambda t: F.coalesce(F.try_element_at("m", t), F.array().cast("array<int>"))
    follows = lambda run, p: F.forall(F.transform(run, lambda t, i: F.array_contains(at(t), p + i)), lambda ok: ok)
    holds = lambda run: F.exists(at(run[0]), lambda p: follows(run, p))
    fine = F.forall("clauses", lambda c: F.exists(c["options"], holds) != c["excluded"])
    return met.filter(fine).select("query_id", key).distinct()
