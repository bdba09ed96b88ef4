"""Queries of the training-data operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from audiolake.llm import consensus, knn, languages, leakage, lookalikes, mixing, neardup, turns
from audiolake.session import read_table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return turns.turns(read_table(spark, d, "transcripts"), read_table(spark, d, "transcript_speakers")).select("transcript_id", "turn_no", "speaker_no")


def p1_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns.turns(read_table(spark, d, "transcripts"), read_table(spark, d, "transcript_speakers"))


def _language_records(spark: SparkSession, d: str) -> DataFrame:
    shows = read_table(spark, d, "podcasts").select(F.lit("podcast").alias("record_kind"), F.col("id").alias("record_id"), F.col("language").alias("label"), F.col("description").alias("text"))
    docs = read_table(spark, d, "documents").select(F.lit("document").alias("record_kind"), F.col("doc_id").alias("record_id"), F.col("lang").alias("label"), "text")
    return shows.unionByName(docs)


def p2_languages(spark: SparkSession, d: str) -> DataFrame:
    done = languages.identify(_language_records(spark, d))
    return done.select("record_kind", "record_id", "label", "language", F.round("confidence", 4).alias("confidence"), F.size("passages").alias("passages"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    done = languages.identify(_language_records(spark, d)).filter(F.col("language").isNotNull())
    wrong = F.when(~F.col("named").eqNullSafe(F.col("language")), F.array(F.struct(F.col("record_kind").alias("record_kind"), F.col("language").alias("language")))).otherwise(F.array())
    inside = F.when(F.col("record_kind") == "document", F.transform(F.filter("passages", lambda p: p["sentences"] >= 2), lambda p: F.struct(F.lit("segment").alias("record_kind"), p["language"].alias("language")))).otherwise(F.array())
    rows = done.select("record_id", F.explode(F.concat(wrong, inside)).alias("r"))
    return rows.select("r.record_kind", "record_id", "r.language").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = knn.nearest(read_table(spark, d, "episode_embeddings"), k=10, least_cosine=0.9)
    return near.select("model", F.least("episode_id", "neighbour_id").alias("episode_id_a"), F.greatest("episode_id", "neighbour_id").alias("episode_id_b")).distinct()


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar of every episode whose id is divisible by 50."""
    return knn.search(read_table(spark, d, "episode_embeddings"), F.col("episode_id") % 50 == 0)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(read_table(spark, d, "eval_items"), read_table(spark, d, "documents")).select("item_id", "doc_id")


def p7_proximity(spark: SparkSession, d: str) -> DataFrame:
    near = leakage.proximity(read_table(spark, d, "eval_items"), read_table(spark, d, "documents"))
    return near.select("item_id", "doc_id", "matched", F.round("share", 6).alias("share"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    same = lookalikes.pairs(read_table(spark, d, "documents"), "doc_id", "text")
    return same.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p9_groups(spark: SparkSession, d: str) -> DataFrame:
    """Documents that read alike but are stored differently, a row each with group, variant, copies and links."""
    return lookalikes.groups(read_table(spark, d, "documents"), "doc_id", "text")


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    done = lookalikes.form(read_table(spark, d, "documents").select("doc_id", "text"), "text")
    return done.select("doc_id", "form", (F.col("form") != F.col("text")).alias("changed"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    same = neardup.pairs(read_table(spark, d, "episodes"), "id", "title", "description")
    return same.select(F.col("a").alias("episode_id_a"), F.col("b").alias("episode_id_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Episodes with partners by the rule of p4_found (title and description), in groups."""
    return neardup.groups(read_table(spark, d, "episodes"), "id", "title", "description")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    items = consensus.consensus(read_table(spark, d, "judgments"))
    return items.filter((F.col("votes") >= 3) & (F.col("stated") > 1)).select("query_id", "episode_id", "grade")


def p5_judges(spark: SparkSession, d: str) -> DataFrame:
    return consensus.reliability(read_table(spark, d, "judgments")).select("judge", "votes", F.round("accuracy", 4).alias("accuracy"))


def p5_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.alpha(read_table(spark, d, "judgments"))


P5_AGREEMENT_SQL = """
WITH v AS (
  SELECT query_id, episode_id, lower(trim(judge)) AS judge, arg_max(grade, (try_cast(judged_at AS TIMESTAMPTZ), grade)) AS grade
  FROM judgments WHERE grade BETWEEN 0 AND 3 AND trim(judge) <> '' AND query_id IS NOT NULL AND episode_id IS NOT NULL GROUP BY 1, 2, 3),
i AS (
  SELECT query_id, episode_id, count(*) AS m, count(*) FILTER (grade = 0) AS n0, count(*) FILTER (grade = 1) AS n1,
    count(*) FILTER (grade = 2) AS n2, count(*) FILTER (grade = 3) AS n3 FROM v GROUP BY 1, 2 HAVING count(*) > 1),
t AS (
  SELECT count(*) AS items, CAST(sum(m) AS BIGINT) AS votes,
    sum(round((n0*(n0-1) + n1*(n1-1) + n2*(n2-1) + n3*(n3-1)) / (m - 1), 9)) AS agree,
    sum(n0) AS n0, sum(n1) AS n1, sum(n2) AS n2, sum(n3) AS n3 FROM i),
o AS (
  SELECT items, votes, 1 - agree / votes AS observed,
    1 - (n0*(n0-1) + n1*(n1-1) + n2*(n2-1) + n3*(n3-1)) / (votes * (votes - 1)) AS expected FROM t)
SELECT items, votes, round(observed, 6) AS observed, round(expected, 6) AS expected, round(1 - observed / expected, 6) AS alpha FROM o
"""


def p8_mix_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes = mixing.sized(read_table(spark, d, "documents"))
    return mixing.report(sizes, mixing.rates(sizes, read_table(spark, d, "mix_targets")))


def p8_mix_records(spark: SparkSession, d: str) -> DataFrame:
    sizes = mixing.sized(read_table(spark, d, "documents"))
    return mixing.mixed(sizes, mixing.rates(sizes, read_table(spark, d, "mix_targets")))


QUERIES = {
    "p1_found": p1_found,
    "p1_turns": p1_turns,
    "p2_found": p2_found,
    "p2_languages": p2_languages,
    "p3_found": p3_found,
    "p3_neighbours": p3_neighbours,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_judges": p5_judges,
    "p5_agreement": p5_agreement,
    "p7_found": p7_found,
    "p7_proximity": p7_proximity,
    "p8_mix_shares": p8_mix_shares,
    "p8_mix_records": p8_mix_records,
    "p9_found": p9_found,
    "p9_forms": p9_forms,
    "p9_groups": p9_groups,
}
SQL: dict[str, str] = {"p5_agreement": P5_AGREEMENT_SQL}
