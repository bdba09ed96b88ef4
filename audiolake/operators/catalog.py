"""Catalogue maintenance: identity upsert, merges, cascades, pending work, job states, effective judgments.

All are set operations on whole batches. Batches have a position, so that what a row-at-a-time merge
decides by arrival is decided here by order.

Defined results: empty strings are missing keys; among incoming rows with one identity the first by position counts;
empty inputs give empty results; extra columns are ignored unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from audiolake.functions.hashing import excerpt_hash


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key in the order; rows whose first key is NULL are all kept."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter((F.col("_n") == 1) | F.col(keys[0]).isNull()).drop("_n")


def upsert_actions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(position, stored_id, matched_by, action) of incoming items against stored ones.

    stored: id, podcast_id, rss_guid, enclosure_url, content_hash; incoming: the same and position instead of id. An item is
    the stored row with its GUID, else with its enclosure (a known enclosure adopts a new GUID), else with its
    hash; ``action`` is insert, update (hash changed) or unchanged. Items without any key are left out.
    """
    inc = incoming.select("position", "podcast_id", blank_to_null(F.col("rss_guid")).alias("g"), blank_to_null(F.col("enclosure_url")).alias("u"), blank_to_null(F.col("content_hash")).alias("h"))
    inc = inc.filter(F.coalesce("g", "u", "h").isNotNull())
    inc = first_by(inc.withColumn("k", F.coalesce(F.concat(F.lit("g:"), "g"), F.concat(F.lit("u:"), "u"), F.concat(F.lit("h:"), "h"))), ["k", "podcast_id"], [F.asc("position")])
    side = lambda c, a: stored.filter(blank_to_null(F.col(c)).isNotNull()).groupBy(F.col("podcast_id").alias("p"), F.trim(c).alias(a)).agg(F.min_by(F.struct("id", "content_hash"), "id").alias(f"m{a}"))
    m = inc
    for c, a in (("rss_guid", "g"), ("enclosure_url", "u"), ("content_hash", "h")):
        s = side(c, a).alias("s")
        m = m.join(s, (F.col("s.p") == m["podcast_id"]) & (F.col(f"s.{a}") == m[a]), "left").drop(F.col("s.p")).drop(F.col(f"s.{a}"))
    hit = F.coalesce("mg", "mu", "mh")
    by = F.when(F.col("mg").isNotNull(), "guid").when(F.col("mu").isNotNull(), "enclosure").when(F.col("mh").isNotNull(), "hash")
    action = F.when(hit.isNull(), "insert").when(by.isin("guid", "enclosure") & ~hit["content_hash"].eqNullSafe(F.col("h")), "update").otherwise("unchanged")
    return m.select("position", hit["id"].alias("stored_id"), by.alias("matched_by"), action.alias("action"))


def merge_greatest(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the larger of old and new value; keys of either side, one row each."""
    return old.select(key, value).unionByName(new.select(key, value)).groupBy(key).agg(F.max(value).alias(value))


def merge_replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and of ``old`` whose keys ``new`` lacks."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``new`` that are inserted: keys not yet stored, the first by ``order`` each."""
    return first_by(new.filter(F.col(key).isNotNull()), [key], [F.asc(order)]).join(old.select(key), key, "left_anti")


def cascade_counts(removed: DataFrame, tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(table_name, deleted): rows of each table that go with the removed keys."""
    gone = removed.select(key).distinct()
    parts = [t.join(gone, key, "left_semi").agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(n).alias("table_name"), "deleted") for n, t in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pending(items: DataFrame, done: DataFrame, model: str) -> DataFrame:
    """(id, reason): items that have no vector of the model, or one of another content."""
    own = done.filter(F.col("model") == model).groupBy(F.col("episode_id").alias("id")).agg(F.max("content_hash").alias("was"))
    joined = items.select("id", "content_hash").join(own, "id", "left")
    reason = F.when(F.col("was").isNull(), "missing").when(~F.col("was").eqNullSafe(F.col("content_hash")), "stale")
    return joined.select("id", reason.alias("reason")).filter(F.col("reason").isNotNull())


def excerpts_pending(transcripts: DataFrame, done: DataFrame, chars: int) -> DataFrame:
    """(episode_id, excerpt_hash, reason): transcripts whose excerpt of ``chars`` characters has no vector, or one of another excerpt."""
    own = done.groupBy("episode_id").agg(F.max("content_hash").alias("was"))
    rows = transcripts.filter(F.trim("content") != "").select("episode_id", excerpt_hash(F.col("content"), chars).alias("excerpt_hash")).join(own, "episode_id", "left")
    return rows.select("episode_id", "excerpt_hash", F.when(F.col("was").isNull(), "missing").when(F.col("was") != F.col("excerpt_hash"), "stale").alias("reason")).filter("reason IS NOT NULL")


def snapshot(episodes: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Episodes in the order of their ids with ``position``, ``has_transcript`` and ``transcript_chars``; the order is a distributed sort."""
    from audiolake.operators.datasets import numbered

    told = transcripts.groupBy(F.col("episode_id").alias("id")).agg(F.max(F.length(F.coalesce("content", F.lit("")))).alias("transcript_chars"))
    rows = numbered(episodes.drop("has_transcript").join(told, "id", "left"), [F.col("id")], "position")
    return rows.withColumn("has_transcript", F.col("transcript_chars").isNotNull()).withColumn("transcript_chars", F.coalesce("transcript_chars", F.lit(0)))


def without(removed: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The rows of a table that stay when the removed keys go."""
    return table.join(removed.select(key).distinct(), key, "left_anti")


def unknown_references(rows: DataFrame, known: dict[str, DataFrame]) -> DataFrame:
    """(reference, value, rows): values of the named columns that their table lacks; NULL counts as unknown. An export must find none."""
    parts = []
    for column, table in known.items():
        own = rows.select(F.col(column).alias("v")).join(table.select(F.col(column).alias("v")).distinct(), "v", "left_anti")
        parts.append(own.groupBy(F.col("v").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(column).alias("reference"), "value", "rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def freshness(embeddings: DataFrame, models: list[str], now: Column) -> DataFrame:
    """(model, n, age_seconds) of every model asked for; a model without vectors has n 0 and no age."""
    every = embeddings.sparkSession.createDataFrame([(m,) for m in models], "model string")
    have = embeddings.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("newest"))
    return every.join(have, "model", "left").select("model", F.coalesce("n", F.lit(0)).alias("n"), ((F.unix_micros(now) - F.unix_micros("newest")) / 1e6).alias("age_seconds"))


def due(feeds: DataFrame, next_at: str, now: Column, window_seconds: int, most: int = 500) -> DataFrame:
    """(id, key): the first ``most`` feeds to poll, never polled ones first, with the key under which a poll of this window is queued once."""
    rows = feeds.filter(F.col(next_at).isNull() | (F.col(next_at) <= now)).orderBy(F.asc_nulls_first(next_at), "id").limit(most)
    return rows.select("id", F.concat(F.lit("feed:"), F.col("id").cast("string"), F.lit(":"), F.floor(F.unix_seconds(now) / window_seconds).cast("string")).alias("key"))


def enqueue(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of ``asked`` (kind, key, position, …) that become jobs: without a key all, with one the first whose (kind, key) no job has."""
    free = asked.filter(F.col("key").isNull())
    first = first_by(asked.filter(F.col("key").isNotNull()), ["kind", "key"], [F.asc("position")])
    return free.unionByName(first.join(jobs.select("kind", "key").filter("key IS NOT NULL").distinct(), ["kind", "key"], "left_anti").select(*asked.columns))


def reaped(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose lease is over (id, status, attempts, most, lease_expires_at): pending again, or dead after the last attempt."""
    over = jobs.filter((F.col("status") == "running") & (F.col("lease_expires_at") < now))
    return over.select("id", F.when(F.col("attempts") >= F.col("most"), "dead").otherwise("pending").alias("status"), F.when(F.col("attempts") >= F.col("most"), "lease expired after final attempt").alias("last_error"))


def effective_grades(judgments: DataFrame, is_human: Column) -> DataFrame:
    """(query_id, episode_id, grade): one grade per pair, human before model, then the latest, then the larger."""
    order = F.struct(is_human.cast("int").alias("a"), F.coalesce(F.col("judged_at"), F.lit("")).alias("b"), F.col("grade").alias("c"))
    return judgments.filter(F.col("grade").between(0, 3)).groupBy("query_id", "episode_id").agg(F.max_by("grade", order).cast("int").alias("grade"))


def job_step(status: Column, attempts: Column, most: Column, outcome: Column, lease_over: Column) -> Column:
    """Next state of a job: outcomes done / failed / permanent; an expired lease counts as a failed attempt."""
    spent = attempts >= most
    running = F.when(outcome == "done", "completed").when(outcome == "permanent", "dead").when(outcome == "failed", F.when(spent, F.lit("dead")).otherwise("pending"))
    running = running.when(lease_over, F.when(spent, F.lit("dead")).otherwise("pending")).otherwise(status)
    return F.when(status == "running", running).otherwise(status)
