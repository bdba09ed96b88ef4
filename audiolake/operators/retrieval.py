"""Retrieval over a batch of queries: filters, exact vectors, popularity, fusion, diversity, suggestions.

Every operator takes all queries at once; vector search compares blocks with a matrix product inside each task and
lets only each task's best ``k`` leave it. All orders end with an id, so results are deterministic.

Defined results: NULL text is empty text; queries without words match nothing; NULL durations and dates
fail an active filter; ties go to the later date, then the smaller id; repeated queries are one query.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from audiolake.functions.numbers import usable_vector

#: Weights of the fields of an indexed record.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def passes(language: Column, wanted: Column, seconds: Column, most: Column, published: Column | None = None, after: Column | None = None, explicit: Column | None = None, clean_only: Column | None = None) -> Column:
    """Optional hard filters; each is off at '' / 0 / NULL / false. Language matches by prefix."""
    wanted, most = F.coalesce(wanted, F.lit("")), F.coalesce(most, F.lit(0))
    ok = ((wanted == "") | F.coalesce(F.startswith(F.lower(language), F.lower(wanted)), F.lit(False))) & ((most <= 0) | F.coalesce(seconds <= most, F.lit(False)))
    if published is not None and after is not None:
        ok &= after.isNull() | F.coalesce(published >= after, F.lit(False))
    if explicit is not None and clean_only is not None:
        ok &= ~clean_only | ~explicit
    return ok


def top(df: DataFrame, group: str | Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows of each group, numbered from 1 (planned as a group limit before the shuffle)."""
    group = [group] if isinstance(group, str) else list(group)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(name) <= k)


def vector_top(corpus: DataFrame, queries: DataFrame, k: int, dim: int, per_block: int = 4096, filtered: bool = False) -> DataFrame:
    """(query_id, id, similarity, rank): exact cosine top-k. ``corpus``: id, embedding. ``queries``: query_id, embedding.

    The stated queries are dealt to blocks of about ``per_block``, the corpus to parts; the queries of a block meet each part
    in one task, which reads the part in batches and lets only its best ``k`` per query leave. One query block
    reads the corpus once; nothing passes through the driver but the number of queries. ``filtered``: only records that pass
    the query's filters count; the corpus then has language and duration_seconds, the queries filter_language and filter_max_seconds.
    """
    kept = [F.lower(F.coalesce("language", F.lit(""))).alias("language"), F.coalesce("duration_seconds", F.lit(-1)).cast("long").alias("seconds")] if filtered else []
    wish = [F.lower(F.coalesce("filter_language", F.lit(""))).alias("language"), F.coalesce("filter_max_seconds", F.lit(0)).cast("long").alias("seconds")] if filtered else []
    extra = ["language", "seconds"] if filtered else []
    own = corpus.filter(usable_vector(F.col("embedding"), dim)).select("id", "embedding", *kept).dropDuplicates(["id"])
    asked = queries.filter(usable_vector(F.col("embedding"), dim)).select("query_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), *wish).dropDuplicates(["query_id"])
    names = asked.select("query_id").dtypes[0][1]
    if names != "bigint":  # the scan numbers queries
        numbered = asked.withColumn("number", F.xxhash64("query_id"))
        found = vector_top(corpus, numbered.withColumn("query_id", F.col("number")).withColumnsRenamed({"language": "filter_language", "seconds": "filter_max_seconds"}), k, dim, per_block, filtered)
        back = numbered.select(F.col("number").alias("query_id"), F.col("query_id").alias("name"))
        return found.join(back, "query_id").drop("query_id").withColumnRenamed("name", "query_id")
    parts = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-asked.count() // per_block))
    deal = lambda c, n: F.pmod(F.hash(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    stored = own.select(every(blocks).alias("block"), deal("id", parts).alias("part"), F.lit(False).alias("asks"), "id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), *extra)
    asking = asked.select(deal("query_id", blocks).alias("block"), every(parts).alias("part"), F.lit(True).alias("asks"), F.col("query_id").alias("id"), "embedding", *extra)
    cell = (F.col("block") * parts + F.col("part")).cast("int")
    rows = stored.unionByName(asking).repartitionById(blocks * parts, cell).sortWithinPartitions("block", "part", F.desc("asks"), "id")
    found = rows.mapInPandas(lambda batches: _scan_blocks(batches, k), "query_id long, id long, similarity double")
    return top(found, "query_id", [F.desc(F.round("similarity", 9)), F.asc("id")], k)


def _scan_blocks(batches, k: int):
    """Best ``k`` of each (block, part), whose queries come first."""
    key, ids, matrix, best, wish = None, None, None, [], None
    for pdf in batches:
        for group, part in pdf.groupby(["block", "part"], sort=False):
            if group != key:
                yield from _emit(ids, best)
                key, ids, matrix, best, wish = group, np.empty(0, np.int64), None, [], None
            x = np.stack(part["embedding"].to_list()).astype(np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            asks = part["asks"].to_numpy()
            if asks.any():
                ids = np.concatenate([ids, part["id"].to_numpy()[asks]])
                matrix = x[asks] if matrix is None else np.concatenate([matrix, x[asks]])
                if "language" in part:
                    wish = pd.concat([wish, part.loc[asks, ["language", "seconds"]]], ignore_index=True)
            if matrix is None or asks.all():
                continue
            own, x = part["id"].to_numpy()[~asks], x[~asks]
            out = _excluded(wish, part[~asks]) if wish is not None else None
            for at in range(0, len(own), 1024):
                s = np.round(matrix @ x[at : at + 1024].T, 9)
                if out is not None:
                    s[out[:, at : at + 1024]] = -9.0
                i = np.broadcast_to(own[at : at + 1024], s.shape)
                if best:
                    i, s = np.concatenate([best[0], i], axis=1), np.concatenate([best[1], s], axis=1)
                order = np.lexsort((i, -s), axis=1)[:, :k]
                best = [np.take_along_axis(i, order, axis=1), np.take_along_axis(s, order, axis=1)]
    yield from _emit(ids, best)


def _excluded(wish: pd.DataFrame, part: pd.DataFrame) -> np.ndarray:
    """Which records each query's filters exclude; a row per query. Equal filters are looked at once."""
    out = np.zeros((len(wish), len(part)), bool)
    for (language, seconds), rows in wish.groupby(["language", "seconds"]).groups.items():
        if language:
            out[rows] |= ~part["language"].str.startswith(language).to_numpy(bool)
        if seconds > 0:
            out[rows] |= ~part["seconds"].between(0, seconds).to_numpy()
    return out


def _emit(ids, best):
    if best:
        keep = best[1].ravel() > -2
        yield pd.DataFrame({"query_id": np.repeat(ids, best[0].shape[1])[keep], "id": best[0].ravel()[keep], "similarity": best[1].ravel()[keep]})


def popular(df: DataFrame, k: int, group: Sequence[str] = ()) -> DataFrame:
    """First ``k`` by popularity, then later date, then id."""
    order = [F.desc("popularity"), F.desc_nulls_last("published_at"), F.asc("id")]
    return df.orderBy(*order).limit(k) if not group else top(df, group, order, k)


def rrf(ranked: DataFrame, key: str, weights: dict[str, float] | None = None, constant: int = 60, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """(query_id, key, rrf_score, legs, one rank column per leg, rank) of (query_id, leg, key, rank) rows.

    One aggregation instead of full outer joins; order: score, more legs, smaller id. ``by``: what a ranking is made for.
    """
    legs = sorted(weights) if weights else None
    weight = F.lit(1.0)
    if weights:
        weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("leg")), F.lit(0.0))
    found = ranked.groupBy(*by, key).agg(
        F.round(F.sum(weight / (constant + F.col("rank"))), 12).alias("rrf_score"), F.count_distinct("leg").alias("legs"), *[F.min(F.when(F.col("leg") == leg, F.col("rank"))).alias(f"{leg}_rank") for leg in legs or []]
    )
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("rrf_score"), F.desc("legs"), F.asc(key))))


def diversify(neighbours: DataFrame, k: int, per_show: int = 2) -> DataFrame:
    """(…, pass, place): neighbours of a source spread over shows.

    ``neighbours``: source_id, source_show, id, show, distance. First other shows, then the own show, each with at most
    ``per_show`` records, then the nearest leftovers.
    """
    by_show = Window.partitionBy("source_id", "show").orderBy("distance", "id")
    rows = neighbours.withColumn("n", F.row_number().over(by_show))
    rows = rows.withColumn("pass", F.when((F.col("n") <= per_show) & (F.col("show") != F.col("source_show")), 0).when(F.col("n") <= per_show, 1).otherwise(2)).drop("n")
    return top(rows, "source_id", [F.asc("pass"), F.asc("distance"), F.asc("id")], k, "place")


def suggest(names: DataFrame, prefix: str, most: int = 8, pool: int = 40) -> DataFrame:
    """(text, kind, place): titles and publishers in which a word starts with ``prefix``, without repeats by case.

    ``names``: title, publisher, popularity. The prefix has 2 to 80 characters.
    """
    p = prefix.strip().lower()
    if not 2 <= len(p) <= 80:
        raise ValueError("prefix length must be between 2 and 80")
    starts = lambda c: F.coalesce(F.startswith(F.lower(c), F.lit(p)) | F.contains(F.lower(c), F.lit(" " + p)), F.lit(False))
    first = names.filter(starts(F.col("title")) | starts(F.col("publisher"))).orderBy(F.desc("popularity"), "title", "publisher").limit(pool)
    order = Window.orderBy(F.desc("popularity"), "title", "publisher")  # over at most ``pool`` rows
    rows = first.withColumn("row", F.row_number().over(order)).select("row", F.posexplode(F.array("title", "publisher")).alias("slot", "text"))
    rows = rows.filter(starts(F.col("text"))).withColumn("n", F.row_number().over(Window.partitionBy(F.lower("text")).orderBy("row", "slot"))).filter("n = 1")
    kind = F.when(F.col("slot") == 0, "show").otherwise("publisher")
    return rows.withColumn("place", F.row_number().over(Window.orderBy("row", "slot"))).filter(F.col("place") <= most).select("text", kind.alias("kind"), "place")
