"""Graded-relevance evaluation: per-query metrics, groups, cohorts, bootstrap, gates, parity.

Runs: (query_id, episode_id, rank). Judgments: (query_id, episode_id, grade), relevant from grade 1 on. Per
query the judged list is short, so the metrics are window and conditional sums; nothing is collected.

Defined results: queries without a relevant item are skipped; an item that a run repeats counts at its first rank;
ties in the ideal order do not change a metric; empty runs score 0; NULL grades are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def per_query(runs: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (5, 10, 100), relevant: int = 1) -> DataFrame:
    """(query_id, relevant, recall@k, hit@k, ndcg@k, mrr, map@10, p@5, p@10, judged@10), metrics rounded to 6 places."""
    grades = qrels.filter(F.col("grade").isNotNull()).groupBy("query_id", "episode_id").agg(F.max("grade").alias("grade"))
    run = runs.groupBy("query_id", "episode_id").agg(F.min("rank").alias("rank"))
    run = run.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "episode_id")))
    query = Window.partitionBy("query_id")
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1.0)
    ideal = grades.withColumn("i", F.row_number().over(query.orderBy(F.desc("grade"), "episode_id")))
    base = ideal.groupBy("query_id").agg(
        F.count_if(F.col("grade") >= relevant).alias("relevant"),
        *[F.sum(F.when(F.col("i") <= k, gain(F.col("grade"), F.col("i"))).otherwise(0.0)).alias(f"ideal{k}") for k in ks],
    ).filter(F.col("relevant") > 0)
    joined = run.join(grades, ["query_id", "episode_id"], "left").join(base.select("query_id"), "query_id", "left_semi")
    rel = F.coalesce(F.col("grade") >= relevant, F.lit(False)).cast("int")
    joined = joined.withColumn("rel", rel).withColumn("hits", F.sum("rel").over(query.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    inside = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0))
    found = joined.groupBy("query_id").agg(
        *[inside(k).alias(f"n{k}") for k in {*ks, 5, 10}],
        *[F.sum(F.when((F.col("rank") <= k) & F.col("grade").isNotNull(), gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias(f"dcg{k}") for k in ks],
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when((F.col("rank") <= 10) & (F.col("rel") == 1), F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap"),
        F.count_if((F.col("rank") <= 10) & F.col("grade").isNotNull()).alias("judged"),
        F.max("rank").alias("length"),
    )
    rows = base.join(found, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        "query_id",
        "relevant",
        *[F.round(zero(F.col(f"n{k}")) / F.col("relevant"), 6).alias(f"recall_{k}") for k in ks],
        *[(zero(F.col(f"n{k}")) > 0).cast("int").alias(f"hit_{k}") for k in ks],
        *[F.round(F.coalesce(F.try_divide(zero(F.col(f"dcg{k}")), F.col(f"ideal{k}")), F.lit(0.0)), 6).alias(f"ndcg_{k}") for k in ks],
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(zero(F.col("ap")) / F.least(F.col("relevant"), F.lit(10)), 6).alias("map_10"),
        F.round(zero(F.col("n5")) / 5, 6).alias("p_5"),
        F.round(zero(F.col("n10")) / 10, 6).alias("p_10"),
        F.round(zero(F.col("judged")) / F.greatest(F.least(zero(F.col("length")), F.lit(10)), F.lit(1)), 6).alias("judged_10"),
    )


def grouped(metrics: DataFrame, groups: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """(grouping, value, queries, mean…): means over all queries and by each of ``columns``, in one pass of grouping sets."""
    joined = metrics.join(groups.select("query_id", *columns), "query_id", "left")
    sets = F.explode(F.array(F.struct(F.lit("all").alias("grouping"), F.lit("").alias("value")), *[F.struct(F.lit(c).alias("grouping"), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("none")).alias("value")) for c in columns]))
    rows = joined.select(sets.alias("s"), *names)
    return rows.groupBy("s.grouping", "s.value").agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(n), 4).alias(n) for n in names])


def cohort_recall(runs: DataFrame, qrels: DataFrame, cohorts: DataFrame, k: int) -> DataFrame:
    """(cohort, queries, recall): recall@k over the relevant items of each (overlapping) cohort of items."""
    rel = qrels.filter("grade >= 1").select("query_id", "episode_id").distinct().join(cohorts.select("episode_id", "cohort").distinct(), "episode_id")
    got = runs.filter(F.col("rank") <= k).select("query_id", "episode_id", F.lit(1).alias("got")).distinct()
    per = rel.join(got, ["query_id", "episode_id"], "left").groupBy("cohort", "query_id").agg((F.count("got") / F.count(F.lit(1))).alias("r"))
    return per.groupBy("cohort").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("r"), 6).alias("recall"))


def pairwise_accuracy(scored: DataFrame) -> DataFrame:
    """(query_id, pairs, right, accuracy) over pairs of a query's judged items with different grades; NULL without such a pair. Columns: query_id, episode_id, score, grade.

    Counted without forming pairs: for items in the order of their scores, those of a smaller grade with a smaller score are
    the running counts by grade below the item's own, equal scores apart.
    """
    query, grades = Window.partitionBy("query_id"), range(4)
    below = Window.partitionBy("query_id").orderBy("score").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    at = Window.partitionBy("query_id", "score")
    one = lambda g: (F.col("grade") == g).cast("long")
    rows = scored.filter(F.col("grade").isNotNull() & F.col("score").isNotNull())
    rows = rows.select("query_id", "grade", "score", *[(F.sum(one(g)).over(below) - F.sum(one(g)).over(at)).alias(f"b{g}") for g in grades], *[F.sum(one(g)).over(query).alias(f"n{g}") for g in grades])
    smaller = lambda c: sum((F.when(F.col("grade") > g, F.col(f"{c}{g}")).otherwise(0) for g in grades), F.lit(0))
    sums = rows.groupBy("query_id").agg(F.sum(smaller("n")).alias("pairs"), F.sum(smaller("b")).alias("right")).filter("pairs > 0")
    return sums.select("query_id", "pairs", "right", F.round(F.col("right") / F.col("pairs"), 6).alias("accuracy"))


def pool_ndcg(scored: DataFrame, k: int) -> DataFrame:
    """(query_id, ndcg): linear gain over judged candidates only. Columns: query_id, episode_id, score, grade."""
    q = Window.partitionBy("query_id")
    rows = scored.withColumn("r", F.row_number().over(q.orderBy(F.desc("score"), "episode_id"))).withColumn("i", F.row_number().over(q.orderBy(F.desc("grade"), "episode_id")))
    dcg = lambda c: F.sum(F.when(F.col(c) <= k, F.col("grade") / F.log2(F.col(c) + 1.0)).otherwise(0.0))
    return rows.groupBy("query_id").agg(F.round(F.coalesce(F.try_divide(dcg("r"), dcg("i")), F.lit(0.0)), 6).alias("ndcg"))


def paired(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """(query_id, difference) over the queries that both runs have."""
    return a.select("query_id", F.col(metric).alias("x")).join(b.select("query_id", F.col(metric).alias("y")), "query_id").select("query_id", F.round(F.col("x") - F.col("y"), 9).alias("difference"))


def wins(differences: DataFrame) -> DataFrame:
    """One row (queries, wins, ties, losses, mean)."""
    d = F.col("difference")
    return differences.agg(F.count(F.lit(1)).alias("queries"), F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d < 0).alias("losses"), F.round(F.avg(d), 6).alias("mean"))


def bootstrap(differences: DataFrame, resamples: int = 10_000, seed: int = 42, parts: int = 8) -> DataFrame:
    """One row (mean, low, high, p_not_above): paired bootstrap of the mean over queries, bounds rounded to 4 places.

    A distributed estimator: instead of drawing all queries with replacement in one task, every query draws a Poisson(1)
    weight for each resample, from the digest of (seed, block, query), and a resample's mean is the weighted one. For many
    queries this is the multinomial bootstrap; no task needs all differences at once.
    """
    blocks = differences.select("query_id", "difference", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("block"))
    size = -(-resamples // parts)

    def draw(batches):
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                digest = hashlib.sha256(f"{seed}:{r.block}:{r.query_id}".encode()).digest()
                w = np.random.default_rng(int.from_bytes(digest[:8], "little")).poisson(1.0, size)
                sums = total.setdefault(r.block, np.zeros((2, size)))
                sums += np.stack([w * r.difference, w])
        for block, sums in total.items():
            yield pd.DataFrame({"block": block, "draw": np.arange(size), "s": sums[0], "w": sums[1]})

    draws = blocks.mapInPandas(draw, "block int, draw int, s double, w double").groupBy("block", "draw").agg(F.try_divide(F.sum("s"), F.sum("w")).alias("m"))
    stats = draws.agg(F.round(F.percentile("m", F.lit(0.025)), 4).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 4).alias("high"), F.round(F.avg((F.col("m") <= 0).cast("double")), 4).alias("p_not_above"))
    return differences.agg(F.round(F.avg("difference"), 4).alias("mean")).crossJoin(stats)  # one row each


def gates(candidate: DataFrame, baseline: DataFrame, primary: tuple[str, ...], tolerance: float = 0.05) -> DataFrame:
    """(name, gate, value, floor, passed): primary metrics must reach the baseline, others may fall short by the tolerance; a missing one fails."""
    joined = candidate.select("name", "value").join(baseline.select("name", F.col("value").alias("base")), "name", "full")
    gate = F.when(F.col("name").isin(list(primary)), "primary").otherwise("cohort")
    floor = F.when(gate == "primary", F.col("base")).otherwise(F.col("base") - tolerance)
    return joined.select("name", gate.alias("gate"), "value", F.round(floor, 6).alias("floor"), F.coalesce(F.col("value") >= floor, F.lit(False)).alias("passed"))


def regressions(values: DataFrame, baselines: list[str], tolerance: float = 0.05, least: int = 10) -> DataFrame:
    """(system, section, cohort, baseline, value, base, delta): cohorts in which a system trails a baseline by more than the tolerance.

    ``values``: system, section, cohort, value, queries. Cohorts of fewer than ``least`` queries are left out unless their
    number is unknown (0); baselines are never compared with each other.
    """
    base = values.filter(F.col("system").isin(baselines)).select(F.col("system").alias("baseline"), "section", "cohort", F.col("value").alias("base"))
    own = values.filter(~F.col("system").isin(baselines) & ((F.col("queries") == 0) | (F.col("queries") >= least)))
    rows = own.join(base, ["section", "cohort"]).filter(F.col("value") < F.col("base") - tolerance)
    return rows.select("system", "section", "cohort", "baseline", "value", "base", F.round(F.col("value") - F.col("base"), 4).alias("delta"))


def reproduced(values: DataFrame, expected: DataFrame, names: list[str], tolerance: float) -> DataFrame:
    """(system, metric, problem): metrics of ``values`` (system, metric, value) that differ from the recorded ones by more than the tolerance, or are missing."""
    systems = values.select("system").distinct().join(expected.select("system").distinct().withColumn("known", F.lit(True)), "system", "left")
    every = systems.withColumn("metric", F.explode(F.array(*[F.lit(n) for n in names])))
    rows = every.join(values, ["system", "metric"], "left").join(expected.withColumnRenamed("value", "want"), ["system", "metric"], "left")
    off = F.abs(F.col("value") - F.col("want")) > tolerance
    problem = F.when(F.col("known").isNull(), "no recorded expectation").when(F.col("value").isNull() | F.col("want").isNull(), "missing").when(off, F.format_string("%.3f, expected %.3f", F.col("value"), F.col("want")))
    return rows.select("system", "metric", problem.alias("problem")).filter(F.col("problem").isNotNull())


def split_ranks(positives: DataFrame, similarities: DataFrame) -> DataFrame:
    """(query_id, place): 1 and the number of pool items nearer than the positive. similarities: query_id, id, similarity."""
    target = positives.join(similarities, (positives["query_id"] == similarities["query_id"]) & (positives["positive_id"] == similarities["id"])).select(positives["query_id"], F.col("similarity").alias("own"))
    nearer = similarities.join(target, "query_id").groupBy("query_id").agg(F.count_if(F.col("similarity") > F.col("own")).alias("n"))
    return nearer.select("query_id", (F.col("n") + 1).alias("place"))


def pool_similarities(queries: DataFrame, pool: DataFrame, per_block: int = 256) -> DataFrame:
    """(query_id, id, similarity): cosines of every stated query with the shared pool, in blocks of queries.

    ``queries``: query_id, embedding; ``pool``: id, embedding; unit or not. A block of queries meets the pool in one task per
    part of it, as matrix products; what leaves is what was asked for, a number for each pair.
    """
    blocks = max(1, -(-queries.count() // per_block))
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), every(parts).alias("part"), F.lit(True).alias("asks"), F.col("query_id").cast("string").alias("key"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rest = pool.select(every(blocks).alias("block"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(False).alias("asks"), F.col("id").cast("string").alias("key"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))

    def run(batches):
        key, names, matrix = None, [], None
        for pdf in batches:
            for group, part in pdf.groupby(["block", "part"], sort=False):
                if group != key:
                    key, names, matrix = group, [], None
                x = np.stack(part["v"].to_list())
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                asks = part["asks"].to_numpy()
                keys = part["key"].to_numpy()
                if asks.any():
                    names += keys[asks].tolist()
                    matrix = x[asks] if matrix is None else np.concatenate([matrix, x[asks]])
                if matrix is not None and not asks.all():
                    s = np.round(matrix @ x[~asks].T, 9)
                    yield pd.DataFrame({"query_id": np.repeat(names, s.shape[1]), "id": np.tile(keys[~asks], len(names)), "similarity": s.ravel()})

    cell = (F.col("block") * parts + F.col("part")).cast("int")
    rows = asks.unionByName(rest).repartitionById(blocks * parts, cell).sortWithinPartitions("block", "part", F.desc("asks"), "key")
    found = rows.mapInPandas(run, "query_id string, id string, similarity double")
    return found.select(F.col("query_id").cast(queries.schema["query_id"].dataType), F.col("id").cast(pool.schema["id"].dataType).alias("id"), "similarity")


def list_report(lists: DataFrame, top: DataFrame) -> DataFrame:
    """(source_id, n, novelty, shows, repetition, top_decile_share, sim_mean, sim_min): what lists of similar episodes are like.

    lists: source_id, source_show, id, show, title, similarity. ``top``: podcast_id of the most popular decile.
    """
    rows = lists.join(top.select(F.col("podcast_id").alias("show"), F.lit(1).alias("hit")), "show", "left").withColumn("name", F.trim(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), "[^a-z0-9]+", " ")))
    n = F.count(F.lit(1))
    return rows.groupBy("source_id").agg(
        n.alias("n"), F.round(F.count_if(F.col("show") != F.col("source_show")) / n, 6).alias("novelty"), F.count_distinct("show").alias("shows"), F.round((n - F.count_distinct("name")) / n, 6).alias("repetition"),
        F.round(F.count("hit") / n, 6).alias("top_decile_share"), F.round(F.avg("similarity"), 6).alias("sim_mean"), F.round(F.min("similarity"), 6).alias("sim_min"),
    )


def top_decile(podcasts: DataFrame) -> DataFrame:
    """(podcast_id, popularity) of the shows at or above the cut-off, the value at place max(n // 10 - 1, 0) of the falling order, and above 0.

    Only two numbers reach the driver; the order is a distributed sort.
    """
    n = podcasts.count()
    place = max(n // 10 - 1, 0)
    cut = podcasts.select("popularity").orderBy(F.desc_nulls_last("popularity")).limit(place + 1).agg(F.min("popularity")).first()[0]
    return podcasts.filter((F.col("popularity") >= F.lit(cut)) & (F.col("popularity") > 0)).select(F.col("id").alias("podcast_id"), "popularity")


def coverage(runs: DataFrame, shows: DataFrame, head: DataFrame) -> DataFrame:
    """One row per system (system, results, distinct_items, catalog_coverage, tail_coverage) of runs (system, query_id, episode_id, rank).

    ``shows``: id, podcast_id of the catalogue; ``head``: podcast_id of the head.
    """
    size = shows.agg(F.count(F.lit(1)).alias("size"))
    of = shows.select(F.col("id").alias("episode_id"), "podcast_id").join(head.select("podcast_id", F.lit(1).alias("big")), "podcast_id", "left")
    rows = runs.join(of, "episode_id", "left")
    per = rows.groupBy("system").agg(F.count(F.lit(1)).alias("results"), F.count_distinct("episode_id").alias("distinct_items"), F.count_if(F.col("podcast_id").isNotNull() & F.col("big").isNull()).alias("tail"))
    return per.crossJoin(size).select("system", "results", "distinct_items", F.round(F.col("distinct_items") / F.col("size"), 6).alias("catalog_coverage"), F.round(F.col("tail") / F.col("results"), 4).alias("tail_coverage"))  # size: one row


def jaccard(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(query_id, jaccard, same_top): overlap of two systems' top-k sets and whether the lists are identical."""
    side = lambda x, n: x.filter(F.col("rank") <= k).select("query_id", "episode_id", F.col("rank").alias(n))
    both = side(a, "ra").join(side(b, "rb"), ["query_id", "episode_id"], "full")
    return both.groupBy("query_id").agg(F.round(F.count_if(F.col("ra").isNotNull() & F.col("rb").isNotNull()) / F.count(F.lit(1)), 6).alias("jaccard"), F.bool_and(F.col("ra").eqNullSafe(F.col("rb"))).alias("same_top"))


def shift(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """(feature, max_difference, standard_shift, missing): parity of two feature tables joined on query and episode."""
    j = a.alias("a").join(b.alias("b"), ["query_id", "episode_id"])
    stacked = j.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"a.{n}").alias("x"), F.col(f"b.{n}").alias("y")) for n in names])).alias("s")).select("s.*")
    spread = F.stddev_pop("x")
    return stacked.groupBy("feature").agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("max_difference"), F.coalesce(F.try_divide(F.abs(F.avg("x") - F.avg("y")), spread), F.lit(0.0)).alias("standard_shift"), F.count_if(F.isnan("x") | F.isnan("y")).alias("missing"))


def head_shows(counts: DataFrame, share: float) -> DataFrame:
    """Shows of the head: the first max(1, int(n * share)) by falling count, then id. Columns: podcast_id, episodes.

    Only the number of shows reaches the driver; the order is a distributed sort.
    """
    most = max(1, int(counts.count() * share))
    return counts.orderBy(F.desc("episodes"), "podcast_id").limit(most)
