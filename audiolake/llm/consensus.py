"""Consensus from several annotators' labels: iteratively reweighted voting.

A vote of a judge counts for each grade by the judge's weight, the logarithm of the smoothed rate with which the
judge states the voted grade when that grade is the consensus. Rates are estimated against the leave-one-out
consensus (the weighted vote of all others on the item), so no judge confirms their own vote; both steps
alternate until no rate moves by the tolerance any more; after ``most_rounds`` without that it is an error. A rate per consensus grade, not one accuracy per judge, is kept, because
judges that are always one grade too high, or always answer the same, are otherwise misread; the
reliability that is reported is the usual single accuracy. Agreement is chance-corrected and allows missing
ratings (Krippendorff's alpha, nominal).

The votes are stored once, gathered by item: a judge votes once on an item, so an item has at most as many votes as there
are judges. While there are at most ``gathered`` judges, a round reads the items, looks the rates up in one row that
every task gets, and shuffles only the sums by judge; beyond that many judges votes stay rows of their own and a round
shuffles by item and by judge. Both ways give the same rates.

Defined results: only integer grades 0..``grades-1`` count, the latest of a judge per item (ties: the larger
grade); judge names are compared in lower case without outer blanks, NULL or blank names and NULL keys are left
out; repeated rows count once; a grade tie goes to the smaller grade; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from audiolake.session import store

ITEM = ["query_id", "episode_id"]


def votes(judgments: DataFrame, grades: int = 4) -> DataFrame:
    """(query_id, episode_id, judge, grade): the one vote of each judge on each item."""
    judge = F.lower(F.trim("judge"))
    rows = judgments.select(*ITEM, judge.alias("judge"), "grade", F.col("judged_at").cast("string").alias("at"))
    rows = rows.filter(F.col("judge").isNotNull() & (F.col("judge") != "") & F.col("grade").between(0, grades - 1) & F.col("query_id").isNotNull() & F.col("episode_id").isNotNull())
    at = F.coalesce(F.try_to_timestamp("at"), F.timestamp_micros(F.lit(0)))
    latest = F.max_by("grade", F.struct(at, F.col("grade")))
    return rows.groupBy(*ITEM, "judge").agg(latest.cast("int").alias("grade"))


def _posterior(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores)
    parts = [F.exp(s - top) for s in scores]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def _rates(counts: np.ndarray, prior: float, least: float) -> np.ndarray:
    """(judge, consensus grade, stated grade): smoothed rates of sums of the same shape."""
    grades = counts.shape[1]
    base = np.full((grades, grades), (1 - least) / (grades - 1))
    np.fill_diagonal(base, least)
    smooth = counts + prior * base
    return smooth / smooth.sum(axis=2, keepdims=True)


def _accuracy(counts: np.ndarray, prior: float, least: float) -> np.ndarray:
    return (np.trace(counts, axis1=1, axis2=2) + prior * least) / (counts.sum(axis=(1, 2)) + prior)


class Fit:
    """Items with the scores of their grades, and the judges with their accuracies."""

    def __init__(self, items: DataFrame, judges: list[str], accuracy: np.ndarray, rounds: int):
        self.items, self.judges, self.accuracy, self.rounds = items, judges, accuracy, rounds


def reweigh(cast: DataFrame, grades: int = 4, tolerance: float = 0.002, prior: float = 4.0, start: float = 0.6, most_rounds: int = 200, gathered: int = 10_000) -> Fit:
    """Alternate consensus and rates until these are stable. The sums by judge (16 numbers each) reach the driver in every round."""
    cast = store(cast, "votes")
    spark = cast.sparkSession
    names = [r.judge for r in cast.select("judge").distinct().orderBy("judge").toLocalIterator()]  # judges, not votes
    numbers = spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "judge string, j int")
    coded = cast.join(numbers, "judge").select(*ITEM, (F.col("j") * grades + F.col("grade")).alias("v"))
    every = range(grades)
    together = len(names) <= gathered
    if together:
        votes_ = store(coded.groupBy(*ITEM).agg(F.sort_array(F.collect_list("v")).alias("vs")), "items")  # at most a vote of each judge
    else:
        votes_ = store(coded, "items")

    def scored(rates: np.ndarray) -> DataFrame:
        """Votes, or items of votes, with the sum s of the log rates under each grade."""
        w = np.log(rates).transpose(1, 0, 2).reshape(grades, -1)
        if together:
            row = spark.createDataFrame([tuple(x.tolist() for x in w)], ", ".join(f"w{c} array<double>" for c in every))
            total = lambda w: F.aggregate("vs", F.lit(0.0), lambda s, v: s + w[v])
            sums = [total(F.col(f"w{c}")).alias(f"s{c}") for c in every]
            return votes_.crossJoin(F.broadcast(row)).select("*", *sums, F.size("vs").alias("votes"))  # one row of 16 numbers a judge, of at most ``gathered``
        table = spark.createDataFrame([(v, *map(float, w[:, v])) for v in range(w.shape[1])], ", ".join(["v int", *[f"w{c} double" for c in every]]))
        item = Window.partitionBy(*ITEM)
        return votes_.join(table, "v").select("*", *[F.sum(f"w{c}").over(item).alias(f"s{c}") for c in every], F.count(F.lit(1)).over(item).alias("votes"))

    counts = np.zeros((len(names), grades, grades))
    rates, rounds = _rates(counts, prior, start), 0
    while names:
        rows = scored(rates).filter(F.col("votes") > 1)
        if together:
            rows = rows.select(*[f"s{c}" for c in every], *[f"w{c}" for c in every], F.explode("vs").alias("v")).select("v", *[f"s{c}" for c in every], *[F.col(f"w{c}")[F.col("v")].alias(f"w{c}") for c in every])
        others = _posterior([F.col(f"s{c}") - F.col(f"w{c}") for c in every])
        sums = rows.select("v", *[p.alias(f"p{c}") for c, p in enumerate(others)]).groupBy("v").agg(*[F.sum(f"p{c}").alias(f"p{c}") for c in every])
        counts = np.zeros((len(names), grades, grades))
        for r in sums.toLocalIterator():
            counts[r.v // grades, :, r.v % grades] = [r[f"p{c}"] for c in every]
        new = _rates(counts, prior, start)
        moved = np.abs(new - rates).max()
        rates, rounds = new, rounds + 1
        if moved < tolerance:
            break
        if rounds >= most_rounds:
            raise RuntimeError(f"the rates still move by {moved:.4f} after {rounds} rounds")
    items = scored(rates)
    if not together:
        items = items.groupBy(*ITEM).agg(F.sort_array(F.collect_list("v")).alias("vs"), *[F.first(f"s{c}").alias(f"s{c}") for c in every], F.first("votes").alias("votes"))
    return Fit(items.select(*ITEM, "vs", "votes", *[f"s{c}" for c in every]), names, _accuracy(counts, prior, start), rounds)


def consensus(judgments: DataFrame, grades: int = 4, **options) -> DataFrame:
    """(query_id, episode_id, grade, confidence, votes, stated, agreement): one row per item.

    ``agreement`` is the share of agreeing pairs of votes, NULL for a single vote.
    """
    items = reweigh(votes(judgments, grades), grades, **options).items
    given = F.transform("vs", lambda v: v % grades)
    of = lambda g: F.size(F.filter("given", lambda x: x == g))
    n = [of(g) for g in range(grades)]
    pairs = sum((x * (x - 1) for x in n[1:]), n[0] * (n[0] - 1))
    shares = F.array(*_posterior([F.round(F.col(f"s{c}"), 9) for c in range(grades)]))
    items = items.withColumn("given", given).withColumn("shares", shares).withColumn("confidence", F.array_max("shares"))
    return items.select(
        *ITEM,
        (F.array_position("shares", F.col("confidence")) - 1).cast("int").alias("grade"),
        "confidence",
        F.col("votes").cast("long").alias("votes"),
        F.size(F.array_distinct("given")).cast("long").alias("stated"),
        F.when(F.col("votes") > 1, pairs / (F.col("votes") * (F.col("votes") - 1))).alias("agreement"),
    )


def reliability(judgments: DataFrame, grades: int = 4, **options) -> DataFrame:
    """(judge, votes, accuracy): the smoothed leave-one-out accuracy of each judge."""
    cast = votes(judgments, grades)
    fit = reweigh(cast, grades, **options)
    known = cast.sparkSession.createDataFrame(list(zip(fit.judges, map(float, fit.accuracy), strict=True)), "judge string, accuracy double")
    return cast.groupBy("judge").agg(F.count(F.lit(1)).alias("votes")).join(known, "judge")


def alpha(judgments: DataFrame, grades: int = 4) -> DataFrame:
    """One row (items, votes, observed, expected, alpha): nominal Krippendorff's alpha over items with two votes or more."""
    per = votes(judgments, grades).groupBy(*ITEM).agg(F.count(F.lit(1)).alias("m"), *[F.sum((F.col("grade") == g).cast("long")).alias(f"n{g}") for g in range(grades)]).filter(F.col("m") > 1)
    agree = sum((F.col(f"n{g}") * (F.col(f"n{g}") - 1) for g in range(grades)), F.lit(0)) / (F.col("m") - 1)
    total = per.agg(F.count(F.lit(1)).alias("items"), F.sum("m").alias("votes"), F.sum(F.round(agree, 9)).alias("agree"), *[F.sum(f"n{g}").alias(f"n{g}") for g in range(grades)])
    observed = 1 - F.try_divide(F.col("agree"), F.col("votes"))
    chance = sum((F.col(f"n{g}") * (F.col(f"n{g}") - 1) for g in range(grades)), F.lit(0))
    expected = 1 - F.try_divide(chance, F.col("votes") * (F.col("votes") - 1))
    return total.select("items", "votes", F.round(observed, 6).alias("observed"), F.round(expected, 6).alias("expected"), F.round(1 - F.try_divide(observed, expected), 6).alias("alpha"))
