"""Drift monitoring: open-ended histograms, population stability, percentiles, log summaries, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_of(value: Column, low: float, step: float, bins: int) -> Column:
    """Bin number 0..bins-1; the end bins are open."""
    return F.least(F.greatest(F.floor((value - low) / step), F.lit(0)), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, value: str, low: float, step: float, bins: int, group: str | None = None) -> DataFrame:
    """(group, bin, n, share) with a row for every bin, also empty ones; NULL values are left out."""
    g = F.col(group) if group else F.lit("all")
    counted = df.filter(F.col(value).isNotNull()).groupBy(g.alias("grp"), bin_of(F.col(value), low, step, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    full = counted.select("grp").distinct().select("grp", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    total = counted.groupBy("grp").agg(F.sum("n").alias("t"))
    return full.join(counted, ["grp", "bin"], "left").join(total, "grp").select("grp", "bin", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("n", F.lit(0)) / F.greatest("t", F.lit(1)), 6).alias("share"))


def psi(expected: DataFrame, actual: DataFrame, floor: float = 1e-4) -> DataFrame:
    """One row (psi) of two (bin, share) histograms: sum of (a - e) ln(a / e), shares at least ``floor``."""
    j = expected.select("bin", F.col("share").alias("e")).join(actual.select("bin", F.col("share").alias("a")), "bin", "full")
    e, a = F.greatest(F.coalesce("e", F.lit(0.0)), F.lit(floor)), F.greatest(F.coalesce("a", F.lit(0.0)), F.lit(floor))
    return j.agg(F.round(F.sum((a - e) * F.ln(a / e)), 6).alias("psi"))


def percentiles(df: DataFrame, group: str, value: str, qs: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(group, n, linear_q, nearest_q, floor_q for each q in percent): three definitions of a percentile; NULL values are left out.

    linear: between the values at (n - 1) q; nearest: the ceil(q n)-th value; floor: the value at place min(n - 1, int(n q)), from 0.
    One distributed sort numbers all values; only the few places that are asked for are looked up, so that no group
    has to fit a task.
    """
    from audiolake.operators.datasets import numbered

    rows = numbered(df.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v")), [F.col("g"), F.col("v")], "at")
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    n = F.col("n")
    asked = []
    for q in qs:
        low = F.floor((n - 1) * F.lit(q))
        asked += [(f"l{q}", low), (f"h{q}", F.least(low + 1, n - 1)), (f"near{q}", F.greatest(F.ceil(n * F.lit(q)) - 1, F.lit(0))), (f"floor{q}", F.least(n - 1, F.floor(n * F.lit(q))))]
    places = sizes.select("g", "n", "first", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), at.cast("long").alias("i")) for name, at in asked])).alias("p"))
    found = places.select("g", "n", "p.name", (F.col("first") + F.col("p.i")).alias("at")).join(rows.select("at", "v"), "at")
    wide = found.groupBy("g", "n").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name, _ in asked])
    part = lambda q: (n - 1) * F.lit(q) - F.floor((n - 1) * F.lit(q))
    out = []
    for q in qs:
        low, high = F.col(f"`l{q}`"), F.col(f"`h{q}`")
        out += [F.round(low + (high - low) * part(q), 6).alias(f"linear_{round(100 * q)}"), F.col(f"`near{q}`").alias(f"nearest_{round(100 * q)}"), F.col(f"`floor{q}`").alias(f"floor_{round(100 * q)}")]
    return wide.select(F.col("g").alias(group), "n", *out)


def feature_means(df: DataFrame, names: list[str]) -> DataFrame:
    """(feature, n, nan, mean): one pass over all named columns."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in names])).alias("s")).select("s.*")
    good = F.when(~F.isnan("x"), F.col("x"))
    return cells.groupBy("feature").agg(F.count(good).alias("n"), F.count_if(F.isnan("x")).alias("nan"), F.round(F.avg(good), 6).alias("mean"))


def search_summary(log: DataFrame) -> DataFrame:
    """(measure, name, value) of a serving log: ordering, bundle, mode, legs map<leg, status>, timings map<stage, ms>, results array<struct<score, sources>>.

    Rates over all searches, statuses per leg, stages' medians and 95th percentiles, mean top score, shares of result
    sources, and counts by bundle and mode.
    """
    n = log.count()
    rate = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    top = F.try_element_at("results", F.lit(1))["score"]
    one = log.agg(F.count(F.lit(1)).cast("double").alias("searches"), rate(F.coalesce(F.size("results"), F.lit(0)) <= 0).alias("zero_result_rate"), rate(~F.col("ordering").eqNullSafe("ranker")).alias("rrf_rate"), F.round(F.avg(top), 6).alias("top_score_mean"))
    names = ("searches", "zero_result_rate", "rrf_rate", "top_score_mean")
    totals = one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("name"), F.col(x).alias("value")) for x in names])).alias("s")).select(F.lit("total").alias("measure"), "s.name", "s.value")
    share = lambda rows, measure, of: rows.groupBy("name").agg(F.round(F.count(F.lit(1)) / F.lit(float(max(of, 1))), 6).alias("value")).select(F.lit(measure).alias("measure"), "name", "value")
    legs = log.select(F.explode(F.map_entries("legs")).alias("l")).select(F.concat_ws(":", "l.key", F.coalesce("l.value", F.lit("unknown"))).alias("name"))
    sources = log.select(F.explode("results").alias("r")).select(F.explode("r.sources").alias("name"))
    stages = percentiles(log.select(F.explode(F.map_entries("timings")).alias("t")).select(F.col("t.key").alias("stage"), F.col("t.value").alias("ms")), "stage", "ms")
    stages = stages.select(F.explode(F.array(F.struct(F.concat("stage", F.lit(":p50")).alias("name"), F.col("linear_50").alias("value")), F.struct(F.concat("stage", F.lit(":p95")).alias("name"), F.col("linear_95").alias("value")), F.struct(F.concat("stage", F.lit(":n")).alias("name"), F.col("n").cast("double").alias("value")))).alias("s")).select(F.lit("stage").alias("measure"), "s.name", "s.value")
    counts = lambda c: log.groupBy(F.coalesce(F.col(c), F.lit("unknown")).alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(c).alias("measure"), "name", "value")
    parts = [share(legs, "leg", n), share(sources, "source", sources.count()), stages, counts("bundle"), counts("mode")]
    for p in parts:
        totals = totals.unionByName(p)
    return totals


def drift(baseline: DataFrame, current: DataFrame, rules: list[tuple[str, str, str, float, float, str]]) -> DataFrame:
    """(measure, name, kind, baseline, current, limit, severity): findings of two summaries (measure, name, value) under a table of rules.

    A rule is (measure, name or '*', kind, limit, floor, severity): ``above`` compares the value with the limit, ``delta``
    the rise over the baseline, ``ratio`` the quotient (only above the floor), ``shift`` the change over the larger
    of the baseline's size and the floor, ``new`` reports names that the baseline lacks.
    """
    table = current.sparkSession.createDataFrame(rules, "measure string, rule string, kind string, amount double, floor double, severity string")
    both = current.withColumnRenamed("value", "current").join(baseline.withColumnRenamed("value", "baseline"), ["measure", "name"], "left")
    rows = both.join(F.broadcast(table), "measure").filter((F.col("rule") == "*") | (F.col("rule") == F.col("name")))  # the rules are a driver list
    base, now, amount, floor = (F.col(c) for c in ("baseline", "current", "amount", "floor"))
    limit = F.when(F.col("kind") == "above", amount).when(F.col("kind") == "delta", F.coalesce(base, F.lit(0.0)) + amount).when(F.col("kind") == "ratio", base * amount)
    shift = F.abs(now - base) / F.greatest(F.abs(base), floor)
    hit = F.when(F.col("kind").isin("above", "delta"), now > limit).when(F.col("kind") == "ratio", (now > floor) & (now > limit)).when(F.col("kind") == "shift", shift > amount).otherwise(base.isNull())
    return rows.filter(F.coalesce(hit, F.lit(False))).select("measure", "name", "kind", "baseline", "current", F.round(F.coalesce(limit, amount), 6).alias("limit"), "severity")


def signed_means(log: DataFrame) -> DataFrame:
    """(feature, n, positive, negative, nan, mean) of (feature, value): sums kept apart by sign, as counters only grow; values that are not finite count as nan."""
    v = F.col("value")
    fine = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = log.groupBy("feature").agg(F.count_if(fine).alias("n"), F.round(F.sum(F.when(fine & (v > 0), v).otherwise(0.0)), 4).alias("positive"), F.round(F.sum(F.when(fine & (v < 0), -v).otherwise(0.0)), 4).alias("negative"), F.count_if(v.isNotNull() & ~fine).alias("nan"))
    return rows.filter("n > 0").withColumn("mean", F.round((F.col("positive") - F.col("negative")) / F.col("n"), 6))


def load_report(samples: DataFrame) -> DataFrame:
    """One row (requests, ok, availability, sent, stored, persistence) of samples (kind, status, stored)."""
    search, event = F.col("kind") == "search", F.col("kind") == "event"
    ok = F.coalesce(F.col("status") == 200, F.lit(False))
    row = samples.agg(F.count_if(search).alias("requests"), F.count_if(search & ok).alias("ok"), F.count_if(event & ok).alias("sent"), F.count_if(event & ok & F.col("stored")).alias("stored"))
    return row.select("requests", "ok", F.round(F.col("ok") / F.greatest("requests", F.lit(1)), 6).alias("availability"), "sent", "stored", F.round(F.try_divide("stored", "sent"), 6).alias("persistence"))


def audit_shares(graded: DataFrame, relevant: int = 2) -> DataFrame:
    """(grouping, value, pairs, relevant_share) of graded pairs (rank, sources array, grade): over all, by rank class, by source combination, by grade."""
    rank = F.when(F.col("rank") <= 5, "1-5").when(F.col("rank") <= 10, "6-10").when(F.col("rank") <= 20, "11-20").otherwise("21+")
    kind = lambda name, value: F.struct(F.lit(name).alias("grouping"), value.alias("value"))
    kinds = F.array(kind("all", F.lit("")), kind("rank", rank), kind("source", F.array_join(F.array_sort(F.array_distinct("sources")), "+")), kind("grade", F.col("grade").cast("string")))
    rows = graded.select("grade", F.explode(kinds).alias("k"))
    return rows.groupBy("k.grouping", "k.value").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg((F.col("grade") >= relevant).cast("double")), 3).alias("relevant_share"))


def leg_status(log: DataFrame) -> DataFrame:
    """(leg, status, n, share): how often each retrieval leg ended in each status, as a share of all searches."""
    rows = log.select(F.explode(F.map_entries("legs")).alias("l"))
    n = log.agg(F.count(F.lit(1)).alias("t"))
    return rows.groupBy(F.col("l.key").alias("leg"), F.col("l.value.status").alias("status")).agg(F.count(F.lit(1)).alias("n")).crossJoin(n).select("leg", "status", "n", (F.col("n") / F.col("t")).alias("share"))


def findings(baseline: DataFrame, current: DataFrame, limits: dict[str, tuple[float, str]]) -> DataFrame:
    """(name, baseline, current, change, severity): named values whose absolute change passes their limit."""
    rules = [F.lit(x) for n, (limit, _) in limits.items() for x in (n, limit)]
    level = [F.lit(x) for n, (_, s) in limits.items() for x in (n, s)]
    j = baseline.select("name", F.col("value").alias("baseline")).join(current.select("name", F.col("value").alias("current")), "name")
    j = j.withColumn("change", F.round(F.col("current") - F.col("baseline"), 6))
    return j.filter(F.abs("change") > F.try_element_at(F.create_map(*rules), F.col("name"))).withColumn("severity", F.try_element_at(F.create_map(*level), F.col("name")))
