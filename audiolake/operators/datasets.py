"""Training datasets: deterministic generators, seeded negatives, contracts, time split, versions.

Every choice is an order by digest of (seed, kind, key), so a build is the same on every cluster and does not
need a random generator's state. Negatives are places of a ring of all candidates, which an example's own digest
gives, so no pair of example and catalogue is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from audiolake.functions.hashing import order_key
from audiolake.functions.text import normalize


def eligible(episodes: DataFrame, language: str = "en", least_text: int = 0) -> DataFrame:
    """Episodes with date, title, matching language and enough description."""
    return episodes.filter(F.col("published_at").isNotNull() & (F.trim("title") != "") & F.startswith(F.lower("language"), F.lit(language)) & (F.length(F.coalesce("description", F.lit(""))) >= least_text))


def split_by_time(df: DataFrame, at: str, validation: str, test: str) -> DataFrame:
    """Add ``split``: train before ``validation``, test from ``test`` on, validation between; NULL times have none."""
    t = F.col(at)
    return df.withColumn("split", F.when(t < F.lit(validation).cast("timestamp"), "train").when(t < F.lit(test).cast("timestamp"), "validation").when(t.isNotNull(), "test"))


def first_by_digest(df: DataFrame, group: list[str], key: str, k: int, seed: int, kind: str) -> DataFrame:
    """First ``k`` rows of each group in digest order."""
    w = Window.partitionBy(*group).orderBy(order_key(seed, kind, F.col(key)), key)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def negatives(examples: DataFrame, candidates: DataFrame, n: int, seed: int) -> DataFrame:
    """(example_id, negative_id, place): ``n`` seeded negatives of each example from the whole catalogue, without repeats.

    examples: example_id, positive_id. candidates: id. The candidates stand in a ring in the order of their digest,
    numbered without gaps; an example's draws are places of the ring given by its own digest, one more than ``n``
    in strides that never meet, so that one of them may be the positive. Every candidate is as likely, an example's draws do
    not depend on other examples, and only numbered places are joined, never pairs of example and catalogue. With ``n``
    candidates or fewer an example gets all but its positive.
    """
    ring = numbered(candidates.select("id").distinct(), [order_key(seed, "ring", F.col("id")), F.col("id")], "at")
    size = ring.count()
    if not size:
        return examples.sparkSession.createDataFrame([], "example_id string, negative_id long, place int")
    draws = min(n + 1, size)
    number = lambda kind: F.conv(F.substring(order_key(seed, kind, F.col("example_id")), 1, F.lit(13)), 16, 10).cast("bigint")
    stride = F.lit(1) + number("stride") % F.lit(max(1, (size - 1) // max(1, draws - 1)))  # draws * stride stays within one turn
    places = examples.select("example_id", "positive_id", number("neg").alias("s"), stride.alias("t")).select("example_id", "positive_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda k: (F.col("s") + k * F.col("t")) % size)).alias("k", "at"))
    met = places.join(ring.withColumnRenamed("id", "negative_id"), "at").filter(F.col("negative_id") != F.col("positive_id"))
    order = Window.partitionBy("example_id").orderBy("k")
    return met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).select("example_id", "negative_id", "place")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, … in the order, by a distributed sort and the sizes of its partitions (one number each to the driver)."""
    from audiolake.session import store

    rows = store(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "ring")
    part, inside = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    sizes = {r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per partition
    total, before = 0, []
    for p in sorted(sizes):
        before += [F.lit(p).cast("long"), F.lit(total).cast("long")]
        total += sizes[p]
    if not before:
        return rows.withColumn(name, F.col("_m")).drop("_m")
    return rows.withColumn(name, F.element_at(F.create_map(*before), part) + inside).drop("_m")


def synthetic_queries(episodes: DataFrame, most: int, seed: int, language: str = "en") -> DataFrame:
    """(example_id, query_text, positive_id, show, event_time): titles as queries, the first ``most`` in digest order."""
    rows = eligible(episodes, language).withColumn("query_text", normalize(F.col("title"))).filter(F.length("query_text") >= 3)
    rows = rows.withColumn("k", order_key(seed, "synthetic_query", F.col("id"))).orderBy("k", "id").limit(most)
    return rows.select(F.concat(F.lit("synthetic_query-"), F.col("id").cast("string")).alias("example_id"), "query_text", F.col("id").alias("positive_id"), F.col("podcast_id").alias("show"), F.col("published_at").alias("event_time"))


def topic_examples(episodes: DataFrame, podcasts: DataFrame, per_category: int, least: int, seed: int, language: str = "en") -> DataFrame:
    """(category, positive_id): at most ``per_category`` episodes of each category that has ``least`` or more."""
    tagged = podcasts.select(F.col("id").alias("podcast_id"), F.explode(F.array_distinct("categories")).alias("category"))
    rows = eligible(episodes, language).select("id", "podcast_id").join(tagged, "podcast_id")
    big = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("category")
    return first_by_digest(rows.join(big, "category", "left_semi"), ["category"], "id", per_category, seed, "topic").select("category", F.col("id").alias("positive_id"))


def name_queries(episodes: DataFrame, podcasts: DataFrame, per_show: int, seed: int) -> DataFrame:
    """(show, kind, query_text, episode_id): each show's picks for its title, then others for its publisher; no episode twice."""
    names = podcasts.select(F.col("id").alias("show"), normalize(F.col("title")).alias("t"), normalize(F.col("publisher")).alias("p"))
    rows = episodes.select("id", F.col("podcast_id").alias("show"))
    w = Window.partitionBy("show").orderBy(order_key(seed, "name", F.col("id")), "id")
    ranked = rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= 2 * per_show).join(names, "show")
    kind = F.when(F.col("n") <= per_show, "show").otherwise("publisher")
    return ranked.select("show", kind.alias("kind"), F.when(F.col("n") <= per_show, F.col("t")).otherwise(F.col("p")).alias("query_text"), F.col("id").alias("episode_id")).filter(F.length("query_text") >= 3)


def folds(queries: DataFrame, kind: str, key: str, k: int, seed: int) -> DataFrame:
    """(key, fold): stratified round robin in digest order; a type starts where the one before it by name ended."""
    sizes = queries.groupBy(kind).agg(F.count(F.lit(1)).alias("size"))
    offset = sizes.withColumn("offset", F.coalesce(F.sum("size").over(Window.orderBy(kind).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per type
    place = F.row_number().over(Window.partitionBy(kind).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key)), 256), key)) - 1
    return queries.select(kind, key, place.alias("place")).join(offset, kind).select(key, ((F.col("place") + F.col("offset")) % k).cast("int").alias("fold"))


def weighted_order(df: DataFrame, key: str, weight: Column, seed: int, kind: str) -> DataFrame:
    """Add ``draw``: sorting by it samples without replacement in proportion to the weight (exponential keys)."""
    u = (F.conv(F.substring(order_key(seed, kind, F.col(key)), 1, F.lit(12)), 16, 10).cast("double") + 1) / float(16**12 + 1)
    return df.withColumn("draw", F.round(-F.ln(u) / weight, 12))


def mined(examples: DataFrame, runs: DataFrame, shows: DataFrame) -> DataFrame:
    """(example_id, episode_id, best_rank, sources): what systems found for an example's query, without its positive and the positive's show.

    examples: example_id, positive_id, show. runs: system, query_id (the example), episode_id, rank. shows: id, podcast_id.
    """
    rows = runs.withColumnRenamed("query_id", "example_id").join(examples.select("example_id", "positive_id", "show"), "example_id").join(shows.select(F.col("id").alias("episode_id"), F.col("podcast_id").alias("other")), "episode_id")
    rows = rows.filter((F.col("episode_id") != F.col("positive_id")) & (F.col("other") != F.col("show")))
    listed = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "system", F.col("rank").cast("string")))), ",")  # one entry per system
    return rows.groupBy("example_id", "episode_id").agg(F.min("rank").alias("best_rank"), listed.alias("sources"))


def weighted_draws(keys: DataFrame, key: str, items: DataFrame, n: int, seed: int, kind: str, buckets: int = 4096) -> DataFrame:
    """(key, k, id): ``n`` draws for each key, an item in proportion to its weight (id, weight), with repeats.

    Draws and the items' stretches of the cumulated weight meet by bucket of the unit interval, so an item of a third of
    the weight is many rows and no task holds all items.
    """
    rows = cumulated(items.filter("weight > 0"))
    total = rows.agg(F.max("upto")).first()[0]
    if not total:
        return keys.select(key, F.lit(0).alias("k"), F.lit(None).cast("long").alias("id")).limit(0)
    cell = lambda x: F.least(F.floor(x * buckets), F.lit(buckets - 1)).cast("int")
    rows = rows.select("id", (F.col("before") / total).alias("low"), (F.col("upto") / total).alias("high"))
    rows = rows.select("*", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    u = F.conv(F.substring(order_key(seed, kind, F.concat_ws(":", F.col(key).cast("string"), F.col("k").cast("string"))), 1, F.lit(12)), 16, 10).cast("double") / float(16**12)
    draws = keys.select(key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).withColumn("u", u).withColumn("cell", cell(F.col("u")))
    return draws.join(rows, "cell").filter((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select(key, "k", "id")


def cumulated(items: DataFrame) -> DataFrame:
    """(id, before, upto): running sums of integer weights in the order of ids, by a distributed sort and its partitions' sums."""
    from audiolake.session import store

    rows = store(items.select("id", F.col("weight").cast("long").alias("weight")).repartitionByRange("id").withColumn("_p", F.spark_partition_id()), "weights")
    sums = {r["_p"]: r["s"] for r in rows.groupBy("_p").agg(F.sum("weight").alias("s")).collect()}  # a row per partition
    total, start = 0, []
    for p in sorted(sums):
        start += [F.lit(p), F.lit(total).cast("long")]
        total += sums[p]
    own = F.sum("weight").over(Window.partitionBy("_p").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    if not start:
        return rows.select("id", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("upto")).limit(0)
    rows = rows.withColumn("upto", own + F.element_at(F.create_map(*start), F.col("_p")))
    return rows.select("id", (F.col("upto") - F.col("weight")).alias("before"), "upto")


def mixed_negatives(examples: DataFrame, hard: DataFrame, popular: DataFrame, uniform: DataFrame, n: int, most_hard: int, most_popular: int) -> DataFrame:
    """(example_id, negative_id, source, place): up to ``n`` of each example, hard ones first, then popular, then uniform ones to fill.

    Each source has (example_id, negative_id, place) and gives its first by place; a negative counts once, under its first source.
    """
    part = lambda df, order, name, most: df.filter(F.col("place") <= most).select("example_id", "negative_id", F.lit(order).alias("o"), F.lit(name).alias("source"), F.col("place").alias("p"))
    rows = part(hard, 0, "hard", most_hard).unionByName(part(popular, 1, "popular", most_popular)).unionByName(part(uniform, 2, "uniform", 1 << 30))
    rows = rows.join(examples.select("example_id", "positive_id"), "example_id").filter(F.col("negative_id") != F.col("positive_id"))
    rows = rows.groupBy("example_id", "negative_id").agg(F.min(F.struct("o", "p", "source")).alias("b"))
    order = Window.partitionBy("example_id").orderBy("b.o", "b.p", "negative_id")
    return rows.select("example_id", "negative_id", F.col("b.source").alias("source"), F.row_number().over(order).alias("place")).filter(F.col("place") <= n)


def distribution(examples: DataFrame, classes: dict[str, str]) -> DataFrame:
    """(measure, name, value) of examples (positive_id, query_text, negatives int, label_source, event_time): counts, shares and bounds.

    ``classes``: label source -> class; a class without rows has share 0.
    """
    q = F.coalesce("query_text", F.lit(""))
    one = examples.agg(
        F.count(F.lit(1)).cast("double").alias("examples"), F.count_distinct("positive_id").cast("double").alias("distinct_positives"), F.count_distinct(F.nullif(q, F.lit(""))).cast("double").alias("distinct_queries"), F.coalesce(F.round(F.avg((q == "").cast("double")), 6), F.lit(0.0)).alias("empty_query_share"),
        F.coalesce(F.min("negatives"), F.lit(0)).cast("double").alias("negatives_min"), F.coalesce(F.round(F.avg("negatives"), 2), F.lit(0.0)).alias("negatives_mean"), F.coalesce(F.max("negatives"), F.lit(0)).cast("double").alias("negatives_max"),
        *[F.coalesce(F.round(F.avg(F.col("label_source").isin([s for s, k in classes.items() if k == c]).cast("double")), 4), F.lit(0.0)).alias(f"{c}_share") for c in sorted(set(classes.values()))],
    )
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in one.columns])).alias("s")).select(F.lit("total").alias("measure"), "s.name", "s.value")
    counts = examples.groupBy(F.col("label_source").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("source").alias("measure"), "name", "value")
    return rows.unionByName(counts)


def distribution_failures(report: DataFrame, least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """(name, value, bound, kind) of the totals of a report that break a bound."""
    rules = [(n, v, "min") for n, v in least.items()] + [(n, v, "max") for n, v in most.items()]
    table = report.sparkSession.createDataFrame(rules, "name string, bound double, kind string")
    rows = report.filter("measure = 'total'").join(table, "name")
    return rows.filter(((F.col("kind") == "min") & (F.col("value") < F.col("bound"))) | ((F.col("kind") == "max") & (F.col("value") > F.col("bound")))).select("name", "value", "bound", "kind")


def example_rules(known_sources: list[str], now: Column) -> dict[str, Column]:
    """Named conditions of a training example, for :func:`contract`."""
    listed = lambda c: F.forall(c, lambda x: x.isNotNull() & (x > 0))
    return {
        "example_id": F.length("example_id") >= 1, "positive": F.col("positive_id") > 0, "strength": F.col("label_strength").between(0.0, 1.0) & ~F.isnan("label_strength"), "source": F.col("label_source").isin(known_sources),
        "version": F.col("dataset_version").rlike(r"^[0-9][0-9A-Za-z.\-]*$"), "negatives_listed": listed("negative_ids"), "history_listed": listed("history"), "positive_not_negative": ~F.array_contains("negative_ids", F.col("positive_id")),
        "positive_not_in_history": ~F.array_contains("history", F.col("positive_id")), "not_in_future": F.col("event_time") <= now,
    }


def strict_columns(df: DataFrame, schema: dict[str, str]) -> list[str]:
    """Differences of a table's columns from a strict schema: missing, extra and of another type."""
    have = dict(df.dtypes)
    return [f"missing {c}" for c in sorted(schema.keys() - have.keys())] + [f"extra {c}" for c in sorted(have.keys() - schema.keys())] + [f"{c} is {have[c]}, not {t}" for c, t in sorted(schema.items()) if c in have and have[c] != t]


def canonical_digest(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row (rows, digest): digest of the digests of the partitions of the canonical form, rows as compact JSON with sorted names in the order of the key.

    The form is cut into pieces of 1,000 rows by place, so that no task or row holds all of it and the result does not depend on partitions.
    """
    line = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    rows = numbered(df.select(F.col(key).alias("_k"), line.alias("line")), [F.col("_k"), F.col("line")], "at")
    piece = rows.groupBy(F.floor(F.col("at") / 1000).alias("piece")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda s: s["line"]), "\n"), 256).alias("d"), F.count(F.lit(1)).alias("n"))  # 1,000 rows
    top = piece.groupBy(F.floor(F.col("piece") / 1000).alias("part")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "d"))), lambda s: s["d"]), "\n"), 256).alias("d"), F.sum("n").alias("n"))
    return top.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "d"))), lambda s: s["d"]), "\n"), 256).alias("digest"))  # a millionth of the rows


def relevance_queries(episodes: DataFrame, podcasts: DataFrame, most_shows: int, most_people: int, language: str = "en") -> DataFrame:
    """(query_id, query_text, query_type): names of the largest shows of a language, and of publishers that look like persons, each name once."""
    from audiolake.functions.hashing import query_id
    from audiolake.operators.contract import looks_like_person

    sizes = episodes.groupBy(F.col("podcast_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    shows = podcasts.filter(F.startswith(F.lower(F.coalesce("language", F.lit(""))), F.lit(language))).join(sizes, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))

    def first(rows: DataFrame, name: Column, kind: str, most: int) -> DataFrame:
        named = rows.select(normalize(name).alias("query_text"), "n", "id").filter(F.length("query_text") >= 3)
        best = named.groupBy("query_text").agg(F.max(F.struct("n", -F.col("id"))).alias("b"))
        return best.orderBy(F.desc("b"), "query_text").limit(most).select("query_text", F.lit(kind).alias("query_type"))

    titles = first(shows, F.col("title"), "navigational", most_shows)
    people = first(shows.filter(looks_like_person(F.col("publisher"))), F.col("publisher"), "entity", most_people + most_shows)
    people = people.join(titles.select("query_text"), "query_text", "left_anti").select("query_text", "query_type")
    rows = titles.unionByName(people)
    return rows.select(query_id(F.col("query_type"), F.col("query_text")).alias("query_id"), "query_text", "query_type")


def contract(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations, examples): counts of rows that break each named rule and up to 20 of their smallest keys.

    NULL counts as broken. The key's uniqueness is one more rule. One pass with map-side counts for the rules.
    """
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    rows = df.select(key, F.explode(F.array_compact(F.array(*broken))).alias("rule"))
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key, F.lit("unique").alias("rule"))
    bad = rows.unionByName(repeated)
    counted = bad.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))
    few = bad.withColumn("n", F.row_number().over(Window.partitionBy("rule").orderBy(key))).filter("n <= 20").groupBy("rule").agg(F.array_join(F.sort_array(F.collect_list(F.col(key).cast("string"))), ",").alias("examples"))
    every = df.sparkSession.createDataFrame([(n,) for n in [*rules, "unique"]], "rule string")
    return every.join(counted, "rule", "left").join(few, "rule", "left").select("rule", F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce("examples", F.lit("")).alias("examples"))


def table_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (rows, digest): order-free hash, the digest of the sums of 48-bit parts of every row's digest."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), 256)
    part = lambda i: F.sum(F.conv(F.substring("d", 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")).cast("string")
    return df.select(row.alias("d")).agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws(":", *[part(i) for i in range(4)]), 256).alias("digest"))
