"""Vector operators: text forms, norms, pooling, a hashing encoder, filtered legs per model, similarities, diversity.

The encoder maps words to signed places of a vector by digest, so that texts with common words are near without a
learned model; an encoder that is learned plugs in as any function with the same result columns.

Defined results: NULL, short, long, non-finite and all-zero vectors are left out; an episode with several vectors of a model
takes one of them; texts without words have no vector; a missing vector has similarity 0; ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from audiolake.functions import text
from audiolake.functions.numbers import dot, norm, usable_vector
from audiolake.operators.retrieval import vector_top
from audiolake.session import store

DIM = 64


def to_text(v: Column) -> Column:
    """``[a,b,…]``, the text form of a vector."""
    return F.when(v.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]")))


def from_text(s: Column) -> Column:
    """The vector of a text form; NULL for anything else."""
    inside = F.transform(F.split(F.regexp_extract(s, r"^\s*\[(.*)\]\s*$", 1), ","), lambda x: F.trim(x).try_cast("double"))
    return F.when(F.forall(inside, lambda x: x.isNotNull()), inside)


def unit(v: Column) -> Column:
    """The vector over its length; NULL for a vector without length."""
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), norm(v)))


def is_unit(v: Column, tolerance: float = 1e-3) -> Column:
    return F.coalesce(F.abs(norm(v) - 1) <= tolerance, F.lit(False))


def mean_pool(rows: Column, mask: Column) -> Column:
    """Mean of the token vectors that the mask (0 or 1 each) keeps; the divisor is at least 1e-9."""
    total = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1e-9))
    summed = F.aggregate(
        F.zip_with(rows, mask, lambda r, m: F.transform(r, lambda x: x.cast("double") * m)),
        F.transform(F.element_at(rows, 1), lambda x: F.lit(0.0)),
        lambda acc, r: F.zip_with(acc, r, lambda a, b: a + b),
    )
    return F.transform(summed, lambda x: x / total)


def encode(words: Column, model: str, dim: int = DIM) -> Column:
    """Unit vector of signed word counts by digest; NULL without words."""
    digest = lambda w: F.sha2(F.concat(F.lit(f"{model}:"), w), 256)
    number = lambda h, at, n: F.conv(F.substring(h, at, n), 16, 10).cast("int")
    placed = F.transform(words, lambda w: F.struct((F.conv(F.substring(digest(w), 1, 6), 16, 10).cast("int") % dim).alias("i"), F.when(number(digest(w), 9, 1) < 8, 1.0).otherwise(-1.0).alias("x")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(placed, F.lit(0.0), lambda s, p: s + F.when(p["i"] == i, p["x"]).otherwise(0.0)))
    return F.when(F.exists(raw, lambda x: x != 0), raw)


def encoded_queries(queries: DataFrame, models: list[str], dim: int = DIM) -> DataFrame:
    """(query_id, model, embedding) of every query with words under every model."""
    vectors = F.array(*[F.struct(F.lit(m).alias("model"), encode(text.words(F.col("query_text")), m, dim).alias("embedding")) for m in models])
    return queries.dropDuplicates(["query_id"]).select("query_id", F.explode(vectors).alias("v")).select("query_id", "v.model", "v.embedding").filter(F.col("embedding").isNotNull())


def of_model(embeddings: DataFrame, model: str, dim: int = DIM) -> DataFrame:
    """(episode_id, embedding) of the model, or of the models with the prefix if the name ends with a colon."""
    own = F.startswith("model", F.lit(model)) if model.endswith(":") else F.col("model") == model
    return embeddings.filter(own & usable_vector(F.col("embedding"), dim)).groupBy("episode_id").agg(F.min("embedding").alias("embedding"))


def filtered_queries(queries: DataFrame, models: list[str], dim: int = DIM) -> DataFrame:
    """(query_id, model, embedding, filter_language, filter_max_seconds), stored: what ``leg`` asks under every model.

    A leg reads its queries several times, and each would hold the encoder in its plan.
    """
    filters = queries.dropDuplicates(["query_id"]).select("query_id", "filter_language", "filter_max_seconds")
    return store(encoded_queries(queries, models, dim).join(filters, "query_id"), "encoded")


def leg(embeddings: DataFrame, episodes: DataFrame, queries: DataFrame, model: str, k: int, dim: int = DIM, asked: DataFrame | None = None) -> DataFrame:
    """(query_id, episode_id, similarity, rank): exact top ``k`` of a model among the episodes that pass the query's filters.

    ``asked``: the ``filtered_queries`` of several models, which their legs share.
    """
    corpus = of_model(embeddings, model, dim).join(episodes.select(F.col("id").alias("episode_id"), "language", "duration_seconds"), "episode_id")
    asked = filtered_queries(queries, [model], dim) if asked is None else asked
    near = vector_top(corpus.withColumnRenamed("episode_id", "id"), asked.filter(F.col("model") == model), k, dim, filtered=True)
    return near.select("query_id", F.col("id").alias("episode_id"), F.round("similarity", 9).alias("similarity"), "rank")


def similarities(pairs: DataFrame, embeddings: DataFrame, queries: DataFrame, models: dict[str, str], encoders: dict[str, str], dim: int = DIM) -> DataFrame:
    """``pairs`` (query_id, episode_id, …) with a cosine per model, 0 for a missing vector. ``models``: column -> model; ``encoders``: model -> encoder of its queries."""
    out = pairs
    for column, model in models.items():
        asked = encoded_queries(queries, [encoders.get(model, model)], dim).select("query_id", F.col("embedding").alias("_q"))
        own = of_model(embeddings, model, dim).select("episode_id", F.col("embedding").alias("_v"))
        cosine = dot(F.col("_v"), F.col("_q")) / (norm(F.col("_v")) * norm(F.col("_q")))
        out = out.join(own, "episode_id", "left").join(asked, "query_id", "left").withColumn(column, F.coalesce(F.round(cosine, 9), F.lit(0.0))).drop("_v", "_q")
    return out


def list_diversity(lists: DataFrame, key: str, vectors: DataFrame) -> DataFrame:
    """(key, vectors, diversity): 1 less the mean cosine of a list's pairs; NULL below two vectors.

    The sum over pairs is (|sum of unit vectors|**2 - n) / 2, so no pair is formed. ``lists``: key, episode_id.
    """
    rows = lists.select(key, "episode_id").distinct().join(vectors, "episode_id").select(key, F.posexplode(unit(F.col("embedding"))).alias("i", "x"))
    sums = rows.groupBy(key, "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    total = sums.groupBy(key).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    return total.select(key, F.col("n").alias("vectors"), F.when(F.col("n") > 1, F.round(1 - (F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6)).alias("diversity"))
