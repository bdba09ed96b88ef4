"""Most similar vectors for every vector: multiprobe p-stable hashing with exact reranking.

Each unit vector gets, in each of ``tables`` hash tables, a key of ``functions`` integers
``floor((a.x + b) / w)`` with Gaussian ``a`` (p-stable for Euclidean distance, which on unit vectors orders
as the cosine does). A vector is stored once per table and looks into its own bucket and into the ``probes``
buckets with the best estimated success: those that a perturbation of this vector's key reaches over the least sum of
squared distances to the boundaries it crosses. Candidates of all tables are merged and ranked by exact cosine.

Equal vectors are one class, which is hashed once, so a vector that a third of all rows share is no hot bucket; of its members only the first ``k + 1`` episodes can appear in a top
k ordered by (similarity, id). A bucket with more than ``bucket_limit`` vectors is dealt to blocks of about that
many, and what looks into it is copied to each block, so that all pairs of a bucket are compared.

The expected recall at a cosine follows from the parameters alone: ``expected_recall`` measures it on random pairs of that
cosine, not on the data. The defaults of ``nearest`` reach 0.93 at the bound of 0.9 and more above. Of unrelated
vectors a share of 0.486 ** functions meets in a bucket of the default width, so ``functions`` (and with it
``tables``) should grow with the logarithm of the collection where it has far more than 100 million vectors.

Defined results: NULL, short, long, non-finite and all-zero vectors and rows with NULL keys are left out;
repeated rows count once; an episode with several vectors under one model takes its best similarity;
ties go to the smaller episode id; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from audiolake.plans.guards import above
from audiolake.session import store

DIM = 64
#: Signs of random projections by which candidates are sifted before their vectors are compared.
SIGNS = 128


def valid_vectors(df: DataFrame, dim: int = DIM) -> DataFrame:
    """(model, episode_id, embedding, class_id) of the rows whose vector has ``dim`` finite values, not all zero."""
    v = F.col("embedding")
    ok = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = df.select("model", "episode_id", "embedding").filter(F.col("model").isNotNull() & F.col("episode_id").isNotNull() & v.isNotNull() & ok)
    return kept.withColumn("class_id", F.xxhash64("model", "embedding"))


def cosine(a: Column, b: Column) -> Column:
    """Exact cosine of two float arrays, in doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _unit(table: pa.RecordBatch) -> np.ndarray:
    flat = table.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(table.num_rows, -1)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _planes(dim: int, tables: int, functions: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.standard_normal((dim, tables * functions)).astype(np.float32), rng.random(tables * functions).astype(np.float32)


def _perturbations(functions: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of boundary ranks among which the ``probes`` cheapest of any vector are, single ones first.

    Ranks count a vector's boundaries by falling nearness. A set is beaten by all that replace one of its ranks by a smaller
    one or leave one out, so one that many others beat can be left out for every vector (twice ``probes``, since a few
    sets cross both boundaries of one function and do not count).
    """
    most = min(2 * functions, 2 * probes)
    sets = [(i,) for i in range(most)]
    size = 2
    while (1 << size) - 1 <= 2 * probes and size <= most:  # all subsets of a set beat it
        sets += [s for s in itertools.combinations(range(most), size) if sum(s) - sum(range(size)) < 2 * probes]
        size += 1
    return sets


def _probe_keys(base: np.ndarray, frac: np.ndarray, probes: int) -> list[np.ndarray]:
    """Keys of the ``probes`` perturbed buckets of every row, in the order of their estimated success."""
    n, m = base.shape
    if not probes:
        return []
    dist = np.concatenate([frac, 1 - frac], axis=1)  # to the lower, then to the upper boundary
    order = np.argsort(dist, axis=1)
    near = np.take_along_axis(dist, order, axis=1) ** 2
    sets = _perturbations(m, probes)
    cost = np.stack([near[:, list(s)].sum(axis=1) for s in sets], axis=1)
    for j, s in enumerate(sets):
        if len(s) > 1:  # both boundaries of one function cannot be crossed
            f = np.sort(order[:, list(s)] % m, axis=1)
            cost[(f[:, 1:] == f[:, :-1]).any(axis=1), j] = np.inf
    best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    out = []
    for q in range(best.shape[1]):
        key = base.copy()
        for j in np.unique(best[:, q]):
            at = np.flatnonzero(best[:, q] == j)
            for r in sets[j]:
                c = order[at, r]
                key[at, c % m] += np.where(c < m, -1, 1).astype(key.dtype)
        out.append(key)
    return out


def _fold(key: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hash of the rows of an integer matrix."""
    with np.errstate(over="ignore"):
        h = np.full(key.shape[0], np.uint64(0x9E3779B97F4A7C15 ^ (salt * 7919)), np.uint64)
        for j in range(key.shape[1]):
            h = (h ^ key[:, j].astype(np.int64).view(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def bucket_rows(x: np.ndarray, tables: int, functions: int, width: float, probes: int, seed: int, salt: np.ndarray | None = None):
    """(row, bucket, is_probe) of each table: the own bucket, where the vector is stored, and the probed ones.

    ``salt`` keeps vectors of different models apart.
    """
    a, b = _planes(x.shape[1], tables, functions, seed)
    y = (x @ a) / width + b
    base = np.floor(y).astype(np.int32)
    frac = y - base
    rows, keys, kinds = [], [], []
    n = np.arange(len(x))
    salt = np.zeros(len(x), np.int64) if salt is None else salt
    for t in range(tables):
        part = slice(t * functions, (t + 1) * functions)
        for i, key in enumerate([base[:, part], *_probe_keys(base[:, part], frac[:, part], probes)]):
            rows.append(n)
            keys.append(_fold(key, t) ^ salt)
            kinds.append(np.full(len(x), i > 0))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(kinds)


def expected_recall(cosine: float, tables: int, functions: int, width: float, probes: int, pairs: int = 1000, seed: int = 7, dim: int = DIM) -> float:
    """Share of random pairs of unit vectors of this cosine that meet in a bucket."""
    rng = np.random.default_rng(seed + 1000)
    x, z = rng.standard_normal((2, pairs, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    met = np.zeros(pairs, bool)
    (ra, a, pa_), (rb, b, pb) = (bucket_rows(v.astype(np.float32), tables, functions, width, probes, seed) for v in (x, cosine * x + np.sqrt(1 - cosine**2) * z))
    for row, key, probe, other_row, other, other_probe in ((ra, a, pa_, rb, b, pb), (rb, b, pb, ra, a, pa_)):
        stored = set(zip(other_row[~other_probe].tolist(), other[~other_probe].tolist(), strict=True))
        met[[r for r, k in zip(row.tolist(), key.tolist(), strict=True) if (r, k) in stored]] = True
    return float(met.mean())


def _sketch(x: np.ndarray, seed: int) -> np.ndarray:
    """Signs of ``SIGNS`` random projections as two integers a row."""
    a = np.random.default_rng(seed + 1).standard_normal((x.shape[1], SIGNS)).astype(np.float32)
    return np.packbits(x @ a > 0, axis=1).view(np.int64)


def _hot(stored: DataFrame, limit: int) -> DataFrame:
    """(bucket, blocks) of the buckets with more than ``limit`` vectors; broadcast if there are few, which a count tells."""
    hot = stored.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    hot = store(hot.select("bucket", F.ceil(F.col("n") / limit).alias("blocks")), "hot")
    return F.broadcast(hot) if hot.count() <= 100_000 else hot  # 1.6 MB at most; beyond that the join shuffles


def candidate_pairs(classes: DataFrame, tables: int, functions: int, width: float, probes: int, most_bits: int, bucket_limit: int, seed: int) -> DataFrame:
    """Distinct pairs (a < b) of classes that share a probed bucket and differ in at most ``most_bits`` signs.

    Entries cross the network once: the exchange by cell serves the stored and the probing side of the join.
    """

    def entries(batches, everything=True):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x, own = _unit(part), part.column("class_id").to_numpy()
                row, key, probe = bucket_rows(x, tables, functions, width, probes if everything else 0, seed, part.column("salt").to_numpy())
                key &= (1 << 40) - 1  # five bytes tell buckets apart; zero bytes compress
                signs = _sketch(x, seed)[row]
                columns = [pa.array(key), pa.array(own[row]), pa.array(signs[:, 0]), pa.array(signs[:, 1]), pa.array(probe)] if everything else [pa.array(key)]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "class_id", "x", "y", "probe"][: len(columns)])

    hot = _hot(classes.mapInArrow(lambda b: entries(b, False), "bucket long"), bucket_limit)
    rows = classes.mapInArrow(entries, "bucket long, class_id long, x long, y long, probe boolean").join(hot, "bucket", "left")
    blocks = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.select("*", F.explode(blocks).alias("block"))
    cell = F.when(F.col("blocks").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", "block"))
    own = F.col("blocks").isNull() | (F.pmod(F.xxhash64("class_id"), F.col("blocks")) == F.col("block"))
    rows = rows.select(cell.alias("cell"), "class_id", "x", "y", (~F.col("probe") & own).alias("stored"))
    # the filter that the join would add below one side's exchange; with it on both sides the exchange is shared
    rows = rows.filter(F.col("stored").isNotNull()).repartition("cell")
    s, p = rows.filter(above(F.col("stored"))).alias("s"), rows.filter(above(F.col("stored").isNotNull())).alias("p")
    differ = lambda c: F.bit_count(F.col(f"s.{c}").bitwiseXOR(F.col(f"p.{c}")))
    near = differ("x") + differ("y") <= most_bits
    met = s.join(p, (F.col("s.cell") == F.col("p.cell")) & (F.col("s.class_id") != F.col("p.class_id")) & near)
    return met.select(F.least("s.class_id", "p.class_id").alias("a"), F.greatest("s.class_id", "p.class_id").alias("b")).distinct()


def nearest(df: DataFrame, k: int = 10, least_cosine: float = 0.9, tables: int = 6, functions: int = 12, width: float = 2.0, probes: int = 3, bucket_limit: int = 2000, seed: int = 7) -> DataFrame:
    """The ``k`` most similar episodes of every episode: (model, episode_id, neighbour_id, similarity, rank).

    Neighbours below ``least_cosine`` are not returned; the hash parameters are made for that bound, and
    so is the limit on differing signs (three standard deviations above the mean at the bound, where it
    leaves out one pair in a thousand; fewer above).
    """
    angle = float(np.arccos(least_cosine) / np.pi)
    most_bits = int(np.ceil(SIGNS * angle + 3 * np.sqrt(SIGNS * angle * (1 - angle))))
    vectors = valid_vectors(df)
    # one value for both fields, so that all readers share one exchange of the vectors
    classes = vectors.groupBy("class_id").agg(F.first(F.struct("embedding", F.xxhash64("model").alias("salt"))).alias("c"))
    classes = classes.filter(above(F.col("c").isNotNull())).select("class_id", "c.embedding", "c.salt")
    pairs = candidate_pairs(classes, tables, functions, width, probes, most_bits, bucket_limit, seed)
    members = vectors.select("class_id", "model", "episode_id").distinct()
    scored = (
        pairs.join(classes.select(F.col("class_id").alias("a"), F.col("embedding").alias("va")), "a")
        .join(classes.select(F.col("class_id").alias("b"), F.col("embedding").alias("vb")), "b")
        .select("a", "b", cosine(F.col("va"), F.col("vb")).alias("similarity"))
        .filter(F.col("similarity") >= least_cosine)
    )
    links = scored.select(F.explode(F.array(F.struct(F.col("a").alias("class_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("class_id"), F.col("a").alias("other")))).alias("l"), "similarity").select("l.*", "similarity")
    first = members.withColumn("_n", F.row_number().over(Window.partitionBy("class_id").orderBy("episode_id"))).filter(F.col("_n") <= k + 1).drop("_n")
    own = first.select("class_id", F.col("episode_id").alias("neighbour_id"), F.lit(1.0).alias("similarity"))
    others = links.join(first.select(F.col("class_id").alias("other"), F.col("episode_id").alias("neighbour_id")), "other").select("class_id", "neighbour_id", "similarity")
    order = [F.desc("similarity"), F.asc("neighbour_id")]
    listed = own.unionByName(others).withColumn("_n", F.row_number().over(Window.partitionBy("class_id").orderBy(*order))).filter(F.col("_n") <= k + 1).drop("_n")
    found = members.join(listed, "class_id").filter(F.col("episode_id") != F.col("neighbour_id"))
    found = found.groupBy("model", "episode_id", "neighbour_id").agg(F.max("similarity").alias("similarity"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("model", "episode_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def search(df: DataFrame, queries: Column, k: int = 10, tables: int = 4, functions: int = 3, width: float = 1.2, probes: int = 18, bucket_limit: int = 20_000, seed: int = 11) -> DataFrame:
    """The ``k`` most similar episodes, however far, of the episodes chosen by the condition ``queries``.

    (model, episode_id, neighbour_id, similarity, rank). Wide buckets of few functions, probed many times. Vectors cross
    the network in half precision, once per table, queries once per probed bucket and block; a bucket of more than
    ``bucket_limit`` vectors is dealt to blocks, each of which gets the bucket's queries. In a block the queries meet the
    stored vectors in streamed batches, and the best ``4 k`` leave the task and are ranked by the exact cosine.
    """
    vectors = valid_vectors(df).select("model", "episode_id", "embedding", F.xxhash64("model").alias("salt"), F.coalesce(queries, F.lit(False)).alias("query"))

    def keys(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                _, key, _ = bucket_rows(_unit(part), tables, functions, width, 0, seed, part.column("salt").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(key)], ["bucket"])

    def entries(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x, ask = _unit(part), np.flatnonzero(part.column("query").to_numpy(zero_copy_only=False))
                salt = part.column("salt").to_numpy()
                row, key, _ = bucket_rows(x, tables, functions, width, 0, seed, salt)
                asked, probed, _ = bucket_rows(x[ask], tables, functions, width, probes, seed, salt[ask])
                row, key, probe = np.r_[row, ask[asked]], np.r_[key, probed], np.r_[np.zeros(len(row), bool), np.ones(len(asked), bool)]
                half = x.astype(np.float16)
                packed = pa.Array.from_buffers(pa.binary(2 * x.shape[1]), len(row), [None, pa.py_buffer(np.ascontiguousarray(half[row]))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(key), part.column("model").take(pa.array(row)), part.column("episode_id").take(pa.array(row)), packed, pa.array(probe)], ["bucket", "model", "episode_id", "v", "probe"])

    hot = _hot(vectors.mapInArrow(keys, "bucket long"), bucket_limit)
    rows = vectors.mapInArrow(entries, "bucket long, model string, episode_id long, v binary, probe boolean").join(hot, "bucket", "left")
    last = F.coalesce(F.col("blocks"), F.lit(1)) - 1
    block = F.explode(F.when(F.col("probe"), F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array(F.pmod(F.xxhash64("episode_id"), last + 1))))
    rows = rows.select("bucket", "model", "episode_id", "v", "probe", block.alias("block")).repartition("bucket", "block").sortWithinPartitions("bucket", "block", F.desc("probe"), "model", "episode_id")
    few = 4 * k

    def best(batches):
        key, asked, models, matrix = None, [], [], None
        for pdf in batches:
            for group, part in pdf.groupby(["bucket", "block"], sort=False):
                if group != key:
                    key, asked, models, matrix = group, [], [], None
                ask = part[part.probe]
                if len(ask):
                    asked += ask.episode_id.tolist()
                    models += ask.model.tolist()
                    new = np.frombuffer(b"".join(ask.v), np.float16).reshape(len(ask), -1).astype(np.float32)
                    matrix = new if matrix is None else np.concatenate([matrix, new])
                rest = part[~part.probe]
                if matrix is None or not len(rest):
                    continue
                ids, names = rest.episode_id.to_numpy(), rest.model.to_numpy()
                scores = matrix @ np.frombuffer(b"".join(rest.v), np.float16).reshape(len(rest), -1).astype(np.float32).T
                scores[(np.array(asked)[:, None] == ids[None, :]) | (np.array(models, dtype=object)[:, None] != names[None, :])] = -2
                top = np.argpartition(-scores, few - 1, axis=1)[:, :few] if scores.shape[1] > few else np.tile(np.arange(scores.shape[1]), (len(asked), 1))
                q = np.repeat(np.arange(len(asked)), top.shape[1])
                s = scores[q, top.ravel()]
                ok = s > -2
                yield pd.DataFrame({"model": np.array(models, dtype=object)[q][ok], "episode_id": np.array(asked)[q][ok], "neighbour_id": ids[top.ravel()][ok], "near": s[ok]})

    hits = rows.mapInPandas(best, "model string, episode_id long, neighbour_id long, near float").groupBy("model", "episode_id", "neighbour_id").agg(F.max("near").alias("near"))
    by_query = Window.partitionBy("model", "episode_id")
    hits = hits.withColumn("n", F.row_number().over(by_query.orderBy(F.desc("near"), F.asc("neighbour_id")))).filter(F.col("n") <= few).select("model", "episode_id", "neighbour_id")
    hits = store(hits, "hits")  # at most 4 k rows for each query
    side = lambda name, vector: vectors.select("model", F.col("episode_id").alias(name), F.col("embedding").alias(vector))
    asked = side("episode_id", "va").join(hits.select("model", "episode_id").distinct(), ["model", "episode_id"], "left_semi").distinct()
    exact = hits.join(side("neighbour_id", "vb"), ["model", "neighbour_id"]).join(asked, ["model", "episode_id"])
    exact = exact.groupBy("model", "episode_id", "neighbour_id").agg(F.max(cosine(F.col("va"), F.col("vb"))).alias("similarity"))
    ranked = exact.withColumn("rank", F.row_number().over(by_query.orderBy(F.desc("similarity"), F.asc("neighbour_id"))))
    return ranked.filter(F.col("rank") <= k)
