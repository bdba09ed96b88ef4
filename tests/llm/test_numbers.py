"""Vectors, consensus and mixing."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from audiolake.llm import consensus, knn, mixing


def vectors(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 64))
    for i in range(0, n, 4):  # a near copy of every fourth
        x[i + 1] = x[i] * 3 + rng.standard_normal(64) * 0.2
    data = [(i, "m", [float(v) for v in x[i]]) for i in range(n)]
    odd = [(9001, "m", None), (9002, "m", [1.0] * 63), (9003, "m", [0.0] * 64), (9004, "m", [float("nan")] * 64), (9005, None, [1.0] * 64), (None, "m", [1.0] * 64), (0, "m", data[0][2]), (9006, "other", data[0][2])]
    return x, spark.createDataFrame([(a, b, c, "x") for a, b, c in data + odd], "episode_id long, model string, embedding array<float>, class_id string")


def test_nearest_recall_and_precision(spark):
    x, df = vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    want = {(i, j) for i, j in zip(*np.where(s >= 0.9))}
    got = {(r.episode_id, r.neighbour_id): r.similarity for r in knn.nearest(df).collect()}
    assert set(got) <= want and len(got) / len(want) >= 0.9
    assert all(abs(v - s[k]) < 1e-5 for k, v in got.items())
    assert knn.nearest(df.limit(0)).count() == 0


def test_search_recall(spark):
    x, df = vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    got = {}
    for r in knn.search(df, (F.col("episode_id") % 50 == 0) & (F.col("model") == "m")).collect():
        got.setdefault(r.episode_id, set()).add(r.neighbour_id)
    hits = [len(got[i] & set(np.argsort(-s[i])[:10])) / 10 for i in range(0, 400, 50)]
    assert np.mean(hits) >= 0.9


def test_hot_vector_and_ties(spark):
    v = [float(i % 7 + 1) for i in range(64)]
    df = spark.createDataFrame([(i, "m", v) for i in range(300)], "episode_id long, model string, embedding array<float>")
    got = knn.nearest(df, k=3)
    assert got.count() == 900
    assert sorted(r.neighbour_id for r in got.filter("episode_id = 100").collect()) == [0, 1, 2]
    assert sorted(r.neighbour_id for r in got.filter("episode_id = 1").collect()) == [0, 2, 3]


def test_recall_on_other_vectors_by_band(spark):
    """Pairs of stated cosines, drawn apart from all data, hot buckets divided or not."""
    rng = np.random.default_rng(77)
    x = rng.standard_normal((600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((600, 64))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = np.repeat([0.901, 0.91, 0.919, 0.93, 0.949, 0.97], 100)[:, None]
    both = np.concatenate([x, c * x + np.sqrt(1 - c * c) * z])
    df = spark.createDataFrame([(i, "m", [float(v) for v in r]) for i, r in enumerate(both)], "episode_id long, model string, embedding array<float>")
    found = lambda limit: {(r.episode_id, r.neighbour_id) for r in knn.nearest(df, bucket_limit=limit).collect()}
    whole, divided = found(2000), found(20)
    share = lambda low, high: np.mean([(i, i + 600) in whole for i in range(600) if low <= c[i, 0] < high])
    assert whole == divided and share(0.9, 0.92) >= 0.9 and share(0.92, 0.95) >= 0.95 and share(0.95, 1) >= 0.98
    assert knn.expected_recall(0.9, 6, 12, 2.0, 3) >= 0.9


def test_hot_bucket_keeps_its_pairs(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(64)
    x = base + rng.standard_normal((300, 64)) * 0.25
    df = spark.createDataFrame([(i, "m", [float(v) for v in r]) for i, r in enumerate(x)], "episode_id long, model string, embedding array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    want = {(i, j) for i, j in zip(*np.where(s >= 0.9))}
    pairs = lambda limit: {(r.episode_id, r.neighbour_id) for r in knn.nearest(df, k=299, bucket_limit=limit).collect()}
    divided, whole = pairs(5), pairs(10**6)
    assert divided == whole <= want and len(divided) / len(want) >= 0.9


def test_probes_are_the_cheapest_of_each_vector():
    rng = np.random.default_rng(3)
    for m, probes in ((2, 5), (3, 1), (3, 4), (3, 14), (4, 8)):
        frac = rng.random((40, m))
        frac[0] = 0.5  # both sides of every function are equally near
        got = knn._probe_keys(np.zeros((40, m), np.int32), frac, probes)
        for i in range(1, 40):
            moves = [o for o in itertools.product((-1, 0, 1), repeat=m) if any(o)]
            cost = {o: sum(frac[i, j] ** 2 if v < 0 else (1 - frac[i, j]) ** 2 for j, v in enumerate(o) if v) for o in moves}
            assert [tuple(int(v) for v in k[i]) for k in got] == sorted(moves, key=cost.get)[:probes]


def judgments(spark):
    rng = np.random.default_rng(4)
    data, truth = [], {}
    for item in range(300):
        t = int(rng.integers(0, 4))
        truth[item] = t
        for judge, kind in (("Good A", 0), ("good b ", 0), ("random", 1), ("random2", 1), ("high", 2), ("flip", 3)):
            if rng.random() < 0.85:
                g = t if kind == 0 and rng.random() < 0.9 else int(rng.integers(0, 4)) if kind < 2 else min(3, t + 1) if kind == 2 else 3 - t
                data.append(("q", item, g, judge, "2026-01-01T00:00:00Z", None))
    data += [("q", 0, 9, "GOOD A", "2027-01-01T00:00:00Z", None), ("q", 1, None, "good a", "2027-01-01T00:00:00Z", None), ("q", 2, 1, None, None, None), ("q", 3, 1, " ", None, None), (None, 4, 1, "good a", None, None)]
    data += data[:20]
    return truth, spark.createDataFrame([(*r, 1) for r in data], "query_id string, episode_id long, grade int, judge string, judged_at string, notes string, votes int")


def test_consensus_beats_majority(spark):
    truth, df = judgments(spark)
    got = {r.episode_id: r.grade for r in consensus.consensus(df).collect()}
    right = np.mean([got[i] == truth[i] for i in got])
    cast = {}
    for r in consensus.votes(df).collect():
        cast.setdefault(r.episode_id, []).append(r.grade)
    majority = np.mean([np.bincount(v, minlength=4).argmax() == truth[i] for i, v in cast.items()])
    assert right > 0.93 and right > majority + 0.05
    trust = {r.judge: r.accuracy for r in consensus.reliability(df).collect()}
    assert set(trust) == {"good a", "good b", "random", "random2", "high", "flip"}
    assert min(trust["good a"], trust["good b"]) > max(trust["random"], trust["flip"]) + 0.3


def test_both_layouts_and_convergence(spark):
    _, df = judgments(spark)
    cast = consensus.votes(df)
    a, b = consensus.reweigh(cast), consensus.reweigh(cast, gathered=0)
    assert a.judges == b.judges and abs(a.accuracy - b.accuracy).max() < 1e-9 and a.rounds == b.rounds > 1
    key = lambda f: {(r.query_id, r.episode_id): tuple(r.vs) for r in f.items.collect()}
    assert key(a) == key(b)
    with pytest.raises(RuntimeError):
        consensus.reweigh(cast, most_rounds=1)


def test_latest_grade_counts_and_empty(spark):
    data = [("q", 1, 0, "A", "2026-01-01T00:00:00Z"), ("q", 1, 3, "a ", "2026-02-01T00:00:00Z"), ("q", 1, 2, "a", "bad date")]
    df = spark.createDataFrame(data, "query_id string, episode_id long, grade int, judge string, judged_at string")
    r = consensus.consensus(df).first()
    assert (r.grade, r.votes, r.agreement) == (3, 1, None)
    assert consensus.consensus(df.limit(0)).count() == 0
    assert consensus.alpha(df.limit(0)).first().alpha is None


def test_mixing(spark):
    docs = [(i, "word " * (i % 40 + 1), " Big" if i % 2 else "big") for i in range(4000)] + [(5000 + i, "tiny text here", "small") for i in range(30)]
    docs += [(9000, None, "big"), (9001, "", "big"), (9002, "x", None), (None, "x", "big"), (9003, "y " * 50_000, "unused")]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, source string, tokens int")
    targets = spark.createDataFrame([("m", "BIG", 3.0, 1), ("m", "small", 1.0, 4), ("m", "absent", 1.0, 9), ("m", "unused", 0.0, 2), ("n", "big", None, 1)], "mix_name string, source string, target_share double, max_repeats int")
    sizes = mixing.sized(df)
    plan = mixing.rates(sizes, targets)
    got = {(r.mix_name, r.source): r for r in mixing.report(sizes, plan).collect()}
    assert got["m", "small"].rate == 4.0 and got["m", "small"].emitted_documents == 120
    assert got["m", "big"].actual_share == pytest.approx(0.75, abs=0.1)
    assert got["m", "absent"].emitted_documents == got["m", "unused"].emitted_documents == got["n", "big"].emitted_documents == 0
    records = mixing.mixed(sizes, plan).collect()
    assert len(records) == len(set(records)) and max(r.copy for r in records) == 4
    assert len(records) == sum(r.emitted_documents for r in got.values())
    assert mixing.report(sizes.limit(0), mixing.rates(sizes.limit(0), targets)).agg(F.sum("emitted_tokens")).first()[0] == 0


def test_shares_of_many_documents_are_close(spark):
    sizes = spark.createDataFrame([(i, s, 10 + i % 7) for s, n in (("a", 4000), ("b", 1500), ("c", 300)) for i in range(n)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("m", "a", 0.5, 3.0), ("m", "b", 0.3, 3.0), ("m", "c", 0.2, 8.0), ("n", "a", 0.7, 1.0), ("n", "b", 0.3, 1.5), ("n", "gone", 0.4, 9.0)], "mix_name string, source string, target_share double, max_repeats double")
    got = {(r.mix_name, r.source): r for r in mixing.report(sizes, mixing.rates(sizes, targets)).collect()}
    want = {("m", "a"): 0.5, ("m", "b"): 0.3, ("m", "c"): 0.2, ("n", "a"): 0.7, ("n", "b"): 0.3, ("n", "gone"): 0.0}
    assert all(abs(got[k].actual_share - v) < 0.01 for k, v in want.items())
    assert all(r.rate <= cap for k, cap in ((("m", "a"), 3), (("m", "b"), 3), (("m", "c"), 8), (("n", "a"), 1), (("n", "b"), 1.5)) for r in [got[k]])


def test_long_texts_are_cut_where_tokens_end():
    encoding = mixing._encoding(mixing.VOCABULARY)
    text = "".join(f"Wort{i}  über 12 naïve,\n" for i in range(4000))
    assert sum(len(encoding.encode_ordinary(p)) for p in mixing._pieces(text, 500)) == len(encoding.encode_ordinary(text))
