"""Retrieval systems and ranking candidates: three legs, fusions, popularity by named categories, united evidence.

A system takes tables and a batch of queries and gives (query_id, episode_id, rank). Candidates are the union of three legs
of equal depth; every candidate gets the evidence of every source, whichever leg found it.

Defined results: a query without words has no lexical and no vector leg (status ``skipped``) and still gets popular
episodes; a query whose words name no category gets globally popular episodes; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from audiolake.functions import text
from audiolake.operators import lexical, retrieval, vectors
from audiolake.session import store

LEGS = ("lexical", "e5", "two_tower")
#: Models of the vector legs; a colon at the end takes every version.
MODELS = {"e5": "e5", "two_tower": "two-tower:"}
#: Vectors of transcripts live in the space of e5, so its query vectors serve them.
TRANSCRIPT_MODEL = "e5-transcript"


class Catalogue:
    """Tables and a batch of queries, with what several systems share computed once."""

    def __init__(self, episodes: DataFrame, podcasts: DataFrame, transcripts: DataFrame, embeddings: DataFrame, queries: DataFrame):
        self.episodes, self.podcasts, self.transcripts, self.embeddings, self.queries = episodes, podcasts, transcripts, embeddings, queries
        self._found: tuple[DataFrame, DataFrame, DataFrame] | None = None
        self._asked: DataFrame | None = None
        self._legs: dict[str, tuple[int, DataFrame]] = {}

    def found(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        if self._found is None:
            self._found = lexical.matches(self.episodes, self.podcasts, self.transcripts, self.queries)
        return self._found

    def asked(self) -> DataFrame:
        """The encoded queries of all vector legs."""
        if self._asked is None:
            self._asked = vectors.filtered_queries(self.queries, list(MODELS.values()))
        return self._asked

    def deepen(self, depths: dict[str, int]) -> None:
        """Store these legs where none of that depth or more is, one after another: plans at work at once add up in the driver's memory."""
        for name, k in depths.items():
            if self._legs.get(name, (0,))[0] >= k:
                continue
            if name == "lexical":
                rows = lexical.pool(self.episodes, self.found(), self.queries, k)
            else:
                rows = vectors.leg(self.embeddings, self.episodes, self.queries, MODELS[name], k, asked=self.asked()).select("query_id", "episode_id", "rank")
            self._legs[name] = k, store(rows, f"leg-{name}")

    def leg(self, name: str, k: int) -> DataFrame:
        """(query_id, episode_id, rank) of one leg; the deepest one that was asked for is stored and serves all that are less deep."""
        self.deepen({name: k})
        rows = self._legs[name][1]
        return lexical.cut(rows, k).drop("score") if name == "lexical" else rows.filter(F.col("rank") <= k)

    def taken(self, name: str, depths: dict[str, int]) -> DataFrame:
        """(system, leg, query_id, episode_id, rank) of one leg at the depth of each system."""
        self.deepen({name: max(depths.values())})
        rows = self._legs[name][1]
        if name == "lexical":
            rows = lexical.cuts(rows, depths)
        else:
            systems = F.filter(F.array(*[F.struct(F.lit(n).alias("system"), F.lit(k).alias("depth")) for n, k in depths.items()]), lambda s: F.col("rank") <= s["depth"])
            rows = rows.select(F.explode(systems).alias("s"), "*").select("s.system", "query_id", "episode_id", "rank")
        return rows.select("system", F.lit(name).alias("leg"), "query_id", "episode_id", "rank")

    def legs(self, names: tuple[str, ...], k: int) -> DataFrame:
        """(query_id, leg, episode_id, rank) of several legs."""
        self.deepen(dict.fromkeys(names, k))
        parts = [self.leg(n, k).select("query_id", F.lit(n).alias("leg"), "episode_id", "rank") for n in names]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def popular(c: Catalogue, k: int, *ways: bool) -> DataFrame:
    """(by_category, query_id, episode_id, rank): most popular episodes under the query's filters; by category, of those it names if it names any.

    A category is named if all its words are in the query. Equal filters are ranked once and shared by their queries and ways. A
    filter meets an episode by equality: of its language with a beginning of the episode's, and of its categories with the
    show's (or of none with none).
    """
    shows = c.podcasts.select(F.col("id").alias("podcast_id"), "popularity", "categories")
    asked = c.queries.dropDuplicates(["query_id"]).select("query_id", F.lower(F.coalesce("filter_language", F.lit(""))).alias("wanted"), F.coalesce("filter_max_seconds", F.lit(0)).cast("long").alias("most"), F.array_distinct(text.words(F.col("query_text"))).alias("w"))
    if any(ways):
        names = shows.select(F.explode("categories").alias("category")).distinct().withColumn("cw", F.array_distinct(text.words(F.col("category")))).filter(F.size("cw") > 0)
        first = asked.select("query_id", F.explode("w").alias("word"))
        named = first.join(names.select("category", F.explode("cw").alias("word"), F.size("cw").alias("need")), "word").groupBy("query_id", "category", "need").agg(F.count(F.lit(1)).alias("n")).filter("n = need")
        named = named.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("category")), "\n").alias("named"))  # at most the query's words
        asked = asked.join(named, "query_id", "left")
    else:
        asked = asked.withColumn("named", F.lit(""))
    asked = asked.withColumn("by_category", F.explode(F.array(*[F.lit(w) for w in ways]))).withColumn("named", F.when(F.col("by_category"), F.coalesce("named", F.lit(""))).otherwise(""))
    kinds = asked.select("wanted", "most", "named").distinct().withColumn("category", F.explode(F.split("named", "\n")))
    spoken = F.lower(F.coalesce("language", F.lit("")))
    beginnings = F.transform(F.sequence(F.lit(0), F.length(spoken)), lambda n: F.left(spoken, n))
    shelves = F.concat(F.array(F.lit("")), F.coalesce("categories", F.array().cast("array<string>"))) if any(ways) else F.array(F.lit(""))
    rows = c.episodes.select(F.col("id").alias("episode_id"), "podcast_id", "language", "duration_seconds", "published_at").join(shows, "podcast_id")
    rows = rows.select("episode_id", "duration_seconds", "published_at", "popularity", F.explode(F.array_distinct(beginnings)).alias("wanted"), F.array_distinct(shelves).alias("c")).join(kinds.select("wanted").distinct(), "wanted", "left_semi")
    rows = rows.withColumn("category", F.explode("c")).drop("c").join(kinds, ["wanted", "category"])
    rows = rows.filter((F.col("most") <= 0) | F.coalesce(F.col("duration_seconds") <= F.col("most"), F.lit(False)))
    keys = ["wanted", "most", "named"]
    order = [F.desc("popularity"), F.desc_nulls_last("published_at"), F.asc("episode_id")]
    # an episode on several of a filter's shelves is there several times: k of them for each shelf are enough
    best = retrieval.top(rows, [*keys, "category"], order, k, "r").select(*keys, "episode_id", "popularity", "published_at").distinct()
    best = retrieval.top(best, keys, order, k)
    return asked.join(best.select(*keys, "episode_id", "rank"), keys).select("by_category", "query_id", "episode_id", "rank")


def fused(c: Catalogue, names: tuple[str, ...], depth: int, k: int) -> DataFrame:
    """(query_id, episode_id, rank) by reciprocal ranks over the legs."""
    return retrieval.rrf(c.legs(names, depth), "episode_id", dict.fromkeys(names, 1.0)).filter(F.col("rank") <= k).select("query_id", "episode_id", "rank")


#: Systems by name.
SYSTEMS: dict[str, Callable[[Catalogue, int], DataFrame]] = {
    "lexical": lambda c, k: c.leg("lexical", k),
    "e5": lambda c, k: c.leg("e5", k),
    "two-tower": lambda c, k: c.leg("two_tower", k),
    "hybrid-rrf": lambda c, k: fused(c, ("lexical", "e5"), max(200, k), k),
    "rrf3": lambda c, k: fused(c, LEGS, 50, k),
    "popularity-global": lambda c, k: popular(c, k, False).drop("by_category"),
    "popularity-category": lambda c, k: popular(c, k, True).drop("by_category"),
}
#: Systems of popular episodes, and whether by category.
POPULAR = {"popularity-global": False, "popularity-category": True}
#: Legs of the systems and their depths.
DEPTHS: dict[str, Callable[[int], dict[str, int]]] = {
    "lexical": lambda k: {"lexical": k},
    "e5": lambda k: {"e5": k},
    "two-tower": lambda k: {"two_tower": k},
    "hybrid-rrf": lambda k: dict.fromkeys(("lexical", "e5"), max(200, k)),
    "rrf3": lambda k: dict.fromkeys(LEGS, 50),
}


def run(name: str, c: Catalogue, k: int) -> DataFrame:
    """The ranking of a system; an unknown name is an error."""
    if name not in SYSTEMS:
        raise ValueError(f"unknown system {name!r}; known: {', '.join(sorted(SYSTEMS))}")
    return SYSTEMS[name](c, k)


def runs(names: tuple[str, ...], c: Catalogue, k: int) -> DataFrame:
    """(system, query_id, episode_id, rank): the first ``k`` of several systems.

    Each leg is computed once, as deep as any of them takes it; one fusion ranks all systems of legs (that of a single leg keeps its
    order) and one plan popular episodes: every plan that runs, and every part of it, stays in the driver's memory for some time.
    """
    needs = {n: DEPTHS[n](k) for n in names if n in DEPTHS}
    uses = {leg: {n: d[leg] for n, d in needs.items() if leg in d} for leg in LEGS}
    loved = [n for n in names if n in POPULAR]
    parts = [run(n, c, k).filter(F.col("rank") <= k).select(F.lit(n).alias("system"), "query_id", "episode_id", "rank") for n in names if n not in needs and n not in loved]
    if legs := [c.taken(leg, depths) for leg, depths in uses.items() if depths]:
        every = legs[0]
        for x in legs[1:]:
            every = every.unionByName(x)
        fusion = retrieval.rrf(every, "episode_id", by=("system", "query_id"))
        parts.append(fusion.filter(F.col("rank") <= k).select("system", "query_id", "episode_id", "rank"))
    if loved:
        name = F.create_map(*[F.lit(x) for n in loved for x in (POPULAR[n], n)])[F.col("by_category")]
        parts.append(popular(c, k, *[POPULAR[n] for n in loved]).select(name.alias("system"), "query_id", "episode_id", "rank"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def candidates(c: Catalogue, depth: int = 50) -> DataFrame:
    """One row per query and united candidate with ranks, evidence, similarities and the fields of episode and show."""
    legs = c.legs(LEGS, depth)
    pairs = legs.groupBy("query_id", "episode_id").agg(*[F.min(F.when(F.col("leg") == n, F.col("rank"))).alias(f"{n}_rank") for n in LEGS])
    e = c.episodes.select(F.col("id").alias("episode_id"), "podcast_id", "title", F.left("description", F.lit(1000)).alias("description"), "language", "duration_seconds", "published_at", "explicit")
    p = c.podcasts.select(F.col("id").alias("podcast_id"), F.col("title").alias("podcast_title"), "publisher", "popularity", F.col("explicit").alias("show_explicit"))
    sizes = c.episodes.groupBy("podcast_id").agg(F.count(F.lit(1)).alias("show_episodes"))
    told = c.transcripts.select("episode_id", F.lit(True).alias("has_transcript")).distinct()
    q = c.queries.dropDuplicates(["query_id"]).select("query_id", "query_text", F.col("filter_language").alias("wanted_language"), F.col("filter_max_seconds").alias("wanted_seconds"))
    rows = lexical.evidence(pairs.join(e, "episode_id"), c.found())
    rows = vectors.similarities(rows, c.embeddings, c.queries, {"e5_sim": MODELS["e5"], "two_tower_sim": MODELS["two_tower"], "transcript_sim": TRANSCRIPT_MODEL}, {TRANSCRIPT_MODEL: MODELS["e5"]})
    rows = rows.join(p, "podcast_id").join(sizes, "podcast_id").join(told, "episode_id", "left").join(q, "query_id")
    return rows.withColumn("has_transcript", F.coalesce("has_transcript", F.lit(False))).withColumn("shown_explicit", F.coalesce(F.col("explicit"), F.lit(False)) | F.coalesce(F.col("show_explicit"), F.lit(False)))


def leg_report(c: Catalogue, depth: int = 50) -> DataFrame:
    """(query_id, leg, status, n): what each leg gave each query; ``skipped`` for queries without words."""
    asked = c.queries.dropDuplicates(["query_id"]).select("query_id", (F.size(text.words(F.col("query_text"))) > 0).alias("worded"), F.explode(F.array(*[F.lit(n) for n in LEGS])).alias("leg"))
    n = c.legs(LEGS, depth).groupBy("query_id", "leg").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(n, ["query_id", "leg"], "left").select("query_id", "leg", F.when(F.col("worded"), "ok").otherwise("skipped").alias("status"), F.coalesce("n", F.lit(0)).alias("n"))


def pooled(c: Catalogue, names: tuple[str, ...], k: int) -> DataFrame:
    """(query_id, episode_id, best_rank, sources): the union of the systems' first ``k`` with the ranks by system."""
    listed = F.sort_array(F.collect_list(F.concat_ws(":", "system", F.col("rank").cast("string"))))  # one entry per system
    return runs(names, c, k).groupBy("query_id", "episode_id").agg(F.min("rank").alias("best_rank"), F.array_join(listed, ",").alias("sources"))


def scored(rows: DataFrame, score: str, fallback: str) -> DataFrame:
    """``rows`` with ``ordering`` and ``place``: a query is ordered by its scores if all are numbers, else by the fallback."""
    query = Window.partitionBy("query_id")
    fine = F.min((F.col(score).isNotNull() & ~F.isnan(score)).cast("int")).over(query) == 1
    rows = rows.withColumn("ordering", F.when(fine, "ranker").otherwise("rrf"))
    value = F.round(F.when(F.col("ordering") == "ranker", F.col(score)).otherwise(F.col(fallback)), 9)
    return rows.withColumn("_s", value).withColumn("place", F.row_number().over(query.orderBy(F.desc("_s"), "episode_id"))).drop("_s")
