"""Event streams: deduplication, windows, alerts, sessions, attribution, outbox, leases.

Each operator works on batch and streaming DataFrames; :func:`drain` runs a streaming query over what is
there and returns its output. State is bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from audiolake.session import forget, shared_folder


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of the test layout as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parquet*")


def drain(df: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a streaming DataFrame with the available-now trigger into files of the shared folder, and read them.

    The file sink commits each micro-batch once, so a restart after a lost executor adds no row twice.
    """
    import uuid

    spark = df.sparkSession
    out = f"{shared_folder(spark)}/stream-{label}-{uuid.uuid4().hex}"
    query = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    query.awaitTermination()
    forget(spark, out)
    forget(spark, out + "-state")
    return spark.read.schema(df.schema).parquet(out)


def deduplicated(events: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """First event of each key within the watermark."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, at: str, width: str, group: str, delay: str | None = None) -> DataFrame:
    """(start, group, n, total): counts and sums of ``value`` by window."""
    base = events.withWatermark(at, delay) if delay else events
    return base.groupBy(F.window(at, width).alias("w"), group).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), group, "n", "total")


def ratio_alerts(events: DataFrame, at: str, width: str, slide: str, bad: str, limit: float, least: int = 20, delay: str | None = None) -> DataFrame:
    """(start, n, bad, ratio): sliding windows in which the share of rows that meet ``bad`` passes the limit."""
    base = events.withWatermark(at, delay) if delay else events
    rows = base.groupBy(F.window(at, width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(bad)).alias("bad"))
    return rows.filter((F.col("n") >= least) & (F.col("bad") > limit * F.col("n"))).select(F.col("w.start").alias("start"), "n", "bad", F.round(F.col("bad") / F.col("n"), 6).alias("ratio"))


def sessions(events: DataFrame, user: str, at: str, gap: str, delay: str | None = None) -> DataFrame:
    """(user, start, end_at, n): runs of a user's events with gaps below ``gap``."""
    base = events.withWatermark(at, delay) if delay else events
    rows = base.groupBy(user, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last"))
    return rows.select(user, F.col("w.start").alias("start"), F.col("last").alias("end_at"), "n")


def attributed(impressions: DataFrame, served: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) impressions. served: query_id, episode_id, rank, score, version.

    Rank, score and version are those that were served. A batch (batch_id) with any item that was not served, or of
    more than 100 items, is rejected whole.
    """
    known = impressions.select("batch_id", "query_id", "episode_id").join(served, ["query_id", "episode_id"], "left")
    bad = known.groupBy("batch_id").agg(F.bool_or(F.col("rank").isNull()).alias("alien"), F.count(F.lit(1)).alias("n")).filter("alien OR n > 100").select("batch_id")
    return known.join(bad, "batch_id", "left_anti"), impressions.join(bad, "batch_id", "left_semi")


def attributed_stream(clicks: DataFrame, views: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Stream-stream join: each click with the views of its user at most ``delay`` before it; both sides watermarked."""
    c = clicks.select(F.col("event_id").alias("click_id"), F.col("ts").alias("clicked"), F.col("user_id").alias("cu")).withWatermark("clicked", delay)
    v = views.select(F.col("event_id").alias("view_id"), F.col("ts").alias("viewed"), F.col("user_id").alias("vu")).withWatermark("viewed", delay)
    near = (F.col("cu") == F.col("vu")) & (F.col("viewed") <= F.col("clicked")) & (F.col("viewed") >= F.col("clicked") - F.expr(f"INTERVAL {delay}"))
    return c.join(v, near).select("click_id", "view_id", F.col("cu").alias("user_id"))


def drain_outbox(outbox: DataFrame, handlers: dict[str, Callable[[DataFrame], None]], most_attempts: int = 10) -> DataFrame:
    """(id, type, outcome) of pending entries: handled by type, unknown types consumed, exhausted ones dead.

    For ``foreachBatch``; delivery is at least once, so handlers are given ids to be idempotent by.
    """
    waiting = outbox.filter(F.col("processed_at").isNull())
    for kind, handle in handlers.items():
        handle(waiting.filter((F.col("type") == kind) & (F.col("attempts") < most_attempts)).orderBy("id"))
    known = F.col("type").isin(list(handlers)) if handlers else F.lit(False)
    return waiting.select("id", "type", F.when(F.col("attempts") >= most_attempts, "dead").when(known, "handled").otherwise("consumed").alias("outcome"))


def claim(jobs: DataFrame, now, n: int) -> DataFrame:
    """The ``n`` oldest due pending jobs with their attempt counted and a lease; one writer per job table."""
    due = jobs.filter((F.col("status") == "pending") & (F.col("run_at") <= F.lit(now))).orderBy("run_at", "id").limit(n)
    return due.withColumn("status", F.lit("running")).withColumn("attempts", F.col("attempts") + 1).withColumn("lease_expires_at", F.lit(now) + F.expr("INTERVAL 5 minutes"))


def split_batches(df: DataFrame, outputs: dict[str, Callable[[DataFrame], DataFrame]], label: str) -> dict[str, DataFrame]:
    """Run a stream and write several results of each micro-batch from one reading of it.

    Every result of a batch goes to a folder of the batch's number, which a repeated batch overwrites, so that an
    executor or driver lost between two writes adds no row twice and leaves no result of a batch without the other.
    """
    import uuid

    spark = df.sparkSession
    base = f"{shared_folder(spark)}/stream-{label}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for name, f in outputs.items():
            f(batch).write.mode("overwrite").parquet(f"{base}/{name}/batch={number}")
        batch.unpersist()

    df.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    forget(spark, base)
    return {name: spark.read.parquet(f"{base}/{name}").drop("batch") for name in outputs}


def attributed_playbacks(playbacks: DataFrame, served: DataFrame, episodes: DataFrame) -> DataFrame:
    """Playbacks (event_id, query_id or NULL, episode_id) with ``rank``, ``score`` and ``outcome``: attributed, unattributed (no search named) or rejected (not a result of it, or no such episode)."""
    known = playbacks.join(episodes.select("episode_id").distinct().withColumn("_e", F.lit(True)), "episode_id", "left").join(served.select("query_id", "episode_id", "rank", "score"), ["query_id", "episode_id"], "left")
    outcome = F.when(F.col("_e").isNull(), "rejected").when(F.col("query_id").isNull(), "unattributed").when(F.col("rank").isNull(), "rejected").otherwise("attributed")
    return known.select("event_id", "query_id", "episode_id", "rank", "score", outcome.alias("outcome"))


def exported(events: DataFrame, session: str, wanted: DataFrame, at: str) -> DataFrame:
    """(session, place, kind, event_id, at) of the wanted sessions: searches first, in time order, then the other events by time and id."""
    rows = events.join(wanted.select(session).distinct(), session, "left_semi")
    order = Window.partitionBy(session).orderBy(F.desc("search"), at, "event_id")
    return rows.select(session, F.row_number().over(order).alias("place"), F.when(F.col("search"), "search").otherwise("event").alias("kind"), "event_id", at)


def alerts(events: DataFrame, at: str, rules: list[tuple[str, str, str, str, str, float, int]], delay: str | None = None) -> DataFrame:
    """(rule, start, n, bad, ratio) of windows in which a rule (name, width, slide, of, bad, limit, least) is broken.

    ``of`` and ``bad`` are conditions; a window of at least ``least`` rows that meet ``of`` fires if the share of those that also
    meet ``bad`` passes the limit. One pass over the events for the rules of a window, which may be a stream.
    """
    base = events.withWatermark(at, delay) if delay else events
    out = None
    for width, slide in dict.fromkeys((r[1], r[2]) for r in rules):
        own = [r for r in rules if (r[1], r[2]) == (width, slide)]
        cells = F.array(*[F.struct(F.lit(name).alias("rule"), F.coalesce(F.expr(of), F.lit(False)).alias("of"), F.coalesce(F.expr(of) & F.expr(bad), F.lit(False)).alias("bad"), F.lit(float(limit)).alias("limit"), F.lit(least).alias("least")) for name, _, _, of, bad, limit, least in own])
        rows = base.select(F.col(at).alias("_at"), F.explode(cells).alias("c"))
        rows = rows.groupBy(F.window("_at", width, slide).alias("w"), "c.rule", "c.limit", "c.least").agg(F.count_if("c.of").alias("n"), F.count_if("c.bad").alias("bad"))
        rows = rows.filter((F.col("n") >= F.col("least")) & (F.col("n") > 0) & (F.col("bad") > F.col("limit") * F.col("n"))).select("rule", F.col("w.start").alias("start"), "n", "bad", F.round(F.col("bad") / F.col("n"), 6).alias("ratio"))
        out = rows if out is None else out.unionByName(rows)
    return out
