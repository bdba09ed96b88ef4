"""Readers and writers: JSON lines, judgments as text, feeds in XML, transcripts, versioned datasets."""

from __future__ import annotations

import hashlib
import json
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITUNES = "{http://www.itunes.com/dtds/podcast-1.0.dtd}"
PODCAST = "{https://podcastindex.org/namespace/1.0}"
FEED_SCHEMA = (
    "feed_title string, feed_language string, feed_categories array<string>, feed_publisher string, feed_image string, feed_link string, feed_explicit string, position int, guid string, title string, description string, "
    "enclosure_url string, pub_date string, duration string, explicit string, image string, link string, transcripts array<struct<url:string,type:string,language:string>>"
)


def read_any(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Parquet or JSON lines by suffix; other suffixes are an error. ``event_time`` text becomes a timestamp."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    elif path.endswith((".jsonl", ".ndjson")):
        df = spark.read.json(path, schema=schema)
    else:
        raise ValueError(f"unknown format: {path}")
    if "event_time" in df.columns and df.schema["event_time"].dataType.simpleString() == "string":
        df = df.withColumn("event_time", F.try_to_timestamp("event_time"))
    return df


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines with every field of every row, NULL ones too."""
    df.write.option("ignoreNullFields", "false").json(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, episode_id, grade) of lines ``query 0 episode grade``; other lines are left out."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(p.alias("p")).filter(F.size("p") == 4)
    return rows.select(F.col("p")[0].alias("query_id"), F.col("p")[2].try_cast("bigint").alias("episode_id"), F.col("p")[3].try_cast("int").alias("grade")).dropna()


def write_qrels(df: DataFrame, path: str) -> None:
    line = F.concat_ws(" ", "query_id", F.lit("0"), F.col("episode_id").cast("string"), F.col("grade").cast("string"))
    df.orderBy("query_id", "episode_id").select(line.alias("value")).write.text(path)


def feed_items(xml: str | None) -> list[tuple]:
    """Rows of one RSS document; categories depth first, without repeats; unreadable documents have none."""
    try:
        channel = ET.fromstring((xml or "").strip()).find("channel")
    except ET.ParseError:
        return []
    if channel is None:
        return []
    text = lambda node, tag: (node.findtext(tag) or "").strip()
    seen: dict[str, None] = {}

    def walk(node):
        for c in node.findall(f"{ITUNES}category"):
            name = (c.get("text") or "").strip()
            if name:
                seen.setdefault(name)
            walk(c)

    walk(channel)
    for c in channel.findall("category"):
        if (c.text or "").strip():
            seen.setdefault(c.text.strip())
    picture = lambda node: (node.find(f"{ITUNES}image").get("href") or "").strip() if node.find(f"{ITUNES}image") is not None else ""
    head = (text(channel, "title"), text(channel, "language").lower()[:16], list(seen), text(channel, f"{ITUNES}author"), picture(channel) or text(channel, "image/url"), text(channel, "link"), text(channel, f"{ITUNES}explicit"))
    out = []
    for i, item in enumerate(channel.findall("item")):
        enclosure = item.find("enclosure")
        url = (enclosure.get("url") or "").strip() if enclosure is not None else ""
        description = text(item, "description") or text(item, f"{ITUNES}summary")
        told = [{k: (t.get(k) or "").strip() for k in ("url", "type", "language")} for t in item.findall(f"{PODCAST}transcript")]
        told = [t for t in told if t["url"]]
        out.append((*head, i, text(item, "guid"), text(item, "title"), description, url, text(item, "pubDate"), text(item, f"{ITUNES}duration"), text(item, f"{ITUNES}explicit"), picture(item), text(item, "link"), told))
    return out


def parse_feeds(df: DataFrame, key: str, xml: str) -> DataFrame:
    """One row per item of the RSS documents in ``xml``."""
    kind = df.schema[key].dataType.simpleString()
    names = [f.split(" ")[0] for f in FEED_SCHEMA.split(", ") if " " in f]

    def run(batches):
        for pdf in batches:
            rows = [(k, *r) for k, x in zip(pdf[key], pdf[xml], strict=True) for r in feed_items(x)]
            yield pd.DataFrame(rows, columns=[key, *names])

    return df.select(key, xml).mapInPandas(run, f"{key} {kind}, {FEED_SCHEMA}")


def transcript_format(mime, url):
    """Column: text, srt, vtt or json by type, then by suffix before '?' or '#'; '' where neither is known."""
    kind = F.trim(F.split(F.lower(F.coalesce(mime, F.lit(""))), ";")[0])
    tail = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"\.([A-Za-z]+)(?:[?#].*)?$", 1))
    by_type = F.when(kind == "text/plain", "text").when(kind.isin("application/srt", "text/srt", "application/x-subrip"), "srt").when(kind == "text/vtt", "vtt").when(kind == "application/json", "json")
    by_tail = F.when(tail == "txt", "text").when(tail.isin("srt", "vtt", "json"), tail)
    return F.coalesce(by_type, by_tail, F.lit(""))


def transcript_text(content, kind):
    """Column: speech of a transcript file by its format, blanks collapsed, tags and cue lines removed."""
    c = F.regexp_replace(F.regexp_replace(F.coalesce(content, F.lit("")), "^﻿", ""), "\r\n?", "\n")
    cues = F.regexp_replace(c, r"(?m)^(WEBVTT.*|NOTE.*|STYLE.*|REGION.*|\d+|.*-->.*)$", " ")
    bodies = F.array_join(F.transform(F.from_json(c, "segments array<struct<body:string>>")["segments"], lambda s: s["body"]), " ")
    raw = F.when(kind == "json", F.coalesce(bodies, F.lit(""))).when(kind == "vtt", F.regexp_replace(cues, "<[^>]*>", "")).when(kind == "srt", cues).otherwise(c)
    return F.trim(F.regexp_replace(raw, r"\s+", " "))


def write_dataset(df: DataFrame, folder: str, name: str, version: str, at: str = "event_time") -> dict:
    """Write the splits of a dataset and then its manifest; the same content again is no error, another one is.

    ``df`` has a ``split`` column. The manifest comes last, so a folder without one is unfinished.
    """
    if not re.fullmatch(r"[0-9][0-9A-Za-z.\-]*", version):
        raise ValueError(f"bad version: {version}")
    spark, path = df.sparkSession, f"{folder}/{name}-{version}"
    stats = df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.min(at).cast("string").alias("first"), F.max(at).cast("string").alias("last"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).cast("string").alias("content"))
    manifest = {"name": name, "version": version, "splits": {r["split"]: r.asDict() for r in stats.orderBy("split").collect()}}  # a row per split
    text = json.dumps(manifest, sort_keys=True)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if target.getFileSystem(conf).exists(target):
        old = "".join(r.value for r in spark.read.text(f"{path}/manifest").collect())
        if old != text:
            raise ValueError(f"{path} already holds other content")
        return manifest
    for split in manifest["splits"]:
        df.filter(F.col("split") == split).drop("split").write.mode("overwrite").parquet(f"{path}/{split}.parquet")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


def write_snapshot(spark: SparkSession, tables: dict[str, tuple[DataFrame, str]], folder: str) -> str:
    """Write tables (name -> rows and key) in the order of their keys to a folder named by their content, then point ``latest`` at it; its name.

    The name is 12 digits of the digest of the tables' canonical digests, so the same content is the same folder and is
    written once. ``latest`` is a file that is replaced by a rename after everything else is there.
    """
    from audiolake.operators.datasets import canonical_digest

    digests = {name: canonical_digest(df, key, df.columns).first().asDict() for name, (df, key) in sorted(tables.items())}
    name = manifest_id(digests)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(folder).getFileSystem(conf)
    if not fs.exists(path(f"{folder}/{name}/manifest")):
        for table, (df, key) in tables.items():
            df.orderBy(key).write.mode("overwrite").parquet(f"{folder}/{name}/{table}.parquet")
        spark.createDataFrame([(json.dumps(digests, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}/manifest")
    out = fs.create(path(f"{folder}/latest.new"), True)
    out.write(bytearray(name.encode()))
    out.close()
    fs.delete(path(f"{folder}/latest"), False)
    fs.rename(path(f"{folder}/latest.new"), path(f"{folder}/latest"))
    return name


def latest(spark: SparkSession, folder: str) -> str:
    """The folder that ``latest`` points at."""
    return f"{folder}/{spark.read.text(f'{folder}/latest').first().value}"


def manifest_id(manifest: dict) -> str:
    """Twelve digits of the digest of a manifest."""
    return hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest()[:12]
