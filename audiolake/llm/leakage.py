"""Evaluation texts leaking into training text: a stored positional inverted index with offset-adjusted lists.

The index is built once per call and written to the shared folder: rows (term, segment, postings) with the packed
postings (doc_id, position) of a term in one segment, a batch of documents, so that a frequent term is
many rows. Only terms that occur in evaluation items can be looked up, so only their postings are kept. For each
window of ``run`` words of an item the rarest term of the corpus is its anchor; a phrase of ``run`` words shared with a
document must contain an anchor at the same offset. Only the lists of anchors and of their next rarest terms are
unpacked. The postings of an anchor, shifted by its position in the item, give (item, doc, offset); two anchors of one
window must agree, and the remaining terms of each offset are intersected in the documents' own token
arrays, which yields the exact length of the longest run; only documents that met are read for that. Edited copies
(``proximity``) are found by so many of an item's rarest words that a copy cannot lack them all.

Defined results: NULL and empty texts match nothing; repeated documents are each reported; several equal runs
are one row; documents and items with NULL id are left out; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from audiolake.session import store


#: Documents of a segment of the index.
SEGMENT = 10_000


def tokens(text: Column) -> Column:
    """Array of the runs of letters or digits, in lower case."""
    return F.transform(F.filter(F.split(text, r"[^\p{L}\p{Nd}\p{Nl}\p{No}]+"), lambda w: w != ""), F.lower)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, position) of every word."""
    return docs.select(key, F.posexplode(tokens(F.col(text))).alias("position", "term"))


def index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, n, held, segment, docs, each, at), stored: the packed postings of the vocabulary's terms.

    ``n`` postings in ``held`` documents of one segment; ``docs`` are 64-bit ids, ``each`` the postings of each as 32-bit
    numbers, ``at`` their 32-bit positions. Tasks pack before the shuffle, which then moves a few bytes for each posting.
    """

    def pack(batches):
        for batch in (whole.slice(at, SEGMENT) for whole in batches for at in range(0, whole.num_rows, SEGMENT)):
            ids = batch.column("doc_id").to_numpy()
            lists = pc.split_pattern_regex(batch.column("text"), r"[^\p{L}\p{N}]+")
            coded = lists.flatten().dictionary_encode()
            doc = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
            names, codes = coded.dictionary, coded.indices.to_numpy()
            lower = pc.utf8_lower(names).dictionary_encode()
            empty = pc.equal(lower.dictionary, "").to_numpy(zero_copy_only=False)
            codes = lower.indices.to_numpy()[codes] if len(codes) else np.empty(0, np.int32)
            real = ~empty[codes] if len(codes) else np.empty(0, bool)
            doc, codes = doc[real], codes[real]
            if not len(codes):
                continue
            begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            at = np.arange(len(doc)) - np.repeat(begin, np.diff(np.r_[begin, len(doc)]))
            order = np.argsort(codes, kind="stable")  # documents and positions stay in order
            codes, doc, at = codes[order], doc[order], at[order].astype(np.int32)
            new = np.r_[True, (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])]
            first = np.flatnonzero(new)
            each = np.diff(np.r_[first, len(codes)]).astype(np.int32)
            term = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            list_ends = np.r_[term, len(codes)]
            doc_ends = np.searchsorted(first, list_ends)
            segment = int(ids[0])
            binary = lambda values, ends: pa.array([values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            columns = [lower.dictionary.take(pa.array(codes[term])), pa.array(np.diff(list_ends)), pa.array(np.diff(doc_ends)), pa.array(np.full(len(term), segment)), binary(ids[doc[first]].astype(np.int64), doc_ends), binary(each, doc_ends), binary(at, list_ends)]
            yield pa.RecordBatch.from_arrays(columns, ["term", "n", "held", "segment", "docs", "each", "at"])

    rows = docs.filter(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = rows.mapInArrow(pack, "term string, n long, held long, segment long, docs binary, each binary, at binary")
    return store(packed.join(vocabulary, "term", "left_semi"), "index")


def lists(stored: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """(term, doc_id, position, columns…): the postings of the wanted terms, one row for each with each wanted row.

    ``wanted``: term and ``columns``. The rows of a term that are sent to one task are those of one segment.
    """
    met = stored.select("term", "segment", "docs", "each", "at").join(wanted, "term")
    met = met.repartition("term", "segment")
    kinds = {f.name: f.dataType.simpleString() for f in wanted.schema.fields}

    def unpack(batches):
        for batch in batches:
            docs, each, at = (np.frombuffer(b"".join(batch.column(c).to_pylist()), t) for c, t in (("docs", np.int64), ("each", np.int32), ("at", np.int32)))
            n = pc.binary_length(batch.column("at")).to_numpy() // 4
            row = pa.array(np.repeat(np.arange(batch.num_rows), n))
            out = [batch.column("term").take(row), pa.array(np.repeat(docs, each)), pa.array(at), *[batch.column(c).take(row) for c in columns]]
            yield pa.RecordBatch.from_arrays(out, ["term", "doc_id", "position", *columns])

    schema = ", ".join(["term string, doc_id long, position int", *[f"`{c}` {kinds[c]}" for c in columns]])
    return met.mapInArrow(unpack, schema)


def anchors(items: DataFrame, frequency: DataFrame, run: int) -> DataFrame:
    """(term, item_id, position, second, gap): rarest term of each window, with the next rarest and its distance.

    Terms that no training text has make their windows impossible; such windows have no anchor.
    """
    words = postings(items, "item_id", "text").join(frequency, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    window = Window.partitionBy("item_id").orderBy("position").rowsBetween(0, run - 1)
    entry = F.struct("n", "term", "position")
    full = words.withColumn("w", F.sort_array(F.collect_list(entry).over(window))).filter(F.size("w") == run).filter(F.col("w")[0]["n"] > 0)
    return full.select(
        F.col("w")[0]["term"].alias("term"),
        "item_id",
        F.col("w")[0]["position"].alias("position"),
        F.col("w")[1]["term"].alias("second"),
        (F.col("w")[1]["position"] - F.col("w")[0]["position"]).alias("gap"),
    ).distinct()


def leaks(items: DataFrame, docs: DataFrame, run: int = 12) -> DataFrame:
    """(item_id, doc_id, longest): documents that share at least ``run`` words in a row with an item.

    ``items``: item_id, text. ``docs``: doc_id, text.
    """
    items, docs = items.filter(F.col("item_id").isNotNull()).select("item_id", "text"), docs.select("doc_id", "text")
    stored = index(docs, postings(items, "item_id", "text").select("term").distinct())
    frequency = stored.groupBy("term").agg(F.sum("n").alias("n"))
    anchor = store(anchors(items, frequency, run), "anchors")
    first = lists(stored, anchor.withColumnRenamed("position", "place"), ["item_id", "place", "second", "gap"])
    first = first.select("item_id", "doc_id", (F.col("position") - F.col("place")).alias("offset"), "second", (F.col("position") + F.col("gap")).alias("place"))
    after = lists(stored, anchor.select(F.col("second").alias("term")).distinct(), []).select(F.col("term").alias("second"), "doc_id", F.col("position").alias("place"))
    met = store(first.join(after, ["second", "doc_id", "place"], "left_semi").select("item_id", "doc_id", "offset").distinct(), "met")
    item_words = items.select("item_id", tokens(F.col("text")).alias("iw"))
    doc_words = docs.join(met.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", tokens(F.col("text")).alias("dw"))
    aligned = met.join(item_words, "item_id").join(doc_words, "doc_id")
    start = F.greatest(F.lit(0), -F.col("offset"))
    length = F.least(F.size("iw") - start, F.size("dw") - F.col("offset") - start)
    same = F.zip_with(F.slice("iw", start + 1, length), F.slice("dw", start + F.col("offset") + 1, length), lambda a, b: a == b)
    state = F.aggregate(
        same,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")),
        lambda s, e: F.struct(F.when(e, s["now"] + 1).otherwise(0).alias("now"), F.greatest(s["best"], F.when(e, s["now"] + 1).otherwise(0)).alias("best")),
    )
    return aligned.select("item_id", "doc_id", state["best"].alias("longest")).filter(F.col("longest") >= run).groupBy("item_id", "doc_id").agg(F.max("longest").alias("longest"))


def entry_words(items: DataFrame, frequency: DataFrame, least_share: float) -> DataFrame:
    """(term, item_id): of each item's distinct words the rarest, one more than a matching span may lack.

    A span with ``least_share`` of the words lacks too few to hold none of these. Words that no training text has count as
    lacking: they take a place and find nothing.
    """
    words = postings(items, "item_id", "text").select("item_id", "term").distinct().join(frequency, "term", "left")
    allowed = F.floor(F.count(F.lit(1)).over(Window.partitionBy("item_id")) * (1 - least_share) + 1e-9)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.coalesce("n", F.lit(0)), "term"))
    return words.select("term", "item_id", "n", place.alias("place"), allowed.alias("allowed")).filter((F.col("place") <= F.col("allowed") + 1) & F.col("n").isNotNull()).select("term", "item_id")


def _most_in_span(item: list[str], doc: list[str], slack: int) -> int:
    """Most distinct words of ``item`` in a span of ``doc`` that an occurrence of one of them opens."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(item))}
    at = np.array([p for p, w in enumerate(doc) if w in ids], np.int64)
    if not len(at):
        return 0
    word = np.array([ids[doc[p]] for p in at])
    length = len(item) + 2 * slack
    # the span that starts at s holds the word at p as its first of that word if s is after the one before and reaches p
    order = np.lexsort((at, word))
    p, w = at[order], word[order]
    before = np.where(np.r_[False, w[1:] == w[:-1]], np.r_[0, p[:-1]], -length - len(doc))
    change = np.zeros(len(doc) + length + 1, np.int64)  # starts from -length on
    np.add.at(change, np.maximum(before, p - length) + 1 + length, 1)
    np.add.at(change, p + 1 + length, -1)
    held = np.cumsum(change)
    places: dict[int, list[int]] = {}
    for k, t in enumerate(item):
        places.setdefault(ids[t], []).append(k)
    starts = np.concatenate([(p[w == i][:, None] - np.array(k)[None, :]).ravel() for i, k in places.items()]) - slack
    return int(held[starts + length].max())


def proximity(items: DataFrame, docs: DataFrame, least_share: float = 0.8, slack: int = 8) -> DataFrame:
    """(item_id, doc_id, matched, share): documents with most of an item's distinct words close together.

    Each occurrence of an item's word opens a span of the item's length plus ``slack`` words on both sides of the aligned
    place; ``share`` is the part of the item's distinct words found in it. Catches copies with edits inside. Documents
    are found by the item's rarest words and verified if they hold enough of its words at all.
    """
    items, docs = items.select("item_id", "text").distinct(), docs.select("doc_id", "text").distinct()
    stored = index(docs, postings(items, "item_id", "text").select("term").distinct())
    frequency = stored.groupBy("term").agg(F.sum("held").alias("n"))
    entries = store(entry_words(items, frequency, least_share), "entries")
    met = store(lists(stored, entries, ["item_id"]).select("item_id", "doc_id").distinct(), "met")
    item_words = items.select("item_id", tokens(F.col("text")).alias("iw"))
    doc_words = docs.join(met.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", tokens(F.col("text")).alias("dw"))
    aligned = met.join(item_words, "item_id").join(doc_words, "doc_id")
    of = F.size(F.array_distinct("iw"))
    aligned = aligned.select("item_id", "doc_id", "iw", "dw", of.alias("of"), F.size(F.array_intersect("iw", "dw")).alias("anywhere")).filter(F.col("anywhere") >= F.col("of") * least_share - 1e-9)

    def most(iw: pd.Series, dw: pd.Series) -> pd.Series:
        return pd.Series([_most_in_span(list(a), list(b), slack) for a, b in zip(iw, dw, strict=True)], dtype="int32")

    scored = aligned.select("item_id", "doc_id", "of", F.pandas_udf(most, T.IntegerType())("iw", "dw").alias("matched"))
    best = scored.select("item_id", "doc_id", "matched", (F.col("matched") / F.col("of")).alias("share")).filter(F.col("share") >= least_share)
    return best.groupBy("item_id", "doc_id").agg(F.max_by("matched", "share").alias("matched"), F.max("share").alias("share"))
