"""Mixing sources to target weights by token counts.

Tokens are summed per source; the largest total is chosen for which every source reaches its share without
being repeated more often than its cap allows; a source's rate is its part of that total over its tokens. Each
document is emitted floor(rate) times, plus once more if the hash of (seed, mix, document) falls below the
fraction of the rate.

Defined results: source names are compared in lower case without outer blanks; documents with NULL or
blank source, NULL id or no tokens are not emitted; shares that are NULL, negative or not finite count as 0; a
source without tokens or with a cap below 1 cannot be used and the shares of the others are scaled to sum to
1; repeated rows of one (mix, source) add their shares and use the largest cap; repeated documents are
documents of their own; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from audiolake.session import store

#: Vocabulary file of the public tokenizer; the setting spark.audiolake.vocabulary of a session names another.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_ENCODINGS: dict = {}


def _encoding(path: str):
    """The byte-level BPE whose ranks the file holds; loaded once per worker."""
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def _pieces(text: str, most: int = 20_000):
    """A long text cut before blanks that follow other characters, where no token reaches across."""
    at = 0
    while len(text) - at > most:
        cut = at + most
        while cut < len(text) and not (text[cut] == " " and not text[cut - 1].isspace()):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def count_tokens(df: DataFrame, text: str, out: str = "tokens", path: str | None = None) -> DataFrame:
    """Add ``out``, the number of tokens of ``text``; 0 for NULL. ``path``: vocabulary, by default the session's."""
    path = path or df.sparkSession.conf.get("spark.audiolake.vocabulary", VOCABULARY)

    def count(column: pd.Series) -> pd.Series:
        encoding = _encoding(path)
        return pd.Series([sum(len(encoding.encode_ordinary(p)) for p in _pieces(t)) if t else 0 for t in column], dtype="int64")

    return df.withColumn(out, F.pandas_udf(count, T.LongType())(F.col(text)))


def sized(docs: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, source, tokens), stored, so that the text is tokenised once."""
    rows = docs.select(key, F.lower(F.trim("source")).alias("source"), "text").filter(F.col(key).isNotNull() & (F.col("source") != "") & (F.length("text") > 0))
    return store(count_tokens(rows, "text", path=path).select(key, "source", "tokens").filter(F.col("tokens") > 0), "sizes")


def rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, documents, tokens, rate) of every source that a mix names."""
    share = F.when(F.col("target_share") > 0, F.nanvl("target_share", F.lit(0.0))).otherwise(0.0)
    share = F.when(F.abs(share) < float("inf"), share).otherwise(0.0)
    wanted = targets.groupBy("mix_name", F.lower(F.trim("source")).alias("source")).agg(F.sum(share).alias("share"), F.max("max_repeats").alias("cap"))
    have = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))
    joined = wanted.join(have, "source", "left").na.fill(0, ["documents", "tokens", "cap"])
    mix = Window.partitionBy("mix_name")
    usable = (F.col("tokens") > 0) & (F.col("cap") >= 1) & (F.col("share") > 0)
    part = F.when(usable, F.try_divide("share", F.sum(F.when(usable, F.col("share"))).over(mix))).otherwise(0.0)
    joined = joined.withColumn("part", part)
    total = F.min(F.when(usable, F.col("cap") * F.col("tokens") / F.col("part"))).over(mix)
    rate = F.when(usable, F.least(F.col("cap").cast("double"), total * F.col("part") / F.col("tokens"))).otherwise(0.0)
    return joined.select("mix_name", "source", F.col("share").alias("target_share"), "documents", "tokens", rate.alias("rate"))


def emit(sizes: DataFrame, plan: DataFrame, key: str = "doc_id", seed: int = 17) -> DataFrame:
    """(mix_name, source, key, tokens, copies): documents with at least one copy in a mix."""
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col("mix_name"), F.col(key)), F.lit(1 << 40)) / float(1 << 40)
    copies = (F.floor("rate") + (unit < F.col("rate") - F.floor("rate")).cast("long")).cast("int")
    return sizes.join(plan.select("mix_name", "source", "rate"), "source").select("mix_name", "source", key, "tokens", copies.alias("copies")).filter(F.col("copies") > 0)


def report(sizes: DataFrame, plan: DataFrame, key: str = "doc_id", seed: int = 17) -> DataFrame:
    """The plan with the documents and tokens emitted and the share reached."""
    done = emit(sizes, plan, key, seed).groupBy("mix_name", "source").agg(F.sum("copies").alias("emitted_documents"), F.sum(F.col("copies") * F.col("tokens")).alias("emitted_tokens"))
    rows = plan.join(done, ["mix_name", "source"], "left").na.fill(0, ["emitted_documents", "emitted_tokens"])
    reached = F.coalesce(F.try_divide(F.col("emitted_tokens"), F.sum("emitted_tokens").over(Window.partitionBy("mix_name"))), F.lit(0.0))
    return rows.withColumn("actual_share", reached)


def mixed(sizes: DataFrame, plan: DataFrame, key: str = "doc_id", seed: int = 17) -> DataFrame:
    """(mix_name, key, copy): one row per emitted record, copies numbered from 1."""
    return emit(sizes, plan, key, seed).select("mix_name", key, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
