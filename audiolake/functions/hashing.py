"""Stable hashes: content, order, query ids, shards. All are built-in digests, equal on every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int, kind: str, value: Column) -> Column:
    """Hex digest by which rows are put in a seeded, reproducible order."""
    return F.sha2(F.concat(F.lit(f"{seed}:{kind}:"), value.cast("string")), 256)


def query_id(kind: Column, text: Column) -> Column:
    """'q' and eight digits of the digest of type and text."""
    return F.concat(F.lit("q"), F.substring(F.sha2(F.concat(kind, F.lit(":"), text), 256), 1, 8))


def content_hash(*fields: Column) -> Column:
    """Digest of fields, each closed by a NUL; NULL reads as empty."""
    parts = [x for f in fields for x in (F.coalesce(f.cast("string"), F.lit("")), F.char(F.lit(0)))]
    return F.sha2(F.concat(*parts), 256)


def rfc3339(at: Column) -> Column:
    """UTC text of an instant to the second, ``Z`` at the end; '' for NULL."""
    return F.coalesce(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def item_hash(title: Column, description: Column, seconds: Column, published: Column, explicit: Column, url: Column) -> Column:
    """Digest of an item's searchable fields, in this order."""
    yes = F.when(F.coalesce(explicit, F.lit(False)), "true").otherwise("false")
    return content_hash(title, description, seconds.cast("bigint"), rfc3339(published), yes, url)


def excerpt_hash(text: Column, n: int) -> Column:
    """First 32 digits of the digest of the first ``n`` characters."""
    return F.substring(F.sha2(F.left(F.coalesce(text, F.lit("")), F.lit(n)), 256), 1, 32)


def shard(text: Column, n: int) -> Column:
    """Remainder of the whole 256-bit digest by ``n``, folded four hex digits at a time."""
    digits = F.sha2(text, 256)
    step = lambda acc, i: (acc * 65536 + F.conv(F.substring(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint")) % n
    return F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(0).cast("bigint"), step)


def low_word(text: Column) -> Column:
    """First four digest bytes, little-endian."""
    h = F.sha2(text, 256)
    return F.conv(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("bigint")
