"""Speech metrics: word edit operations, word and character error rates, entity outcomes."""

from __future__ import annotations

import itertools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCHEMA = T.StructType().add("substitutions", T.IntegerType()).add("deletions", T.IntegerType()).add("insertions", T.IntegerType()).add("reference_words", T.IntegerType()).add("wer", T.DoubleType())


def spoken(text: str | None) -> list[str]:
    """Words of letters a to z and digits, accents removed, in lower case; everything else separates."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))
    return re.findall("[a-z0-9]+", plain.lower())


def edit_operations(reference: list[str], heard: list[str]) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) of a cheapest alignment; of equally cheap ones that with fewer substitutions, then deletions.

    A table of distances first; then the alignments that reach the least cost are walked backwards, each cell once, keeping
    the smallest triple of what follows it.
    """
    n, m = len(reference), len(heard)
    cost = [[max(i, j) if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i, j in itertools.product(range(1, n + 1), range(1, m + 1)):
        cost[i][j] = min(cost[i - 1][j - 1] + (reference[i - 1] != heard[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    best: dict[tuple[int, int], tuple[int, int, int]] = {(n, m): (0, 0, 0)}
    for i in range(n, -1, -1):
        for j in range(m, -1, -1):
            if (i, j) not in best:
                continue
            s, d, k = best[i, j]
            steps = []
            if i and j:
                wrong = int(reference[i - 1] != heard[j - 1])
                steps.append((i - 1, j - 1, wrong, (s + wrong, d, k)))
            steps += [(i - 1, j, 1, (s, d + 1, k))] * (i > 0) + [(i, j - 1, 1, (s, d, k + 1))] * (j > 0)
            for a, b, price, triple in steps:
                if cost[a][b] + price == cost[i][j]:
                    best[a, b] = min(best.get((a, b), triple), triple)
    return best[0, 0]


def word_errors(reference: Column, heard: Column) -> Column:
    """Struct of edit operations and the word error rate (of an empty reference: 0, or 1 if anything was heard)."""

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b, strict=True):
            r, h = spoken(x), spoken(y)
            s, d, n = edit_operations(r, h)
            rows.append((s, d, n, len(r), (s + d + n) / len(r) if r else float(bool(h))))
        return pd.DataFrame(rows, columns=[f.name for f in _SCHEMA])

    return F.pandas_udf(run, _SCHEMA)(reference, heard)


@F.pandas_udf(T.StringType())
def _plain(text: pd.Series) -> pd.Series:
    return text.map(lambda t: " ".join(spoken(t)))


def plain(text: Column) -> Column:
    """The normalised words of a text, joined by blanks; '' for NULL."""
    return _plain(F.coalesce(text, F.lit("")))


def character_error_rate(reference: Column, heard: Column) -> Column:
    """Levenshtein distance of the normalised texts over the reference's length; of an empty reference 0, or 1 if anything was heard."""
    a, b = plain(reference), plain(heard)
    return F.when(F.length(a) > 0, F.levenshtein(a, b) / F.length(a)).otherwise((F.length(b) > 0).cast("double"))


def entity_match(entity: Column, heard: Column) -> Column:
    """Struct (found, closest, cer): whether the words of an entity were heard in a row, else the run of as many words that is nearest by character errors, the first of equal ones. Both are columns of :func:`plain`."""
    e, h = F.split(entity, " "), F.split(heard, " ")
    target = F.array_join(e, " ")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(h) - F.size(e) + 1)), lambda i: F.array_join(F.slice(h, i, F.size(e)), " "))
    rate = lambda s: F.when(F.length(target) > 0, F.levenshtein(target, s) / F.length(target)).otherwise((F.length(s) > 0).cast("double"))
    best = F.array_min(F.transform(runs, lambda s, i: F.struct(rate(s).alias("cer"), i.alias("i"), s.alias("closest"))))
    return F.struct(F.array_contains(runs, target).alias("found"), best["closest"].alias("closest"), best["cer"].alias("cer"))


def entity_outcome(matches: Column, limit: float = 0.34) -> Column:
    """found if all of an array of matches are, near miss if the others are within the limit, else missed."""
    return F.when(F.forall(matches, lambda m: m["found"]), "found").when(F.forall(matches, lambda m: m["found"] | (m["cer"] <= limit)), "near miss").otherwise("missed")


def value_bin(value: Column, edges: tuple[float, ...]) -> Column:
    """Label of a value: ``0``, intervals open below and closed above, and the rest."""
    label = F.when(value == 0, "0")
    low = "0"
    for edge in edges:
        label = label.when(value <= edge, f"({low}, {edge:g}]")
        low = f"{edge:g}"
    return label.otherwise(f"> {low}")


def degradation(rows: DataFrame, groups: dict[str, Column], metric: str) -> DataFrame:
    """(grouping, value, clips, wer, wer_zero_share, entity_error_rate, reference, heard, degradation): means by each grouping.

    ``rows``: wer, entity_error (NULL without entities), and the metric for the stated and the heard text as ``reference_m``
    and ``heard_m``. Means ignore NULL and are rounded to 4 places.
    """
    kinds = F.array(*[F.struct(F.lit(n).alias("grouping"), c.cast("string").alias("value")) for n, c in groups.items()])
    mean = lambda c: F.round(F.avg(c), 4)
    long = rows.select("*", F.explode(kinds).alias("k"))
    a, b = F.col(f"reference_{metric}"), F.col(f"heard_{metric}")
    return long.groupBy("k.grouping", "k.value").agg(F.count(F.lit(1)).alias("clips"), mean("wer").alias("wer"), mean((F.col("wer") == 0).cast("double")).alias("wer_zero_share"), mean("entity_error").alias("entity_error_rate"), mean(a).alias("reference"), mean(b).alias("heard"), mean(a - b).alias("degradation"))
