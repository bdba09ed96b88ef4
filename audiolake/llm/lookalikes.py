"""Visually identical text with different characters: one consistent form of every text.

Steps: compatibility decomposition, deletion of ignorable characters, blanks of any width to one blank,
then for every token that holds a letter with look-alikes the best path through its lattice of look-alike
letters: Viterbi under character bigram scores of one script at a time, with a price for changing the
script inside a token. The scores are counted, case-folded, over the tokens of all texts that are certain to be
of one script: Latin ones, and others with at least one letter that has no look-alike. The result is composed again. Letter case, accents and line breaks are kept.

Defined results: NULL stays NULL; empty text stays empty and is no partner of anything; repeated texts
get the same form; empty tables give empty results; other columns are kept (``form``) or ignored (``pairs``).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from audiolake.session import store

# Letters that look like the Latin letter on the left, from the public confusables of Unicode (UTS 39):
# Cyrillic, Greek, Armenian, Latin extensions; of the capitals also Coptic, Cherokee and Lisu. Digits are not letters here.
LOOKALIKES = {
    "a": "аαɑ", "c": "сϲⲥ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һհ", "i": "іιı", "j": "јϳ", "k": "κ", "l": "ӏ", "n": "ո",
    "o": "оοօⲟ", "p": "рρⲣ", "q": "ԛզ", "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝ", "x": "хχ", "y": "уγ",
    "A": "АΑᎪꓮ", "B": "ВΒⲂᏴꓐ", "C": "СϹⲤᏟꓚ", "D": "Ꭰꓓ", "E": "ЕΕⲈᎬꓰ", "F": "Ϝꓝ", "G": "ᏀꓖԌ", "H": "НΗⲎᎻꓧ", "I": "ІΙӀⲒꓲ", "J": "ЈᎫꓙ",
    "K": "КΚⲔᏦꓗ", "L": "ᏞꓡⳐ", "M": "МΜϺⲘᎷꓟ", "N": "ΝⲚꓠ", "O": "ОΟՕⲞꓳ", "P": "РΡⲢᏢꓑ", "R": "ᎡꓣᏒ", "S": "ЅՏᏚꓢ", "T": "ТΤⲦᎢꓔ", "U": "Սꓴ",
    "V": "ᏙꓦѴ", "W": "ᎳꓪԜ", "X": "ХΧⲬꓫ", "Y": "УΥҮⲨꓬ", "Z": "ΖᏃꓜ", "-": "‐‑−",
}
#: Log price of a change of script between two letters of a token.
SCRIPT_CHANGE = -12.0

_CLASSES: dict[str, set[str]] = defaultdict(set)
for _plain, _others in LOOKALIKES.items():
    _CLASSES[_plain] |= {_plain, *_others}
OPTIONS = {c: sorted(group) for group in _CLASSES.values() for c in group}
_PLAIN_TEXT = re.compile("[\n -~¡-§©«®°±¶»¿-ž–—‘-„★]*")
_LETTERS = re.compile(r"[^\W\d_]+")
_BREAKS = re.compile("\r\n|[\r\u0085  ]")


def script(c: str) -> str:
    """Script of a letter by its Unicode name; look-alike rules treat other characters as common."""
    if c.isascii():
        return "LATIN" if c.isalpha() else "COMMON"
    return unicodedata.name(c, "COMMON").split(" ")[0] if c.isalpha() else "COMMON"


def _ignorable(c: str) -> bool:
    return unicodedata.category(c) == "Cf" or c in "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0" or "\ufe00" <= c <= "\ufe0f" or "\U000e0000" <= c <= "\U000e0fff"


_POINTS = [chr(i) for i in (*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000)) if not 0xD800 <= i < 0xE000]
_IGNORED = re.compile("[" + "".join(c for c in _POINTS if _ignorable(c)) + "]")
_BLANK = re.compile("[" + "".join(c for c in _POINTS if unicodedata.category(c) == "Zs") + "]")


def decompose(text: str) -> str:
    """Compatibility decomposition without ignorable characters, with one kind of blank and line break."""
    text = unicodedata.normalize("NFKD", _BREAKS.sub("\n", text).replace("\t", " "))
    if text.isascii():
        return text
    if max(text) > "\uffff":  # beyond the tables of the two patterns
        text = "".join(c for c in text if c <= "\uffff" or not _ignorable(c))
    return _BLANK.sub(" ", _IGNORED.sub("", text))


class Scores:
    """Bigram log probabilities of characters by script, from counts of (previous, character); '' is the margin."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        scripts = {c: script(c) for pair in counts for c in pair if c}
        totals: Counter = Counter()
        self.before: Counter = Counter()
        letters = defaultdict(set)
        for (a, b), n in counts.items():
            s = scripts.get(b) or scripts.get(a)
            totals[s] += n
            self.before[(s, a)] += n
            letters[s].add(b)
        every = sum(totals.values()) or 1
        self.size = {s: len(x) + 1 for s, x in letters.items()}
        self.counts = counts
        self.prior = {s: math.log((n + 0.5) / (every + 1)) for s, n in totals.items()}
        self.unseen = math.log(0.5 / (every + 1))

    def step(self, s: str, a: str, b: str) -> float:
        a, b = a.lower(), b.lower()
        return math.log((self.counts.get((a, b), 0) + 0.1) / (self.before.get((s, a), 0) + 0.1 * self.size.get(s, 60)))


def best_path(token: str, scores: Scores) -> str:
    """The likeliest reading of a token's look-alike lattice; characters without look-alikes are fixed."""
    layers = [OPTIONS.get(c, [c]) for c in token]
    paths: dict[str, tuple[float, str, str]] = {}  # last character -> (score, text, script so far)
    for layer in layers:
        new: dict[str, tuple[float, str, str]] = {}
        for c in layer:
            s = script(c)
            if s == "COMMON":
                options = [(v, t + c, k) for v, t, k in paths.values()] or [(0.0, c, "")]
            elif not paths:
                options = [(scores.prior.get(s, scores.unseen) + scores.step(s, "", c), c, s)]
            else:
                options = []
                for last, (v, t, k) in paths.items():
                    changed = SCRIPT_CHANGE + scores.prior.get(s, scores.unseen) if k not in ("", s) else scores.prior.get(s, scores.unseen) if k == "" else 0.0
                    options.append((v + changed + scores.step(s, last if k == s and last.isalpha() else "", c), t + c, s))
            new[c] = max(options, key=lambda o: (o[0], [-ord(x) for x in o[1]]))
        paths = new
    end = [(v + (scores.step(k, last, "") if k and last.isalpha() else 0.0), t) for last, (v, t, k) in paths.items()]
    return max(end, key=lambda o: (o[0], [-ord(x) for x in o[1]]))[1]


_TOKEN = re.compile(r"[^\s̀-ͯ]+(?:[̀-ͯ]+[^\s̀-ͯ]*)*")
_MARKS = re.compile("[̀-ͯ]+")


def one_form(text: str | None, scores: Scores, known: dict[str, str]) -> str | None:
    """The consistent form of a text; ``known`` caches tokens."""
    if text is None or _PLAIN_TEXT.fullmatch(text):
        return text

    def token(found: re.Match) -> str:
        t = found.group()
        if t.isascii():
            return t
        out = known.get(t)
        if out is None:
            bare = _MARKS.sub("", t)
            read = iter(best_path(bare, scores)) if any(c in OPTIONS and not c.isascii() for c in bare) else iter(bare)
            out = "".join(c if _MARKS.fullmatch(c) else next(read) for c in t)
            if len(known) < 200_000:
                known[t] = out
        return out

    return unicodedata.normalize("NFC", _TOKEN.sub(token, decompose(text)))


def count_bigrams(df: DataFrame, text: str) -> dict[tuple[str, str], int]:
    """Character bigram counts of the one-script words of all texts.

    The result is bounded by the square of the letters of the table's scripts that look alike
    (Latin, Cyrillic, Greek, Armenian base letters), not by the data.
    """

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            words: Counter = Counter()
            for t in batch.column(0).to_pylist():
                if t:
                    words.update(_LETTERS.findall(t if t.isascii() else _MARKS.sub("", decompose(t))))
            for w, n in words.items():
                names = {"LATIN"} if w.isascii() else {script(c) for c in w}
                certain = names == {"LATIN"} or any(c not in OPTIONS for c in w)
                if len(names) == 1 and certain and names <= {"LATIN", "CYRILLIC", "GREEK", "ARMENIAN"}:
                    low = w.lower()
                    for a, b in zip(("", *low), (*low, ""), strict=True):
                        total[(a, b)] += n
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())], ["a", "b", "n"])

    rows = df.select(text).mapInArrow(count, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return {(r.a, r.b): r.n for r in rows.toLocalIterator()}


def form(df: DataFrame, text: str, out: str = "form") -> DataFrame:
    """Add ``out``, the one consistent form of ``text``."""
    scores = Scores(count_bigrams(df, text))
    known: dict[str, str] = {}

    def convert(column: pd.Series) -> pd.Series:
        return column.map(lambda t: one_form(t, scores, known), na_action="ignore")

    return df.withColumn(out, F.pandas_udf(convert, T.StringType())(F.col(text)))


def groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, group_id, variant_id, copies, links): one row per row whose text reads like a differently stored one.

    ``copies`` rows store the same characters, ``links`` rows of the group store others; nothing is spelt out in pairs.
    """
    rows = form(df.select(key, text).filter(F.length(text) > 0), text).select(key, F.xxhash64("form").alias("group_id"), F.xxhash64(text).alias("variant_id")).distinct()
    rows = store(rows, "forms")
    variants = rows.groupBy("group_id", "variant_id").agg(F.count(F.lit(1)).alias("copies"))
    whole = variants.groupBy("group_id").agg(F.sum("copies").alias("all"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    sized = variants.join(whole, "group_id").select("group_id", "variant_id", "copies", (F.col("all") - F.col("copies")).alias("links"))
    return rows.join(sized, ["group_id", "variant_id"]).select(key, "group_id", "variant_id", "copies", "links")


def pairs(df: DataFrame, key: str, text: str, expand: int = 16) -> DataFrame:
    """(a, b), a < b: rows whose texts read the same but are stored as different characters.

    Equal stored texts are one variant. Of each variant the first ``expand`` rows meet those of the group's other
    variants; its further copies meet the first row of every other variant, so that every copy and
    every two different texts are linked while a text that a third of all rows share stays linear.
    """
    rows = form(df.select(key, text).filter(F.length(text) > 0), text).select(key, F.sha2("form", 256).alias("g"), F.sha2(text, 256).alias("v"))
    rows = store(rows.distinct(), "forms")  # read twice below; the forms are computed once
    alike = rows.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).filter(F.col("lo") != F.col("hi")).select("g")
    ranked = rows.join(alike, "g", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("g", "v").orderBy(key)))
    few, more, first = ranked.filter(F.col("n") <= expand), ranked.filter(F.col("n") > expand), ranked.filter(F.col("n") == 1)
    side = lambda x, name: x.select("g", F.col("v").alias(f"v{name}"), F.col(key).alias(name))
    near = side(few, "a").join(side(few, "b"), "g").filter((F.col("va") != F.col("vb")) & (F.col("a") < F.col("b"))).select("a", "b")
    far = side(more, "a").join(side(first, "b"), "g").filter(F.col("va") != F.col("vb")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return near.unionByName(far).distinct()
