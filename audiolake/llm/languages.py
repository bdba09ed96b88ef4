"""Missing or wrong language labels: a language for every record and every passage, with a confidence.

The script of a word narrows its candidate languages; words score the candidates by log-likelihoods learnt
from a bounded sample of labelled records; Viterbi with a price for each switch labels the words;
a sentence has the language of most of its scored words, a record that of most of its words, and sentences in
a row that speak another language form a passage.

The model is fitted on at most ``sample`` labelled records (those with the smallest hash), twice: after the first
fit the sample's records are relabelled by their own scores, which removes wrong labels.

Defined results: NULL and empty texts and texts without a scored word have language NULL and confidence 0;
labels are compared as code, region code, three-letter code or name, and a label that names no language is
``named`` NULL; repeated rows give repeated rows; with no labelled record at all every language is NULL; other
columns are kept, but those with the names of new ones are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from audiolake.llm.lookalikes import LOOKALIKES, decompose

LANGUAGES = ("de", "en", "es", "fr", "pt")
# Codes and names of the languages.
NAMES = {
    "de": "de deu ger german deutsch allemand alemán alemão",
    "en": "en eng english englisch anglais inglés inglês",
    "es": "es spa spanish español spanisch espagnol espanhol castellano",
    "fr": "fr fra fre french français französisch francés francês",
    "pt": "pt por portuguese português portugiesisch portugais portugués",
}
# Ranges of the scripts, first and last letter, and the languages here that each can write. Words in
# a script that none of them writes say nothing.
SCRIPTS = {
    ("A", "ɏ"): LANGUAGES, ("Ḁ", "ỿ"): LANGUAGES, ("Ͱ", "Ͽ"): (), ("Ѐ", "ԯ"): (), ("԰", "֏"): (), ("֐", "ۿ"): (), ("ऀ", "෿"): (), ("฀", "໿"): (),
    ("Ⴀ", "ჿ"): (), ("ᄀ", "ᇿ"): (), ("Ⲁ", "⳿"): (), ("぀", "ヿ"): (), ("㐀", "鿿"): (), ("가", "힣"): (),
}
# Letters beyond a to z of the languages' alphabets. A word with such a letter can only be of a language that has it.
LETTERS = {"de": "äöüß", "en": "", "es": "áéíóúüñ", "fr": "àâæçéèêëîïôœùûüÿ", "pt": "áâãàçéêíóôõú"}
#: Log price of a change of language between two words: about the weight of two words that only one language uses (``MOST``), so
#: that a name or a loan word does not break a sentence while a sentence in another language does.
SWITCH = 9.0
#: Bound of a word's log-likelihood ratio, so that no single word decides a text.
MOST = 5.0

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”')\]]*\s+|\n+")
_FOLD = {ord(c): plain for plain, others in LOOKALIKES.items() for c in others}
_DISGUISED = re.compile("[^\x00-\x7f -ɏ‐-‧]|[­͏]")


def named(label: Column) -> Column:
    """The language that a label names, NULL if none."""
    pairs = [F.lit(x) for code, names in NAMES.items() for n in names.split() for x in (n, code)]
    text = F.trim(F.lower(label))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), text), F.try_element_at(F.create_map(*pairs), F.split(F.translate(text, "_", "-"), "-")[0]))


def plain(text: str) -> str:
    """Text with disguised letters read as Latin, so that they score like what they look like."""
    if text.isascii() or not _DISGUISED.search(text):
        return text
    return unicodedata.normalize("NFC", decompose(text).translate(_FOLD))


def candidates(word: str) -> tuple[str, ...]:
    """Languages that the script and the letters of a word allow; all of the script's where no alphabet has its letters."""
    if word.isascii():
        return LANGUAGES
    allowed = set(LANGUAGES)
    for c in word:
        if c.isalpha():
            allowed &= set(next((langs for (low, high), langs in SCRIPTS.items() if low <= c <= high), ()))
    odd = {c for c in word.lower() if c.isalpha() and not c.isascii()}
    own = {lang for lang in allowed if odd <= set(LETTERS[lang])}
    return tuple(lang for lang in LANGUAGES if lang in (own or allowed))


class Model:
    """Word log-likelihood ratios of the languages, each row centred on its mean and clipped."""

    def __init__(self, counts: list[Counter], least: int = 3):
        total = [sum(c.values()) for c in counts]
        words = sorted(w for w in set().union(*counts) if sum(c[w] for c in counts) >= least)
        self.index = {w: i + 1 for i, w in enumerate(words)}
        table = np.array([[c[w] for c in counts] for w in words], dtype=float).reshape(-1, len(LANGUAGES))
        rate = (table + 0.5) / (np.array(total, dtype=float) + 0.5 * max(1, len(words)))
        logs = np.log(rate)
        logs -= logs.mean(axis=1, keepdims=True)
        allowed = np.array([[lang in candidates(w) for lang in LANGUAGES] for w in words]).reshape(-1, len(LANGUAGES))
        known = np.array([t > 0 for t in total])
        logs = np.where(allowed & known, np.clip(logs, -MOST, MOST), -MOST)
        self.scores = np.vstack([np.zeros((1, len(LANGUAGES))), logs])  # row 0: words that say nothing

    def ids(self, words: list[str]) -> np.ndarray:
        get = self.index.get
        return np.fromiter((get(w, 0) for w in words), dtype=np.int32, count=len(words))


def fit(sample: list[tuple[str, str]]) -> Model | None:
    """A model of (text, language) pairs, refitted on the sample's own relabelling."""
    read = [(_WORD.findall(plain(t).lower()), LANGUAGES.index(lang)) for t, lang in sample if t and lang in LANGUAGES]
    if not read:
        return None
    labels = [lang for _, lang in read]
    for _ in range(3):
        counts = [Counter() for _ in LANGUAGES]
        for (w, _), lang in zip(read, labels, strict=True):
            counts[lang].update(w)
        model = Model(counts)
        labels = [int(model.scores[model.ids(w)].sum(axis=0).argmax()) for w, _ in read]
    return model


def viterbi(score: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of every word for padded (texts, words, languages) scores."""
    n, t, k = score.shape
    best, back = score[:, 0].copy(), np.zeros((n, t, k), np.int8)
    stay = np.arange(k, dtype=np.int8)
    for i in range(1, t):
        top = best.argmax(axis=1)
        other = best[np.arange(n), top] - switch
        change = other[:, None] > best
        back[:, i] = np.where(change, top[:, None].astype(np.int8), stay)
        new = np.maximum(best, other[:, None]) + score[:, i]
        best = np.where((i < lengths)[:, None], new, best)
    path = np.zeros((n, t), np.int8)
    state = best.argmax(axis=1)
    for i in range(t - 1, -1, -1):
        inside = i < lengths
        path[:, i] = state
        state = np.where(inside, back[np.arange(n), i, state], state)
    return path


def _read(text: str, model: Model):
    """(word ids, sentence number of each word, sentence count)."""
    ids, numbers, count = [], [], 0
    for sentence in _SENTENCE.split(plain(text)):
        words = _WORD.findall(sentence.lower())
        if words:
            ids.append(model.ids(words))
            numbers.append(np.full(len(words), count))
            count += 1
    return (np.concatenate(ids), np.concatenate(numbers), count) if ids else (np.empty(0, np.int32), np.empty(0, int), 0)


def _judge(ids, numbers, count, path, model: Model):
    """(language, confidence, passages) of one text from the languages of its words."""
    told = ids > 0
    if not told.any():
        return None, 0.0, []
    k = len(LANGUAGES)
    language = int(np.bincount(path, minlength=k).argmax())
    sums = model.scores[ids].sum(axis=0)
    by_sentence = np.zeros((count, k), int)
    np.add.at(by_sentence, (numbers, path), 1 + told)
    spoken = by_sentence.argmax(axis=1)
    own = path == language
    agree = model.scores[ids[own]].sum(axis=0)
    margin = agree[language] - np.delete(agree, language).max() if own.any() else 0.0
    confidence = float(own.mean() / (1 + np.exp(-np.clip(margin, -30, 30))))
    passages, at = [], 0
    while at < count:
        end = at
        while end < count and spoken[end] == spoken[at]:
            end += 1
        if spoken[at] != language:
            part = model.scores[ids[(numbers >= at) & (numbers < end)]].sum(axis=0)
            gap = part[spoken[at]] - np.delete(part, spoken[at]).max()
            passages.append({"language": LANGUAGES[spoken[at]], "first": at, "sentences": end - at, "confidence": float(1 / (1 + np.exp(-np.clip(gap, -30, 30))))})
        at = end
    return LANGUAGES[language], confidence, passages


def identify(df: DataFrame, text: str = "text", label: str = "label", key: str = "record_id", sample: int = 3000, longest: int = 20_000, seed: int = 5) -> DataFrame:
    """Add ``named``, ``language``, ``confidence`` and ``passages`` (language, first sentence, sentences, confidence).

    ``sample`` bounds the labelled records of at most ``longest`` characters that the classifier is fitted on;
    all records are classified, whatever their length.
    """
    df = df.withColumn("named", named(F.col(label)))
    df = df.drop(*({"language", "confidence", "passages"} - {text, key}))
    chosen = df.filter(F.col("named").isNotNull() & F.length(text).between(1, longest)).select(F.col(text).alias("t"), "named", F.xxhash64(F.lit(seed), F.col(key)).alias("h"))
    model = fit([(r.t, r.named) for r in chosen.orderBy("h", "t").limit(sample).toLocalIterator()])
    names = df.columns

    def run(batches):
        for pdf in batches:
            n = len(pdf)
            languages, sure, passages = [None] * n, [0.0] * n, [[] for _ in range(n)]
            if model is not None:
                read = [_read(t, model) if isinstance(t, str) and t else (np.empty(0, np.int32), np.empty(0, int), 0) for t in pdf[text]]
                order = sorted((i for i in range(n) if len(read[i][0])), key=lambda i: len(read[i][0]))
                at = 0
                while at < len(order):
                    take = max(1, min(512, 200_000 // len(read[order[min(len(order), at + 512) - 1]][0])))
                    part = order[at : at + take]
                    at += take
                    lengths = np.array([len(read[i][0]) for i in part])
                    padded = np.zeros((len(part), lengths.max()), np.int32)
                    for row, i in enumerate(part):
                        padded[row, : lengths[row]] = read[i][0]
                    paths = viterbi(model.scores[padded], lengths)
                    for row, i in enumerate(part):
                        languages[i], sure[i], passages[i] = _judge(*read[i], paths[row, : lengths[row]], model)
            yield pdf.assign(language=pd.array(languages, dtype=object), confidence=sure, passages=passages)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    schema = f"{fields}, language string, confidence double, passages array<struct<language:string,first:int,sentences:int,confidence:double>>"
    return df.select(*names).mapInPandas(run, schema)
