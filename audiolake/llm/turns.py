"""Speech transcripts into clean, ordered speaker turns.

A file is read to cues (place in the file, start time, cue number), and a cue to the lines of its speakers. The
order of these segments is found from weighted precedence edges: the lines of one cue follow each other
(dialogue order, the strongest), an earlier start comes before a later one, a smaller cue number before the next, and
a cue before the next one in the file (the weakest). Edges enter strongest first into an online topological order;
an edge that would close a cycle contradicts stronger ones and is dropped. The segments are then taken in topological
order, cleaned of hesitations and sound annotations, given a speaker of the transcript's own list, and
merged to turns.

Defined results: NULL or empty content and files without speech give no turn; a transcript without
listed speakers gives no turn; a leading segment without label belongs to the only listed speaker, if
there is one, and to nobody otherwise; a label that names nobody on the list is text; of cues with one
start time the smaller cue number comes first, then the earlier place in the file; repeated transcript ids are
read as one file each and their turns are numbered apart by file; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights of the precedence edges.
DIALOGUE, TIME, NUMBER, FILE = 8, 4, 2, 1

# Hesitation sounds of the five languages.
HESITATIONS = "um uh uhm er erm hmm hm mm mhm mm-hm mmh mmm uh-huh ah eh ehm em euh heu hum bah äh ähm öh öhm hä mhh ãh hã hum-hum hmm-hm".split()
# Words for the roles of speakers.
ROLES = {
    "host": "host animation presenter moderator moderation moderatorin gastgeber animateur animatrice hôte présentateur présentatrice présente presenta presentador presentadora anfitrión anfitriã anfitrião apresentador apresentadora apresenta apresentação",
    "guest": "guest gast invité invitée invitado invitada convidado convidada interviewee",
    "cohost": "cohost co-host co-moderator comoderator co-moderation co-moderatorin co-animateur coanimateur co-animatrice copresentador copresentadora co-presentador coanfitrión co-anfitrión co-apresentador coapresentador co-apresentadora co-hôte",
}
_ROLE = {w: role for role, words in ROLES.items() for w in words.split()}
_NUMBER = re.compile(r"(?:(?:speaker|sprecher|sprecherin|locuteur|locutrice|intervenant|hablante|locutor|falante|orador|spk|person)[ _#-]*)?0*(\d{1,4})", re.I)

_STAMP = r"(?:(\d{1,3}):)?(\d{1,2}):(\d{2})(?:[.,](\d{1,3}))?"
_CUE = re.compile(r"^\s*" + _STAMP + r"\s*-->\s*(?:\d{1,3}:)?\d{1,2}:\d{2}")
_LEAD = re.compile(r"^[\[(]?" + _STAMP + r"[\])]?[ \t]*[-–:]?[ \t]*")
_HEAD = re.compile(r"^(.{1,80}?)[ \t]+[\[(]?" + _STAMP + r"[\])]?[ \t]*:?[ \t]*$")
_MIDDLE = re.compile(r"^(.{1,80}?)[ \t]*[\[(]" + _STAMP + r"[\])][ \t]*:[ \t]*")
_VOICE = re.compile(r"<v(?:\.[^ >]*)?[ \t]+([^>]+)>", re.I)
_LABEL = re.compile(r"^(?:>>+|[-–—])?[ \t]*([^:\n]{1,80}?)[ \t]*:(?!\d)[ \t]*")
_BRACKET = re.compile(r"^(?:>>+[ \t]*)?\[([^\]\n]{1,80})\][ \t]*:?[ \t]*")
_TAGS = re.compile(r"<[^>\n]*>")
_SOUNDS = re.compile(r"\[[^\]\n]*\]|\([^)\n]*\)|♪[^♪\n]*♪|[♪♫]+[^\n]*$|\*[^*\n]+\*")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*|\d+")
_FILLER = re.compile(r"(?<![\w-])(?:" + "|".join(sorted(map(re.escape, HESITATIONS), key=len, reverse=True)) + r")(?![\w-])(?:\.\.\.|…|[,.])?[ \t]*", re.I)


def _seconds(h, m, s, f) -> float:
    return int(h or 0) * 3600 + int(m) * 60 + int(s) + (int(f.ljust(3, "0")) / 1000 if f else 0.0)


def kind_of(content: str, mime: str | None, url: str | None) -> str:
    """json, vtt, srt or text. The content decides; type and place only where it leaves a doubt."""
    head = content.lstrip()
    if head.startswith("WEBVTT"):
        return "vtt"
    if head[:1] == "{" or re.match(r"\[\s*\{", head):
        return "json"
    if re.search(r"^\s*" + _STAMP + r"\s*-->", content, re.M):
        stated = f"{mime or ''} {re.split('[?#]', url or '')[0]}".lower()
        return "vtt" if "vtt" in stated and "srt" not in stated else "srt"
    return "text"


def _json_segments(content: str):
    try:
        data = json.loads(content)
    except ValueError:  # a cut-off file: read the whole segments it has
        data, decoder, at = [], json.JSONDecoder(), 0
        while (at := content.find("{", at + 1)) >= 0:
            try:
                item, end = decoder.raw_decode(content, at)
            except ValueError:
                continue
            if isinstance(item, dict):
                data.append(item)
            at = end - 1
    if isinstance(data, dict):
        data = next((data[k] for k in ("segments", "cues", "items", "transcript") if isinstance(data.get(k), list)), [])
    first = lambda item, *names: next((item[n] for n in names if item.get(n) not in (None, "")), None)
    for item in data if isinstance(data, list) else []:
        if not isinstance(item, dict):
            continue
        start = first(item, "startTime", "start", "start_time", "begin")
        if isinstance(start, str):
            found = re.fullmatch(_STAMP, start.strip())
            start = _seconds(*found.groups()) if found else float(start) if re.fullmatch(r"\d+(\.\d+)?", start.strip()) else None
        label = first(item, "speaker", "speakerName", "name")
        body = first(item, "body", "text", "content")
        yield (float(start) if isinstance(start, (int, float)) else None), (str(label).strip() if label is not None else None), str(body or ""), None


def _cue_segments(content: str):
    for block in re.split(r"\n[ \t]*\n", content):
        lines = block.split("\n")
        at = next((i for i, line in enumerate(lines) if _CUE.match(line)), None)
        if at is None:
            continue
        start, number = _seconds(*_CUE.match(lines[at]).groups()), _cue_number(lines[at - 1]) if at else None
        body = []
        for line in lines[at + 1 :]:
            again = _CUE.match(line)
            if again:  # cues without a blank line between them
                following = _cue_number(body[-1]) if body and body[-1].strip().isdigit() else None
                if following is not None:
                    body.pop()
                yield start, None, "\n".join(body), number
                start, number, body = _seconds(*again.groups()), following, []
            else:
                body.append(line)
        yield start, None, "\n".join(body), number


def _cue_number(line: str) -> int | None:
    """The number of a cue's own line, as SRT has it and many VTT files."""
    found = re.fullmatch(r"[A-Za-z]{0,8}[-_ ]?(\d{1,9})", line.strip())
    return int(found[1]) if found else None


def _text_segments(content: str, known):
    start, label = None, None
    for line in content.split("\n"):
        line = line.strip()
        if not line:
            continue
        if (found := _HEAD.match(line)) and known(found[1]) is not None:
            start, label = _seconds(*found.groups()[1:]), found[1]  # a line of its own before the speech
            continue
        if (found := _MIDDLE.match(line)) and known(found[1]) is not None:
            start, label, line = _seconds(*found.groups()[1:]), found[1], line[found.end() :]
        elif found := _LEAD.match(line):
            start, line = _seconds(*found.groups()), line[found.end() :]
        yield start, label, line, None
        start, label = None, None


class People:
    """Resolves written labels to the speakers of one transcript."""

    def __init__(self, speakers: list[tuple[int, str | None, str | None]]):
        self.numbers = {no for no, _, _ in speakers}
        options: dict[str, set[int]] = {}
        for no, name, role in speakers:
            parts = self.plain(name or "").split()
            forms = {" ".join(parts)} if parts else set()
            if len(parts) > 1:
                first, last = parts[0], parts[-1]
                forms |= {first, last, f"{first} {last}", f"{first[0]} {last}", f"{first} {last[0]}", f"{last} {first}"}
            forms |= {f"{role_word}" for role_word, r in _ROLE.items() if r == (role or "").strip().lower()}
            for form in forms:
                options.setdefault(self.plain(form), set()).add(no)
        self.names = {form: next(iter(who)) for form, who in options.items() if len(who) == 1}

    @staticmethod
    def plain(label: str) -> str:
        """Lower case, without accents, dots and commas; blanks collapsed."""
        text = unicodedata.normalize("NFKD", label.lower())
        return " ".join("".join(" " if c in ".,_" else c for c in text if not unicodedata.combining(c)).split())

    def find(self, label: str | None) -> int | None:
        if not label:
            return None
        label = label.strip(" \t[]()<>-–—:")
        number = _NUMBER.fullmatch(label)
        if number and int(number[1]) in self.numbers:
            return int(number[1])
        form = re.sub(r"\s*\(.*?\)\s*", " ", self.plain(label)).strip()
        return self.names.get(form) or self.misspelt(form)

    def misspelt(self, form: str) -> int | None:
        """The one speaker a form of whose name has the same letters, or is one edit away for each six letters."""
        if len(form) < 5 or len(form) > 60:
            return None
        near = {who for name, who in self.names.items() if len(name) >= 5 and name.count(" ") == form.count(" ") and edits(form, name, max(1, min(len(form), len(name)) // 6)) is not None}
        return next(iter(near)) if len(near) == 1 else None


def edits(a: str, b: str, most: int) -> int | None:
    """Edits with swaps of neighbouring letters between two words, None if more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return None
    before, last = list(range(len(b) + 1)), None
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if last is not None and j > 1 and i > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, last[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return None
        last, before = before, row
    return before[-1] if before[-1] <= most else None


def _split_label(text: str, people: People) -> tuple[int | None, str]:
    """A leading label that names a listed speaker, and the rest."""
    if found := _VOICE.search(text):
        who = people.find(found[1])
        if who is not None:
            return who, text[: found.start()] + text[found.end() :]
    for pattern in (_BRACKET, _LABEL):
        found = pattern.match(text)
        if found and (who := people.find(found[1])) is not None:
            return who, text[found.end() :]
    return None, re.sub(r"^(?:>>+)[ \t]*", "", text)


def _lines(text: str, people: People) -> list[tuple[int | None, str]]:
    """(speaker or None, text) of each speaker's lines in one cue; a line without label goes on with the one before it."""
    parts, at = [], 0
    for found in _VOICE.finditer(text):
        if people.find(found[1]) is not None and found.start() > at:
            parts.append(text[at : found.start()])
            at = found.start()
    out: list[tuple[int | None, str]] = []
    for part in (*parts, text[at:]):
        for line in part.split("\n"):
            if not line.strip():
                continue
            who, rest = _split_label(line.strip(), people)
            if out and who is None:
                out[-1] = (out[-1][0], f"{out[-1][1]} {rest}")
            else:
                out.append((who, rest))
    return out


def clean(text: str) -> str:
    """Text without tags, sound annotations and hesitations."""
    text = _FILLER.sub("", _SOUNDS.sub(" ", _TAGS.sub(" ", text)))
    text = " ".join(text.split())
    return re.sub(r"^[,.;… ]+", "", text)


class Order:
    """A topological order under insertion of edges; an edge that would close a cycle is refused.

    Only the nodes between the two ends of a contradicting edge are looked at and moved.
    """

    def __init__(self, n: int):
        self.at = list(range(n))
        self.after: list[list[int]] = [[] for _ in range(n)]
        self.before: list[list[int]] = [[] for _ in range(n)]

    def _reach(self, start: int, edges: list[list[int]], inside) -> list[int]:
        seen, todo = {start}, [start]
        while todo:
            for j in edges[todo.pop()]:
                if j not in seen and inside(self.at[j]):
                    seen.add(j)
                    todo.append(j)
        return list(seen)

    def add(self, a: int, b: int) -> bool:
        """Enter a -> b; False if b comes before a already."""
        low, high = self.at[b], self.at[a]
        if low < high:
            forward = self._reach(b, self.after, lambda p: p <= high)
            if a in forward:
                return False
            backward = self._reach(a, self.before, lambda p: p >= low)
            moved = sorted(backward, key=self.at.__getitem__) + sorted(forward, key=self.at.__getitem__)
            for node, place in zip(moved, sorted(self.at[x] for x in moved), strict=True):
                self.at[node] = place
        self.after[a].append(b)
        self.before[b].append(a)
        return a != b


def order(starts: list[float | None], cues: list[int] | None = None, numbers: list[int | None] | None = None) -> list[int]:
    """Order of segments, given in file order, under their precedence edges.

    ``starts``: start times (None: unknown). ``cues``: the cue of each segment, rising; by default each is its own.
    ``numbers``: cue numbers. Nodes beyond the segments stand between the distinct start times, so that
    the time edges are linear in number.
    """
    n = len(starts)
    cues = list(range(n)) if cues is None else cues
    numbers = [None] * n if numbers is None else numbers
    heads = [i for i in range(n) if not i or cues[i] != cues[i - 1]]
    ends = [j - 1 for j in (*heads[1:], n)] if heads else []
    edges = [(DIALOGUE, i - 1, i) for i in range(1, n) if cues[i] == cues[i - 1]]
    times = sorted({t for t in starts if t is not None})
    rank = {t: k for k, t in enumerate(times)}
    for i, t in enumerate(starts):
        if t is not None:
            edges += [(TIME, n + rank[t] - 1, i)] * (rank[t] > 0) + [(TIME, i, n + rank[t])] * (rank[t] + 1 < len(times))
    counted = sorted((numbers[a], a, b) for a, b in zip(heads, ends, strict=True) if numbers[a] is not None)
    edges += [(NUMBER, b, c) for (x, _, b), (y, c, _) in zip(counted, counted[1:]) if x < y]
    edges += [(FILE, b, a) for b, a in zip(ends, heads[1:])]
    graph = Order(n + max(0, len(times) - 1))
    last, place = (0, 0), []  # initial order: by the last time stated before a segment, then the file
    for i, t in enumerate(starts):
        last = (2 * rank[t], 0) if t is not None else last
        place.append((*last, i))
    place += [(2 * k + 1, 0, 0) for k in range(max(0, len(times) - 1))]
    for at, node in enumerate(sorted(range(len(place)), key=place.__getitem__)):
        graph.at[node] = at
    for _, a, b in sorted(edges, key=lambda e: -e[0]):
        graph.add(a, b)
    return sorted(range(n), key=graph.at.__getitem__)


def turns_of(content: str | None, mime: str | None, url: str | None, speakers: list[tuple[int, str | None, str | None]]) -> list[tuple[int, float | None, str]]:
    """(speaker_no, start, text) of each turn of one file."""
    if not content or not speakers:
        return []
    content = content.replace("﻿", "").replace("\r\n", "\n").replace("\r", "\n")
    people = People(speakers)
    kind = kind_of(content, mime, url)
    if kind == "json":
        raw = _json_segments(content)
    elif kind == "text":
        raw = _text_segments(content, people.find)
    else:
        raw = _cue_segments(content)
    segments, seen = [], set()
    for cue, (start, label, text, number) in enumerate(raw):
        who, key = people.find(label), (start, label, " ".join(text.split()))
        if start is not None and key in seen:
            continue
        seen.add(key)
        lines = [(who, text)] if who is not None else _lines(text, people)
        segments += [(start, speaker, line, cue, number) for speaker, line in lines]
    speaker = speakers[0][0] if len(speakers) == 1 else None
    out: list[list] = []
    for i in order(*([s[k] for s in segments] for k in (0, 3, 4))):
        start, who, text = segments[i][:3]
        speaker = who if who is not None else speaker
        text = clean(text)
        if speaker is None or not _WORD.search(text):
            continue
        if out and out[-1][0] == speaker:
            out[-1][2].append(text)
        else:
            out.append([speaker, start, [text]])
    return [(a, b, " ".join(c)) for a, b, c in out]


def turns(transcripts: DataFrame, speakers: DataFrame) -> DataFrame:
    """(transcript_id, turn_no, speaker_no, start_seconds, text). Speakers are grouped by transcript, a short list each."""
    listed = speakers.filter(F.col("speaker_no").isNotNull()).groupBy("transcript_id").agg(F.sort_array(F.collect_set(F.struct("speaker_no", "speaker_name", "speaker_role"))).alias("people"))
    files = transcripts.select(F.col("id").alias("transcript_id"), "mime_type", "source_url", "content").filter(F.length("content") > 0).join(listed, "transcript_id")

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                people = [(p["speaker_no"], p["speaker_name"], p["speaker_role"]) for p in r.people]
                rows += [(r.transcript_id, n, *t) for n, t in enumerate(turns_of(r.content, r.mime_type, r.source_url, people), 1)]
            frame = pd.DataFrame(rows, columns=["transcript_id", "turn_no", "speaker_no", "start_seconds", "text"])
            frame["start_seconds"] = frame.start_seconds.astype("Float64")
            yield frame

    return files.mapInPandas(run, "transcript_id long, turn_no int, speaker_no int, start_seconds double, text string")
