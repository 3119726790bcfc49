"""Sentence units of cued texts in many scripts, with unsupervised statistics that decide ambiguous periods.

Two passes over whole texts. The first learns, for each language, which tokens are abbreviations, which words start
sentences and which words belong together, by log-likelihood ratios over all lines (each distinct line of a
partition is analysed once and weighted by its number). The second cuts every document: layout (cue numbers, times,
headers, markup, dashes, names of speakers, bracketed sounds, sung lines) belongs to no sentence; clear marks end one;
periods, dots and cue ends are decided with the learned statistics.

Defined cases: null, empty and blank texts have no sentence; text without any cue times is taken as plain text whose blank
lines part it; a sentence without a final mark ends with its cue or its speaker's line; in Japanese, Chinese and
Thai none runs over cues, in Thai every blank parts sentences; a cue shown twice counts twice; positions are code
points of the stored text, wrong encodings included (they are read through, never changed); texts of any length are cut whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltgrid.session import stored

# ---------------------------------------------------------------- characters

#: Final marks, closing and opening marks.
MARKS = ".!?…。！？।॥;;\x85"
CLOSERS = "\"'”“’»›」』）)］\\]\x93\x94"
OPENERS = "\"'“„‘«‹「『（(［[¿¡\x93\x84"
QUOTES = set("\"”“»」』«„\x93\x94")

_MARKUP = re.compile(r"<[^<>\n]*>|\{[^{}\n]*\}")
_FRAME = re.compile(r"\{\d+\}\{\d+\}")
_SPEAKER = re.compile(r"([^\s:a-z0-9][^:a-z0-9]+):\s+")
_DASH = re.compile(r"[-–—‐]+\s*")
_SUNG = re.compile(r"[♪♫🎵🎶]")
_SOUND = re.compile(r"[\[(（［].*[\])）］]", re.S)
_HEADER = re.compile(r"(?:WEBVTT|NOTE|STYLE|REGION)\b")
#: A mark, what repeats it, and the closing marks after it (a closing guillemet may stand apart).
_END = re.compile("[.!?…。！？।॥;;\x85]+(?:[   ]?[»›]|[\"'”“’」』）)\\]\x93\x94])*")
_JA_QUOTE = re.compile("[。！？…]*[」』]+")
_WIDE_END = re.compile(f"{_END.pattern}|{_JA_QUOTE.pattern}")
_WORD = re.compile(r"\w")
#: One or two capitals with a period.
_INITIAL = re.compile(r"[^\W\d_a-z]{1,2}\.[,;]?")
_TOKEN = re.compile(r"[^\s\"“”„«»‹›¿¡()\[\]（）「」『』]+")
_LEAD = re.compile(r"[\s\"'“„‘«‹「『（(\[¿¡\x93\x84\-–—]*")

_KANA, _HAN, _THAI, _DEVA = re.compile("[぀-ヿ]"), re.compile("[㐀-鿿]"), re.compile("[฀-๿]"), re.compile("[ऀ-ॿ]")
_GREEK, _CYRILLIC, _LATIN = re.compile("[Ͱ-Ͽἀ-῿]"), re.compile("[Ѐ-ӿ]"), re.compile("[A-Za-z]")
#: Any letter of the scripts that are told apart.
_BEYOND = re.compile("[Ͱ-Ͽἀ-῿Ѐ-ӿऀ-ॿ฀-๿぀-ヿ㐀-鿿]")
_CONT = "\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_MOJIBAKE = re.compile(f"[\xc2-\xf4][{_CONT}]{{1,3}}")
_HIGH = re.compile("[\xc0-\xff]")
#: Commonest function words by which unlabelled Latin text is told apart.
FUNCTION_WORDS = {
    "en": (" the ", " of ", " to ", " has ", " was ", "The ", " a "),
    "de": (" der ", " die ", " den ", " das ", " nicht ", "Der ", " am ", " seit "),
    "fr": (" le ", " des ", " est ", " du ", " et ", " sur ", "La ", " a "),
    "es": (" el ", " los ", " las ", " del ", " al ", "El ", " por ", " sin "),
}


def _byte(c: str) -> int | None:
    try:
        return c.encode("cp1252")[0]
    except UnicodeEncodeError:
        return ord(c) if ord(c) < 256 else None


def repaired(line: str) -> tuple[str, list[int] | None]:
    """The line with UTF-8 that was read as one-byte text put right, and the place of each character's last original one."""
    if not _MOJIBAKE.search(line):
        return line, None
    out, place, i = [], [], 0
    while i < len(line):
        c = line[i]
        n = 0
        if "\xc2" <= c <= "\xf4":
            n = 1 if c < "\xe0" else 2 if c < "\xf0" else 3
            raw = [_byte(x) for x in line[i : i + n + 1]]
            try:
                c = bytes(b if b is not None else 0 for b in raw).decode("utf-8") if len(raw) == n + 1 else c
                n = n if c != line[i] else 0
            except UnicodeDecodeError:
                n = 0
        out.append(c)
        place.append(i + n)
        i += n + 1
    return "".join(out), place


def script(line: str) -> str:
    """'ja', 'zh', 'th', 'hi', 'el', 'ru', 'latin' or '' of a line."""
    if line.isascii() or not _BEYOND.search(line):
        return "latin" if _LATIN.search(line) or _HIGH.search(line) else ""
    for name, pattern in (("ja", _KANA), ("zh", _HAN), ("th", _THAI), ("hi", _DEVA), ("el", _GREEK), ("ru", _CYRILLIC)):
        if pattern.search(line):
            return name
    return "latin" if _LATIN.search(line) or _HIGH.search(line) else ""


def language(text: str, label: str | None) -> str:
    """Language of a document's Latin lines: by function words, the label where they say nothing."""
    votes = {name: sum(map(text.count, words)) for name, words in FUNCTION_WORDS.items()}
    best = max(votes, key=lambda k: votes[k])
    label = (label or "").strip().lower()[:2]
    if votes[best] > 1.3 * votes.get(label, 0) and votes[best] >= 2:
        return best
    return label if label in votes else best if votes[best] else "en"


#: One-byte code pages by which text of a script may have been misread.
PAGES = {"ru": "cp1251", "el": "cp1253"}


_TABLES: dict[str, dict[int, str]] = {}


def _page_table(page: str) -> dict[int, str]:
    """What each Latin character stands for if it was a byte of `page`; other characters stay."""
    if page not in _TABLES:
        table = {}
        for b in range(0x80, 0x100):
            meant = bytes([b]).decode(page, "ignore")
            for seen in {chr(b), bytes([b]).decode("cp1252", "ignore") or chr(b)}:
                if meant:
                    table[ord(seen)] = meant
        _TABLES[page] = table
    return _TABLES[page]


def view(line: str, page: str | None) -> tuple[str, list[int] | None]:
    """A line as it was meant: UTF-8 misread as bytes, or a code page misread as Latin."""
    fixed, place = repaired(line)
    if place is None and page and not line.isascii() and len(_HIGH.findall(line)) >= 3 and not re.search("[a-z]{3}", line):
        return line.translate(_page_table(page)), None
    return fixed, place


# ---------------------------------------------------------------- layout


def cues(text: str) -> list[list[tuple[int, str]]]:
    """The cues of a text, each a list of (place, line); without any times, paragraphs."""
    timed = "-->" in text or _FRAME.search(text) is not None
    out: list[list[tuple[int, str]]] = []
    cue: list[tuple[int, str]] | None = None if timed else []
    at = 0
    for raw in text.split("\n"):
        line, here = raw.rstrip("\r"), at
        at += len(raw) + 1
        if "-->" in line:
            if cue and cue[-1][1].strip().isdigit():
                cue.pop()  # the number of the next cue, where no blank line parts them
            cue = []
            out.append(cue)
        elif line[:1] == "{" and (m := _FRAME.match(line)):
            part, k = [], here + m.end()
            for piece in line[m.end() :].split("|"):
                part.append((k, piece))
                k += len(piece) + 1
            out.append(part)
            cue = part
        elif not line or line.isspace():
            cue = None if timed else []
            if not timed:
                out.append(cue)
        elif cue is None:
            if out and not line.strip("﻿ ").isdigit() and not _HEADER.match(line):
                cue = [(here, line)]
                out.append(cue)
        else:
            if not timed and not out:
                out.append(cue)
            if timed or not _HEADER.match(line.lstrip("﻿")):
                cue.append((here, line))
    return [c for c in out if c]


class Line:
    """A spoken line: its words without markup, dash and speaker, where they stand, and its places that may end a sentence."""

    __slots__ = ("text", "at", "place", "turn", "lang", "marks")

    def __init__(self, text: str, at: int, place, turn: bool, lang: str, marks):
        self.text, self.at, self.place, self.turn, self.lang, self.marks = text, at, place, turn, lang, marks

    def end(self, k: int) -> int:
        """Place in the stored text of the character before k."""
        return self.at + (self.place[k - 1] if self.place else k - 1)


#: Lines kept by a worker with what was read of them; it bounds memory only.
KEPT = 100_000
_READ: dict[tuple[str, str | None], tuple | None] = {}


def _read(raw: str, page: str | None) -> tuple | None:
    """(text, start of its words, place, turn, script, marks) of a line, or None if nobody speaks in it."""
    text, place = (raw, None) if raw.isascii() else view(raw, page)
    marked = "<" in text or "{" in text
    if marked:
        text = _MARKUP.sub(lambda m: "\x01" * len(m[0]), text)
    i, j = 0, len(text)
    turn = False
    while not (i == 0 and text[:1].isalnum() and ":" not in text):
        while i < j and (text[i].isspace() or text[i] in "\x01\ufeff"):
            i += 1
        if m := _DASH.match(text, i):
            i, turn = m.end(), True
            continue
        if ":" in text and (m := _SPEAKER.match(text, i)) and m[1].isupper():
            i, turn = m.end(), True
            continue
        break
    while j > i and ((c := text[j - 1]).isspace() or c in "\x01\ufeff"):
        j -= 1
    if i >= j or not _WORD.search(text, i, j):
        return None
    words = text[i:j].replace("\x01", "\u200b") if marked else text[i:j]
    sc = script(words)
    text = " " * i + words if i else words
    ends = _WIDE_END if sc in ("ja", "zh") else _END
    marks = tuple((m.start(), m.end(), m[0]) for m in ends.finditer(text)) if sc != "th" else ()
    return text, i, place, turn, sc, marks


def spoken(cue: list[tuple[int, str]], latin: str, page: str | None) -> list[Line]:
    """The lines of a cue that belong to sentences; [] for sounds, songs and empty cues."""
    out = []
    for at, raw in cue:
        key = (raw, page)
        if key in _READ:
            got = _READ[key]
        else:
            if len(_READ) > KEPT:
                _READ.clear()
            got = _READ[key] = _read(raw, page)
        if got is not None:
            out.append((at, got))
    if not out:
        return []
    text, i = out[0][1][:2]
    if text[i] in "[(（［♪♫🎵🎶":
        first, last = text[i:], out[-1][1][0]
        whole = "\n".join(x[0][x[1] :] for _, x in out)
        if _SUNG.match(first) and (_SUNG.match(last[-1]) or len(_SUNG.findall(whole)) >= 2):
            return []
        if first[0] in "[(（［" and last[-1] in "])）］" and _SOUND.fullmatch(whole) and not re.search(r"[\])）］][^\[(（［]+[\[(（［]", whole):
            return []
    return [Line(text, at, place, turn, latin if sc in ("latin", "") else sc, marks) for at, (text, _, place, turn, sc, marks) in out]


def word_before(text: str, k: int) -> str:
    """The token that ends at k."""
    i = k
    while i > 0 and not text[i - 1].isspace() and text[i - 1] not in "\"“”„«»(（[「『¿¡​":
        i -= 1
    return text[i:k].lstrip("-–'’….")


def word_after(text: str, k: int = 0) -> str:
    """The first token at or after k, without opening marks; '' if there is none."""
    k = _LEAD.match(text, k).end()
    m = _TOKEN.match(text, k)
    return m[0].strip("​,:") if m else ""


def kind(word: str) -> str:
    """'lower', 'upper', 'digit' or 'other' (scripts without case) of a token's first letter."""
    w = word.lstrip("….​'’")
    c = w[:1]
    if c.isdigit():
        return "upper" if c == "0" and w[1:2].isalpha() else "digit"
    if c == "l" and (w[1:2] in ("", "'", "’") or w in ("lt", "ln", "ls", "lf", "lts")):
        return "upper"  # a capital I that was read as l
    return "lower" if c.islower() else "upper" if c.isupper() else "other"


def plain(word: str) -> str:
    """A token without the marks around it; numbers are all alike."""
    w = word.strip(".,!?…;:।。！？\"'”“’»«​")
    return "##" if w[:1].isdigit() else w


# ---------------------------------------------------------------- statistics

#: Kinds of counts: followers of "word." by kind, capitals that follow it, words in the middle, words at sure starts, word pairs, words after a closed quotation.
DOT_LOWER, DOT_DIGIT, DOT_PAIR, INNER, START, PAIR, QUOTED = range(7)
#: Log-likelihood ratio from which two shares differ (5 % of a chi-square of one degree).
DIFFERS = 3.84
_COUNTS = T.StructType(
    [T.StructField("lang", T.StringType()), T.StructField("kind", T.IntegerType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("n", T.LongType())]
)


def study(line: str, lang: str, n: int, counts: Counter) -> None:
    """Counts of one distinct line."""
    if lang in ("ja", "zh", "th", ""):
        return
    tokens = line.split()
    for x, y in zip(tokens, tokens[1:]):
        if x[-1] in ".…" and not x.endswith("..") and x[-1] == ".":
            a, k = plain(x), kind(word_after(y))
            b = plain(y)
            if _INITIAL.fullmatch(y):
                k = "lower"  # a period before an initial ends nothing
            if k != "upper":
                counts[lang, DOT_DIGIT if k == "digit" else DOT_LOWER, a, ""] += n
            elif b:
                counts[lang, DOT_PAIR, a, b] += n
        elif x[-1] in "!?।;" or x[-1] in "\"”“»" and len(x) > 1 and x[-2] in "!?।;.":
            b = plain(y)
            if x[-1] in "\"”“»":
                counts[lang, QUOTED, b, ""] += n
            else:
                counts[lang, START, b, ""] += n
        elif x[-1].isalnum() or "\u0900" <= x[-1] <= "\u0d7f":
            k = kind(y)
            if k != "lower":
                b = plain(y)
                if b:
                    counts[lang, INNER, b, ""] += n
                    counts[lang, PAIR, plain(x), b] += n


def learn(documents: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, kind, a, b, n) over all lines of all documents."""

    def run(batches):
        lines: Counter = Counter()
        counts: Counter = Counter()

        def flush():
            for (k, line), n in lines.items():
                study(line, k, n, counts)
            lines.clear()

        for batch in batches:
            for t, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not t or t.isspace():
                    continue
                latin = language(t, label)
                for raw in (t.replace("|", "\n") if "}{" in t else t).split("\n"):
                    if "-->" in raw or len(raw) < 3:
                        continue
                    if not raw.isascii():
                        raw = repaired(raw)[0]
                    k = script(raw)
                    if k:
                        lines[latin if k == "latin" else k, _MARKUP.sub("", raw) if "<" in raw or "{" in raw else raw] += 1
            if len(lines) > 200_000:
                flush()
        flush()
        keys = list(counts)
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            columns = list(zip(*part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0]), pa.array(columns[1], pa.int32()), pa.array(columns[2]), pa.array(columns[3]), pa.array([counts[k] for k in part], pa.int64())], names=_COUNTS.names
            )

    found = documents.select(text, lang).mapInArrow(run, _COUNTS)
    return found.groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n"))


def log_likelihood(k1: float, n1: float, k2: float, n2: float) -> float:
    """Dunning's ratio for k1 of n1 against k2 of n2 (twice the log)."""

    def part(k: float, n: float, p: float) -> float:
        p = min(max(p, 1e-12), 1 - 1e-12)
        return k * math.log(p) + (n - k) * math.log(1 - p)

    p1, p2, p = k1 / n1 if n1 else 0.0, k2 / n2 if n2 else 0.0, (k1 + k2) / (n1 + n2) if n1 + n2 else 0.0
    return 2 * (part(k1, n1, p1) + part(k2, n2, p2) - part(k1, n1, p) - part(k2, n2, p))


def starts(start: float, total_start: float, inner: float, total_inner: float) -> bool:
    """Does a word start sentences significantly more often than it stands within them?"""
    return start / total_start > inner / total_inner and log_likelihood(start, total_start, inner, total_inner) > DIFFERS


def like_within(hits: float, n: float, within: float, total_within: float, at_start: float, total_start: float) -> bool:
    """Do n followers, of which hits are starters, look like words within sentences rather than like words at sure starts?

    A likelihood ratio of two shares of starters: that of capitalised words within sentences and that of sure starts.
    """
    p, q = (min(max(k / t, 1e-3), 1 - 1e-3) for k, t in ((within, total_within), (at_start, total_start)))
    return p < q and 2 * (hits * math.log(p / q) + (n - hits) * math.log((1 - p) / (1 - q))) > DIFFERS


class Model:
    """What the counts say, by language: abbreviations, titles, starters, words that belong together, report words."""

    def __init__(self, rows):
        by: dict[str, dict[int, dict]] = {}
        for lang, k, a, b, n in rows:
            by.setdefault(lang, {}).setdefault(k, {})[(a, b) if b else a] = n
        self.abbreviations: dict[str, dict[str, tuple[bool, bool]]] = {}
        self.pairs: dict[str, set[tuple[str, str]]] = {}
        self.reports: dict[str, set[str]] = {}
        for lang, counts in by.items():
            get = lambda k: counts.get(k, {})  # noqa: B023, E731
            inner, start = get(INNER), get(START)
            total_inner, total_start = sum(inner.values()) or 1, sum(start.values()) or 1
            # words that start sentences more often than they stand within
            starters = {w for w, n in start.items() if starts(n, total_start, inner.get(w, 0), total_inner)}
            at_start, within = sum(start[w] for w in starters), sum(inner.get(w, 0) for w in starters)
            upper: dict[str, Counter] = {}
            for (a, b), n in get(DOT_PAIR).items():
                upper.setdefault(a, Counter())[b] += n
            lower, digit = get(DOT_LOWER), get(DOT_DIGIT)
            n_all = {w: lower.get(w, 0) + digit.get(w, 0) + sum(upper.get(w, {}).values()) for w in {*lower, *digit, *upper}}
            low_all, all_all = sum(lower.values()) + sum(digit.values()), sum(n_all.values())
            table = {}
            for w, n in n_all.items():
                if w == "##":
                    continue
                low = lower.get(w, 0) + digit.get(w, 0)
                ups = upper.get(w, {})
                n_up = sum(ups.values())
                # after a title stand such words as stand within sentences
                hits = sum(m for b, m in ups.items() if b in starters)
                title = n_up > 0 and like_within(hits, n_up, within, total_inner, at_start, total_start)
                before = low / n > 0.5 and n >= 3 and log_likelihood(low, n, low_all - low, max(1, all_all - n)) > DIFFERS
                if before or title and n >= 3:
                    table[w] = (title, digit.get(w, 0) > 0.02 * n)
            self.abbreviations[lang] = table
            together = get(PAIR)
            left: Counter = Counter()
            for (a, _), n in together.items():
                left[a] += n
            self.pairs[lang] = {
                (a, b) for (a, b), n in together.items() if n >= 2 and log_likelihood(n, left[a], inner.get(b, 0) - n, max(1, total_inner - left[a])) > DIFFERS
            }
            for (a, b), n in get(DOT_PAIR).items():
                if a == "##" and n >= 3 and start.get(b, 0) + inner.get(b, 0) < n:
                    self.pairs[lang].add(("##.", b))
            quoted = get(QUOTED)
            self.reports[lang] = {w for w, n in quoted.items() if n >= 2 and n > start.get(w, 0)}

    @classmethod
    def of(cls, rows) -> Model:
        """The model from rows of decided()."""
        m = cls([])
        for lang, what, a, b, title, digits in rows:
            if what == "word":
                m.abbreviations.setdefault(lang, {})[a] = (bool(title), bool(digits))
            elif what == "pair":
                m.pairs.setdefault(lang, set()).add((a, b))
            else:
                m.reports.setdefault(lang, set()).add(a)
        return m


def _ratio(k1, n1, k2, n2) -> Column:
    """log_likelihood on columns."""
    share = lambda k, n: F.when(n != 0, k / n).otherwise(F.lit(0.0))
    bound = lambda p: F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    part = lambda k, n, p: k * F.log(bound(p)) + (n - k) * F.log(1 - bound(p))
    p = share(k1 + k2, n1 + n2)
    return 2 * (part(k1, n1, share(k1, n1)) + part(k2, n2, share(k2, n2)) - part(k1, n1, p) - part(k2, n2, p))


def decided(counts: DataFrame) -> DataFrame:
    """(lang, what, a, b, title, digits) of what Model decides from all counts, those met once too: abbreviations ('word'), word pairs ('pair'),
    report words ('report'). Totals, scores and tests are aggregations and joins; only what passes is left.
    """
    of = lambda *kinds: counts.where(F.col("kind").isin(*kinds))
    total = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0))
    seen = of(INNER, START).groupBy("lang", "a").agg(total(INNER).alias("inner"), total(START).alias("start"))
    sums = seen.groupBy("lang").agg(F.sum("inner").alias("ti"), F.sum("start").alias("ts"))
    sums = of(DOT_LOWER, DOT_DIGIT, DOT_PAIR, PAIR).select("lang").distinct().join(sums, "lang", "left")
    sums = sums.select("lang", *(F.greatest(F.coalesce(c, F.lit(0)), F.lit(1)).alias(c) for c in ("ti", "ts")))
    more = (F.col("start") / F.col("ts") > F.col("inner") / F.col("ti")) & (_ratio(F.col("start"), F.col("ts"), F.col("inner"), F.col("ti")) > DIFFERS)
    odds = seen.join(sums.select("lang", "ti", "ts"), "lang").select("lang", F.col("a").alias("b"), "inner", "start", more.alias("starter"))
    odds = stored(odds, "sentence-words")
    sums = sums.join(odds.where("starter").groupBy("lang").agg(F.sum("start").alias("bs"), F.sum("inner").alias("bi")), "lang", "left").na.fill(0)

    ups = of(DOT_PAIR).join(odds.select("lang", "b", "starter"), ["lang", "b"], "left")
    ups = ups.groupBy("lang", "a").agg(F.sum("n").alias("up"), F.sum(F.when(F.col("starter"), F.col("n")).otherwise(0)).alias("hits"))
    dots = of(DOT_LOWER, DOT_DIGIT).groupBy("lang", "a").agg(total(DOT_LOWER).alias("lower"), total(DOT_DIGIT).alias("digit"))
    words = dots.join(ups, ["lang", "a"], "full").na.fill(0).withColumn("low", F.col("lower") + F.col("digit")).withColumn("n", F.col("low") + F.col("up"))
    words = words.join(words.groupBy("lang").agg(F.sum("low").alias("low_all"), F.sum("n").alias("all")), "lang").join(sums, "lang")
    share = lambda k, n: F.least(F.greatest(F.col(k) / F.col(n), F.lit(1e-3)), F.lit(1 - 1e-3))
    p, q = share("bi", "ti"), share("bs", "ts")
    title = (F.col("up") > 0) & (p < q) & (2 * (F.col("hits") * F.log(p / q) + (F.col("up") - F.col("hits")) * F.log((1 - p) / (1 - q))) > DIFFERS)
    apart = _ratio(F.col("low"), F.col("n"), F.col("low_all") - F.col("low"), F.greatest(F.lit(1), F.col("all") - F.col("n")))
    before = (F.col("low") / F.col("n") > 0.5) & (apart > DIFFERS)
    words = words.where((F.col("a") != "##") & (F.col("n") >= 3) & (before | title))
    out = words.select("lang", F.lit("word").alias("what"), "a", F.lit("").alias("b"), title.alias("title"), (F.col("digit") > 0.02 * F.col("n")).alias("digits"))

    no = F.lit(False)
    rows = lambda df, what, a, b: df.select("lang", F.lit(what).alias("what"), a.alias("a"), b.alias("b"), no.alias("title"), no.alias("digits"))
    pairs = of(PAIR)
    left = pairs.groupBy("lang", "a").agg(F.sum("n").alias("left"))
    pairs = pairs.where("n >= 2").join(left, ["lang", "a"]).join(odds.select("lang", "b", "inner"), ["lang", "b"], "left").join(sums.select("lang", "ti"), "lang")
    tied = _ratio(F.col("n"), F.col("left"), F.coalesce("inner", F.lit(0)) - F.col("n"), F.greatest(F.lit(1), F.col("ti") - F.col("left")))
    out = out.unionByName(rows(pairs.where(tied > DIFFERS), "pair", F.col("a"), F.col("b")))
    numbers = of(DOT_PAIR).where("a = '##' and n >= 3").join(odds.select("lang", "b", "inner", "start"), ["lang", "b"], "left")
    numbers = numbers.where(F.coalesce("inner", F.lit(0)) + F.coalesce("start", F.lit(0)) < F.col("n"))
    out = out.unionByName(rows(numbers, "pair", F.lit("##."), F.col("b")))
    quoted = of(QUOTED).where("n >= 2").join(seen.select("lang", "a", "start"), ["lang", "a"], "left").where(F.col("n") > F.coalesce("start", F.lit(0)))
    return out.unionByName(rows(quoted, "report", F.col("a"), F.lit("")))


# ---------------------------------------------------------------- cutting


class Cutter:
    def __init__(self, model: Model):
        self.m = model

    def goes_on(self, lang: str, a: str, b: str) -> bool:
        """Do two words around an unmarked or dotted place belong together?"""
        return (plain(a), plain(b)) in self.m.pairs.get(lang, ())

    def dot(self, lang: str, before: str, after: str) -> bool:
        """Does the single period between two tokens end a sentence?"""
        k = kind(after)
        w = before.strip("​")
        if lang == "hi" and k == "other":
            return False
        if k in ("lower", "other") and w[:1].isalnum():
            return False
        if w[:1].isdigit():
            return k != "digit" and ("##.", plain(after)) not in self.m.pairs.get(lang, ())
        title, digits = self.m.abbreviations.get(lang, {}).get(w, (None, None))
        if title is None:
            return not (len(w) == 1 and w.isupper())
        if k == "digit":
            return not digits
        return not title and not (_INITIAL.fullmatch(after) and after[:-1].isupper())

    def ends(self, document: list[list[Line]]) -> list[int]:
        out: list[int] = []
        open_at: int | None = None  # end of what is said since the last sentence's end
        flat = [(line, c, i) for c, cue in enumerate(document) for i, line in enumerate(cue)]
        said = lambda c: [x.text.strip() for x in document[c]]
        for f, (line, c, i) in enumerate(flat):
            text, lang = line.text, line.lang
            follow = flat[f + 1] if f + 1 < len(flat) else None
            same_cue = follow is not None and follow[1] == c
            if follow is not None and (follow[0].turn or (not same_cue and (lang in ("ja", "zh", "th") or said(c + 1) == said(c)))):
                follow = None
            elif follow is not None and follow[0].lang != lang and not (same_cue or {follow[0].lang, lang} & {""}):
                follow = None
            if lang == "th":
                k = 0
                for m in re.finditer(r"\S+", text):
                    piece = m[0].strip("​")
                    if piece:
                        k = m.start() + len(m[0].rstrip("​"))
                        out.append(line.end(k))
                open_at = None
                continue
            done = 0
            size = len(text)
            wide = lang in ("ja", "zh")
            for begin, e, mark in line.marks:
                if mark[0] == ";" and lang != "el" or mark[0] in ";" and lang != "el":
                    continue
                at_end = e >= size
                if not at_end and not text[e].isspace() and not wide and text[e] != "​":
                    # inside a token (decimals, addresses, abbreviations), unless a clear mark or an opening one follows
                    if mark[0] in ".…;" or text[e].isalnum() or text[e] in ",-/":
                        continue
                if wide and not at_end and mark == "." and begin and text[e].isalnum() and text[begin - 1].isalnum():
                    continue
                rest = word_after(text, e) if not at_end else ""
                if not rest and follow is not None:
                    rest = word_after(follow[0].text)
                core = mark if len(mark) == 1 else mark.rstrip("\"'”“’»›」』）)]\x93\x94   ")
                quote = e - begin > 1 and not QUOTES.isdisjoint(mark)
                if self.is_end(lang, text, begin, core, quote, rest, line, follow, at_end, wide, mark, e):
                    out.append(line.end(e))
                    done = e
                    open_at = None
            tail = text[done:].strip(" ​\t  ")
            if tail and not (done and all(x in CLOSERS + OPENERS + "-–—.…" for x in tail)):
                open_at = line.end(len(text.rstrip("​ \t")))
                if self.closes(lang, line, document[c], i, follow):
                    out.append(open_at)
                    open_at = None
        if open_at is not None:
            out.append(open_at)
        return out

    def is_end(self, lang, text, at, core, quote, rest, line, follow, at_end, wide, mark, e) -> bool:
        if not rest:
            return True
        if wide:
            # a closed quotation that is reported goes on
            nxt = text[e : e + 1] if not at_end else follow[0].text.lstrip()[:1]
            return not (mark[-1] in "」』”" and nxt in "とっ")
        k = kind(rest)
        before = word_before(text, at)
        dotted = core in ("...", "…", "..", "\x85") or core.endswith("...") and core.strip(".") == "" or core.strip("…") == ""
        if dotted and core != ".":
            lead = (text[e:] if not at_end else follow[0].text).lstrip(" ​ ")
            if lead[:1] in ("…", "\x85") or lead[:2] == "..":
                return False
            if k == "lower":
                return False
            if k == "other" or not quote:
                return not self.goes_on(lang, before, rest)
            return True
        if quote:
            if k == "lower":
                return False
            if k == "other":
                return plain(rest) not in self.m.reports.get(lang, ())
            return True
        if core == ".":
            return self.dot(lang, before, rest)
        return True

    def closes(self, lang: str, line: Line, cue: list[Line], i: int, follow) -> bool:
        """Does a line whose last words have no final mark end a sentence there?"""
        if follow is None:
            return True
        nxt, same = follow[0], follow[2] == i + 1 and i + 1 < len(cue)
        if same:
            return False
        lead = nxt.text.lstrip(" ​")
        if lead[:1] == "…" or lead[:2] == "..":
            return False
        rest = word_after(nxt.text)
        if kind(rest) == "lower":
            return False
        if len(cue) > 1 and not line.turn:
            return False
        return not self.goes_on(lang, word_before(line.text, len(line.text)), rest)

    @staticmethod
    def page(text: str) -> str | None:
        """Code page of text that is all misread: by the places of each alphabet's commonest vowels."""
        ru, el = (sum(map(text.count, letters)) for letters in ("îàè", "ïáôé"))
        return None if max(ru, el) < 10 else PAGES["ru"] if ru > el else PAGES["el"]

    def cut(self, text: str | None, label: str | None) -> list[int]:
        """Place of the last character of each sentence of a document."""
        if not text or text.isspace():
            return []
        latin = language(text, label)
        page = None
        if not text.isascii() and _HIGH.search(text):
            cy, gr = len(_CYRILLIC.findall(text)), len(_GREEK.findall(text))
            tag = (label or "").strip().lower()[:2]
            page = PAGES["ru"] if cy > gr else PAGES["el"] if gr else PAGES.get(tag) or self.page(text)
        document = [x for x in (spoken(c, latin, page) for c in cues(text)) if x]
        return self.ends(document)


def sentence_ends(documents: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", counts: DataFrame | None = None) -> DataFrame:
    """(doc_id, sentence_ix, end_pos) of every sentence. counts: learned elsewhere; by default from these documents.

    The statistics that are shipped to the tasks hold words and word pairs that pass a significance test; they grow
    with the vocabulary around periods and capitals, not with the number of documents.
    """
    spark = documents.sparkSession
    counts = stored(learn(documents, text, lang), "sentence-counts") if counts is None else counts
    rows = decided(counts).toPandas().itertuples(index=False, name=None)
    model = spark.sparkContext.broadcast(Model.of(rows))
    schema = T.StructType([documents.schema[id_column], T.StructField("sentence_ix", T.IntegerType()), T.StructField("end_pos", T.IntegerType())])

    def run(batches):
        cutter = Cutter(model.value)
        for batch in batches:
            ids, ix, pos = [], [], []
            for d, t, label in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ends = cutter.cut(t, label)
                ids += [d] * len(ends)
                ix += range(len(ends))
                pos += ends
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(ix, pa.int32()), pa.array(pos, pa.int32())], names=schema.names)

    return documents.select(id_column, text, lang).mapInArrow(run, schema)
