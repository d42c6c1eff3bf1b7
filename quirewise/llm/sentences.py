"""Sentence spans of paragraphs in any script, chosen by semi-Markov dynamic programming.

Every span between two possible ends is scored as a whole: by how it closes (kind of end mark, the word before it), by the odds that
its first word opens sentences, by its length against the lengths of stretches between any marks, and by whether quotations and brackets
inside it are balanced; the best sequence of spans is taken, however many places a span covers. Opening words, abbreviations and
lengths aren't listed but learned from all texts: what begins paragraphs and follows long words with a full stop opens sentences; words
whose full stop is mostly followed by something else than an opening word are abbreviations.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Marks by kind.
STRONG, STOP, DOTS = "!?。！？؟।॥｡۔‼⁇⁈⁉။።፧։។៕།᠃", ".．", "…"
UNSPACED = "。！？｡။។៕།"  # of scripts that need no blank behind the mark
OPEN, CLOSE = "“„«「『‘(（[【《〈", "”“»」』’)）]】》〉"
PARTNERS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "〈": "〉"}
#: Least counts of an opening word and of an abbreviation, share of continuations of an abbreviation and of one of more than eight letters.
OPENER_N, SHORT_N, SHORT_SHARE, LONG_SHARE = 2, 3, 0.5, 0.8
#: Places of the tables of words: their size doesn't depend on the vocabulary. Steps of length, the last for all that is longer, and least
#: number of stretches from which lengths are learned.
PLACES, STEPS, LENGTHS_N = 1 << 20, 24, 200
#: Most that the opening word and the length may weigh.
OPEN_MOST, LENGTH_MOST = 1.5, 2.0

_END = re.compile(rf"[{re.escape(STRONG + STOP + DOTS)};]+")
_GAP = re.compile(r"\s*")
_WORD = re.compile(r"[^\W_]+(?:[.'’-][^\W_]+)*")
_INNER = re.compile(r" (?<=[^\W\d_A-Z] )([A-ZÀ-ÞĀ-ŽΑ-ΩЀ-Я][^\W\d_]*)")
_UNSPACED = re.compile("[\u0e00-\u0eff\u0f00-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")  # letters of scripts without blanks between words
_LAST = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*$")
_TIES = re.compile(rf"[{re.escape(OPEN + CLOSE)}]")
_THAI_GAP = re.compile(r"(?<=[฀-๿])\s+(?=[฀-๿])|(?<=[)”\"])\s+(?=[฀-๿])")
_SKIP = re.compile(rf"[\s{re.escape(OPEN)}\"¿¡—–-]*")


def first_word(text: str, at: int) -> str:
    """The word that opens the text from ``at``, behind quotation marks and brackets."""
    m = _WORD.match(text, _SKIP.match(text, at).end())
    return m.group() if m else ""


def _head(text: str, at: int) -> str:
    """The opening word, unless it is an initial."""
    w = first_word(text, at)
    return "" if len(w) == 1 and text.startswith(w + ".", _SKIP.match(text, at).end()) else w


def last_word(text: str, end: int) -> str:
    """The word, with inner stops, that ends at ``end``."""
    m = _LAST.search(text, max(0, end - 200), end)
    return m.group() if m else ""


def plain_lower(word: str) -> bool:
    """Whether a word is of small letters throughout and no symbol of one letter."""
    return len(word) > 1 and word[0].islower() and word.split("-")[0].islower() or word in ("a", "y", "e", "o", "à", "и", "в", "с", "к", "о", "у", "я", "ο", "η", "ή")


def places(word: str) -> tuple[int, int]:
    """The word's places by two hash functions, one in each half of a table."""
    raw = word.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) % PLACES, PLACES + zlib.crc32(raw, 0x5EED) % PLACES


class Words:
    """Values of words in a table by their places: of the two the one that fewer occurrences share, or nothing where one place is empty."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        self.values, self.counts = values, counts
        self.known: dict[str, float] = {}

    def get(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            a, b = places(word)
            got = float(self.values[a if self.counts[a] <= self.counts[b] else b]) if self.counts[a] and self.counts[b] else 0.0
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[word] = got
        return got

    def __contains__(self, word: str) -> bool:
        return self.get(word) > 0


def step(length: int) -> int:
    """Steps of length grow by a half each from four characters on."""
    return min(STEPS - 1, max(0, int(2 * math.log2(max(1, length))) - 3))


_TAIL = next(n for n in range(1, 1 << 20) if step(n) == STEPS - 1)  # from here on length makes no difference
_EVEN = [0.0] * _TAIL


class Marks:
    """What was learned: odds of opening words, abbreviations, and what a length says for a sentence."""

    def __init__(self, openers, short, lengths: list[float] | None = None):
        self.openers, self.short, self.lengths = openers, short, lengths or [0.0] * STEPS
        self.by_size = [self.lengths[step(n)] for n in range(_TAIL)]

    def opens(self, word: str) -> bool:
        return word in self.openers

    def odds(self, word: str) -> float:
        if isinstance(self.openers, Words):
            return min(OPEN_MOST, max(-OPEN_MOST, self.openers.get(word)))
        return 0.5 * (word in self.openers)

    def is_short(self, word: str) -> bool:
        """Whether a full stop after the word may well belong to the word."""
        return word in self.short or (len(word) == 1 and word.isalpha()) or "." in word or word.isdigit() or (len(word) <= 2 and word.isupper())


def _depths(text: str) -> tuple[dict[int, int], set[int]]:
    """Depth of quotations and brackets behind each mark, and where they close; marks without partner don't count."""
    stack: list[tuple[str, int]] = []
    ties: list[tuple[int, int]] = []
    for m in _TIES.finditer(text):
        c, i = m.group(), m.start()
        k = next((k for k in range(len(stack) - 1, -1, -1) if c in PARTNERS[stack[k][0]]), None)
        if k is not None and not (c == "“" and stack[k][0] != "„"):
            ties.append((stack[k][1], i))
            del stack[k:]
        elif c in PARTNERS:
            stack.append((c, i))
    out, depth = {}, 0
    for i, d in sorted([(a, 1) for a, _ in ties] + [(b, -1) for _, b in ties]):
        depth += d
        out[i] = depth
    return out, {b for _, b in ties}


def _shut(text: str, at: int, closing: set[int]) -> int:
    """Where the closing marks behind ``at`` end; a blank may stand before one."""
    while True:
        if at < len(text) and (at in closing or (text[at] in CLOSE and text[at] not in "“’")):
            at += 1
        elif at + 1 in closing and text[at].isspace():
            at += 2
        else:
            return at


def candidates(text: str, marks: Marks, closing: set[int]) -> list[tuple[int, int, float]]:
    """(end, next start, closing score) of all places where a sentence may end."""
    out = []
    for m in _END.finditer(text):
        end = _shut(text, m.end(), closing)
        start = _GAP.match(text, end).end()
        mark, shut, gap = m.group(), text[m.end() : end], text[end:start]
        if start >= len(text):
            continue
        follows, after = text[start], first_word(text, start)
        last = last_word(text, m.start())
        if ";" in mark and not (set(mark) <= {";"} and len(mark) == 1 and last[-1:] and "Ͱ" <= last[-1] <= "Ͽ" and after[:1].isupper()):
            if mark.strip(";") == "":
                continue
        if follows in ",，、;:،" or (shut and text.startswith("と", start) and not gap and shut[-1] in "」』"):
            continue
        lower = plain_lower(after)
        dots = DOTS in mark or ".." in mark or (mark == "." and text[m.start() - 2 : m.start()] == "..")
        strong = any(c in STRONG for c in mark)
        cjk = any(c in UNSPACED for c in mark) or (strong and follows >= "⺀")
        if not gap and not cjk and not shut:
            tight = mark == "." and len(last) >= 3 and last[1:].islower() and follows.isupper() and not marks.is_short(last) and text[start + 1 : start + 2].islower()
            if not tight and not strong:
                continue
            if strong and not (follows.isupper() or follows in OPEN):
                continue
        if not gap and shut and not cjk and not (follows in OPEN or follows.isupper()):
            continue
        if dots:
            score = 4.0 if after[:1].isupper() else -6.0
        elif lower:
            score = -6.0
        elif strong or ";" in mark:
            score = 5.0
        elif shut:
            name = len(after) == 1 and text.startswith(after + ".", _SKIP.match(text, start).end()) or len(after) > 1 and after in marks.short or re.match(r"(?:[^\W\d_]\.)+", text[start : start + 12]) is not None
            score = -3.0 if name else 4.0
        elif marks.is_short(last) and not (last.isdigit() and (len(last) > 2 or re.search(r"[.,=<>≤≥]\s?$", text[: m.start() - len(last)][-2:]))):
            score = 3.0 if marks.opens(_head(text, start)) and after[:1].isupper() and follows not in "([（" else -5.0
        else:
            score = 5.0
        if shut and (strong or dots) and after[:1].isupper() and re.match(r"(?:[^\W\d_]\.)+", text[start : start + 12]):
            score = -3.0
        elif shut and strong and len(after) > 1 and after in marks.short:
            score = -3.0
        out.append((end, start, score))
    for m in _THAI_GAP.finditer(text):
        out.append((m.start(), m.end(), 3.0))
    return sorted(set(out))


def split(text: str | None, marks: Marks) -> list[tuple[int, int]]:
    """The sentence spans of a text, without white space at their ends; none for a null or blank text."""
    if not text or text.isspace():
        return []
    body = len(text) - len(text.lstrip())
    stop = len(text.rstrip())
    depth_of, closed = _depths(text)
    cuts = [c for c in candidates(text, marks, closed) if body < c[0] < stop]
    if not cuts:
        return [(body, stop)]
    depth_at = sorted(depth_of.items())
    depths, k, d = [], 0, 0
    for end, _, _ in cuts:
        while k < len(depth_at) and depth_at[k][0] < end:
            d = depth_at[k][1]
            k += 1
        depths.append(d)
    starts = [body, *(c[1] for c in cuts)]
    ends = [*(c[0] for c in cuts), stop]
    closing = [*(c[2] for c in cuts), 0.0]
    opening = [0.0, *(0.5 * marks.odds(first_word(text, s)) for s in starts[1:])]
    ds, de = [0, *depths], [*depths, 0]
    n = len(ends)
    best, back = [0.0] + [-1e9] * n, [0] * (n + 1)
    bare = _UNSPACED.search(text) is not None
    weigh, tail = _EVEN if bare else marks.by_size, 0.0 if bare else marks.lengths[-1]
    near, far = 0, (-1e9, 0)  # spans from before ``near`` are so long that of them only the best start counts
    for j in range(n):
        while near <= j and ends[j] - starts[near] >= _TAIL:
            far = max(far, (best[near] + opening[near] - (10.0 if ds[near] else 0.0), -near))
            near += 1
        shut = closing[j] - (10.0 if de[j] else 0.0)
        top, at = far[0] + tail, -far[1]
        for i in range(near, j + 1):
            size = ends[j] - starts[i]
            v = best[i] + opening[i] - (10.0 if ds[i] else 0.0) + weigh[size] - (2.0 if size < 2 else 0.0)
            if v > top:
                top, at = v, i
        best[j + 1], back[j + 1] = top + shut, at
    spans, j = [], n
    while j > 0:
        i = back[j]
        spans.append((starts[i], ends[j - 1]))
        j = i
    return spans[::-1]


def _heads(t: str) -> list[str]:
    return [_head(t, 0), *(_head(t, m.end()) for m in re.finditer(r"[^\W\d_]{5,}[.!?]\s+(?=[^\W\d_])", t) if not t[m.start() : m.start() + 1].isupper())]


def learn(texts: DataFrame, text: str = "text") -> Marks:
    """Odds of opening words, abbreviations and lengths, counted over all rows into tables of fixed size."""
    found, sc = texts.select(text), texts.sparkSession.sparkContext

    def opening(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[int]] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if not t or t.isspace():
                    continue
                for k, found_ in ((0, _heads(t)), (1, _INNER.findall(t))):
                    for w in found_:
                        if w and "." not in w and (k == 0 or w[0].isupper()):
                            for at in places(w):
                                seen.setdefault(at, [0, 0])[k] += 1
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int32()), *(pa.array([x[k] for x in seen.values()], pa.int64()) for k in (0, 1))], ["place", "n", "inside"])

    rows = found.mapInArrow(opening, "place int, n long, inside long").groupBy("place").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside")).toArrow()  # at most 2 * PLACES
    n, inside = (np.zeros(2 * PLACES) for _ in range(2))
    n[rows.column("place").to_numpy()], inside[rows.column("place").to_numpy()] = rows.column("n").to_numpy(), rows.column("inside").to_numpy()
    odds = np.where((n >= OPENER_N) | (inside > 0), np.log((n + 0.5) / (inside + 0.5)), 0).astype("float32")
    odds[(odds > 0) & (n < OPENER_N)] = 0
    opens = Words(odds, (n + inside).astype("float32"))
    sent = sc.broadcast(opens)

    def closing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        openers = sent.value
        seen: dict[int, list[int]] = {}
        long = np.zeros((2, STEPS), "int64")  # of sentences between sure ends, of stretches between any marks
        for batch in batches:
            for t in batch.column(0).to_pylist():
                sure, mark, spaced = 0, 0, None
                for m in re.finditer(r"(?<![.])\.\s*(?=\S)", t) if t else ():
                    w = last_word(t, m.start())
                    if not w or not w[0].isalpha():
                        continue
                    after = first_word(t, m.end())
                    goes_on = t[m.end()] in ",;:)]" or plain_lower(after) or after[:1].isdigit() or (after[:1].isupper() and after not in openers)
                    for at in places(w):
                        x = seen.setdefault(at, [0, 0, 0])
                        x[0] += 1
                        x[1] += goes_on
                        x[2] = max(x[2], len(w))
                    if spaced is None:
                        spaced = not _UNSPACED.search(t)
                    if not spaced:  # lengths are those of scripts with blanks between words
                        continue
                    long[1, step(m.start() + 1 - mark)] += 1
                    mark = m.end()
                    if not goes_on and len(w) > 4 and w.islower():
                        long[0, step(m.start() + 1 - sure)] += 1
                        sure = m.end()
        lengths = [(-1 - k * STEPS - j, int(v), 0, 0) for k in (0, 1) for j, v in enumerate(long[k]) if v]
        got = [(k, *x) for k, x in seen.items()] + lengths
        yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int32() if k in (0, 3) else pa.int64()) for k in range(4)], ["place", "n", "on", "size"])

    rows = found.mapInArrow(closing, "place int, n long, on long, size int").groupBy("place").agg(F.sum("n").alias("n"), F.sum("on").alias("on"), F.max("size").alias("size")).toArrow()
    at, n, on, size = (rows.column(c).to_numpy() for c in ("place", "n", "on", "size"))
    short, often = np.zeros(2 * PLACES, "int8"), np.zeros(2 * PLACES, "float32")
    often[at[at >= 0]] = n[at >= 0]
    is_short = (at >= 0) & (n >= SHORT_N) & (on >= n * np.where(size > 8, LONG_SHARE, SHORT_SHARE))
    short[at[is_short]] = 1
    counts = np.zeros(2 * STEPS)
    counts[-1 - at[at < 0]] = n[at < 0]
    own, any_ = counts[:STEPS], counts[STEPS:]
    weigh = [0.0] * STEPS
    if own.sum() >= LENGTHS_N:
        ratio = np.log((own + 1) / (own.sum() + STEPS)) - np.log((any_ + 1) / (any_.sum() + STEPS))
        weigh = np.clip(ratio, -LENGTH_MOST, LENGTH_MOST).tolist()
    return Marks(opens, Words(short, often), weigh)


def sentence_spans(rows: DataFrame, keys: tuple[str, ...] = ("paper_id", "paragraph_id"), text: str = "text", formatted: str | None = None) -> DataFrame:
    """(keys, start_pos, end_pos[, sentence]) of every sentence; positions count code points, ``end_pos`` is excluded.

    Null and blank texts have no row; of rows with the same key one counts; an empty table gives no row. With ``formatted`` the
    column of that name (XML of the text) serves where the text is null, its tags taken off first.
    """
    body = F.col(text)
    if formatted:
        plain = F.regexp_replace(F.regexp_replace(F.col(formatted), r"(?s)^\s*<p[^>]*>|</p>\s*$", ""), "<[^>]+>", "")
        for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            plain = F.replace(plain, F.lit(entity), F.lit(c))
        body = F.coalesce(body, plain)
    data = rows.select(*keys, body.alias("text")).dropDuplicates(list(keys))
    marks = rows.sparkSession.sparkContext.broadcast(learn(data))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            got = [(i, a, b, texts[i][a:b]) for i, t in enumerate(texts) for a, b in split(t, marks.value)]
            at = pa.array([g[0] for g in got], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32()), pa.array([g[3] for g in got], pa.string())], [*keys, "start_pos", "end_pos", "sentence"])

    kinds = ", ".join(f"{k} {data.schema[k].dataType.simpleString()}" for k in keys)
    return data.mapInArrow(cut, f"{kinds}, start_pos int, end_pos int, sentence string")
