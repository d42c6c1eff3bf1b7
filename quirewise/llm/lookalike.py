"""One consistent form for texts that look alike but differ in their characters.

Ignorable characters go, widths, blanks and ligatures are normalised, and every letter is reduced to its class of look-alike
letters. Over the classes of a token lies a lattice of its possible spellings in four scripts; Viterbi picks the one of the
highest character bigram score, with a price for changing script. As the lattice is made from the classes alone, texts of equal
look always get the same form, and as a form can be reduced to its classes again, texts of different look never do.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewise.runtime import materialise

# Letters that are printed alike, by class; the first names the class (Latin, Greek, Cyrillic, Armenian letters).
CLASSES = """
aа cс dԁ eе hһհ iі jјϳ lӏ oοоօ pр qԛ sѕ uս wԝ xх yу nո
AΑА BΒВ CСϹ EΕЕ FϜ GԌ HΗН IΙІ JЈͿ KΚК MΜМ NΝ OΟОՕ PΡР QԚ SЅՏ TΤТ VѴ WԜ XΧХ YΥҮ ZΖ
ΓГ ΠП ΦФ
""".split()
# Characters that leave no trace in print, besides the format characters (category Cf).
INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
# Format characters that are visible.
VISIBLE_FORMAT = [*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD]
# Ranges of compatibility characters that look like the letters or dots they stand for.
SAME_LOOK = [(0x00B5, 0x00B5), (0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2024, 0x2026), (0x2160, 0x217F), (0xFB00, 0xFB06), (0xFB13, 0xFB17)]
SCRIPT_PRICE, OFF_SCRIPT_PRICE = 9.0, 2.5

SCRIPTS = {"L": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)), "G": ((0x370, 0x3FF),), "C": ((0x400, 0x52F),), "A": ((0x531, 0x58F),)}


def script_of(c: str) -> str:
    o = ord(c)
    return next((s for s, spans in SCRIPTS.items() if any(a <= o <= b for a, b in spans)), "")


def _fold_table() -> dict[int, str | None]:
    out: dict[int, str | None] = {}
    for o in range(sys.maxunicode + 1):
        c = chr(o)
        kind = unicodedata.category(c)
        if kind in ("Zs", "Zl", "Zp") or c in "\t\n\v\f\r\x85":
            out[o] = " "
        elif kind == "Cc" or (kind == "Cf" and o not in VISIBLE_FORMAT):
            out[o] = None
        elif (d := unicodedata.decomposition(c)).startswith(("<wide>", "<narrow>", "<noBreak>")) or (d.startswith("<compat>") and any(a <= o <= b for a, b in SAME_LOOK)):
            out[o] = unicodedata.normalize("NFKD", c)
    out |= dict.fromkeys(INVISIBLE)
    return out | {0x2010: "-", 0x2011: "-"}


_tables: dict = {}
_TOKEN = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")
_FOREIGN = re.compile("[Ͱ-ϿЀ-ԯԱ-֏]")


def _table(name: str):
    if not _tables:
        _tables["fold"] = _fold_table()
        _tables["class"] = {ord(c): x[0] for x in CLASSES for c in x[1:]}
        _tables["members"] = {x[0]: x for x in CLASSES}
    return _tables[name]


def skeleton(text: str) -> str:
    """The classes of the visible characters of a text, decomposed, with single blanks and none at the ends."""
    t = text.translate(_table("fold"))
    return " ".join(unicodedata.normalize("NFD", t).translate(_table("class")).split(" ")).strip() if "  " not in t else " ".join(x for x in unicodedata.normalize("NFD", t).translate(_table("class")).split(" ") if x)


class Speller:
    """Spells skeletons by a model of character bigrams: {(first or "", second): count}."""

    def __init__(self, bigrams: dict[tuple[str, str], int]):
        self.n = bigrams
        self.total: dict[str, float] = {}
        for (a, _), n in bigrams.items():
            self.total[a] = self.total.get(a, 0) + n
        self.token = lru_cache(200_000)(self._token)

    def _score(self, a: str, b: str) -> float:
        return math.log((self.n.get((a, b), 0) + 0.05) / (self.total.get(a, 0) + 20))

    def _token(self, token: str, main: str) -> str:
        members = _table("members")
        best: dict[str, tuple[float, str]] = {}  # by the last letter: score and spelling
        for c in token:
            if unicodedata.combining(c):
                best = {k: (s, x + c) for k, (s, x) in best.items()}
                continue
            now: dict[str, tuple[float, str]] = {}
            for m in members.get(c, c):
                sm = script_of(m)
                off = OFF_SCRIPT_PRICE * (sm != main) * (sm != "")
                if not best:
                    now[m] = (self._score("", m) - off, m)
                    continue
                now[m] = max((s + self._score(k, m) - off - SCRIPT_PRICE * (script_of(k) != sm), x + m) for k, (s, x) in best.items())
            best = now
        return max(best.values())[1] if best else token

    def form(self, text: str) -> str:
        """The consistent form of a text."""
        s = skeleton(text)
        if not _FOREIGN.search(s):
            return unicodedata.normalize("NFC", s)
        n = {k: 0 for k in SCRIPTS}
        members = _table("members")
        for c in s:
            if c not in members and (k := script_of(c)):
                n[k] += 1
        main = max(n, key=lambda k: n[k])
        return unicodedata.normalize("NFC", _TOKEN.sub(lambda m: self.token(m.group(), main), s))


def _alphabet() -> tuple[np.ndarray, list[str]]:
    """Code point -> number of its base letter (0: no letter of the four scripts), and the letters by number."""
    letters, at, numbers = [""], {}, np.zeros(0x10000, "int64")
    for o in range(0x10000):
        b = unicodedata.normalize("NFD", chr(o))[0]
        if b.isalpha() and script_of(b):
            if b not in at:
                at[b] = len(letters)
                letters.append(b)
            numbers[o] = at[b]
    return numbers, letters


def bigrams(texts: DataFrame, text: str = "text") -> dict[tuple[str, str], int]:
    """Counts of letter pairs over all rows; at most the square of the letters of four scripts, so small enough to collect."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, letters = _alphabet()
        k, total = len(letters), None
        for batch in batches:
            got = "\x00".join(t for t in batch.column(0).to_pylist() if t)
            x = np.frombuffer(got.encode("utf-32-le", "replace"), "uint32")
            x = numbers[np.where(x > 0xFFFF, 0, x)]
            x = np.concatenate([[0], x])
            n = np.bincount(x[:-1] * k + x[1:], minlength=k * k)
            total = n if total is None else total + n
        if total is not None:
            pairs = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(total[pairs])], ["pair", "n"])

    _, letters = _alphabet()
    rows = texts.select(text).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    k = len(letters)
    return {(letters[r["pair"] // k], letters[r["pair"] % k]): r["n"] for r in rows if r["pair"] % k}


def consistent_forms(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, text, form): the consistent form of every text.

    A null text has a null form, a text without visible characters an empty one; repeated rows stay. Texts of printable ASCII
    are their own form but for blanks, so only the others leave the JVM.
    """
    model = rows.sparkSession.sparkContext.broadcast(bigrams(rows, text))
    base = rows.select(*keys, F.col(text).alias("text"))
    plain = F.col("text").isNull() | (F.octet_length("text") == F.char_length("text"))
    ascii_form = F.trim(F.regexp_replace(F.regexp_replace("text", r"[\x00-\x08\x0e-\x1f\x7f]", ""), r"[ \t-\r]+", " "))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(model.value)
        for batch in batches:
            forms = [speller.form(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forms, pa.string())], [*batch.schema.names, "form"])

    out = base.withColumn("form", F.lit(None).cast("string")).schema
    return base.filter(plain).withColumn("form", ascii_form).unionByName(base.filter(~plain).mapInArrow(spell, out))


def alike_pairs(rows: DataFrame, group: str = "paper_id", item: str = "text_id", text: str = "text") -> DataFrame:
    """(group_a, item_a, group_b, item_b): pairs of rows whose texts look alike and aren't equal, the smaller key first.

    Null texts and texts without visible characters belong to no pair; repeated rows of a key count once. Many equal copies of a
    text stay one entry until the last join, by which they are spread over tasks.
    """
    kept = consistent_forms(rows, [group, item], text).filter(F.length("form") > 0)
    coded = materialise(kept.select(F.col(group).alias("g"), F.col(item).alias("i"), F.unhex(F.md5("form")).alias("f"), F.unhex(F.md5("text")).alias("t")))
    mixed = coded.groupBy("f").agg(F.min("t").alias("a"), F.max("t").alias("b")).filter("a <> b").select("f")
    cases = materialise(coded.join(mixed, "f", "left_semi").distinct())
    texts = cases.select("f", "t").distinct()
    salts = 16
    salted = cases.withColumn("salt", F.pmod(F.hash("g", "i"), F.lit(salts)))
    pairs = texts.join(texts.withColumnRenamed("t", "u"), "f").filter(F.col("t") < F.col("u"))
    left = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).join(salted, ["f", "t", "salt"]).select("f", "u", F.struct("g", "i").alias("x"))
    right = salted.select("f", F.col("t").alias("u"), "salt", F.struct("g", "i").alias("y"))
    both = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).join(right, ["f", "u", "salt"])
    lo, hi = F.least("x", "y"), F.greatest("x", "y")
    return both.select(lo["g"].alias(f"{group}_a"), lo["i"].alias(f"{item}_a"), hi["g"].alias(f"{group}_b"), hi["i"].alias(f"{item}_b"))
