"""References matched with the records of a register without common keys.

Candidates share a MinHash band across attributes: title words alone, title words with a surname, title words with the year, surnames with
the year. Each hash function draws the words of a title in an order of its own, rarer words sooner, and a band takes as many of the first
ones as it needs for the register to hold but a few works with all of them by chance; so the bands grow finer with the register and the
pairs grow with the rows, not with their square. Beside them stand ways without chance: whole titles, their first words with a surname or
the year. Years must be compatible. Pairs get similarity features of title, authors, year and container; a logistic classifier is
fitted on weakly labelled pairs, its probabilities are calibrated on held-out pairs, and of competing editions the nearest in time is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirewise.llm.names import agree_org, flat, fold, lcs_ratio, parse
from quirewise.runtime import materialise

#: MinHash bands: of title words, of title words with a surname, of title words with the year; words that a band holds at most.
TITLE_BANDS, NAME_BANDS, YEAR_BANDS, DEPTH = 12, 5, 5, 5
#: Works that a band may hold by chance, and the share of works of two years in a row, by which that is estimated.
EXPECTED, YEAR_SHARE = 3.0, 0.05
#: Places of the table of word counts: its size doesn't depend on the vocabulary, words that fall together add up on both sides alike.
PLACES = 1 << 20
#: Labelled pairs that the classifier sees at most: they are collected, so their number is bounded.
SAMPLE = 20_000
# Words that set a work apart from another of the same name.
MARKERS = set("reply response comment rejoinder erratum corrigendum correction addendum supplement edition ed part volume vol wave study first second third fourth fifth revisited revised i ii iii iv v vi 1 2 3 4 5 6".split())
# Words that shortened names of containers leave out.
_SMALL = {"of", "the", "and", "in", "for", "o"}
FEATURES = ["title", "contained", "marker", "no_title", "authors", "first", "no_authors", "year0", "year1", "year_digit", "no_year", "container", "no_container", "all_else"]


def title_words(title: str | None) -> list[str]:
    """Folded words of a title without markup; words broken by a hyphen are joined."""
    t = re.sub(r"<[^>]*>", "", title or "")
    t = re.sub(r"(?<=\w)-\s?(?=[^\W\d_])", "", t).replace("&", " and ")
    return re.findall(r"[^\W_]+", fold(t).replace("'", ""))


def surnames(authors: list[str] | None) -> list[str]:
    """The surname of each author; an organisation's words, with blanks between."""
    return [p for a in authors or () if a and (p := _surname(a.strip(" ")))]


@lru_cache(200_000)
def _surname(name: str) -> str | None:
    p = parse(name)
    return p and (flat(p[1]) if p[0] == "p" else p[2])


@lru_cache(200_000)
def same_author(s: str, t: str) -> bool:
    """Whether two surnames or organisations agree, but for a misprint or a shortening."""
    if s == t:
        return True
    if " " in s or " " in t:
        return " " in s and " " in t and agree_org(s, t) > 0
    u, v = sorted((s, t), key=lambda x: "." not in x)
    if u.endswith("."):
        return len(u) > 5 and v.startswith(u[:-1])
    return min(len(s), len(t)) > 4 and lcs_ratio(s, t) >= 0.8


def compare_titles(a: list[str], b: list[str], cut: bool) -> tuple[float, float, float]:
    """(likeness by letters, share of the shorter found in the longer, whether marking words differ)."""
    left, only_a = list(b), []
    same = 0
    for w in a:
        if w in left:
            left.remove(w)
            same += len(w)
        else:
            only_a.append(w)
    la, lb = sum(map(len, a)), sum(map(len, b))
    ja, jb = "".join(only_a), "".join(left)
    like = lcs_ratio(ja, jb) * (len(ja) + len(jb)) / 2 if ja and jb else 0
    like = like if like > 0.7 * min(len(ja), len(jb)) else 0
    ma, mb = MARKERS & set(only_a), MARKERS & set(left)
    differ = (ma ^ mb) if not cut else ma - mb
    return 2 * (same + like) / max(1, la + lb), (same + like) / max(1, min(la, lb)), float(bool(differ))


@lru_cache(200_000)
def compare_containers(first: str, second: str) -> float:
    """1 for the same words, less for shortened ones or initials."""
    a, b = [w for w in first.split() if w != "the"], [w for w in second.split() if w != "the"]
    short, long = sorted((a, b), key=lambda x: len("".join(x)))
    if len(short) == 1 and len(long) > 1 and short[0] in ("".join(w[0] for w in long), "".join(w[0] for w in long if w not in _SMALL)):
        return 0.9
    a, b = [w for w in a if w not in _SMALL], [w for w in b if w not in _SMALL]
    if not a or not b:
        return 0.5
    if a == b:
        return 1.0
    s, t = sorted((a, b), key=lambda x: len("".join(x)))
    if len(s) == len(t):
        got = [1.0 if x == y else 0.9 if y.startswith(x) or x.startswith(y) else lcs_ratio(x, y) for x, y in zip(s, t)]
        return min(got) * 0.5 + sum(got) / len(got) * 0.5 if min(got) > 0.6 else 0.2 * sum(got) / len(got)
    return 0.5 * len(set(a) & set(b)) / max(len(a), len(b))


def features(x: tuple, y: tuple) -> list[float]:
    """The numbers that describe a pair: x a reference, y a record, each (words, cut, names, year, container) with strings of
    words parted by blanks and of names parted by semicolons."""
    (wa, cut, na, xa, ca), (wb, _, nb, xb, cb) = x, y
    title, contained, marker = (1.0, 1.0, 0.0) if wa and wa == wb else compare_titles(wa.split(), wb.split(), cut) if wa and wb else (0.5, 0.5, 0.0)
    if na and na == nb:
        authors, first = 1.0, 1.0
    elif na and nb:
        sa, sb = na.split(";"), nb.split(";")
        hit = sum(any(same_author(s, t) for t in sb) for s in sa)
        back = sum(any(same_author(s, t) for s in sa) for t in sb)
        authors, first = max(hit / len(sa), back / len(sb)), float(same_author(sa[0], sb[0]))
    else:
        authors, first = 0.5, 0.5
    d = abs(xa - xb) if xa is not None and xb is not None else None
    container = compare_containers(ca, cb) if ca and cb else 0.5
    all_else = not (wa and wb) and authors > 0.66 and bool(na and nb) and d in (0, 1) and container > 0.8
    return [title, contained, marker, float(not (wa and wb)), authors, first, float(not (na and nb)), float(d == 0), float(d == 1), float(d is not None and d > 1), float(d is None), container, float(not (ca and cb)), float(all_else)]


def weak_label(f: list[float]) -> int | None:
    """1 where several attributes agree and none speaks against, 0 where one plainly does, else null."""
    g = dict(zip(FEATURES, f))
    if g["marker"] or (not g["no_title"] and g["contained"] < 0.6) or (not g["no_authors"] and g["authors"] < 0.34):
        return 0
    agree = (g["title"] > 0.9) + (g["authors"] > 0.66) + g["year0"] + (g["container"] > 0.8)
    near = g["title"] > 0.95 and (g["year0"] or g["year1"]) and (g["no_container"] or g["container"] > 0.5)
    return 1 if agree >= 3 or near else None


class Logistic:
    """Logistic regression by Newton steps with a ridge, and a monotone calibration on pairs it hasn't seen."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        fit = np.arange(len(y)) % 4 != 0
        self.w = self._newton(x[fit], y[fit], ridge)
        self.knots, self.values = self._isotonic(self.raw(x[~fit]), y[~fit])

    @staticmethod
    def _newton(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
        x = np.c_[np.ones(len(x)), x]
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve(x.T * (p * (1 - p)) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        return w

    @staticmethod
    def _isotonic(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(p, kind="stable")
        blocks: list[list[float]] = []
        for s, v in zip(p[order], y[order]):
            blocks.append([v, 1, s])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                v2, n2, s2 = blocks.pop()
                blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + n2, s2]
        if not blocks:
            return np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return np.array([0.0] + [b[2] for b in blocks] + [1.0]), np.array([0.0] + [(b[0] + 0.5) / (b[1] + 1) for b in blocks] + [1.0])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(x)), x] @ self.w, -30, 30)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return np.interp(self.raw(x), self.knots, self.values)


def word_counts(register: DataFrame) -> Broadcast:
    """How many works have each title word and each surname, in a table of fixed size by their hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PLACES, "int64")
        for batch in batches:
            for column, sep, stem in (("words", " ", ""), ("names", ";", ";")):
                seen = [stem + w for t in batch.column(column).to_pylist() for w in set(t.split(sep)) if w]
                total += np.bincount(_code(seen) % np.uint64(PLACES), minlength=PLACES)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["place", "n"])

    rows = register.select("words", "names").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(PLACES)
    table[rows.column("place").to_numpy()] = rows.column("n").to_numpy()
    return register.sparkSession.sparkContext.broadcast(table)


def _code(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, object), categorize=False)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(salt * 2654435761)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


class _Draws:
    """Of each row of a list of word lists the words that each of ``n`` hash functions draws first, rarer ones sooner."""

    def __init__(self, lists: list[list[str]], counts: np.ndarray, n: int, depth: int, salt: int):
        flat_, sizes = [w for x in lists for w in x], np.fromiter(map(len, lists), "int64", len(lists))
        codes, known = pd.factorize(np.array(flat_, object))
        self.h = _code(list(known)) if len(known) else np.empty(0, "uint64")
        self.f = counts[(self.h % np.uint64(PLACES)).astype("int64")] if len(known) else np.empty(0)
        row = np.repeat(np.arange(len(lists)), sizes)
        both = np.unique(row * max(1, len(known)) + codes)  # each word of a row once
        row, word = both // max(1, len(known)), both % max(1, len(known))
        keep = self.f[word] > 0  # what the register lacks can't meet anything
        row, word = row[keep], word[keep]
        self.rows = len(lists)
        self.first = np.full((depth, n, self.rows), -1, "int64")
        if not len(row):
            return
        at = np.nonzero(np.r_[True, row[1:] != row[:-1]])[0]
        owner, group = row[at], np.cumsum(np.r_[0, row[1:] != row[:-1]])
        for d in range(n):
            u = ((_mixed(self.h, salt + d) >> np.uint64(11)).astype("float64") + 1) / 2.0**53
            order = np.argsort(-np.log(u) * self.f, kind="stable")
            rank = np.empty(len(order), "int64")
            rank[order] = np.arange(len(order))
            left = rank[word]
            for k in range(depth):
                least = np.minimum.reduceat(left, at)
                some = least < len(order)
                if not some.any():
                    break
                self.first[k, d, owner[some]] = order[least[some]]
                left = np.where(left == least[group], len(order), left)

    def keys(self, d: int, start: np.ndarray, works: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray]:
        """Keys from ``start`` and as many of the words drawn by function d as it takes to come down to EXPECTED works or fewer, and which rows have any."""
        key, works, used = start.copy(), works.copy(), np.zeros(self.rows, bool)
        for k in range(self.first.shape[0]):
            w = self.first[k, d]
            use = (w >= 0) & ((works > EXPECTED) | ~used)
            with np.errstate(over="ignore"):
                key[use] += _mixed(self.h[w[use]], 101)
            works[use] *= self.f[w[use]] / n
            used |= use
        return key, used


def _bands(forms: DataFrame, counts: Broadcast, n: int, register: bool) -> DataFrame:
    """(id, year, band): hashes under which works meet. References that have a title don't use what is there for those without."""
    n_works = float(max(1, n))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [t.split() for t in batch.column("words").to_pylist()]
            names = [[";" + a for a in dict.fromkeys(t.split(";")) if a] for t in batch.column("names").to_pylist()]
            year = np.array([-1 if y is None else y for y in batch.column("year").to_pylist()], "int64")
            size, dated = len(words), year >= 0
            rows, keys = [], []

            def add(has: np.ndarray, key: np.ndarray, tag: int) -> None:
                rows.append(np.nonzero(has)[0])
                keys.append(_mixed(key[has], tag))

            def both_years(has: np.ndarray, key: np.ndarray, tag: int) -> None:
                for y in (0, 1):
                    with np.errstate(over="ignore"):
                        add(has & dated, key + _mixed((year + y).view("uint64"), 7), tag)

            zero = np.zeros(size, "uint64")
            t = _Draws(words, counts.value, TITLE_BANDS, DEPTH, 1)
            a = _Draws(names, counts.value, NAME_BANDS, 2, 301)
            some = np.array([bool(w) for w in words])
            for d in range(TITLE_BANDS):
                key, used = t.keys(d, zero, np.full(size, n_works), n_works)
                add(used, key, 1)
            for d in range(YEAR_BANDS):
                key, used = t.keys(d, zero, np.full(size, n_works * YEAR_SHARE), n_works)
                both_years(used, key, 2)
            for d in range(NAME_BANDS):
                w = a.first[0, d]
                own = np.where(w >= 0, a.h[w] if len(a.h) else 0, 0).astype("uint64")
                key, used = t.keys(d, own, np.where(w >= 0, a.f[w] if len(a.f) else 0, 0), n_works)
                add(used & (w >= 0), key, 3)
            for d in range(2):  # surnames with the year: as many as it takes
                key, used = a.keys(d, zero, np.full(size, n_works * YEAR_SHARE), n_works)
                both_years(used, key, 4)
            whole = _code([" ".join(w) for w in words])
            add(some, whole, 5)
            lead = _code([" ".join([x for x in w if len(x) > 2][:2]) for w in words])
            both_years(some, lead, 6)
            each = np.array([(i, j) for i, x in enumerate(names) for j in range(len(x))], "int64").reshape(-1, 2)
            own = _code([x for y in names for x in y])
            has = some[each[:, 0]]
            rows.append(each[has, 0])
            with np.errstate(over="ignore"):
                keys.append(_mixed(lead[each[has, 0]] + own[has], 7))
            add(some if register else some & ~dated, lead, 8)
            add(some & ~dated & np.array([not x for x in names], bool) if register else some, lead, 10)
            bare = np.ones(size, bool) if register else ~some
            has = bare[each[:, 0]] & dated[each[:, 0]]
            for y in (0, 1):
                rows.append(each[has, 0])
                with np.errstate(over="ignore"):
                    keys.append(_mixed(own[has] + _mixed((year[each[has, 0]] + y).view("uint64"), 7), 9))
            row, key = np.concatenate(rows), np.concatenate(keys).view("int64")
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            new = np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])] if len(row) else np.empty(0, bool)
            at = pa.array(row[new])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("year").take(at), pa.array(key[new])], ["id", "year", "band"])

    return forms.select("id", "words", "names", "year").mapInArrow(cut, "id long, year int, band long")


def _read(rows: DataFrame) -> DataFrame:
    """(id, words, cut, names, year, container): what is compared, read from the attributes once for each row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            titles, authors, containers = (batch.column(c).to_pylist() for c in ("title", "authors", "container"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array([" ".join(title_words(t)) for t in titles], pa.string()), pa.array([(t or "").rstrip("”\" ").endswith(("...", "…")) for t in titles], pa.bool_()),
                    pa.array([";".join(surnames(a)) for a in authors], pa.string()), batch.column("year"), pa.array([_container(c) for c in containers], pa.string()),
                ],
                ["id", "words", "cut", "names", "year", "container"],
            )

    return rows.select("id", "title", "authors", "year", "container").mapInArrow(read, "id long, words string, cut boolean, names string, year int, container string")


@lru_cache(200_000)
def _container(name: str | None) -> str:
    return " ".join(title_words(name))


def _compatible(a: Column, b: Column) -> Column:
    """Whether two years may stand for one: either is missing, they are at most one apart, or a decade or one digit but the last
    is wrong, as by a misprint (a wrong last digit can't be told from another edition)."""
    x, y = F.lpad(a.cast("string"), 4, "0"), F.lpad(b.cast("string"), 4, "0")
    differ = sum(((F.substr(x, F.lit(i), F.lit(1)) != F.substr(y, F.lit(i), F.lit(1))).cast("int") for i in (1, 2, 3)), F.lit(0))
    return a.isNull() | b.isNull() | (F.abs(a - b) <= 1) | ((a % 10 == b % 10) & ((differ == 1) | (F.abs(a - b) == 10)))


def match(references: DataFrame, register: DataFrame, key: tuple[str, str] = ("paper_id", "bib_id"), least: float = 0.5) -> DataFrame:
    """(key, record_id, confidence): the records of the same work for each reference, from the columns title, authors, year and container.

    ``references`` hold authors as text between semicolons, ``register`` as an array. Any of the attributes may be null; without
    title and authors there is no match. Repeated rows of a key count once; empty tables give no row.
    """
    ref = references.select(*key, "title", F.split("authors", ";").alias("authors"), F.col("year").cast("int").alias("year"), "container").withColumn("id", F.xxhash64("title", "authors", "year", "container"))
    forms = materialise(_read(ref.dropDuplicates(["id"])))
    reg = materialise(_read(register.select(F.col("record_id").alias("id"), "title", "authors", F.col("year").cast("int").alias("year"), "container")))
    n, counts = reg.count(), word_counts(reg)
    theirs = _bands(reg, counts, n, True).withColumnsRenamed({"id": "rid", "year": "year2"})
    met = _bands(forms, counts, n, False).join(theirs, "band").filter(_compatible(F.col("year"), F.col("year2"))).select("id", "rid").distinct()
    parts = ["words", "cut", "names", "year", "container"]
    pairs = met.join(forms, "id").join(reg.select(F.col("id").alias("rid"), *[F.col(c).alias(f"{c}2") for c in parts]), "rid")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = ([batch.column(f"{c}{k}").to_pylist() for c in parts] for k in ("", "2"))
            f = [features(x, y) for x, y in zip(zip(*one), zip(*two))]
            off = [abs(a - b) if a is not None and b is not None else None for a, b in zip(one[3], two[3])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("rid"), pa.array(f, pa.list_(pa.float64())), pa.array([weak_label(v) for v in f], pa.int32()), batch.column("year2"), pa.array(off, pa.int32())],
                ["id", "rid", "f", "label", "year", "off"],
            )

    scored = materialise(pairs.select("id", "rid", *parts, *[f"{c}2" for c in parts]).mapInArrow(measure, "id long, rid long, f array<double>, label int, year int, off int"))
    labelled = scored.filter("label IS NOT NULL")
    per = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(per) < 2:
        return _back(ref, labelled.filter("label = 1").withColumn("p", F.lit(1.0)), key)
    order = F.xxhash64("id", "rid")
    halves = [labelled.filter(F.col("label") == v).orderBy(order).limit(SAMPLE // 2) for v in (0, 1)]
    train = halves[0].unionByName(halves[1]).select("f", "label", order.alias("o")).toPandas().sort_values("o")
    model = Logistic(np.array(train["f"].tolist()), train["label"].to_numpy(float))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("rid"), batch.column("year"), batch.column("off"), pa.array(x[:, FEATURES.index("marker")]), pa.array(model.probability(x)), pa.array(model.raw(x))], ["id", "rid", "year", "off", "marker", "p", "raw"])

    likely = scored.select("id", "rid", "f", "year", "off").mapInArrow(judge, "id long, rid long, year int, off int, marker double, p double, raw double").filter(F.col("p") >= least)
    # of editions years apart the nearest to the reference stays; without a year on either side the more probable
    best = Window.partitionBy("id").orderBy(F.coalesce("off", F.lit(99)), F.desc("raw"), "rid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    alike = likely.filter(F.col("marker") == 0)  # an exact check after the classifier: a reply, part or edition is another work by definition
    kept = alike.withColumn("y0", F.first("year", True).over(best)).filter("year IS NULL OR y0 IS NULL OR abs(year - y0) <= 1")
    return _back(ref, kept, key)


def _back(ref: DataFrame, kept: DataFrame, key: tuple[str, str]) -> DataFrame:
    return ref.select(*key, "id").distinct().join(kept.select("id", F.col("rid").alias("record_id"), "p"), "id").groupBy(*key, "record_id").agg(F.max("p").alias("confidence"))
