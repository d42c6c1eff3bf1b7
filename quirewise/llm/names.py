"""Spellings of names linked to one entity each, by suffix blocking and longest common subsequences.

A spelling is read into a form: surname and given names of a person, or the words of an organisation, folded to plain small
letters. Forms that share a suffix of a token and the initial of the given name are compared. A suffix that too many forms have counts
only together with the first letter of its token, then with three; what is too common even so is discarded, while the longer suffixes of
the token and the whole of it stand in any case. Pairs are compared by the ratio of their longest common subsequence; each form
then joins the best documented form it agrees with, and works both are cited for count first.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirewise.runtime import materialise

# Letters without a decomposition.
FOLD = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ı": "i", "ħ": "h", "’": "'", "1": "l", "0": "o"})
# Particles of surnames.
PARTICLES = set("de da do dos das del della di du la le van von der den ter ten zu zur el al bin ibn af av".split())
# Given names with their short forms.
NICKNAMES = """
alexander: sasha alex sascha xander; alexandra: sandra sasha; anthony: tony; antonio: toni tonio tono nino; barbara: babs; benjamin: ben benny;
catherine: cathy kate; charles: charlie chuck; christopher: chris kit; christine: chris tina; daniel: dan danny; david: dave; dmitri: dima mitya;
dorothy: dot dolly; edith: edie; edward: ed ned ted eddie; elizabeth: liz beth betty lisa eliza; francisco: paco pancho kiko; friedrich: fritz;
giuseppe: beppe pino peppe; gustav: gus; heinrich: heinz heiner; helen: nell; henry: harry hank; hugo: huw; james: jim jimmy jamie;
jennifer: jenny jen; johannes: hannes hans; john: jack johnny; jose: pepe; joseph: joe joey; juan: juanito; jurgen: jurg; katherine: kathy kate katie kat;
kenneth: ken; leonard: len leo; lawrence: larry; ludwig: lutz; margaret: peggy maggie meg; maria: mia; matthew: matt; mehmet: memo;
michael: mike mick; nicholas: nick nico; omar: omi; oscar: ossie; patricia: pat patty trish tricia; pavel: pasha; peter: pete; philip: phil;
rebecca: becky; richard: dick rick rich; robert: bob rob bobby bert; samuel: sam sammy; sergei: seryozha; stephen: steve; susan: sue susie; susanna: sue susie susi; svetlana: sveta;
theodore: ted theo; thomas: tom tommy tomas; timothy: tim; tomas: tomi tom; victoria: vicky vic; vladimir: volodya vova; wilhelm: willi willy; william: bill will billy;
yekaterina: katya katja; ekaterina: katya; ottilie: tilly tilli; ines: nines; nuria: nuri; priya: pri; andre: dre; clara: klara
"""
NICK: dict[str, set[str]] = {}
for _entry in NICKNAMES.replace("\n", " ").split(";"):
    _full, _, _short = _entry.strip().partition(":")
    for _s in _short.split():
        NICK.setdefault(_s, set()).add(_full)
# Words of organisations with their usual short forms, and words that carry no name.
ORG_WORDS = {"institute": "inst", "centre": "ctr", "center": "ctr", "department": "dept", "society": "soc", "laboratory": "lab", "consortium": "cons", "university": "univ", "association": "assoc", "committee": "comm", "agency": "ag", "foundation": "found", "group": "grp", "council": "coun", "school": "sch", "college": "coll", "network": "netw", "project": "proj"}
ORG_SHORT = {"inst", "ctr", "dept", "soc", "lab", "cons", "consort", "univ", "assoc", "comm", "cent", "labor", "depart"}
ORG_EMPTY = {"the", "of", "for", "and", "in", "fur", "pour", "de"}
MIN_SUFFIX, MIN_RATIO = 3, 0.84
#: Forms above which a key is common, and places of the table of common keys: its size doesn't depend on the data, keys that fall together
#: add up on all sides alike.
COMMON, PLACES = 12, 1 << 23
#: Given names that so large a share of the surnames (but at least so many) goes with are names of their own, no misprints.
KNOWN_SHARE, KNOWN_LEAST = 0.003, 4


def fold(s: str) -> str:
    """Small letters without accents."""
    s = unicodedata.normalize("NFD", s.lower().translate(FOLD))
    return "".join(c for c in s if not unicodedata.combining(c)).translate(FOLD)


def flat(s: str) -> str:
    """The same for spelled-out umlauts and for an m that was read as r and n."""
    return re.sub("([aou])e", r"\1", s).replace("rn", "m")


def lcs_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence by the sum of the lengths."""
    if not a or not b:
        return 0.0
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = v = (1 << len(a)) - 1  # a zero bit for each letter of the subsequence so far, all of a row at once
    for y in b:
        u = v & places.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return 2 * (len(a) - v.bit_count()) / (len(a) + len(b))


def parse(name: str) -> tuple[str, str, str] | None:
    """(kind, surname or place, rest) of a spelling: "p" with given names, "o" with the words of an organisation; null without letters."""
    raw = re.sub(r"\s+", " ", name).strip(" ,")
    if not any(c.isalpha() for c in raw) or fold(raw).strip(" .") in ("et al", "and others", "anonymous"):
        return None
    words = re.findall(r"[^\W_]+(?:['’][^\W_]+)*\.?", raw)
    plain = [fold(w).strip(".") for w in words]
    if len(words) > 1 and (any(p in ORG_WORDS or p in ORG_SHORT for p in plain) or {"for", "of"} & set(plain[1:-1])):
        kept = sorted(fold(w) for w, p in zip(words, plain) if p not in ORG_EMPTY and (len(p) > 3 or p in ORG_SHORT))
        return "o", "", " ".join(kept)
    caps = re.fullmatch(r"(.*[^\W\d_]),? ([^\W\d_]{1,6})", raw)
    if caps and not (caps.group(2).isupper() and any(c.islower() for c in caps.group(1))):
        caps = None
    if "," not in raw and caps and " " not in caps.group(1).strip() and len(caps.group(2)) > 2:
        return "o", "", f"{fold(caps.group(1))} {fold(caps.group(2))}!"
    if "," in raw:
        last, _, given = raw.partition(",")
    elif caps and len(words) > 1:
        last, given = caps.group(1), " ".join(caps.group(2))
    else:
        parts = raw.split(" ")
        k = len(parts) - 1
        while k > 1 and fold(parts[k - 1]) in PARTICLES:
            k -= 1
        last, given = " ".join(parts[k:]), " ".join(parts[:k])
    sur = [w for w in re.split(r"[\s\-]+", fold(last)) if w]
    kept = [w for i, w in enumerate(sur) if w.split("-")[0] not in PARTICLES] or sur
    g = [w for w in re.findall(r"[^\W\d_]+\.?", fold(given).replace("'", "")) if w.strip(".") not in PARTICLES or w.endswith(".")]
    g = [w.strip(".") if len(w.strip(".")) == 1 else w for w in g]
    surname = "".join(re.sub(r"[^\w.]", "", w) for w in kept)
    return ("p", surname, " ".join(g)) if surname.strip(".") else None


def _given(x: str, y: str, known: frozenset[str] = frozenset()) -> float:
    """How well two given names agree: 1 equal, less for initials, short forms and misprints, 0 for a conflict. Two ``known`` names are
    no misprints of each other."""
    a, b = sorted((x, y), key=len)
    if x == y:
        return 1.0
    if len(a) == 1:
        return 0.8 if b[0] == a or any(n[0] == a for n in NICK.get(b, ())) else 0.0
    if a.endswith("."):
        a = a[:-1]
        return 0.9 if b.strip(".").startswith(a) or any(n.startswith(a) for n in NICK.get(b, ())) else (0.7 if len(a) > 3 and lcs_ratio(a, b[: len(a)]) > 0.79 else 0.0)
    if b.endswith("."):
        return 0.9 if a.startswith(b[:-1]) or any(n.startswith(b[:-1]) for n in NICK.get(a, ())) else 0.0
    if a in NICK.get(b, ()) or b in NICK.get(a, ()) or NICK.get(a, set()) & NICK.get(b, set()):
        return 0.95
    if flat(a) == flat(b):
        return 0.95
    if a in known and b in known:
        return 0.0
    if any(lcs_ratio(n, z) > 0.87 for z, w in ((a, b), (b, a)) for n in NICK.get(w, ())):
        return 0.7
    if len(a) == len(b) == 3 and a[0] == b[0] and (a[1] == b[1] or sorted(a) == sorted(b)):
        return 0.7
    return 0.7 if len(a) >= 3 and abs(len(a) - len(b)) <= 2 and lcs_ratio(a, b) >= 0.75 and (len(a) > 3 or a[0] == b[0]) else 0.0


def agree_person(s1: str, g1: str, s2: str, g2: str, known: frozenset[str] = frozenset()) -> float:
    """Agreement of two persons' forms, 0 for a conflict; at most one part may hold a misprint."""
    if s1 == s2 or flat(s1) == flat(s2):
        s = 1.0
    elif "." in s1 or "." in s2:
        a, b = sorted((s1, s2), key=lambda x: "." not in x)
        s = 0.9 if b.startswith(a.rstrip(".")) and len(a) > 5 else 0.0
    else:
        r = lcs_ratio(s1, s2)
        s = r * 0.9 if r >= MIN_RATIO and min(len(s1), len(s2)) >= 5 and abs(len(s1) - len(s2)) <= 2 else 0.0
    if not s:
        return 0.0
    a, b = g1.split(), g2.split()
    if not a or not b:
        return 0.0
    got = [_given(x, y, known) for x, y in zip(a, b)]
    if min(got) == 0:
        return 0.0
    if s < 0.9 and min(got) == 0.7:
        return 0.0
    return s * sum(got) / len(got) - 0.01 * abs(len(a) - len(b))


def agree_org(w1: str, w2: str) -> float:
    """Agreement of two organisations: every word must find its like, as it is, shortened or misprinted; or initials stand for the rest."""
    a, b = w1.split(), w2.split()
    if w1 == w2:
        return 1.0
    if any(x.endswith("!") for x in a + b):
        if all(any(x.endswith("!") for x in y) for y in (a, b)):
            return 0.9 if a[-1] == b[-1] and lcs_ratio(a[0], b[0]) >= MIN_RATIO else 0.0
        short, full = (a, b) if a[-1].endswith("!") else (b, a)
        rest = [w for w in full if lcs_ratio(w.strip("."), short[0]) < MIN_RATIO]
        return 0.85 if len(rest) == len(full) - 1 and sorted(w[0] for w in rest) == sorted(short[-1][:-1]) else 0.0
    if len(a) != len(b):
        return 0.0
    left, total, prints = list(b), 0.0, 0
    for x in sorted(a, key=len, reverse=True):
        best = (0.0, "")
        for y in left:
            p, q = x.strip("."), y.strip(".")
            u, v = sorted((p, q), key=len)
            if p == q or ORG_WORDS.get(p, p) == ORG_WORDS.get(q, q):
                r = 1.0
            elif (x.endswith(".") or y.endswith(".") or u in ORG_SHORT) and len(u) >= 3 and v.startswith(u):
                r = 0.9
            else:
                r = lcs_ratio(p, q)
                r = r * 0.85 if r >= MIN_RATIO and len(u) >= 5 else 0.0
            best = max(best, (r, y))
        if not best[0]:
            return 0.0
        prints += best[0] < 0.86
        left.remove(best[1])
        total += best[0]
    return total / len(a) if prints <= 1 else 0.0


def key_chains(kind: str, surname: str, rest: str) -> list[tuple[bool, tuple[str, ...]]]:
    """Chains of keys of a form, each key finer than the one before, and whether the last one stands even if it is common: suffixes of the
    tokens, the tokens without their last letters, whole tokens, and suffixes of a full given name."""
    out: list[tuple[bool, tuple[str, ...]]] = []
    if kind == "p":
        g = rest.split()
        firsts = sorted({g[0][0], *(n[0] for n in NICK.get(g[0], ()))}) if g else [""]
        token = flat(surname.strip("."))
        tokens = [(token, f) for f in firsts]
        if g and len(g[0].strip(".")) > 3:
            stem = f"g{g[0].strip('.')[-4:]}|{token[:2]}|{token[-2:]}"
            out.append((False, (stem, f"{stem}|{len(token) // 3}", f"{stem}|{token[:3]}|{token[-3:]}")))
    else:
        words = [w.strip(".!") for w in rest.split() if len(w) > 5 and w not in ORG_WORDS]
        tokens = [(t, f) for t in words for f in (f"o{len(rest.split()) if '!' not in rest else ''}", "oa")]
    for t, f in tokens:
        out.append((True, (f"={f}|{t}",)))
        for size in range(MIN_SUFFIX, len(t)):
            end, room = t[-size:], len(t) - size
            heads = [t[:q] for q in sorted({1, min(3, room - 1)}) if 0 < q < room]
            out.append((size >= len(t) - 3, (f"{f}|{end}", *(f"{f}|{h}|{end}" for h in heads))))
        for size in range(max(MIN_SUFFIX, len(t) - 4), len(t)):  # misprints in the last letters
            out.append((size >= len(t) - 3, (f"{f}|{t[:size]}<",)))
        if kind == "p" and ("." in surname or len(t) > 11):  # a second surname may be cut short
            out.append((True, (f"{f}|{t[:6]}<<",)))
    return out


def chain_codes(forms: DataFrame) -> DataFrame:
    """(form, keys, marks): the hashed keys of all chains one behind the other; a mark is 1 at the start of a chain, 2 more where the chain
    stands, 4 more for a last key that stands, whose count doesn't matter."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chains = [key_chains(*x) for x in zip(*(c.to_pylist() for c in batch.columns[1:]))]
            keys = pd.util.hash_array(np.array([k for c in chains for _, ks in c for k in ks], object), categorize=False).view("int64")
            marks = np.array([(j == 0) + 2 * stands + 4 * (stands and j == len(ks) - 1) for c in chains for stands, ks in c for j in range(len(ks))], "int8")
            ends = np.cumsum([0, *(sum(len(ks) for _, ks in c) for c in chains)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(marks))], ["form", "keys", "marks"])

    return forms.select("form", "kind", "surname", "rest").mapInArrow(code, "form long, keys array<long>, marks array<byte>")


def common_keys(codes: DataFrame) -> Broadcast:
    """A bit for each place of keys that more than COMMON forms have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).flatten().to_numpy()[batch.column(1).flatten().to_numpy() < 4]  # a form has a key but once or twice
            at, n = np.unique((keys.view("uint64") % np.uint64(PLACES)).astype("int64"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype("int64")), pa.array(n.astype("int64"))], ["place", "n"])

    rows = codes.select("keys", "marks").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    found = np.zeros(PLACES, bool)
    found[rows.filter(F.col("n") > COMMON).select("place").toArrow().column("place").to_numpy()] = True  # at most PLACES of them
    return codes.sparkSession.sparkContext.broadcast(np.packbits(found))


def block_keys(codes: DataFrame, common: Broadcast) -> DataFrame:
    """(form, key): of each chain the first key that isn't common, or the last where it stands in any case."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.unpackbits(common.value).astype(bool)
        for batch in batches:
            lists = batch.column(1)
            keys, marks = lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            if not len(keys):
                continue
            own = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            start = np.nonzero(marks & 1)[0]
            often_ = often[(keys.view("uint64") % np.uint64(PLACES)).astype("int64")] & (marks < 4)
            at = np.minimum.reduceat(np.where(often_, len(keys), np.arange(len(keys))), start)
            at = at[at < len(keys)]
            got = np.unique(np.stack([own[at], keys[at]]), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(got[0])), pa.array(got[1])], ["form", "key"])

    return codes.mapInArrow(pick, "form long, key long")


def spellings(rows: DataFrame, columns: tuple[str, ...] = ("authors", "editors"), works: tuple[str, ...] = ("title", "doi")) -> DataFrame:
    """(name, works, n): every spelling with the works it is cited for, known by their whole titles or DOIs; elements between semicolons
    without blanks at their ends. A reference without either shares no work with another."""
    keys = [F.regexp_replace(F.lower(F.col(w).cast("string")), r"[^\p{L}\p{N}]+", "") for w in works if w in rows.columns]
    own = F.array_distinct(F.filter(F.array(*[F.when(F.length(k) > 0, F.xxhash64(k)) for k in keys]), lambda x: x.isNotNull())) if keys else F.array().cast("array<bigint>")
    parts = [rows.select(F.explode(F.split(c, ";")).alias("name"), own.alias("works")) for c in columns]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.select(F.regexp_replace("name", r"^[ \t]+|[ \t]+$", "").alias("name"), "works").filter(F.length("name") > 0).groupBy("name", "works").agg(F.count(F.lit(1)).alias("n"))


def entities(rows: DataFrame, columns: tuple[str, ...] = ("authors", "editors"), works: tuple[str, ...] = ("title", "doi")) -> DataFrame:
    """(name, entity): every spelling with the id of its entity, a hash of the form it is best documented under. A spelling
    used for several entities, such as an initial shared by relatives whose works show both, has a row for each.

    Null and empty cells give no spelling, neither does "et al."; repeated rows change nothing but counts; an empty table gives
    no row.
    """
    said = materialise(spellings(rows, columns, works))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(n, *f) for n in batch.column(0).to_pylist() if (f := parse(n))]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.string()) for k in range(4)], ["name", "kind", "surname", "rest"])

    names = materialise(said.select("name").distinct().mapInArrow(read, "name string, kind string, surname string, rest string").withColumn("form", F.xxhash64("kind", "surname", "rest")))
    cited = said.join(names.select("name", "form"), "name")
    works = materialise(cited.select("form", F.explode("works").alias("work")).distinct())
    counts = cited.groupBy("form").agg(F.sum("n").alias("n"))
    forms = materialise(names.select("form", "kind", "surname", "rest").distinct().join(counts, "form"))

    first = forms.filter("kind = 'p'").select("surname", F.split("rest", " ")[0].alias("given")).distinct()
    per = first.filter((F.length("given") > 2) & ~F.col("given").endswith(".")).groupBy("given").agg(F.count(F.lit(1)).alias("n"))
    least = max(KNOWN_LEAST, KNOWN_SHARE * first.count())
    known = frozenset(r["given"] for r in per.filter(F.col("n") >= least).collect())  # at most 1 / KNOWN_SHARE of them

    codes = materialise(chain_codes(forms))
    keys = materialise(block_keys(codes, common_keys(codes)))
    met = keys.join(keys.withColumnRenamed("form", "other"), "key").filter(F.col("form") < F.col("other")).select("form", "other").distinct()
    one = forms.select("form", "kind", F.col("surname").alias("s1"), F.col("rest").alias("r1"), F.col("n").alias("n1"))
    two = forms.select(F.col("form").alias("other"), F.col("kind").alias("kind2"), F.col("surname").alias("s2"), F.col("rest").alias("r2"), F.col("n").alias("n2"))
    pairs = met.join(one, "form").join(two, "other").filter(F.col("kind") == F.col("kind2"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            got = [agree_person(a, b, c, e, known) if k == "p" else agree_org(b, e) for k, a, b, c, e in zip(d["kind"], d["s1"], d["r1"], d["s2"], d["r2"])]
            t = pa.RecordBatch.from_arrays([batch.column("form"), batch.column("other"), batch.column("n1"), batch.column("n2"), pa.array(got, pa.float64())], ["form", "other", "n1", "n2", "score"])
            yield t.filter(pa.compute.greater(t.column("score"), 0))

    close = materialise(pairs.select("form", "other", "kind", "s1", "r1", "s2", "r2", "n1", "n2").mapInArrow(compare, "form long, other long, n1 long, n2 long, score double"))
    common = close.select("form", "other").join(works.select("form", "work"), "form").join(works.select(F.col("form").alias("other"), "work"), ["other", "work"]).groupBy("form", "other").agg(F.count(F.lit(1)).alias("shared"))
    edges = close.join(common, ["form", "other"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    detail = forms.select("form", (F.length(F.regexp_replace("rest", r"\.", "")) - 3 * F.size(F.expr(r"regexp_extract_all(rest, '\\.', 0)"))).alias("detail"), "n")
    way = edges.select("form", "other", "score", "shared").unionByName(edges.select(F.col("other").alias("form"), F.col("form").alias("other"), "score", "shared"))
    return _resolve(names, detail, materialise(way))


def _resolve(names: DataFrame, detail: DataFrame, way: DataFrame) -> DataFrame:
    """Each form points to the best form above it in rank (detail, then count); pointers are followed to their ends."""
    rank = detail.select("form", F.struct(F.least("detail", F.lit(6)), "n", "detail", "form").alias("rank"))
    up = way.join(rank, "form").join(rank.withColumnsRenamed({"form": "other", "rank": "above"}), "other").filter(F.col("above") > F.col("rank"))
    first = Window.partitionBy("form").orderBy(F.desc(F.col("shared") > 0), F.desc("score"), F.desc("shared"), F.desc("above"))
    head = materialise(up.withColumn("k", F.row_number().over(first)).filter("k = 1 OR shared > 0").select("form", F.col("other").alias("head")))
    while True:
        step = head.select(F.col("form").alias("head"), F.col("head").alias("top"))
        new = materialise(head.join(step, "head", "left").select("form", F.coalesce("top", "head").alias("head"), F.col("top").isNotNull().alias("moved")).distinct())
        head = new.select("form", "head").distinct()
        if new.filter("moved").isEmpty():
            break
    return names.join(head, "form", "left").select("name", F.coalesce("head", "form").alias("entity"))


def name_pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b): the pairs of different spellings of an entity, the smaller first."""
    other = linked.withColumnRenamed("name", "name_b")
    return linked.withColumnRenamed("name", "name_a").join(other, "entity").filter(F.col("name_a") < F.col("name_b")).select("name_a", "name_b").distinct()
