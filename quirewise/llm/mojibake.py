"""Texts decoded with a wrong character encoding: found by expectation-maximization over latent encoding chains, and restored.

A chain says as what the bytes were read and what they were. For every record and chain the evidence is the gain in the joint
counts of neighbouring characters over the whole corpus when the chain is undone in the best stretch of the text. Each source
has its own prior over the chains, drawn towards the prior of all, and both are estimated from the posteriors of the records, so
that weak evidence of many records of a source adds up.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewise.runtime import materialise

# Names of encodings.
UTF8_READ_AS = ["cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp866", "koi8-r", "mac_roman", "mac_cyrillic", "iso8859-15"]
UTF8_READ_AS_WIDE = ["gbk", "big5", "shift_jis", "euc_kr"]
ONE_BYTE = ["cp1252", "cp1250", "cp1251", "cp1253", "koi8-r", "cp866", "cp437", "cp850", "mac_roman", "mac_cyrillic", "iso8859-2", "iso8859-5"]
WIDE_READ_AS_LATIN = ["gbk", "big5", "shift_jis", "euc_jp", "euc_kr"]
LOST = "lost"
#: Rounds of estimation, weight of the overall prior in a source's (in records), price of a token in a stretch that a chain leaves unchanged.
ROUNDS, PULL, UNCHANGED = 5, 20.0, 0.7
#: Evidence of a valid UTF-8 sequence among characters that would form one by chance hardly ever.
VALID = 5.0
#: Least gain of a token and of a stretch to count as evidence; places of the table of pair counts: its size doesn't depend on the data.
TOKEN_GAIN, STRETCH_GAIN, PLACES = 1.0, 0.0, 4_194_301
#: The prior shares before the first round.
START = {"utf8": 1e-3, "one": 1e-5, "wide": 1e-4, LOST: 1e-2}
_SPLIT = re.compile("[ \n\r\t]")


def _high(enc: str) -> list[str]:
    """The characters of bytes 80 to FF; undefined ones stand for themselves, as lenient decoders have it."""
    return [bytes([b]).decode(enc, "ignore") or chr(b) for b in range(128, 256)]


class _Utf8As:
    """UTF-8 read as a one-byte encoding; each valid sequence is put right, ``times`` over."""

    kind = "utf8"

    def __init__(self, enc: str, times: int = 1):
        high = _high(enc)
        self.byte = {c: b for b, c in reversed(list(enumerate(high, 128)))}
        if enc == "cp1252":
            self.byte = {chr(b): b for b in range(128, 160)} | self.byte

        def among(lo: int, hi: int) -> str:
            return "[" + "".join(re.escape(c) for c, b in self.byte.items() if lo <= b <= hi) + "]"

        more = among(0x80, 0xBF)
        self.seq = re.compile(f"(?:{among(0xC2, 0xDF)}{more}|{among(0xE0, 0xEF)}{more}{more}|{among(0xF0, 0xF4)}{more}{more}{more})+")
        self.times = times

    def _right(self, m: re.Match) -> str:
        try:
            return bytes(self.byte[c] for c in m.group()).decode()
        except UnicodeDecodeError:
            return m.group()

    def undo(self, text: str) -> str:
        for _ in range(self.times):
            new = self.seq.sub(self._right, text)
            if new == text:
                return new if self.times == 1 else ""
            text = new
        return text


class _Runs:
    """Whole runs of characters beyond ASCII, encoded as what they were read as and decoded as what they were."""

    def __init__(self, read_as: str, was: str, kind: str):
        self.read_as, self.was, self.kind = read_as, was, kind

    def _right(self, m: re.Match) -> str:
        try:
            return m.group().encode(self.read_as).decode(self.was)
        except UnicodeError:
            return m.group()

    def undo(self, text: str) -> str:
        return re.sub("[^\x00-\x7f]+", self._right, text)


class _Wide:
    """A two-byte encoding read as cp1252 or Latin-1: whole tokens, or else their runs beyond ASCII."""

    kind = "wide"

    def __init__(self, was: str):
        self.was = was
        self.byte = {chr(b): b for b in range(256)} | {c: b for b, c in enumerate(_high("cp1252"), 128)}
        high = "".join(re.escape(c) for c in self.byte if not c.isascii())
        self.run, self.rest = re.compile(f"[{high}]{{2,}}"), re.compile(f"[{high}][{high}\x21-\x7e]+")  # second bytes may be ASCII

    def _right(self, t: str) -> str:
        try:
            return bytes(self.byte[c] for c in t).decode(self.was)
        except (UnicodeError, KeyError):
            return t

    def undo(self, text: str) -> str:
        for way in (self._right, lambda t: self.rest.sub(lambda m: self._right(m.group()), t)):
            if (new := way(text)) != text:
                return new
        return self.run.sub(lambda m: self._right(m.group()), text)


class _OneByte:
    kind = "one"

    def __init__(self, read_as: str, was: str):
        self.map = {ord(a): b for a, b in zip(_high(read_as), _high(was)) if a != b}

    def undo(self, text: str) -> str:
        return text.translate(self.map)


def chains() -> dict[str, object]:
    """All chains by name, "read as<what it was"."""
    out: dict[str, object] = {f"{e}<utf-8": _Utf8As(e) for e in UTF8_READ_AS}
    out |= {f"{e}<utf-8<{e}<utf-8": _Utf8As(e, 2) for e in UTF8_READ_AS}
    out |= {f"{e}<utf-8": _Runs(e, "utf-8", "utf8") for e in UTF8_READ_AS_WIDE}
    out |= {f"latin-1<{e}": _Wide(e) for e in WIDE_READ_AS_LATIN}
    out |= {f"{a}<{b}": _OneByte(a, b) for a in ONE_BYTE for b in ONE_BYTE if a != b}
    return out


def tokens(text: str) -> list[str]:
    """The stretches between blanks that hold a character beyond ASCII."""
    return [] if text.isascii() else [w for w in _SPLIT.split(text) if not w.isascii()]


def _wide(c: str) -> bool:
    return "⺀" <= c <= "鿿" or "가" <= c <= "힣" or c >= "豈"


def pairs(token: str) -> list[tuple[str, str]]:
    """Neighbours of which one is beyond ASCII; ideographs and syllables count alone, so that the table stays small."""
    s = f" {token} "
    return [("", b) if _wide(b) else (a, b) for a, b in zip(s, s[1:]) if not (a.isascii() and b.isascii()) and not (_wide(a) and b == " ")]


def place(pair: tuple[str, str]) -> int:
    return (ord(pair[0] or "\0") * 0x110000 + ord(pair[1])) % PLACES


class Judge:
    """Scores chains for texts by counts of pairs (by their place) and of characters."""

    def __init__(self, counts: dict[int, int], single: dict[str, int]):
        self.n, self.chains, self.single = counts, chains(), single
        self.known: dict[str, dict[str, float]] = {}
        self.one = [k for k, c in self.chains.items() if c.kind == "one"]
        self.utf8 = {k: f"{k}<{k}" for k, c in self.chains.items() if isinstance(c, _Utf8As) and c.times == 1}
        alone = min(self.n.get(place((" ", "\ufffd")), 0), self.n.get(place(("\ufffd", " ")), 0))
        # how much likelier the sign of lost characters is in a text that lost some than in one that means it
        self.lost = math.log(0.5 * (sum(single.values()) + 4) / (alone + 1))
        self.over_latin = [k for k, c in self.chains.items() if c.kind == "wide"]
        self.over_wide = [k for k, c in self.chains.items() if isinstance(c, _Runs) and c.kind == "utf8"]
        self.logs = {c: math.log(n + 0.5) for c, n in self.single.items()}
        self.last = ("", 0.0)
        self.masks: dict[str, int] = {}
        self.gains: dict[tuple[str, str], float] = {}

    def _mask(self, c: str) -> int:
        m = self.masks.get(c)
        if m is None:
            m, n = 0, self.single.get(c, 0)
            for k, name in enumerate(self.one):
                new = self.chains[name].map.get(ord(c))
                if new and self.single.get(new, 0) > 3 * n + 3:
                    m |= 1 << k
            self.masks[c] = m
        return m

    def gain(self, chain: str, token: str) -> float:
        """Log ratio of joint counts when the chain is undone in the token; a price if that changes nothing."""
        got = self.gains.get((chain, token))
        if got is None:
            c = self.chains[chain]
            new = c.undo(token)
            if not new or new == token:
                got = -UNCHANGED
            elif c.kind == "one" and not any(x.isalpha() for x in token if not x.isascii()):
                got = 0.0
            else:
                after = pairs(new)
                now = sum(math.log(self.n.get(place(p), 0) + 0.5) for p in after) / len(after) if after else 2.0
                weight = sum(not x.isascii() for x in token)
                if c.kind == "utf8":  # what a valid sequence looked like before is left out: its counts come from garbled texts
                    unseen = any(x not in self.single for x in new if not x.isascii())
                    plain = isinstance(c, _Utf8As) and not chain.startswith("cp866<utf-8")  # only there do real words hold valid sequences
                    got = -3.0 if unseen else (now - (0 if plain else self._base(token))) * min(weight / 2, 12) + VALID * plain
                else:
                    got = (now - self._base(token)) * min(weight, 12)
            if len(self.gains) > 400_000:
                self.gains.clear()
            self.gains[chain, token] = got
        return got

    def _base(self, token: str) -> float:
        """Mean log count of the token's own pairs."""
        if self.last[0] != token:
            before = pairs(token)
            self.last = (token, sum(math.log(self.n.get(place(p), 0) + 0.5) for p in before) / max(1, len(before)))
        return self.last[1]

    def _likely(self, token: str, mask: int) -> list[str]:
        """Of the one-byte chains in the mask those that make the token's characters commoner taken one by one."""
        out, chars = [], [c for c in token if not c.isascii()]
        old = sum(self.logs.get(c, -0.7) for c in chars)
        while mask:
            k = (mask & -mask).bit_length() - 1
            mask &= mask - 1
            to = self.chains[self.one[k]].map
            if sum(self.logs.get(to.get(ord(c), c), -0.7) for c in chars) - old > 1:
                out.append(self.one[k])
        return out

    def _hints(self, token: str) -> frozenset[str]:
        got = self.known.get(token)
        if got is None:
            m, wide = 0, False
            latin = self.chains[self.over_latin[0]].run.search(token) is not None
            for c in token:
                if not c.isascii():
                    m |= self._mask(c)
                    wide |= _wide(c)
            rest = self.over_latin * latin + self.over_wide * wide
            for k, twice in self.utf8.items():
                c = self.chains[k]
                if c.seq.search(token):
                    rest += [k, twice] if c.seq.search(c.undo(token)) else [k]
            cand = rest + (self._likely(token, m) if m else [])
            got = frozenset(k for k in cand if self.gain(k, token) > TOKEN_GAIN)
            if len(self.known) > 400_000:
                self.known.clear()
            self.known[token] = got
        return got

    def evidence(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(chain, log likelihood ratio, first and last affected token) of the chains that speak for themselves somewhere."""
        toks = tokens(text) if text else []
        out = []
        lost = [w for w in toks if "�" in w and w.strip("�")]  # alone between blanks it may be meant
        if lost:
            out.append((LOST, self.lost * sum(w.count("\ufffd") for w in lost), 0, len(toks)))
        cand = set().union(*map(self._hints, set(toks))) if toks else ()
        for k in cand:
            best = run = 0.0
            start, span = 0, (0, 0)
            for i, w in enumerate(toks):
                run += self.gain(k, w)
                if run <= 0:
                    run, start = 0.0, i + 1
                elif run > best:
                    best, span = run, (start, i + 1)
            best -= 2 * math.log1p(span[0] + len(toks) - span[1])
            if best > STRETCH_GAIN:
                out.append((k, best, *span))
        return sorted(out, key=lambda x: (-x[1], x[0]))


def restored(known: dict[str, object], chain: str, text: str, first: int, last: int) -> str:
    """The text with the chain undone in its tokens from ``first`` up to ``last``."""
    if chain == LOST:
        return text
    parts, k = re.split("([ \n\r\t])", text), 0
    for i, w in enumerate(parts):
        if not w.isascii():
            if first <= k < last:
                parts[i] = known[chain].undo(w) or w
            k += 1
    return "".join(parts)


def pair_counts(docs: DataFrame, text: str = "text") -> tuple[dict[int, int], dict[str, int]]:
    """Counts over all rows of character pairs by their place (at most PLACES) and of characters beyond ASCII (at most all of Unicode)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        total: dict[int, int] = {}

        def settle() -> None:
            for w, n in seen.items():
                for p in pairs(w):
                    for k in (place(p), *(-1 - ord(c) for c in {*p} if c and not c.isascii())):
                        total[k] = total.get(k, 0) + n
            seen.clear()

        for batch in batches:
            for t in batch.column(0).to_pylist():
                for w in tokens(t) if t else ():
                    seen[w] = seen.get(w, 0) + 1
            if len(seen) > 100_000:
                settle()
        settle()
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], ["k", "n"])

    rows = docs.select(text).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    both = dict(zip(rows.column("k").to_pylist(), rows.column("n").to_pylist()))
    return {k: n for k, n in both.items() if k >= 0}, {chr(-1 - k): n for k, n in both.items() if k < 0}


def garbled(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, chain, posterior, text): the garbled records with their chain, its posterior and the restored text.

    What was lost in decoding (U+FFFD) stays as it is. Null and empty texts and plain ASCII are never garbled; a null source
    counts as one source; repeated rows of a key come out once each; an empty table gives no row.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pair_counts(docs, text))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    shape = "array<struct<chain:string,ll:double,first:int,last:int>>"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = Judge(*sent.value)
        of = pa.list_(pa.struct([("chain", pa.string()), ("ll", pa.float64()), ("first", pa.int32()), ("last", pa.int32())]))
        for batch in batches:
            got = [j.evidence(t) for t in batch.column(2).to_pylist()]
            at = pa.array([i for i, g in enumerate(got) if g], pa.int64())
            found = [[{"chain": c, "ll": v, "first": a, "last": b} for c, v, a, b in g] for g in got if g]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), pa.array(found, of)], ["key", "source", "text", "ev"])

    plain = F.octet_length("text") > F.char_length("text")
    found = materialise(rows.filter(plain).mapInArrow(judge, f"key {kind}, source string, text string, ev {shape}"))
    sizes = materialise(rows.groupBy("source").agg(F.count(F.lit(1)).alias("size")))
    kinds = {k: c.kind for k, c in chains().items()} | {LOST: LOST}
    present = {r["chain"] for r in found.select(F.explode("ev.chain").alias("chain")).distinct().collect()}  # at most the fixed number of chains
    kinds = {k: v for k, v in kinds.items() if k in present}
    if not kinds:
        return found.select(F.col("key").alias(key), F.lit("").alias("chain"), F.lit(0.0).alias("posterior"), F.col("text").alias(text)).filter(F.lit(False))
    n_all = sizes.agg(F.sum("size")).first()[0] or 0
    overall = {k: START[v] for k, v in kinds.items()}

    def shares(of: dict[str, float]) -> Column:
        return F.create_map(*[F.lit(x) for kv in of.items() for x in kv])

    # one row a source: its size, and the share of each chain that its records showed
    prior = sizes.select("source", "size", F.lit(None).cast("map<string,double>").alias("own"))
    for round_ in range(ROUNDS):
        all_ = shares(overall)
        known = found.select("key", "source", "text", "ev").join(prior, "source") if round_ else found.withColumn("own", F.lit(None).cast("map<string,double>")).withColumn("size", F.lit(0.0))
        share = lambda e: (F.coalesce(F.element_at("own", e["chain"]), F.lit(0.0)) + PULL * F.element_at(all_, e["chain"])) / (F.col("size") + PULL)  # noqa: B023, E731
        scored = known.withColumn("s", F.transform("ev", lambda e: e["ll"] + F.log(share(e)))).withColumn("m", F.array_max("s"))
        base = scored.withColumn("z", F.aggregate("s", F.exp(-F.col("m")), lambda acc, x: acc + F.exp(x - F.col("m"))))
        post = base.withColumn("r", F.transform("s", lambda x: F.exp(x - F.col("m")) / F.col("z")))
        if round_ == ROUNDS - 1:
            break
        each = post.select("source", F.explode(F.arrays_zip(F.col("ev.chain").alias("chain"), F.col("r"))).alias("x")).groupBy("source", F.col("x.chain").alias("chain")).agg(F.sum("x.r").alias("r"))
        each = materialise(each)
        summed = {x["chain"]: x["r"] for x in each.groupBy("chain").agg(F.sum("r").alias("r")).collect()}  # as many as chains
        overall = {k: max((summed.get(k, 0.0) + 1) / (n_all + len(kinds)), START[v] / 10) for k, v in kinds.items()}
        own = each.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("chain", "r"))).alias("own"))
        prior = materialise(sizes.join(own, "source", "left"))

    best = post.withColumn("p", 1 - F.exp(-F.col("m")) / F.col("z")).filter("p > 0.5").withColumn("e", F.element_at("ev", F.array_position("s", F.col("m")).cast("int")))

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chains()
        for batch in batches:
            d = [batch.column(c).to_pylist() for c in ("chain", "text", "first", "last")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("chain"), batch.column("posterior"), pa.array([restored(known, *x) for x in zip(*d)], pa.string())], [key, "chain", "posterior", text])

    chosen = best.select("key", F.col("e.chain").alias("chain"), F.col("p").alias("posterior"), "text", F.col("e.first").alias("first"), F.col("e.last").alias("last")).distinct()
    return chosen.mapInArrow(restore, f"`{key}` {kind}, chain string, posterior double, `{text}` string").distinct()
