"""Long exact spans that records share, located with sharded Aho-Corasick automata over words.

A text is cut into segments: longest runs of windows of ``k`` words that have the same smallest hash of four words in a row
(their minimizer). Equal windows thereby meet in one shard wherever they stand, and a shard holds each segment text only once,
with the least and the greatest owner. There the recurring windows are confirmed and merged into whole passages. The passages of a shard are
compiled into one automaton, and the segments of all records, copies included, stream through the automata of their shards, which
report every occurrence. A table of bits of fixed size keeps segments away whose minimizer no passage has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirewise.runtime import materialise

GRAM = 4
#: Distinct segments that a shard holds on average, segments of one minimizer above which its windows are spread one by one, rows of one
#: minimizer above which they stream through several copies of its automaton (there are at most HOT_MOST such), and bits of the table.
SHARD_SEGMENTS, HOT_SEGMENTS, HOT_ROWS, HOT_MOST, BITS = 40_000, 200_000, 50_000, 10_000, 1 << 22
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], "uint64")


def words_of(text: str) -> list[str]:
    """What stands between blanks (U+0020), empty ones dropped."""
    return [w for w in text.split(" ") if w]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def _segments(texts: list[str | None], k: int, hot: np.ndarray) -> tuple[list[int], list[int], list[str], np.ndarray]:
    """Row, first word, text and minimizer of each segment of the texts; windows with a hot minimizer stand alone under their own hash."""
    rows, lists = [], []
    for i, t in enumerate(texts):
        if t and t.count(" ") >= k - 1 and len(w := words_of(t)) >= k:
            rows.append(i)
            lists.append(w)
    if not rows:
        return [], [], [], np.empty(0, "int64")
    flat = [w for x in lists for w in x]
    sizes = np.fromiter(map(len, lists), "int64", len(lists))
    starts = np.cumsum(sizes) - sizes
    codes, known = pd.factorize(np.array(flat, object))
    h = pd.util.hash_array(np.asarray(known, object), categorize=False)[codes]
    n = len(flat)
    with np.errstate(over="ignore"):
        g = _mixed(sum(h[j : n - GRAM + 1 + j] * _MIX[j] for j in range(GRAM)))
        low = np.lib.stride_tricks.sliding_window_view(g, k - GRAM + 1).min(1)
        row_of = np.repeat(np.arange(len(lists)), sizes)
        at = np.nonzero(np.arange(n) + k <= (starts + sizes)[row_of])[0]
        low, own = low[at], row_of[at]
        if len(hot):
            is_hot = np.isin(low.view("int64"), hot)
            low = low.copy()
            low[is_hot] = _mixed(sum(h[at[is_hot] + j] * (_MIX[j % 4] + np.uint64(2 * j + 2)) for j in range(k)))
        else:
            is_hot = np.zeros(len(low), bool)
    new = np.ones(len(at), bool)
    new[1:] = (own[1:] != own[:-1]) | (low[1:] != low[:-1]) | is_hot[1:] | is_hot[:-1]
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(at)) - 1
    a, b = at[first].tolist(), (at[last] + k).tolist()
    return [rows[i] for i in own[first].tolist()], (at[first] - starts[own[first]]).tolist(), [" ".join(flat[x:y]) for x, y in zip(a, b)], low[first].view("int64")


def _distinct(texts: DataFrame, k: int, hot: np.ndarray) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, _, seg, low = _segments(batch.column(1).to_pylist(), k, hot)
            owners = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(seg, pa.string()), owners, pa.compute.is_null(owners)], ["low", "seg", "owner", "outer"])

    return texts.select("owner", "text").mapInArrow(cut, "low long, seg string, owner string, outer boolean").groupBy("low", "seg").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi"), F.max("outer").alias("outer"), F.count(F.lit(1)).alias("n"))


def confirm(shard: pa.Table, k: int) -> pa.Table:
    """(low, passage) of one shard (low, seg, lo, hi, outer): the longest stretches of its segments of which every ``k`` words recur."""
    pdf = shard.to_pydict()
    vocabulary: dict[str, int] = {}
    split = [s.split(" ") for s in pdf["seg"]]
    coded = [tuple(vocabulary.setdefault(w, len(vocabulary)) for w in s) for s in split]
    seen: dict[tuple, list] = {}
    recurring = set()
    for ids, lo, hi, outer in zip(coded, pdf["lo"], pdf["hi"], pdf["outer"]):
        for i in range(len(ids) - k + 1):
            w = ids[i : i + k]
            x = seen.get(w)
            if x is None:
                seen[w] = x = [lo, hi, outer]
            else:
                x[0] = lo if x[0] is None else x[0] if lo is None else min(x[0], lo)
                x[1] = hi if x[1] is None else x[1] if hi is None else max(x[1], hi)
                x[2] = x[2] or outer
            if x[0] is not None and (x[2] or x[0] != x[1]):
                recurring.add(w)
    del seen
    out: set[tuple[int, str]] = set()
    for low, words, ids in zip(pdf["low"], split, coded) if recurring else ():
        run = None
        for i in range(len(ids) - k + 1):
            if ids[i : i + k] in recurring:
                run = i if run is None else run
            elif run is not None:
                out.add((low, " ".join(words[run : i + k - 1])))
                run = None
        if run is not None:
            out.add((low, " ".join(words[run:])))
    return pa.table({"low": pa.array([x[0] for x in out], pa.int64()), "passage": pa.array([x[1] for x in out], pa.string())})


class Passages:
    """An automaton over words of the passages of one shard."""

    def __init__(self, passages: list[str]):
        import ahocorasick

        self.vocabulary: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for p in passages:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in p.split(" "))
            self.automaton.add_word(ids, len(ids))
        self.automaton.make_automaton()

    def spans(self, segment: str) -> list[list[int]]:
        """Unbroken stretches [from, to) of the segment's words that lie in passages."""
        known = self.vocabulary
        out: list[list[int]] = []
        for end, size in self.automaton.iter(tuple(known.get(w, 0) for w in segment.split(" "))):
            a, b = end - size + 1, end + 1
            while out and a <= out[-1][1]:
                a, b = min(a, out[-1][0]), max(b, out[-1][1])
                out.pop()
            out.append([a, b])
        return out


def _located(rows: DataFrame, kinds: str) -> DataFrame:
    """(o, i, a, b) for rows (o, i, start, seg, kind) sorted by shard, salt and kind: passages (kind 0) are compiled, the segments behind them stream through."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, automaton = None, [], None
        for batch in batches:
            shard, salt, kind, start, seg = (batch.column(c).to_pylist() for c in ("shard", "salt", "kind", "start", "seg"))
            row, first, last = [], [], []
            for j, key in enumerate(zip(shard, salt)):
                if key != at:
                    at, held, automaton = key, [], None
                if kind[j] == 0:
                    held.append(seg[j])
                    continue
                if held and automaton is None:
                    automaton, held = Passages(held), []
                for a, b in automaton.spans(seg[j]) if automaton else ():
                    row.append(j)
                    first.append(start[j] + a)
                    last.append(start[j] + b)
            t = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("o").take(t), batch.column("i").take(t), pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["o", "i", "a", "b"])

    return rows.mapInArrow(stream, f"{kinds}, a int, b int")


def shared_spans(records: DataFrame, outside: DataFrame | None = None, owner: str = "paper_id", item: str = "text_id", text: str = "text", k: int = 12, shard_segments: int = SHARD_SEGMENTS, hot_segments: int = HOT_SEGMENTS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(owner, item, start_word, end_word): the longest unbroken stretches of words of a record that lie in ``k`` words in a row
    which also stand in a row in a record of another owner, or in a row of ``outside`` (its column ``text``).

    Null and empty texts and texts under ``k`` words give no row; records of a null owner count as those of one owner ""; repeated
    rows of a key give their stretches once; an empty table gives no row.
    """
    rec = records.select(F.col(owner).alias("o"), F.col(item).alias("i"), F.col(text).alias("text"))
    texts = rec.select(F.coalesce(F.col("o").cast("string"), F.lit("")).alias("owner"), "text")
    if outside is not None:
        texts = texts.unionByName(outside.select(F.lit(None).cast("string").alias("owner"), F.col("text")))
    hot = np.empty(0, "int64")
    distinct = materialise(_distinct(texts, k, hot))
    sizes = distinct.groupBy("low").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    frequent = sizes.filter(F.col("c") > hot_segments).select("low").toPandas()["low"]  # at most rows / hot_segments of them
    if len(frequent):
        hot = frequent.to_numpy("int64")
        distinct = materialise(_distinct(texts, k, hot))
        sizes = distinct.groupBy("low").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    total = distinct.agg(F.count(F.lit(1)).alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n_shards = max(16, -(-total["c"] // shard_segments))
    each = max(hot_rows, total["n"] // HOT_MOST)
    salts = {r["low"]: -(-r["n"] // each) for r in sizes.filter(F.col("n") > each).collect()}  # at most HOT_MOST of them

    shard = F.pmod(F.col("low"), F.lit(n_shards)).cast("int").alias("shard")
    passages = materialise(distinct.withColumn("shard", shard).repartition(n_shards, "shard").groupBy("shard").applyInArrow(lambda x: confirm(x, k), "low long, passage string"))
    bits = np.zeros(BITS, bool)
    bits[passages.select(F.pmod("low", F.lit(BITS)).cast("int").alias("p")).distinct().toArrow().column("p").to_numpy()] = True  # at most BITS of them
    sent = records.sparkSession.sparkContext.broadcast((np.packbits(bits), salts))

    kinds = f"o {rec.schema['o'].dataType.simpleString()}, i {rec.schema['i'].dataType.simpleString()}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, many = sent.value
        some = np.unpackbits(packed).astype(bool)
        for batch in batches:
            row, start, seg, low = _segments(batch.column(2).to_pylist(), k, hot)
            keep = np.nonzero(some[low % BITS])[0]
            at = pa.array(np.array(row, "int64")[keep])
            ways = np.array([many.get(x, 1) for x in low[keep].tolist()], "int64")
            spread_ = np.array([hash((j, len(t))) for j, t in zip(start, seg)], "int64")[keep] + np.array(row, "int64")[keep] * 7919
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.array(start, "int32")[keep]), pa.array(low[keep]), pa.array([seg[j] for j in keep.tolist()], pa.string()), pa.array((spread_ % ways).astype("int32"))],
                ["o", "i", "start", "low", "seg", "salt"],
            )

    mine = rec.mapInArrow(cut, f"{kinds}, start int, low long, seg string, salt int").select("o", "i", "start", "seg", shard, "salt", F.lit(1).alias("kind"))

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(x, p, j) for x, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for j in range(sent.value[1].get(x, 1))]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.int32())], ["low", "seg", "salt"])

    null = [F.lit(None).cast(rec.schema[c].dataType).alias(c) for c in ("o", "i")]
    compiled = passages.mapInArrow(copy, "low long, seg string, salt int").select(*null, F.lit(0).alias("start"), "seg", shard, "salt", F.lit(0).alias("kind"))
    both = compiled.unionByName(mine).repartition(n_shards, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    w = Window.partitionBy("o", "i").orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = _located(both, kinds).distinct().withColumn("new", (reach.isNull() | (F.col("a") > reach)).cast("int")).withColumn("isle", F.sum("new").over(w))
    merged = runs.groupBy("o", "i", "isle").agg(F.min("a").alias("start_word"), F.max("b").alias("end_word"))
    return merged.select(F.col("o").alias(owner), F.col("i").alias(item), "start_word", "end_word")


def coverage(records: DataFrame, spans: DataFrame, owner: str = "paper_id", item: str = "text_id", text: str = "text") -> DataFrame:
    """(owner, item, n_words, shared_words, n_spans, coverage) for each key: the share of its words that lie in shared spans.

    Texts without words have coverage 0; repeated rows of a key count once.
    """
    n = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), " "), lambda w: w != ""))
    rec = records.select(owner, item, n.alias("n")).groupBy(owner, item).agg(F.max("n").alias("n_words"))
    per = spans.groupBy(F.col(owner).alias("o"), F.col(item).alias("i")).agg(F.sum(F.col("end_word") - F.col("start_word")).alias("s"), F.count(F.lit(1)).alias("c"))
    got = rec.join(per, F.col(owner).eqNullSafe(F.col("o")) & F.col(item).eqNullSafe(F.col("i")), "left")
    shared = F.coalesce("s", F.lit(0))
    return got.select(owner, item, "n_words", shared.alias("shared_words"), F.coalesce("c", F.lit(0)).alias("n_spans"), F.when(F.col("n_words") > 0, shared / F.col("n_words")).otherwise(0.0).alias("coverage"))
