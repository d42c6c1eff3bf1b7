"""Filling of containers of fixed capacity: best fit in every partition, then a tree of merges of what isn't full.

Each level packs the groups of the level below: bins that are nearly full are settled, the others go up as items. The levels
only hold (bin, size) and the content follows by a join. A group with more bins than a task should hold is split by a hash that differs
from level to level, and at the root such rounds go on as long as they save bins; so no bin is left out and memory stays bounded.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewise.llm.tokens import TOKENIZERS, token_sizes
from quirewise.runtime import materialise

#: Unused room up to which a bin counts as full; items that one task packs at once; groups merged by a level; underfull bins beyond
#: which a group is split; share of the bins that a round at the root must save for another one.
SLACK, CHUNK, FAN_IN, GROUP, GAIN = 8, 200_000, 8, 200_000, 0.001


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin numbers by best fit in falling order of size; ties in the order given."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by their room
    open_rooms: list[int] = []  # rooms that some bin has, rising
    out, made = [0] * len(sizes), 0
    for i in order:
        k = bisect.bisect_left(open_rooms, sizes[i])
        if k == len(open_rooms):
            b, left, made = made, capacity - sizes[i], made + 1
        else:
            r = open_rooms[k]
            b, left = room[r].pop(), r - sizes[i]
            if not room[r]:
                del open_rooms[k]
        out[i] = b
        if left:
            if not room[left]:
                bisect.insort(open_rooms, left)
            room[left].append(b)
    return out


def pack(items: DataFrame, capacity: int, key: str = "item", size: str = "size", group: int = GROUP) -> DataFrame:
    """(key, size, container STRING) for each item with 0 < size <= capacity; other sizes must be cut or left out before.

    Keys must be unique. The packing depends on how the items lie in partitions; it is settled by being written down.
    """
    kind = items.schema[key].dataType.simpleString()

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, k = [], 0, 0
        for f in frames:
            held.append(f)
            n += len(f)
            if n >= CHUNK:
                yield one(pd.concat(held), k)
                held, n, k = [], 0, k + 1
        if held:
            yield one(pd.concat(held), k)

    def one(f: pd.DataFrame, k: int) -> pd.DataFrame:
        from pyspark import TaskContext

        stem = f"{TaskContext.get().partitionId()}.{k}."
        return f.assign(bin=[f"{stem}{b}" for b in best_fit(f["s"].tolist(), capacity)])

    packed = materialise(items.select(F.col(key).alias("k"), F.col(size).cast("int").alias("s")).mapInPandas(first, f"k {kind}, s int, bin string"))
    bins = packed.groupBy("bin").agg(F.sum("s").cast("int").alias("s"))
    under = materialise(bins.filter(F.col("s") < capacity - SLACK).withColumn("g", F.split("bin", r"\.")[0].cast("int")))
    state = under.agg(F.max("g").alias("g"), F.count(F.lit(1)).alias("n")).first()
    n_groups, left, maps, round_ = (state["g"] or 0) + 1, state["n"], None, 0

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["s", "bin"])
        to = pd.Series(best_fit(pdf["s"].tolist(), capacity), index=pdf.index)
        return pd.DataFrame({"bin": pdf["bin"], "head": pdf["bin"].groupby(to).transform("first"), "s": pdf["s"].groupby(to).transform("sum"), "g": pdf["g"]})

    while n_groups > 1 or left > group:
        n_groups, round_ = -(-n_groups // FAN_IN), round_ + 1
        up = under.withColumn("g", F.floor(F.col("g") / FAN_IN).cast("int"))
        parts = up.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / group).alias("parts"))  # as many rows as groups
        split = up.join(F.broadcast(parts), "g").withColumn("h", F.pmod(F.xxhash64("bin", F.lit(round_)), F.col("parts")))
        level = materialise(split.groupBy("g", "h").applyInPandas(merge, "bin string, head string, s int, g int"))
        moved = level.select("bin", "head")
        maps = moved if maps is None else maps.join(moved.select(F.col("bin").alias("head"), F.col("head").alias("top")), "head", "left").select("bin", F.coalesce("top", "head").alias("head"))
        under = level.filter((F.col("bin") == F.col("head")) & (F.col("s") < capacity - SLACK)).select("bin", "s", "g")
        before, left = left, under.count()
        if n_groups == 1 and before - left < GAIN * before:
            break
    out = packed if maps is None else packed.join(maps, "bin", "left").withColumn("bin", F.coalesce("head", "bin"))
    return out.select(F.col("k").alias(key), F.col("s").alias(size), F.col("bin").alias("container"))


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, part, start_token, tokens, container): the place of each document.

    A document longer than a container is cut into full containers and a rest, which is packed like any other item; every
    other document stays whole (part 0). Null and empty texts have no row.
    """
    sized = token_sizes(docs, tokenizer=tokenizer, folder=folder).filter("n_tokens > 0")
    parts = sized.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("int"))).alias("part"), "n_tokens")
    parts = parts.select(F.struct("doc_id", "part").alias("item"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("part") * capacity).cast("int").alias("size"))
    got = pack(parts.select(F.concat_ws("/", "item.doc_id", "item.part").alias("item"), "size"), capacity)
    cut = F.split("item", "/")
    kind = docs.schema["doc_id"].dataType
    return got.select(cut[0].cast(kind).alias("doc_id"), cut[1].cast("int").alias("part"), (cut[1].cast("long") * capacity).alias("start_token"), F.col("size").cast("int").alias("tokens"), "container")
