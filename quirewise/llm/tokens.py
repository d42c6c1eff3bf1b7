"""Encoding of a corpus with a public tokenizer through a table of distinct words.

The text is cut into the tokenizer's words on the executors, every distinct word of the corpus is encoded once, and the
ids come back to the words by position. Null and empty texts have an empty list of ids; repeated rows stay.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.runtime import materialise

TOKENIZERS = os.environ.get("TOKENIZERS_PATH", "/opt/tokenizers")
#: The fixed pattern by which the vocabularies of byte-level BPE were made.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Beyond so many distinct words, or so many characters in them, only the most frequent words are sent to the executors, the others are joined by a shuffle.
TABLE_WORDS, TABLE_CHARS = 1_500_000, 24_000_000
_FLUSH = 200_000
_state: dict = {}


def _splitter():
    if "split" not in _state:
        import regex

        _state["split"] = regex.compile(PATTERN)
    return _state["split"]


def ranks(name: str, folder: str) -> dict[bytes, int]:
    """The vocabulary file ``name`` as pieces with their ids."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoder(name: str, folder: str):
    key = ("encoder", name, folder)
    if key not in _state:
        import tiktoken

        _state[key] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks(name, folder), special_tokens={})
    return _state[key]


def distinct_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): every word of the texts with its count over all rows; counted per task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = _splitter(), {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    for w in split.findall(t):
                        seen[w] = seen.get(w, 0) + 1
                    if len(seen) > _FLUSH:
                        yield out()
                        seen.clear()
        if seen:
            yield out()

    return docs.select(F.col(text)).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_table(docs: DataFrame, text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(word, ids, n): the ids of every distinct word, each encoded once, with its count; written to the shared folder."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _encoder(tokenizer, folder)._core_bpe.encode_single_piece
        for batch in batches:
            words = batch.column(0)
            yield pa.RecordBatch.from_arrays([words, pa.array([one(w.encode()) for w in words.to_pylist()], pa.list_(pa.int32())), batch.column(1)], ["word", "ids", "n"])

    return materialise(distinct_words(docs, text).mapInArrow(encode, "word string, ids array<int>, n long"))


def _by_table(docs: DataFrame, key: str, text: str, words: DataFrame, sizes: bool) -> DataFrame:
    """Ids (or their number) by a look-up in the word table on the executors; for a table of checked size."""
    import numpy as np

    rows = words.toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(
        (rows.column("word").to_pylist(), np.concatenate([[0], np.cumsum(rows.column("ids").combine_chunks().value_lengths().fill_null(0).to_numpy())]).astype("int64"), rows.column("ids").combine_chunks().flatten().to_numpy().astype("int32"))
    )
    token = uuid.uuid4().hex

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _splitter()
        if _state.get("token") != token:
            listed, starts, ids = sent.value
            _state.update(token=token, at=dict(zip(listed, range(len(listed)))), starts=starts, ids=ids)
        at, starts, ids = _state["at"].__getitem__, _state["starts"], _state["ids"]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo in range(0, len(texts), 256):
                part = texts[lo : lo + 256]
                found = [list(map(at, split.findall(t))) if t else [] for t in part]
                per = np.fromiter(map(len, found), "int64", len(found))
                flat = np.fromiter((i for x in found for i in x), "int64", int(per.sum()))
                lengths = starts[flat + 1] - starts[flat]
                ends = np.concatenate([[0], np.cumsum(lengths)])
                bounds = ends[np.concatenate([[0], np.cumsum(per)])]
                keys = batch.column(0).slice(lo, len(part))
                if sizes:
                    yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(bounds), pa.int64())], [key, "n_tokens"])
                else:
                    places = np.repeat(starts[flat] - ends[:-1], lengths) + np.arange(ends[-1])
                    got = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids[places], pa.int32()))
                    yield pa.RecordBatch.from_arrays([keys, got], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(encode, f"`{key}` {kind}, n_tokens long" if sizes else f"`{key}` {kind}, ids array<int>")


def _by_join(docs: DataFrame, key: str, text: str, words: DataFrame, sizes: bool, table_words: int) -> DataFrame:
    """The same for a larger table: the most frequent words are sent to the executors, so that no word of the join is frequent, the
    others are joined by a shuffle on the word. Rows are kept apart by an id of their own, so repeated keys stay repeated."""
    # a power of two above which words are frequent, so that they keep to the bounds of the table
    steps = words.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("w"), F.sum(F.length("word") + F.size("ids")).alias("c")).orderBy(F.desc("k")).collect()  # at most 64 rows
    k, many, chars = 64, 0, 0
    for step in steps:
        many, chars = many + step["w"], chars + step["c"]
        if many > table_words or chars > TABLE_CHARS:
            break
        k = step["k"]
    often = words.filter(F.col("n") >= 2.0**k).select("word", "ids").toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(dict(zip(often.column("word").to_pylist(), often.column("ids").to_pylist())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = _splitter(), sent.value
        for batch in batches:
            row, pos, word, ids = [], [], [], []

            def put(i: int, at: int, w: str | None, x: list[int] | None) -> None:
                row.append(i)
                pos.append(at)
                word.append(w)
                ids.append(x)

            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held: list[int] = []
                at = -1
                for at, w in enumerate(split.findall(t) if t else ()):
                    x = known.get(w)
                    if x is not None:
                        held += x
                        continue
                    if held:
                        put(i, 2 * at, None, held)
                        held = []
                    put(i, 2 * at + 1, w, None)
                if held:
                    put(i, 2 * at + 2, None, held)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(pos, pa.int32()), pa.array(word, pa.string()), pa.array(ids, pa.list_(pa.int32()))], ["row", "pos", "word", "ids"])

    # the row ids are written down first: monotonically_increasing_id isn't the same in a repeated task
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text")))
    cuts = materialise(rows.select("row", "text").mapInArrow(cut, "row long, pos int, word string, ids array<int>"))
    rare = cuts.filter("word IS NOT NULL").select("row", "pos", "word").join(words.filter(F.col("n") < 2.0**k).select("word", "ids"), "word").select("row", "pos", "ids")
    at = cuts.filter("ids IS NOT NULL").select("row", "pos", "ids").unionByName(rare)
    if sizes:
        got = at.groupBy("row").agg(F.sum(F.size("ids")).alias("v"))
        return rows.select("row", "key").join(got, "row", "left").select(F.col("key").alias(key), F.coalesce("v", F.lit(0)).cast("long").alias("n_tokens"))
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"]))
    got = at.groupBy("row").agg(ordered.alias("v"))
    return rows.select("row", "key").join(got, "row", "left").select(F.col("key").alias(key), F.coalesce("v", F.array().cast("array<int>")).alias("ids"))


def _encode(docs: DataFrame, key: str, text: str, tokenizer: str, folder: str, table_words: int, sizes: bool) -> DataFrame:
    words = word_table(docs, text, tokenizer, folder)
    size = words.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("word") + F.size("ids")), F.lit(0)).alias("c")).first()
    if size["n"] <= table_words and size["c"] <= TABLE_CHARS:
        return _by_table(docs, key, text, words.select("word", "ids"), sizes)
    return _by_join(docs, key, text, words, sizes, table_words)


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, table_words: int = TABLE_WORDS) -> DataFrame:
    """(key, ids) for each row: the ids of its text without special tokens, whose strings count as ordinary text.

    A null or an empty text gives an empty list; a null key stays null; an empty table gives no row.
    """
    return _encode(docs, key, text, tokenizer, folder, table_words, False)


def token_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, table_words: int = TABLE_WORDS) -> DataFrame:
    """(key, n_tokens) for each row: the number of its ids; 0 for a null or an empty text."""
    return _encode(docs, key, text, tokenizer, folder, table_words, True)


def pieces(spark: SparkSession, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, piece BINARY): the vocabulary, of fixed size."""
    return spark.createDataFrame([(i, bytearray(p)) for p, i in ranks(tokenizer, folder).items()], "id int, piece binary")


def decode_corpus(encoded: DataFrame, key: str = "doc_id", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, text): texts put together again by a join of ids with pieces; keys must be unique; an empty list gives an empty text."""
    spark = encoded.sparkSession
    joined = encoded.select(F.col(key).alias("key"), F.posexplode("ids").alias("pos", "id")).join(F.broadcast(pieces(spark, tokenizer, folder)), "id")

    def whole(c: Column) -> Column:
        return F.decode(F.unhex(F.array_join(F.transform(F.array_sort(c), lambda x: x["h"]), "")), "UTF-8")

    got = joined.groupBy("key").agg(whole(F.collect_list(F.struct("pos", F.hex("piece").alias("h")))).alias("text"))
    return encoded.select(F.col(key).alias("key")).join(got, "key", "left").select(F.col("key").alias(key), F.coalesce("text", F.lit("")).alias("text"))
