"""Files of a library: listing, texts of several formats, an incremental cache, and look-up tables in place of web services."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from quirewise.functions import text as T

LIMIT = 60_000_000
# Endings of readable files.
ENDINGS = ("pdf", "docx", "txt", "md", "html", "htm", "xml")


def list_library(spark: SparkSession, path: str, limit: int = LIMIT) -> DataFrame:
    """(path, content, length, modificationTime, kind): readable files below a folder up to a size, by their first bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.filter((F.col("length") <= limit) & F.lower("path").rlike(r"\.(" + "|".join(ENDINGS) + ")$")).withColumn("kind", T.sniff(F.col("content")))


def docx_text(content: bytes) -> str | None:
    """Paragraph texts of a word-processor file; null if it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            xml = z.read("word/document.xml").decode("utf-8", "replace")
    except (KeyError, zipfile.BadZipFile):
        return None
    paragraphs = re.findall(r"<w:p[ >].*?</w:p>", xml, re.S)
    return "\n".join("".join(re.findall(r"<w:t[^>]*>([^<]*)</w:t>", p)) for p in paragraphs).strip() or None


def pdf_text(content: bytes) -> str | None:
    """Text of a PDF by whatever reader is installed; null without one."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return None
    return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages) or None


def article_text(xml):
    """Text of an article's full-text XML without its reference list, tables and front matter."""
    for tag in ("front", "ref-list", "table-wrap", "xref"):
        xml = F.regexp_replace(xml, rf"(?s)<{tag}[ >].*?</{tag}>", " ")
    return T.strip_tags(xml)


def texts(files: DataFrame) -> DataFrame:
    """(path, text, title, doi): texts by format; mark-up and plain text in the JVM, the others in Arrow batches."""
    marked = files.filter(F.col("kind") == "markup").select("path", T.html_to_text(F.decode("content", "UTF-8")).alias("text"), F.nullif(T.strip_tags(F.regexp_extract(F.decode("content", "UTF-8"), r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")).alias("title"))
    plain = files.filter(F.col("kind") == "other").select("path", F.decode("content", "UTF-8").alias("text"), F.lit(None).cast("string").alias("title"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [docx_text(bytes(c)) if k == "zip" else pdf_text(bytes(c)) for c, k in zip(f["content"], f["kind"])]
            yield pd.DataFrame({"path": f["path"], "text": pd.Series(got, dtype="object"), "title": None})

    packed = files.filter(F.col("kind").isin("zip", "pdf")).select("path", "content", "kind").mapInPandas(read, "path string, text string, title string")
    both = marked.unionByName(plain).unionByName(packed)
    return both.withColumn("doi", F.nullif(F.lower(F.regexp_extract(F.substring("text", 1, 6000), r"(10\.[0-9]{4,9}/[^\s\"<>]+)", 1)), F.lit("")))


def with_key(files: DataFrame) -> DataFrame:
    """Files with the key under which their text is kept: it changes with path, time and size."""
    return files.withColumn("key", F.sha1(F.concat_ws("|", "path", F.col("modificationTime").cast("string"), F.col("length").cast("string"))))


def refresh(spark: SparkSession, files: DataFrame, cache: str) -> DataFrame:
    """Texts of all files from a parquet cache, which first gets those that are new or changed."""
    keyed = with_key(files)
    schema = "path string, text string, title string, doi string, key string"
    try:
        old = spark.read.schema(schema).parquet(cache)
        fresh = keyed.join(old.select("key"), "key", "left_anti")
    except Exception as e:  # the cache doesn't exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = keyed
    texts(fresh).join(fresh.select("path", "key"), "path").select("path", "text", "title", "doi", "key").write.mode("append").parquet(cache)
    return spark.read.schema(schema).parquet(cache).join(keyed.select("key"), "key", "left_semi")


def dimension(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """A look-up table from parquet, CSV or JSON by ending; without a path an empty one of the schema."""
    if path is None:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    raw = reader.csv(path, header=True) if path.endswith((".csv", ".csv.gz")) else reader.json(path) if path.endswith((".json", ".jsonl")) else reader.parquet(path)
    out = raw
    for f in raw.schema.fields:
        if isinstance(f.dataType, ST.StringType) and f.name.startswith("doi"):
            out = out.withColumn(f.name, F.nullif(F.lower(F.trim(f.name)), F.lit("")))
    return out.distinct()


# The columns of the look-up tables that stand for databases and services.
SCHEMAS = {
    "retraction": "doi string, note string",
    "replication": "doi_o string, apa_ref_o string, doi_r string, apa_ref_r string, url_r string, outcome string, outcome_quote string, type string",
    "miscitation": "doi string, reftext string, warning string",
    "comments": "doi string, total_comments bigint, users array<string>",
    "registry": "doi string, message string",
    "osf": "osf_id string, osf_type string",
    "repo_file": "url string, path string, size bigint, type string",
    "file_content": "url string, content string",
    "http_status": "url string, code int",
}


def registry_fields(rows: DataFrame) -> DataFrame:
    """(doi, title, year, authors) out of the JSON messages of a register: the first date that is given, family names in small letters."""
    year = F.coalesce(*[F.get_json_object("message", f"$.{f}['date-parts'][0][0]") for f in ("published-print", "published-online", "issued", "created")]).cast("int")
    people = F.from_json(F.get_json_object("message", "$.author"), "array<struct<family:string,given:string>>")
    return rows.select("doi", F.get_json_object("message", "$.title[0]").alias("title"), year.alias("year"), F.transform(people, lambda p: F.lower(p["family"])).alias("authors"))


def link_states(urls: DataFrame, status: DataFrame) -> DataFrame:
    """(url, code, state) of every distinct address by a table of status codes."""
    return urls.select("url").distinct().join(status, "url", "left").select("url", "code", T.http_state(F.col("code")).alias("state"))


def write_phrase_log(phrases: DataFrame, path: str, run: str, seed: int, requested: int | None = None, skip_used: bool = False) -> None:
    """Append the phrases of a run to the log, with the time, how many were asked for, and whether used ones were left out."""
    phrases.select("paper_id", "phrase", F.lit(run).alias("run"), F.lit(seed).alias("seed"), F.current_timestamp().alias("at"), F.lit(requested).cast("int").alias("requested"), F.lit(skip_used).alias("skip_used")).write.mode("append").partitionBy("run").parquet(path)


def read_phrase_log(spark: SparkSession, path: str) -> DataFrame:
    """The log, empty if there is none yet."""
    schema = "paper_id string, phrase string, seed int, at timestamp, requested int, skip_used boolean, run string"
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
