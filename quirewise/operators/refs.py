"""References: their sentences, citations in the text, and joins with retractions, replications, miscitations and registers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.functions import patterns as P
from quirewise.functions import text as T
from quirewise.operators import search as Q
from quirewise.operators.checks import lights

MENTION = r"([A-Z][\p{L}'’-]+)(?: (?:&|and) [A-Z][\p{L}'’-]+| et al\.?)?,? \(?((?:1[6-9]|20)[0-9][0-9])"


def doi_key(c: Column | str) -> Column:
    """A DOI for joins: small letters, no blanks at the ends; empty ones are null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def ref_table(spark: SparkSession, d: str) -> DataFrame:
    """Every reference with the sentence it stands in, null if none is known."""
    s = Q.sentences(spark, d).select("paper_id", "text_id", F.col("text").alias("sentence"))
    return Q.references(spark, d).withColumn("doi", doi_key("doi")).join(s, ["paper_id", "text_id"], "left")


@Q.once
def xrefs(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, text_id, ord, xref_type, target, contents): cross references in the XML of the sentences, but for addresses."""
    return xrefs_of(Q.sentences(spark, d))


def xrefs_of(sentence: DataFrame) -> DataFrame:
    rx = r'<ref type="([a-z]+)"(?: target="([^"]*)")?[^>]*>([^<]*)</ref>'
    x = sentence.filter(F.col("formatted").contains("<ref")).select("paper_id", "text_id", F.posexplode(F.regexp_extract_all("formatted", F.lit(rx), F.lit(0))).alias("ord", "m"))
    g = lambda k: F.regexp_extract("m", rx, k)
    return x.select("paper_id", "text_id", "ord", g(1).alias("xref_type"), F.regexp_extract(g(2), "([0-9]+)", 1).try_cast("int").alias("target"), T.strip_tags(g(3)).alias("contents")).filter("xref_type <> 'url'")


def mentions(text: DataFrame) -> DataFrame:
    """(paper_id, text_id, name, year): author-year citations in the text, names in small letters."""
    x = text.filter(F.col("text").rlike("(?:1[6-9]|20)[0-9][0-9]")).select("paper_id", "text_id", F.explode(F.regexp_extract_all("text", F.lit(MENTION), F.lit(0))).alias("m"))
    return x.select("paper_id", "text_id", F.lower(F.regexp_extract("m", MENTION, 1)).alias("name"), F.regexp_extract("m", MENTION, 2).cast("int").alias("year"))


def first_names(refs: DataFrame) -> DataFrame:
    """References with the surname of their first author as ``name``."""
    return refs.withColumn("name", T.surname(F.split("authors", ";")[0]))


def citation_status(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, bib_id, cited): a reference is cited if a sentence names its first author and year, or a cross reference points to it."""
    text = Q.text_table(spark, d)
    said = mentions(text).select("paper_id", "name", "year").distinct().withColumn("m", F.lit(True))
    pointed = xrefs(spark, d).filter("xref_type = 'bibr'").select("paper_id", F.col("target").alias("bib_id")).distinct().withColumn("x", F.lit(True))
    r = first_names(Q.references(spark, d)).select("paper_id", "bib_id", "name", "year")
    return r.join(said, ["paper_id", "name", "year"], "left").join(pointed, ["paper_id", "bib_id"], "left").select("paper_id", "bib_id", (F.col("m").isNotNull() | F.col("x").isNotNull()).alias("cited"))


def orphans(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, name, year): citations for which the bibliography has no author of that surname in that year."""
    names = Q.references(spark, d).select("paper_id", "year", F.explode(F.split("authors", ";")).alias("a")).select("paper_id", "year", T.surname(F.col("a")).alias("name")).distinct()
    return mentions(Q.text_table(spark, d)).select("paper_id", "name", "year").distinct().join(names, ["paper_id", "name", "year"], "left_anti")


def ref_consistency(spark: SparkSession, d: str) -> DataFrame:
    n = citation_status(spark, d).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_bib"), F.count_if("cited").alias("n_cited"), F.count_if(~F.col("cited")).alias("n_uncited"))
    o = orphans(spark, d).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_orphan"))
    out = Q.papers(spark, d).join(n, "paper_id", "left").join(o, "paper_id", "left").fillna(0)
    return out.withColumn("traffic_light", lights((F.col("n_bib") == 0, "na"), ((F.col("n_uncited") > 0) | (F.col("n_orphan") > 0), "red"), other="green"))


def lookup(spark: SparkSession, d: str, dim: DataFrame, key: str = "doi") -> DataFrame:
    """References joined with a table of DOIs; the table's size decides how."""
    r = Q.references(spark, d).withColumn("doi", doi_key("doi")).select("paper_id", "bib_id", "doi", "title")
    return r.join(dim.withColumnRenamed(key, "doi"), "doi")


def _counted(spark: SparkSession, d: str, rows: DataFrame, column: str, some: str, none: str = "na") -> DataFrame:
    n = rows.groupBy("paper_id").agg(F.count(F.lit(1)).alias(column))
    return Q.papers(spark, d).join(n, "paper_id", "left").fillna(0).withColumn("traffic_light", lights((F.col(column) > 0, some), other=none))


def ref_retraction(spark: SparkSession, d: str, retractions: DataFrame) -> DataFrame:
    return _counted(spark, d, lookup(spark, d, retractions), "retractionwatch", "info")


def ref_miscitation(spark: SparkSession, d: str, miscited: DataFrame) -> DataFrame:
    """Miscited works; green where none is, as the table was there to look in."""
    return _counted(spark, d, lookup(spark, d, miscited), "miscite_n", "yellow", "green")


def ref_pubpeer(spark: SparkSession, d: str, comments: DataFrame) -> DataFrame:
    """Comments (doi, total_comments, users) on references, but for those that only a program made."""
    rows = lookup(spark, d, comments).filter((F.col("total_comments") > 0) & (F.size(F.filter("users", lambda u: u != "Statcheck")) > 0))
    n = rows.groupBy("paper_id").agg(F.sum("total_comments").alias("pubpeer_comments"))
    return Q.papers(spark, d).join(n, "paper_id", "left").fillna(0).withColumn("traffic_light", lights((F.col("pubpeer_comments") > 0, "info"), other="na"))


def replications(spark: SparkSession, d: str, pairs: DataFrame) -> DataFrame:
    """Replications (doi_o, doi_r, outcome, url_r) of cited works that the paper doesn't cite itself."""
    cited = Q.references(spark, d).select("paper_id", doi_key("doi").alias("doi_r")).filter("doi_r IS NOT NULL")
    hit = lookup(spark, d, pairs.withColumn("doi_r", doi_key("doi_r")), "doi_o")
    out = hit.join(cited, ["paper_id", "doi_r"], "left_anti")
    return out.select("paper_id", "bib_id", "doi", "doi_r", "outcome", F.coalesce("url_r", F.concat(F.lit("https://doi.org/"), "doi_r")).alias("link"))


def ref_replication(spark: SparkSession, d: str, pairs: DataFrame) -> DataFrame:
    return _counted(spark, d, replications(spark, d, pairs), "replications", "info")


def ref_accuracy_rows(spark: SparkSession, d: str, register: DataFrame) -> DataFrame:
    """References with a DOI against the register's record of it (doi, title, year, authors: family names in small letters): no record,
    or which parts differ. A part that one side lacks doesn't differ; every author of the record must be among those of the reference."""
    reg = register.select(doi_key("doi").alias("doi"), F.struct("title", "year", "authors").alias("r")).filter("doi IS NOT NULL").groupBy("doi").agg(F.min("r").alias("r"))
    b = Q.references(spark, d).withColumn("doi", doi_key("doi")).filter("doi IS NOT NULL").select("paper_id", "bib_id", "doi", "title", "year", "authors")
    x = b.join(reg, "doi", "left")
    names = F.filter(F.transform(F.split("authors", ";"), T.surname), lambda n: n != "")
    author_off = (F.size(names) > 0) & (F.size("r.authors") > 0) & ~F.forall("r.authors", lambda t: F.exists(names, lambda n: F.contains(n, t)))
    no = F.lit(False)
    return x.select("paper_id", "bib_id", "doi", F.col("r").isNull().alias("no_match"), F.coalesce(F.col("year") != F.col("r.year"), no).alias("year_mismatch"), T.title_mismatch(F.col("title"), F.col("r.title")).alias("title_mismatch"), F.coalesce(author_off, no).alias("author_mismatch"))


_PARTS = ("no_match", "year_mismatch", "title_mismatch", "author_mismatch")


def ref_accuracy(spark: SparkSession, d: str, register: DataFrame) -> DataFrame:
    n = ref_accuracy_rows(spark, d, register).groupBy("paper_id").agg(F.count(F.lit(1)).alias("refs_checked"), *[F.count_if(c).alias(c) for c in _PARTS])
    out = Q.papers(spark, d).join(n, "paper_id", "left").fillna(0)
    issues = F.col("no_match") + F.col("year_mismatch") + F.col("title_mismatch") + F.col("author_mismatch") > 0
    return out.withColumn("traffic_light", lights((F.col("refs_checked") == 0, "na"), (issues, "yellow"), other="green"))


def ref_summary(spark: SparkSession, d: str, retractions: DataFrame, miscited: DataFrame, pairs: DataFrame, register: DataFrame, comments: DataFrame) -> DataFrame:
    """Every reference with what the reference checks found about it: left joins of their details."""
    out = Q.references(spark, d).select("paper_id", "bib_id", doi_key("doi").alias("doi"))
    off = ref_accuracy_rows(spark, d, register).filter(" OR ".join(_PARTS))
    for name, rows in (("retracted", lookup(spark, d, retractions)), ("miscited", lookup(spark, d, miscited)), ("replicated", replications(spark, d, pairs)), ("inaccurate", off)):
        out = out.join(rows.select("paper_id", "bib_id").distinct().withColumn(name, F.lit(True)), ["paper_id", "bib_id"], "left")
    details = replications(spark, d, pairs).groupBy("paper_id", "bib_id").agg(F.array_join(F.array_sort(F.collect_set("outcome")), ";").alias("outcomes"))
    said = lookup(spark, d, comments).groupBy("paper_id", "bib_id").agg(F.sum("total_comments").alias("comments"))
    out = out.join(details, ["paper_id", "bib_id"], "left").join(said, ["paper_id", "bib_id"], "left")
    return out.fillna(False, ["retracted", "miscited", "replicated", "inaccurate"]).fillna(0, ["comments"]).fillna("", ["outcomes"])


def repo_check(links: DataFrame, files: DataFrame) -> DataFrame:
    """(paper_id, repo_n, files_n, data, code, readme, zip, light): repositories linked by papers and their listed files (url, path)."""
    repos = links.filter(F.col("kind") != "other").select("paper_id", "url").distinct()
    f = files.select("url", T.file_type(F.col("path")).alias("t"))
    x = repos.join(f, "url", "left").groupBy("paper_id").agg(F.count_distinct("url").alias("repo_n"), F.count("t").alias("files_n"), *[F.count_if(F.col("t") == t).alias(f"files_{t}") for t in ("data", "code", "readme", "archive")])
    return x.withColumn("traffic_light", lights((F.col("repo_n") == 0, "na"), (F.col("files_archive") > 0, "yellow"), other="green"))


def prereg_check(links: DataFrame, states: DataFrame) -> DataFrame:
    """(paper_id, osf_links, osf_registrations, aspredicted_links): what kind of thing (osf_id, osf_type) the linked archive ids are."""
    x = links.withColumn("osf_id", F.nullif(Q.osf_id(F.col("url")), F.lit(""))).join(states, "osf_id", "left")
    n = x.groupBy("paper_id").agg(F.count_if(F.col("kind") == "osf").alias("osf_links"), F.count_if(F.col("osf_type") == "registrations").alias("osf_registrations"), F.count_if(F.col("kind") == "aspredicted").alias("aspredicted_links"))
    n = n.filter("osf_links + aspredicted_links > 0").withColumn("preregistration", (F.col("osf_registrations") > 0) | (F.col("aspredicted_links") > 0))
    return n.withColumn("traffic_light", F.lit("info"))


def code_check(files: DataFrame) -> DataFrame:
    """(id, language, n_lines, ..., issues) of code files (id, name, content)."""
    x = files.select("id", T.code_language(F.col("name")).alias("language"), T.code_review(F.col("content")).alias("r")).select("id", "language", "r.*")
    return x.withColumn("issues", (F.col("n_absolute_paths") > 0).cast("int") + F.col("unseeded").cast("int") + (F.col("n_comments") == 0).cast("int"))
