"""Text overlap of manuscripts with a library: shared six-word shingles, runs of eight words and more, coverage and light.

Words are taken sentence by sentence and runs don't cross sentences, so no paper's text ever sits in one row. Quotations and
author-year citations are masked: a mask is one word that no shingle may hold and that isn't scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirewise.functions import text as T
from quirewise.functions.stats import let
from quirewise.operators import search as Q
from quirewise.operators.checks import lights
from quirewise.operators.ranks import numbered
from quirewise.operators.refs import doi_key
from quirewise.runtime import materialise, table

SHINGLE, MIN_RUN, PHRASE, PASSAGES = 6, 8, 9, 25
QUOTED = r"[“\"][^“”\"]{25,700}[”\"]"
CITED = r"\([^()]{0,200}(?:1[6-9]|20)[0-9][0-9][a-z]?[^()]{0,200}\)"
MASK = "§"


def word_list(c: Column) -> Column:
    """Words of a text with masks for quotations and citations."""
    masked = F.regexp_replace(F.regexp_replace(c, QUOTED, f" {MASK} "), CITED, f" {MASK} ")
    return F.regexp_extract_all(F.lower(masked), F.lit(rf"{MASK}|[\p{{L}}\p{{N}}]+(?:['’][\p{{L}}\p{{N}}]+)?"), F.lit(0))


@Q.once
def manuscripts(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, text_id, w): words of the sentences of all papers outside references, figures and tables."""
    rows = Q.text_table(spark, d).filter(~F.coalesce("section_type", F.lit("")).isin("figure", "table") & (F.length(F.trim("text")) > 0))
    return rows.select("paper_id", "text_id", word_list(F.col("text")).alias("w"))


def library(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_text").filter("text IS NOT NULL").select("source_id", word_list(F.col("text")).alias("w"))


def grams(rows: DataFrame, keys: list[str], k: int = SHINGLE) -> DataFrame:
    """(keys, pos, gram): every k words in a row without a mask."""
    g = let(F.col("w"), lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.struct(i.alias("pos"), F.slice(w, i + 1, F.lit(k)).alias("x"))))
    x = rows.filter(F.size("w") >= k).select(*keys, F.explode(g).alias("g")).filter(~F.array_contains("g.x", MASK))
    return x.select(*keys, F.col("g.pos").alias("pos"), F.array_join("g.x", " ").alias("gram"))


@Q.once
def runs(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, text_id, source_id, start_word, end_word, source_start): runs of MIN_RUN words and more that lie under shared shingles."""
    src = grams(library(spark, d), ["source_id"]).groupBy("gram", "source_id").agg(F.min("pos").alias("spos"))
    hit = grams(manuscripts(spark, d), ["paper_id", "text_id"]).join(src, "gram")
    w = Window.partitionBy("paper_id", "text_id", "source_id").orderBy("pos")
    new = (F.col("pos") - F.lag("pos").over(w) > SHINGLE) | F.lag("pos").over(w).isNull()
    isle = hit.withColumn("isle", F.sum(new.cast("int")).over(w))
    g = isle.groupBy("paper_id", "text_id", "source_id", "isle").agg(F.min("pos").alias("start_word"), (F.max("pos") + SHINGLE).alias("end_word"), F.min_by("spos", "pos").alias("source_start"))
    return g.filter(F.col("end_word") - F.col("start_word") >= MIN_RUN).drop("isle")


@Q.once
def scored_words(spark: SparkSession, d: str) -> DataFrame:
    return manuscripts(spark, d).groupBy("paper_id").agg(F.sum(F.size(F.filter("w", lambda x: x != MASK))).alias("n_scored"))


def flags(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, source_id, same_work, cited) of pairs where either holds: equal DOI or alike titles; DOI or title among the references."""
    src = table(spark, d, "source_text").select("source_id", doi_key("doi").alias("doi"), T.normalise(F.col("title")).alias("t"), "title", "kind")
    pap = table(spark, d, "paper").select("paper_id", doi_key("doi").alias("pdoi"), F.col("title").alias("ptitle")).distinct()
    by_doi = pap.join(src, F.col("pdoi") == F.col("doi")).select("paper_id", "source_id")
    a = pap.select("paper_id", "ptitle", F.explode(T.content_words(F.col("ptitle"))).alias("word"))
    b = src.select("source_id", "title", F.explode(T.content_words(F.col("title"))).alias("word"))
    by_title = a.join(b, "word").select("paper_id", "source_id", "ptitle", "title").distinct().filter(T.title_similarity(F.col("ptitle"), F.col("title")) >= 0.7).select("paper_id", "source_id")
    same = by_doi.union(by_title).distinct().withColumn("same_work", F.lit(True))
    refs = Q.references(spark, d).select("paper_id", doi_key("doi").alias("rdoi"), T.normalise(F.col("title")).alias("rt"))
    c1 = refs.filter("rdoi IS NOT NULL").join(src, F.col("rdoi") == F.col("doi")).select("paper_id", "source_id")
    # a title's beginning of 80 characters stands in a reference's title: its first two words meet any two of the reference, then it is looked for
    key = F.array_join(F.slice(F.split("t", " "), 1, 2), " ")
    two = let(F.split("rt", " "), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(2)), " ")))
    titles = src.withColumn("st", F.substring("t", 1, 80)).filter(F.length("st") > 20).select("source_id", key.alias("two"), F.concat(F.lit(" "), "st", F.when(F.length("t") > 80, "").otherwise(" ")).alias("st"))
    c2 = refs.select("paper_id", "rt").distinct().withColumn("two", F.explode(F.array_distinct(two))).join(titles, "two").filter(F.contains(F.concat(F.lit(" "), "rt", F.lit(" ")), F.col("st"))).select("paper_id", "source_id")
    cited = c1.union(c2).distinct().withColumn("cited", F.lit(True))
    both = same.join(cited, ["paper_id", "source_id"], "full").fillna(False, ["same_work", "cited"])
    kinds = src.filter(F.col("kind").isin("online", "library")).select("source_id")
    return both.join(kinds, "source_id")


@Q.once
def sources(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, source_id, matched_words, n_runs, coverage, same_work, cited, rank, light) of every source a paper shares runs with."""
    return rated(spark, d, runs(spark, d))


def rated(spark: SparkSession, d: str, found: DataFrame) -> DataFrame:
    r = found.groupBy("paper_id", "source_id").agg(F.sum(F.col("end_word") - F.col("start_word")).alias("matched_words"), F.count(F.lit(1)).alias("n_runs"))
    x = r.join(scored_words(spark, d), "paper_id").withColumn("coverage", F.round(F.col("matched_words") / F.col("n_scored"), 6))
    x = x.join(flags(spark, d), ["paper_id", "source_id"], "left").fillna(False, ["same_work", "cited"])
    rank = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("coverage"), "source_id"))
    return x.select("paper_id", "source_id", "matched_words", "n_runs", "coverage", "same_work", "cited", rank.alias("rank"), lights((F.col("same_work"), "na"), (F.col("coverage") < 0.05, "green"), (F.col("coverage") < 0.15, "yellow"), other="red").alias("light"))


def union_coverage(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, n_scored, covered, covered_uncited, score, score_uncited, top, traffic_light): words covered by any source but the same
    work; na where the library is empty, as nothing was compared."""
    found = Q.written(runs(spark, d))  # used for the sources and for the words they cover
    s = materialise(rated(spark, d, found)).select("paper_id", "source_id", "same_work", "cited", "coverage")
    words = found.join(s, ["paper_id", "source_id"]).filter(~F.col("same_work")).select("paper_id", "text_id", "cited", F.explode(F.sequence("start_word", F.col("end_word") - 1)).alias("pos"))
    per = words.groupBy("paper_id", "text_id", "pos").agg(F.min("cited").alias("only_cited")).groupBy("paper_id").agg(F.count(F.lit(1)).alias("covered"), F.count_if(~F.col("only_cited")).alias("covered_uncited"))
    top = s.filter(~F.col("same_work")).groupBy("paper_id").agg(F.max("coverage").alias("top"))
    x = scored_words(spark, d).join(per, "paper_id", "left").join(top, "paper_id", "left").fillna(0)
    x = x.withColumn("score", F.when(F.col("n_scored") > 0, F.round(F.col("covered") / F.col("n_scored"), 6)).otherwise(0.0)).withColumn("score_uncited", F.when(F.col("n_scored") > 0, F.round(F.col("covered_uncited") / F.col("n_scored"), 6)).otherwise(0.0))
    nothing = library(spark, d).agg(F.count(F.lit(1)).alias("n")).scalar() == 0
    light = lights((nothing, "na"), ((F.col("score") >= 0.15) | (F.col("top") >= 0.15), "red"), ((F.col("score") >= 0.05) | (F.col("top") >= 0.08), "yellow"), other="green")
    return Q.papers(spark, d).join(x, "paper_id", "left").fillna(0).withColumn("traffic_light", light)


def passages(spark: SparkSession, d: str, most: int = PASSAGES) -> DataFrame:
    """(paper_id, source_id, k, manuscript, source): the first runs of each source with both wordings; a top-k report."""
    k = F.row_number().over(Window.partitionBy("paper_id", "source_id").orderBy("text_id", "start_word"))
    first = runs(spark, d).withColumn("k", k).filter(F.col("k") <= most)
    r = first.join(manuscripts(spark, d), ["paper_id", "text_id"]).join(library(spark, d).withColumnRenamed("w", "v"), "source_id")
    n = F.col("end_word") - F.col("start_word")
    return r.select("paper_id", "source_id", "k", F.array_join(F.slice("w", F.col("start_word") + 1, n), " ").alias("manuscript"), F.array_join(F.slice("v", F.col("source_start") + 1, n), " ").alias("source"))


def highlights(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, text_id, start_word, end_word, source_id): stretches of words by the source that owns them, the one of highest coverage."""
    r = runs(spark, d).join(sources(spark, d).select("paper_id", "source_id", "rank"), ["paper_id", "source_id"])
    words = r.select("paper_id", "text_id", "rank", "source_id", F.explode(F.sequence("start_word", F.col("end_word") - 1)).alias("pos")).groupBy("paper_id", "text_id", "pos").agg(F.min_by("source_id", "rank").alias("source_id"))
    w = Window.partitionBy("paper_id", "text_id", "source_id").orderBy("pos")
    isle = words.withColumn("isle", F.col("pos") - F.row_number().over(w))
    return isle.groupBy("paper_id", "text_id", "source_id", "isle").agg(F.min("pos").alias("start_word"), (F.max("pos") + 1).alias("end_word")).drop("isle")


def eligible_phrases(spark: SparkSession, d: str, per_row: int = 3) -> DataFrame:
    """(paper_id, text_id, rank, pos, score, phrase): of a sentence the best windows of nine words, greedily and apart from each other.

    A window needs five content words and no mask or number; sentences under twelve words have none.
    """
    stop = F.array(*map(F.lit, T.STOPWORDS))
    rows = manuscripts(spark, d).filter(F.size("w") >= 12)
    weight = F.transform("w", lambda x: F.when((x == MASK) | x.rlike("^[0-9]+$"), F.lit(-100)).otherwise(((F.length(x) > 3) & ~F.array_contains(stop, x)).cast("int")))
    rows = rows.withColumn("v", weight)
    win = let(F.col("v"), lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - PHRASE), lambda i: F.struct((-F.aggregate(F.slice(v, i + 1, F.lit(PHRASE)), F.lit(0), lambda a, x: a + x)).alias("neg"), i.alias("pos"))))
    rows = rows.withColumn("win", F.array_sort(F.filter(win, lambda x: x["neg"] <= -5)))

    def apart(picked: Column) -> Column:
        left = F.filter(F.col("win"), lambda x: F.forall(picked, lambda y: F.abs(x["pos"] - y["pos"]) >= PHRASE))
        return F.concat(picked, F.slice(left, 1, 1))

    picked = F.slice("win", 1, 1)
    for _ in range(per_row - 1):
        picked = let(picked, apart)
    x = rows.select("paper_id", "text_id", "w", F.posexplode(picked).alias("rank", "p"))
    return x.select("paper_id", "text_id", (F.col("rank") + 1).alias("rank"), F.col("p.pos").alias("pos"), (-F.col("p.neg")).alias("score"), F.array_join(F.slice("w", F.col("p.pos") + 1, F.lit(PHRASE)), " ").alias("phrase"))


def select_phrases(phrases: DataFrame, n: int, seed: int = 1, exclude: DataFrame | None = None) -> DataFrame:
    """(paper_id, bucket, phrase): a stratified sample of n phrases a paper, one from each stretch, by a seeded hash; used ones are left out."""
    if exclude is not None:
        phrases = phrases.join(exclude.select("phrase").distinct(), "phrase", "left_anti")
    k = numbered(phrases, ["paper_id"], ["text_id", "pos"], "k")
    total = k.groupBy("paper_id").agg(F.count(F.lit(1)).alias("total"))
    x = phrases.join(k, ["paper_id", "text_id", "pos"]).join(total, "paper_id")
    x = x.withColumn("bucket", F.floor((F.col("k") - 1) * n / F.greatest(F.lit(n), F.col("total"))).cast("int"))
    first = F.min(F.struct(F.md5(F.concat(F.lit(f"{seed}|"), "phrase")).alias("code"), "text_id", "pos", "phrase")).alias("f")
    return x.groupBy("paper_id", "bucket").agg(first).select("paper_id", "bucket", F.col("f.text_id").alias("text_id"), F.col("f.phrase").alias("phrase"))


def retrieve_candidates(spark: SparkSession, d: str, phrases: DataFrame, most_hits: int = 25) -> DataFrame:
    """(paper_id, source_id, n_phrases, score): sources that hold phrases of a paper; rare phrases count more, very common ones not at all."""
    g = grams(library(spark, d), ["source_id"], PHRASE).select("source_id", F.col("gram").alias("phrase")).distinct()
    df = g.groupBy("phrase").agg(F.count(F.lit(1)).alias("hits")).filter(F.col("hits") <= most_hits)
    x = phrases.select("paper_id", "phrase").distinct().join(g.join(df, "phrase"), "phrase")
    return x.groupBy("paper_id", "source_id").agg(F.count(F.lit(1)).alias("n_phrases"), F.round(F.sum(1.0 / F.col("hits")), 6).alias("score"))


def candidate_states(candidates: DataFrame, texts: DataFrame, max_sources: int = 15, least: int = 500) -> DataFrame:
    """(paper_id, source_id, score, rank, state): the best ``max_sources`` candidates of a paper whose text (source_id, text) has ``least``
    characters are compared, the others stay unverified."""
    rank = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("score"), "source_id"))
    x = candidates.withColumn("rank", rank).join(texts.select("source_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("size")), "source_id")
    return x.select("paper_id", "source_id", "score", "rank", F.when((F.col("rank") <= max_sources) & (F.col("size") >= least), "compared").otherwise("unverified").alias("state"))


def run(spark: SparkSession, d: str, max_passages: int = 120, max_sources: int = 15, seed: int = 1, used: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of a check of every manuscript: the phrases that are searched (those in ``used`` left out) and how many were left out, the
    candidates and their states, sources, passages, marks and the light."""
    eligible = eligible_phrases(spark, d)
    phrases = select_phrases(eligible, max_passages, seed, used)
    found = retrieve_candidates(spark, d, phrases)
    n = eligible.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_eligible"))
    left_out = eligible.join(used.select("phrase").distinct(), "phrase", "left_semi").groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_skipped")) if used is not None else n.select("paper_id", F.lit(0).alias("n_skipped"))
    counts = n.join(left_out, "paper_id", "left").fillna(0)
    return {"phrases": phrases, "counts": counts, "candidates": candidate_states(found, table(spark, d, "source_text"), max_sources), "sources": sources(spark, d), "passages": passages(spark, d), "highlights": highlights(spark, d), "light": union_coverage(spark, d)}


def phrase_words(log: DataFrame, phrases: DataFrame, eligible: DataFrame) -> DataFrame:
    """(paper_id, words_now, words_before, words_either): words of a manuscript that lie under phrases of this run, of earlier runs, and of
    either; phrases of the log that the manuscript no longer holds count nothing."""
    now = phrases.select("paper_id", "phrase").distinct().withColumn("now", F.lit(1))
    old = log.select("paper_id", "phrase").distinct().withColumn("old", F.lit(1))
    at = eligible.select("paper_id", "text_id", "pos", "phrase").join(now, ["paper_id", "phrase"], "left").join(old, ["paper_id", "phrase"], "left").filter("now = 1 OR old = 1")
    words = at.select("paper_id", "text_id", "now", "old", F.explode(F.sequence("pos", F.col("pos") + (PHRASE - 1))).alias("word")).groupBy("paper_id", "text_id", "word").agg(F.max("now").alias("now"), F.max("old").alias("old"))
    return words.groupBy("paper_id").agg(F.count("now").alias("words_now"), F.count("old").alias("words_before"), F.count(F.lit(1)).alias("words_either"))


def phrase_history(log: DataFrame, phrases: DataFrame) -> DataFrame:
    """(paper_id, n_now, n_before, n_either): phrases of this run, of earlier runs (a log of paper_id, phrase), and of both together."""
    now = phrases.select("paper_id", "phrase").distinct().withColumn("now", F.lit(1))
    old = log.select("paper_id", "phrase").distinct().withColumn("old", F.lit(1))
    return now.join(old, ["paper_id", "phrase"], "full").groupBy("paper_id").agg(F.count("now").alias("n_now"), F.count("old").alias("n_before"), F.count(F.lit(1)).alias("n_either"))
