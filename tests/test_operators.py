"""Operators on small tables: empty ones, nulls, ties, repeated rows, clashing columns, and brute force."""

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirewise.functions import text as T
from quirewise.operators import checks as C
from quirewise.operators import overlap as O
from quirewise.operators import refs as R
from quirewise.operators import search as Q


@pytest.fixture()
def text(spark):
    rows = [("a", 1, 1, 1, "We test one.", "Intro", "intro"), ("a", 1, 1, 2, "because of X  we stop", "Intro", "intro"), ("a", 1, 2, 3, None, "Intro", "intro"), ("b", 1, 1, 1, "", None, None), ("b", 2, 1, 2, "Because Y.", "Results", "results")]
    return spark.createDataFrame(rows, "paper_id string, section_id int, paragraph_id int, text_id int, text string, header string, section_type string")


def test_search_kinds(text):
    assert Q.search(text, "because").count() == 2
    assert Q.search(text, "because", ignore_case=False).count() == 1
    assert Q.search(text, "because", fixed=True).count() == 1
    assert Q.search(text, "because", exclude=True).count() == 2
    assert Q.search(text, ["because", "one"]).count() == 3
    assert Q.search(text, "results", headers=True).count() == 1
    assert [r.text for r in Q.search(text, "[xy]", returns="match").orderBy("text").collect()] == ["X", "Y"]
    assert Q.search(text, "because", returns="paragraph").filter("paper_id = 'a'").first().text == "because of X we stop"
    with pytest.raises(ValueError):
        Q.search(text, "(")
    with pytest.raises(ValueError):
        Q.search(text, "a", returns="chapter")
    assert Q.search(text.limit(0), "a").count() == 0


def test_expand(text):
    hit = Q.search(text, "because of").select("paper_id", "section_id", "paragraph_id", "text_id", "text")
    assert Q.expand(hit, text, minus=1).first().expanded == "We test one. because of X  we stop"
    assert Q.expand(hit, text, "paragraph").first().expanded == "We test one. because of X we stop"
    with pytest.raises(ValueError):
        Q.expand(hit, text, "book")


def test_near_duplicates_by_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    sets = {r.doc_id: frozenset(r.s) for r in docs.select("doc_id", T.shingles(F.col("text")).alias("s"), T.normalise(F.col("text")).alias("n")).filter("size(split(n, ' ')) >= 5").collect() if r.s}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = {(r.doc_id_a, r.doc_id_b) for r in C.near_duplicates(docs, None, "doc_id", "text", 5, 0.8, 5).collect()}
    assert got <= want
    # pairs are given between classes of equal shingles and within a class from its first member: the same components
    def parts(pairs):
        up = {x: x for x in sets}
        def find(x):
            while up[x] != x:
                x = up[x]
            return x
        for a, b in pairs:
            up[find(a)] = find(b)
        return {frozenset(y for y in sets if find(y) == find(x)) for x in sets}
    assert parts(got) == parts(want)


def test_image_pairs_by_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**31, 8)
    def flip(n):
        h = base.copy()
        for k in rng.choice(256, n, replace=False):
            h[k // 32] ^= 1 << int(31 - k % 32)
        return [int(x) for x in h]
    rows = [(0, [int(x) for x in base]), (1, flip(0)), (2, flip(6)), (3, flip(7)), (4, [int(x) for x in rng.integers(0, 2**31, 8)])]
    df = spark.createDataFrame(rows, "k int, hash array<bigint>")
    dist = lambda a, b: sum(bin(x ^ y).count("1") for x, y in zip(a, b))
    got = {(r.k_a, r.k_b) for r in C.image_pairs(df).collect()}
    assert (0, 1) in got and (0, 2) in got and (0, 3) not in got
    assert all(dist(rows[a][1], rows[b][1]) <= 6 for a, b in got)
    assert C.image_forensic_check(df).first().duplicate_images == 3
    assert C.image_pairs(df.limit(0)).count() == 0


def _library(spark, tmp, sentence, source, paper=None, bib=None, section=None):
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp}/{name}.parquet")
    write(sentence, "paper_id string, section_id int, paragraph_id int, text_id int, text string, formatted string, page_number int, loaded_at timestamp", "sentence")
    write(source, "source_id int, kind string, title string, doi string, text string", "source_text")
    write(paper or [], "paper_id string, title string, doi string", "paper")
    write(section or [], "paper_id string, section_id int, header string, section_type string", "section")
    write(bib or [], "paper_id string, bib_id int, year int, doi string, title string, authors string, text_id int, loaded_at timestamp", "bib")
    return str(tmp)


def test_overlap_runs(spark, tmp_path):
    w = [f"w{i}" for i in range(40)]
    s = lambda i, t: ("p", 1, 1, i, t, None, None, None)
    sentence = [s(1, " ".join(w[:8])), s(2, " ".join(w[:7])), s(3, " ".join(w[10:16] + ["gap"] + w[17:30])), s(4, None), s(5, ""), s(6, '"' + " ".join(w[:20]) + '"')]
    d = _library(spark, tmp_path, sentence, [(1, "library", "T", None, " ".join(w)), (2, "local", "U", None, None)])
    got = sorted((r.text_id, r.start_word, r.end_word, r.source_start) for r in O.runs(spark, d).collect())
    assert got == [(1, 0, 8, 0), (3, 7, 20, 17)]
    r = O.union_coverage(spark, d).first()
    assert r.covered == 21 and r.traffic_light == "red"


def test_overlap_of_a_text_with_itself_is_whole(spark, tmp_path):
    t = " ".join(f"word{i}" for i in range(30))
    d = _library(spark, tmp_path, [("p", 1, 1, 1, t, None, None, None)], [(1, "library", "x", None, t)])
    assert O.sources(spark, d).first().coverage == 1


def test_empty_tables_give_empty_results(spark, tmp_path):
    d = _library(spark, tmp_path, [], [])
    for f in (O.runs, O.sources, O.union_coverage, O.eligible_phrases, C.stat_check, C.grim_check, C.es_check, R.ref_consistency, C.keyword_verdicts, C.duplicate_check, C.power):
        assert f(spark, d).count() == 0


def test_latest_reference_counts(spark, tmp_path):
    import datetime as dt

    b = [("p", 1, 2000, "10.1/A ", "Old", "Xu, Y", 1, dt.datetime(2020, 1, 1)), ("p", 1, 2001, "10.1/a", "New", "Xu, Y", 1, dt.datetime(2021, 1, 1)), ("p", 2, None, None, None, None, None, dt.datetime(2020, 1, 1))]
    d = _library(spark, tmp_path, [("p", 1, 1, 1, "As said before (Xu, 2001), and by Zed (1999).", None, None, None)], [], bib=b)
    assert Q.references(spark, d).filter("bib_id = 1").first().title == "New"
    assert {(r.bib_id, r.cited) for r in R.citation_status(spark, d).collect()} == {(1, True), (2, False)}
    assert [(r.name, r.year) for r in R.orphans(spark, d).collect()] == [("zed", 1999)]
    dim = spark.createDataFrame([("10.1/a", "n"), (None, "m")], "doi string, note string")
    assert R.lookup(spark, d, dim).count() == 1


def test_replications_already_cited_are_left_out(spark, tmp_path):
    b = [("p", 1, 2000, "10.1/a", "A", "X", None, None), ("p", 2, 2001, "10.1/b", "B", "Y", None, None)]
    d = _library(spark, tmp_path, [], [], bib=b)
    pairs = spark.createDataFrame([("10.1/a", "10.1/B ", "ok", None), ("10.1/a", "10.1/c", "ok", None)], "doi_o string, doi_r string, outcome string, url_r string")
    got = R.replications(spark, d, pairs).collect()
    assert [(r.doi_r, r.link) for r in got] == [("10.1/c", "https://doi.org/10.1/c")]


def test_code_and_repositories(spark):
    files = spark.createDataFrame([("1", "a.R", "# x\nset.seed(1)\nrnorm(3)"), ("2", "b.py", 'open("/home/me/x")\nrandom.random()\nsample(3)'), ("3", "c", None)], "id string, name string, content string")
    got = {r.id: r for r in R.code_check(files).collect()}
    assert got["1"].issues == 0 and got["2"].n_absolute_paths == 1 and got["2"].unseeded and got["3"].language is None


def test_phrases_are_apart(spark, data):
    by = {}
    for r in O.eligible_phrases(spark, data).collect():
        by.setdefault((r.paper_id, r.text_id), []).append(r)
    for rows in by.values():
        assert len(rows) <= 3 and all(abs(a.pos - b.pos) >= 9 for a, b in itertools.combinations(rows, 2)) and all(r.score >= 5 for r in rows)


def test_streamed_counts_equal_the_batch(spark, data, tmp_path):
    from quirewise.streaming import verdicts as V

    src = tmp_path / "in"
    rows = spark.read.parquet(f"{data}/sentence.parquet")
    rows.repartition(3).write.parquet(str(src))
    flags = ["coi", "missing_handled"]
    q = V.keep_counts(V.arriving(spark, str(src), rows.schema, "3000 days"), flags, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = {r.paper_id: (r.n_coi, r.n_missing_handled) for r in V.current(spark, str(tmp_path / "out"), flags).collect()}
    from quirewise.functions import patterns as P

    want = rows.dropDuplicates(["paper_id", "text_id"]).groupBy("paper_id").agg(*[F.count_if(T.flag("text", P.FLAGS[f])).alias(f) for f in flags])
    assert got == {r.paper_id: (r.coi, r.missing_handled) for r in want.collect()}


def test_no_query_of_the_core_needs_the_subpackage():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "quirewise")
    for folder, _, files in os.walk(root):
        if os.sep + "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    assert "quirewise.llm" not in open(os.path.join(folder, f)).read(), f


def test_numbers_run_through_partitions(spark):
    from quirewise.operators.ranks import numbered

    rows = [("hot", i) for i in range(0, 3000, 3)] + [("a", 5), ("a", 5), ("b", None), ("b", 1), (None, 1)]
    df = spark.createDataFrame(rows, "g string, t int").repartition(7).withColumn("pos", F.lit("clash"))
    got = {(r.g, r.t): r.pos for r in numbered(df, ["g"], ["t"]).collect()}
    assert all(got["hot", 3 * i] == i + 1 for i in range(1000)) and got["a", 5] == 1 and got["b", None] == 1 and got["b", 1] == 2 and len(got) == 1003


def test_windowed_flags_close_with_the_watermark(spark, data, tmp_path):
    from quirewise.streaming import verdicts as V

    src = tmp_path / "in"
    rows = spark.read.parquet(f"{data}/sentence.parquet")
    rows.orderBy("loaded_at").coalesce(1).write.parquet(str(src))
    q = V.windowed_flags(V.arriving(spark, str(src), rows.schema, "1 days"), ["coi"], "30 days").writeStream.format("memory").queryName("flags_closed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    closed = spark.sql("SELECT sum(n) AS n, sum(n_coi) AS c FROM flags_closed").first()
    assert 0 < closed.n <= rows.dropDuplicates(["paper_id", "text_id"]).count() and closed.c >= 0
