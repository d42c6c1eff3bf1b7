"""The rules of the checks on sentences made for them, by hand and not by the patterns."""

import pytest
from pyspark.sql import functions as F

from quirewise.functions import patterns as P
from quirewise.functions import text as T
from quirewise.operators import checks as C
from quirewise.operators import search as Q
from quirewise.plans import catalog
from quirewise.plans import fixtures as FX


def test_every_flag_has_sentences():
    assert set(FX.FLAGS) == set(P.FLAGS)


def test_flags_meet_their_sentences_and_no_near_misses(spark, data):
    hits = {(r.text_id, r.flag) for r in catalog.fixture_flags(spark, data).collect()}
    for i, f in enumerate(FX.FLAGS):
        assert (2 * i, f) in hits, FX.FLAGS[f][0]
        assert (2 * i + 1, f) not in hits, FX.FLAGS[f][1]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Conflict of interest: none.", True), ("The conflict of interest grew over time", False), ("competing interest among firms was reported", True), ("duality of interest", True), ("Disclosure: nothing.", True), ("self-disclosure in therapy", False),
        ("disclosure of interests", True), ("Financial disclosure of interests", False), ("The two were competing interest groups, as each author said", True),
    ],
)
def test_disclosures(spark, text, want):
    assert spark.createDataFrame([(text,)], "text string").select(T.flag("text", P.FLAGS["coi"])).first()[0] is want


def test_statistics_of_every_outcome(spark):
    at = {t: i for i, t in enumerate(catalog._FIXED)}
    of = lambda rows, k, c: [r[c] for r in rows if r.text_id == at[FX.STATISTICS[k]]]
    es = C.effect_rows(catalog.fixtures(spark)).collect()
    assert [of(es, k, "status") for k in (0, 1, 2, 3, 4, 6, 7, 8, 12, 13, 14)] == [["PASS"], ["ERROR"], ["SKIP"], ["PASS"], ["PASS"], ["PASS"], ["ERROR"], ["WARN"], ["PASS"], ["PASS"], ["SKIP"]]
    ci = C.interval_rows(catalog.fixtures(spark), True).collect()
    assert [of(ci, k, "status") for k in (0, 4, 5, 15)] == [["PASS"], ["PASS"], ["WARN"], ["ERROR"]]
    tests = {r.text_id: r for r in Q.tests(catalog.fixtures(spark)).collect()}
    assert tests[at[FX.STATISTICS[16]]].df1 is None and tests[at[FX.STATISTICS[11]]].p_comp == "~" and tests[at[FX.STATISTICS[9]]].df2 == 2500


def test_edges_next_to_optional_letters():
    for p, yes, no in ((r"\bmaterials?\b x", "material x", "materialsy x"), (r"a?\bb", "b", "xb"), (r"(?:ab)?\bc", "-c", "abc"), (r"x[^\n]\b", "x,a", "x,,")):
        import re

        assert re.search(P.java(p, False), yes) and not re.search(P.java(p, False), no), p


def test_overlap_light_counts_cited_sources(spark, tmp_path):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    one = lambda n, rows, kind: spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{n}.parquet")
    one("paper", [("p", "T", "10.1/a"), ("q", "U", None)], "paper_id string, title string, doi string")
    one("section", [("p", 1, "Intro", "intro")], "paper_id string, section_id int, header string, section_type string")
    one("sentence", [("p", 1, 1, 1, text, None, 1), ("p", 1, 1, 2, "nothing of this stands elsewhere at all in no text whatever " * 9, None, 1)], "paper_id string, section_id int, paragraph_id int, text_id int, text string, formatted string, loaded_at int")
    one("bib", [("p", 1, "10.1/s", "A title of the source that is long enough", 2001, "A, B", None, None)], "paper_id string, bib_id int, doi string, title string, year int, authors string, text_id int, loaded_at timestamp")
    one("source_text", [(1, "library", "A title of the source that is long enough", "10.1/s", text)], "source_id int, kind string, title string, doi string, text string")
    from quirewise.operators import overlap as O

    got = {r.paper_id: r for r in O.union_coverage(spark, str(tmp_path)).collect()}
    assert got["p"].score_uncited == 0 and 0.05 <= got["p"].score < 0.15 and got["p"].traffic_light == "yellow" and got["q"].traffic_light == "green"


def test_near_duplicates_of_all_scripts(spark):
    base = "Каждый ответ снижает шкала по плану исследования второй группы"
    rows = [(1, base), (2, base), (3, base + " и ещё"), (4, "第二次误差改变了结果但不改变方法"), (5, "第二次误差改变了结果但不改变方法。"), (6, "so"), (7, "so"), (8, None), (9, ""), (10, "совсем другой текст о погоде и реке весной")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id_a, r.doc_id_b): r.similarity for r in C.near_duplicates(df.filter("text IS NOT NULL"), None, "doc_id", "text", 5, 0.7, 1, True).collect()}
    assert set(got) == {(1, 2), (1, 3), (4, 5), (6, 7)} and got[1, 2] == got[4, 5] == got[6, 7] == 1
    assert C.near_duplicates(df.limit(0), None, "doc_id", "text").count() == 0


def test_all_checks_run_by_name(spark, data):
    from quirewise.operators import runner

    names = [r[0] for r in catalog._catalogue()]
    assert len(names) == 48 and set(names) <= set(runner.REGISTRY)
    got = runner.run_checks(spark, data, ["all_urls", "csf_check", "repo_check", "ref_summary", "nonsense"]).groupBy("check").agg(F.count("*").alias("n"), F.max("message").alias("m")).collect()
    assert {r.check for r in got if r.m} == {"nonsense"} and len({r.n for r in got}) == 1


def test_faults_in_running_stop_no_other_check(spark, data):
    from quirewise.operators import runner

    bad = lambda s, d: Q.papers(s, d).withColumn("traffic_light", F.raise_error(F.lit("broken")).cast("string"))
    got = {r[0]: r[1] for r in runner.run_checks(spark, data, ["bad", "marginal"], {"bad": bad}, execute=True).groupBy("check").agg(F.max("traffic_light")).collect()}
    assert got["bad"] == "fail" and got["marginal"] != "fail"


def test_register_by_doi(spark, tmp_path):
    from quirewise.operators import refs as R

    one = lambda n, rows, kind: spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{n}.parquet")
    kind = "paper_id string, bib_id int, doi string, title string, year int, authors string, text_id int, loaded_at timestamp"
    one("paper", [("p",)], "paper_id string")
    one("sentence", [("p",)], "paper_id string")
    one("bib", [("p", 1, "10.1/A ", "On Things: a-study.", 2001, "Doe, Jo; Li, W.", None, None), ("p", 2, "10.1/a", "Other", 2002, "Roe, X.", None, None), ("p", 3, "10.1/z", "T", 1, "A", None, None), ("p", 4, None, "T", 1, "A", None, None), ("p", 5, "10.1/a", None, None, None, None, None)], kind)
    reg = spark.createDataFrame([("10.1/a", "on things — a study", 2001, ["doe", "li"])], "doi string, title string, year int, authors array<string>")
    got = {r.bib_id: (r.no_match, r.year_mismatch, r.title_mismatch, r.author_mismatch) for r in R.ref_accuracy_rows(spark, str(tmp_path), reg).collect()}
    assert got == {1: (False, False, True, False), 2: (False, True, True, True), 3: (True, False, False, False), 5: (False, False, False, False)}


def test_tokens_have_their_places(spark):
    rows = [(1, "It’s 😀 über-all, don't."), (2, None), (3, " … "), (4, "x")]
    got = T.tokens(spark.createDataFrame(rows, "i int, text string"), "i", "text").collect()
    assert [r.word for r in got if r.i == 1] == ["It’s", "über", "all", "don't"] and {r.i for r in got} == {1, 4}
    assert all(rows[r.i - 1][1][r.start_pos : r.end_pos] == r.word for r in got)


def test_missing_summaries_are_filled(spark):
    s = spark.createDataFrame([("a", 3, "x", None)], "paper_id string, n int, kind string, share double")
    p = spark.createDataFrame([("a",), ("b",)], "paper_id string")
    assert {tuple(r) for r in T.na_replace(s, p, {"share": None, "kind": "none"}).collect()} == {("a", 3, "x", None), ("b", 0, "none", None)}
