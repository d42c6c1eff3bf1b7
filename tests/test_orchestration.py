"""Registry, runs with faults, reports, and the joins of their own."""

import json
import random

from quirewise.operators import joins as J
from quirewise.operators import report as RP
from quirewise.operators import runner
from quirewise.plans import catalog
from quirewise.sources import files as FS


def test_selection():
    known = ["a", "b", "c", "d"]
    assert runner.select_checks(known) == known
    assert runner.select_checks(known, ["c", "a", "x"]) == ["a", "c"]
    assert runner.select_checks(known, None, ["b", "c"], ["c"], False) == ["b"]


def test_faults_stay_with_their_check(spark, data):
    def broken(s, d):
        raise ValueError("no such thing")

    def partial(s, d):
        return s.createDataFrame([("none", "red")], "paper_id string, traffic_light string")

    rows = runner.run_checks(spark, data, ["marginal", "missing", "broken", "partial"], {"broken": broken, "partial": partial}).collect()
    by = {}
    for r in rows:
        by.setdefault(r.check, set()).add((r.traffic_light, r.message))
    n = len({r.paper_id for r in rows})
    assert len(rows) == 4 * n and by["missing"] == {("fail", "unknown check missing")} and by["broken"] == {("fail", "ValueError: no such thing")} and by["partial"] == {("na", None)}
    assert {x for x, _ in by["marginal"]} <= {"red", "green"}
    assert runner.run_checks(spark, data, []).count() == 0


def test_own_checks_can_be_registered(spark, data):
    @runner.register("always")
    def always(s, d):
        from quirewise.operators import search as Q

        return Q.papers(s, d).selectExpr("paper_id", "'info' AS traffic_light")

    assert {r.traffic_light for r in runner.run_checks(spark, data, ["always"]).collect()} == {"info"}
    del runner.REGISTRY["always"]


def test_report(spark):
    v = spark.createDataFrame([("p", "marginal", "red"), ("p", "own", "info"), ("p", "grim_check", "na")], "paper_id string, check string, traffic_light string")
    rows = RP.report_rows(v, catalog.check_catalog(spark))
    got = sorted(rows.collect(), key=lambda r: r.ord)
    assert [r.check for r in got] == ["marginal", "grim_check", "own"] and got[-1].label == "own"
    meta = json.loads(RP.to_json(rows).first().meta)
    assert meta["n_checks"] == 3 and [x["check"] for x in meta["summary"]] == ["marginal", "grim_check", "own"]
    assert RP.legend(v).first().red == 1
    page = RP.render("A <b>", got, {"marginal": ["| x | y |", "|---|---|", "| **1** | a\\|b |", "See [here](https://e.org)."]})
    assert "<h1>A &lt;b&gt;</h1>" in page and "<td><b>1</b></td>" in page and '<a href="https://e.org">' in page and page.index("Statistical") < page.index("More")
    from pyspark.sql import functions as F

    r = spark.createDataFrame([("a|b\nc", 2), (None, 0)], "t string, n int").select(RP.table_row(F.col("t"), F.col("n")).alias("m"), RP.summary_text(F.col("n"), "case", "None.").alias("s")).collect()
    assert r[0].m == "| a\\|b c | 2 |" and r[1].m == "|  | 0 |" and r[0].s == "We found 2 cases." and r[1].s == "None."


def test_as_of_by_brute_force(spark):
    rng = random.Random(1)
    left = [(i, rng.choice("ab"), rng.choice([None, *range(20)])) for i in range(60)]
    right = [(rng.choice("abc"), rng.choice([None, *range(20)]), i) for i in range(30)]
    got = {r.i: r.v for r in J.as_of(spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, t int, v int"), ["k"], "t", ["v"]).collect()}
    for i, k, t in left:
        ok = [(rt, v) for rk, rt, v in right if rk == k and rt is not None and t is not None and rt <= t]
        assert got[i] == (max(ok)[1] if ok else None)


def test_within_by_brute_force(spark):
    rng = random.Random(2)
    points = [(i, rng.choice("ab"), rng.randrange(-5, 50)) for i in range(60)]
    spans = [(j, rng.choice("ab"), a := rng.randrange(-5, 45), a + rng.randrange(-1, 15)) for j in range(25)] + [(99, "a", None, 5)]
    got = {(r.i, r.j) for r in J.within(spark.createDataFrame(points, "i int, k string, x int"), spark.createDataFrame(spans, "j int, k string, lo int, hi int"), ["k"], "x", "lo", "hi", 7).collect()}
    assert got == {(i, j) for i, k, x in points for j, q, lo, hi in spans if k == q and lo is not None and lo <= x < hi}


def test_article_text(spark):
    from pyspark.sql import functions as F

    x = "<article><front><t>F</t></front><body><p>Keep <xref rid='1'>[1]</xref> this.</p><table-wrap><td>no</td></table-wrap></body><back><ref-list><ref>no</ref></ref-list></back></article>"
    assert spark.createDataFrame([(x,)], "x string").select(FS.article_text(F.col("x")).alias("v")).first().v == "Keep this."
