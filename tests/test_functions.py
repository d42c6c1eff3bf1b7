"""Text and statistics functions against values worked out by hand, the JVM's distributions and plain Python."""

import math
import re
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirewise.functions import patterns as P
from quirewise.functions import stats as S
from quirewise.functions import text as T


def one(spark, row, schema, column):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


def test_distributions_agree_with_the_jvm(spark):
    j = spark._jvm.org.apache.commons.math3.distribution
    rows = [(t, v) for t in (0.0, 0.5, 2.2, -3.1, 8.0) for v in (1, 2, 3, 8, 28, 199)]
    for r in spark.createDataFrame(rows, "t double, v int").select("t", "v", S.t_p(F.col("t"), F.col("v")).alias("p")).collect():
        assert abs(r.p - 2 * (1 - j.TDistribution(float(r.v)).cumulativeProbability(abs(r.t)))) < 1e-12
    rows = [(f, a, b) for f in (0.2, 1.0, 4.1, 12.0) for a in (1, 2, 3, 4, 7) for b in (1, 2, 3, 10, 57)]
    for r in spark.createDataFrame(rows, "f double, a int, b int").select("*", S.f_p(F.col("f"), F.col("a"), F.col("b")).alias("p")).collect():
        assert abs(r.p - (1 - j.FDistribution(float(r.a), float(r.b)).cumulativeProbability(r.f))) < 1e-12
    rows = [(x, a) for x in (0.2, 4.1, 40.0) for a in (1, 2, 3, 8, 31)]
    for r in spark.createDataFrame(rows, "x double, a int").select("*", S.chi2_p(F.col("x"), F.col("a")).alias("p")).collect():
        assert abs(r.p - (1 - j.ChiSquaredDistribution(float(r.a)).cumulativeProbability(r.x))) < 1e-9


def test_distributions_with_many_degrees_of_freedom(spark):
    j = spark._jvm.org.apache.commons.math3.distribution
    rows = [(q, a, b) for q in (0.9, 0.98, 1.0, 1.001, 1.05, 3.9) for a, b in ((1, 2001), (2, 2500), (3, 50000), (4, 100000), (7, 3001), (400, 9000), (401, 9001), (600, 2400), (3000, 4000), (1500, 1500), (5000, 12), (5001, 7))]
    for r in spark.createDataFrame(rows, "f double, a int, b int").select("*", S.f_p(F.col("f"), F.col("a"), F.col("b")).alias("p")).collect():
        assert abs(r.p - (1 - j.FDistribution(float(r.a), float(r.b)).cumulativeProbability(r.f))) < 1e-6, r
    rows = [(q * v, v) for q in (0.9, 0.99, 1.0, 1.0001, 1.02, 1.1) for v in (1514, 1901, 2001, 2002, 7570, 100001)]
    for r in spark.createDataFrame(rows, "x double, a int").select("*", S.chi2_p(F.col("x"), F.col("a")).alias("p")).collect():
        assert abs(r.p - (1 - j.ChiSquaredDistribution(float(r.a)).cumulativeProbability(r.x))) < 1e-6, r


def test_distribution_edges(spark):
    assert one(spark, (2.2, 0), "t double, v int", S.t_p(F.col("t"), F.col("v"))) is None
    assert one(spark, (2.2, None), "t double, v int", S.t_p(F.col("t"), F.col("v"))) is None
    assert one(spark, (0.0, 5), "t double, v int", S.t_p(F.col("t"), F.col("v"))) == pytest.approx(1)
    assert one(spark, (2.2, 28), "t double, v int", S.t_p(F.col("t"), F.col("v"))) == pytest.approx(0.036225, abs=1e-6)
    assert one(spark, (-1.0, 2, 3), "f double, a int, b int", S.f_p(F.col("f"), F.col("a"), F.col("b"))) == 1


def test_normal_quantile_inverts(spark):
    ps = [1e-6, 0.001, 0.04, 0.5, 0.9, 0.999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", S.normal_quantile(F.col("p")).alias("z")).collect()
    for r in got:
        assert r.z == pytest.approx(statistics.NormalDist().inv_cdf(r.p), abs=1e-8)


def test_stouffer_and_fisher_by_hand(spark, data):
    from quirewise.operators import checks as C
    from quirewise.operators import search as Q

    text = Q.text_table(spark, data)
    by = {}
    for r in Q.p_values(text).filter("p_value <= 1").collect():
        by.setdefault(r.paper_id, []).append(min(max(r.p_value, 1e-12), 1 - 1e-12))
    n = statistics.NormalDist()
    for r in C.csf_check(spark, data).collect():
        ps = by.get(r.paper_id, [])
        assert r.n_pvalues == len(ps)
        if ps:
            z = sum(n.inv_cdf(1 - p) for p in ps) / math.sqrt(len(ps))
            assert r.stouffer_p == pytest.approx(2 * n.cdf(-abs(z)), abs=2e-6)
            x = -sum(map(math.log, ps))
            assert r.fisher_p == pytest.approx(math.exp(-x) * sum(x**i / math.factorial(i) for i in range(len(ps))), abs=2e-6)


def test_consistency_of_means(spark):
    rows = [(3.50, 2, True), (3.33, 3, True), (3.34, 3, False)]
    for m, n, ok in rows:
        assert one(spark, (m, n), "m double, n int", S.grim(F.col("m"), F.col("n"))) is ok
    assert one(spark, (2, 1.0, 7.0), "n int, a double, b double", S.max_sd(F.col("n"), F.col("a"), F.col("b"))) == pytest.approx(4.2426, abs=1e-4)
    assert one(spark, (None, 1.0, 7.0), "n int, a double, b double", S.max_sd(F.col("n"), F.col("a"), F.col("b"))) == 3
    for m, sd, ok in ((0.5, 0.5, True), (0.5, 0.9, False), (1.2, 0.1, None)):
        assert one(spark, (m, sd), "m double, s double", S.debit(F.col("m"), F.col("s"))) is ok


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 7), min_size=2, max_size=40))
def test_true_means_are_never_rejected(spark, xs):
    mean = round(statistics.fmean(xs), 2)
    assert one(spark, (mean, len(xs)), "m double, n int", S.grim(F.col("m"), F.col("n")))


def test_effect_sizes(spark):
    v = lambda c, *x: one(spark, x, ", ".join(f"a{i} double" for i in range(len(x))), c(*[F.col(f"a{i}") for i in range(len(x))]))
    assert v(S.r_from_t, 2.2, 28.0) == pytest.approx(0.3839, abs=1e-4)
    assert v(S.eta2_from_f, 4.1, 2.0, 57.0) == pytest.approx(0.1258, abs=1e-4)
    assert v(S.omega2_from_f, 0.5, 2.0, 57.0) == 0
    assert v(S.d_from_t, 2.2, 15.0, 15.0) == pytest.approx(0.8033, abs=1e-4)
    assert v(S.dz_from_t, 2.2, 1.0) is None
    assert [v(S.compare, 0.40, x) for x in (0.41, 0.45, 0.55)] == ["PASS", "WARN", "ERROR"]
    assert v(S.compare, 0.4, None) == "SKIP"


def test_noncentral_intervals():
    assert S.noncentral_f_cdf(4.1, 2, 57, 0.0) == pytest.approx(1 - 0.02168, abs=1e-3)
    lo, hi = S.eta2_interval(4.1, 2, 57)
    assert 0 <= lo < 0.1258 < hi < 1
    assert S.noncentral_f_cdf(4.1, 2, 57, hi / (1 - hi) * 60) == pytest.approx(0.025, abs=1e-6)
    lo, hi = S.dz_interval(2.2, 29)
    assert lo < 2.2 / math.sqrt(29) < hi
    assert S.eta2_interval(float("nan"), 1, 1) == (None, None)


def test_noncentral_intervals_of_many_tests():
    import time

    import numpy as np

    # by the scalar sums and the grid of one test after the other, 0.1 s each
    for x, want in (((3, 4, 1), (0.0, 0.911975)), ((50, 2, 10), (0.669755, 0.942990)), ((300, 3, 40), (0.923830, 0.968509)), ((0.5, 500, 2000), (0.0, 0.0)), ((0, 1, 10), (0.0, 0.0))):
        assert S.eta2_interval(*x) == pytest.approx(want, abs=1e-6)
    for x, want in (((-2.2, 29), (-0.784398, -0.025956)), ((30, 30), (4.026395, 6.919801)), ((2, 1000), (0.001188, 0.125271)), ((0, 2), (-1.959964 / math.sqrt(2), 1.959964 / math.sqrt(2))), ((100, 2), (100 * 0.0313380 / math.sqrt(2), 100 * 2.241403 / math.sqrt(2)))):
        assert S.dz_interval(*x) == pytest.approx(want, rel=1e-4, abs=1e-6)
    assert S.eta2_interval(math.inf, 2, 3) == S.eta2_interval(2, 0, 3) == S.dz_interval(math.inf, 5) == S.dz_interval(2, 1) == (None, None)

    # with one degree F is the square of t: its upper tail is both tails of the noncentral t
    with np.errstate(all="ignore"):
        for t, df, nc in ((2.0, 9.0, 1.5), (40.0, 3.0, 35.0), (300.0, 80.0, 310.0)):
            up, down = (float(S._noncentral_t(*(np.array([v]) for v in (t, df, c)))[0][0]) for c in (nc, -nc))
            assert S.noncentral_f_cdf(t * t, 1, df, nc * nc) == pytest.approx(up + down - 1, abs=1e-10)
        # beyond the sums: the numerator's normal root gives what the sums give
        for x in ((2e6, 600, 10), (1.1e6, 1000, 300)):
            for p in (0.975, 0.025):
                f, a, b, q = (np.array([float(v)]) for v in (*x, p))
                nc = S._f_bound(f, a, b, q)
                if nc[0] == nc[0]:
                    assert S.noncentral_f_cdf(*x, nc[0]) == pytest.approx(p, abs=1e-4)

    # as many distinct tests as a tenth of a GB of text holds: minutes by the scalar functions
    r, n = np.random.default_rng(1), 4000
    f, a, b, level = np.round(r.uniform(0, 12, n), 2), r.integers(1, 5, n) * 1.0, r.integers(10, 300, n) * 1.0, np.full(n, 0.95)
    t = np.round(r.uniform(-6, 6, n), 2)
    began = time.process_time()
    lo, hi = S.eta2_intervals(f, a, b, level)
    low, high = S.dz_intervals(t, b + 1, level)
    assert time.process_time() - began < 30
    assert ((0 <= lo) & (lo <= hi) & (hi < 1)).all() and ((low < t / np.sqrt(b + 1)) & (t / np.sqrt(b + 1) < high)).all()
    for i in range(0, n, 400):
        assert (lo[i], hi[i]) == pytest.approx(S.eta2_interval(f[i], a[i], b[i]), abs=1e-9) and (low[i], high[i]) == pytest.approx(S.dz_interval(t[i], b[i] + 1), abs=1e-9)


def test_intervals_of_odd_degrees(spark, tmp_path):
    from quirewise.operators import checks as C

    texts = ["t(2147483647) = 2.0", "t(0) = 1.0", "t(28) = 2.2 and t(28) = -2.2", "F(2, 57) = 4.1", "F(2, 57) = 4.1, again", "F(0, 5) = 2", f"F(2, 5) = {'9' * 400}", "t(99999999999) = 1.5", None]
    rows = [("p", 1, 1, i, x, None, 1) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "paper_id string, section_id int, paragraph_id int, text_id int, text string, formatted string, loaded_at int").write.parquet(f"{tmp_path}/sentence.parquet")
    spark.createDataFrame([("p", 1, "A", "intro")], "paper_id string, section_id int, header string, section_type string").write.parquet(f"{tmp_path}/section.parquet")
    got = {(r.kind, r.value, r.df1): (r.lo, r.hi) for r in C.es_intervals(spark, str(tmp_path)).collect()}
    assert len(got) == 8 and got["t", 2.0, 2147483647][0] is not None
    assert got["t", 1.0, 0] == got["F", 2.0, 0] == got["F", math.inf, 2] == got["t", 1.5, None] == (None, None)
    assert got["t", 2.2, 28] == tuple(-x for x in reversed(got["t", -2.2, 28])) and got["F", 4.1, 2] == pytest.approx(S.eta2_interval(4.1, 2, 57), abs=1e-6)


def test_p_values_of_all_forms(spark):
    from quirewise.operators import search as Q

    texts = ["p = .04", "p < 2.1 x 10^-5", "p = n.s.", "p≤.05", "group = 3", "P-value = 1e-3 p = 0.5e-2", None, ""]
    rows = spark.createDataFrame([("a", i, t) for i, t in enumerate(texts)], "paper_id string, text_id int, text string")
    got = {(r.text_id, r.ord): (r.p_comp, r.p_value) for r in Q.p_values(rows).collect()}
    assert got[0, 0] == ("=", 0.04) and got[1, 0][0] == "<" and got[1, 0][1] == pytest.approx(2.1e-5)
    assert got[2, 0] == ("=", None) and got[3, 0] == ("≤", 0.05)
    assert not any(k[0] in (4, 6, 7) for k in got)


def test_text_functions(spark):
    v = lambda c, x: one(spark, (x,), "a string", c(F.col("a")))
    assert v(T.normalise, "The  Größe, of IT!") == "the gr e of it"
    assert v(T.shingles, "a b c") == ["a b c"] and v(T.shingles, "") == [] and v(T.shingles, "a b c d e f") == ["a b c d e", "b c d e f"]
    assert v(T.shingles, None) is None or v(T.shingles, None) == []
    assert v(T.split_sentences, "One. Two? 3 is p. five") == ["One.", "Two?", "3 is p. five"]
    assert v(T.section_type, "M e t h o d s") == "method" and v(T.section_type, "Procedure") is None
    assert v(T.surname, "de Souza, Ana") == "de souza" and v(T.surname, "Ana Souza") == "souza"
    assert v(T.file_type, "x/README.txt") == "readme" and v(T.file_type, "a.Rmd") == "code" and v(T.file_type, "b") == "other"
    assert v(T.clean_title, "A <i>B</i> – C.") == "a b c"
    assert v(T.safe_stem, "a b/c?.pdf") == "a_b_c_.pdf"
    assert v(T.version_key, "v1.10.0rc1") == [1, 10, 0]
    assert v(T.html_to_text, '<p>a &lt; b</p><script>"</p>"</script><!-- x --> c') == "a < b c"
    for code, state in ((200, "ok"), (404, "error"), (403, "manual"), (0, "unreachable"), (None, "unreachable")):
        assert one(spark, (code,), "c int", T.http_state(F.col("c"))) == state


def test_title_mismatch_and_similarity(spark):
    two = lambda f, a, b: one(spark, (a, b), "a string, b string", f(F.col("a"), F.col("b")))
    assert two(T.title_mismatch, "A study", "a study of things") is False and two(T.title_mismatch, "A study", "Another") is True
    assert two(T.title_similarity, "The big red house", "big red house") == 1 and two(T.title_similarity, "", "x y") == 0


@pytest.mark.parametrize("name", sorted(P.FLAGS))
def test_flags_with_and_without_prefilter_agree(spark, name):
    flags = P.FLAGS[name] if isinstance(P.FLAGS[name], tuple) else (P.FLAGS[name],)
    words = [w for f in flags for p in f.every for w in (P.stems(p) or [])]
    texts = ["No case here.", None, "", *[f"It {w} s." for w in words], *[f"{a} {b}s 5 = .3 significant" for a in words for b in words][:60]]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select(T.flag("text", P.FLAGS[name]).alias("a"), T.flag("text", P.FLAGS[name], F.lower("text")).alias("b")).collect()
    assert all(r.a == r.b for r in got)


def test_checks_fire_on_their_phrases(spark):
    cases = {
        "marginal": ("a marginally significant effect", "the margin was wide"), "coi": ("The authors declare no competing interests.", "We declare victory."), "funding": ("This research was funded by X.", "The study had no funding."),
        "data_request": ("Data are available on reasonable request.", "Data are here."), "causal": ("It led to change.", "It was seen."), "ethics": ("All gave informed consent.", "All agreed."), "exclusion_reason": ("Two were excluded because of noise.", "Two were excluded."),
        "missing_handled": ("We used multiple imputation.", "We used means."), "panel": ("Run on MTurk.", "Run on foot."), "agreement": ("Cohen's kappa was .8", "They agreed."), "survey": ("An online survey ran.", "The questionnaires items were odd."),
    }
    for name, (yes, no) in cases.items():
        got = spark.createDataFrame([(yes,), (no,)], "text string").select(T.flag("text", P.FLAGS[name]).alias("v")).collect()
        assert [r.v for r in got] == [True, False], name


def test_patterns_mean_the_same_in_python():
    for f in [f for x in P.FLAGS.values() for f in (x if isinstance(x, tuple) else (x,))]:
        for p in f.every + f.never + f.cased + f.cased_never:
            re.compile(p, re.I)
