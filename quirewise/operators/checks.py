"""The checks of papers: for each a summary with one row per paper and a traffic light, all papers at once.

Keyword checks share one pass: every sentence gets all flags in one projection, one aggregation counts them per paper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirewise.functions import patterns as P
from quirewise.functions import stats as S
from quirewise.functions import text as T
from quirewise.operators import search as Q
from quirewise.runtime import materialise, spread, table



def flag_counts(spark: SparkSession, d: str, flags: list[str] | None = None) -> DataFrame:
    """(paper_id, n_<flag>...): sentences of each paper that meet each flag, in one scan; papers without sentences have zeros."""
    names = flags or list(P.FLAGS)
    text = Q.text_table(spark, d).select("paper_id", "text", F.lower("text").alias("low"))
    flat = text.select("paper_id", *[T.flag("text", P.FLAGS[f], F.col("low")).alias(f) for f in names])
    both = [F.count_if(F.col("data_sentence") & F.col("data_request")).alias("n_data_sentence__data_request")] if {"data_sentence", "data_request"} <= set(names) else []
    counts = flat.groupBy("paper_id").agg(*[F.count_if(f).alias(f"n_{f}") for f in names], *both)
    return Q.papers(spark, d).join(counts, "paper_id", "left").fillna(0)


def _extra(spark: SparkSession, d: str, name: str) -> DataFrame:
    """(paper_id, n_<name>): counts that come from other tables than the sentences."""
    if name == "bib":
        return Q.references(spark, d).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_bib"))
    if name == "doi":
        return table(spark, d, "paper").groupBy("paper_id").agg(F.count_if(F.trim("doi") != "").alias("n_doi"))
    if name == "p":
        return Q.p_values(Q.text_table(spark, d)).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_p"))
    if name == "prereg_link":
        return Q.urls(Q.text_table(spark, d)).groupBy("paper_id").agg(F.count_if(F.col("kind").isin("osf", "aspredicted")).alias("n_prereg_link"))
    raise KeyError(name)


def keyword_check(spark: SparkSession, d: str, name: str) -> DataFrame:
    """(paper_id, summary columns, traffic_light) of one keyword check."""
    c = P.CHECKS[name]
    counts = flag_counts(spark, d, list(c.flags))
    for e in c.extra:
        if "__" not in e:
            counts = counts.join(_extra(spark, d, e), "paper_id", "left").fillna(0)
    return counts.select("paper_id", *[F.expr(sql).alias(k) for k, sql in c.columns.items()], F.expr(c.light).alias("traffic_light"))


def keyword_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, check, traffic_light) of all keyword checks out of one scan of the text."""
    counts = flag_counts(spark, d)
    for e in sorted({e for c in P.CHECKS.values() for e in c.extra if "__" not in e}):
        counts = counts.join(_extra(spark, d, e), "paper_id", "left").fillna(0)
    wide = counts.select("paper_id", *[F.expr(c.light).alias(k) for k, c in P.CHECKS.items()])
    return wide.unpivot("paper_id", list(P.CHECKS), "check", "traffic_light")


def r2_items(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, item, found): the items of the editorial checklist one by one."""
    counts = flag_counts(spark, d, P.R_ITEMS)
    for e in ("bib", "doi"):
        counts = counts.join(_extra(spark, d, e), "paper_id", "left").fillna(0)
    wide = counts.select("paper_id", *[(F.col(f"n_{i}") > 0).alias(i) for i in [*P.R_ITEMS, "bib", "doi"]])
    return wide.unpivot("paper_id", [*P.R_ITEMS, "bib", "doi"], "item", "found")


def keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, text_id, flag): which flags every sentence meets; the detail table of the keyword checks."""
    text = Q.text_table(spark, d).select("paper_id", "text_id", "text", F.lower("text").alias("low"))
    flat = text.select("paper_id", "text_id", F.array_compact(F.array(*[F.when(T.flag("text", f, F.col("low")), F.lit(k)) for k, f in P.FLAGS.items()])).alias("flags"))
    return flat.select("paper_id", "text_id", F.explode("flags").alias("flag"))


def _per_paper(spark: SparkSession, d: str, counts: DataFrame, light: Column) -> DataFrame:
    """Counts of papers that have any, zeros for the others, and the light."""
    return Q.papers(spark, d).join(counts, "paper_id", "left").fillna(0).withColumn("traffic_light", light)


def or_na(spark: SparkSession, d: str, found: DataFrame) -> DataFrame:
    """(paper_id, traffic_light) of all papers; na for those without a row."""
    return Q.papers(spark, d).join(found.select("paper_id", "traffic_light"), "paper_id", "left").fillna("na", ["traffic_light"])


def lit_by(spark: SparkSession, d: str, rows: DataFrame, light: str) -> DataFrame:
    """(paper_id, traffic_light) of all papers: ``light`` for those that have a row, na for the others."""
    return or_na(spark, d, rows.select("paper_id").distinct().withColumn("traffic_light", F.lit(light)))


def lights(*cases: tuple[Column, str], other: str) -> Column:
    out = F.when(cases[0][0], cases[0][1])
    for c, v in cases[1:]:
        out = out.when(c, v)
    return out.otherwise(other)


def all_p_values(spark: SparkSession, d: str) -> DataFrame:
    n = Q.p_values(Q.text_table(spark, d)).groupBy("paper_id").agg(F.count(F.lit(1)).alias("p_values"))
    return _per_paper(spark, d, n, lights((F.col("p_values") > 0, "info"), other="na"))


def all_urls(spark: SparkSession, d: str, text: DataFrame | None = None) -> DataFrame:
    n = Q.urls(Q.text_table(spark, d) if text is None else text).groupBy("paper_id").agg(F.count(F.lit(1)).alias("urls"))
    return _per_paper(spark, d, n, lights((F.col("urls") > 0, "info"), other="na"))


def stat_p_exact(spark: SparkSession, d: str) -> DataFrame:
    """Imprecise p-values ("<" above .001, other comparators than = and <, or no number) and p-values given as zero."""
    p = Q.p_values(Q.text_table(spark, d))
    star = F.coalesce(T.matches("text", r"\* *p *<"), F.lit(False))
    imprecise = ((F.col("p_comp") == "<") & (F.coalesce("p_value", F.lit(1.0)) > 0.001) | ~F.col("p_comp").isin("=", "<") | F.col("p_value").isNull()) & ~star
    n = p.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_p"), F.count_if(imprecise).alias("n_imprecise"), F.count_if((F.col("p_comp") == "=") & (F.col("p_value") == 0)).alias("n_zero"))
    return _per_paper(spark, d, n, lights((F.col("n_p") == 0, "na"), ((F.col("n_imprecise") == 0) & (F.col("n_zero") == 0), "green"), other="red")).drop("n_p")


def stat_p_nonsig(spark: SparkSession, d: str) -> DataFrame:
    p = Q.p_values(Q.text_table(spark, d))
    n = p.groupBy("paper_id").agg(F.count_if(~F.coalesce((F.col("p_value") <= 0.05) & F.col("p_comp").isin("<", "="), F.lit(False))).alias("n_nonsignificant"))
    return _per_paper(spark, d, n, lights((F.col("n_nonsignificant") > 0, "yellow"), other="green"))


def computed_p(kind: Column, value: Column, df1: Column, df2: Column, chi: bool = True) -> Column:
    """The p of a test; with ``chi`` of chi-square tests too."""
    if not chi:
        return F.when(kind != "chi2", computed_p(kind, value, df1, df2))
    return F.when(kind == "t", S.t_p(value, df1)).when(kind == "F", S.f_p(F.abs(value), df1, df2)).when(kind == "chi2", S.chi2_p(value, df1))


def statcheck_rows(spark: SparkSession, d: str) -> DataFrame:
    """Tests with a reported p: the p recomputed, whether they disagree, and whether that changes the decision at .05."""
    t = Q.tests(Q.text_table(spark, d)).filter(F.col("kind").isin("t", "F") & F.col("p_reported").isNotNull())
    t = t.withColumn("p_computed", F.round(computed_p(F.col("kind"), F.col("value"), F.col("df1"), F.col("df2")), 6)).filter("p_computed IS NOT NULL")
    wrong = F.when(F.col("p_comp") == "<", F.col("p_computed") >= F.col("p_reported")).otherwise(F.round("p_computed", 3) != F.round("p_reported", 3))
    return t.withColumn("error", wrong).withColumn("decision_error", wrong & ((F.col("p_reported") < 0.05) != (F.col("p_computed") < 0.05)))


def stat_check(spark: SparkSession, d: str) -> DataFrame:
    n = statcheck_rows(spark, d).groupBy("paper_id").agg(F.count(F.lit(1)).alias("statcheck_found"), F.count_if("error").alias("statcheck_errors"), F.count_if("decision_error").alias("statcheck_decision_errors"))
    return _per_paper(spark, d, n, lights((F.col("statcheck_found") == 0, "na"), (F.col("statcheck_errors") > 0, "red"), other="green"))


@Q.once
def effects(text: DataFrame) -> DataFrame:
    """(paper_id, text_id, k, kind, value) of the effect sizes reported in a sentence, numbered kind by kind."""

    def found(kind: str, name: str) -> Column:
        rx = P.java(rf"(?:{name})\s*=\s*({P.NUMBER})", kind not in ("V", "f", "g", "r", "d"))
        return F.transform(F.regexp_extract_all("text", F.lit(rx), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), v.try_cast("double").alias("value")))

    entries = [found(k, n) for k, n in P.EFFECTS.items()]
    return text.filter(F.col("text").rlike(f"=\\s*{P.NUMBER}")).select("paper_id", "text_id", F.posexplode(F.concat(*entries)).alias("k", "e")).select("paper_id", "text_id", "k", "e.kind", "e.value")


def stat_effect_size(spark: SparkSession, d: str) -> DataFrame:
    """t and F tests with and without an effect size in their sentence."""
    text = Q.text_table(spark, d)
    have = effects(text).select("paper_id", "text_id").distinct().withColumn("has", F.lit(True))
    t = Q.tests(text).filter(F.col("kind").isin("t", "F")).join(have, ["paper_id", "text_id"], "left").withColumn("has", F.coalesce("has", F.lit(False)))
    n = t.groupBy("paper_id").agg(*[F.count_if((F.col("kind") == k) & (F.col("has") == F.lit(h))).alias(f"{k.lower()}_{'with' if h else 'without'}_es") for k in ("t", "F") for h in (True, False)])
    found, missing = F.col("t_with_es") + F.col("f_with_es"), F.col("t_without_es") + F.col("f_without_es")
    return _per_paper(spark, d, n, lights((found + missing == 0, "na"), (found == 0, "red"), (missing > 0, "yellow"), other="green"))


def named_sizes(text: DataFrame) -> DataFrame:
    """(paper_id, text_id, n1, n2, m): group sizes and the m of a table as the sentence names them; n stands for n1."""
    size = lambda p: F.regexp_extract("text", P.java(p), 1).try_cast("int")
    return text.filter(F.col("text").rlike("[0-9]")).select("paper_id", "text_id", F.coalesce(size(r"\bn1\s*=\s*([0-9]+)"), size(r"\bn\s*=\s*([0-9]+)")).alias("n1"), size(r"\bn2\s*=\s*([0-9]+)").alias("n2"), size(r"\b(?:df|m)\s*=\s*([0-9]+)").alias("m"))


def es_check_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every test crossed with the effect sizes of its sentence: the size recomputed from the test and compared. SKIP where the pair has no
    rule or where the sentence doesn't name what it takes: both group sizes for d and g, n for dz and phi, n and m for V (1 for one degree)."""
    return effect_rows(Q.text_table(spark, d))


def effect_rows(text: DataFrame) -> DataFrame:
    t = Q.tests(text).select("paper_id", "text_id", F.col("kind").alias("test"), "ord", "df1", "df2", "value").join(named_sizes(text), ["paper_id", "text_id"])
    x = t.join(effects(text).drop("k").withColumnsRenamed({"kind": "effect", "value": "reported"}), ["paper_id", "text_id"])
    v, a, b, n1, n2 = F.col("value"), F.col("df1"), F.col("df2"), F.col("n1"), F.col("n2")
    is_ = lambda k, e: (F.col("test") == k) & (F.col("effect") == e)
    got = (
        F.when(is_("t", "d"), S.d_from_t(v, n1, n2)).when(is_("t", "g"), S.hedges(S.d_from_t(v, n1, n2), n1 + n2 - 2)).when(is_("t", "dz"), S.dz_from_t(v, n1)).when(is_("t", "r"), S.r_from_t(v, a)).when(is_("F", "eta2"), S.eta2_from_f(v, a, b))
        .when(is_("F", "omega2"), S.omega2_from_f(v, a, b)).when(is_("F", "f"), S.cohens_f(v, a, b)).when(is_("chi2", "phi"), S.phi_from_chi2(v, n1)).when(is_("chi2", "V"), S.v_from_chi2(v, n1, F.coalesce("m", F.when(a == 1, 1))))
    )
    return x.withColumn("computed", F.round(got, 6)).withColumn("status", S.compare(F.col("reported"), F.col("computed")))


def intervals(text: DataFrame) -> DataFrame:
    """(paper_id, text_id, ord, level, lo, hi): confidence intervals as reported."""
    rx = P.java(P.CI)
    g = lambda k: F.regexp_extract("match", rx, k).try_cast("double")
    return Q.exploded(text, P.CI).select("paper_id", "text_id", "ord", (g(1) / 100).alias("level"), g(2).alias("lo"), g(3).alias("hi"))


def ci_pairs(text: DataFrame) -> DataFrame:
    """Intervals with an effect size of their sentence: for each test the first size, in sentences without a test every size."""
    t = Q.tests(text).select("paper_id", "text_id", F.col("kind").alias("test"), F.col("ord").alias("test_ord"), "df1", "df2", F.col("value").alias("stat"))
    e = effects(text).withColumnsRenamed({"kind": "effect", "value": "es"})
    x = intervals(text).join(e, ["paper_id", "text_id"]).join(named_sizes(text), ["paper_id", "text_id"]).join(t, ["paper_id", "text_id"], "left")
    return x.filter("test IS NULL OR k = 0")


def ci_rows(spark: SparkSession, d: str, inversions: bool = False) -> DataFrame:
    """Intervals against effect sizes: ERROR if reversed, WARN if off-centre, then compared with the interval computed by the method of
    the kind where the sentence names what it takes, else PASS. The methods of eta squared and dz invert noncentral distributions in
    Python and count with ``inversions`` only."""
    return interval_rows(Q.text_table(spark, d), inversions)


def interval_rows(text: DataFrame, inversions: bool = False) -> DataFrame:
    x = ci_pairs(text)
    lo, hi, es, n1, n2 = (F.col(c) for c in ("lo", "hi", "es", "n1", "n2"))
    off = F.abs((lo + hi) / 2 - es) > F.greatest(F.lit(0.05), 0.10 * F.abs(es))
    status = F.when(hi < lo, "ERROR").when(off, "WARN")
    r, dd = S.ci_r(es, n1), S.ci_d(es, n1, n2)
    if inversions:
        keys = x.filter((F.col("effect") == "eta2") & (F.col("test") == "F")).select("stat", "df1", "df2").distinct()
        eta = keys.withColumn("eta", S.eta2_interval_udf()(F.col("stat"), F.col("df1").cast("double"), F.col("df2").cast("double"), F.lit(0.95)))
        dz = x.filter((F.col("effect") == "dz") & (n1 >= 2)).select("es", "n1").distinct().withColumn("dz", S.dz_interval_udf()(es * F.sqrt(n1), n1.cast("double"), F.lit(0.95)))
        x = x.join(eta, ["stat", "df1", "df2"], "left").join(dz, ["es", "n1"], "left")
        status = status.when((F.col("effect") == "eta2") & F.col("eta.lo").isNotNull(), S.compare_interval(lo, hi, F.col("eta.lo"), F.col("eta.hi"))).when((F.col("effect") == "dz") & F.col("dz.lo").isNotNull(), S.compare_interval(lo, hi, F.col("dz.lo"), F.col("dz.hi")))
    status = status.when((F.col("effect") == "r") & r[0].isNotNull(), S.compare_interval(lo, hi, *r)).when((F.col("effect") == "d") & (n1 > 0) & (n2 > 0) & (n1 + n2 > 2), S.compare_interval(lo, hi, *dd)).otherwise("PASS")
    return x.select("paper_id", "text_id", "ord", "test", "test_ord", "k", "effect", "es", "level", "lo", "hi", status.alias("status"))


def es_check(spark: SparkSession, d: str, inversions: bool = False) -> DataFrame:
    rows = es_check_rows(spark, d).select("paper_id", "status").unionByName(ci_rows(spark, d, inversions).select("paper_id", "status"))
    n = rows.groupBy("paper_id").agg(F.count(F.lit(1)).alias("es_checked"), *[F.count_if(F.col("status") == s).alias(f"es_{s.lower()}") for s in ("PASS", "WARN", "ERROR", "SKIP")])
    return _per_paper(spark, d, n, lights((F.col("es_checked") == 0, "na"), (F.col("es_error") > 0, "red"), (F.col("es_warn") > 0, "yellow"), other="green"))


def es_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of eta squared (F tests) and dz (t tests) by inversion of noncentral distributions, for the distinct tests of all papers."""
    t = Q.tests(Q.text_table(spark, d)).select("kind", "value", "df1", "df2").distinct()
    tasks = spark.sparkContext.defaultParallelism  # else a few small partitions are all that is left of the distinct tests
    f = t.filter("kind = 'F'").repartition(tasks).withColumn("ci", S.eta2_interval_udf()(F.col("value"), F.col("df1").cast("double"), F.col("df2").cast("double"), F.lit(0.95)))
    u = t.filter("kind = 't'").repartition(tasks).withColumn("ci", S.dz_interval_udf()(F.col("value"), F.col("df1").cast("double") + 1, F.lit(0.95)))
    return f.unionByName(u).select("kind", "value", "df1", "df2", F.round("ci.lo", 6).alias("lo"), F.round("ci.hi", 6).alias("hi"))


def _forensic(spark: SparkSession, d: str, tested: Column, bad: Column, column: str, light: str) -> DataFrame:
    """A consistency check over the descriptive statistics: na where nothing can be tested."""
    x = Q.descriptives(Q.text_table(spark, d)).filter(tested)
    n = x.groupBy("paper_id").agg(F.count(F.lit(1)).alias("tested"), F.count_if(bad).alias(column))
    return _per_paper(spark, d, n, lights((F.col("tested") == 0, "na"), (F.col(column) > 0, light), other="green"))


def grim_check(spark: SparkSession, d: str) -> DataFrame:
    return _forensic(spark, d, F.col("mean").isNotNull() & (F.col("n") > 0), ~S.grim(F.col("mean"), F.col("n")), "grim_fail", "red")


def grimmer_check(spark: SparkSession, d: str) -> DataFrame:
    return _forensic(spark, d, F.col("mean").isNotNull() & F.col("sd").isNotNull() & (F.col("n") > 1), ~S.grimmer(F.col("mean"), F.col("sd"), F.col("n")), "grimmer_fail", "red")


def grimmer_strict_check(spark: SparkSession, d: str) -> DataFrame:
    return _forensic(spark, d, F.col("mean").isNotNull() & F.col("sd").isNotNull() & (F.col("n") > 1), ~S.grimmer_strict(F.col("mean"), F.col("sd"), F.col("n")), "grimmer_fail", "red")


def sd_range_check(spark: SparkSession, d: str) -> DataFrame:
    return _forensic(spark, d, F.col("sd").isNotNull() & F.col("min").isNotNull(), F.col("sd") > S.max_sd(F.col("n"), F.col("min"), F.col("max")), "sd_issues", "red")


def sd_se_check(spark: SparkSession, d: str) -> DataFrame:
    return _forensic(spark, d, F.col("sd").isNotNull() & (F.col("n") > 1), F.sqrt("n") * F.col("sd") > 10 * F.col("sd"), "sd_se_suspect", "yellow")


def debit_check(spark: SparkSession, d: str) -> DataFrame:
    return _forensic(spark, d, F.col("sd").isNotNull() & (F.col("mean") >= 0) & (F.col("mean") <= 1), ~S.debit(F.col("mean"), F.col("sd")), "debit_issues", "red")


def stalt_check(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds ("p <") reported for tests whose p lies below a tenth of them."""
    t = Q.tests(Q.text_table(spark, d)).filter((F.col("p_comp") == "<") & F.col("p_reported").isNotNull() & F.col("kind").isin("t", "F"))
    t = t.withColumn("p_computed", F.round(computed_p(F.col("kind"), F.col("value"), F.col("df1"), F.col("df2")), 9))
    n = t.groupBy("paper_id").agg(F.count(F.lit(1)).alias("tested"), F.count_if(F.col("p_computed") < F.col("p_reported") * 0.1).alias("stalt_issues"))
    return _per_paper(spark, d, n, lights((F.col("tested") == 0, "na"), (F.col("stalt_issues") > 0, "yellow"), other="green"))


def csf_check(spark: SparkSession, d: str) -> DataFrame:
    """All numeric p-values of a paper combined by Stouffer's and Fisher's methods; p is held between 1e-12 and 1 - 1e-12."""
    p = Q.p_values(Q.text_table(spark, d)).filter("p_value IS NOT NULL AND p_value <= 1").withColumn("p", F.greatest(F.lit(1e-12), F.least(F.col("p_value"), F.lit(1 - 1e-12))))
    distinct = p.select("p").distinct().withColumn("z", S.normal_quantile(1 - F.col("p")))
    x = p.join(distinct, "p").groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_pvalues"), F.sum("z").alias("sz"), (-2 * F.sum(F.log("p"))).alias("x"))
    n = x.select("paper_id", "n_pvalues", F.round(S.normal_two_sided(F.col("sz") / F.sqrt("n_pvalues")), 6).alias("stouffer_p"), F.round(S.chi2_p(F.col("x"), 2 * F.col("n_pvalues")), 6).alias("fisher_p"))
    out = Q.papers(spark, d).join(n, "paper_id", "left").fillna(0, ["n_pvalues"])
    return out.withColumn("traffic_light", lights((F.col("n_pvalues") == 0, "na"), (F.col("stouffer_p") < 1e-4, "yellow"), other="info"))


def test_recalc(spark: SparkSession, d: str) -> DataFrame:
    """The t of the first two groups of a section that report mean, sd and n: Welch's denominator, pooled degrees of freedom."""
    x = Q.descriptives(Q.text_table(spark, d)).filter("mean IS NOT NULL AND sd > 0 AND n > 1").join(Q.sentences(spark, d).select("paper_id", "text_id", "section_id"), ["paper_id", "text_id"])
    k = F.row_number().over(Window.partitionBy("paper_id", "section_id").orderBy("text_id"))
    two = x.withColumn("k", k).filter("k <= 2").groupBy("paper_id", "section_id").agg(F.count(F.lit(1)).alias("c"), *[F.max_by(c, F.when(F.col("k") == i, 1)).alias(f"{c}{i}") for i in (1, 2) for c in ("mean", "sd", "n")])
    t = two.filter("c = 2").withColumn("t", S.welch_t(*[F.col(f"{c}{i}") for i in (1, 2) for c in ("mean", "sd", "n")])).withColumn("df", F.col("n1") + F.col("n2") - 2)
    return t.select("paper_id", "section_id", F.round("t", 6).alias("t"), "df", F.round(S.t_p(F.col("t"), F.col("df")), 6).alias("p"))


def power(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs on statistical power that name a number, and the kind of analysis they name first."""
    par = Q.text_table(spark, d).filter("text IS NOT NULL").groupBy("paper_id", "section_id", "paragraph_id").agg(Q.joined("text", "text_id").alias("text"))
    hit = par.filter(T.matches("text", P.POWER_WORD) & T.matches("text", P.POWER_TERM) & T.matches("text", P.POWER_NUMBER))
    kind = F.when(T.matches("text", r"\ba priori\b"), "apriori").when(T.matches("text", r"\bsensitivity\b"), "sensitivity").when(T.matches("text", r"\bcompromise\b"), "compromise").when(T.matches("text", r"\ba posteriori\b|\bpost[- ]hoc\b|\bretrospective\b|\bobserved\b"), "posthoc").otherwise("unknown")
    n = hit.groupBy("paper_id").agg(F.count(F.lit(1)).alias("power_n"), F.array_join(F.array_sort(F.collect_set(kind)), ";").alias("power_types"))
    return Q.papers(spark, d).join(n, "paper_id", "left").fillna(0, ["power_n"]).fillna("", ["power_types"]).withColumn("traffic_light", lights((F.col("power_n") > 0, "yellow"), other="na"))


def prereg_statement(spark: SparkSession, d: str) -> DataFrame:
    n = Q.text_table(spark, d).filter(T.flag("text", P.FLAGS["prereg_mention"])).groupBy("paper_id").agg(F.count_distinct("text").alias("prereg_mentions"))
    return _per_paper(spark, d, n, lights((F.col("prereg_mentions") > 0, "info"), other="na"))


def df_consistency_check(spark: SparkSession, d: str) -> DataFrame:
    """Tests whose degrees of freedom imply more participants than the largest N that the paper names."""
    text = Q.text_table(spark, d)
    ns = text.select("paper_id", F.explode(F.regexp_extract_all("text", F.lit(P.java(r"\bn\s*=\s*([0-9]{2,6})")), F.lit(1))).alias("n")).groupBy("paper_id").agg(F.max(F.col("n").try_cast("int")).alias("max_n"))
    t = Q.tests(text).filter(F.col("kind").isin("t", "F")).withColumn("implied", F.when(F.col("kind") == "t", F.col("df1") + 2).otherwise(F.col("df1") + F.col("df2") + 2))
    n = t.join(ns, "paper_id").groupBy("paper_id").agg(F.count(F.lit(1)).alias("df_checked"), F.count_if(F.col("implied") > F.col("max_n")).alias("df_inconsistent"))
    return _per_paper(spark, d, n, lights((F.col("df_checked") == 0, "na"), (F.col("df_inconsistent") > 0, "red"), other="green"))


def funding_coi_affiliation_check(spark: SparkSession, d: str, affiliations: DataFrame) -> DataFrame:
    """Affiliations (paper_id, affiliation) named in funding sentences, and how many of them no conflict statement names."""
    text = Q.text_table(spark, d)
    said = text.groupBy("paper_id").agg(F.lower(F.concat_ws(" ", F.collect_list(F.when(T.flag("text", P.FLAGS["funding"]), F.col("text"))))).alias("fund"), F.lower(F.concat_ws(" ", F.collect_list(F.when(T.flag("text", P.FLAGS["coi"]), F.col("text"))))).alias("coi"))
    a = affiliations.select("paper_id", "affiliation").distinct().withColumn("words", T.affiliation_keywords(F.col("affiliation"))).join(said, "paper_id")
    overlap = F.exists("words", lambda k: F.contains(F.col("fund"), k))
    known = F.exists("words", lambda k: F.contains(F.col("coi"), k))
    n = a.groupBy("paper_id").agg(F.count(F.lit(1)).alias("affiliations"), F.count_if(F.col("fund") != "").alias("funded"), F.count_if(overlap).alias("affiliation_funding_overlap"), F.count_if(overlap & ~known).alias("undisclosed_overlap"))
    light = lights(((F.col("affiliations") == 0) | (F.col("funded") == 0), "na"), (F.col("affiliation_funding_overlap") == 0, "green"), (F.col("undisclosed_overlap") > 0, "red"), other="yellow")
    return _per_paper(spark, d, n, light).drop("affiliations", "funded")


def duplicate_sentences(spark: SparkSession, d: str, least_words: int = 12) -> DataFrame:
    """Normalised sentences that stand in two or more paragraphs of a paper: first wording, count, sections."""
    x = Q.text_table(spark, d).withColumn("norm", T.normalise(F.col("text"))).filter((F.size(F.split("norm", " ")) >= least_words))
    g = x.groupBy("paper_id", "norm").agg(F.count_distinct("paragraph_id").alias("n_paragraphs"), F.count(F.lit(1)).alias("n"), F.min_by("text", "text_id").alias("text"), F.array_join(F.array_sort(F.collect_set(F.coalesce("section_type", F.lit("")))), ";").alias("sections"))
    return g.filter("n_paragraphs >= 2").select("paper_id", "text", "n", "n_paragraphs", "sections")


def members(rows: DataFrame, heads: DataFrame, keys: list[str], by: str, salts: int = 16) -> DataFrame:
    """Rows with the one head of their key; the rows of a key are spread by salts, so no task gets all copies of anything."""
    salted = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.hash(by), F.lit(salts))).join(salted, [*keys, "salt"]).drop("salt")


#: Texts of a group that share a shingle above which it comes last in the order of shingles.
COMMON_SHINGLE = 20


def near_duplicates(items: DataFrame, group: str | None, item: str, text: str, k: int = 5, least: float = 0.65, least_words: int = 12, letters: bool = False) -> DataFrame:
    """(group, item_a, item_b, similarity): pairs of texts, within a group or over all, whose shingle sets have a Jaccard of ``least`` or more.

    Exact by prefix filtering: with shingles in one global order (by hash, common ones last), two sets that alike must share one of
    their first ``n - ceil(least * n) + 1``; only these are joined. Texts of equal shingles are compared once, as one class, and come out
    as pairs of the class's smallest item with the others; shorter texts than ``least_words`` are left out. With ``letters`` the letters
    and digits of all scripts count, and each sign of scripts without blanks is a word.
    """
    g = F.col(group) if group else F.lit(0)
    norm = T.normalise_letters(F.col(text)) if letters else T.normalise(F.col(text))
    base = spread(items).select(g.alias("g"), F.col(item).alias("i"), norm.alias("n")).filter((F.col("n") != "") & (F.size(F.split("n", " ")) >= least_words))
    base = base.withColumn("c", F.md5("n"))
    classes = materialise(base.groupBy("g", "c").agg(F.min("i").alias("i"), F.min("n").alias("n"), F.max("i").alias("last")))
    sets = materialise(classes.select("g", "i", T.shingle_codes(F.col("n"), k).alias("x")))
    each = sets.select("g", "i", F.explode("x").alias("s"))
    often = each.groupBy("g", "s").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > COMMON_SHINGLE).select("g", "s")
    last = each.join(often, ["g", "s"]).groupBy("g", "i").agg(F.array_sort(F.collect_list("s")).alias("last"))
    sets = sets.join(last, ["g", "i"], "left").select("g", "i", F.when(F.col("last").isNull(), F.col("x")).otherwise(F.concat(F.array_except("x", "last"), "last")).alias("x"))
    sets = materialise(sets.withColumn("m", F.size("x")))
    prefix = sets.select("g", "i", "m", F.explode(F.slice("x", F.lit(1), F.col("m") - F.ceil(F.lit(least) * F.col("m")).cast("int") + 1)).alias("s"))
    other = prefix.select("g", "s", F.col("i").alias("j"), F.col("m").alias("m2"))
    # of sets that alike the smaller holds at least ``least`` of the larger
    cand = prefix.join(other, ["g", "s"]).filter((F.col("i") < F.col("j")) & (F.col("m") >= least * F.col("m2")) & (F.col("m2") >= least * F.col("m"))).select("g", "i", "j").distinct()
    both = cand.join(sets.select("g", "i", "x"), ["g", "i"]).join(sets.select("g", F.col("i").alias("j"), F.col("x").alias("y")), ["g", "j"])
    similar = both.withColumn("similarity", T.jaccard(F.col("x"), F.col("y"))).filter(F.col("similarity") >= least).select("g", "i", "j", "similarity")
    equal = members(base.select("g", "c", F.col("i").alias("j")), classes.filter("i <> last").select("g", "c", "i"), ["g", "c"], "j").filter("i <> j").distinct().select("g", "i", "j", F.lit(1.0).alias("similarity"))
    out = similar.unionByName(equal).select(*([F.col("g").alias(group)] if group else []), F.col("i").alias(f"{item}_a"), F.col("j").alias(f"{item}_b"), F.round("similarity", 6).alias("similarity"))
    return out


def duplicate_check(spark: SparkSession, d: str) -> DataFrame:
    """Sentences that recur word for word in other paragraphs, and pairs of near-duplicate paragraphs."""
    text = Q.text_table(spark, d)
    exact = duplicate_sentences(spark, d).groupBy("paper_id").agg(F.count(F.lit(1)).alias("exact_n"))
    paragraphs = text.filter("text IS NOT NULL AND paragraph_id IS NOT NULL").groupBy("paper_id", "paragraph_id").agg(Q.joined("text", "text_id").alias("text"))
    near = near_duplicates(paragraphs, "paper_id", "paragraph_id", "text").groupBy("paper_id").agg(F.count(F.lit(1)).alias("near_n"))
    n = Q.papers(spark, d).join(exact, "paper_id", "left").join(near, "paper_id", "left").fillna(0).withColumn("duplicate_n", F.col("exact_n") + F.col("near_n"))
    some = text.filter(F.length(F.trim("text")) > 0).select("paper_id").distinct().withColumn("some", F.lit(True))
    return n.join(some, "paper_id", "left").withColumn("traffic_light", lights((F.col("some").isNull(), "na"), (F.col("duplicate_n") > 0, "yellow"), other="green")).select("paper_id", "duplicate_n", "traffic_light")


def image_hashes(images: DataFrame, key: str, pixels: str, bits: int = 256) -> DataFrame:
    """(key, hash): average hashes as longs of 32 bits each."""
    return spread(images).select(F.col(key).alias("k"), S.average_hash(F.transform(pixels, lambda x: x.cast("double")), bits).alias("hash"))


def image_pairs(hashes: DataFrame, most: int = 6, n_bits: int = 256) -> DataFrame:
    """(k_a, k_b, distance): hashes at most ``most`` bits apart. Of most + 1 bands one must be equal, so an equi-join on bands finds all."""
    bits = F.array_join(F.transform("hash", lambda w: F.lpad(F.bin(w), 32, "0")), "")
    width = -(-n_bits // (most + 1))
    classes = hashes.groupBy("hash").agg(F.min("k").alias("k"), F.max("k").alias("last"))
    bands = classes.withColumn("bits", bits).select("k", "hash", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(most)), lambda b: F.substr(F.col("bits"), b * width + 1, F.lit(width)))).alias("b", "band"))
    pairs = bands.join(bands.select("b", "band", F.col("k").alias("k2"), F.col("hash").alias("hash2")), ["b", "band"]).filter(F.col("k") < F.col("k2")).select("k", "k2", "hash", "hash2").distinct()
    near = pairs.withColumn("distance", S.hamming(F.col("hash"), F.col("hash2"))).filter(F.col("distance") <= most).select(F.col("k").alias("k_a"), F.col("k2").alias("k_b"), "distance")
    copies = members(hashes.select(F.col("k").alias("k_b"), "hash"), classes.filter("k <> last").select(F.col("k").alias("k_a"), "hash"), ["hash"], "k_b")
    same = copies.filter("k_a <> k_b").select("k_a", "k_b", F.lit(0).alias("distance"))
    return near.unionByName(same)


def image_forensic_check(hashes: DataFrame, most: int = 6, n_bits: int = 256) -> DataFrame:
    """Summary over a set of images: how many, how many look like another."""
    p = image_pairs(hashes, most, n_bits)
    dup = p.select(F.col("k_a").alias("k")).union(p.select("k_b")).distinct().agg(F.count(F.lit(1)).alias("duplicate_images"))
    return hashes.agg(F.count(F.lit(1)).alias("image_n")).join(dup, F.lit(True)).withColumn("traffic_light", lights((F.col("image_n") == 0, "na"), (F.col("duplicate_images") > 0, "red"), other="green"))
