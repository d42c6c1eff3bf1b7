"""Text query layer: the searchable text of all papers, searches, context, and extraction of reported values."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce, wraps
from threading import Lock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.functions import patterns as P
from quirewise.functions import text as T
from quirewise.operators.ranks import numbered
from quirewise.runtime import materialise, table

KEYS = ["paper_id", "section_id", "paragraph_id", "text_id"]


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of all papers, each key once: rows that come again differ in loaded_at only. Columns that a plan doesn't use
    aren't shuffled."""
    return table(spark, d, "sentence").drop("loaded_at").dropDuplicates(["paper_id", "text_id"])


def sections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "section").select("paper_id", "section_id", "header", "section_type").distinct()


#: What the operators of one context share within ``sharing``.
_shared: ContextVar[dict | None] = ContextVar("shared", default=None)


@contextmanager
def sharing(spark: SparkSession, d: str) -> Iterator[None]:
    """Within it all operators read one written copy of the searchable text and of what is extracted from it, instead of each scanning anew."""
    token = _shared.set({"folder": (spark.sparkContext.applicationId, d)})
    _shared.get()["text"] = materialise(text_table(spark, d).drop("formatted", "page_number"))
    try:
        yield
    finally:
        _shared.reset(token)


def once(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator on a text, or on (spark, folder), whose result is written once and read again within ``sharing``."""

    @wraps(f)
    def run(*args):
        held = _shared.get()
        ours = held is not None and "text" in held and (len(args) == 1 and args[0] is held["text"] or len(args) == 2 and isinstance(args[0], SparkSession) and (args[0].sparkContext.applicationId, args[1]) == held["folder"])
        if not ours:
            return f(*args)
        with held.setdefault(("lock", f), Lock()):  # of several threads that ask for it one writes
            if f not in held:
                held[f] = materialise(f(*args))
        return held[f]

    return run


@once
def papers(spark: SparkSession, d: str) -> DataFrame:
    """Ids of all papers, with or without sentences."""
    return table(spark, d, "paper").select("paper_id").union(table(spark, d, "sentence").select("paper_id")).distinct()


@once
def references(spark: SparkSession, d: str) -> DataFrame:
    """The bibliography, each entry once: the row loaded last; one without a time counts as the earliest."""
    rows = table(spark, d, "bib")
    rest = [c for c in rows.columns if c not in ("paper_id", "bib_id", "loaded_at")]
    when = F.coalesce("loaded_at", F.lit("0001-01-01 00:00:00").cast(rows.schema["loaded_at"].dataType))
    return rows.groupBy("paper_id", "bib_id").agg(*[F.max_by(c, when).alias(c) for c in rest])  # unused ones aren't read


def written(df: DataFrame) -> DataFrame:
    """``df`` written once, or as it is where ``sharing`` has written it already."""
    held = _shared.get()
    return df if held is not None and any(df is x for x in list(held.values())) else materialise(df)


def text_table(spark: SparkSession, d: str, include_refs: bool = False) -> DataFrame:
    """Sentences with header and type of their section; the reference list is left out. Null texts never match anything."""
    held = _shared.get()
    if held is not None and "text" in held and held["folder"] == (spark.sparkContext.applicationId, d) and not include_refs:
        return held["text"]
    out = sentences(spark, d).join(sections(spark, d), ["paper_id", "section_id"], "left")
    return out if include_refs else out.filter(F.coalesce("section_type", F.lit("")) != "references")


def search(text: DataFrame, pattern: str | list[str], *, returns: str = "sentence", fixed: bool = False, exclude: bool = False, headers: bool = False, ignore_case: bool = True, distinct: bool = True) -> DataFrame:
    """Sentences (or matches, papers, paragraphs, sections, headers) whose text fits a pattern or one of several.

    ``fixed`` looks for literal text and minds the case; ``exclude`` keeps what fits none of the patterns; ``headers`` also looks at
    section headers. Results are sets unless ``distinct`` is off. A malformed pattern raises ValueError at once.
    """
    many = [pattern] if isinstance(pattern, str) else list(pattern)
    if not fixed:
        for p in many:
            _validate(text.sparkSession, P.java(p, ignore_case))

    def fits(p: str) -> Column:
        one = lambda c: F.coalesce(F.col(c).contains(p) if fixed else T.matches(c, p, ignore_case), F.lit(False))
        return one("text") | one("header") if headers else one("text")

    hit = reduce(lambda a, b: a | b, map(fits, many))
    found = text.filter(F.col("text").isNotNull() & (~hit if exclude else hit))
    if returns == "match":
        if fixed or exclude:
            raise ValueError("matches need a pattern that is looked for")
        parts = [text.filter(fits(p)).withColumn("text", F.explode(F.regexp_extract_all("text", F.lit(P.java(p, ignore_case)), F.lit(0)))) for p in many]
        found = reduce(DataFrame.unionByName, parts)
    elif returns == "paper_id":
        return found.select("paper_id").distinct()
    elif returns in ("paragraph", "section", "header"):
        by = {"paragraph": ["paper_id", "section_id", "paragraph_id"], "section": ["paper_id", "section_id"], "header": ["paper_id", "header"]}[returns]
        return found.groupBy(*by).agg(joined("text", "text_id").alias("text"))
    elif returns != "sentence":
        raise ValueError(f"unknown kind of result: {returns}")
    return found.distinct() if distinct else found


def _validate(spark: SparkSession, pattern: str) -> None:
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:
        raise ValueError(f"malformed pattern {pattern!r}: {str(e)[:200]}") from e


def joined(text: str, order: str, sep: str = " ") -> Column:
    """Texts of a group in order, blanks squeezed."""
    return F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), sep), r"[ \t\n\r]+", " ")


def expand(found: DataFrame, text: DataFrame, to: str = "sentence", plus: int = 0, minus: int = 0) -> DataFrame:
    """Matches with their context in ``expanded``: the sentence with ``minus`` before and ``plus`` after it, or the paragraph."""
    if to == "sentence":
        around = text.select("paper_id", "text_id", F.col("text").alias("expanded"))
        if plus or minus:
            at = text.select("paper_id", "text_id", "text").join(numbered(text, ["paper_id"], ["text_id"]), ["paper_id", "text_id"])
            wanted = found.select("paper_id", "text_id").distinct().join(at.drop("text"), ["paper_id", "text_id"]).withColumn("pos", F.explode(F.sequence(F.col("pos") - minus, F.col("pos") + plus)))
            around = wanted.join(at.drop("text_id"), ["paper_id", "pos"]).groupBy("paper_id", "text_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("expanded"))
        keys = ["paper_id", "text_id"]
    elif to in ("paragraph", "section"):
        keys = ["paper_id", "section_id", "paragraph_id"][: 3 if to == "paragraph" else 2]
        around = text.groupBy(*keys).agg(joined("text", "text_id").alias("expanded"))
    else:
        raise ValueError(f"unknown context: {to}")
    return found.join(around, keys, "left").withColumn("expanded", F.coalesce("expanded", "text"))


def exploded(text: DataFrame, pattern: str, name: str = "match", ignore_case: bool = True) -> DataFrame:
    """One row per match, with its number in the sentence as ``ord``; sentences without one are filtered before the explode."""
    rx = P.java(pattern, ignore_case)
    return text.filter(F.col("text").rlike(rx)).select("*", F.posexplode(F.regexp_extract_all("text", F.lit(rx), F.lit(0))).alias("ord", name))


@once
def p_values(text: DataFrame) -> DataFrame:
    """Reported p-values: comparator and number, null for n.s."""
    rx = P.java(P.P_VALUE)
    g = lambda k: F.regexp_extract("match", rx, k)
    return exploded(text, P.P_VALUE).select("paper_id", "text_id", "ord", "text", "match", g(1).alias("p_comp"), T.p_number(g(2), g(3)).alias("p_value"))


@once
def urls(text: DataFrame) -> DataFrame:
    """Addresses in the text without punctuation at their end, first occurrence of each in a paper, with host and kind of place."""
    found = exploded(text, P.URL, "url").select("paper_id", "text_id", "ord", F.regexp_replace("url", r"[.,;:)\]}<>]+$", "").alias("url"))
    first = found.groupBy("paper_id", "url").agg(F.min(F.struct("text_id", "ord")).alias("f"))
    host = F.lower(F.regexp_extract("url", r"^(?:https?://)?(?:www\.)?([^/:]+)", 1))
    return first.select("paper_id", F.col("f.text_id").alias("text_id"), "url", host.alias("host"), link_kind(host).alias("kind"))


def link_kind(host: Column) -> Column:
    """The repository a host belongs to, or "other"."""
    known = F.when(host.endswith("github.com"), "github").when(host.endswith("osf.io"), "osf").when(host.endswith("zenodo.org"), "zenodo").when(host.endswith("researchbox.org"), "researchbox")
    return known.when(host.endswith("aspredicted.org"), "aspredicted").otherwise("other")


def osf_id(url: Column) -> Column:
    """The five-character id in an address of the archive."""
    return F.regexp_extract(url, r"osf\.io/([A-Za-z0-9]{5})", 1)


def equations(text: DataFrame) -> DataFrame:
    """Reported equations: left side, degrees of freedom, comparator, right side; grp_id numbers the sentences that have any."""
    first = exploded(text, P.EQUATION)
    df = F.regexp_extract("match", r"(\([^)]*\))", 1)
    bare = F.regexp_replace("match", r"\([^)]*\)", " ")
    comp = F.regexp_extract(bare, f"([{P.COMPARATORS}]{{1,2}})", 1)
    side = lambda k: F.trim(F.regexp_replace(F.split(bare, f"[{P.COMPARATORS}]{{1,2}}")[k], r"[ \t]+", " "))
    out = first.select("paper_id", "text_id", "ord", side(0).alias("lhs"), F.when(df != "", df).alias("df"), comp.alias("comp"), side(1).alias("rhs"))
    return out.join(numbered(out, ["paper_id"], ["text_id"], "grp_id"), ["paper_id", "text_id"]).filter(~F.col("lhs").rlike("^[0-9]$"))


@once
def descriptives(text: DataFrame) -> DataFrame:
    """Mean, sd, n, range, percentages and "k of n" of a sentence; sentences with none are left out."""
    x = lambda p, k=1: F.regexp_extract("text", P.java(p), k)
    num = lambda p, k=1: x(p, k).try_cast("double")
    mean = F.coalesce(num(rf"\bM\s*=\s*({P.NUMBER})"), num(rf"\bmeans?\s*(?:=|of|was)\s*({P.NUMBER})"))
    sd = F.coalesce(num(r"\bSD\s*=\s*([0-9]*\.?[0-9]+)"), num(r"\bstandard deviations?\s*(?:=|of|was)\s*([0-9]*\.?[0-9]+)"))
    n = x(r"\bn\s*=\s*([0-9]+)").try_cast("int")
    a, b = num(rf"\brang(?:e|ed|ing)\s*(?:=|from|of)?\s*({P.NUMBER})\s*(?:to|-|–)\s*({P.NUMBER})"), num(rf"\brang(?:e|ed|ing)\s*(?:=|from|of)?\s*({P.NUMBER})\s*(?:to|-|–)\s*({P.NUMBER})", 2)
    percents = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"([0-9]+(?:\.[0-9]+)?)\s*%"), F.lit(1)), lambda v: v.try_cast("double")), lambda v: v.isNotNull())
    k_of = r"\b([0-9]+)\s+(?:out )?of\s+(?:the\s+)?([0-9]+)\b"
    out = text.filter(F.col("text").rlike("[0-9]")).select(
        "paper_id", "text_id", mean.alias("mean"), sd.alias("sd"), n.alias("n"), F.least(a, b).alias("min"), F.greatest(a, b).alias("max"), percents.alias("percent"), x(k_of).try_cast("int").alias("k"), x(k_of, 2).try_cast("int").alias("of_n")
    )
    return out.filter(F.coalesce("mean", "sd", "n", "min", "k").isNotNull() | (F.size("percent") > 0))


@once
def tests(text: DataFrame) -> DataFrame:
    """t, F and chi-square tests of a sentence: kind, degrees of freedom, value, and the p reported right behind it."""
    parts = []
    for kind, pattern, value in (("t", P.T_TEST, 2), ("F", P.F_TEST, 3), ("chi2", P.CHI_TEST, 2)):
        rx = P.java(rf"{pattern}(?:\s*{P.P_NEXT})?", kind == "chi2")
        g = lambda k, rx=rx: F.regexp_extract("match", rx, k)
        found = text.filter(F.col("text").rlike(P.java(pattern, kind == "chi2"))).select("paper_id", "text_id", "text", F.posexplode(F.regexp_extract_all("text", F.lit(rx), F.lit(0))).alias("ord", "match"))
        parts.append(
            found.select(
                "paper_id", "text_id", F.lit(kind).alias("kind"), "ord", g(1).try_cast("int").alias("df1"), (g(2).try_cast("int") if kind == "F" else F.lit(None).cast("int")).alias("df2"), g(value).try_cast("double").alias("value"), F.nullif(g(value + 1), F.lit("")).alias("p_comp"), g(value + 2).try_cast("double").alias("p_reported"), "text"
            )
        )
    return reduce(DataFrame.unionByName, parts)
