"""All queries of the core by name, with their SQL. A query takes (spark, folder of the tables) and covers whole tables."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirewise.functions import patterns as P
from quirewise.functions import text as T
from quirewise.operators import checks as C
from quirewise.operators import joins as J
from quirewise.operators import overlap as O
from quirewise.operators import refs as R
from quirewise.operators import report as RP
from quirewise.operators import runner
from quirewise.operators import search as Q
from quirewise.plans import fixtures as FX
from quirewise.plans import relational
from quirewise.plans import sql as S
from quirewise.sources import files as FS
from quirewise.runtime import table

FLAGSHIP = "overlap_light"
#: Checks whose plans are made at a time.
THREADS = 6
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = dict(relational.QUERIES)
_SQL: dict[str, str] = dict(relational.SQL)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def keep(f: Query) -> Query:
        k = name or f.__name__
        _QUERIES[k] = f
        if sql is not None:
            _SQL[k] = sql
        return f

    return keep


B = S.BODY

# --- text ---


@query(f"SELECT doc_id, i AS pos, s AS sentence FROM (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\f\\r]+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^[ \\t\\n\\f\\r]+|[ \\t\\n\\f\\r]+$', '', 'g')), lambda x: x <> '') AS l FROM documents))")
def sentence_split(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "sentence"))


_WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)?"


@query(f"SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), {S.q(_WORD)}, 0) AS w FROM documents WHERE text IS NOT NULL)")
def token_counts(s: SparkSession, d: str) -> DataFrame:
    w = T.words(F.col("text"))
    return table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"))


@query(f"SELECT doc_id, pos, word, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY pos) - length(word) AS INT) AS start_pos FROM (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word, unnest(string_split_regex(text, {S.q(_WORD)})[:len(w)]) AS gap FROM (SELECT doc_id, text, regexp_extract_all(text, {S.q(_WORD)}, 0) AS w FROM documents WHERE text IS NOT NULL))")
def tokens(s: SparkSession, d: str) -> DataFrame:
    """Every word of every document with its number and its place: what lies before it is the gaps and words so far."""
    return T.tokens(table(s, d, "documents"), "doc_id", "text").select("doc_id", "pos", "word", "start_pos")


@query(f"SELECT doc_id, len(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))) AS n_shingles FROM (SELECT doc_id, list_filter(string_split({S.norm('text')}, ' '), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0")
def shingle_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.size(T.shingles(F.col("text"))).alias("n_shingles")).filter("n_shingles > 0")


@query(f"SELECT paper_id, text_id, {S.strip('formatted')} AS plain FROM (SELECT DISTINCT paper_id, text_id, formatted FROM sentence) WHERE formatted IS NOT NULL")
def strip_markup(s: SparkSession, d: str) -> DataFrame:
    return Q.sentences(s, d).filter("formatted IS NOT NULL").select("paper_id", "text_id", T.strip_tags(F.col("formatted")).alias("plain"))


@query("SELECT paper_id, section_id, CASE WHEN h LIKE '%abstract%' THEN 'abstract' WHEN h LIKE '%intro%' THEN 'intro' WHEN regexp_matches(h, 'method|material') THEN 'method' WHEN h LIKE '%result%' THEN 'results' WHEN h LIKE '%discuss%' THEN 'discussion' WHEN regexp_matches(h, 'bibliograph|reference') THEN 'references' END AS kind FROM (SELECT DISTINCT paper_id, section_id, lower(regexp_replace(header, '[ \\t\\n\\r]', '', 'g')) AS h FROM section)")
def section_classify(s: SparkSession, d: str) -> DataFrame:
    return Q.sections(s, d).select("paper_id", "section_id", T.section_type(F.col("header")).alias("kind"))


@query("SELECT paper_id, section_id, last_value(section_type IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY section_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM (SELECT DISTINCT paper_id, section_id, section_type FROM section)")
def section_forward_fill(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("paper_id").orderBy("section_id").rowsBetween(Window.unboundedPreceding, 0)
    return Q.sections(s, d).select("paper_id", "section_id", F.last("section_type", True).over(w).alias("filled"))


_COLS = "paper_id, section_id, paragraph_id, text_id, text"
_SEL = _COLS.split(", ")
_A, _Z = r"\bbecause\b", r"\bdespite\b|\bwithout\b"


@query(f"{B} SELECT DISTINCT {_COLS} FROM body WHERE {S.rx('text', _A)}")
def search_sentence(s: SparkSession, d: str) -> DataFrame:
    return Q.search(Q.text_table(s, d), _A).select(_SEL).distinct()


@query(f"{B} SELECT DISTINCT {_COLS} FROM body WHERE contains(text, 'because')")
def search_fixed(s: SparkSession, d: str) -> DataFrame:
    return Q.search(Q.text_table(s, d), "because", fixed=True).select(_SEL).distinct()


@query(f"{B} SELECT DISTINCT {_COLS} FROM body WHERE {S.rx('text', _A)} OR {S.rx('text', _Z)}")
def search_any(s: SparkSession, d: str) -> DataFrame:
    return Q.search(Q.text_table(s, d), [_A, _Z]).select(_SEL).distinct()


@query(f"{B} SELECT DISTINCT {_COLS} FROM body WHERE text IS NOT NULL AND NOT {S.rx('text', _A)} AND NOT {S.rx('text', _Z)}")
def search_exclude(s: SparkSession, d: str) -> DataFrame:
    return Q.search(Q.text_table(s, d), [_A, _Z], exclude=True).select(_SEL).distinct()


@query(f"{B} SELECT DISTINCT {_COLS} FROM body WHERE text IS NOT NULL AND ({S.rx('text', 'participants')} OR {S.rx('header', 'participants')})")
def search_header(s: SparkSession, d: str) -> DataFrame:
    return Q.search(Q.text_table(s, d), "participants", headers=True).select(_SEL).distinct()


_M = r"[a-z]+ism\b"


@query(f"{B} SELECT DISTINCT {_COLS} FROM (SELECT * EXCLUDE (text), unnest(regexp_extract_all(text, {S.q(_M)}, 0, 'i')) AS text FROM body)")
def search_match(s: SparkSession, d: str) -> DataFrame:
    return Q.search(Q.text_table(s, d), _M, returns="match").select(_SEL).distinct()


@query(f"{B} SELECT DISTINCT paper_id FROM body WHERE {S.rx('text', _A)}")
def search_paper_ids(s: SparkSession, d: str) -> DataFrame:
    return Q.search(Q.text_table(s, d), _A, returns="paper_id")


_AGG = "regexp_replace(string_agg(text, ' ' ORDER BY text_id), '[ \\t\\n\\r]+', ' ', 'g') AS text"


@query(f"{B} SELECT paper_id, section_id, paragraph_id, {_AGG} FROM body WHERE {S.rx('text', _A)} GROUP BY 1, 2, 3")
def search_paragraph(s: SparkSession, d: str) -> DataFrame:
    return Q.search(Q.text_table(s, d), _A, returns="paragraph")


@query(f"{B} SELECT paper_id, section_id, {_AGG} FROM body WHERE {S.rx('text', _A)} GROUP BY 1, 2")
def search_section(s: SparkSession, d: str) -> DataFrame:
    return Q.search(Q.text_table(s, d), _A, returns="section")


@query(f"{B} SELECT paper_id, text_id, coalesce(concat_ws(' ', before, text, after), text) AS expanded FROM (SELECT *, lag(text) OVER w AS before, lead(text) OVER w AS after FROM body WINDOW w AS (PARTITION BY paper_id ORDER BY text_id)) WHERE {S.rx('text', _A)}")
def expand_context(s: SparkSession, d: str) -> DataFrame:
    body = Q.text_table(s, d)
    return Q.expand(Q.search(body, _A).select("paper_id", "text_id", "text"), body, plus=1, minus=1).select("paper_id", "text_id", "expanded")


@query(f"{B}, {S.PV} SELECT paper_id, text_id, ord, match, p_comp, round(p_value, 9) AS p_value FROM pv")
def p_values(s: SparkSession, d: str) -> DataFrame:
    return Q.p_values(Q.text_table(s, d)).select("paper_id", "text_id", "ord", "match", "p_comp", F.round("p_value", 9).alias("p_value"))


_BARE = "regexp_replace(match, '\\([^)]*\\)', ' ', 'g')"
_SIDE = "trim(regexp_replace(string_split_regex(" + _BARE + ", '[" + P.COMPARATORS + "]{{1,2}}')[{}], '[ \\t]+', ' ', 'g'))"


@query(f"{B} SELECT paper_id, text_id, ord, grp_id, lhs, df, comp, rhs FROM (SELECT paper_id, text_id, ord, dense_rank() OVER (PARTITION BY paper_id ORDER BY text_id) AS grp_id, {_SIDE.format(1)} AS lhs, nullif(regexp_extract(match, '(\\([^)]*\\))', 1), '') AS df, regexp_extract({_BARE}, '([{P.COMPARATORS}]{{1,2}})', 1) AS comp, {_SIDE.format(2)} AS rhs FROM ({S.exploded(P.EQUATION)})) WHERE NOT regexp_matches(lhs, '^[0-9]$')")
def equations(s: SparkSession, d: str) -> DataFrame:
    return Q.equations(Q.text_table(s, d)).select("paper_id", "text_id", "ord", "grp_id", "lhs", "df", "comp", "rhs")


@query(f"{B}, {S.desc()} SELECT * FROM descr")
def descriptives(s: SparkSession, d: str) -> DataFrame:
    return Q.descriptives(Q.text_table(s, d))


@query(f"{B}, {S.tests()} SELECT paper_id, text_id, kind, ord, df1, df2, value, p_comp, p_reported FROM tests")
def test_statistics(s: SparkSession, d: str) -> DataFrame:
    return Q.tests(Q.text_table(s, d)).drop("text")


@query(f"{B}, {S.effects()} SELECT * FROM effects")
def effect_sizes(s: SparkSession, d: str) -> DataFrame:
    return C.effects(Q.text_table(s, d))


_CI = [S.g(P.CI, k) for k in (1, 2, 3)]


@query(f"{B} SELECT paper_id, text_id, ord, CAST({_CI[0]} AS DOUBLE) / 100 AS level, CAST({_CI[1]} AS DOUBLE) AS lo, CAST({_CI[2]} AS DOUBLE) AS hi FROM ({S.exploded(P.CI)})")
def confidence_intervals(s: SparkSession, d: str) -> DataFrame:
    return C.intervals(Q.text_table(s, d))


# sentences with links, made from the bibliography by rule, as the tables hold none
_LINKS = """links AS (SELECT DISTINCT paper_id, bib_id AS text_id, CASE bib_id % 6 WHEN 0 THEN 'Code is at https://github.com/lab' || bib_id || '/repo, see there.' WHEN 1 THEN 'Data: https://osf.io/ab' || CAST(100 + bib_id % 50 AS VARCHAR) || '/.' WHEN 2 THEN 'We registered this at https://aspredicted.org/x' || bib_id || '.pdf (first).' WHEN 3 THEN 'See www.example.org/a and zenodo.org/record/' || bib_id || '.' WHEN 4 THEN 'Ask info@example.com about it.' ELSE 'No link here.' END AS text FROM bib)"""


def _links(s: SparkSession, d: str) -> DataFrame:
    b, k = F.col("bib_id"), F.col("bib_id").cast("string")
    text = (
        F.when(b % 6 == 0, F.concat(F.lit("Code is at https://github.com/lab"), k, F.lit("/repo, see there."))).when(b % 6 == 1, F.concat(F.lit("Data: https://osf.io/ab"), (100 + b % 50).cast("string"), F.lit("/."))).when(b % 6 == 2, F.concat(F.lit("We registered this at https://aspredicted.org/x"), k, F.lit(".pdf (first).")))
        .when(b % 6 == 3, F.concat(F.lit("See www.example.org/a and zenodo.org/record/"), k, F.lit("."))).when(b % 6 == 4, F.lit("Ask info@example.com about it.")).otherwise("No link here.")
    )
    return table(s, d, "bib").select("paper_id", b.alias("text_id"), text.alias("text")).distinct()


@query(f"WITH {_LINKS}, {S.urls('links')} SELECT paper_id, text_id, url, host, kind FROM urls")
def links(s: SparkSession, d: str) -> DataFrame:
    return Q.urls(_links(s, d))


_FILES = "files AS (SELECT url, unnest(['data/d.csv', 'analysis.R', 'README.md', 'all.zip', 'fig.png']) AS path FROM (SELECT DISTINCT url FROM urls WHERE kind = 'github'))"


def _files(s: SparkSession, d: str) -> DataFrame:
    return Q.urls(_links(s, d)).filter("kind = 'github'").select("url").distinct().select("url", F.explode(F.array(*map(F.lit, ["data/d.csv", "analysis.R", "README.md", "all.zip", "fig.png"]))).alias("path"))


_FT = "CASE WHEN regexp_matches(lower(path), '\\.(zip|tar|gz|7z|rar)$') THEN 'archive' WHEN regexp_matches(lower(path), '\\.(r|rmd|py|sas|do|stata|spss|jasp)$') THEN 'code' WHEN regexp_matches(lower(path), '(^|/)readme|\\.md$') THEN 'readme' WHEN regexp_matches(lower(path), '\\.(csv|tsv|xlsx|xls|sav|dta|json|rds)$') THEN 'data' ELSE 'other' END"


@query(f"WITH {_LINKS}, {S.urls('links')}, {_FILES} SELECT paper_id, count(DISTINCT url) AS repo_n, count(t) AS files_n, count(*) FILTER (WHERE t = 'data') AS files_data, count(*) FILTER (WHERE t = 'code') AS files_code, count(*) FILTER (WHERE t = 'readme') AS files_readme, count(*) FILTER (WHERE t = 'archive') AS files_archive, CASE WHEN count(DISTINCT url) = 0 THEN 'na' WHEN count(*) FILTER (WHERE t = 'archive') > 0 THEN 'yellow' ELSE 'green' END AS traffic_light FROM (SELECT DISTINCT paper_id, url FROM urls WHERE kind <> 'other') LEFT JOIN (SELECT url, {_FT} AS t FROM files) USING (url) GROUP BY 1")
def repo_check(s: SparkSession, d: str) -> DataFrame:
    return R.repo_check(Q.urls(_links(s, d)), _files(s, d))


_OSF = "states AS (SELECT 'ab' || CAST(100 + i AS VARCHAR) AS osf_id, CASE WHEN i % 2 = 0 THEN 'registrations' ELSE 'nodes' END AS osf_type FROM range(0, 40) t(i))"


@query(f"WITH {_LINKS}, {S.urls('links')}, {_OSF} SELECT *, osf_registrations > 0 OR aspredicted_links > 0 AS preregistration, 'info' AS traffic_light FROM (SELECT paper_id, count(*) FILTER (WHERE kind = 'osf') AS osf_links, count(*) FILTER (WHERE osf_type = 'registrations') AS osf_registrations, count(*) FILTER (WHERE kind = 'aspredicted') AS aspredicted_links FROM (SELECT *, nullif(regexp_extract(url, 'osf\\.io/([A-Za-z0-9]{{5}})', 1), '') AS osf_id FROM urls) LEFT JOIN states USING (osf_id) GROUP BY 1) WHERE osf_links + aspredicted_links > 0")
def prereg_check(s: SparkSession, d: str) -> DataFrame:
    states = s.range(40).select(F.concat(F.lit("ab"), (100 + F.col("id")).cast("string")).alias("osf_id"), F.when(F.col("id") % 2 == 0, "registrations").otherwise("nodes").alias("osf_type"))
    return R.prereg_check(Q.urls(_links(s, d)), states)


_CODE = "SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'a.R' WHEN 1 THEN 'b.py' ELSE 'c.do' END AS name, text AS content FROM documents WHERE text IS NOT NULL"


@query(f"""SELECT *, CAST(n_absolute_paths > 0 AS INT) + CAST(unseeded AS INT) + CAST(n_comments = 0 AS INT) AS issues FROM (SELECT id, CASE name WHEN 'a.R' THEN 'R' WHEN 'b.py' THEN 'Python' ELSE 'Stata' END AS language, len(string_split(content, chr(10))) AS n_lines, len(list_filter(string_split(content, chr(10)), lambda x: starts_with(ltrim(x), '#') OR starts_with(ltrim(x), '//') OR starts_with(ltrim(x), '*'))) AS n_comments, len(regexp_extract_all(content, '["''](?:[A-Za-z]:\\\\|/home/|/Users/|~/)', 0)) AS n_absolute_paths, regexp_matches(content, '\\b(rnorm|runif|sample|random|randint|shuffle)\\s*\\(') AND NOT regexp_matches(content, 'set\\.seed|random\\.seed|np\\.random\\.seed|set seed') AS unseeded FROM ({_CODE}))""")
def code_check(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id") % 3
    return R.code_check(table(s, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.when(i == 0, "a.R").when(i == 1, "b.py").otherwise("c.do").alias("name"), F.col("text").alias("content")))


@query(f"WITH {_LINKS}, {S.urls('links')} SELECT url, code, CASE WHEN code IS NULL OR code = 0 THEN 'unreachable' WHEN code < 400 THEN 'ok' WHEN code IN (401, 403, 405, 429, 999) THEN 'manual' ELSE 'error' END AS state FROM (SELECT DISTINCT url, CASE length(url) % 5 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 403 WHEN 3 THEN 0 END AS code FROM urls)")
def link_states(s: SparkSession, d: str) -> DataFrame:
    u = Q.urls(_links(s, d))
    k = F.length("url") % 5
    status = u.select("url").distinct().select("url", F.when(k == 0, 200).when(k == 1, 404).when(k == 2, 403).when(k == 3, 0).alias("code")).filter("code IS NOT NULL")
    return FS.link_states(u, status)


# --- joins ---


@query("SELECT e.event_id, e.user_id, p.value AS last_value, p.event_id AS last_event FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def join_as_of(s: SparkSession, d: str) -> DataFrame:
    """Every other event with the user's last purchase before it."""
    e = table(s, d, "events")
    right = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_event"), F.col("value").alias("last_value"))
    return J.as_of(e.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", ["last_event", "last_value"]).select("event_id", "user_id", "last_value", "last_event")


@query("SELECT p.p_partkey, l.l_orderkey, l.l_linenumber FROM part p JOIN lineitem l ON l.l_partkey = p.p_partkey WHERE l.l_quantity >= p.p_size AND l.l_quantity < p.p_size + 5")
def join_within(s: SparkSession, d: str) -> DataFrame:
    """Order lines whose quantity lies in the interval [size, size + 5) of their part."""
    points = table(s, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    spans = table(s, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("lo"), (F.col("p_size") + 5).cast("long").alias("hi"))
    return J.within(points, spans, ["p_partkey"], "q", "lo", "hi", 5).select("p_partkey", "l_orderkey", "l_linenumber")


# --- checks ---

for _name in P.CHECKS:
    query(S.keyword(_name), _name)(partial(lambda s, d, n: C.keyword_check(s, d, n), n=_name))
query(S.keyword_verdicts(), "keyword_verdicts")(C.keyword_verdicts)
query(f"{B} SELECT paper_id, item, n > 0 AS found FROM (SELECT paper_id, unnest({[*P.R_ITEMS, 'bib', 'doi']}) AS item, unnest([{', '.join(f'coalesce({x}, 0)' for x in [*P.R_ITEMS, 'n_bib', 'n_doi'])}]) AS n FROM papers LEFT JOIN (SELECT paper_id, {', '.join(f'count(*) FILTER (WHERE {S.flag(f)}) AS {f}' for f in P.R_ITEMS)} FROM body GROUP BY 1) USING (paper_id) LEFT JOIN (SELECT paper_id, count(*) AS n_bib FROM refs GROUP BY 1) USING (paper_id) LEFT JOIN (SELECT paper_id, count(*) FILTER (WHERE trim(doi) <> '') AS n_doi FROM paper GROUP BY 1) USING (paper_id))", "r2_items")(C.r2_items)
query(f"{B} " + " UNION ALL ".join(f"SELECT paper_id, text_id, '{f}' AS flag FROM body WHERE {S.flag(f)}" for f in P.FLAGS), "keyword_hits")(C.keyword_hits)
query(f"{B}, {S.PV} " + S.per_paper("SELECT paper_id, count(*) AS p_values FROM pv GROUP BY 1", ["p_values"], "CASE WHEN p_values > 0 THEN 'info' ELSE 'na' END"), "all_p_values")(C.all_p_values)
query(f"{B}, {S.urls()} " + S.per_paper("SELECT paper_id, count(*) AS urls FROM urls GROUP BY 1", ["urls"], "CASE WHEN urls > 0 THEN 'info' ELSE 'na' END"), "all_urls")(C.all_urls)
_STAR = S.rx("text", r"\* *p *<")
query(
    f"{B}, {S.PV} " + S.per_paper(f"SELECT paper_id, count(*) AS n_p, count(*) FILTER (WHERE (p_comp = '<' AND coalesce(p_value, 1) > 0.001 OR p_comp NOT IN ('=', '<') OR p_value IS NULL) AND NOT {_STAR}) AS n_imprecise, count(*) FILTER (WHERE p_comp = '=' AND p_value = 0) AS n_zero FROM pv GROUP BY 1", ["n_p", "n_imprecise", "n_zero"], "CASE WHEN n_p = 0 THEN 'na' WHEN n_imprecise = 0 AND n_zero = 0 THEN 'green' ELSE 'red' END", ["n_imprecise", "n_zero"]), "stat_p_exact"
)(C.stat_p_exact)
query(f"{B}, {S.PV} " + S.per_paper("SELECT paper_id, count(*) FILTER (WHERE NOT coalesce(p_value <= 0.05 AND p_comp IN ('<', '='), false)) AS n_nonsignificant FROM pv GROUP BY 1", ["n_nonsignificant"], "CASE WHEN n_nonsignificant > 0 THEN 'yellow' ELSE 'green' END"), "stat_p_nonsig")(C.stat_p_nonsig)
_SC = f"sc AS (SELECT *, err AS error, err AND (p_reported < 0.05) <> (p_computed < 0.05) AS decision_error FROM (SELECT *, CASE WHEN p_comp = '<' THEN p_computed >= p_reported ELSE round(p_computed, 3) <> round(p_reported, 3) END AS err FROM (SELECT *, round({S.COMPUTED}, 6) AS p_computed FROM tests WHERE kind IN ('t', 'F') AND p_reported IS NOT NULL) WHERE p_computed IS NOT NULL))"


@query(f"{B}, {S.tests()}, {_SC} SELECT paper_id, text_id, kind, ord, p_reported, p_computed, error, decision_error FROM sc")
def statcheck_rows(s: SparkSession, d: str) -> DataFrame:
    return C.statcheck_rows(s, d).select("paper_id", "text_id", "kind", "ord", "p_reported", "p_computed", "error", "decision_error")


query(f"{B}, {S.tests()}, {_SC} " + S.per_paper("SELECT paper_id, count(*) AS statcheck_found, count(*) FILTER (WHERE error) AS statcheck_errors, count(*) FILTER (WHERE decision_error) AS statcheck_decision_errors FROM sc GROUP BY 1", ["statcheck_found", "statcheck_errors", "statcheck_decision_errors"], "CASE WHEN statcheck_found = 0 THEN 'na' WHEN statcheck_errors > 0 THEN 'red' ELSE 'green' END"), "stat_check")(C.stat_check)
_ES = ["t_with_es", "t_without_es", "f_with_es", "f_without_es"]
_HAS = "(EXISTS (SELECT 1 FROM effects e WHERE e.paper_id = tests.paper_id AND e.text_id = tests.text_id))"
query(f"{B}, {S.tests()}, {S.effects()} " + S.per_paper("SELECT paper_id, " + ", ".join(f"count(*) FILTER (WHERE kind = '{c[0].upper() if c[0] == 'f' else 't'}' AND {'h' if '_with_' in c else 'NOT h'}) AS {c}" for c in _ES) + f" FROM (SELECT paper_id, kind, {_HAS} AS h FROM tests WHERE kind IN ('t', 'F')) GROUP BY 1", _ES, "CASE WHEN t_with_es + t_without_es + f_with_es + f_without_es = 0 THEN 'na' WHEN t_with_es + f_with_es = 0 THEN 'red' WHEN t_without_es + f_without_es > 0 THEN 'yellow' ELSE 'green' END"), "stat_effect_size")(C.stat_effect_size)
_X = lambda p: f"try_cast(nullif(regexp_extract(text, {S.q(p)}, 1, 'i'), '') AS INT)"
_SIZES = f"sizes AS (SELECT paper_id, text_id, coalesce({_X(chr(92) + 'bn1' + chr(92) + 's*=' + chr(92) + 's*([0-9]+)')}, {_X(chr(92) + 'bn' + chr(92) + 's*=' + chr(92) + 's*([0-9]+)')}) AS n1, {_X(chr(92) + 'bn2' + chr(92) + 's*=' + chr(92) + 's*([0-9]+)')} AS n2, {_X(chr(92) + 'b(?:df|m)' + chr(92) + 's*=' + chr(92) + 's*([0-9]+)')} AS m FROM body)"
_D = "CASE WHEN n1 > 0 AND n2 > 0 THEN value * sqrt(1 / n1 + 1 / n2) END"
_GOT = f"""CASE WHEN test = 't' AND effect = 'd' THEN {_D} WHEN test = 't' AND effect = 'g' THEN CASE WHEN n1 + n2 > 2 THEN {_D} * (1 - 3.0 / (4.0 * (n1 + n2 - 2) - 1)) END WHEN test = 't' AND effect = 'dz' THEN CASE WHEN n1 >= 2 THEN value / sqrt(n1) END
  WHEN test = 't' AND effect = 'r' THEN CASE WHEN df1 > 0 THEN value / sqrt(value * value + df1) END WHEN test = 'F' AND effect = 'eta2' THEN CASE WHEN value >= 0 THEN value * df1 / (value * df1 + df2) END WHEN test = 'F' AND effect = 'omega2' THEN CASE WHEN value >= 0 THEN greatest(0.0, (value * df1 - df1) / (value * df1 + df2 + 1)) END WHEN test = 'F' AND effect = 'f' THEN CASE WHEN value >= 0 THEN sqrt(value * df1 / df2) END
  WHEN test = 'chi2' AND effect = 'phi' THEN CASE WHEN n1 > 0 THEN sqrt(value / n1) END WHEN test = 'chi2' AND effect = 'V' THEN CASE WHEN n1 > 0 AND coalesce(m, CASE WHEN df1 = 1 THEN 1 END) > 0 THEN sqrt(value / (n1 * coalesce(m, 1))) END END"""
_ESR = _SIZES + f", esr AS (SELECT paper_id, text_id, test, effect, reported, computed, CASE WHEN computed IS NULL THEN 'SKIP' WHEN abs(reported - computed) <= 0.02 THEN 'PASS' WHEN abs(reported - computed) > 0.10 OR abs(reported - computed) > 0.2 * abs(reported) THEN 'ERROR' ELSE 'WARN' END AS status FROM (SELECT *, round({_GOT}, 6) AS computed FROM (SELECT t.paper_id, t.text_id, t.kind AS test, e.kind AS effect, e.value AS reported, t.value, t.df1, t.df2, z.n1, z.n2, z.m FROM tests t JOIN effects e USING (paper_id, text_id) JOIN sizes z USING (paper_id, text_id))))"


@query(f"{B}, {S.tests()}, {S.effects()}, {_ESR} SELECT * FROM esr")
def es_check_rows(s: SparkSession, d: str) -> DataFrame:
    return C.es_check_rows(s, d).select("paper_id", "text_id", "test", "effect", "reported", "computed", "status")


_MC = lambda lo, hi: f"CASE WHEN greatest(abs(lo - ({lo})), abs(hi - ({hi}))) <= 0.06 THEN 'PASS' WHEN greatest(abs(lo - ({lo})), abs(hi - ({hi}))) > 0.20 THEN 'ERROR' ELSE 'WARN' END"
_Z975 = 1.959963984540054
_TANH = lambda x: f"((exp(2 * ({x})) - 1) / (exp(2 * ({x})) + 1))"
_SE = "sqrt((n1 + n2) / (n1 * n2) + es * es / (2.0 * (n1 + n2 - 2)))"
_CIR = _SIZES + f""", cir AS (SELECT paper_id, text_id, ord, test, test_ord, k, effect, es, level, lo, hi, CASE WHEN hi < lo THEN 'ERROR' WHEN abs((lo + hi) / 2 - es) > greatest(0.05, 0.10 * abs(es)) THEN 'WARN'
  WHEN effect = 'r' AND n1 > 3 AND abs(es) < 1 THEN {_MC(_TANH(f"0.5 * ln((1 + es) / (1 - es)) - {_Z975} / sqrt(n1 - 3)"), _TANH(f"0.5 * ln((1 + es) / (1 - es)) + {_Z975} / sqrt(n1 - 3)"))}
  WHEN effect = 'd' AND n1 > 0 AND n2 > 0 AND n1 + n2 > 2 THEN {_MC(f"es - {_Z975} * {_SE}", f"es + {_Z975} * {_SE}")} ELSE 'PASS' END AS status
  FROM (SELECT paper_id, text_id, ord, try_cast({_CI[0]} AS DOUBLE) / 100 AS level, try_cast({_CI[1]} AS DOUBLE) AS lo, try_cast({_CI[2]} AS DOUBLE) AS hi FROM ({S.exploded(P.CI)}))
  JOIN (SELECT paper_id, text_id, k, kind AS effect, value AS es FROM effects) USING (paper_id, text_id) JOIN sizes USING (paper_id, text_id) LEFT JOIN (SELECT paper_id, text_id, kind AS test, ord AS test_ord FROM tests) USING (paper_id, text_id) WHERE test IS NULL OR k = 0)"""


@query(f"{B}, {S.tests()}, {S.effects()}, {_CIR} SELECT * FROM cir")
def ci_check_rows(s: SparkSession, d: str) -> DataFrame:
    return C.ci_rows(s, d)


_EC = ["es_checked", "es_pass", "es_warn", "es_error", "es_skip"]
query(f"{B}, {S.tests()}, {S.effects()}, {_ESR}, {_CIR[len(_SIZES) + 2:]} " + S.per_paper("SELECT paper_id, count(*) AS es_checked, " + ", ".join(f"count(*) FILTER (WHERE status = '{c[3:].upper()}') AS {c}" for c in _EC[1:]) + " FROM (SELECT paper_id, status FROM esr UNION ALL SELECT paper_id, status FROM cir) GROUP BY 1", _EC, "CASE WHEN es_checked = 0 THEN 'na' WHEN es_error > 0 THEN 'red' WHEN es_warn > 0 THEN 'yellow' ELSE 'green' END"), "es_check")(C.es_check)
query(None, "es_check_inversions")(lambda s, d: C.es_check(s, d, True))
query(None, "es_intervals")(C.es_intervals)
query(S.forensic("mean IS NOT NULL AND n > 0", S.GRIM_BAD, "grim_fail", "red"), "grim_check")(C.grim_check)
query(S.forensic("mean IS NOT NULL AND sd IS NOT NULL AND n > 1", f"NOT abs({S.T2} - round_even({S.T2}, 0)) < 0.5", "grimmer_fail", "red"), "grimmer_check")(C.grimmer_check)
query(S.forensic("mean IS NOT NULL AND sd IS NOT NULL AND n > 1", "NOT floor((n - 1) * pow(sd + 0.005, 2) + n * mean * mean) >= ceil((n - 1) * pow(greatest(0.0, sd - 0.005), 2) + n * mean * mean)", "grimmer_fail", "red"), "grimmer_strict_check")(C.grimmer_strict_check)
query(S.forensic("sd IS NOT NULL AND min IS NOT NULL", "sd > CASE WHEN n IS NULL OR n <= 1 THEN (max - min) / 2 ELSE sqrt(n / (n - 1)) * (max - min) / 2 END", "sd_issues", "red"), "sd_range_check")(C.sd_range_check)
query(S.forensic("sd IS NOT NULL AND n > 1", "sqrt(n) * sd > 10 * sd", "sd_se_suspect", "yellow"), "sd_se_check")(C.sd_se_check)
query(S.forensic("sd IS NOT NULL AND mean >= 0 AND mean <= 1", "NOT (abs(sd - sqrt(mean * (1 - mean))) < 0.02 OR sd <= 0.5)", "debit_issues", "red"), "debit_check")(C.debit_check)
query(f"{B}, {S.tests()} " + S.per_paper(f"SELECT paper_id, count(*) AS tested, count(*) FILTER (WHERE p_computed < p_reported * 0.1) AS stalt_issues FROM (SELECT *, round({S.COMPUTED}, 9) AS p_computed FROM tests WHERE p_comp = '<' AND p_reported IS NOT NULL AND kind IN ('t', 'F')) GROUP BY 1", ["tested", "stalt_issues"], "CASE WHEN tested = 0 THEN 'na' WHEN stalt_issues > 0 THEN 'yellow' ELSE 'green' END"), "stalt_check")(C.stalt_check)
query(f"{B}, {S.PV}, {S.CSF} SELECT paper_id, coalesce(n_pvalues, 0) AS n_pvalues, stouffer_p, fisher_p, CASE WHEN coalesce(n_pvalues, 0) = 0 THEN 'na' WHEN stouffer_p < 0.0001 THEN 'yellow' ELSE 'info' END AS traffic_light FROM papers LEFT JOIN csf USING (paper_id)", "csf_check")(C.csf_check)
_TR = f"""tr AS (SELECT *, row_number() OVER (PARTITION BY paper_id, section_id ORDER BY text_id) AS kk FROM descr JOIN (SELECT DISTINCT paper_id, text_id, section_id FROM sentence) USING (paper_id, text_id) WHERE mean IS NOT NULL AND sd > 0 AND n > 1),
two AS (SELECT a.paper_id, a.section_id, (a.mean - b.mean) / sqrt(a.sd * a.sd / a.n + b.sd * b.sd / b.n) AS t, a.n + b.n - 2 AS df FROM tr a JOIN tr b ON a.paper_id = b.paper_id AND a.section_id IS NOT DISTINCT FROM b.section_id AND a.kk = 1 AND b.kk = 2)"""
query(f"{B}, {S.desc()}, {_TR} SELECT paper_id, section_id, round(t, 6) AS t, df, round({S.t_p('t', 'CAST(df AS DOUBLE)')}, 6) AS p FROM two", "test_recalc")(C.test_recalc)
_PT = "CASE WHEN {0} THEN 'apriori' WHEN {1} THEN 'sensitivity' WHEN {2} THEN 'compromise' WHEN {3} THEN 'posthoc' ELSE 'unknown' END".format(*[S.rx("text", p) for p in (r"\ba priori\b", r"\bsensitivity\b", r"\bcompromise\b", r"\ba posteriori\b|\bpost[- ]hoc\b|\bretrospective\b|\bobserved\b")])
query(f"{B} SELECT paper_id, coalesce(power_n, 0) AS power_n, coalesce(power_types, '') AS power_types, CASE WHEN power_n > 0 THEN 'yellow' ELSE 'na' END AS traffic_light FROM papers LEFT JOIN (SELECT paper_id, count(*) AS power_n, array_to_string(list_sort(list_distinct(list({_PT}))), ';') AS power_types FROM (SELECT paper_id, section_id, paragraph_id, string_agg(text, ' ' ORDER BY text_id) AS text FROM body WHERE text IS NOT NULL GROUP BY 1, 2, 3) WHERE {S.rx('text', P.POWER_WORD)} AND {S.rx('text', P.POWER_TERM)} AND {S.rx('text', P.POWER_NUMBER)} GROUP BY 1) USING (paper_id)", "power")(C.power)
query(f"{B} " + S.per_paper(f"SELECT paper_id, count(DISTINCT text) AS prereg_mentions FROM body WHERE {S.flag('prereg_mention')} GROUP BY 1", ["prereg_mentions"], "CASE WHEN prereg_mentions > 0 THEN 'info' ELSE 'na' END"), "prereg_statement")(C.prereg_statement)
_NS = r"\bn\s*=\s*([0-9]{2,6})"
query(f"{B}, {S.tests()} " + S.per_paper(f"SELECT paper_id, count(*) AS df_checked, count(*) FILTER (WHERE CASE kind WHEN 't' THEN df1 + 2 ELSE df1 + df2 + 2 END > max_n) AS df_inconsistent FROM tests JOIN (SELECT paper_id, max(CAST(n AS INT)) AS max_n FROM (SELECT paper_id, unnest(regexp_extract_all(text, {S.q(_NS)}, 1, 'i')) AS n FROM body) GROUP BY 1) USING (paper_id) WHERE kind IN ('t', 'F') GROUP BY 1", ["df_checked", "df_inconsistent"], "CASE WHEN df_checked = 0 THEN 'na' WHEN df_inconsistent > 0 THEN 'red' ELSE 'green' END"), "df_consistency_check")(C.df_consistency_check)
# affiliations by rule: every publisher of a paper's references stands for one, and funding statements are whatever the sentences say
query(
    f"""{B}, said AS (SELECT paper_id, lower(coalesce(string_agg(CASE WHEN {S.flag('funding')} THEN text END, ' '), '')) AS fund, lower(coalesce(string_agg(CASE WHEN {S.flag('coi')} THEN text END, ' '), '')) AS coi FROM body GROUP BY 1),
aff AS (SELECT paper_id, fund, list_bool_or(list_transform(w, lambda k: contains(fund, k))) AS ov, list_bool_or(list_transform(w, lambda k: contains(coi, k))) AS kn FROM (SELECT DISTINCT paper_id, publisher, list_filter(list_distinct(regexp_extract_all(lower(publisher), '[a-z]{{3,}}', 0)), lambda x: NOT list_contains({S.AFF_STOP}, x)) AS w FROM bib WHERE publisher IS NOT NULL) JOIN said USING (paper_id)) """
    + S.per_paper("SELECT paper_id, count(*) AS affiliations, count(*) FILTER (WHERE fund <> '') AS funded, count(*) FILTER (WHERE ov) AS affiliation_funding_overlap, count(*) FILTER (WHERE ov AND NOT coalesce(kn, false)) AS undisclosed_overlap FROM aff GROUP BY 1", ["affiliations", "funded", "affiliation_funding_overlap", "undisclosed_overlap"], "CASE WHEN affiliations = 0 OR funded = 0 THEN 'na' WHEN affiliation_funding_overlap = 0 THEN 'green' WHEN undisclosed_overlap > 0 THEN 'red' ELSE 'yellow' END", ["affiliation_funding_overlap", "undisclosed_overlap"]),
    "funding_coi_affiliation_check",
)(lambda s, d: C.funding_coi_affiliation_check(s, d, table(s, d, "bib").filter("publisher IS NOT NULL").select("paper_id", F.col("publisher").alias("affiliation"))))
_DS = f"ds AS (SELECT paper_id, arg_min(text, text_id) AS text, count(*) AS n, count(DISTINCT paragraph_id) AS n_paragraphs, array_to_string(list_sort(list_distinct(list(coalesce(section_type, '')))), ';') AS sections FROM (SELECT *, {S.norm('text')} AS nrm FROM body) WHERE len(string_split(nrm, ' ')) >= 12 GROUP BY paper_id, nrm HAVING count(DISTINCT paragraph_id) >= 2)"
query(f"{B}, {_DS} SELECT * FROM ds", "duplicate_sentences")(C.duplicate_sentences)
query(
    f"{B}, {_DS}, par AS (SELECT paper_id, paragraph_id, {_AGG} FROM body WHERE text IS NOT NULL AND paragraph_id IS NOT NULL GROUP BY 1, 2), {S.near('par', 'paper_id', 'paragraph_id', 0.65, 12)} SELECT paper_id, coalesce(e, 0) + coalesce(f, 0) AS duplicate_n, CASE WHEN NOT has_text THEN 'na' WHEN coalesce(e, 0) + coalesce(f, 0) > 0 THEN 'yellow' ELSE 'green' END AS traffic_light FROM (SELECT p.paper_id, e, f, s.paper_id IS NOT NULL AS has_text FROM papers p LEFT JOIN (SELECT paper_id, count(*) AS e FROM ds GROUP BY 1) x USING (paper_id) LEFT JOIN (SELECT g AS paper_id, count(*) AS f FROM near GROUP BY 1) y USING (paper_id) LEFT JOIN (SELECT DISTINCT paper_id FROM body WHERE length(trim(text)) > 0) s ON s.paper_id = p.paper_id)",
    "duplicate_check",
)(C.duplicate_check)


@query(f"WITH {S.near('documents', '0', 'doc_id', 0.8, 1, n=S.LETTERS)} SELECT a AS doc_id_a, b AS doc_id_b, round(sim, 6) AS similarity FROM near")
def near_duplicate_documents(s: SparkSession, d: str) -> DataFrame:
    """Pairs of classes of equal shingles, and of a class's first document with its copies."""
    return C.near_duplicates(table(s, d, "documents").filter("text IS NOT NULL"), None, "doc_id", "text", 5, 0.8, 1, True)


def _hashes(s: SparkSession, d: str) -> DataFrame:
    """Hashes of the vectors of 64 numbers, as of pictures of 8 by 8 cells."""
    return C.image_hashes(table(s, d, "embeddings").filter("embedding IS NOT NULL"), "vec_id", "embedding", 64)


@query(f"WITH {S.HASHES} SELECT * FROM hp")
def image_hash_pairs(s: SparkSession, d: str) -> DataFrame:
    return C.image_pairs(_hashes(s, d), 6, 64)


@query(f"WITH {S.HASHES} SELECT image_n, duplicate_images, CASE WHEN image_n = 0 THEN 'na' WHEN duplicate_images > 0 THEN 'red' ELSE 'green' END AS traffic_light FROM (SELECT (SELECT count(*) FROM hb) AS image_n, (SELECT count(*) FROM (SELECT k_a FROM hp UNION SELECT k_b FROM hp)) AS duplicate_images)")
def image_forensic_check(s: SparkSession, d: str) -> DataFrame:
    return C.image_forensic_check(_hashes(s, d), 6, 64)


# --- references ---


def _dims(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """Tables of DOIs that stand for databases, made from the bibliography by rule."""
    doi = table(s, d, "bib").select(R.doi_key("doi").alias("doi")).distinct()
    return {
        "retraction": doi.filter("doi LIKE '%7'").withColumn("note", F.lit("withdrawn")),
        "miscitation": doi.filter("doi LIKE '%9'").withColumn("warning", F.lit("says the opposite")),
        "comments": doi.filter("doi LIKE '%1'").select("doi", (F.length("doi") % 3).cast("long").alias("total_comments"), F.when(F.col("doi").like("%11"), F.array(F.lit("Statcheck"))).otherwise(F.array(F.lit("Statcheck"), F.lit("A reader"))).alias("users")),
        "replication": doi.filter("doi LIKE '%3'").select(F.col("doi").alias("doi_o"), F.concat(F.expr("left(doi, length(doi) - 1)"), F.lit("5")).alias("doi_r"), F.when(F.col("doi").like("%33"), "failed").otherwise("successful").alias("outcome"), F.lit(None).cast("string").alias("url_r")),
    }


_LK = f"{B}, {S.DIMS}, {S.LOOKUP}"


@query(f"{B} SELECT r.paper_id, bib_id, {S.DOI.replace('doi', 'r.doi')} AS doi, s.text AS sentence FROM refs r LEFT JOIN (SELECT DISTINCT paper_id, text_id, text FROM sentence) s ON r.paper_id = s.paper_id AND r.text_id = s.text_id")
def ref_table(s: SparkSession, d: str) -> DataFrame:
    return R.ref_table(s, d).select("paper_id", "bib_id", "doi", "sentence")


query(f"WITH {S.XREFS} SELECT * FROM xr", "xrefs")(R.xrefs)
query(f"{B}, {S.MENTIONS} SELECT * FROM ment", "citation_mentions")(lambda s, d: R.mentions(Q.text_table(s, d)))
query(f"{B}, {S.MENTIONS}, {S.XREFS}, {S.STATUS} SELECT * FROM cs", "citation_status")(R.citation_status)
query(f"{B}, {S.MENTIONS}, {S.ORPH} SELECT * FROM orph", "ref_orphans")(R.orphans)
query(f"{B}, {S.MENTIONS}, {S.XREFS}, {S.STATUS}, {S.ORPH} " + S.per_paper("SELECT paper_id, coalesce(a, 0) AS n_bib, coalesce(b, 0) AS n_cited, coalesce(c, 0) AS n_uncited, coalesce(o, 0) AS n_orphan FROM (SELECT paper_id, count(*) AS a, count(*) FILTER (WHERE cited) AS b, count(*) FILTER (WHERE NOT cited) AS c FROM cs GROUP BY 1) FULL JOIN (SELECT paper_id, count(*) AS o FROM orph GROUP BY 1) USING (paper_id)", ["n_bib", "n_cited", "n_uncited", "n_orphan"], "CASE WHEN n_bib = 0 THEN 'na' WHEN n_uncited > 0 OR n_orphan > 0 THEN 'red' ELSE 'green' END"), "ref_consistency")(R.ref_consistency)
for _n, _f, _dim, _col, _li in (("ref_retraction", R.ref_retraction, "retraction", "retractionwatch", ("info", "na")), ("ref_miscitation", R.ref_miscitation, "miscitation", "miscite_n", ("yellow", "green"))):
    query(f"{_LK} " + S.per_paper(f"SELECT paper_id, count(*) AS {_col} FROM r JOIN {_dim} USING (doi) GROUP BY 1", [_col], f"CASE WHEN {_col} > 0 THEN '{_li[0]}' ELSE '{_li[1]}' END"), _n)(partial(lambda s, d, f, k: f(s, d, _dims(s, d)[k]), f=_f, k=_dim))
query(f"{_LK} " + S.per_paper("SELECT paper_id, CAST(sum(total_comments) AS BIGINT) AS pubpeer_comments FROM r JOIN comments USING (doi) WHERE total_comments > 0 AND len(list_filter(users, lambda u: u <> 'Statcheck')) > 0 GROUP BY 1", ["pubpeer_comments"], "CASE WHEN pubpeer_comments > 0 THEN 'info' ELSE 'na' END"), "ref_pubpeer")(lambda s, d: R.ref_pubpeer(s, d, _dims(s, d)["comments"]))
query(f"{_LK}, {S.REPL} SELECT * FROM repl", "ref_replication_rows")(lambda s, d: R.replications(s, d, _dims(s, d)["replication"]))
query(f"{_LK}, {S.REPL} " + S.per_paper("SELECT paper_id, count(*) AS replications FROM repl GROUP BY 1", ["replications"], "CASE WHEN replications > 0 THEN 'info' ELSE 'na' END"), "ref_replication")(lambda s, d: R.ref_replication(s, d, _dims(s, d)["replication"]))
def _register(s: SparkSession, d: str) -> DataFrame:
    """Records by DOI that stand for a register's: the first reference to each work, but for works it hasn't heard of."""
    names = F.filter(F.transform(F.split("authors", ";"), T.surname), lambda n: n != "")
    first = Q.references(s, d).select(R.doi_key("doi").alias("doi"), "paper_id", "bib_id", "title", "year", names.alias("authors")).filter("doi IS NOT NULL AND doi NOT LIKE '%4'")
    return first.groupBy("doi").agg(F.min_by(F.struct("title", "year", "authors"), F.struct("paper_id", "bib_id")).alias("r")).select("doi", "r.*")


query(f"{B}, {S.ACC} SELECT * FROM acc", "ref_accuracy_rows")(lambda s, d: R.ref_accuracy_rows(s, d, _register(s, d)))
_RC = ["refs_checked", "no_match", "year_mismatch", "title_mismatch", "author_mismatch"]
query(f"{B}, {S.ACC} " + S.per_paper("SELECT paper_id, count(*) AS refs_checked, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {c}" for c in _RC[1:]) + " FROM acc GROUP BY 1", _RC, "CASE WHEN refs_checked = 0 THEN 'na' WHEN no_match + year_mismatch + title_mismatch + author_mismatch > 0 THEN 'yellow' ELSE 'green' END"), "ref_accuracy")(lambda s, d: R.ref_accuracy(s, d, _register(s, d)))
query(
    f"{_LK}, {S.REPL}, {S.ACC} SELECT paper_id, bib_id, doi, doi IN (SELECT doi FROM retraction) AND doi IS NOT NULL AS retracted, doi IN (SELECT doi FROM miscitation) AND doi IS NOT NULL AS miscited, EXISTS (SELECT 1 FROM repl x WHERE x.paper_id = r.paper_id AND x.bib_id = r.bib_id) AS replicated, EXISTS (SELECT 1 FROM acc x WHERE x.paper_id = r.paper_id AND x.bib_id = r.bib_id AND (no_match OR year_mismatch OR title_mismatch OR author_mismatch)) AS inaccurate, coalesce(o, '') AS outcomes, coalesce(c, 0) AS comments FROM r LEFT JOIN (SELECT paper_id, bib_id, array_to_string(list_sort(list_distinct(list(outcome))), ';') AS o FROM repl GROUP BY 1, 2) USING (paper_id, bib_id) LEFT JOIN (SELECT doi, CAST(sum(total_comments) AS BIGINT) AS c FROM comments GROUP BY 1) USING (doi)",
    "ref_summary",
)(lambda s, d: R.ref_summary(s, d, *[_dims(s, d)[k] for k in ("retraction", "miscitation", "replication")], _register(s, d), _dims(s, d)["comments"]))

# --- overlap ---

_OV = f"{B}, {S.OVER}"
_OS = f"{_OV}, {S.FLAGGED}, {S.SOURCES}"
query(f"{_OV} SELECT * FROM runs", "overlap_runs")(O.runs)
query(f"{_OS} SELECT * FROM sources", "overlap_sources")(O.sources)
query(f"{_OS}, {S.UNION} SELECT * FROM ovl", "overlap_light")(O.union_coverage)
query(f"{B}, {S.FLAGGED} SELECT * FROM flags", "overlap_flags")(O.flags)
query(f"{_OV} SELECT paper_id, source_id, k, array_to_string(list_slice(w, start_word + 1, end_word), ' ') AS manuscript, array_to_string(list_slice(v, source_start + 1, source_start + end_word - start_word), ' ') AS source FROM (SELECT r.*, m.w, l.w AS v, row_number() OVER (PARTITION BY r.paper_id, r.source_id ORDER BY r.text_id, start_word) AS k FROM runs r JOIN ms m USING (paper_id, text_id) JOIN lib l USING (source_id)) WHERE k <= 25", "overlap_passages")(O.passages)
query(f"{_OS}, own AS (SELECT paper_id, text_id, pos, arg_min(source_id, rank) AS source_id FROM (SELECT r.paper_id, r.text_id, s.source_id, s.rank, unnest(range(r.start_word, r.end_word)) AS pos FROM runs r JOIN sources s USING (paper_id, source_id)) GROUP BY 1, 2, 3) SELECT paper_id, text_id, source_id, min(pos) AS start_word, max(pos) + 1 AS end_word FROM (SELECT *, pos - row_number() OVER (PARTITION BY paper_id, text_id, source_id ORDER BY pos) AS isle FROM own) GROUP BY paper_id, text_id, source_id, isle", "overlap_highlights")(O.highlights)
_PH = f"""v AS (SELECT paper_id, text_id, w, list_transform(w, lambda x: CASE WHEN x = '§' OR regexp_full_match(x, '[0-9]+') THEN -100 WHEN length(x) > 3 AND NOT list_contains({S.STOP}, x) THEN 1 ELSE 0 END) AS v FROM ms WHERE len(w) >= 12),
win AS (SELECT paper_id, text_id, w, list_sort(list_filter(list_transform(range(0, len(w) - 8), lambda i: {{'neg': -CAST(list_sum(list_slice(v, i + 1, i + 9)) AS BIGINT), 'pos': i}}), lambda x: x.neg <= -5)) AS win FROM v),
p1 AS (SELECT *, win[1] AS a FROM win WHERE len(win) > 0), p2 AS (SELECT *, list_filter(win, lambda x: abs(x.pos - a.pos) >= 9)[1] AS b FROM p1),
p3 AS (SELECT *, CASE WHEN b IS NULL THEN NULL ELSE list_filter(win, lambda x: abs(x.pos - a.pos) >= 9 AND abs(x.pos - b.pos) >= 9)[1] END AS c FROM p2),
phr AS (SELECT paper_id, text_id, rank, p.pos AS pos, -p.neg AS score, array_to_string(list_slice(w, p.pos + 1, p.pos + 9), ' ') AS phrase FROM (SELECT paper_id, text_id, w, unnest([a, b, c]) AS p, unnest([1, 2, 3]) AS rank FROM p3) WHERE p IS NOT NULL)"""
query(f"{_OV}, {_PH} SELECT * FROM phr", "eligible_phrases")(O.eligible_phrases)
_SEL_P = "sel AS (SELECT paper_id, bucket, text_id, phrase FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, bucket ORDER BY md5('7|' || phrase), text_id, pos) AS f FROM (SELECT *, CAST(floor(k * 20 / greatest(20, total)) AS INT) AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY text_id, pos) - 1 AS k, count(*) OVER (PARTITION BY paper_id) AS total FROM phr))) WHERE f = 1)"
query(f"{_OV}, {_PH}, {_SEL_P} SELECT * FROM sel", "select_phrases")(lambda s, d: O.select_phrases(O.eligible_phrases(s, d), 20, 7))
query(f"{_OV}, {_PH}, gr AS (SELECT DISTINCT source_id, gram AS phrase FROM ({S.grams('lib', 'source_id', 9)})), dfp AS (SELECT phrase, count(*) AS hits FROM gr GROUP BY 1 HAVING count(*) <= 25) SELECT paper_id, source_id, count(*) AS n_phrases, round(sum(1.0 / hits), 6) AS score FROM (SELECT DISTINCT paper_id, phrase FROM phr) JOIN gr USING (phrase) JOIN dfp USING (phrase) GROUP BY 1, 2", "phrase_candidates")(lambda s, d: O.retrieve_candidates(s, d, O.eligible_phrases(s, d)))
_GR = f"gr AS (SELECT DISTINCT source_id, gram AS phrase FROM ({S.grams('lib', 'source_id', 9)})), dfp AS (SELECT phrase, count(*) AS hits FROM gr GROUP BY 1 HAVING count(*) <= 25), cand AS (SELECT paper_id, source_id, count(*) AS n_phrases, round(sum(1.0 / hits), 6) AS score FROM (SELECT DISTINCT paper_id, phrase FROM phr) JOIN gr USING (phrase) JOIN dfp USING (phrase) GROUP BY 1, 2)"
query(f"{_OV}, {_PH}, {_GR} SELECT paper_id, source_id, score, rank, CASE WHEN rank <= 3 AND coalesce(length(text), 0) >= 500 THEN 'compared' ELSE 'unverified' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, source_id) AS rank FROM cand) JOIN source_text USING (source_id)", "candidate_states")(lambda s, d: O.candidate_states(O.retrieve_candidates(s, d, O.eligible_phrases(s, d)), table(s, d, "source_text"), 3))
query(f"{_OV}, {_PH} SELECT paper_id, count(*) FILTER (WHERE r1) AS n_now, count(*) FILTER (WHERE r2) AS n_before, count(*) AS n_either FROM (SELECT paper_id, phrase, bool_or(rank = 1) AS r1, bool_or(rank = 2) AS r2 FROM phr WHERE rank <= 2 GROUP BY 1, 2) GROUP BY 1", "phrase_history")(lambda s, d: (lambda p: O.phrase_history(p.filter("rank = 2"), p.filter("rank = 1")))(O.eligible_phrases(s, d)))

query(f"{_OV}, {_PH} SELECT paper_id, count(*) FILTER (WHERE n) AS words_now, count(*) FILTER (WHERE o) AS words_before, count(*) AS words_either FROM (SELECT paper_id, text_id, word, bool_or(n) AS n, bool_or(o) AS o FROM (SELECT p.paper_id, text_id, h.n, h.o, unnest(range(pos, pos + 9)) AS word FROM phr p JOIN (SELECT paper_id, phrase, bool_or(rank = 1) AS n, bool_or(rank = 2) AS o FROM phr WHERE rank <= 2 GROUP BY 1, 2) h USING (paper_id, phrase)) GROUP BY 1, 2, 3) GROUP BY 1", "phrase_words")(lambda s, d: (lambda p: O.phrase_words(p.filter("rank = 2"), p.filter("rank = 1"), p))(O.eligible_phrases(s, d)))


@query(f"{_OV} SELECT paper_id, text_id, len(w) AS n_tokens, len(list_filter(w, lambda x: x = '§')) AS n_masks FROM ms")
def quote_citation_mask(s: SparkSession, d: str) -> DataFrame:
    return O.manuscripts(s, d).select("paper_id", "text_id", F.size("w").alias("n_tokens"), F.size(F.filter("w", lambda x: x == "§")).alias("n_masks"))


@query(f"{B} SELECT paper_id, flag, string_agg(left(text, 150), '; ' ORDER BY text_id) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, flag ORDER BY text_id) AS k FROM (" + " UNION ALL ".join(f"SELECT paper_id, text_id, text, '{f}' AS flag FROM body WHERE {S.flag(f)}" for f in P.FLAGS) + ")) WHERE k <= 2 GROUP BY 1, 2")
def check_examples(s: SparkSession, d: str) -> DataFrame:
    """The first two sentences of every flag in a paper: a top-k report."""
    hits = C.keyword_hits(s, d).join(Q.sentences(s, d).select("paper_id", "text_id", "text"), ["paper_id", "text_id"])
    k = F.row_number().over(Window.partitionBy("paper_id", "flag").orderBy("text_id"))
    return hits.withColumn("k", k).filter("k <= 2").groupBy("paper_id", "flag").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("text_id", F.substring("text", 1, 150).alias("t")))), lambda x: x["t"]), "; ").alias("examples"))


# --- every rule on sentences made for it ---

_FIXED = [s for k, v in FX.FLAGS.items() for s in v] + FX.STATISTICS + FX.LINKS
_FIX_SQL = "WITH body AS (SELECT 'fixture' AS paper_id, text_id, text FROM (VALUES " + ", ".join(f"({i}, {S.q(t)})" for i, t in enumerate(_FIXED)) + ") v(text_id, text))"


def fixtures(s: SparkSession) -> DataFrame:
    """The made sentences as one paper."""
    return s.createDataFrame([("fixture", i, t) for i, t in enumerate(_FIXED)], "paper_id string, text_id int, text string")


@query(f"{_FIX_SQL} " + " UNION ALL ".join(f"SELECT text_id, '{f}' AS flag FROM body WHERE {S.flag(f)}" for f in P.FLAGS))
def fixture_flags(s: SparkSession, d: str) -> DataFrame:
    """Which flags each made sentence meets."""
    return fixtures(s).withColumn("low", F.lower("text")).select("text_id", F.explode(F.array_compact(F.array(*[F.when(T.flag("text", f, F.col("low")), F.lit(k)) for k, f in P.FLAGS.items()]))).alias("flag"))


query(f"{_FIX_SQL}, {S.tests()} SELECT text_id, kind, ord, df1, df2, value, p_comp, p_reported, round({S.COMPUTED}, 6) AS p_computed FROM tests", "fixture_tests")(
    lambda s, d: Q.tests(fixtures(s)).select("text_id", "kind", "ord", "df1", "df2", "value", "p_comp", "p_reported", F.round(C.computed_p(F.col("kind"), F.col("value"), F.col("df1"), F.col("df2"), False), 6).alias("p_computed"))
)
query(f"{_FIX_SQL}, {S.tests()}, {S.effects()}, {_ESR} SELECT text_id, test, effect, reported, computed, status FROM esr", "fixture_effects")(lambda s, d: C.effect_rows(fixtures(s)).select("text_id", "test", "effect", "reported", "computed", "status"))
query(f"{_FIX_SQL}, {S.tests()}, {S.effects()}, {_CIR} SELECT text_id, ord, test, effect, es, lo, hi, status FROM cir", "fixture_intervals")(lambda s, d: C.interval_rows(fixtures(s)).select("text_id", "ord", "test", "effect", "es", "lo", "hi", "status"))
query(f"{_FIX_SQL}, {S.urls()} SELECT text_id, url, host, kind FROM urls", "fixture_links")(lambda s, d: Q.urls(fixtures(s)).drop("paper_id"))
query(f"{_FIX_SQL}, {S.PV} SELECT text_id, ord, match, p_comp, p_value FROM pv", "fixture_p_values")(lambda s, d: Q.p_values(fixtures(s)).select("text_id", "ord", "match", "p_comp", "p_value"))


# --- verdicts ---

SECTIONS = ["Statistical reporting", "Forensic metascience", "Open science & transparency", "Data & content integrity", "Social science methodology", "Disclosures", "References"]
#: Checks with a light a paper beside the keyword checks, and the section of the report they stand in.
OTHERS = {
    "all_p_values": 0, "stat_p_exact": 0, "stat_p_nonsig": 0, "stat_check": 0, "stat_effect_size": 0, "es_check": 0, "df_consistency_check": 0, "grim_check": 1, "grimmer_check": 1, "sd_range_check": 1, "sd_se_check": 1, "debit_check": 1, "stalt_check": 1,
    "prereg_statement": 2, "power": 0, "overlap_light": 3, "funding_coi_affiliation_check": 5, "ref_consistency": 6, "ref_retraction": 6, "ref_miscitation": 6, "ref_pubpeer": 6, "ref_replication": 6, "ref_accuracy": 6,
    "all_urls": None, "csf_check": 1, "test_recalc": 1, "duplicate_check": 3, "image_forensic_check": 3, "repo_check": 2, "code_check": 2, "prereg_check": 2, "ref_summary": 6,
}


#: Checks whose look-up tables the data doesn't hold: they see the links of the text and empty listings, so that they answer for every paper.
NO_FILES = "url string, path string"
RUNS: dict[str, tuple[Query, str]] = {
    "test_recalc": (lambda s, d: C.lit_by(s, d, C.test_recalc(s, d), "info"), f"{B}, {S.desc()}, {_TR} SELECT paper_id, CASE WHEN c > 0 THEN 'info' ELSE 'na' END AS traffic_light FROM papers LEFT JOIN (SELECT paper_id, count(*) AS c FROM two GROUP BY 1) USING (paper_id)"),
    "image_forensic_check": (lambda s, d: Q.papers(s, d).withColumn("traffic_light", F.lit("na")), f"{B} SELECT paper_id, 'na' AS traffic_light FROM papers"),
    "code_check": (lambda s, d: Q.papers(s, d).withColumn("traffic_light", F.lit("na")), f"{B} SELECT paper_id, 'na' AS traffic_light FROM papers"),
    "repo_check": (lambda s, d: C.or_na(s, d, R.repo_check(Q.urls(Q.text_table(s, d)), s.createDataFrame([], NO_FILES))), f"{B}, {S.urls()} SELECT paper_id, CASE WHEN c > 0 THEN 'green' ELSE 'na' END AS traffic_light FROM papers LEFT JOIN (SELECT paper_id, count(*) AS c FROM urls WHERE kind <> 'other' GROUP BY 1) USING (paper_id)"),
    "prereg_check": (lambda s, d: C.or_na(s, d, R.prereg_check(Q.urls(Q.text_table(s, d)), s.createDataFrame([], "osf_id string, osf_type string"))), f"{B}, {S.urls()} SELECT paper_id, CASE WHEN c > 0 THEN 'info' ELSE 'na' END AS traffic_light FROM papers LEFT JOIN (SELECT paper_id, count(*) AS c FROM urls WHERE kind IN ('osf', 'aspredicted') GROUP BY 1) USING (paper_id)"),
    "ref_summary": (lambda s, d: C.lit_by(s, d, Q.references(s, d), "info"), f"{B} SELECT paper_id, CASE WHEN c > 0 THEN 'info' ELSE 'na' END AS traffic_light FROM papers LEFT JOIN (SELECT paper_id, count(*) AS c FROM refs GROUP BY 1) USING (paper_id)"),
}


def check_run(name: str) -> Query:
    """The check of a name as it runs on every paper."""
    return RUNS[name][0] if name in RUNS else _QUERIES[name]


def verdicts(s: SparkSession, d: str) -> DataFrame:
    """(paper_id, check, traffic_light) of every check on every paper, all over one copy of the text and of what is extracted from it."""
    with Q.sharing(s, d), ThreadPoolExecutor(THREADS) as pool:  # what the checks write down are small jobs that fill the cores together
        first = copy_context()
        keyword = pool.submit(first.run, C.keyword_verdicts, s, d)
        others = [pool.submit(copy_context().run, check_run(n), s, d) for n in OTHERS]
        out = keyword.result()
        for n, x in zip(OTHERS, others):
            out = out.unionByName(x.result().select("paper_id", F.lit(n).alias("check"), "traffic_light"))
    return out


_VS = S.keyword_verdicts() + "".join(f" UNION ALL SELECT paper_id, '{n}' AS \"check\", traffic_light FROM ({RUNS[n][1] if n in RUNS else _SQL[n]})" for n in OTHERS)
query(_VS, "verdict_matrix")(verdicts)


@query(f'SELECT "check", traffic_light, count(*) AS n FROM ({_VS}) GROUP BY 1, 2')
def legend_counts(s: SparkSession, d: str) -> DataFrame:
    return verdicts(s, d).groupBy("check", "traffic_light").agg(F.count(F.lit(1)).alias("n"))


def _catalogue() -> list[tuple[str, str, str | None, int, bool]]:
    online = {"repo_check", "code_check", "prereg_check", "ref_accuracy", "ref_replication", "ref_retraction", "ref_pubpeer"}
    rows = [(n, c.label, c.section) for n, c in P.CHECKS.items()] + [(n, n.replace("_", " "), None if k is None else SECTIONS[k]) for n, k in OTHERS.items()]
    rows.sort(key=lambda r: (SECTIONS.index(r[2]) if r[2] else len(SECTIONS), r[0]))
    return [(n, lab, sec, i, n in online) for i, (n, lab, sec) in enumerate(rows)]


def check_catalog(s: SparkSession, d: str | None = None) -> DataFrame:
    """(check, label, section, ord, online): the catalogue of checks in the order of the report; checks without a section come last."""
    return s.createDataFrame(_catalogue(), "check string, label string, section string, ord int, online boolean")


_CAT = 'cat("check", label, section, ord, online) AS (VALUES ' + ", ".join(f"({S.q(n)}, {S.q(lab)}, {S.q(sec) if sec else 'CAST(NULL AS VARCHAR)'}, {i}, {str(on).lower()})" for n, lab, sec, i, on in _catalogue()) + ")"
query(f"WITH {_CAT} SELECT * FROM cat", "check_catalog")(check_catalog)


@query(f'WITH {_CAT} SELECT v.paper_id, coalesce(c.ord, 10000) AS ord, v."check", coalesce(c.label, v."check") AS label, c.section, v.traffic_light FROM ({_VS}) v LEFT JOIN cat c USING ("check")')
def report_rows(s: SparkSession, d: str) -> DataFrame:
    """The verdicts of all papers with label, section and place in the report."""
    return RP.report_rows(verdicts(s, d), check_catalog(s))


@query()
def report_json(s: SparkSession, d: str) -> DataFrame:
    """One JSON text a paper with its checks in the order of the report."""
    return RP.to_json(RP.report_rows(verdicts(s, d), check_catalog(s)))


for _n in [*P.CHECKS, *OTHERS]:
    runner.register(_n)(check_run(_n))
