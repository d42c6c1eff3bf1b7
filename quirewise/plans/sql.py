"""The queries in SQL for DuckDB, written apart from the DataFrame plans, to compare results with."""

from __future__ import annotations

from quirewise.functions import patterns as P
from quirewise.functions.text import AFFILIATION_STOPWORDS, STOPWORDS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(c: str, p: str, case: bool = False) -> str:
    return f"coalesce(regexp_matches({c}, {q(p)}{'' if case else ', ' + q('i')}), false)"


def flag(name: str) -> str:
    f = P.FLAGS[name]
    one = lambda f: "(" + " AND ".join([rx("text", p) for p in f.every] + ["NOT " + rx("text", p) for p in f.never] + [rx("text", p, True) for p in f.cased] + ["NOT " + rx("text", p, True) for p in f.cased_never]) + ")"
    return "(" + " OR ".join(map(one, f)) + ")" if isinstance(f, tuple) else one(f)


BODY = """WITH body AS (
  SELECT s.*, c.header, c.section_type
  FROM (SELECT DISTINCT paper_id, section_id, paragraph_id, text_id, text, formatted, page_number FROM sentence) s
  LEFT JOIN (SELECT DISTINCT paper_id, section_id, header, section_type FROM section) c USING (paper_id, section_id)
  WHERE coalesce(c.section_type, '') <> 'references'),
papers AS (SELECT paper_id FROM paper UNION SELECT paper_id FROM sentence),
refs AS (SELECT * EXCLUDE (rn, loaded_at) FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, bib_id ORDER BY loaded_at DESC) AS rn FROM bib) WHERE rn = 1)"""


def exploded(p: str, name: str = "match", case: bool = False, frm: str = "body", keep: str = "paper_id, text_id, text") -> str:
    opt = "" if case else ", 'i'"
    return f"SELECT {keep}, unnest(regexp_extract_all(text, {q(p)}, 0{opt})) AS {name}, unnest(range(len(regexp_extract_all(text, {q(p)}, 0{opt})))) AS ord FROM {frm} WHERE {rx('text', p, case)}"


def g(p: str, k: int, case: bool = False, c: str = "match") -> str:
    return f"regexp_extract({c}, {q(p)}, {k}{'' if case else ', ' + q('i')})"


def num(e: str) -> str:
    return f"try_cast(nullif({e}, '') AS DOUBLE)"


PV = f"""pv AS (SELECT paper_id, text_id, ord, text, match, {g(P.P_VALUE, 1)} AS p_comp,
  {num("regexp_replace(" + g(P.P_VALUE, 2) + ", '[ \\t\\n\\r]', '', 'g')")} * pow(10.0, -coalesce(try_cast(nullif(regexp_extract({g(P.P_VALUE, 3)}, '-\\s*([0-9]+)', 1), '') AS INT), 0)) AS p_value
  FROM ({exploded(P.P_VALUE)}))"""

def _poly(x: str, *cs: float) -> str:
    out = repr(cs[-1])
    for c in reversed(cs[:-1]):
        out = f"({out} * {x} + {c!r})"
    return out


# Coefficients of the inverse normal distribution function (algorithm AS 241).
_NEAR = (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727), (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610)
_FAR = (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640), (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-09)
_FARTHEST = (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-05, 2.01033439929228813265e-07), (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 0.000786869131145613259100, 1.84631831751005468180e-05, 1.42151175831644588870e-07, 2.04426310338993978564e-15)
_QUANTILE = f"CASE WHEN abs(u - 0.5) <= 0.425 THEN (u - 0.5) * {_poly('(0.180625 - (u - 0.5) * (u - 0.5))', *_NEAR[0])} / {_poly('(0.180625 - (u - 0.5) * (u - 0.5))', *_NEAR[1])} ELSE sign(u - 0.5) * CASE WHEN r <= 5 THEN {_poly('(r - 1.6)', *_FAR[0])} / {_poly('(r - 1.6)', *_FAR[1])} ELSE {_poly('(r - 5)', *_FARTHEST[0])} / {_poly('(r - 5)', *_FARTHEST[1])} END END"
_UPPER = "CASE WHEN z > 6 THEN 0 ELSE greatest(0.0, 0.5 - exp(-z * z / 2) / sqrt(2 * pi()) * CASE WHEN z = 0 THEN 0 ELSE list_sum(list_transform(range(0, 121), lambda k: exp((2 * k + 1) * ln(z) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1))))) END) END"
CSF = f"""zs AS (SELECT paper_id, p, {_QUANTILE} AS z FROM (SELECT paper_id, p, 1 - p AS u, sqrt(-ln(least(p, 1 - p))) AS r FROM (SELECT paper_id, greatest(1e-12, least(p_value, 1 - 1e-12)) AS p FROM pv WHERE p_value <= 1))),
csf AS (SELECT paper_id, n_pvalues, round(2 * {_UPPER}, 6) AS stouffer_p, round(least(1.0, list_sum(list_transform(range(0, n_pvalues), lambda k: exp(k * ln(x / 2) - x / 2 - lgamma(k + 1))))), 6) AS fisher_p FROM (SELECT paper_id, count(*) AS n_pvalues, abs(sum(z)) / sqrt(count(*)) AS z, -2 * sum(ln(p)) AS x FROM zs GROUP BY 1))"""

_KIND = "CASE WHEN host LIKE '%github.com' THEN 'github' WHEN host LIKE '%osf.io' THEN 'osf' WHEN host LIKE '%zenodo.org' THEN 'zenodo' WHEN host LIKE '%researchbox.org' THEN 'researchbox' WHEN host LIKE '%aspredicted.org' THEN 'aspredicted' ELSE 'other' END"


def urls(frm: str = "body") -> str:
    return f"""urls AS (SELECT paper_id, text_id, url, host, {_KIND} AS kind FROM (SELECT *, lower(regexp_extract(url, '^(?:https?://)?(?:www\\.)?([^/:]+)', 1)) AS host FROM (
  SELECT paper_id, url, arg_min(text_id, text_id * 1000 + ord) AS text_id FROM (SELECT paper_id, text_id, ord, regexp_replace(match, '[.,;:)\\]}}<>]+$', '') AS url FROM ({exploded(P.URL, frm=frm)})) GROUP BY paper_id, url)))"""


def tests() -> str:
    parts = []
    for kind, pattern, value in (("t", P.T_TEST, 2), ("F", P.F_TEST, 3), ("chi2", P.CHI_TEST, 2)):
        case = kind != "chi2"
        full = rf"{pattern}(?:\s*{P.P_NEXT})?"
        x = lambda k, full=full, case=case: g(full, k, case)
        parts.append(
            f"SELECT paper_id, text_id, '{kind}' AS kind, ord, try_cast({x(1)} AS INT) AS df1, {f'try_cast({x(2)} AS INT)' if kind == 'F' else 'CAST(NULL AS INT)'} AS df2, CAST({x(value)} AS DOUBLE) AS value, nullif({x(value + 1)}, '') AS p_comp, {num(x(value + 2))} AS p_reported, text FROM ({exploded(full, case=case)})"
        )
    return "tests AS (" + " UNION ALL ".join(parts) + ")"


def t_p(t: str, v: str) -> str:
    th = f"atan(abs({t}) / sqrt({v}))"
    even = f"sin({th}) * list_sum(list_transform(range(0, CAST({v} AS BIGINT) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) - 0.5 * ln(pi())) * pow(cos({th}), 2 * k)))"
    odd = f"2 / pi() * ({th} + sin({th}) * coalesce(list_sum(list_transform(range(0, (CAST({v} AS BIGINT) - 1) // 2), lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5) + 0.5 * ln(pi()) - ln(2)) * pow(cos({th}), 2 * k + 1))), 0))"
    return f"CASE WHEN {v} IS NULL OR {v} <= 0 THEN NULL ELSE greatest(0.0, 1 - CASE WHEN CAST({v} AS BIGINT) % 2 = 0 THEN {even} ELSE {odd} END) END"


def f_p(f: str, a: str, b: str) -> str:
    x = f"({b} / ({b} + {a} * {f}))"
    th = f"atan(sqrt({a} * {f} / {b}))"
    even1 = f"pow({x}, {b} / 2) * list_sum(list_transform(range(0, CAST({a} AS BIGINT) // 2), lambda k: pow(1 - {x}, k) * exp(lgamma({b} / 2 + k) - lgamma({b} / 2) - lgamma(k + 1))))"
    even2 = f"1 - pow(1 - {x}, {a} / 2) * list_sum(list_transform(range(0, CAST({b} AS BIGINT) // 2), lambda k: pow({x}, k) * exp(lgamma({a} / 2 + k) - lgamma({a} / 2) - lgamma(k + 1))))"
    beta = f"CASE WHEN {a} = 1 THEN 0 ELSE 2 / sqrt(pi()) * exp(lgamma(({b} + 1) / 2) - lgamma({b} / 2)) * sin({th}) * pow(cos({th}), {b}) * list_sum(list_transform(range(0, (CAST({a} AS BIGINT) - 1) // 2), lambda k: pow(sin({th}), 2 * k) * exp(lgamma(({b} + 1) / 2 + k) - lgamma(({b} + 1) / 2) + lgamma(1.5) - lgamma(k + 1.5)))) END"
    p = f"CASE WHEN CAST({a} AS BIGINT) % 2 = 0 THEN {even1} WHEN CAST({b} AS BIGINT) % 2 = 0 THEN {even2} ELSE {t_p(f'sqrt({a} * {f})', b)} + {beta} END"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL OR {a} <= 0 OR {b} <= 0 THEN NULL WHEN {f} <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, {p})) END"


COMPUTED = f"CASE kind WHEN 't' THEN {t_p('value', 'CAST(df1 AS DOUBLE)')} WHEN 'F' THEN {f_p('abs(value)', 'CAST(df1 AS DOUBLE)', 'CAST(df2 AS DOUBLE)')} END"


def desc() -> str:
    x = lambda p, k=1: f"regexp_extract(text, {q(p)}, {k}, 'i')"
    rng = rf"\brang(?:e|ed|ing)\s*(?:=|from|of)?\s*({P.NUMBER})\s*(?:to|-|–)\s*({P.NUMBER})"
    k_of = r"\b([0-9]+)\s+(?:out )?of\s+(?:the\s+)?([0-9]+)\b"
    return f"""descr AS (SELECT * FROM (SELECT paper_id, text_id,
  coalesce({num(x(rf'\bM\s*=\s*({P.NUMBER})'))}, {num(x(rf'\bmeans?\s*(?:=|of|was)\s*({P.NUMBER})'))}) AS mean,
  coalesce({num(x(r'\bSD\s*=\s*([0-9]*\.?[0-9]+)'))}, {num(x(r'\bstandard deviations?\s*(?:=|of|was)\s*([0-9]*\.?[0-9]+)'))}) AS sd,
  try_cast(nullif({x(r'\bn\s*=\s*([0-9]+)')}, '') AS INT) AS n, least({num(x(rng))}, {num(x(rng, 2))}) AS min, greatest({num(x(rng))}, {num(x(rng, 2))}) AS max,
  list_transform(regexp_extract_all(text, {q(r'([0-9]+(?:\.[0-9]+)?)\s*%')}, 1), lambda v: CAST(v AS DOUBLE)) AS percent,
  try_cast(nullif({x(k_of)}, '') AS INT) AS k, try_cast(nullif({x(k_of, 2)}, '') AS INT) AS of_n
  FROM body WHERE regexp_matches(text, '[0-9]')) WHERE coalesce(mean, sd, n, min, k) IS NOT NULL OR len(percent) > 0)"""


def effects() -> str:
    found = lambda k, p: f"regexp_extract_all(text, {q(rf'(?:{p})\s*=\s*({P.NUMBER})')}, 1{'' if k in ('V', 'f', 'g', 'r', 'd') else ', ' + q('i')})"
    parts = [f"SELECT paper_id, text_id, {at} AS place, '{k}' AS kind, unnest(range(len({found(k, p)}))) AS ord, CAST(unnest({found(k, p)}) AS DOUBLE) AS value FROM body" for at, (k, p) in enumerate(P.EFFECTS.items())]
    return "effects AS (SELECT paper_id, text_id, CAST(row_number() OVER (PARTITION BY paper_id, text_id ORDER BY place, ord) - 1 AS INT) AS k, kind, value FROM (" + " UNION ALL ".join(parts) + "))"


def per_paper(counts: str, cols: list[str], light: str, keep: list[str] | None = None, more: str = "") -> str:
    c = ", ".join(f"coalesce({x}, 0) AS {x}" for x in cols)
    k = ", ".join(keep if keep is not None else cols)
    return f"SELECT paper_id, {k}{more}, {light} AS traffic_light FROM (SELECT p.paper_id, {c} FROM papers p LEFT JOIN ({counts}) n USING (paper_id))"


def norm(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


def keyword(name: str) -> str:
    c = P.CHECKS[name]
    cols = [f"n_{f}" for f in c.flags]
    agg = [f"count(*) FILTER (WHERE {flag(f)}) AS n_{f}" for f in c.flags]
    ctes, joins = [BODY], ""
    for e in c.extra:
        cols.append(f"n_{e}")
        if "__" in e:
            a, b = e.split("__")
            agg.append(f"count(*) FILTER (WHERE {flag(a)} AND {flag(b)}) AS n_{e}")
            continue
        sub = {
            "bib": "SELECT paper_id, count(*) AS n_bib FROM refs GROUP BY 1",
            "doi": "SELECT paper_id, count(*) FILTER (WHERE trim(doi) <> '') AS n_doi FROM paper GROUP BY 1",
            "p": "SELECT paper_id, count(*) AS n_p FROM pv GROUP BY 1",
            "prereg_link": "SELECT paper_id, count(*) FILTER (WHERE kind IN ('osf', 'aspredicted')) AS n_prereg_link FROM urls GROUP BY 1",
        }[e]
        ctes += {"p": [PV], "prereg_link": [urls()]}.get(e, [])
        joins += f" LEFT JOIN ({sub}) x_{e} USING (paper_id)"
    counts = f"SELECT * FROM papers LEFT JOIN (SELECT paper_id, {', '.join(agg)} FROM body GROUP BY 1) k USING (paper_id){joins}"
    return ",\n".join(ctes) + f"\nSELECT paper_id, {', '.join(f'{sql} AS {k}' for k, sql in c.columns.items())}, {c.light} AS traffic_light FROM (SELECT paper_id, {', '.join(f'coalesce({x}, 0) AS {x}' for x in cols)} FROM ({counts}))"


def keyword_verdicts() -> str:
    parts = [f"SELECT paper_id, '{n}' AS \"check\", traffic_light FROM ({keyword(n)})" for n in P.CHECKS]
    return " UNION ALL ".join(parts)


def forensic(tested: str, bad: str, column: str, light: str) -> str:
    n = f"SELECT paper_id, count(*) AS tested, count(*) FILTER (WHERE {bad}) AS {column} FROM descr WHERE {tested} GROUP BY 1"
    return f"{BODY}, {desc()} " + per_paper(n, ["tested", column], f"CASE WHEN tested = 0 THEN 'na' WHEN {column} > 0 THEN '{light}' ELSE 'green' END")


GRIM_BAD = "NOT list_bool_or(list_transform(range(CAST(round_even(mean * n, 0) AS BIGINT) - 3, CAST(round_even(mean * n, 0) AS BIGINT) + 4), lambda s: s >= 0 AND round_even(s / n, 2) = round_even(mean, 2)))"
T2 = "((n - 1) * sd * sd + n * mean * mean)"

# tables of DOIs that stand for databases, made from the bibliography by rule
DOI = "nullif(lower(trim(doi)), '')"
DIMS = f"""retraction AS (SELECT DISTINCT {DOI} AS doi, 'withdrawn' AS note FROM bib WHERE {DOI} LIKE '%7'),
miscitation AS (SELECT DISTINCT {DOI} AS doi, 'says the opposite' AS warning FROM bib WHERE {DOI} LIKE '%9'),
comments AS (SELECT DISTINCT {DOI} AS doi, CAST(length({DOI}) AS BIGINT) % 3 AS total_comments, CASE WHEN {DOI} LIKE '%11' THEN ['Statcheck'] ELSE ['Statcheck', 'A reader'] END AS users FROM bib WHERE {DOI} LIKE '%1'),
replication AS (SELECT DISTINCT {DOI} AS doi_o, left({DOI}, -1) || '5' AS doi_r, CASE WHEN {DOI} LIKE '%33' THEN 'failed' ELSE 'successful' END AS outcome, CAST(NULL AS VARCHAR) AS url_r FROM bib WHERE {DOI} LIKE '%3')"""
LOOKUP = f"r AS (SELECT paper_id, bib_id, {DOI} AS doi, title FROM refs)"
REPL = f"repl AS (SELECT r.paper_id, r.bib_id, r.doi, d.doi_r, d.outcome, coalesce(d.url_r, 'https://doi.org/' || d.doi_r) AS link FROM r JOIN replication d ON r.doi = d.doi_o WHERE NOT EXISTS (SELECT 1 FROM r c WHERE c.paper_id = r.paper_id AND c.doi = d.doi_r))"
SURNAME = "lower(CASE WHEN contains(trim({0}), ',') THEN trim(split_part(trim({0}), ',', 1)) ELSE regexp_extract(trim({0}), '([^ ]+)$', 1) END)"
MENTION = r"([A-Z][\p{L}'’-]+)(?: (?:&|and) [A-Z][\p{L}'’-]+| et al\.?)?,? \(?((?:1[6-9]|20)[0-9][0-9])"
MENTIONS = f"ment AS (SELECT paper_id, text_id, lower(regexp_extract(m, {q(MENTION)}, 1)) AS name, CAST(regexp_extract(m, {q(MENTION)}, 2) AS INT) AS year FROM (SELECT paper_id, text_id, unnest(regexp_extract_all(text, {q(MENTION)}, 0)) AS m FROM body))"
XREF = r'<ref type="([a-z]+)"(?: target="([^"]*)")?[^>]*>([^<]*)</ref>'
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def strip(c: str) -> str:
    out = f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    for a, b in ENTITIES:
        out = f"replace({out}, {q(a)}, {q(b)})"
    return f"trim(regexp_replace({out}, '[ \\t\\n\\r]+', ' ', 'g'))"


XREFS = f"xr AS (SELECT * FROM (SELECT paper_id, text_id, ord, regexp_extract(m, {q(XREF)}, 1) AS xref_type, try_cast(nullif(regexp_extract(regexp_extract(m, {q(XREF)}, 2), '([0-9]+)', 1), '') AS INT) AS target, {strip(f'regexp_extract(m, {q(XREF)}, 3)')} AS contents FROM (SELECT paper_id, text_id, unnest(regexp_extract_all(formatted, {q(XREF)}, 0)) AS m, unnest(range(len(regexp_extract_all(formatted, {q(XREF)}, 0)))) AS ord FROM (SELECT DISTINCT paper_id, text_id, formatted FROM sentence) WHERE formatted LIKE '%<ref%')) WHERE xref_type <> 'url')"
STATUS = f"cs AS (SELECT r.paper_id, r.bib_id, (EXISTS (SELECT 1 FROM ment m WHERE m.paper_id = r.paper_id AND m.name = {SURNAME.format('r.a1')} AND m.year = r.year) OR EXISTS (SELECT 1 FROM xr x WHERE x.xref_type = 'bibr' AND x.paper_id = r.paper_id AND x.target = r.bib_id)) AS cited FROM (SELECT *, split_part(authors, ';', 1) AS a1 FROM refs) r)"
ORPH = f"orph AS (SELECT DISTINCT m.paper_id, m.name, m.year FROM ment m WHERE NOT EXISTS (SELECT 1 FROM (SELECT paper_id, year, {SURNAME.format('a')} AS name FROM (SELECT paper_id, year, unnest(string_split(authors, ';')) AS a FROM refs)) n WHERE n.paper_id = m.paper_id AND n.name = m.name AND n.year = m.year))"
_CLEAN = "regexp_replace(trim(regexp_replace(lower(regexp_replace({0}, '<[^>]+>|[-‐‑–—−]+', ' ', 'g')), '[ \\t\\n\\r]+', ' ', 'g')), '\\.+$', '')"
_NAMES = f"list_filter(list_transform(string_split(authors, ';'), lambda n: {SURNAME.format('n')}), lambda n: n <> '')"
ACC = f"""reg AS (SELECT doi, title, year, names FROM (SELECT {DOI} AS doi, title, year, {_NAMES} AS names, row_number() OVER (PARTITION BY {DOI} ORDER BY paper_id, bib_id) AS k FROM refs) WHERE k = 1 AND doi IS NOT NULL AND doi NOT LIKE '%4'),
acc AS (SELECT b.paper_id, b.bib_id, b.doi, reg.doi IS NULL AS no_match, coalesce(b.year <> reg.year, false) AS year_mismatch, coalesce(b.c <> '' AND {_CLEAN.format('reg.title')} <> '' AND NOT (starts_with(b.c, {_CLEAN.format('reg.title')}) OR starts_with({_CLEAN.format('reg.title')}, b.c)), false) AS title_mismatch,
  coalesce(len(b.ns) > 0 AND len(reg.names) > 0 AND NOT list_bool_and(list_transform(reg.names, lambda t: list_bool_or(list_transform(b.ns, lambda n: contains(n, t))))), false) AS author_mismatch
  FROM (SELECT paper_id, bib_id, {DOI} AS doi, year, {_CLEAN.format('title')} AS c, {_NAMES} AS ns FROM refs WHERE {DOI} IS NOT NULL) b LEFT JOIN reg ON reg.doi = b.doi)"""

# overlap
QUOTED, CITED = r"[“\"][^“”\"]{25,700}[”\"]", r"\([^()]{0,200}(?:1[6-9]|20)[0-9][0-9][a-z]?[^()]{0,200}\)"


def word_list(c: str) -> str:
    return f"regexp_extract_all(lower(regexp_replace(regexp_replace({c}, {q(QUOTED)}, ' § ', 'g'), {q(CITED)}, ' § ', 'g')), {q('§|[' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+(?:[' + chr(39) + '’][' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+)?')}, 0)"


def grams(frm: str, keys: str, k: int) -> str:
    return f"SELECT {keys}, pos, array_to_string(x, ' ') AS gram FROM (SELECT {keys}, unnest(range(0, len(w) - {k - 1})) AS pos, unnest(list_transform(range(0, len(w) - {k - 1}), lambda i: list_slice(w, i + 1, i + {k}))) AS x FROM {frm} WHERE len(w) >= {k}) WHERE NOT list_contains(x, '§')"


OVER = f"""ms AS (SELECT paper_id, text_id, {word_list('text')} AS w FROM body WHERE coalesce(section_type, '') NOT IN ('figure', 'table') AND length(trim(text)) > 0),
lib AS (SELECT source_id, {word_list('text')} AS w FROM source_text WHERE text IS NOT NULL),
hit AS (SELECT m.paper_id, m.text_id, s.source_id, m.pos, s.spos FROM ({grams('ms', 'paper_id, text_id', 6)}) m JOIN (SELECT gram, source_id, min(pos) AS spos FROM ({grams('lib', 'source_id', 6)}) GROUP BY 1, 2) s USING (gram)),
isle AS (SELECT *, sum(CASE WHEN pos - before <= 6 THEN 0 ELSE 1 END) OVER (PARTITION BY paper_id, text_id, source_id ORDER BY pos) AS isle FROM (SELECT *, lag(pos) OVER (PARTITION BY paper_id, text_id, source_id ORDER BY pos) AS before FROM hit)),
runs AS (SELECT paper_id, text_id, source_id, min(pos) AS start_word, max(pos) + 6 AS end_word, arg_min(spos, pos) AS source_start FROM isle GROUP BY paper_id, text_id, source_id, isle HAVING max(pos) + 6 - min(pos) >= 8),
scored AS (SELECT paper_id, CAST(sum(len(list_filter(w, lambda x: x <> '§'))) AS BIGINT) AS n_scored FROM ms GROUP BY 1)"""
STOP = "[" + ", ".join(map(q, STOPWORDS)) + "]"


def content(c: str) -> str:
    w = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)?"
    return f"list_filter(list_distinct(regexp_extract_all(lower({c}), {q(w)}, 0)), lambda x: NOT list_contains({STOP}, x))"


FLAGGED = f"""src AS (SELECT source_id, {DOI} AS doi, {norm('title')} AS t, title, kind FROM source_text),
pap AS (SELECT DISTINCT paper_id, {DOI} AS pdoi, title AS ptitle FROM paper),
pt AS (SELECT *, {content('ptitle')} AS a FROM pap), st AS (SELECT *, {content('title')} AS b FROM src),
same AS (SELECT paper_id, source_id FROM pap JOIN src ON pdoi = doi UNION SELECT paper_id, source_id FROM pt JOIN st ON len(list_intersect(a, b)) > 0 AND len(list_intersect(a, b)) >= 0.7 * (len(a) + len(b) - len(list_intersect(a, b)))),
cit AS (SELECT paper_id, source_id FROM refs JOIN src ON nullif(lower(trim(refs.doi)), '') = src.doi UNION SELECT paper_id, source_id FROM (SELECT DISTINCT paper_id, {norm('title')} AS rt FROM refs) x JOIN src ON contains(' ' || rt || ' ', ' ' || left(t, 80) || CASE WHEN length(t) > 80 THEN '' ELSE ' ' END) WHERE length(left(t, 80)) > 20),
flags AS (SELECT paper_id, source_id, same.paper_id IS NOT NULL AS same_work, cit.paper_id IS NOT NULL AS cited FROM same FULL JOIN cit USING (paper_id, source_id) WHERE source_id IN (SELECT source_id FROM src WHERE kind IN ('online', 'library')))"""
FLAGGED = FLAGGED.replace("same.paper_id IS NOT NULL", "s1 IS NOT NULL").replace("cit.paper_id IS NOT NULL", "c1 IS NOT NULL").replace("FROM same FULL JOIN cit", "FROM (SELECT *, 1 AS s1 FROM same) FULL JOIN (SELECT *, 1 AS c1 FROM cit)")
SOURCES = """sources AS (SELECT paper_id, source_id, matched_words, n_runs, coverage, same_work, cited, row_number() OVER (PARTITION BY paper_id ORDER BY coverage DESC, source_id) AS rank,
  CASE WHEN same_work THEN 'na' WHEN coverage < 0.05 THEN 'green' WHEN coverage < 0.15 THEN 'yellow' ELSE 'red' END AS light
  FROM (SELECT r.paper_id, r.source_id, matched_words, n_runs, round(matched_words / n_scored, 6) AS coverage, coalesce(same_work, false) AS same_work, coalesce(cited, false) AS cited
  FROM (SELECT paper_id, source_id, CAST(sum(end_word - start_word) AS BIGINT) AS matched_words, count(*) AS n_runs FROM runs GROUP BY 1, 2) r JOIN scored USING (paper_id) LEFT JOIN flags USING (paper_id, source_id)))"""
UNION = """wp AS (SELECT paper_id, text_id, pos, bool_and(cited) AS only_cited FROM (SELECT r.paper_id, r.text_id, s.cited, unnest(range(r.start_word, r.end_word)) AS pos FROM runs r JOIN sources s USING (paper_id, source_id) WHERE NOT s.same_work) GROUP BY 1, 2, 3),
per AS (SELECT paper_id, count(*) AS covered, count(*) FILTER (WHERE NOT only_cited) AS covered_uncited FROM wp GROUP BY 1),
top AS (SELECT paper_id, max(coverage) AS top FROM sources WHERE NOT same_work GROUP BY 1),
uni AS (SELECT paper_id, n_scored, coalesce(covered, 0) AS covered, coalesce(covered_uncited, 0) AS covered_uncited, coalesce(top, 0) AS top, CASE WHEN n_scored > 0 THEN round(coalesce(covered, 0) / n_scored, 6) ELSE 0 END AS score, CASE WHEN n_scored > 0 THEN round(coalesce(covered_uncited, 0) / n_scored, 6) ELSE 0 END AS score_uncited FROM scored LEFT JOIN per USING (paper_id) LEFT JOIN top USING (paper_id)),
ovl AS (SELECT paper_id, coalesce(n_scored, 0) AS n_scored, coalesce(covered, 0) AS covered, coalesce(covered_uncited, 0) AS covered_uncited, coalesce(top, 0) AS top, coalesce(score, 0) AS score, coalesce(score_uncited, 0) AS score_uncited, CASE WHEN (SELECT count(*) FROM lib) = 0 THEN 'na' WHEN score >= 0.15 OR top >= 0.15 THEN 'red' WHEN score >= 0.05 OR top >= 0.08 THEN 'yellow' ELSE 'green' END AS traffic_light FROM papers LEFT JOIN uni USING (paper_id))"""
AFF_STOP = "[" + ", ".join(map(q, AFFILIATION_STOPWORDS)) + "]"


LETTERS = "trim(regexp_replace(regexp_replace(replace(lower(text), 'ς', 'σ'), '([\\p{Han}\\p{Hiragana}\\p{Katakana}\\p{Thai}])', ' \\1 ', 'g'), '[^\\p{L}\\p{N}\\p{M}]+', ' ', 'g'))"


def near(frm: str, group: str, item: str, least: float, least_words: int, k: int = 5, n: str | None = None) -> str:
    """CTE ``near``: pairs of classes of equal normalised texts by Jaccard of their shingles, and of a class's first item with the others."""
    return f"""nb AS (SELECT {group} AS g, {item} AS i, {n or norm('text')} AS n FROM {frm} WHERE text IS NOT NULL),
nc AS (SELECT g, n, min(i) AS i, list_filter(string_split(n, ' '), lambda x: x <> '') AS w FROM nb WHERE n <> '' AND len(string_split(n, ' ')) >= {least_words} GROUP BY g, n),
nsh AS (SELECT DISTINCT g, i, unnest(list_transform(range(1, greatest(len(w) - {k - 1}, 1) + 1), lambda j: array_to_string(list_slice(w, j, j + {k - 1}), ' '))) AS s FROM nc),
nn AS (SELECT g, i, count(*) AS m FROM nsh GROUP BY 1, 2),
np AS (SELECT a.g, a.i, b.i AS j, count(*) AS c FROM nsh a JOIN nsh b ON a.g = b.g AND a.s = b.s AND a.i < b.i GROUP BY 1, 2, 3),
near AS (SELECT np.g, np.i AS a, np.j AS b, c / (x.m + y.m - c) AS sim FROM np JOIN nn x ON x.g = np.g AND x.i = np.i JOIN nn y ON y.g = np.g AND y.i = np.j WHERE c / (x.m + y.m - c) >= {least}
  UNION ALL SELECT DISTINCT nb.g, nc.i, nb.i, 1.0 FROM nb JOIN nc ON nb.g = nc.g AND nb.n = nc.n WHERE nb.i <> nc.i)"""


HASHES = """hb AS (SELECT vec_id AS k, list_transform(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda x: x >= list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE))) / len(embedding)) AS b FROM embeddings WHERE embedding IS NOT NULL),
hc AS (SELECT b, min(k) AS k FROM hb GROUP BY 1),
hp AS (SELECT x.k AS k_a, y.k AS k_b, len(list_filter(range(1, 65), lambda i: x.b[i] <> y.b[i])) AS distance FROM hc x JOIN hc y ON x.k < y.k WHERE len(list_filter(range(1, 65), lambda i: x.b[i] <> y.b[i])) <= 6
  UNION ALL SELECT hc.k, hb.k, 0 FROM hb JOIN hc USING (b) WHERE hb.k <> hc.k)"""
