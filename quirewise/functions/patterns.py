"""The vocabulary of the checks as data.

Patterns keep to what Java and RE2 read alike: no lookaround, no backreference, ``\\b`` between ASCII words, case ignored.
``java`` spells ``\\b`` out, as Java's own also stops at letters beyond ASCII.
"""

from __future__ import annotations

from dataclasses import dataclass, field

_BEFORE, _BEHIND = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


_EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def java(pattern: str, ignore_case: bool = True) -> str:
    """The pattern as Spark needs it: each ``\\b`` as an edge between ASCII words. Where a plain letter stands beside it one look suffices,
    next to anything optional, a class or a group both sides are looked at."""
    parts = pattern.split(r"\b")
    out = parts[0]
    for p in parts[1:]:
        last, follows, after = out[-1:], p[:1], p[1:2]
        plain = last.isascii() and last.isalnum() and out[-2:-1] != "\\"
        opens = follows.isascii() and follows.isalnum() and after not in ("?", "*", "{")
        out += (_BEHIND if plain else _BEFORE if opens else _EDGE) + p
    return ("(?i)" if ignore_case else "") + out


def stems(pattern: str, least: int = 3) -> list[str] | None:
    """Literals of which a matching text must hold one in small letters: the longest of each alternative; null if one has none."""
    found, runs, run, depth, i = [], [], "", 0, 0
    while True:
        c = pattern[i] if i < len(pattern) else None
        if depth == 0 and c in (None, "|"):
            best = max([*runs, run], key=len)
            if len(best) < least:
                return None
            found.append(best.lower())
            runs, run = [], ""
            if c is None:
                return sorted(set(found))
        elif c == "\\":
            runs, run, i = [*runs, run], "", i + 1
        elif c == "[":
            runs, run, i = [*runs, run], "", pattern.index("]", i + 2)
        elif c == "{":
            runs, run, i = [*runs, run[:-1]], "", pattern.index("}", i)
        elif c in "()":
            runs, run, depth = [*runs, run], "", depth + (1 if c == "(" else -1)
        elif c in "?*":
            runs, run = [*runs, run[:-1]], ""
        elif c in "+.^$":
            runs, run = [*runs, run], ""
        elif depth == 0:
            run += c
        i += 1


@dataclass(frozen=True)
class Flag:
    """A sentence predicate: all of ``every`` match and none of ``never``; ``cased`` patterns mind the case."""

    every: tuple[str, ...]
    never: tuple[str, ...] = ()
    cased: tuple[str, ...] = ()
    cased_never: tuple[str, ...] = ()


def _f(*every: str, never: tuple[str, ...] = (), cased: tuple[str, ...] = (), cased_never: tuple[str, ...] = ()) -> Flag:
    return Flag(every, never, cased, cased_never)


# Comparison signs of reported statistics.
COMPARATORS = "=<>~≈≠≤≥≪≫"
P_VALUE = rf"\bp(?:-value|-values)?\s*([{COMPARATORS}]{{1,2}})\s*(n\.?\s?s\.?|[0-9]*\.[0-9]+|[01]\b)(\s*e\s*-\s*[0-9]+|\s*[x*]\s*10\s*\^\s*-\s*[0-9]+)?"
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
T_TEST = rf"\bt\s*\(\s*([0-9]+)\s*\)\s*=\s*({NUMBER})"
F_TEST = rf"\bF\s*\(\s*([0-9]+)\s*,\s*([0-9]+)\s*\)\s*=\s*({NUMBER})"
CHI_TEST = rf"(?:[χΧ]|\bchi|\bchi-squared|\bchisq)\s*[2²]?\s*\(\s*([0-9]+)\s*\)\s*=\s*({NUMBER})"
P_NEXT = r"[,;]?\s*p\s*([<=>~])\s*([0-9]*\.[0-9]+)"
CI = rf"([0-9]{{2}}(?:\.[0-9])?)\s*%?\s*(?:CI|confidence interval)[^\[(\n]{{0,20}}[\[(]?\s*({NUMBER})\s*[,;]\s*({NUMBER})\s*[\])]?"
# Effect sizes by the signs they are reported with.
EFFECTS = {
    "d": r"\b(?:cohen'?s? )?d",
    "g": r"\b(?:hedges'?s? )?g",
    "dz": r"\bdz",
    "r": r"\br",
    "eta2": r"(?:η|\beta)(?:p)?(?:2|²| squared|-squared)",
    "omega2": r"(?:ω|\bomega)(?:2|²| squared|-squared)",
    "f": r"\b(?:cohen'?s? )?f",
    "phi": r"(?:φ|\bphi)",
    "V": r"\b(?:cramer'?s? )?V",
}
EQUATION = rf"[a-zA-Zα-ωΑ-Ω²][a-zA-Z0-9α-ωΑ-Ω²_.-]*\s*(?:\([^)\n]*\))?\s*[{COMPARATORS}]{{1,2}}\s*(?:[+-]?[0-9]*\.?[0-9]+|\[[^\]\n]+\]|n\.?\s?s\.?)"
URL = r"(?:https?://|www\.)[^\s<>\"')\]}]+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|org|net|edu|io|gov|info|xyz|app|dev|link|online|site|eu|de|uk)(?:/[^\s<>\"')\]}]*)?"
CITATION = r"\(([^()]*[A-Z][^()]*,? (?:1[6-9]|20)[0-9][0-9][a-z]?[^()]*)\)"

_SIG = r"\bsignifican"
# The vocabulary of the checks; a tuple of flags holds where one of them does.
FLAGS: dict[str, Flag | tuple[Flag, ...]] = {
    "marginal": _f(rf"(?:\bmargin[a-z]*(?: +[a-z]+){{0,5}}|\btrend[a-z]*(?: +[a-z]+){{0,1}}|\balmost(?: +[a-z]+){{0,2}}|\bapproach[a-z]*(?: +[a-z]+){{0,2}}|\bborder[a-z]*(?: +[a-z]+){{0,2}}|\bclose to(?: +[a-z]+){{0,2}}) +{_SIG[2:]}"),
    "coi": (
        _f(r"competing financial interest|declaration of interest|duality of interest"),
        _f(r"conflicts? of interest|competing interests?", r"author|interests?[.:;,]|disclosed|reported|mentioned|declared|communicated|revealed|divulged|aired|voiced|expressed|no[^\n]{0,20}(?:conflict|competing)"),
        _f(r"conflicts? of interest|competing interests?", cased=(r"Conflict|CONFLICT|Compet|COMPET",)),
        _f(r"disclosure", r"\binterests?\b", never=(r"financial disclosure|conflicts? of interest|competing interests?",)),
        _f(r"disclosure", cased=(r"Disclos|DISCLOS|No|NO|Nil|NIL|Author[^\n]{0,2} [dD]isclo",), never=(r"financial disclosure|conflicts? of interest|competing interests?",)),
    ),
    "funding": _f(r"\bfunder|\bfunded\b|\bfunding\b|\bfinanc|\bsupported by\b|\bgrant|\bsponsor|\backnowledg", r"\bworks?\b|\bstud(?:y|ies)\b|\bresearch\b|\bmanuscript\b|\bproject\b|\bpaper\b|\barticle\b|\bauthor|\bthank", never=(r"\b(?:no|without|not) (?:[a-z]+ )?(?:fund|support|grant)",)),
    "data_sentence": _f(r"\bdata(?:sets?)?\b", r"\bavailab|\bsupplement|\barchive|\baccess|\bshared?\b|\bonline\b|\bfound\b|\bfind\b|\bdetailed\b|\bsee\b|https?:|\brepositor|\bosf\b|open science framework|researchbox|zenodo|github|figshare|datadryad|kaggle|mendeley|dataverse|ourworldindata"),
    "data_request": _f(r"\bdata(?:sets?)?\b", r"\b(?:on|upon) (?:reasonable )?request"),
    "prereg": _f(r"\bpre-?registered\b|\bpre-?registration|\bregistered\b", never=(r"\bnot pre-?registered",)),
    "prereg_mention": _f(r"\bpre-?registered\b|\bpre-?registration|\bregistered\b"),
    "causal": _f(r"\bcaus(?:e|es|ed|ing)\b|\b(?:lead|leads|led|leading) to\b|\bresult(?:s|ed)? in\b|\bimpact(?:s|ed)? on\b|\beffect of\b[^\n]{1,40}\bon\b|\bincreases?\b|\bdecreases?\b|\bimprov(?:e|es|ed|ing)\b|\breduc(?:e|es|ed|ing)\b"),
    "design_marker": _f(r"\brandomly assigned\b|\brandom assignment\b|\brandomi[sz]ed\b|\bRCT\b|\bwere manipulated\b|\bexperimental (?:condition|group|manipulation)|\bcontrol(?:led)? condition|\b(?:between|within)-subjects? design|\bquasi-experimental\b|\binstrumental variable"),
    "scale": _f(r"\bscales?\b|\bquestionnaires?\b|\binventor(?:y|ies)\b|\bsubscales?\b"),
    "reliability": _f(r"\bcronbach|\bmcdonald'?s? omega|[ωα]\s*=|\binternal consistency\b|\btest-retest\b|\bsplit-half\b|\binter-item\b|\bICC\s*=|\bintraclass correlation"),
    "ethics": _f(r"\binstitutional review board\b|\bIRB\b|\bethics committee\b|\bethic(?:s|al) approval\b|\bapproved by the\b[^\n]{0,40}ethics|\bdeclaration of helsinki\b|\binformed consent\b"),
    "age": _f(r"\bmean age\b|\bage range\b|\bM age\b|\bage = [0-9]|\baged [^\n]{0,12}years"),
    "gender": _f(r"[0-9]\s*%? (?:were )?(?:female|male|women|men)\b|\bgender identit|\bsex: [0-9]"),
    "origin": _f(r"\brecruited (?:in|from)\b|\bnationalit|\bcountry of residence\b|\bsample (?:was|were) recruited\b|\bparticipants (?:were|was) from\b"),
    "multiplicity": _f(r"\bbonferroni\b|\bholm\b|\bfalse discovery rate\b|\bFDR\b|\bbenjamini|\bmultiple compar[a-z]* (?:correction|adjustment)|\bcorrected for multiple\b|\balpha (?:level )?(?:was )?adjusted\b"),
    "exclusion": _f(r"\bexcluded\b|\bexclusions?\b|\bexcludes\b"),
    "exclusion_reason": _f(r"\bexcluded\b|\bexclusions?\b|\bexcludes\b", r"\bbecause\b|\bdue to\b|\bowing to\b|\bas a result of\b|\bfor failing\b|\bfailed (?:to|an|the)\b|\bdid not (?:complete|pass|meet|finish)\b|\bcriteri(?:a|on)\b|\boutlier|\battention check|\bincomplete\b|\bmissing data\b|\btechnical (?:error|issue)|\bwithdrew\b|\bineligible\b|\bpre-?registered\b"),
    "likert": _f(r"\b[0-9]-point (?:likert|ordinal|rating)|\blikert(?:[- ]type)? (?:scale|item)|\bordinal (?:scale|data|variable)"),
    "parametric": _f(r"\b(?:independent|paired|one-sample)[a-z -]*t-tests?\b|\bANOVA\b|\banalysis of variance\b|\bpearson\b|\blinear regression\b"),
    "ordinal_reason": _f(r"\btreated as (?:continuous|interval)\b|\brobust(?:ness)? (?:to|of) (?:violations|ordinal)|\bnon-?parametric\b|\bmann-whitney\b|\bwilcoxon\b|\bkruskal-wallis\b|\bspearman\b|\bordinal (?:logistic|regression)\b|\bas if (?:continuous|interval)\b"),
    "coding": _f(r"\bcoded by\b|\bindependent(?:ly)? (?:coded|rated)\b|\btwo raters\b|\bcoders?\b|\braters?\b|\bcontent analysis\b"),
    "agreement": _f(r"\bcohen'?s? kappa\b|\bkappa\s*=|κ\s*=|\bintraclass correlation|\bICC\s*=|\bpercent(?:age)? agreement\b|\binter-?(?:rater|coder) (?:reliability|agreement)"),
    "confirmatory": _f(r"\bas (?:predicted|expected|hypothesi[sz]ed)\b|\bconsistent with (?:our|the) hypothes|\bconfirm[a-z]* (?:our|the) hypothes|\bsupport[a-z]* (?:our|the) hypothes|\bin line with (?:our|the) (?:hypothes|prediction)"),
    "survey": _f(r"\bsurveys?\b|\bquestionnaires?\b", never=(r"\bquestionnaires? items\b",)),
    "response_rate": _f(r"\bresponse rate\b|% of (?:invitees|those invited)[^\n]{0,30}completed"),
    "panel": _f(r"\bMTurk\b|\bmechanical turk\b|\bprolific\b|\bcloudresearch\b|\bqualtrics panel\b|\b(?:online|survey) panel\b"),
    "panel_quality": _f(r"\battention checks?\b|\bcatch trials?\b|\binstructional manipulation check|\bIMC\b|\bbot detection\b|\bduplicate (?:IP|response)|\bcaptcha\b|\bscreening question"),
    "missing": _f(r"\bmissing (?:data|values?)\b|\battrition\b|\bdrop-?out\b|\bdid not complete\b|\bincomplete responses?\b"),
    "missing_handled": _f(r"\b(?:listwise|pairwise) deletion\b|\b(?:multiple|mean) imputation\b|\bFIML\b|\bfull information maximum likelihood\b|\bMICE\b|\bcomplete-case analysis\b|\bexpectation-maximi[sz]ation\b"),
    "r_ethics": _f(r"ethic|IRB|institutional review|approval|consent"),
    "r_credit": _f(r"credit|author contribution|contribution statement"),
    "r_coi": _f(r"conflict of interest|competing interest"),
    "r_funding": _f(r"funding|supported by|grant|funded"),
    "r_prereg": _f(r"pre-?regist|aspredicted|osf\.io"),
    "r_protocol": _f(r"protocol|preregistered analysis plan|pre-?analysis plan"),
    "r_materials": _f(r"materials? (?:are|available|at)|osf\.io|zenodo|github"),
    "r_data": _f(r"data (?:are|available|at)|data availability|dataset|osf\.io|zenodo"),
    "r_code": _f(r"code (?:is|are|available|at)|analytic code|replication package|github"),
    "r_preprint": _f(r"preprint|psyarxiv|arxiv|pre-print"),
    "r_model": _f(r"\b(?:ChatGPT|OpenAI|Claude|Gemini|Bard|Copilot|Qwen|Ollama|Mistral|Llama|DeepSeek|Grok|Perplexity|Midjourney|DALL[- ]?E|Opus|Sonnet|Haiku|GPT[- ]?[0-9]?|LLM|LLMs)\b|large language model|generative AI|artificial intelligence|AI[- ]?(?:tool|assistant|chatbot|generated|assisted|usage|model)"),
    "r_impact": _f(r"social impact"),
}
POWER_WORD, POWER_TERM, POWER_NUMBER = r"\bpower(?:ed|s)?\b", r"\beffect size|\bsample size|\ba priori\b|\ba posteriori\b|\bpost[- ]hoc\b|\bsensitivity\b|\bstatistical power\b|\bto detect\b|\bachieve|\bobserved power\b", r"(?:^|[^0-9])(?:[0-9]{1,3}|[013-9][0-9]{3}|2[1-9][0-9]{2})(?:[^0-9]|$)"


@dataclass(frozen=True)
class Check:
    """A check on a paper: summary columns and the traffic light as SQL over the counts ``n_<flag>`` of its sentences."""

    flags: tuple[str, ...]
    columns: dict[str, str]
    light: str
    label: str
    section: str = "Social science methodology"
    extra: tuple[str, ...] = field(default=())


def _light(*cases: tuple[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in cases) + f" ELSE '{other}' END"


R_ITEMS = ["r_ethics", "r_credit", "r_coi", "r_funding", "r_prereg", "r_protocol", "r_materials", "r_data", "r_code", "r_preprint", "r_model", "r_impact"]
_R_SUM = " + ".join(f"CAST(n_{f} > 0 AS INT)" for f in R_ITEMS) + " + CAST(n_bib > 0 AS INT) + CAST(n_doi > 0 AS INT)"
CHECKS: dict[str, Check] = {
    "marginal": Check(("marginal",), {"marginal": "n_marginal"}, _light(("n_marginal > 0", "red"), other="green"), "Marginal significance", "Statistical reporting"),
    "coi_check": Check(("coi",), {"coi_found": "CAST(n_coi > 0 AS INT)"}, _light(("n_coi > 0", "green"), other="red"), "Conflict of interest", "Disclosures"),
    "funding_check": Check(("funding",), {"funding_found": "CAST(n_funding > 0 AS INT)"}, _light(("n_funding > 0", "green"), other="red"), "Funding", "Disclosures"),
    "open_practices": Check(("data_sentence", "data_request"), {"data_open": "CAST(n_data_sentence > n_data_sentence__data_request AS INT)", "on_request": "n_data_request", "n_statements": "n_data_sentence"}, _light(("n_data_sentence > n_data_sentence__data_request", "green"), ("n_data_request > 0", "yellow"), other="red"), "Open practices", "Open science & transparency", ("data_sentence__data_request",)),
    "causal_language_check": Check(("causal", "design_marker"), {"causal_n": "n_causal", "design_marker_found": "CAST(n_design_marker > 0 AS INT)"}, _light(("n_causal = 0", "na"), ("n_design_marker > 0", "green"), other="yellow"), "Causal language"),
    "reliability_check": Check(("scale", "reliability"), {"scale_mentions": "n_scale", "reliability_statements": "n_reliability"}, _light(("n_scale = 0", "na"), ("n_reliability > 0", "green"), other="yellow"), "Reliability"),
    "irb_ethics_check": Check(("ethics",), {"ethics_found": "CAST(n_ethics > 0 AS INT)"}, _light(("n_ethics > 0", "green"), other="red"), "Ethics approval", "Disclosures"),
    "demographics_check": Check(("age", "gender", "origin"), {"demographics_reported": "CAST(n_age > 0 AS INT) + CAST(n_gender > 0 AS INT) + CAST(n_origin > 0 AS INT)", "demographics_missing": "3 - (CAST(n_age > 0 AS INT) + CAST(n_gender > 0 AS INT) + CAST(n_origin > 0 AS INT))"}, _light(("n_age > 0 AND n_gender > 0 AND n_origin > 0", "green"), ("n_age = 0 AND n_gender = 0 AND n_origin = 0", "red"), other="yellow"), "Demographics"),
    "exclusion_reporting_check": Check(("exclusion", "exclusion_reason"), {"exclusion_statements": "n_exclusion", "unjustified_exclusions": "n_exclusion - n_exclusion_reason"}, _light(("n_exclusion = 0", "na"), ("n_exclusion = n_exclusion_reason", "green"), other="yellow"), "Exclusions"),
    "likert_parametric_check": Check(("likert", "parametric", "ordinal_reason"), {"parametric_tests_on_ordinal": "CASE WHEN n_likert > 0 THEN n_parametric ELSE 0 END", "justification_found": "CAST(n_ordinal_reason > 0 AS INT)"}, _light(("n_likert = 0 OR n_parametric = 0", "na"), ("n_ordinal_reason > 0", "green"), other="yellow"), "Parametric tests on ordinal data"),
    "interrater_reliability_check": Check(("coding", "agreement"), {"coding_mentions": "n_coding", "reliability_reported": "CAST(n_agreement > 0 AS INT)"}, _light(("n_coding = 0", "na"), ("n_agreement > 0", "green"), other="yellow"), "Agreement of raters"),
    "response_rate_check": Check(("survey", "response_rate", "panel", "panel_quality"), {"survey_checks": "CAST(n_survey > 0 AS INT) + CAST(n_panel > 0 AS INT)", "survey_missing": "CAST(n_survey > 0 AND n_response_rate = 0 AS INT) + CAST(n_panel > 0 AND n_panel_quality = 0 AS INT)"}, _light(("n_survey = 0 AND n_panel = 0", "na"), ("(n_survey = 0 OR n_response_rate > 0) AND (n_panel = 0 OR n_panel_quality > 0)", "green"), other="yellow"), "Survey response"),
    "missing_data_check": Check(("missing", "missing_handled"), {"missing_data_mentions": "n_missing", "handling_method_found": "CAST(n_missing_handled > 0 AS INT)"}, _light(("n_missing = 0", "na"), ("n_missing_handled > 0", "green"), other="yellow"), "Missing data"),
    "r2_check": Check(tuple(R_ITEMS), {"r2_checks": "14", "r2_passed": _R_SUM}, _light((f"{_R_SUM} = 14", "green"), other="yellow"), "Editorial checklist", "Open science & transparency", ("bib", "doi")),
    "harking_check": Check(("confirmatory",), {"confirmatory_statements": "n_confirmatory", "preregistration_found": "CAST(n_prereg_link > 0 AS INT)"}, _light(("n_confirmatory = 0", "na"), ("n_prereg_link > 0", "green"), other="yellow"), "Confirmatory claims", "Social science methodology", ("prereg_link",)),
    "multiple_comparisons_check": Check(("multiplicity",), {"p_value_n": "n_p", "correction_mentioned": "CAST(n_multiplicity > 0 AS INT)"}, _light(("n_p < 5", "na"), ("n_multiplicity > 0", "green"), other="yellow"), "Multiple comparisons", "Social science methodology", ("p",)),
}
