"""TEI files to tables. Element paths are evaluated in the JVM (xpath functions ignore namespaces); paragraphs keep their mark-up.

Every reader takes a DataFrame (paper_id, xml) and gives one table for all papers. Papers of malformed XML give no row.
"""

from __future__ import annotations

import hashlib
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirewise.functions import text as T

HOLD, CUT = "\ue000", "\ue001"  # private-use characters that hold a blank, and that cut


def read_tei(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """(paper_id, xml, file_hash): files below a folder; the paper's id is the file's stem."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return raw.select(F.regexp_extract("path", r"([^/]+?)(?:\.tei)?\.xml$", 1).alias("paper_id"), F.decode("content", "UTF-8").alias("xml"), F.substring(F.md5("content"), 1, 16).alias("file_hash"))


def well_formed(xml: DataFrame) -> DataFrame:
    """Papers whose XML can be read; entity declarations aren't accepted."""

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[[_parse(x) is not None for x in f["xml"]]]

    return xml.mapInPandas(keep, xml.schema)


def _parse(xml: str | None) -> ET.Element | None:
    if not xml or "<!ENTITY" in xml:
        return None
    try:
        return ET.fromstring(xml.encode())
    except ET.ParseError:
        return None


def info(xml: DataFrame) -> DataFrame:
    """(paper_id, title, keywords, doi, input_format): scalars of the header, null where missing."""
    one = lambda p: F.nullif(F.trim(F.xpath_string("xml", F.lit(p))), F.lit(""))
    return xml.select(
        "paper_id", one("/TEI/teiHeader/fileDesc/titleStmt/title[1]").alias("title"), F.filter(F.transform(F.xpath("xml", F.lit("//keywords//term/text()")), lambda x: F.trim(x)), lambda x: x != "").alias("keywords"), one("//teiHeader//idno[@type='DOI'][1]").alias("doi"), one("//appInfo/application/@ident").alias("input_format")
    )


_TABLES = {
    "author": "paper_id string, author_id int, given string, family string, affiliation string, email string, corresponding boolean, orcid string, role array<string>",
    "paragraph": "paper_id string, ord int, header string, back_type string, formatted string",
    "bib": "paper_id string, bib_id int, bib_type string, title string, authors string, editors string, container string, year int, year_suffix string, doi string, volume string, issue string, first_page string, last_page string, publisher string, raw string",
}


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _all(e: ET.Element, *path: str) -> list[ET.Element]:
    found = [e]
    for name in path:
        found = [x for f in found for x in f.iter() if x is not f and _local(x) == name]
    return found


def _text(e: ET.Element | None) -> str | None:
    t = re.sub(r"\s+", " ", "".join(e.itertext())).strip() if e is not None else ""
    return t or None


def _first(e: ET.Element, *path: str) -> ET.Element | None:
    got = _all(e, *path)
    return got[0] if got else None


def _markup(e: ET.Element) -> str:
    s = ET.tostring(e, encoding="unicode")
    s = re.sub(r'\sxmlns(:\w+)?="[^"]*"', "", s)
    return re.sub(r"<(/?)\w+:", r"<\1", s).strip()


def _name(p: ET.Element) -> str:
    given = " ".join(t for f in _all(p, "forename") if (t := _text(f)))
    family = _text(_first(p, "surname")) or ""
    return ", ".join(x for x in (family, given) if x)


def _authors(pid: str, root: ET.Element) -> Iterator[tuple]:
    n = 0
    for a in _all(root, "sourceDesc", "author"):
        person = _first(a, "persName")
        if person is None:
            continue
        n += 1
        orcid = next((_text(i) for i in _all(a, "idno") if (i.get("type") or "").upper() == "ORCID"), None)
        given = " ".join(t for f in _all(person, "forename") if (t := _text(f))) or None
        yield pid, n, given, _text(_first(person, "surname")), _text(_first(a, "affiliation")), _text(_first(a, "email")), a.get("role") == "corresp", orcid, [r for r in [_text(x) for x in _all(a, "roleName")] if r]


def _paragraphs(pid: str, root: ET.Element) -> Iterator[tuple]:
    """Abstract, body, typed back matter, figure descriptions, foot notes, in this order; a paragraph belongs to its innermost div."""
    out: list[tuple[str | None, str | None, ET.Element]] = []

    def divs(e: ET.Element, kind: str | None) -> None:
        head = next((_text(c) for c in e if _local(c) == "head"), None)
        ps = [c for c in e if _local(c) == "p"]
        inner = [c for c in e if _local(c) == "div"]
        if ps:
            out.extend((head, kind, p) for p in ps)
        elif not inner and _local(e) == "div":
            out.append((head, kind, e))
        for c in inner:
            divs(c, kind if kind is None else (c.get("type") or kind))

    for a in _all(root, "abstract"):
        found = _all(a, "p") or [a]
        out.extend(("Abstract", "abstract", p) for p in found)
    for b in _all(root, "text", "body"):
        divs(b, None)
    for b in _all(root, "back"):
        for c in b:
            if _local(c) == "div" and (c.get("type") or "references") != "references":
                divs(c, c.get("type"))
    for f in _all(root, "figure"):
        if (desc := _first(f, "figDesc")) is not None:
            out.append((_text(_first(f, "head")), "table" if f.get("type") == "table" else "figure", desc))
    for n in _all(root, "note"):
        if n.get("place") == "foot":
            out.append((None, "foot", n))
    k = 0
    for head, kind, e in out:
        if _text(e):
            k += 1
            yield pid, k, head, kind, _markup(e)


def _bib(pid: str, root: ET.Element) -> Iterator[tuple]:
    for k, b in enumerate([x for lb in _all(root, "listBibl") for x in lb if _local(x) == "biblStruct"], 1):
        analytic, monogr = _first(b, "analytic"), _first(b, "monogr")
        title_of = lambda e, level: next((_text(t) for t in _all(e, "title") if level is None or t.get("level") == level), None) if e is not None else None
        title, journal, book = title_of(analytic, None), title_of(monogr, "j"), title_of(monogr, "m")
        kind = "article" if journal else "incollection" if book and title else "book" if book else "misc"
        people = [n for a in _all(analytic if analytic is not None and _all(analytic, "author") else b, "author") if (p := _first(a, "persName")) is not None and (n := _name(p))]
        editors = [n for a in _all(b, "editor") if (n := _name(a) or _text(a))]
        raw = next((_text(n) for n in _all(b, "note") if n.get("type") == "raw_reference"), None) or _text(b)
        when = next((d.get("when") or _text(d) for d in _all(b, "date")), None) or raw or ""
        year = re.search(r"([12]\d{3})([a-z]?)", when)
        scope = {s.get("unit"): s for s in _all(b, "biblScope")}
        page = scope.get("page")
        first, last = (page.get("from"), page.get("to")) if page is not None else (None, None)
        if page is not None and not first and (t := _text(page)):
            first, _, last = (x.strip() or None for x in t.replace("–", "-").partition("-"))
        doi = next((_text(i) for i in _all(b, "idno") if (i.get("type") or "").upper() == "DOI"), None)
        yield pid, k, kind, title or book, "; ".join(people) or None, "; ".join(editors) or None, journal or (book if title else None), int(year[1]) if year else None, (year[2] or None) if year else None, doi, _text(scope.get("volume")), _text(scope.get("issue")), first, last, _text(_first(b, "publisher")), raw


_READERS = {"author": _authors, "paragraph": _paragraphs, "bib": _bib}


def parsed(xml: DataFrame, name: str) -> DataFrame:
    """The table ``author``, ``paragraph`` or ``bib`` of all papers; nested mark-up is beyond what path functions can return in order."""
    reader, schema = _READERS[name], _TABLES[name]
    columns = [c.strip().split(" ")[0] for c in re.split(r",\s*(?![^<]*>)", schema)]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [r for pid, x in zip(f["paper_id"], f["xml"]) if (root := _parse(x)) is not None for r in reader(pid, root)]
            yield pd.DataFrame(got, columns=columns).astype({c: "Int64" for c in columns if c in ("author_id", "ord", "bib_id", "year")})

    return xml.select("paper_id", "xml").mapInPandas(rows, schema)


def split_formatted(formatted):
    """Sentences of marked-up text, as an array of mark-up: split behind . ! ? before a capital or digit, never inside a <ref>,
    nor behind "p." before a number or behind an initial."""
    held = F.regexp_replace(formatted, r"\b(pp?|[A-Z])\.\s+(?=[A-Z0-9])", f"$1.{HOLD}")
    held = F.regexp_replace(held, r"^\s*<(p|ab|div|figDesc|note)[^>]*>|</(p|ab|div|figDesc|note)>\s*$", "")
    parts = F.regexp_extract_all(held, F.lit(r"(?s)<ref[^>]*>.*?</ref>|[^<]+|<[^>]*>"), F.lit(0))
    safe = F.array_join(F.transform(parts, lambda x: F.when(x.startswith("<ref"), x).otherwise(F.regexp_replace(x, r"(?<=[.!?])\s+(?=[A-Z0-9])", CUT))), "")
    return F.filter(F.transform(F.split(safe, CUT), lambda x: F.trim(F.replace(x, F.lit(HOLD), F.lit(" ")))), lambda x: x != "")


def sections_and_sentences(xml: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables section and sentence: sections numbered in reading order, types by header and carried on, sentences numbered over the paper."""
    par = parsed(xml, "paragraph").withColumn("type0", F.coalesce("back_type", T.section_type(F.col("header"))))
    w = Window.partitionBy("paper_id").orderBy("ord")
    change = (~F.col("header").eqNullSafe(F.lag("header").over(w)) | ~F.col("back_type").eqNullSafe(F.lag("back_type").over(w)) | (F.col("ord") == 1)).cast("int")
    par = par.withColumn("section_id", F.sum(change).over(w).cast("int"))
    par = par.withColumn("section_type", F.last("type0", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sec = par.groupBy("paper_id", "section_id").agg(F.first("header").alias("header"), F.min("section_type").alias("section_type"))
    s = par.select("paper_id", "section_id", F.col("ord").alias("paragraph_id"), F.posexplode(split_formatted(F.col("formatted"))).alias("k", "formatted"))
    text = T.strip_tags(F.regexp_replace("formatted", "</?(ref|hi|emph|formula)[^>]*>", ""))
    ids = F.row_number().over(Window.partitionBy("paper_id").orderBy("paragraph_id", "k")).cast("int")
    return sec, s.select("paper_id", "section_id", "paragraph_id", ids.alias("text_id"), text.alias("text"), "formatted")


def with_references(sentence: DataFrame, section: DataFrame, bib: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sentences and sections with the reference list appended: one sentence an entry in a section of its own, ids continued."""
    last = sentence.groupBy("paper_id").agg(F.max("text_id").alias("t"), F.max("section_id").alias("s"), F.max("paragraph_id").alias("p"))
    refs = bib.join(last, "paper_id", "left").fillna(0, ["t", "s", "p"]).filter("raw IS NOT NULL")
    more = refs.select("paper_id", (F.col("s") + 1).alias("section_id"), (F.col("p") + F.col("bib_id")).alias("paragraph_id"), (F.col("t") + F.col("bib_id")).alias("text_id"), F.col("raw").alias("text"), F.lit(None).cast("string").alias("formatted"))
    head = refs.select("paper_id", (F.col("s") + 1).alias("section_id"), F.lit("References").alias("header"), F.lit("references").alias("section_type")).distinct()
    return sentence.unionByName(more), section.unionByName(head)


def urls(sentence: DataFrame) -> DataFrame:
    """(paper_id, text_id, href, link_text): addresses in the mark-up of sentences, without the full stop at their end."""
    rx = r'<ref\b(?=[^>]*\btype="url")[^>]*>[^<]*</ref>'
    x = sentence.filter(F.col("formatted").contains('"url"')).select("paper_id", "text_id", F.explode(F.regexp_extract_all("formatted", F.lit(rx), F.lit(0))).alias("m"))
    href = F.regexp_replace(F.trim(F.regexp_extract("m", r'\btarget="([^"]*)"', 1)), r"\.+$", "")
    return x.select("paper_id", "text_id", href.alias("href"), T.strip_tags(F.col("m")).alias("link_text"))


def listed(section: DataFrame, kind: str) -> DataFrame:
    """(paper_id, <kind>_id, section_id): the sections that are figures or tables, numbered in each paper."""
    w = Window.partitionBy("paper_id").orderBy("section_id")
    return section.filter(F.col("section_type") == kind).select("paper_id", F.row_number().over(w).alias(f"{kind}_id"), "section_id")


def read_paper(xml: DataFrame) -> dict[str, DataFrame]:
    """All tables of all papers of a DataFrame (paper_id, xml): info, author, section, text (with the reference list), bib, xref, url, figure,
    table and eq; papers of malformed XML have no rows."""
    from quirewise.operators import refs
    from quirewise.operators import search as Q

    good, bib = well_formed(xml.select("paper_id", "xml")), parsed(xml, "bib")
    section, text = sections_and_sentences(xml)
    text_, section_ = with_references(text, section, bib)
    return {"info": info(good), "author": parsed(xml, "author"), "section": section_, "text": text_, "bib": bib, "xref": refs.xrefs_of(text), "url": urls(text), "figure": listed(section, "figure"), "table": listed(section, "table"), "eq": Q.equations(text)}


def content_id(content: bytes) -> str:
    """The 16 hexadecimal digits that name a file's content."""
    return hashlib.md5(content).hexdigest()[:16]
