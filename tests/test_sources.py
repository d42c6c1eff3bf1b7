"""TEI ingest and library files."""

import zipfile

from quirewise.sources import files as FS
from quirewise.sources import tei

TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>A Title</title></titleStmt><sourceDesc><biblStruct><analytic>
<author role="corresp"><persName><forename>Ana</forename><surname>Souza</surname></persName><email>a@b.c</email><affiliation>Lab of Things</affiliation><idno type="ORCID">0000</idno></author><author><affiliation>none</affiliation></author>
</analytic><idno type="DOI">10.1/x</idno></biblStruct></sourceDesc></fileDesc><encodingDesc><appInfo><application ident="G"/></appInfo></encodingDesc><profileDesc><textClass><keywords><term>one</term><term> </term></keywords></textClass>
<abstract><p>We did it. It worked.</p></abstract></profileDesc></teiHeader><text><body><div><head>1. Introduction</head><p>See p. 12 of J. Smith. Now <ref type="bibr" target="#b0">(Doe, 2001. A note)</ref> ends. Next one &amp; more.</p>
<div><head>Aims</head><p>Inner text.</p></div></div><div><head>Methods</head><p>Done.</p></div><figure type="table"><head>T1</head><figDesc>Table text.</figDesc></figure><note place="foot">A note.</note></body>
<back><div type="funding"><div><p>Paid by X.</p></div></div><div type="references"><listBibl><biblStruct><analytic><title level="a">Work</title><author><persName><forename>Jo</forename><surname>Doe</surname></persName></author></analytic><monogr><title level="j">Journal</title><imprint><date when="2001-05"/><biblScope unit="page" from="1" to="9"/><biblScope unit="volume">3</biblScope></imprint></monogr></biblStruct>
<biblStruct><monogr><title level="m">Book</title><imprint><date>1999b</date></imprint></monogr></biblStruct></listBibl></div></back></text></TEI>"""


def _xml(spark):
    return spark.createDataFrame([("p", TEI), ("bad", "<TEI><x>"), ("null", None)], "paper_id string, xml string")


def test_header(spark):
    r = tei.info(tei.well_formed(_xml(spark))).collect()
    assert len(r) == 1 and r[0].title == "A Title" and r[0].keywords == ["one"] and r[0].doi == "10.1/x" and r[0].input_format == "G"
    a = tei.parsed(_xml(spark), "author").collect()
    assert len(a) == 1 and a[0].family == "Souza" and a[0].corresponding and a[0].orcid == "0000"


def test_sentences(spark):
    sec, s = tei.sections_and_sentences(_xml(spark))
    rows = s.orderBy("text_id").collect()
    assert [r.text for r in rows] == ["We did it.", "It worked.", "See p. 12 of J. Smith.", "Now (Doe, 2001. A note) ends.", "Next one & more.", "Inner text.", "Done.", "Paid by X.", "Table text.", "A note."]
    assert '<ref type="bibr" target="#b0">' in rows[3].formatted and [r.text_id for r in rows] == list(range(1, 11))
    kinds = {r.header: r.section_type for r in sec.collect()}
    assert kinds["Abstract"] == "abstract" and kinds["1. Introduction"] == "intro" and kinds["Aims"] == "intro" and kinds["Methods"] == "method"


def test_references(spark):
    b = {r.bib_id: r for r in tei.parsed(_xml(spark), "bib").collect()}
    assert b[1].bib_type == "article" and b[1].authors == "Doe, Jo" and (b[1].first_page, b[1].last_page, b[1].volume, b[1].year) == ("1", "9", "3", 2001)
    assert b[2].bib_type == "book" and b[2].year == 1999 and b[2].year_suffix == "b" and b[2].title == "Book"
    sec, s = tei.sections_and_sentences(_xml(spark))
    s2, sec2 = tei.with_references(s, sec, tei.parsed(_xml(spark), "bib"))
    assert s2.count() == 12 and s2.agg({"text_id": "max"}).first()[0] == 12 and sec2.filter("section_type = 'references'").count() == 1


def test_all_tables_of_a_paper(spark):
    xml = TEI.replace("Done.</p>", 'Done, see <ref type="url" target="https://osf.io/ab123.">the plan</ref> and d = 0.30 here.</p>')
    t = tei.read_paper(spark.createDataFrame([("p", xml), ("bad", "<TEI><x>"), ("null", None)], "paper_id string, xml string"))
    assert [tuple(r) for r in t["url"].select("paper_id", "href", "link_text").collect()] == [("p", "https://osf.io/ab123", "the plan")]
    assert [tuple(r)[:2] for r in t["table"].collect()] == [("p", 1)] and t["figure"].count() == 0 and t["text"].count() == 12 and t["info"].count() == 1 and t["bib"].count() == 2
    assert {r.xref_type for r in t["xref"].collect()} == {"bibr"} and [(r.lhs, r.rhs) for r in t["eq"].collect()] == [("d", "0.30")]


def test_tei_files(spark, tmp_path):
    (tmp_path / "x.tei.xml").write_text(TEI)
    r = tei.read_tei(spark, str(tmp_path)).first()
    assert r.paper_id == "x" and r.file_hash == tei.content_id(TEI.encode())


def test_library_and_cache(spark, tmp_path):
    lib = tmp_path / "lib"
    lib.mkdir()
    (lib / "a.html").write_text("<html><title>T &amp; U</title><body>One <b>two</b></body></html>")
    (lib / "b.txt").write_text("plain 10.1234/abc text")
    (lib / "skip.bin").write_bytes(b"x")
    with zipfile.ZipFile(lib / "c.docx", "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p ><w:t xml:space='preserve'>World</w:t></w:p></w:document>")
    files = FS.list_library(spark, str(lib))
    got = {r.path.rsplit("/", 1)[1]: r for r in FS.texts(files).collect()}
    assert got["a.html"].title == "T & U" and "One two" in got["a.html"].text and got["b.txt"].doi == "10.1234/abc" and got["c.docx"].text == "Hello\nWorld" and len(got) == 3
    cache = str(tmp_path / "cache")
    assert FS.refresh(spark, files, cache).count() == 3 and FS.refresh(spark, files, cache).count() == 3
    assert spark.read.parquet(cache).count() == 3


def test_dimensions_and_logs(spark, tmp_path):
    (tmp_path / "r.csv").write_text("doi,note\n 10.1/A ,x\n10.1/a,x\n,y\n")
    rows = FS.dimension(spark, str(tmp_path / "r.csv"), FS.SCHEMAS["retraction"]).collect()
    assert {(r.doi, r.note) for r in rows} == {("10.1/a", "x"), (None, "y")}
    assert FS.dimension(spark, None, FS.SCHEMAS["osf"]).count() == 0
    m = spark.createDataFrame([("d", '{"title":["A"],"issued":{"date-parts":[[2001,2]]},"author":[{"family":"Doe"}]}'), ("e", None)], "doi string, message string")
    got = {r.doi: r for r in FS.registry_fields(m).collect()}
    assert got["d"].year == 2001 and got["d"].authors == ["doe"] and got["e"].title is None
    log = str(tmp_path / "log")
    assert FS.read_phrase_log(spark, log).count() == 0
    FS.write_phrase_log(spark.createDataFrame([("p", "x y")], "paper_id string, phrase string"), log, "r1", 1)
    assert FS.read_phrase_log(spark, log).first().phrase == "x y"
