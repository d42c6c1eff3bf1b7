"""Text functions as Column expressions; nulls give null unless a line says otherwise."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewise.functions.patterns import Flag, java, stems
from quirewise.functions.stats import let

# Words without weight in titles and phrases.
STOPWORDS = """a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing
down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now
of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under
until up very was we were what when where which while who whom why will with would you your et al fig table""".split()
# Words that don't identify an affiliation.
AFFILIATION_STOPWORDS = """university of the department institute hospital school college center centre faculty and for medical national laboratory research group inc ltd
gmbh corporation company science sciences""".split()


def matches(c: Column | str, pattern: str, ignore_case: bool = True) -> Column:
    return (F.col(c) if isinstance(c, str) else c).rlike(java(pattern, ignore_case))


def flag(c: Column | str, f: Flag | tuple[Flag, ...], low: Column | None = None) -> Column:
    """Whether a sentence meets a flag, or one of several; false for null. With ``low``, the text in small letters, literals are looked for first:
    a byte search decides nearly every sentence, and the regular expression only runs on the rest."""

    if isinstance(f, tuple):
        some = flag(c, f[0], low)
        for g in f[1:]:
            some = some | flag(c, g, low)
        return some

    def fits(p: str) -> Column:
        words = stems(p) if low is not None else None
        if not words:
            return matches(c, p)
        some = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            some = some | F.contains(low, F.lit(w))
        return some & matches(c, p)

    parts = [fits(p) for p in f.every] + [~fits(p) for p in f.never] + [matches(c, p, False) for p in f.cased] + [~matches(c, p, False) for p in f.cased_never]
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return F.coalesce(out, F.lit(False))


def split_sentences(c: Column) -> Column:
    """Split behind . ! ? before a capital or digit; trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])[ \t\n\f\r]+(?=[A-Z0-9])"), lambda x: F.regexp_replace(x, r"^[ \t\n\f\r]+|[ \t\n\f\r]+$", "")), lambda x: x != "")


def normalise(c: Column) -> Column:
    """Small letters, everything but a-z, 0-9 and blanks turned into a blank, blanks squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "), " +", " "))


def words(c: Column) -> Column:
    """Words of letters and digits, with one inner apostrophe."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)?"), F.lit(0))


def tokens(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, word, start_pos, end_pos): the words of a text as they stand, with their places in characters; texts without words have no
    row. The places come out of one pass over each text, in Arrow batches: array functions would copy what they have so far at every word."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
        for batch in batches:
            got = [(i, k, m.group(), m.start(), m.end()) for i, t in enumerate(batch.column(1).to_pylist()) if t for k, m in enumerate(word.finditer(t))]
            columns = list(zip(*got)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.int32())], [key, "pos", "word", "start_pos", "end_pos"])

    return rows.select(key, text).mapInArrow(cut, f"`{key}` {rows.schema[key].dataType.simpleString()}, pos int, word string, start_pos int, end_pos int")


def na_replace(summary: DataFrame, papers: DataFrame, values: dict[str, object]) -> DataFrame:
    """A summary with a row for every paper: columns of papers without one take the values given, 0 or "" by default."""
    kinds = dict(summary.dtypes)
    fill = {c: values.get(c, "" if kinds[c] == "string" else 0) for c in summary.columns if c != "paper_id"}
    return papers.select("paper_id").join(summary, "paper_id", "left").fillna({c: v for c, v in fill.items() if v is not None})


def normalise_letters(c: Column) -> Column:
    """Small letters and digits of all scripts, everything else a blank; each sign of scripts without blanks stands alone."""
    low = F.replace(F.lower(c), F.lit("ς"), F.lit("σ"))
    apart = F.regexp_replace(low, r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}])", " $1 ")
    return F.trim(F.regexp_replace(apart, r"[^\p{L}\p{N}\p{M}]+", " "))


def shingles(c: Column, k: int = 5) -> Column:
    """Set of k-grams of a normalised text; a shorter text is its own shingle, an empty one has none."""
    return word_shingles(normalise(c), k)


def word_shingles(c: Column, k: int = 5) -> Column:
    """The same of a text that is normalised."""

    def of_words(w: Column) -> Column:
        long = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " ")))
        return F.when(F.size(w) >= k, long).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return let(F.filter(F.split(c, " "), lambda x: x != ""), of_words)


def shingle_codes(c: Column, k: int = 5) -> Column:
    """Sorted hashes of the k-grams of a normalised text; a shorter text is its own shingle, an empty one has none."""

    def of_words(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (k - 1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(k))))

    return let(F.filter(F.split(c, " "), lambda x: x != ""), lambda w: F.when(F.size(w) > 0, F.array_sort(F.array_distinct(of_words(w)))).otherwise(F.array().cast("array<bigint>")))


def jaccard(a: Column, b: Column) -> Column:
    """Shared by all members of two sets; 0 when either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def content_words(c: Column) -> Column:
    """Distinct words that aren't stop words."""
    return F.array_except(F.array_distinct(words(c)), F.array(*map(F.lit, STOPWORDS)))


def title_similarity(a: Column, b: Column) -> Column:
    return jaccard(content_words(a), content_words(b))


def strip_tags(c: Column) -> Column:
    """Text of marked-up text: tags become blanks, the five entities are read, blanks squeezed."""
    out = F.regexp_replace(c, "<[^>]+>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"[ \t\n\r]+", " "))


def html_to_text(c: Column) -> Column:
    """Visible text of a page: scripts, styles and comments are dropped first."""
    for p in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->"):
        c = F.regexp_replace(c, p, " ")
    return strip_tags(c)


def section_type(header: Column) -> Column:
    """Type of a section by the first keyword its header holds, blanks ignored."""
    h = F.lower(F.regexp_replace(header, r"[ \t\n\r]", ""))
    return (
        F.when(h.rlike("abstract"), "abstract").when(h.rlike("intro"), "intro").when(h.rlike("method|material"), "method").when(h.rlike("result"), "results").when(h.rlike("discuss"), "discussion").when(h.rlike("bibliograph|reference"), "references")
    )


def p_number(value: Column, power: Column) -> Column:
    """Number of a reported p-value; n.s. gives null; "e-5" and "x 10^-5" are powers of ten."""
    exp = F.coalesce(F.regexp_extract(power, r"-\s*([0-9]+)", 1).try_cast("int"), F.lit(0))
    return F.regexp_replace(value, r"\s", "").try_cast("double") * F.pow(F.lit(10.0), -exp)


def surname(author: Column) -> Column:
    """Small-letter surname of "Surname, Given" or "Given Surname"."""
    a = F.trim(author)
    return F.lower(F.when(a.contains(","), F.trim(F.split_part(a, F.lit(","), F.lit(1)))).otherwise(F.regexp_extract(a, r"([^ ]+)$", 1)))


def affiliation_keywords(c: Column) -> Column:
    """Words of three letters or more that identify an affiliation."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0))), F.array(*map(F.lit, AFFILIATION_STOPWORDS)))


def clean_title(c: Column) -> Column:
    """A title for comparison: no tags and dashes, single blanks, small letters, no full stop at the end."""
    t = F.regexp_replace(c, "<[^>]+>|[-‐‑–—−]+", " ")
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(t), r"[ \t\n\r]+", " ")), r"\.+$", "")


def title_mismatch(a: Column, b: Column) -> Column:
    """Neither cleaned title begins with the other; false where one is missing."""
    x, y = clean_title(a), clean_title(b)
    return F.coalesce((x != "") & (y != "") & ~(x.startswith(y) | y.startswith(x)), F.lit(False))


def file_type(name: Column) -> Column:
    """archive, code, readme, data or other, by name."""
    n = F.lower(name)
    return F.when(n.rlike(r"\.(zip|tar|gz|7z|rar)$"), "archive").when(n.rlike(r"\.(r|rmd|py|sas|do|stata|spss|jasp)$"), "code").when(n.rlike(r"(^|/)readme|\.md$"), "readme").when(n.rlike(r"\.(csv|tsv|xlsx|xls|sav|dta|json|rds)$"), "data").otherwise("other")


def code_language(name: Column) -> Column:
    """Language of a code file by its ending."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z]+)$", 1))
    return F.when(ext.isin("r", "rmd"), "R").when(ext == "py", "Python").when(ext == "sas", "SAS").when(ext.isin("do", "stata"), "Stata").when(ext == "spss", "SPSS").otherwise(F.lit(None).cast("string"))


def code_review(content: Column) -> Column:
    """Struct of a code text: lines, comment lines, absolute paths, random numbers without a seed."""
    lines = F.split(content, "\n")
    random = content.rlike(r"\b(rnorm|runif|sample|random|randint|shuffle)\s*\(") & ~content.rlike(r"set\.seed|random\.seed|np\.random\.seed|set seed")
    return F.struct(
        F.size(lines).alias("n_lines"),
        F.size(F.filter(lines, lambda x: F.ltrim(x).startswith("#") | F.ltrim(x).startswith("//") | F.ltrim(x).startswith("*"))).alias("n_comments"),
        F.size(F.regexp_extract_all(content, F.lit(r"[\"'](?:[A-Za-z]:\\|/home/|/Users/|~/)"), F.lit(0))).alias("n_absolute_paths"),
        F.coalesce(random, F.lit(False)).alias("unseeded"),
    )


def raw_file_url(url: Column) -> Column:
    """Where the raw content of a file shown by a code host lies."""
    return F.replace(F.replace(url, F.lit("https://github.com/"), F.lit("https://raw.githubusercontent.com/")), F.lit("/blob/"), F.lit("/"))


def http_state(code: Column) -> Column:
    """ok, manual (the host refuses programs), error or unreachable, by status code."""
    return F.when(code.isNull() | (code == 0), "unreachable").when(code < 400, "ok").when(code.isin(401, 403, 405, 429, 999), "manual").otherwise("error")


def safe_stem(c: Column) -> Column:
    """A file name of letters, digits, dot, dash and underscore, of 80 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", ""), 1, 80)


def counted(n: Column, one: str, many: str | None = None) -> Column:
    """"1 case", "2 cases"."""
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many or one + "s"))


def version_key(c: Column) -> Column:
    """Numbers of a version, for comparison as an array."""
    return F.transform(F.split(F.regexp_replace(c, "^[vV]", ""), r"\."), lambda x: F.coalesce(F.regexp_extract(x, "^([0-9]+)", 1).try_cast("int"), F.lit(0)))


def sniff(content: Column) -> Column:
    """Type of a file by its first bytes."""
    head = lambda k: F.hex(F.substring(content, 1, k))
    return F.when(head(5) == "255044462D", "pdf").when(head(4) == "504B0304", "zip").when(head(4) == "D0CF11E0", "ole").when(F.lower(F.decode(F.substring(content, 1, 200), "UTF-8")).rlike(r"^\s*<(!doctype|html|\?xml|tei)"), "markup").otherwise("other")
