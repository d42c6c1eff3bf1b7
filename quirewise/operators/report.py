"""Report tables of papers, their JSON form, and the page of one paper."""

from __future__ import annotations

import html
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewise.functions import text as T

# Colours of the lights.
COLOURS = {"green": "#2e7d32", "yellow": "#f9a825", "red": "#c62828", "info": "#1565c0", "na": "#9e9e9e", "fail": "#6a1b9a"}


def report_rows(verdicts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Verdicts (paper_id, check, traffic_light) with label, section and place in the report; unknown checks come last."""
    known = catalogue.select("check", "label", "section", "ord")
    return verdicts.join(F.broadcast(known), "check", "left").select("paper_id", F.coalesce("ord", F.lit(10_000)).alias("ord"), "check", F.coalesce("label", "check").alias("label"), "section", "traffic_light")


def legend(verdicts: DataFrame) -> DataFrame:
    """(paper_id, one count for each light)."""
    return verdicts.groupBy("paper_id").agg(*[F.count_if(F.col("traffic_light") == k).alias(k) for k in COLOURS])


def to_json(rows: DataFrame) -> DataFrame:
    """(paper_id, meta): status, number of checks and the checks in order as one JSON text for each paper."""
    s = F.transform(F.array_sort(F.collect_list(F.struct("ord", "check", "traffic_light"))), lambda x: F.struct(x["check"].alias("check"), x["traffic_light"].alias("traffic_light")))
    return rows.groupBy("paper_id").agg(F.to_json(F.struct(F.lit("ok").alias("status"), F.count(F.lit(1)).alias("n_checks"), s.alias("summary"))).alias("meta"))


def table_row(*columns: Column) -> Column:
    """A row of a Markdown table; bars and line breaks in cells are made harmless, nulls are empty."""
    cell = lambda c: F.coalesce(F.replace(F.regexp_replace(c.cast("string"), r"[\r\n]+", " "), F.lit("|"), F.lit("\\|")), F.lit(""))
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))


def summary_text(n: Column, one: str, none: str) -> Column:
    """"We found 2 cases.", or another sentence for none."""
    return F.when(n > 0, F.concat(F.lit("We found "), T.counted(n, one), F.lit("."))).otherwise(none)


def render(title: str, rows: list, details: dict[str, list[str]] | None = None) -> str:
    """The HTML page of one paper from its report rows, which are few: as many as there are checks."""
    out = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    section = object()
    for r in sorted(rows, key=lambda r: r["ord"]):
        if r["section"] != section:
            section = r["section"]
            out.append(f"<h2>{html.escape(section or 'More')}</h2>")
        out.append(f"<h3><span style='color:{COLOURS.get(r['traffic_light'], '#000')}'>&#9679;</span> {html.escape(r['label'])}</h3>")
        out.append(markdown("\n".join((details or {}).get(r["check"], []))))
    return "\n".join(out)


def markdown(text: str) -> str:
    """HTML of a small part of Markdown: tables, bold, italic, links, paragraphs."""

    def inline(s: str) -> str:
        s = html.escape(s, quote=False)
        s = re.sub(r"\[([^\]]+)\]\((https?://[^)\s]+)\)", r'<a href="\2">\1</a>', s)
        s = re.sub(r"\*\*([^*]+)\*\*", r"<b>\1</b>", s)
        return re.sub(r"\*([^*]+)\*", r"<i>\1</i>", s)

    out, cells = [], []
    for line in [*text.split("\n"), ""]:
        if line.startswith("|"):
            if not re.fullmatch(r"[|\s:-]+", line):
                cells.append([inline(c.strip()) for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))])
            continue
        if cells:
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in cells) + "</table>")
            cells = []
        if line.strip():
            out.append(f"<p>{inline(line.strip())}</p>")
    return "\n".join(out)
