"""The queries of the text-collection operators, by name; each takes (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirewise.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from quirewise.llm.lookalike import alike_pairs

    return alike_pairs(table(spark, d, "sentence"))


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    from quirewise.llm.lookalike import consistent_forms

    return consistent_forms(table(spark, d, "sentence"), ["paper_id", "text_id"]).select("paper_id", "text_id", "form")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_matches(spark, d).select("paper_id", "bib_id", "record_id")


def p2_matches(spark: SparkSession, d: str) -> DataFrame:
    from quirewise.llm.matching import match

    return match(table(spark, d, "bib"), table(spark, d, "registry_record"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from quirewise.llm.spans import shared_spans

    return shared_spans(table(spark, d, "sentence"), table(spark, d, "source_text"))


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    from quirewise.llm.spans import coverage

    return coverage(table(spark, d, "sentence"), p3_found(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from quirewise.llm.names import name_pairs

    return name_pairs(p4_entities(spark, d))


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    from quirewise.llm.names import entities

    return entities(table(spark, d, "bib"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_sentences(spark, d).drop("sentence")


def p5_sentences(spark: SparkSession, d: str) -> DataFrame:
    from quirewise.llm.sentences import sentence_spans

    return sentence_spans(table(spark, d, "paragraph"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    from quirewise.llm.tokens import encode_corpus

    return encode_corpus(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    from quirewise.llm.tokens import decode_corpus

    return decode_corpus(p6_ids(spark, d))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    from quirewise.llm.packing import pack_documents

    return pack_documents(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_restored(spark, d).select("doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    from quirewise.llm.mojibake import garbled

    return garbled(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


_WORDS = "list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')"
_SPANS = f"""WITH row_ AS (SELECT DISTINCT paper_id, text_id, {_WORDS} AS w FROM sentence), out_ AS (SELECT {_WORDS} AS w FROM source_text),
win AS (SELECT paper_id, text_id, pos, array_to_string(list_slice(w, pos + 1, pos + 12), ' ') AS gram FROM (SELECT *, unnest(range(0, len(w) - 11)) AS pos FROM row_ WHERE len(w) >= 12)),
osrc AS (SELECT DISTINCT array_to_string(list_slice(w, pos + 1, pos + 12), ' ') AS gram FROM (SELECT *, unnest(range(0, len(w) - 11)) AS pos FROM out_ WHERE len(w) >= 12)),
hit AS (SELECT paper_id, text_id, pos FROM win WHERE gram IN (SELECT gram FROM win GROUP BY 1 HAVING count(DISTINCT paper_id) > 1) OR gram IN (SELECT gram FROM osrc)),
isle AS (SELECT *, sum(CASE WHEN pos - before <= 12 THEN 0 ELSE 1 END) OVER (PARTITION BY paper_id, text_id ORDER BY pos) AS k FROM (SELECT *, lag(pos) OVER (PARTITION BY paper_id, text_id ORDER BY pos) AS before FROM hit)),
found AS (SELECT paper_id, text_id, CAST(min(pos) AS INT) AS start_word, CAST(max(pos) + 12 AS INT) AS end_word FROM isle GROUP BY paper_id, text_id, k)"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query on whole tables; the others are tested by brute force, round trips or hand-made cases."""
    return {
        "p3_found": f"{_SPANS} SELECT * FROM found",
        "p3_coverage": f"{_SPANS} SELECT paper_id, text_id, n_words, coalesce(s, 0) AS shared_words, coalesce(c, 0) AS n_spans, CASE WHEN n_words > 0 THEN coalesce(s, 0) / n_words ELSE 0 END AS coverage FROM (SELECT paper_id, text_id, max(len(w)) AS n_words FROM row_ GROUP BY 1, 2) LEFT JOIN (SELECT paper_id, text_id, CAST(sum(end_word - start_word) AS BIGINT) AS s, count(*) AS c FROM found GROUP BY 1, 2) USING (paper_id, text_id)",
        "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
