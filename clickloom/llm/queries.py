"""The registered queries of the text operators and the SQL that some of them can be held against.

Each query applies its operator with production parameters to the whole of its tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontaminate import contaminated
from .filter_audit import filter_audit
from .html_text import html_text
from .language_id import languages
from .licenses import license_scan
from .packing import pack_documents
from .quality import quality_rules
from .secret_scan import secret_spans
from .simhash import near_duplicates
from .suffix_tree import language_scores
from .token_alignment import cross_tokenizer
from .toxicity import toxicity_scores
from .warc import archive_pages


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))


def op9_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokenizer(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_packing": op2_packing,
        "op3_html_text": op3_html_text,
        "op4_licenses": op4_licenses,
        "op5_quality_rules": op5_quality_rules,
        "op6_warc": op6_warc,
        "op7_simhash": op7_simhash,
        "op8_suffix_tree": op8_suffix_tree,
        "op9_secret_spans": op9_secret_spans,
        "op10_decontaminate": op10_decontaminate,
        "op11_language_id": op11_language_id,
        "op12_token_alignment": op12_token_alignment,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express whole; the others are held against plain versions in the tests."""
    return {
        "op13_filter_audit": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails
  FROM w LEFT JOIN l USING (doc_id)),
p AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
i AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, array_to_string(['ABCDE'[x] FOR x IN o], '') AS filter_order, step FROM o, (SELECT unnest(range(1, 6)) AS step)),
x AS (SELECT part, filter_order, step, o[step] AS own, n, good, toxic, fails[o[step]] AS failing,
    len([j FOR j IN o[1:step - 1] IF fails[j]]) = 0 AS reached, len([b FOR b IN fails IF b]) = 1 AS single FROM p, s),
g AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (reached AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (reached AND failing), 0) AS removed,
    coalesce(sum(n) FILTER (failing AND NOT reached), 0) AS redundant, coalesce(sum(n) FILTER (failing AND single), 0) AS unique_fails,
    coalesce(sum(n) FILTER (reached AND failing AND good = 1), 0) AS good_lost, coalesce(sum(n) FILTER (reached AND failing AND toxic = 1), 0) AS toxic_lost
  FROM x GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM g""",
        "op6_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE strlen(h) >= 100 AND page_id IS NOT NULL GROUP BY h)
SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (h)""",
    }
