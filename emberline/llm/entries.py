"""Queries of this package for ``__spark_entry__.py``, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from emberline.llm import ann, html_text, mixing, ngram_join, packing, quality_net, quality_rules, suffix_dedup, token_counts, url_rules


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


documents, labels, pages, embeddings = map(_table, ("documents", "labels", "pages", "embeddings"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_net.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(pages(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokens=token_counts.n_tokens(spark, F.col("text")))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.match(pages(spark, sf_dir), url_rules.default_rules(spark))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 100; all rows are searched."""
    table = embeddings(spark, sf_dir)
    return ann.neighbours(table, queries=table.where("vec_id % 100 = 0"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), with_plan=True)
    return mixed.select("doc_id", "domain", "lang", "source", "epoch", "n_words")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(documents(spark, sf_dir))


WORDS = r"regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x7f]+')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_html_extraction": op2_html_extraction,
    "op3_packing": op3_packing,
    "op4_url_filters": op4_url_filters,
    "op5_quality_rules": op5_quality_rules,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_token_counts": op8_token_counts,
    "op9_mixing": op9_mixing,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "pipeline": corpus_pipeline.run,
}

_RULES = ", ".join(f"({n}, '{pattern}', '{action}')" for n, pattern, action in url_rules.RULES)
_HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1))"
_PATH = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)', 1)"

ORACLE_SQL: dict[str, str] = {
    "op4_url_filters": f"""
        WITH r AS (SELECT rule_id, action, array_to_string(list_reverse(string_split(regexp_extract(pattern, '^([^/]*)', 1), '.')), '.')
                       || '.' || regexp_extract(pattern, '^[^/]*(/.*)?$', 1) AS prefix
                   FROM (VALUES {_RULES}) AS v(rule_id, pattern, action)),
        u AS (SELECT row_number() OVER () AS n, page_id, url, CASE WHEN {_HOST} <> '' THEN
                  array_to_string(list_reverse(string_split({_HOST}, '.')), '.') || '.' ||
                  CASE WHEN starts_with({_PATH}, '/') THEN {_PATH} ELSE '/' || {_PATH} END END AS key FROM pages),
        m AS (SELECT u.n, r.rule_id, r.action, length(prefix) AS long FROM u JOIN r ON starts_with(u.key, r.prefix)),
        b AS (SELECT n, arg_max(rule_id, long * 1000 + rule_id) AS rule_id, arg_max(action, long * 1000 + rule_id) AS action, count(*) AS n_rules FROM m GROUP BY n)
        SELECT u.page_id, u.url, b.rule_id, coalesce(b.action, 'allow') AS action, coalesce(b.n_rules, 0) AS n_rules
        FROM u LEFT JOIN b USING (n)""",
    "op7_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5
                  THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS gram FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS overlap
              FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
        q AS (SELECT doc_a, doc_b FROM p JOIN n x ON x.doc_id = doc_a JOIN n y ON y.doc_id = doc_b
              WHERE overlap::DOUBLE / (x.n + y.n - overlap) >= 0.4),
        l AS (SELECT doc_a AS a, doc_b AS b FROM q UNION ALL SELECT doc_b, doc_a FROM q),
        c AS (SELECT DISTINCT a, a AS z FROM l UNION SELECT l.b, c.z FROM c JOIN l ON l.a = c.a)
        SELECT a AS doc_id, min(z) AS class_id, any_value(k) AS n_links
        FROM c JOIN (SELECT a, count(*) AS k FROM l GROUP BY a) USING (a) GROUP BY a""",
    "op10_suffix_array_dedup": f"""
        WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        v AS (SELECT doc_id, unnest(range(0, len(ws) - 49)) AS i, ws FROM w WHERE len(ws) >= 50),
        k AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1:i + 50], ' ')) AS h FROM v),
        r AS (SELECT doc_id, i, first_value(doc_id) OVER o AS fd, first_value(i) OVER o AS fi
              FROM k WINDOW o AS (PARTITION BY h ORDER BY doc_id, i)),
        d AS (SELECT * FROM r WHERE doc_id <> fd OR i <> fi),
        e AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS cut FROM d),
        g AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS isle FROM e)
        SELECT doc_id, min(i) AS start_word, max(i) + 50 - min(i) AS n_words,
               arg_min(fd, i) AS first_doc_id, arg_min(fi, i) AS first_word
        FROM g GROUP BY doc_id, isle""",
}
