"""The queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encode

    return encode(_table(spark, sf_dir, "documents"), with_ids=False, check=True)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(_table(spark, sf_dir, "documents"))


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .training_order import materialise

    return materialise(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import report

    return report(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import decontaminate

    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import document_counts

    return document_counts(_table(spark, sf_dir, "documents"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import classes

    return classes(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_language_id": op3_language_id,
        "op4_training_order": op4_training_order,
        "op5_pii": op5_pii,
        "op6_quality_rules": op6_quality_rules,
        "op7_decontamination": op7_decontamination,
        "op8_token_counts": op8_token_counts,
        "op9_simhash_dedup": op9_simhash_dedup,
        "op10_substring_dedup": op10_substring_dedup,
    }


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bp AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM bp),
lengths AS (SELECT DISTINCT n FROM bw),
dp AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
dl AS (SELECT rid, k, list(word) OVER (PARTITION BY rid ORDER BY k ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM dp),
hit AS (SELECT rid, k, bw.n AS n, item FROM dl JOIN lengths ON len(l) >= lengths.n JOIN bw ON bw.n = lengths.n AND bw.win = array_to_string(l[1:lengths.n], ' ')),
cover AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS s FROM hit GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (rid) LEFT JOIN items USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_decontamination": _OP7}
