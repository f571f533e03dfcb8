"""One registered query for each operator of this subpackage, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.bpe import encode
from ledgerloom.llm.common import documents
from ledgerloom.llm.language_id import identify
from ledgerloom.llm.lattice import score
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.repetition import repetition_rules
from ledgerloom.llm.rule_ensemble import classify
from ledgerloom.llm.simhash_graph import near_duplicates
from ledgerloom.llm.substring_dedup import repeated_intervals

from ledgerloom.llm.suffix_merge import merged_intervals
from ledgerloom.llm.transport import text_transport_index


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_intervals(documents(spark, sf_dir))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_transport_index(documents(spark, sf_dir))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_intervals(documents(spark, sf_dir))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_language_id": op2_language_id,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_media_columns": op8_media_columns,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
}

_TOKENS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f\v]+'), lambda x: x <> '')"



def _repeats(width: int) -> str:
    return f"""
WITH tok AS (SELECT doc_id, {_TOKENS} AS w FROM documents WHERE doc_id IS NOT NULL),
win AS (SELECT doc_id, CAST(i AS INTEGER) AS p, md5(array_to_string(w[i+1:i+{width}], ' ')) AS h
        FROM tok, unnest(range(0, greatest(len(w)-{width - 1}, 0))) AS u(i)),
m AS (SELECT doc_id, p, count(*) OVER (PARTITION BY h) AS c, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS r FROM win),
k AS (SELECT doc_id, p, 'repeat' AS kind FROM m WHERE c > 1 UNION ALL SELECT doc_id, p, 'remove' FROM m WHERE r > 1),
g AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id, kind ORDER BY p) + {width} THEN 0 ELSE 1 END AS f FROM k),
s AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, kind ORDER BY p) AS island FROM g)
SELECT doc_id, kind, min(p) AS start_token, CAST(max(p) + {width} AS INTEGER) AS end_token FROM s GROUP BY doc_id, kind, island
"""


ORACLE_SQL = {
    "op8_media_columns": """
WITH t AS (SELECT doc_id, encode(text) AS b, octet_length(encode(text)) AS n FROM documents WHERE doc_id IS NOT NULL AND text <> ''),
u AS (SELECT doc_id, CAST(i AS INTEGER) AS unit, b[i*8192+1:i*8192+8192] AS whole, CASE WHEN i % 4 = 0 THEN 163 ELSE 165 END AS head FROM t, unnest(range(0, (n + 8191) // 8192)) AS x(i)),
v AS (SELECT *, octet_length(whole) AS n, unit % 7 = 3 AND octet_length(whole) > head + 184 AS gap FROM u),
w AS (SELECT *, CASE WHEN gap THEN whole[1:head] || whole[head+185:n] ELSE whole END AS payload FROM v)
SELECT doc_id, 1 AS program, 256 AS pid, 6 AS stream_type, unit, 189 AS stream_id, CAST((unit + 1) * 3600 AS BIGINT) AS pts,
       CAST(unit * 3600 AS BIGINT) AS dts, unit % 4 = 0 AS random_access, CAST(octet_length(payload) AS INTEGER) AS size,
       NOT gap AS complete, CASE WHEN gap THEN 1 ELSE 0 END AS breaks, md5(payload) AS digest FROM w
UNION ALL SELECT doc_id, 2, 257, 15, unit, 192, CAST((unit + 1) * 3600 AS BIGINT), CAST(unit * 3600 AS BIGINT), false, CAST(length('size=' || n) AS INTEGER), true, 0, md5('size=' || n) FROM w
""",
    "op5_substring_dedup": _repeats(40),
    "op10_suffix_dedup": _repeats(50),
}
