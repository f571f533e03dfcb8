"""A corpus pipeline over `documents`: five stages, each one operator of ledgerloom.llm applied to all that the last kept.

1. language ID: documents without a clear language go (ambiguous ones, and texts without letters).
2. quality rules: documents that repeat themselves go.
3. SimHash near-dedup: of each group of near-duplicates the one with the least id stays.
4. substring dedup: of each passage of 40 tokens or more that is repeated, every place but the first is cut from its
   text and n_chars is counted again; documents stay, with '' where the whole text was such a passage.
5. best-fit packing: one row a piece of a document, with its sequence (ledgerloom.llm.packing).

Rows without an id go in the first stage. Stages 1 to 4 return the columns that they get; stage 5 returns the packing.
Extra columns pass through stages 1 to 4. An empty table passes all stages and gives no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.common import cut, documents
from ledgerloom.llm.language_id import keep_identified
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.repetition import keep_unrepetitive
from ledgerloom.llm.simhash_graph import keep_one_of_each
from ledgerloom.llm.substring_dedup import remove_repeats
from ledgerloom.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return keep_identified(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return keep_unrepetitive(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return keep_one_of_each(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", passage_dedup),
    ("best_fit_packing", packing),
]

#: SQL can't express the trained classifier of stage 1 or the graphs of stage 3: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
