"""A corpus pipeline of the operators in trawlkit.llm: rejected languages and boilerplate lines go, one
document of each near-duplicate group stays, personal data is replaced, and what is left is packed.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the
last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlkit.llm import language, lines, packing, personal_data, shingle_join
from trawlkit.llm.common import MARK, table
from trawlkit.session import written_table


def _like(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with the length of the text as it now is."""
    counted = docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else docs
    return counted.select(*columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language the model rejects go; a missing lang is filled in."""
    judged = language.predict(docs, language.train(docs))
    kept = judged.where(~F.col("rejected")).withColumn("lang", F.coalesce("lang", "lang_pred"))
    return kept.select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines seen on many sites go from the texts."""
    return _like(lines.drop_spread_lines(docs), docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by similarity the one with the least doc_id stays.

    Of rows repeated under that id one stays. Texts without words link with nothing and stay.
    """
    row = f"{MARK}row"
    found = shingle_join.similar_documents(docs).where(F.col("family").isNotNull())
    # A null id comes last.
    best = found.groupBy("family").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"))
    chosen = written_table(best.select(F.col("best.row").alias(row)), "chosen")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.withColumn(row, shingle_join.row_key(F.col("doc_id"), F.col("text")))
    one = keyed.where(worded).join(chosen, row).dropDuplicates([row])
    return one.select(*docs.columns).unionByName(docs.where(~worded))


def personal_data_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind."""
    return _like(personal_data.redact(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts in buckets and batches."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("personal_data", personal_data_removal),
    ("packing", pack),
]

# Training, sketches and components are not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
