"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents. The last returns the pieces of op5: where each run of a document's token ids lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voidframe.llm import decontaminate, dedup, language, packing, secrets
from voidframe.llm.common import documents, written

#: A document whose best language has less of the posterior mass than this is rejected.
LEAST_LANGUAGE_SCORE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those of which no language is likely, go; a missing lang is filled in."""
    named = language.predict(docs, language.learn(docs)).where(F.col("lang_pred") != "und").where(F.col("score") >= LEAST_LANGUAGE_SCORE)
    return named.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def by_row(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(docs with _row, whether that is only a number): the doc_id where each row has its own; else rows are numbered, and written so that the
    numbers stand."""
    ids = docs.groupBy("doc_id").count()
    if ids.where("doc_id is null or count > 1").isEmpty():
        return docs.withColumn("_row", F.col("doc_id")), False
    return written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows"), True


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose _row is not in gone."""
    return docs.join(gone.select(F.col("_row").alias("_gone")).distinct(), F.col("_row") == F.col("_gone"), "left_anti").drop("_row")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8), the row with the least doc_id stays (a null one is last; of equal
    ids any). Equal texts are near duplicates; rows without words stay."""
    rows, numbered = by_row(docs)
    found = dedup.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), words=5, at_least=80).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    if numbered:
        order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")
        found = found.join(rows.select("_row", "doc_id"), "_row").select("_row", "_group", order.alias("_order"))
        best = found.groupBy("_group").agg(F.min("_order")["_row"].alias("_best"))
        return without(rows, found.join(best, "_group").where("_row <> _best"))
    return without(rows, found.where("_group < _row"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item, word for word or with other parameters, go; other rows with their doc_id stay."""
    rows, _ = by_row(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(rows, decontaminate.leaks(rows.select(F.col("_row").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_row")))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark of its kind; n_chars follows the new text."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: The first stage is a learned model and the last a heuristic partition; neither is an SQL expression.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
