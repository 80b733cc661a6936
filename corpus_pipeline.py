"""The training-data pipeline: each stage works on all documents its predecessor kept.

A document is a row. A verdict holds for its own row alone, so ids may be null or repeated: a null
id is an id like others, and one id on two texts is two documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import languages, near, packing, quality, secrets
from tidegrid.llm.common import table, unused, written
from tidegrid.llm.queries import BYTES

MIN_LANGUAGE_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or like none of the learned languages."""
    profiles = languages.prototypes(docs.where(languages.fold() != 2))
    whole = docs.select(F.struct("*").alias("row"), "text")
    found = languages.predict(whole, profiles, ["row"])
    return found.where((F.col("lang_pred") != languages.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or the adaptive thresholds."""
    whole = docs.select(F.struct("*").alias("row"), "doc_id", "text", "lang", "source")
    return quality.judge(whole, carry=["row"]).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: that of the smallest id, null ids last, one of them if
    the id is repeated. Texts without words are no one's copies, but of the same id."""
    key = unused("row_key", docs.columns)
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    found = near.clusters(rows, doc_id=key).select(F.col("doc_id").alias(key), "n_shingles", "component_id")
    named = found.join(rows.select(key, F.col("doc_id").alias("id")), key)
    wordless = F.col("n_shingles") == 0
    group = [F.when(~wordless | F.col("id").isNull(), F.col("component_id")), F.when(wordless, F.col("id"))]
    order = F.struct(F.col("id").isNull(), "id", key)
    first = named.groupBy(*(g.alias(f"g{i}") for i, g in enumerate(group))).agg(F.min_by(key, order).alias(key))
    return rows.join(first.select(key), key, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; keeps all documents."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into training sequences."""
    return packing.pieces(docs, BYTES)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates),
          ("secret_scan", secret_scan), ("packing", pack)]

# Profiles, sketches, MinHash and token ids are outside SQL; tests hold the surviving rows of the filters against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
