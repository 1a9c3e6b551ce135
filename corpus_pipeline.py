"""A training-corpus pipeline of five stages, each one operator at work on what the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs; all but the last return the
columns of documents. Rows are told apart by a row id of a written table, so
repeated or null doc_ids do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import decontamination, exact_dedup, language, near_copies, packing
from quirelake.llm.common import crc32_mod, fresh, written

#: Texts that need more phrases per letter than this are in no learned language.
MOST_PHRASES = 0.5


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a lasting row id, and its column's name, which docs does not have."""
    row = fresh("row", docs)
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "rows", compression="zstd"), row


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the labelled ones teach."""
    model = language.fit(docs.where(crc32_mod(F.col("doc_id"), 4) != 2))
    names = tuple(fresh(x, docs) for x in ("lang_pred", "score", "phrase_rate"))
    found = language.predict(docs, model, keep=tuple(docs.columns), names=names)
    return found.where((F.col(names[0]) != "und") & (F.col(names[2]) <= MOST_PHRASES)).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep the row with the largest doc_id."""
    rows, row = numbered(docs)
    made = exact_dedup.recipes(rows.select("doc_id", "text", row), row_id=row)
    gone = exact_dedup.groups(made).where(~F.col("kept")).select(F.col("row_id").alias(row))
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, overlap 0.8 or more), keep the row with the smallest doc_id."""
    rows, row = numbered(docs)
    near = near_copies.groups(rows.select(F.col(row).alias("id"), "text"))
    near = written(rows.select(F.col(row).alias("id"), F.col("doc_id").cast("long").alias("own")).join(near, "id"), "near")
    first = near.groupBy("component").agg(F.min(F.struct("own", "id")).alias("first")).select("first.id")
    gone = near.select("id").join(first, "id", "left_anti").select(F.col("id").alias(row))
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item."""
    rows, row = numbered(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.decontaminate(rows.select(F.col(row).alias("doc_id"), "text"), items)
    gone = found.where("n_hit > 0").select(F.col("doc_id").alias(row))
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL cannot express language identification or min-hashes; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
