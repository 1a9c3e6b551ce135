"""Persisted memory: entity candidates, facts and summaries in one store.

A store is a folder with a Parquet log for each kind of record. Every call that
changes it appends one operation, numbered in order; a record's present state
is an aggregation over the log: its last save, then the last review and the last
staleness call on its document that came after that save. Nothing is rewritten,
so a call that fails leaves the store as it was. One writer at a time.

Saving an id again replaces the record and both its states, at the place of its
first save. Lists are in the order of first saves. A store that is not there is
an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quirelake.operators import memory

#: The columns of each kind of record, and those that all have.
KINDS = {"entity_candidates": "name string", "reviewable_facts": "subject string, predicate string, object string", "reviewable_summaries": "scope string, text string"}
SHARED = "source_document_path string, source_anchors_json string, source_start_char long, source_end_char long, review_state string, staleness_state string"


def columns_of(kind: str) -> list[str]:
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")
    return StructType.fromDDL(f"{KINDS[kind]}, {SHARED}").names


def log(spark: SparkSession, store: str, kind: str) -> DataFrame:
    """Every operation on a kind: op, its number; nth, the place in it; action: save, review or stale."""
    columns_of(kind)
    schema = f"action string, nth long, id string, {KINDS[kind]}, {SHARED}, op long"
    place = f"{store}/{kind}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(place) if there else spark.createDataFrame([], schema)


def next_op(spark: SparkSession, store: str) -> int:
    return 1 + max(log(spark, store, kind).agg(F.max("op")).first()[0] or 0 for kind in KINDS)


def append(rows: DataFrame, store: str, kind: str, action: str, op: int) -> None:
    rows.withColumn("action", F.lit(action)).withColumn("op", F.lit(op).cast("long")).write.mode("append").partitionBy("op").parquet(f"{store}/{kind}")


def save(records: DataFrame, store: str, kind: str) -> None:
    """Save records (id, seq, the order in which they come, the columns of their kind, and anchors or source_anchors_json)."""
    if "source_anchors_json" not in records.columns:
        records = records.withColumn("source_anchors_json", memory.encode_anchors(F.col("anchors")))
    spark = records.sparkSession
    append(records.select("id", F.col("seq").cast("long").alias("nth"), *columns_of(kind)), store, kind, "save", next_op(spark, store))


def records(spark: SparkSession, store: str, kind: str) -> DataFrame:
    """Present records of a kind, with first: the operation and the place in it of their first save."""
    rows, names = log(spark, store, kind), columns_of(kind)
    saves = rows.where("action = 'save'")
    at = F.struct("op", "nth")
    last = saves.groupBy("id").agg(F.max_by(F.struct(*names), at).alias("last"), F.min(at).alias("first"), F.max("op").alias("saved")).select("id", "first", "saved", "last.*")
    reviews = rows.where("action = 'review'").groupBy("id").agg(F.max("op").alias("reviewed"), F.max_by("review_state", "op").alias("to"))
    gone = rows.where("action = 'stale'").groupBy("source_document_path").agg(F.max("op").alias("gone"))
    out = last.join(reviews, "id", "left").join(gone, "source_document_path", "left")
    out = out.withColumn("review_state", F.when(F.col("reviewed") > F.col("saved"), F.col("to")).otherwise(F.col("review_state")))
    out = out.withColumn("staleness_state", F.when(F.col("gone") > F.col("saved"), "stale").otherwise(F.col("staleness_state")))
    return out.select("id", "first", *names)


def listed(spark: SparkSession, store: str, kind: str, name: str = "all") -> DataFrame:
    """Records that a filter of operators.memory lets through, in order, with their anchors and the error of what cannot be read."""
    out = memory.stored_errors(records(spark, store, kind).where(memory.state_filter(name)))
    return out.withColumn("anchors", memory.decode_anchors(F.col("source_anchors_json"))).orderBy("first")


def review(updates: DataFrame, store: str, kind: str) -> DataFrame:
    """Set the review state of ids (id, review_state; the last by seq counts); id and error_code of each."""
    spark = updates.sparkSession
    last = updates.groupBy("id").agg(F.max_by("review_state", "seq").alias("review_state"))
    known = records(spark, store, kind).select("id", F.lit(True).alias("known"))
    op = next_op(spark, store)
    append(last.join(known, "id", "left_semi").select("id", "review_state"), store, kind, "review", op)
    return last.join(known, "id", "left").select("id", F.when(F.col("known").isNull(), "memory_record_not_found").alias("error_code"))


def mark_stale(paths: DataFrame, store: str) -> dict[str, int]:
    """Mark every record whose source is one of the documents (path); how many of each kind there are, stale ones included."""
    spark, out = paths.sparkSession, {}
    gone, op = paths.select(F.col("path").alias("source_document_path")).distinct(), next_op(paths.sparkSession, store)
    for kind in KINDS:
        held = records(spark, store, kind).join(gone, "source_document_path", "left_semi")
        found = held.groupBy("source_document_path").agg(F.count("*").alias("n"))
        out[kind] = found.agg(F.sum("n")).first()[0] or 0
        if out[kind]:
            append(found.select("source_document_path"), store, kind, "stale", op)
    return out


def anchors_json(kind: str, ordinal: Column) -> Column:
    """A stored text of one anchor."""
    return memory.encode_anchors(F.array(F.struct(F.lit(kind).alias("kind"), ordinal.alias("ordinal"))))
