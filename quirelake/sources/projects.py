"""Project configurations: saving, loading and opening them, and loading documents.

A store is a Parquet folder with a partition for each project root. Rows are
mappings: root_path, path, role, enabled. Errors are columns, so that many
projects go through one plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.operators import parse
from quirelake.sources import files

SCHEMA = "path string, role string, enabled boolean, root_path string"
ROLES = ("primary_manuscript", "reference", "notes", "ignore")
STATUS = "quirelake engine ready"


def healthcheck(tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each table that the engine was given: its name, how many rows were read of it, and the status."""
    rows = [t.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(STATUS).alias("status")) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def checked(drafts: DataFrame) -> DataFrame:
    """root_path and the first error_code (or null) of each project's mappings (root_path, seq, path, role, enabled)."""
    return files.validate_mappings(drafts.withColumnRenamed("root_path", "project")).withColumnRenamed("project", "root_path")


def save_config(drafts: DataFrame, store: str) -> DataFrame:
    """Replace the mappings of every project that is valid; root_path and error_code of all.

    A project's old mappings go as a whole; other projects in the store stay.
    """
    told = checked(drafts)
    rows = files.normalize_mappings(drafts.where("role IS NOT NULL")).join(told.where("error_code IS NULL").select("root_path"), "root_path", "left_semi")
    rows = rows.select(F.col("normalized").alias("path"), "role", "enabled", "root_path")
    rows.repartition("root_path").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("root_path").parquet(store)
    return told


def load_config(spark: SparkSession, store: str, roots: DataFrame) -> DataFrame:
    """Mappings of the roots that are configured, with their place in the order of paths, and an error_code for a role that no one knows."""
    rows = spark.read.schema(SCHEMA).parquet(store).join(roots.select("root_path").distinct(), "root_path", "left_semi")
    place = F.row_number().over(Window.partitionBy("root_path").orderBy("path")) - 1
    error = F.when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), "invalid_stored_directory_role")
    return rows.select("root_path", place.alias("seq"), "path", "role", "enabled", error.alias("error_code"))


def open_projects(roots: DataFrame, config: DataFrame, tree: DataFrame) -> DataFrame:
    """root_path, path, document_type, error_code: each root's documents by path parts, or the error that keeps it closed.

    config: rows of load_config; tree: root_path and path below it.
    """
    rows = config.groupBy("root_path").agg(F.max("error_code").alias("bad"))
    asked = roots.select("root_path").distinct().join(rows.withColumn("known", F.lit(True)), "root_path", "left")
    told = asked.select("root_path", F.when(F.col("known").isNull(), "not_configured").otherwise(F.col("bad")).alias("error_code"))
    good = told.where("error_code IS NULL").select("root_path")
    found = files.discover(tree.join(good, "root_path", "left_semi"), config.join(good, "root_path", "left_semi"), by=("root_path",))
    closed = told.where("error_code IS NOT NULL").select("root_path", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("document_type"), "error_code")
    return found.withColumn("error_code", F.lit(None).cast("string")).unionByName(closed)


def in_order(documents: DataFrame) -> DataFrame:
    """Distinct documents of each root with their position: paths are ordered part by part, not as strings."""
    order = F.row_number().over(Window.partitionBy("root_path").orderBy(F.split("path", "/"))) - 1
    return documents.dropDuplicates(["root_path", "path"]).withColumn("position", order)


def safe_path(path: Column) -> Column:
    """Whether a path leads from the root to something below it: not absolute, no .. in it, no . in front. Empty parts and a . inside are harmless."""
    names = F.split(path, "/")
    return F.coalesce((path != "") & ~path.startswith("/") & (F.get(names, F.lit(0)) != ".") & ~F.array_contains(names, ".."), F.lit(False))


def load_documents(requests: DataFrame, opened: DataFrame, tree: DataFrame) -> DataFrame:
    """root_path, path, document_type, text, error_code of each request (root_path, path); tree also has text and, for texts that are not UTF-8, an error_code."""
    safe = safe_path(F.col("path"))
    closed = opened.where("error_code IS NOT NULL").select("root_path", F.col("error_code").alias("closed"))
    known = opened.where("error_code IS NULL").select("root_path", "path", "document_type")
    texts = tree.select("root_path", "path", "text", F.col("error_code").alias("unread"))
    rows = requests.select("root_path", "path").join(closed, "root_path", "left").join(known, ["root_path", "path"], "left").join(texts, ["root_path", "path"], "left")
    error = F.when(~safe, "invalid_document_path").when(F.col("closed").isNotNull(), F.col("closed")).when(F.col("document_type").isNull(), "document_not_discovered").otherwise(F.col("unread"))
    return rows.select("root_path", "path", "document_type", F.when(error.isNull(), F.col("text")).alias("text"), error.alias("error_code"))


def parsed(loaded: DataFrame, mode: str = "conservative_heuristic") -> DataFrame:
    """Spans of loaded documents, by root_path and path."""
    key = F.to_json(F.struct("root_path", "path"))
    spans = parse.spans(loaded.where("error_code IS NULL").select(key.alias("path"), "text"), mode)
    names = F.from_json("path", "root_path string, path string")
    return spans.withColumn("k", names).select("k.root_path", "k.path", *[c for c in spans.columns if c != "path"])
