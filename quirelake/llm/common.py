"""Helpers that the operators of this subpackage share.

Nothing here holds data on the driver: the helpers place written tables in the
folder that all executors share, rank rows without one hot window, and find
connected components by joins.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
import zlib
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only. ``lower`` agrees with that on ASCII text and is faster."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, ASCII_UPPER, ASCII_UPPER.lower())
    )


def crc32_mod(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n (null counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def crc32_text(value: object) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode())


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a private one, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = str(Path(tempfile.gettempdir()) / "checkpoints")
    return f"{base.rstrip('/')}/quirelake-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def written(df: DataFrame, what: str = "table", **options: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back.

    A lost executor then costs only the tasks it ran. Shuffle files of the
    write go with it; the table goes by ``drop``, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}"
    schema, key = df.schema, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(key, before)
    where, fs = _path(spark, path)
    fs.deleteOnExit(where)
    table = spark.read.schema(schema).parquet(path)
    _PATHS[table] = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete written tables whose last reader has itself been written."""
    for table in tables:
        where, fs = _path(table.sparkSession, _PATHS.pop(table))
        fs.delete(where, True)


def small(table: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A written table of a few longs a row, marked for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(table) if table.count() <= rows else table


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mapped(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow for functions of this package, in small batches."""
    workers_see_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def bounded_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Let an Arrow batch hold at most ``rows`` rows: Spark's 10,000 whole texts take hundreds of MB on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, rows)


def workers_see_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package when it is not installed, and take texts in small batches."""
    bounded_batches(spark)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    workers_see_package(spark)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def lookup(left: DataFrame, right: DataFrame, on: list[str], salts: int = 8) -> DataFrame:
    """Left join to a table that is unique on ``on``, when a key of ``left`` may be hot.

    The right side is repeated once per salt, so a hot key's rows meet in
    ``salts`` tasks; adaptive execution may split them further.
    """
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return shuffled(left, right, [*on, "_salt"], "left").drop("_salt")


def shuffled(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join whose right side grows with the input.

    It is never sent to all tasks by way of the driver: Spark goes by the size
    of compressed files, and does not count the rows that ``explode`` adds.
    """
    return left.join(right.hint("merge"), on, how)


#: Tables of two longs a row are sent to all tasks up to so many rows.
FEW = 1_000_000


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id for each id in ``links`` (columns a, b).

    Every round takes the least label among neighbours, hooks the label's own
    root onto it, and jumps one pointer. Each round ends in a written table.
    Labels go to all tasks as long as they are few; only more are repeated by salt.
    Returns columns id, component.
    """
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other"))
    both = written(both.unionByName(both.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct(), "links")
    held = written(
        both.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("component"), F.col("id").alias("old")), "label0"
    )
    for k in range(1, max_rounds + 1):
        label = held.select("id", "component")
        near = label.select(F.col("id").alias("other"), F.col("component").alias("near"))
        few = label.count() <= FEW
        best = (both.join(F.broadcast(near), "other", "left") if few else lookup(both, near, ["other"])).groupBy("id").agg(F.min("near").alias("near"))
        step = label.join(best, "id", "left").select(
            "id", F.col("component").alias("old"), F.least("component", "near").alias("new")
        )
        hook = step.where("new < old").groupBy(F.col("old").alias("id")).agg(F.min("new").alias("hook"))
        step = step.join(hook, "id", "left").select("id", "old", F.least("new", "hook").alias("new"))
        step = written(step, f"step{k}")
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("far"))
        new = written(
            (step.join(F.broadcast(jump), "new", "left") if few else lookup(step, jump, ["new"])).select("id", F.least("new", "far").alias("component"), "old"), f"label{k}"
        )
        drop(step, held)
        held = new
        if held.where("component < old").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    drop(both)
    return held.select("id", "component")


class Table:
    """Values by 64-bit key, 0 for others, for many look-ups: open slots, a second table for keys whose slot is taken."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.layers: list[tuple[np.uint64, np.uint64, np.ndarray, np.ndarray]] = []
        self.kind = values.dtype
        seed = 0
        while len(keys):
            bits = max(4, int(len(keys) * 4).bit_length())
            odd = np.uint64((0x9E3779B97F4A7C15 + 2 * 0xBF58476D1CE4E5B9 * seed) & 0xFFFFFFFFFFFFFFFF | 1)
            shift = np.uint64(64 - bits)
            slot = (keys * odd) >> shift
            held, value = np.full(1 << bits, np.iinfo(np.uint64).max, dtype=np.uint64), np.zeros(1 << bits, self.kind)
            held[slot] = keys
            won = held[slot] == keys
            value[slot[won]] = values[won]
            self.layers.append((odd, shift, held, value))
            keys, values, seed = keys[~won], values[~won], seed + 1

    def get(self, keys: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(keys), self.kind), None
        for odd, shift, held, value in self.layers:
            own = keys if todo is None else keys[todo]
            slot = (own * odd) >> shift
            hit = held[slot] == own
            if todo is None:
                out = np.where(hit, value[slot], self.kind.type(0))
                todo = np.flatnonzero(~hit)
            else:
                out[todo[hit]] = value[slot[hit]]
                todo = todo[~hit]
            if not len(todo):
                break
        return out
