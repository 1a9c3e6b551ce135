"""Exact dedup by content-defined chunk recipes (operator 4), DataFrame functions only.

A normalised text is cut where its own characters say so; every distinct chunk
is moved once, to verify that its 64-bit fingerprint stands for one text only;
a document is then the ordered list of its chunks' identifiers, and equal lists
are equal texts. Only identifiers travel after that, never the long texts.

Defined cases: null text counts as empty, and empty texts equal each other; of
equal texts the largest doc_id stays (a null one is smallest), of equal doc_ids
as well one row stays; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.common import lookup, lower_ascii, written


def _class(rest: int) -> str:
    """A regex class of the characters up to U+024F whose code point leaves this rest modulo 8."""
    return "[" + "".join(f"\\x{{{c:x}}}" for c in range(rest, 0x250, 8)) + "]"


def cut_pattern(least: int = 512, most: int = 4096) -> str:
    """A chunk: ``least`` characters, then as few as reach a cut, ``most`` at most.

    A cut is behind three characters whose code points leave 5, 1 and 4 modulo 8.
    Text without cuts is chunked by length; equal texts get equal chunks anyway.
    """
    return f"(?s).{{{least}}}.{{0,{most - least}}}?(?<={_class(5)}{_class(1)}{_class(4)})|.{{1,{most}}}"


def normalised(docs: DataFrame, row_id: str | None = None) -> DataFrame:
    """doc_id, a row id (a column of docs, else made here), and the text that is compared."""
    own = F.col(row_id) if row_id else F.monotonically_increasing_id()
    return docs.select("doc_id", own.alias("row_id"), lower_ascii(F.coalesce("text", F.lit(""))).alias("norm"))


def chunk_store(norm: DataFrame, fingerprint: Callable[[Column], Column], pattern: str) -> DataFrame:
    """Each distinct chunk once: fp, chunk."""
    chunks = norm.select(F.explode(F.regexp_extract_all("norm", F.lit(pattern), F.lit(0))).alias("chunk"))
    return chunks.select(fingerprint(F.col("chunk")).alias("fp"), "chunk").distinct()


def recipes(docs: DataFrame, fingerprint: Callable[[Column], Column] = F.xxhash64, pattern: str | None = None, row_id: str | None = None) -> DataFrame:
    """doc_id, row_id, recipe (ordered verified identifiers), text_sha256. A written table."""
    pattern = pattern or cut_pattern()
    norm = normalised(docs, row_id)
    store = chunk_store(norm, fingerprint, pattern)
    shared = written(store.groupBy("fp").agg(F.count("*").alias("texts")).where("texts > 1").select("fp"), "clashes")
    pick = ["doc_id", "row_id", F.sha2("norm", 256).alias("text_sha256")]
    if shared.isEmpty():
        one = lambda c: F.struct(fingerprint(c).alias("fp"), F.lit(0).alias("nth"))
        return written(norm.select(*pick, F.transform(F.regexp_extract_all("norm", F.lit(pattern), F.lit(0)), one).alias("recipe")), "recipes")
    # Some fingerprint stands for several texts: number those, and take a chunk's number by its text.
    numbered = store.join(shared, "fp", "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("fp").orderBy("chunk")))
    parts = norm.select(*pick, F.posexplode_outer(F.regexp_extract_all("norm", F.lit(pattern), F.lit(0))).alias("pos", "chunk"))
    parts = parts.withColumn("fp", fingerprint(F.col("chunk"))).join(numbered, ["fp", "chunk"], "left")
    part = F.when(F.col("pos").isNotNull(), F.struct("pos", "fp", F.coalesce("nth", F.lit(0)).alias("nth")))
    listed = parts.groupBy("doc_id", "row_id", "text_sha256").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return written(listed.select("doc_id", "row_id", "text_sha256", F.transform("parts", lambda p: F.struct(p.fp.alias("fp"), p.nth.alias("nth"))).alias("recipe")), "recipes")


def groups(made: DataFrame) -> DataFrame:
    """One row per document of ``recipes``: the row that stays of its group, and the group's size."""
    same = made.groupBy("recipe").agg(F.max(F.struct("doc_id", "row_id")).alias("keep"), F.count("*").alias("group_size")).where("group_size > 1")
    out = lookup(made, same, ["recipe"])
    alone = F.col("keep").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep.row_id") == F.col("row_id"))).alias("kept"),
        "text_sha256",
        "row_id",
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    return groups(recipes(docs)).drop("row_id")


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
"""
