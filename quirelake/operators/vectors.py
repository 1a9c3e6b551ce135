"""Vector retrieval: an inverted file with product quantisation, and the fusion of rankings.

Vectors (id, vector) are normalised; the most alike have the largest inner
product. A coarse codebook deals them to lists, and of what is left in each a
code of ``parts`` bytes is kept, one for each stretch of dimensions. A search
looks through the lists nearest to a query: inner products are read from a
table of each query's products with all codewords, and the ``shortlist`` best of
each query are scored again from the vectors themselves.

Codebooks are fitted on a sample of at most ``sample`` vectors, those of least
hash, by some rounds of k-means on the driver; every vector is indexed. Lists
are cut into blocks by a hash of the id, more blocks the more vectors there are,
so that a list with a third of all vectors is many blocks; queries come in
blocks too, and a task scores one block of vectors for one of queries.

Defined cases: vectors that are null, empty, of another length than most, or
without a direction are not found and find nothing; equal products go to the
smaller id; a vector does not find itself where ``others`` is set. Ids are unlike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.scratch import kept
from quirelake.functions.workers import workers_see_package

BLOCK, ASKED = 2_048, 256


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width)


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * rows @ centres.T, axis=1)


def means(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """k centres of rows by k-means; of fewer distinct rows than k, those rows."""
    distinct = np.unique(rows, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        own = nearest(rows, centres)
        count = np.bincount(own, minlength=k)
        total = np.stack([np.bincount(own, rows[:, d], k) for d in range(rows.shape[1])], axis=1)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres.astype(np.float32)


@dataclass
class Codes:
    """coarse: a centre for each list. fine: for each stretch of dimensions its codewords."""

    coarse: np.ndarray
    fine: list[np.ndarray]

    @property
    def width(self) -> int:
        return self.coarse.shape[1]

    def stretches(self) -> list[slice]:
        at = np.cumsum([0] + [f.shape[1] for f in self.fine])
        return [slice(a, b) for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and code of each row."""
        own = nearest(rows, self.coarse)
        rest = rows - self.coarse[own]
        return own, np.stack([nearest(rest[:, s], f) for s, f in zip(self.stretches(), self.fine, strict=True)], axis=1).astype(np.uint8)


@dataclass
class Index:
    """blocks: list, shard, ids, codes (bytes). vectors: id, vector, both of unit length."""

    codes: Codes | None
    blocks: DataFrame
    vectors: DataFrame


def unit(vectors: DataFrame, width: int | None = None) -> DataFrame:
    """id and vector of unit length, of those that have a direction and ``width`` dimensions, or else as many as most have."""
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = vectors.select("id", "vector", F.sqrt(square).alias("norm")).where("id IS NOT NULL AND norm > 0 AND norm < double('Infinity')")
    rows = kept(rows.select("id", F.transform("vector", lambda x: x / F.col("norm")).cast("array<float>").alias("vector")))
    if width is not None:
        return rows.where(F.size("vector") == width)
    common = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.col("rows").desc(), "n").first()
    return rows.where(F.size("vector") == (common["n"] if common else 0))


def fit(vectors: DataFrame, parts: int = 16, sample: int = 20_000) -> Codes | None:
    """Codebooks of unit vectors, on the sample of least hash; lists in proportion to the root of all vectors, 1,024 at most."""
    n = vectors.count()
    if not n:
        return None
    rows = np.array([r.vector for r in vectors.orderBy(F.xxhash64("id"), "id").limit(sample).collect()], dtype=np.float32)
    coarse = means(rows, int(min(1_024, max(1, n**0.5))))
    rest = rows - coarse[nearest(rows, coarse)]
    cuts = np.array_split(np.arange(rows.shape[1]), min(parts, rows.shape[1]))
    return Codes(coarse, [means(rest[:, c[0] : c[-1] + 1], 256, seed=k + 2) for k, c in enumerate(cuts)])


def build(vectors: DataFrame, parts: int = 16, sample: int = 20_000) -> Index:
    spark = vectors.sparkSession
    workers_see_package(spark)
    rows = unit(vectors)
    codes = fit(rows, parts, sample)
    held = spark.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, code = held.value.encode(matrix(batch.column(1), held.value.width))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], names=["id", "list", "code"])

    coded = rows.mapInArrow(run, "id long, list int, code binary")
    shards = max(1, rows.count() // (BLOCK * (len(codes.coarse) if codes else 1)))
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard")
    blocks = coded.groupBy("list", shard).agg(F.collect_list(F.struct("id", "code")).alias("rows"))
    return Index(codes, kept(blocks.select("list", "shard", F.col("rows.id").alias("ids"), F.col("rows.code").alias("codes"))), rows)


def best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def probes_for(index: Index, queries: DataFrame, recall: float = 0.95, k: int = 10, sample: int = 200) -> int:
    """How many lists hold so large a part of the true neighbours, as measured on the queries of least hash, at most ``sample``."""
    codes = index.codes
    if codes is None:
        return 1
    asked = kept(queries.orderBy(F.xxhash64("query"), "query").limit(sample))
    truth = exhaustive(index.vectors, asked, k, others=True).select("query", "id")
    met = truth.join(index.vectors.withColumnRenamed("vector", "x"), "id").join(unit(asked.select(F.col("query").alias("id"), "vector"), codes.width).withColumnsRenamed({"id": "query", "vector": "y"}), "query")
    held = queries.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for batch in batches:
            if batch.num_rows:
                own = nearest(matrix(batch.column(0), c.width), c.coarse)
                order = np.argsort(-(matrix(batch.column(1), c.width) @ c.coarse.T), axis=1, kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array(np.argmax(order == own[:, None], axis=1))], names=["place"])

    places = met.select("x", "y").mapInArrow(run, "place long").groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()
    total = sum(r.n for r in places)
    seen = 0
    for r in places:
        seen += r.n
        if seen >= recall * total:
            return r.place + 1
    return len(codes.coarse)


def search(index: Index, queries: DataFrame, k: int = 10, probes: int = 32, shortlist: int = 200, others: bool = False) -> DataFrame:
    """query, rank, id, score: the k vectors most alike to each query (query, vector), as far as its lists and shortlist hold them."""
    spark, codes = queries.sparkSession, index.codes
    if codes is None:
        return spark.createDataFrame([], "query long, rank int, id long, score double")
    held = spark.sparkContext.broadcast(codes)
    asked = unit(queries.select(F.col("query").alias("id"), "vector"), codes.width)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(-(matrix(batch.column(1), c.width) @ c.coarse.T), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["query", "vector", "lists"])

    probe = asked.mapInArrow(routed, "query long, vector array<float>, lists array<int>").select("query", "vector", F.explode("lists").alias("list"))
    group = F.pmod(F.xxhash64("query"), F.lit(max(1, asked.count() // ASKED))).alias("group")
    probe = probe.groupBy("list", group).agg(F.collect_list(F.struct("query", "vector")).alias("asked"))
    pairs = index.blocks.join(probe, "list").select("list", "ids", "codes", F.col("asked.query").alias("queries"), F.flatten("asked.vector").alias("vectors"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for batch in batches:
            for at, ids, code, who, flat in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                rows = np.array(flat, dtype=np.float32).reshape(len(who), c.width)
                code = np.frombuffer(b"".join(code), np.uint8).reshape(len(ids), len(c.fine))
                score = (rows @ c.coarse[at])[:, None] + sum((rows[:, s] @ f.T)[:, code[:, p]] for p, (s, f) in enumerate(zip(c.stretches(), c.fine, strict=True)))
                take = min(shortlist + 1, len(ids))
                top = np.argpartition(-score, take - 1, axis=1)[:, :take]
                ids = np.array(ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(who), take)), pa.array(ids[top].ravel()), pa.array(np.take_along_axis(score, top, 1).ravel().astype(np.float64))], names=["query", "id", "score"])

    found = pairs.mapInArrow(scored, "query long, id long, score double")
    found = best(found.where("query <> id") if others else found, shortlist).select("query", "id")
    exact = F.aggregate(F.zip_with("x", "y", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, p: s + p)
    met = found.join(index.vectors.withColumnRenamed("vector", "x"), "id").join(asked.select(F.col("id").alias("query"), F.col("vector").alias("y")), "query")
    return best(met.select("query", "id", exact.alias("score")), k).select("query", "rank", "id", "score")


def exhaustive(vectors: DataFrame, queries: DataFrame, k: int = 10, others: bool = False) -> DataFrame:
    """query, rank, id, score of the k vectors most alike, of all: blocks of queries are sent to every block of vectors."""
    rows = unit(vectors)
    first = rows.select(F.size("vector").alias("n")).first()
    asked = unit(queries.select(F.col("query").alias("id"), "vector"), first.n if first else 0)
    workers_see_package(vectors.sparkSession)
    group = F.pmod(F.xxhash64("id"), F.lit(max(1, asked.count() // ASKED))).alias("group")
    groups = asked.groupBy(group).agg(F.collect_list("id").alias("queries"), F.flatten(F.collect_list("vector")).alias("asked"))
    shard = F.pmod(F.xxhash64("id"), F.lit(max(1, rows.count() // BLOCK))).alias("shard")
    blocks = rows.groupBy(shard).agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("vector")).alias("vectors"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, flat, who, own in zip(*(batch.column(c).to_pylist() for c in ("ids", "vectors", "queries", "asked")), strict=True):
                x, y = np.array(flat).reshape(len(ids), -1), np.array(own).reshape(len(who), -1)
                if x.shape[1] != y.shape[1]:
                    continue
                score, ids, who = np.round(y @ x.T, 9), np.array(ids), np.array(who)
                if others:
                    score[who[:, None] == ids[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(who, order.shape[1])), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(score, order, 1).ravel())], names=["query", "id", "score"])

    # every block of the stated queries meets every block of vectors
    pairs = blocks.withColumn("shared", F.explode(F.sequence(F.lit(0), F.lit(max(1, asked.count() // ASKED) - 1)))).join(groups, F.col("shared") == F.col("group")).drop("shared", "group", "shard")
    return best(pairs.mapInArrow(run, "query long, id long, score double").where("score > double('-Infinity')"), k).select("query", "rank", "id", "score")


def fused(rankings: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """query, rank, item, score of the first k items by reciprocal rank fusion of rankings (query, rank, item), the more trusted first.

    Items that a ranking holds come before all that only later ones hold; among
    these the sum of 1 / (constant + rank) over the rankings decides, in millionths, then the item.
    """
    each = None
    for place, r in enumerate(rankings):
        part = r.select("query", "item", F.lit(place).alias("place"), F.floor(1_000_000 / (F.col("rank") + constant)).cast("long").alias("share"))
        each = part if each is None else each.unionByName(part)
    sums = each.groupBy("query", "item").agg(F.min("place").alias("place"), F.sum("share").alias("score"))
    order = Window.partitionBy("query").orderBy("place", F.col("score").desc(), "item")
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "item", "place", "score")
