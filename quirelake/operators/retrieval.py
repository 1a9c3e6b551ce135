"""Lexical retrieval: the best spans for each query, by BM25, without scoring every span.

An index holds, for each term, its postings in blocks of like impact: the
impacts of a block differ little, and its largest is stored beside it. A block
holds postings of one term and one level of impact among spans that are numbered
close together (neighbours), so that no group of postings grows with the
collection, however common its term, and a task makes the blocks of its own
spans. Blocks of the same neighbours meet in one
group, for up to ``QUERIES`` queries at a time, and are added up there as arrays.

A search starts with each term's best level of blocks to learn, for each query,
a score that k spans reach (the floor). Then, in each group, a query all of whose
terms' largest impacts together stay below the floor opens nothing; terms that
stay below it together cannot bring a span in on their own, and are looked up
only at the spans that the others found, for as long as these can still reach
the floor. Each group gives at most its k best spans of each query. The result
equals that of scoring everything: scores are sums of whole numbers, ties go by
path and ordinal.

    weight(term) = floor(1024 ln(1 + (N - df + 0.5) / (df + 0.5)))
    impact(term, span) = floor(1024 tf 2.2 / (tf + 1.2 (0.25 + 0.75 length / mean length)))
    score(query, span) = sum of weight * impact over the query's distinct terms
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.scratch import kept
from quirelake.functions.text import ASCII_UPPER
from quirelake.functions.workers import workers_see_package
from quirelake.operators.parse import SPAN_TYPES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(ASCII_UPPER, ASCII_UPPER.lower())
#: Levels of impact are so wide; a block spans at most 2**NEAR neighbouring span numbers.
LEVEL, NEAR = 128, 14
#: About so many queries are added up together over the same neighbours.
QUERIES = 256
#: A task makes blocks of about so many postings at a time.
HELD = 500_000
TEXT_TYPES = tuple(t for t in SPAN_TYPES if t != "scene")


def counted(rows: DataFrame) -> DataFrame:
    """The columns of rows with length and terms (term, tf) in place of text, its last one."""
    workers_see_package(rows.sparkSession)
    *keys, _ = rows.schema.fields
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(WORD.findall((t or "").translate(LOWER))) for t in batch.column(batch.num_columns - 1).to_pylist()]
            cuts = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            term = pa.array([t for c in found for t in c], pa.string())
            tf = pa.array([n for c in found for n in c.values()], pa.int64())
            terms = pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([term, tf], names=["term", "tf"])).cast(kind)
            length = pa.array([sum(c.values()) for c in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], length, terms], names=[*(f.name for f in keys), "length", "terms"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)
    return rows.mapInArrow(run, f"{own}, length long, terms array<struct<term: string, tf: long>>")


@dataclass
class Index:
    """terms: term, weight, top (its largest impact). blocks: term, level, near, top, postings (span, impact). spans: span, path, ordinal; neighbours are numbered in the order of path and ordinal."""

    terms: DataFrame
    blocks: DataFrame
    spans: DataFrame


def blocked(rows: DataFrame, mean: float) -> DataFrame:
    """Blocks of rows (span, length, terms), each of one term, level of impact and group of neighbours; a group that lies in several tasks has blocks from each."""
    near, wide, most = NEAR, LEVEL, HELD

    def made(held: list[tuple]) -> pa.RecordBatch:
        span, length, tf = (np.concatenate([x[k] for x in held]) for k in range(3))
        coded = pa.chunked_array([x[3] for x in held]).combine_chunks().dictionary_encode()
        tf = tf.astype(float)
        impact = np.floor(tf * 2.2 / (tf + (length / mean * 0.75 + 0.25) * 1.2) * 1024).astype(np.int64)
        key = np.stack([coded.indices.to_numpy(), impact // wide, span >> near])
        order = np.lexsort((span, *key[::-1]))
        key, span, impact = key[:, order], span[order], impact[order]
        first = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
        postings = pa.StructArray.from_arrays([pa.array(span), pa.array(impact)], names=["span", "impact"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(span)], pa.int32()), postings)
        columns = [coded.dictionary.take(pa.array(key[0, first])), pa.array(key[1, first], pa.int32()), pa.array(key[2, first]), pa.array(np.maximum.reduceat(impact, first)), lists]
        return pa.RecordBatch.from_arrays(columns, names=["term", "level", "near", "top", "postings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            span, length = (batch.column(k).to_numpy() for k in range(2))
            many, flat = pc.list_value_length(batch.column(2)).to_numpy(), batch.column(2).flatten()
            if len(flat):
                held.append((np.repeat(span, many), np.repeat(length, many), flat.field("tf").to_numpy(), flat.field("term")))
                size += len(flat)
            if size >= most:
                yield made(held)
                held, size = [], 0
        if held:
            yield made(held)

    return rows.select("span", "length", "terms").mapInArrow(run, "term string, level int, near long, top long, postings array<struct<span: long, impact: long>>")


def build(spans: DataFrame) -> Index:
    """The index of spans (path, ordinal, span_type, text)."""
    rows = counted(spans.where(F.col("span_type").isin(*TEXT_TYPES)).select("path", "ordinal", "text"))
    rows = rows.sortWithinPartitions("path", "ordinal").select(F.monotonically_increasing_id().alias("span"), "path", "ordinal", "length", "terms")
    rows = kept(rows, compression="zstd")
    n, mean = rows.agg(F.count("*"), F.avg("length")).first()
    blocks = kept(blocked(rows, mean or 1.0), compression="zstd")
    df = F.sum(F.size("postings")).cast("double")
    weight = F.floor(F.ln((F.lit(float(n)) - df + 0.5) / (df + 0.5) + 1) * 1024).cast("long")
    terms = kept(blocks.groupBy("term").agg(weight.alias("weight"), F.max("top").alias("top")))
    return Index(terms, blocks, rows.select("span", "path", "ordinal"))


def best(scored: DataFrame, k: int, *ties: str) -> DataFrame:
    """The k highest scores of each query, with their rank; ties go by the given columns."""
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def tops(spans: list[np.ndarray], impacts: list[np.ndarray], asks: list[list[tuple[int, int]]], floors: dict[int, int], k: int) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """Queries, and of each the k best spans and scores (of equal ones the first span) of those that reach its floor.

    Term j's postings are spans[j] (numbers among neighbours, in order) and
    impacts[j]; asks[j] are the queries and weights it is asked with.
    """
    wide = 1 + max(int(x.max()) for x in spans)
    highest = [int(x.max()) for x in impacts]
    own: dict[int, list[tuple[int, int, int]]] = {}
    for j, asked in enumerate(asks):
        for query, weight in asked:
            own.setdefault(query, []).append((weight * highest[j], weight, j))
    out: tuple[list, list, list] = ([], [], [])
    for query, terms in own.items():
        floor, rest = floors[query], sum(most for most, _, _ in terms)
        if rest < floor:
            continue
        score, met, found = np.zeros(wide, np.int64), np.zeros(wide, bool), None
        for most, weight, j in sorted(terms, reverse=True):
            if found is None and rest < floor:
                # What is left brings no span in on its own.
                found = np.flatnonzero(met)
            if found is None:
                score[spans[j]] += weight * impacts[j]
                met[spans[j]] = True
            else:
                found = found[score[found] + rest >= floor]
                if not len(found):
                    break
                at = np.minimum(np.searchsorted(spans[j], found), len(spans[j]) - 1)
                score[found] += weight * np.where(spans[j][at] == found, impacts[j][at], 0)
            rest -= most
        found = np.flatnonzero(met) if found is None else found
        found = found[score[found] >= floor]
        if len(found) > k:
            least = np.partition(score[found], -k)[-k]
            found = found[score[found] >= least]
            found = found[np.argsort(-score[found], kind="stable")[:k]]
        if len(found):
            out[0].append(query)
            out[1].append(found)
            out[2].append(score[found])
    return out


def scored(blocks: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query, span, score: the k best spans of each query and group of neighbours by the given blocks, of those that reach the query's floor.

    asked: part, query, term, weight, floor; a part's queries are added up together.
    """
    workers_see_package(blocks.sparkSession)
    plan = asked.groupBy("term", "part").agg(F.collect_list(F.struct("query", "weight", "floor")).alias("asks"))
    rows = blocks.select("term", "near", "postings").join(plan, "term")
    near = NEAR

    def run(table: pa.Table) -> pa.Table:
        first = int(table.column("near")[0].as_py()) << near
        held = table.column("postings").combine_chunks()
        sizes, flat = pc.list_value_length(held).to_numpy(zero_copy_only=False), held.flatten()
        number, impact = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("span", "impact"))
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        names: dict[str, list[int]] = {}
        for at, term in enumerate(table.column("term").to_pylist()):
            names.setdefault(term, []).append(at)
        spans, impacts, asks, floors = [], [], [], {}
        for ats in names.values():
            own = np.concatenate([number[cuts[at] : cuts[at + 1]] for at in ats]) - first
            order = np.argsort(own)
            spans.append(own[order])
            impacts.append(np.concatenate([impact[cuts[at] : cuts[at + 1]] for at in ats])[order])
            told = table.column("asks")[ats[0]].as_py()
            asks.append([(a["query"], a["weight"]) for a in told])
            floors |= {a["query"]: a["floor"] for a in told}
        query, span, score = tops(spans, impacts, asks, floors, k)
        none = np.zeros(0, np.int64)
        return pa.table({
            "query": pa.array(np.repeat(np.array(query, np.int64), [len(x) for x in span])),
            "span": pa.array(np.concatenate([none, *span]) + first),
            "score": pa.array(np.concatenate([none, *score])),
        })

    return rows.groupBy("near", "part").applyInArrow(run, "query long, span long, score long")


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """query, rank, path, ordinal, score: the k best spans of each query (query, a whole number, and text), of those with a word of it.

    Query ids are unlike. No row is made for a query and a span but for the k
    best of each group of neighbours.
    """
    own = counted(queries.select(F.col("query").cast("long"), "text"))
    asked = own.select("query", F.explode("terms.term").alias("term")).join(index.terms, "term")
    parts = F.lit(max(1, -(-queries.count() // QUERIES)))
    asked = kept(asked.select("query", "term", "weight", "top", F.pmod(F.xxhash64("query"), parts).alias("part"), F.lit(0).cast("long").alias("floor")))
    # The floor: the k-th best sum over each term's best level of blocks.
    best_level = asked.select("term", (F.col("top") / LEVEL).cast("int").alias("level")).distinct()
    first = scored(index.blocks.join(best_level, ["term", "level"], "left_semi"), asked, k)
    floor = best(first, k, "span").where(F.col("rank") == k).select("query", F.col("score").alias("reached"))
    bound = kept(asked.join(floor, "query", "left").withColumn("floor", F.coalesce("reached", "floor")).drop("reached"))
    found = kept(scored(index.blocks, bound, k)).join(index.spans, "span")
    return best(found, k, "path", "ordinal").select("query", "rank", "path", "ordinal", "score")
