"""SimHash near-dedup over a Gray-order hierarchical index (operator 5).

Distinct fingerprints are sorted by Gray rank, so that neighbours share most
bits, and cut into leaves, whose number grows with the input. A node keeps the bit pattern that all below it have
in common; what its parent has already fixed is left out of its mask. A query
adds up its differences on the way down and drops a whole group as soon as they
exceed the limit. The levels above the leaves, one entry a leaf, route fingerprints to
leaves; each leaf's own tree is built and searched within its tasks.

Defined cases: null and empty texts have fingerprint zero, linked like any
other; texts of fewer words than a shingle hash as one; equal fingerprints are
one node of the graph, so copies are never paired; repeated rows share their
component; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import components, drop, lookup, mapped, written

LANES = np.uint64(0x0101010101010101)
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint_texts(texts: list[str | None], words: int = 3, seed: int = 42) -> np.ndarray:
    """A 64-bit fingerprint of each text's word shingles."""
    import xxhash

    digest = xxhash.xxh64_digest
    found: list[bytes] = []
    sizes = np.zeros(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        own = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both treat ASCII only
        if not own:
            continue
        joined = b" ".join(own)
        ends = np.cumsum(np.fromiter(map(len, own), dtype=np.int64, count=len(own)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        if len(own) <= words:
            found.append(digest(joined, seed))
            sizes[k] = 1
            continue
        pairs = zip(starts[: len(own) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
        found += [digest(joined[a:b], seed) for a, b in pairs]
        sizes[k] = len(own) - words + 1
    return majority(np.frombuffer(b"".join(found), dtype=">u8").astype(np.uint64), sizes)


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits set in over half of each group of successive hashes; zero for an empty group.

    Bits are counted eight to a word, over stretches of at most 255 hashes.
    """
    out = np.zeros(len(sizes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    starts = np.cumsum(n) - n
    per = -(-n // 255)
    first = np.cumsum(per) - per
    nth = np.arange(per.sum()) - np.repeat(first, per)
    cuts = np.repeat(starts, per) + 255 * nth
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & LANES, cuts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):  # little-endian: byte k holds bits 8k and up
            out[full] |= (2 * counts[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and fp, a signed long with the fingerprint's bits; columns of longs named in ``also`` come along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [fingerprint_texts(batch.column(1)[at : at + 512].to_pylist(), words, seed) for at in range(0, batch.num_rows, 512)]
            fp = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), *batch.columns[2:]], names=["doc_id", "fp", *also])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text", *also), run, "doc_id long, fp long" + "".join(f", {c} long" for c in also))


def gray_rank(fp: Column) -> Column:
    """Position in the Gray order, shifted so that signed order is the unsigned one."""
    r = fp
    for k in (1, 2, 4, 8, 16, 32):
        r = r.bitwiseXOR(F.shiftrightunsigned(r, k))
    return r.bitwiseXOR(F.lit(-(1 << 63)))


class Tree:
    """Nodes over entries in Gray order, level 0 topmost.

    values, masks: of each level's nodes, the masks without what the parents fix.
    The children of node i are nodes fan*i to fan*i+fan-1 of the next level.
    """

    def __init__(self, values: np.ndarray, masks: np.ndarray, fan: int = 8) -> None:
        self.fan, self.size = fan, len(values)
        levels = [(values, masks)]
        while len(levels[0][0]) > fan:
            v, m = levels[0]
            at = np.arange(0, len(v), fan)
            low, high = np.bitwise_and.reduceat(v | ~m, at), np.bitwise_or.reduceat(v & m, at)
            same = np.bitwise_and.reduceat(m, at) & ~(low ^ high)
            levels.insert(0, (low & same, same))
        self.levels = [levels[0]]
        for (v, m), (_, above) in zip(levels[1:], levels, strict=False):
            self.levels.append((v, m & ~np.repeat(above, fan)[: len(m)]))

    def search(self, queries: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query number, entry, differences within the common bits) of those that stay within the limit."""
        step = max(1, 2_000_000 // (self.fan * 64))
        for lo in range(0, len(queries), step):
            q = np.arange(lo, min(lo + step, len(queries)))
            node = np.tile(np.arange(len(self.levels[0][0])), len(q))
            q = np.repeat(q, len(self.levels[0][0]))
            far = np.zeros(len(q), dtype=np.int64)
            for k, (v, m) in enumerate(self.levels):
                if k:
                    q, far = np.repeat(q, self.fan), np.repeat(far, self.fan)
                    node = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                    real = node < len(v)
                    q, far, node = q[real], far[real], node[real]
                far = far + np.bitwise_count((queries[q] ^ v[node]) & m[node])
                near = far <= limit
                q, far, node = q[near], far[near], node[near]
            yield q, node, far


def links(fps: DataFrame, limit: int = 2, node_rows: int | None = None) -> DataFrame:
    """All pairs a < b of distinct fingerprints (column fp, unique) that differ in at most ``limit`` bits.

    A leaf has 2,048 to 131,072 fingerprints (``node_rows``), a 32nd of all in
    between, so that a query visits about as many leaves at any size until
    there are four million; beyond, leaves grow in number with the input. The
    tree above them has one entry a leaf: 24 bytes for each 131,072.
    """
    spark = fps.sparkSession
    ranked = fps.select("fp", gray_rank(F.col("fp")).alias("rank"))
    n = fps.count()
    most = node_rows or max(2048, min(131_072, n // 32))
    # A task takes four queries for each fingerprint of its leaf, so what is held twice stays below a quarter.
    per_task = 4 * most

    def seal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, seen = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            node = base + (seen + np.arange(batch.num_rows)) // most
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node)], names=["fp", "node"])

    ordered = ranked.repartitionByRange(max(1, -(-n // most)), "rank").sortWithinPartitions("rank")
    members = written(mapped(ordered, seal, "fp long, node long"), "members")
    common = members.groupBy("node").agg(F.bit_and("fp").alias("low"), F.bit_or("fp").alias("high")).orderBy("node").collect()  # one row a leaf
    ids = np.array([r["node"] for r in common], dtype=np.int64)
    low = np.array([r["low"] for r in common], dtype=np.int64).view(np.uint64)
    same = ~(low ^ np.array([r["high"] for r in common], dtype=np.int64).view(np.uint64))
    top = spark.sparkContext.broadcast((ids, Tree(low & same, same)))  # one entry a leaf

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ids, tree = top.value
            for q, entry, _ in tree.search(fp.view(np.uint64), limit):
                # A pair in two ranges is found from the one that is first.
                onward = ids[entry] >= own[q]
                q, node = q[onward], ids[entry[onward]]
                yield pa.RecordBatch.from_arrays([pa.array(fp[q]), pa.array(node), pa.array(node == own[q])], names=["fp", "node", "own"])

    routed = written(mapped(members, route, "fp long, node long, own boolean"), "routed")
    shares = F.broadcast(routed.groupBy("node").agg(F.ceil(F.count("*") / per_task).cast("int").alias("shares")))  # one row a leaf
    asked = routed.join(shares, "node").select(
        "node", F.pmod(F.xxhash64("fp"), F.col("shares")).cast("int").alias("share"), "fp", "own", F.lit(True).alias("query")
    )
    held = members.join(shares, "node").select(
        "node", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "fp", F.lit(True).alias("own"), F.lit(False).alias("query")
    )

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        ask = rows["query"].to_numpy(dtype=bool)
        held = rows["fp"].to_numpy()[~ask].view(np.uint64)
        rank = held.copy()
        for k in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(k)
        held = held[np.argsort(rank)]
        q, own = rows["fp"].to_numpy()[ask], rows["own"].to_numpy(dtype=bool)[ask]
        a, b = [], []
        for k, entry, _ in Tree(held, np.full(len(held), ALL)).search(q.view(np.uint64), limit):
            other = held[entry].view(np.int64)
            once = (q[k] != other) & (~own[k] | (q[k] < other))
            a.append(np.minimum(q[k], other)[once])
            b.append(np.maximum(q[k], other)[once])
        none = np.zeros(0, np.int64)
        return pd.DataFrame({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})

    return asked.unionByName(held).groupBy("node", "share").applyInPandas(find, "a long, b long")


def near_dedup(docs: DataFrame, words: int = 3, limit: int = 2, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable by links) of every row."""
    marked = written(fingerprints(docs, words, also=also), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    pairs = written(links(nodes.select("fp"), limit), "pairs")
    label = components(pairs).select(F.col("id").alias("fp"), "component")
    least = label.join(nodes, "fp").groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(lookup(label, least, ["component"]).select("fp", F.col("component_id").alias("linked")), "named")
    owner = nodes.join(named, "fp", "left").select("fp", F.coalesce("linked", "least").alias("component_id"))
    drop(pairs)
    return lookup(marked, owner, ["fp"])


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
