"""Near copies of the pipeline: texts whose sets of 5-word shingles overlap by 0.8 or more (Jaccard).

Operator 5 comes first: SimHash fingerprints of the shingles, searched for those
within 2 bits by its Gray-order index; texts of one fingerprint meet its
smallest id. At an overlap of 0.8 two fingerprints differ in about 10 of 64 bits
and now and then in 18, a radius at which the tree visits nearly all pairs. What
lies beyond 2 bits is found by ``BANDS`` keys of ``ROWS`` min-hashes each; a pair
of overlap 0.8 shares none of them once in about 10^7 pairs.

Only links between components matter. So of each key all members first meet its
centre, the member whose keys are the most common, so that variants of one text
meet the one that has changed least. Then keys whose members are not all in one
component are taken up again. In keys of up to ``CROWD`` members those outside the
largest component meet all of other components. The members of larger keys meet by
their rarest shingles instead: sets of n and m shingles that overlap enough share
0.8 of either, so, with all shingles in one order, the rarer first, they share one
of the first n - 0.8 n + 1 of the one and m - 0.8 m + 1 of the other, and, as they
share 0.8 / 1.8 (n + m), one of the first n + 1 and m + 1 less that. What all of a
crowd has in common stands last in that order. These keys are exact; of each, too,
all meet the centre first, and then those outside the largest component all of
other components. No link between components is left out that way.

Every candidate pair is checked on its whole shingle sets.

Defined cases: texts of fewer words than a shingle are one shingle; texts
without words are copies of each other; letters A-Z count as lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm import simhash
from quirelake.llm.common import components, drop, mapped, small, written

WORDS, OVERLAP = 5, 0.8
BANDS, ROWS = 32, 4
CROWD = 16


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; one zero for a text without words."""
    import xxhash

    own = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both treat ASCII only
    if not own:
        return np.zeros(1, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(own[k : k + words])) for k in range(max(1, len(own) - words + 1))], dtype=np.uint64))


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """For each set a row of BANDS * ROWS minima of independent hashes."""
    rng = np.random.default_rng(5)
    odd = rng.integers(0, 1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, size=BANDS * ROWS, dtype=np.uint64)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    every = np.concatenate(sets)
    out = np.empty((len(sets), BANDS * ROWS), dtype=np.uint32)
    for k in range(BANDS * ROWS):
        mixed = (every ^ add[k]) * odd[k]
        out[:, k] = np.minimum.reduceat((mixed >> np.uint64(32)).astype(np.uint32), starts)
    return out


def keys(docs: DataFrame) -> DataFrame:
    """id, n (its shingles), fp (their SimHash), and k: BANDS keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def key(sig: np.ndarray, band: int) -> np.ndarray:
            """Hashes of a band's min-hashes."""
            raw = np.ascontiguousarray(sig[:, band * ROWS : (band + 1) * ROWS]).tobytes()
            return np.array([xxhash.xxh64_intdigest(raw[k : k + ROWS * 4], band) for k in range(0, len(raw), ROWS * 4)], dtype=np.uint64).view(np.int64)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                sig = min_hashes(sets)
                own = pa.array(np.stack([key(sig, b) for b in range(BANDS)], axis=1).ravel())
                lists = pa.FixedSizeListArray.from_arrays(own, BANDS).cast(pa.list_(pa.int64()))
                n = np.array([len(s) for s in sets], dtype=np.int32)
                fp = simhash.majority(np.concatenate(sets), n.astype(np.int64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(fp), lists], names=["id", "n", "fp", "k"])

    return mapped(docs.select("id", "text"), run, "id long, n int, fp long, k array<long>")


def near_size() -> Column:
    """Whether two sets of n and m shingles are near enough in size."""
    return F.least("n", "m") >= OVERLAP * F.greatest("n", "m")


def ordered(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def by_fingerprint(marked: DataFrame) -> DataFrame:
    """Pairs of one fingerprint's smallest id and its others, and of the smallest ids of fingerprints within operator 5's limit."""
    nodes = written(marked.groupBy("fp").agg(F.min(F.struct("id", "n")).alias("o"), F.count("*").alias("size")).select("fp", "size", F.col("o.id").alias("least"), F.col("o.n").alias("m")), "nodes")
    same = marked.select("id", "n", "fp").join(nodes.where("size > 1"), "fp").where((F.col("id") != F.col("least")) & near_size())
    one, two = (nodes.select(F.col("fp").alias(c), F.col("least").alias(f"id_{c}"), F.col("m").alias(k)) for c, k in (("a", "n"), ("b", "m")))
    near = simhash.links(nodes.select("fp")).join(one, "a").join(two, "b").where(near_size())
    return ordered(same, F.col("id"), F.col("least")).unionByName(ordered(near, F.col("id_a"), F.col("id_b")))


def shared(rows: DataFrame) -> DataFrame:
    """key, id, n, turn and size of every key of rows (key, id, n, turn: the key's place among the id's, 0 if it does not count) that several have. A written table."""
    size = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return written(rows.join(size, "key"), "shared")


def stars(held: DataFrame) -> DataFrame:
    """Pairs of each member of a key with the key's centre, of those that may overlap enough."""
    common = held.groupBy("id").agg(F.sum("size").alias("common"))
    centre = held.join(common, "id").groupBy("key").agg(F.max(F.struct("common", F.xxhash64("id"), "id", "n")).alias("c")).select("key", F.col("c.id").alias("centre"), F.col("c.n").alias("m"))
    return ordered(held.join(centre, "key").where((F.col("id") != F.col("centre")) & near_size()), F.col("id"), F.col("centre"))


def mixed(held: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (with component) of the keys whose members are in several components. A written table."""
    told = held.join(small(labels), "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = told.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return written(told.join(several, "key", "left_semi"), "mixed")


def across(held: DataFrame) -> DataFrame:
    """Pairs of a key's members outside its largest component with all members of other components that may overlap enough by their sizes and the key's turn in both."""
    most = held.groupBy("key", "component").agg(F.count("*").alias("own")).groupBy("key").agg(F.max_by("component", F.struct("own", "component")).alias("largest"))
    outside = held.join(most, "key").where("component <> largest").select("key", F.col("id").alias("a"), "n", "turn", "component")
    other = held.select("key", F.col("id").alias("b"), F.col("n").alias("m"), F.col("turn").alias("turn_b"), F.col("component").alias("far"))
    least = F.ceil((F.col("n") + F.col("m")) * (OVERLAP / (1 + OVERLAP)) - 1e-6)
    first = (F.col("turn") <= F.col("n") - least + 1) & (F.col("turn_b") <= F.col("m") - least + 1)
    met = outside.join(other, "key").where((F.col("component") != F.col("far")) & near_size() & first)
    return ordered(met, F.col("a"), F.col("b"))


def rarest(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """key, id, n, turn: of the texts with these ids, those shingles one of which any two that overlap enough share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = shingles(text).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), own)), pa.array(np.full(len(key), len(key), np.int32))], names=["key", "id", "n"])

    every = written(mapped(docs.join(small(ids), "id", "left_semi").select("id", "text"), run, "key long, id long, n int"), "shingles", compression="zstd")
    held = every.groupBy("key").agg(F.count("*").alias("held"))
    turn = F.row_number().over(Window.partitionBy("id").orderBy("held", "key"))
    return every.join(held, "key").withColumn("turn", turn).where(F.col("turn") <= F.col("n") - F.ceil(F.col("n") * OVERLAP - 1e-6) + 1).select("key", "id", "n", "turn")


def alike(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, x, y) those whose texts x and y overlap enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = last_set = None
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if last_set is None or y != last:  # pairs come in the order of b
                    last, last_set = y, shingles(y)
                x, y = shingles(x), last_set
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= OVERLAP * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return mapped(pairs.select("a", "b", "x", "y"), run, "a long, b long")


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs (a, b) of a written table whose texts overlap enough; a written table."""
    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "asked")
    texts = written(docs.join(small(asked), "id", "left_semi").select("id", "text"), "texts", compression="zstd")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
    both = both.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    links = written(alike(both), "alike")
    drop(asked, texts)
    return links


def groups(docs: DataFrame) -> DataFrame:
    """id and component of every row of docs (id, text) that has a near copy."""
    marked = written(keys(docs), "keys")
    held = shared(marked.select(F.explode("k").alias("key"), "id", "n", F.lit(0).alias("turn")))
    pairs = written(by_fingerprint(marked).unionByName(stars(held)).distinct(), "first")
    labels = components(verified(docs, pairs))
    told = mixed(held, labels)
    drop(marked, held, pairs)
    labels = joined(docs, labels, across(told.where(F.col("size") <= CROWD)))
    crowd = written(told.where(F.col("size") > CROWD).select("id").distinct(), "crowd")
    drop(told)
    if not crowd.isEmpty():
        held = shared(rarest(docs, crowd))
        labels = joined(docs, labels, stars(held))
        told = mixed(held, labels)
        labels = joined(docs, labels, across(told))
        drop(held, told)
    drop(crowd)
    return labels


def joined(docs: DataFrame, labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Labels after those of the pairs that are near copies are joined as well."""
    pairs = written(pairs.distinct(), "candidates")
    links = verified(docs, pairs)
    drop(pairs)
    if links.isEmpty():
        return labels
    known = labels.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    return components(known.unionByName(links))
