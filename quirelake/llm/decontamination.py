"""Benchmark decontamination by a distributed positional inverted index (operator 1).

The training documents are cut into segments of about ``segment_words`` words.
Each segment is a row of a written table: its documents, its terms, and each
term's postings (ascending word positions). A search ranks a phrase's terms by
their frequency in the whole index and intersects their postings, each shifted
by the term's place in the phrase, from the rarest on; what is left are exact
starts of the phrase, or, with ``slack``, places where every term lies within so
many words of its place. Phrases whose rarest term a segment lacks cost nothing
there.

The benchmark is the stated query set. It is taken in blocks of about
``block_bytes`` of text, each held against all documents; only terms that a
block asks for are stored for it. A block is kept as arrays of term numbers, 9
bytes a word and 13 a window, beside its vocabulary.

Defined cases: null texts have no words; phrases never cross documents; items
without words are never found; a null item_id is named by the empty string;
repeated rows are answered once each; an empty benchmark or table works; extra
columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import ASCII_UPPER, mapped, written

#: Word characters: digits, a-z, and everything beyond ASCII.
FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in bytes(range(256)).lower())
FOUND = "doc_id long, segment long, place int, n_words long, items array<string>, spans array<struct<start: int, stop: int>>"


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(FOLD).split()


@dataclass
class Phrases:
    """Windows of item words. terms: number of each word. stream: the items' words, one after another.
    start, length, owner: of each window its place in stream, its words, and its item. items: ids of each item."""

    terms: dict[bytes, int]
    stream: np.ndarray
    start: np.ndarray
    length: np.ndarray
    owner: np.ndarray
    items: list[list[str]]


def phrases_of(items: list[tuple[list[str], str | None]], window: int) -> Phrases:
    """All windows of items (ids, text); a shorter item is one window, one without words none."""
    terms: dict[bytes, int] = {}
    stream, start, length, owner, ids = array("i"), [np.zeros(0, np.int64)], [np.zeros(0, np.int8)], [np.zeros(0, np.int32)], []
    for own, text in items:
        words = words_of(text)
        if words:
            n = max(1, len(words) - window + 1)
            start.append(np.arange(n, dtype=np.int64) + len(stream))
            length.append(np.full(n, min(window, len(words)), dtype=np.int8))
            owner.append(np.full(n, len(ids), dtype=np.int32))
            stream.extend(terms.setdefault(w, len(terms)) for w in words)
            ids.append(own)
    return Phrases(terms, np.array(stream, dtype=np.int32), np.concatenate(start), np.concatenate(length), np.concatenate(owner), ids)


def build_index(docs: DataFrame, terms: set[bytes] | None = None, segment_words: int = 1_000_000) -> DataFrame:
    """Segments with postings of ``terms`` (None: of every term), not yet written.

    A document lies in one segment whole. Positions leave one place free between
    documents.
    """
    numbered = {t: k for k, t in enumerate(sorted(terms))} if terms is not None else None
    shared = docs.sparkSession.sparkContext.broadcast(numbered)

    def seal(segment: int, ids: list, sizes: list[int], parts: list[np.ndarray], known: dict[bytes, int]) -> pa.RecordBatch:
        stream = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        at = np.flatnonzero(stream >= 0).astype(np.int32)
        order = np.argsort(stream[at], kind="stable")
        present, counts = np.unique(stream[at], return_counts=True)
        names = list(known)
        cols = [
            pa.array([segment], pa.int64()),
            pa.array([ids], pa.list_(pa.int64())),
            pa.array([sizes], pa.list_(pa.int32())),
            pa.array([[names[k].decode("utf-8", "replace") for k in present.tolist()]], pa.list_(pa.string())),
            pa.array([counts.tolist()], pa.list_(pa.int32())),
            pa.array([at[order].astype("<i4").tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["segment", "doc_ids", "sizes", "terms", "counts", "postings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made, fixed = TaskContext.get().partitionId() << 24, 0, shared.value
        known: dict[bytes, int] = fixed if fixed is not None else {}
        ids, sizes, parts, total = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                if fixed is None:
                    for w in set(words):
                        known.setdefault(w, len(known))
                own = np.full(len(words) + 1, -1, dtype=np.int32)
                own[:-1] = [known.get(w, -1) for w in words]
                ids.append(doc_id)
                sizes.append(len(words))
                parts.append(own)
                total += len(own)
                if total >= segment_words:
                    yield seal(base + made, ids, sizes, parts, known)
                    ids, sizes, parts, total, made = [], [], [], 0, made + 1
                    known = fixed if fixed is not None else {}
        if ids:
            yield seal(base + made, ids, sizes, parts, known)

    schema = "segment long, doc_ids array<long>, sizes array<int>, terms array<string>, counts array<int>, postings binary"
    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def frequencies(index: DataFrame) -> DataFrame:
    """term, n: occurrences in the whole index."""
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("p"))
    return pairs.groupBy(F.col("p.terms").alias("term")).agg(F.sum("p.counts").alias("n"))


def shifted(postings: np.ndarray, starts: np.ndarray, place: int, slack: int) -> np.ndarray:
    """Those starts that have a posting at their place, give or take ``slack``."""
    k = np.searchsorted(postings, starts + (place - slack))
    near = postings[np.minimum(k, len(postings) - 1)]
    return starts[(k < len(postings)) & (near <= starts + (place + slack))]


def search(index: DataFrame, asked: Phrases, slack: int = 0) -> DataFrame:
    """Every document of a written index with the items found in it and the word spans they cover."""
    spark = index.sparkSession
    many = np.zeros(len(asked.terms), dtype=np.int64)
    if asked.terms:
        words = pa.table({"term": pa.array([w.decode("utf-8", "replace") for w in asked.terms]), "number": pa.array(np.arange(len(many)))})
        found = frequencies(index).join(spark.createDataFrame(words), "term").select("number", "n").toArrow()  # at most a block's terms
        many[found["number"].to_numpy()] = found["n"].to_numpy()
    # Of each window the place of its rarest term; windows with a term that no document has are out.
    least, place = np.full(len(asked.start), np.iinfo(np.int64).max), np.zeros(len(asked.start), dtype=np.int8)
    for k in range(int(asked.length.max(initial=0))):
        n = many[asked.stream[np.minimum(asked.start + k, len(asked.stream) - 1)]]
        rarer = (k < asked.length) & (n < least)
        least[rarer], place[rarer] = n[rarer], k
    rarest = asked.stream[asked.start + place] if len(place) else np.zeros(0, np.int32)
    use = np.flatnonzero(least > 0)
    use = use[np.argsort(rarest[use], kind="stable")]
    first = np.searchsorted(rarest[use], np.arange(len(many) + 1))
    names = {w.decode("utf-8", "replace"): k for w, k in asked.terms.items()}
    held = Phrases(names, asked.stream, asked.start[use], asked.length[use], asked.owner[use], asked.items)
    shared = spark.sparkContext.broadcast((held, many, first))  # a block of the benchmark

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield answer(*(batch.column(k)[row] for k in range(6)), *shared.value, slack)

    return mapped(index.select("segment", "doc_ids", "sizes", "terms", "counts", "postings"), run, FOUND)


def answer(segment, doc_ids, sizes, terms, counts, postings, asked: Phrases, many: np.ndarray, groups: np.ndarray, slack: int) -> pa.RecordBatch:
    """The rows of one segment. groups: where the windows of each rarest term begin."""
    sizes = np.array(sizes.as_py(), dtype=np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    ends = np.cumsum(counts.as_py(), dtype=np.int64)
    places = np.frombuffer(postings.as_py(), dtype="<i4").astype(np.int64)
    numbers = [asked.terms.get(t, -1) for t in terms.as_py()]
    lists = dict(zip(numbers, np.split(places, ends[:-1]) if len(ends) else [], strict=True))
    hit = np.zeros(int((sizes + 1).sum()), dtype=bool)
    found: list[set[int]] = [set() for _ in sizes]
    for rarest in numbers:
        for w in range(groups[rarest], groups[rarest + 1]) if rarest >= 0 else ():
            length = int(asked.length[w])
            phrase = asked.stream[asked.start[w] : asked.start[w] + length].tolist()
            order = sorted(range(length), key=lambda k: (many[phrase[k]], k))
            starts = lists[rarest] - order[0]
            for k in order[1:]:
                if not len(starts) or phrase[k] not in lists:
                    starts = starts[:0]
                    break
                starts = shifted(lists[phrase[k]], starts, k, slack)
            if not len(starts):
                continue
            doc = np.searchsorted(first, starts + order[0], side="right") - 1
            inside = np.ones(len(starts), dtype=bool) if not slack else (starts >= first[doc]) & (starts + length <= first[doc] + sizes[doc])
            starts, doc = starts[inside], doc[inside]
            hit[(starts[:, None] + np.arange(length)).ravel()] = True
            for d in np.unique(doc).tolist():
                found[d].add(int(asked.owner[w]))
    edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(first, lo, side="right") - 1
    spans: list[list[dict]] = [[] for _ in sizes]
    for d, a, b in zip(owner.tolist(), lo.tolist(), hi.tolist(), strict=True):
        spans[d].append({"start": a - int(first[d]), "stop": b - int(first[d])})
    n = len(sizes)
    cols = [
        pa.array(doc_ids.as_py(), pa.int64()),
        pa.array([segment.as_py()] * n, pa.int64()),
        pa.array(range(n), pa.int32()),
        pa.array(sizes, pa.int64()),
        pa.array([sorted({i for o in x for i in asked.items[o]}) for x in found], pa.list_(pa.string())),
        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "segment", "place", "n_words", "items", "spans"])


def block_phrases(items: DataFrame, window: int) -> Phrases:
    """Windows of the items; equal texts are one item with all their ids."""
    named = items.groupBy("text").agg(F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("ids"))
    return phrases_of([(r["ids"], r["text"]) for r in named.toLocalIterator()], window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, slack: int = 0, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted) and spans of every document."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    key = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = None
    for k in range(blocks):
        phrases = block_phrases(benchmark.where(key == k) if blocks > 1 else benchmark, window)
        index = written(build_index(docs, set(phrases.terms)), "postings")
        part = search(index, phrases, slack)
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        found = found.groupBy("segment", "place").agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
            joined(F.sort_array(F.flatten(F.collect_list("spans")))).alias("spans"),
        )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.stop - s.start)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.array_sort("items").alias("items"), "spans")


def joined(spans: Column) -> Column:
    """Sorted spans, those that overlap or touch made one."""

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        apart = (F.size(done) == 0) | (F.try_element_at(done, F.lit(-1)).stop < s.start)
        longer = F.struct(last.start.alias("start"), F.greatest(last.stop, s.stop).alias("stop"))
        return F.when(apart, F.concat(done, F.array(s))).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer)))

    return F.aggregate(spans, F.array().cast("array<struct<start: int, stop: int>>"), add)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM i WHERE len(w) > 0)),
pos AS (SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS g
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM win))),
hits AS (SELECT doc_id, s, k, item_id FROM pos JOIN win USING (k, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
