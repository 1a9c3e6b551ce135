"""Links from spans to the entities that they name.

The names are an Aho-Corasick automaton that runs over each span once, whatever
the number of names; those that do not fit one automaton of ``shard_names``
names are dealt by hash to several, each sent to all tasks in its own pass. A
name counts where no letter or digit stands next to it. Of names that overlap
the one that starts first is linked, of those that start together the longest;
what it covers is not linked again.

Defined cases: letters count as they are written; empty and null names are
none; repeated names are one; spans without text have no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.functions.workers import workers_see_package

FOUND = "path string, ordinal int, start int, stop int, name string"


def mentions(names: list[str], text: str, automaton: object) -> Iterator[tuple[int, int, str]]:
    """Start, end and name of the longest name at each place where one stands by itself."""
    best: dict[int, int] = {}
    for last, k in automaton.iter(text):
        start, stop = last + 1 - len(names[k]), last + 1
        if not (start and text[start - 1].isalnum()) and not (stop < len(text) and text[stop].isalnum()):
            best[start] = max(stop, best.get(start, 0))
    for start in sorted(best):
        yield start, best[start], text[start : best[start]]


def first_longest(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Of rows (path, ordinal, start, stop, name) in the order of place, longest first, those that do not reach into one before."""
    at, end = None, 0
    for row in rows:
        if row[:2] != at:
            at, end = row[:2], 0
        if row[2] >= end:
            end = row[3]
            yield row


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    columns = zip(*rows, strict=True) if rows else ((),) * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["path", "ordinal", "start", "stop", "name"])


def link(spans: DataFrame, names: DataFrame, shard_names: int = 50_000) -> DataFrame:
    """path, ordinal, start, stop (characters of the span), name of every link of spans (path, ordinal, text) to names (name)."""
    spark = spans.sparkSession
    workers_see_package(spark)
    wanted = names.where("name <> ''").select("name").distinct()
    shards = max(1, -(-wanted.count() // shard_names))
    found = None
    for shard in range(shards):
        own = wanted.where(F.pmod(F.xxhash64("name"), F.lit(shards)) == shard)
        held = spark.sparkContext.broadcast(sorted(r.name for r in own.toLocalIterator()))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for k, name in enumerate(held.value):
                automaton.add_word(name, k)
            automaton.make_automaton()
            for batch in batches:
                rows = zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
                all_ = ((p, o, *m) for p, o, text in rows if text and held.value for m in mentions(held.value, text, automaton))
                yield batch_of(list(first_longest(all_) if shards == 1 else all_))

        part = spans.select("path", F.col("ordinal").cast("int"), "text").mapInArrow(run, FOUND)
        found = part if found is None else found.unionByName(part)
    if shards == 1:
        return found

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = first_longest(r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        held = []
        for row in rows:
            held.append(row)
            if len(held) == 10_000:
                yield batch_of(held)
                held = []
        yield batch_of(held)

    order = ["path", "ordinal", F.col("start"), F.col("stop").desc()]
    return found.repartition("path", "ordinal").sortWithinPartitions(*order).mapInArrow(settled, FOUND)
