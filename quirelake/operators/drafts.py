"""Draft changes: line differences as hunks, their acceptance, and where stored ranges lie afterwards.

A hunk is a run of lines of the old text that others take the place of: path,
hunk (in order), start and stop (old lines, from 0), the characters from
start_char up to end_char that they take in the old text, and new_text, which
comes in their place. Texts are lists of lines, each with its line feed but for
the last, so that any text is told whole.

The difference of two texts is a shortest one (Myers' greedy search between the
common first and last lines); where it would take more than ``most`` edits, what
lies between is one hunk. Texts are compared one pair at a time, whatever their
number; ranges are moved by running sums over the hunks of their document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.workers import workers_see_package

#: Characters of hunks, with 100 for each hunk's other columns, that a task gathers before it hands them on.
HELD = 1 << 20
HUNKS = "path string, hunk int, start int, stop int, start_char long, end_char long, new_text string"


def matches(a: list[str], b: list[str], most: int) -> list[tuple[int, int]] | None:
    """Places of equal lines on a shortest way from a to b; None where that takes more than ``most`` edits."""
    ends, before = {1: 0}, []
    for d in range(min(most, len(a) + len(b)) + 1):
        before.append(dict(ends))
        for k in range(-d, d + 1, 2):
            x = ends.get(k + 1, 0) if k == -d or (k != d and ends.get(k - 1, -1) < ends.get(k + 1, -1)) else ends[k - 1] + 1
            while x < len(a) and x - k < len(b) and a[x] == b[x - k]:
                x += 1
            ends[k] = x
            if x >= len(a) and x - k >= len(b):
                return walked(before, x, k, d)
    return None


def walked(before: list[dict[int, int]], x: int, k: int, d: int) -> list[tuple[int, int]]:
    out = []
    for step in range(d, -1, -1):
        ends = before[step]
        down = k == -step or (k != step and ends.get(k - 1, -1) < ends.get(k + 1, -1))
        last = k + 1 if down else k - 1
        begin = (ends.get(last, 0) if down else ends[last] + 1) if step else 0
        while x > begin:
            x -= 1
            out.append((x, x - k))
        x, k = ends.get(last, 0), last
    return out[::-1]


def hunks_of(old: str, new: str, most: int) -> Iterator[tuple[int, int, int, int, str]]:
    """start, stop, start_char, end_char, new_text of each hunk."""
    a, b = old.split("\n"), new.split("\n")
    a, b = ([x + "\n" for x in s[:-1]] + s[-1:] for s in (a, b))
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    inner = matches(a[head : len(a) - tail], b[head : len(b) - tail], most) or []
    same = [(x + head, y + head) for x, y in inner] + [(len(a) - tail, len(b) - tail)]
    x = y = head
    at = sum(map(len, a[:head]))
    for i, j in same:
        if i > x or j > y:
            size = sum(map(len, a[x:i]))
            yield x, i, at, at + size, "".join(b[y:j])
            at += size
        if i < len(a):
            at += len(a[i])
        x, y = i + 1, j + 1


def diff(pairs: DataFrame, most: int = 2_000) -> DataFrame:
    """HUNKS of pairs (path, old, new); a null text is empty."""
    workers_see_package(pairs.sparkSession)

    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], names=["path", "hunk", "start", "stop", "start_char", "end_char", "new_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One pair of texts is a Python object at a time, and hunks leave once they hold HELD characters.
        for batch in batches:
            rows, size = [], 0
            for p, o, n in zip(*batch.columns, strict=True):
                path = p.as_py()
                for k, h in enumerate(hunks_of(o.as_py() or "", n.as_py() or "", most)):
                    rows.append((path, k, *h))
                    size += 100 + len(h[-1])
                    if size >= HELD:
                        yield batch_of(rows)
                        rows, size = [], 0
            yield batch_of(rows)

    return pairs.select("path", "old", "new").mapInArrow(run, HUNKS)


def applied(texts: DataFrame, hunks: DataFrame) -> DataFrame:
    """path and text of texts (path, old) once the hunks given have been accepted; all others stay as they were."""
    listed = hunks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_char", "hunk", "end_char", "new_text"))).alias("hunks"))
    old = F.coalesce("old", F.lit(""))
    part = lambda a, b: F.substring(old, (a + 1).cast("int"), (b - a).cast("int"))
    done = F.aggregate(
        F.coalesce("hunks", F.array().cast("array<struct<start_char: bigint, hunk: int, end_char: bigint, new_text: string>>")),
        F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")),
        lambda s, h: F.struct(F.concat(s.text, part(s.at, h.start_char), h.new_text).alias("text"), h.end_char.alias("at")),
        lambda s: F.concat(s.text, part(s.at, F.char_length(old).cast("long"))),
    )
    return texts.join(listed, "path", "left").select("path", done.alias("text"))


def moved(ranges: DataFrame, hunks: DataFrame) -> DataFrame:
    """Ranges (path, start_char, end_char, and any others) with new_start and new_end after the hunks given; null, for stale, where a hunk reaches into one.

    Hunks and ranges of a document are put in one order of place. A range is
    moved by what the hunks add that end before or where it starts, and stale if
    more hunks than these start before it ends.
    """
    names = [c for c in ranges.columns if c not in ("path", "start_char", "end_char")]
    event = lambda at, turn, opened, closed, add: F.struct(at.alias("at"), F.lit(turn).alias("turn"), F.lit(opened).alias("opened"), F.lit(closed).alias("closed"), add.alias("add"))
    start, end, none = F.col("start_char"), F.col("end_char"), F.lit(0).cast("long")
    grown = F.char_length("new_text").cast("long") - (end - start)
    edits = hunks.select("path", F.explode(F.array(event(start, 1, 1, 0, none), event(end, 2, 0, 1, grown))).alias("e")).select("path", "e.*")
    held = ranges.select("path", F.monotonically_increasing_id().alias("row"), "start_char", "end_char", F.struct(F.lit(0).alias("_"), *names).alias("rest"))
    asked = held.select("*", F.explode(F.array(event(end, 0, 0, 0, none), event(start, 3, 0, 0, none))).alias("e")).select("path", "row", "start_char", "end_char", "rest", "e.*")
    so_far = Window.partitionBy("path").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = asked.unionByName(edits, allowMissingColumns=True)
    sums = every.select("path", "row", "start_char", "end_char", "rest", "turn", *(F.sum(c).over(so_far).alias(c) for c in ("opened", "closed", "add"))).where("row IS NOT NULL")
    at = lambda turn, c: F.max(F.when(F.col("turn") == turn, F.col(c)))
    out = sums.groupBy("path", "row", "start_char", "end_char").agg(F.first("rest").alias("rest"), at(0, "opened").alias("opened"), at(3, "closed").alias("closed"), at(3, "add").alias("add"))
    fresh = F.col("opened") <= F.col("closed")
    return out.select("path", "start_char", "end_char", *(F.col(f"rest.{c}").alias(c) for c in names), F.when(fresh, start + F.col("add")).alias("new_start"), F.when(fresh, end + F.col("add")).alias("new_end"))
