"""URL filters by a Bloom filter cascade (operator 11).

A list of domains is to be asked for every host of a corpus and for all parents
of each host; together these are the complete universe of keys that can ever be
asked. The first level is a Bloom filter of the listed keys. Those keys of the
universe that it lets through though they are not listed go to a second filter,
the listed ones that this one lets through to a third, and so on, until a level
lets nothing through. The level that first says no tells whether a key is
listed, without doubt for any key of the universe: no page is joined to
anything. A level's bits are set by tasks and combined in an aggregation; its
wrong keys are found by asking all that are left, so nothing but bits reaches
the driver, in proportion to the listed keys.

``rules`` come before the list: (verdict, host, path), each for its host and
the subdomains, if the path starts with the rule's; the longest that fits wins
(of equally long ones that with the longer host). They are a short list in the
call, and become part of the plan.

Bounds: a list of more than ``block_keys`` domains is taken in blocks, dealt by
hash; each block is a cascade of its own of at most a few bytes a key, sent to
all tasks, and all pages pass each block in turn.

Defined cases: a url that is null or has no :// has an empty host and path, fits
no rule and is in no list; no url is decoded; repeated pages are judged alike;
an empty table, list or rule list works; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import drop, lower_ascii, mapped, workers_see_package, written

#: The rules and words of the registered query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
WORDS = ("ads", "adult", "bets", "casino", "gambling", "pills", "porn", "spam", "xxx")
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    part = lambda k: F.coalesce(F.regexp_extract(url, URL, k), F.lit(""))
    return lower_ascii(part(1)), part(2)


def parents(host: Column) -> Column:
    """The host and every domain above it; none for an empty host."""
    labels = F.split(host, r"\.")
    all_ = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    return F.filter(all_, lambda d: d != "")


def first_rule(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, own, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(start))
        name, verdict = F.when(fits, own + start).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers, their bits well mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Level:
    """A Bloom filter over pairs of 64-bit hashes: ``bits`` bits, ``hashes`` places for a key; every level has places of its own."""

    def __init__(self, number: int, keys: int, rate: float) -> None:
        self.hashes = max(1, round(-math.log2(rate)))
        self.bits = 64 * max(1, math.ceil(keys * -math.log2(rate) / math.log(2) / 64))
        self.number, self.words = number, np.empty(0, np.uint64)

    def places(self, one: np.ndarray, two: np.ndarray) -> Iterator[np.ndarray]:
        salt = np.uint64(0x9E3779B97F4A7C15 * (self.number + 1) & 0xFFFFFFFFFFFFFFFF)
        at, step = mixed(one + salt), mixed(two + salt) | np.uint64(1)
        for _ in range(self.hashes):
            yield at % np.uint64(self.bits)
            at = at + step

    def set_bits(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words and the bits to set there, of some keys."""
        places = np.unique(np.concatenate(list(self.places(one, two))))
        word, start = np.unique(places >> np.uint64(6), return_index=True)
        return word, np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), start)

    def holds(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether each key may be in the filter."""
        out = np.ones(len(one), bool)
        for place in self.places(one, two):
            out &= (self.words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def listed_keys(levels: list[Level], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether each key of the universe is listed: whether the first level that lacks it has an odd number."""
    out, open_ = np.zeros(len(one), bool), np.arange(len(one))
    for level in levels:
        held = level.holds(one[open_], two[open_])
        out[open_[~held]] = level.number % 2 == 1
        open_ = open_[held]
    out[open_] = len(levels) % 2 == 1
    return out


def pair(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("one", "two"))


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("one"), F.xxhash64(key, F.lit(1)).alias("two")]


def universe(hosts: DataFrame, listed: DataFrame) -> DataFrame:
    """Each key once (key, listed): hosts with their parents, and the listed keys."""
    asked = hosts.select("host").distinct().select(F.explode(parents(F.col("host"))).alias("key"), F.lit(False).alias("listed"))
    named = listed.select(lower_ascii(F.col("key")).alias("key"), F.lit(True).alias("listed")).where("key <> ''")
    return asked.unionByName(named).groupBy("key").agg(F.bool_or("listed").alias("listed"))


def fit(keys: DataFrame, most_levels: int = 64) -> list[Level]:
    """The cascade of keys (their hashes one and two, listed), all distinct.

    A level lets through all its members and some others; the two change places
    at the next. Another level is needed as long as any other is let through.
    """
    spark, levels = keys.sparkSession, []
    left = keys.select("one", "two", "listed")
    while True:
        count = {r["listed"]: r["n"] for r in left.groupBy("listed").agg(F.count("*").alias("n")).collect()}
        own, others = count.get(len(levels) % 2 == 0, 0), count.get(len(levels) % 2 == 1, 0)
        if not own:
            if levels:
                drop(left)
            return levels
        if len(levels) == most_levels:
            raise ValueError("two keys, of which one is listed, have the same 128 bits of hash")
        rate = 0.5 if levels else min(0.5, max(2.0**-32, math.sqrt(0.5) * own / max(1, others)))
        level = Level(len(levels), own, rate)

        def bits_of(batches: Iterator[pa.RecordBatch], level: Level = level) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    word, bits = level.set_bits(*pair(batch))
                    yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

        members = left.where(F.col("listed") == F.lit(len(levels) % 2 == 0)).select("one", "two")
        made = mapped(members, bits_of, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        level.words = np.zeros(level.bits // 64, np.uint64)
        level.words[made["word"].to_numpy()] = made["bits"].to_numpy().view(np.uint64)
        held = spark.sparkContext.broadcast(level)

        def let_through(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(held.value.holds(*pair(batch))))

        before, left = left, written(mapped(left, let_through, "one long, two long, listed boolean"), f"level{len(levels)}")
        if levels:
            drop(before)
        levels.append(level)


def ask(pages: DataFrame, levels: list[Level], block: int, blocks: int) -> DataFrame:
    """pages with ``listed`` also true where the block's cascade holds one of their keys (arrays one, two)."""
    held = pages.sparkSession.sparkContext.broadcast(levels)
    place = pages.columns.index("listed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = batch.column("one"), batch.column("two")
            one, two = (a.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for a in arrays)
            owner = pa.compute.list_parent_indices(arrays[0]).to_numpy(zero_copy_only=False)
            own = (one >> np.uint64(1)) % np.uint64(blocks) == block
            hit = listed_keys(held.value, one[own], two[own])
            known = batch.column("listed").to_numpy(zero_copy_only=False).astype(bool)
            known[owner[own][hit]] = True
            yield batch.set_column(place, "listed", pa.array(known))

    return mapped(pages, run, pages.schema.simpleString().removeprefix("struct<").removesuffix(">"))


def judge(pages: DataFrame, listed: DataFrame, rules: Iterable[tuple[str, str, str]] = (), block_keys: int = 1 << 24) -> DataFrame:
    """page_id, host, path, rule and verdict of every page: the rule's, else block for hosts at or below a listed domain (listed: key)."""
    workers_see_package(pages.sparkSession)
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    keys = written(universe(rows, listed).select("listed", *hashes(F.col("key"))), "universe")
    blocks = max(1, -(-keys.where("listed").count() // block_keys))
    block_of = F.pmod(F.shiftrightunsigned(F.col("one"), 1), F.lit(blocks))
    name, says = first_rule(F.col("host"), F.col("path"), rules)
    own = parents(F.col("host"))
    arrays = [F.transform(own, lambda key: F.xxhash64(key)).alias("one"), F.transform(own, lambda key: F.xxhash64(key, F.lit(1))).alias("two")]
    rows = rows.select("page_id", "host", "path", name.alias("rule"), says.alias("says"), *arrays, F.lit(False).alias("listed"))
    for block in range(blocks):
        asked = ask(rows, fit(keys.where(block_of == block)), block, blocks)
        rows = asked if block == blocks - 1 else written(asked, "asked")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("says", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def listed_by_words(pages: DataFrame, words: Iterable[str] = WORDS) -> DataFrame:
    """A list made from the corpus itself: domains whose first label has one of the words between its hyphens."""
    host, _ = parts(F.col("url"))
    keys = pages.select(host.alias("host")).distinct().select(F.explode(parents(F.col("host"))).alias("key")).distinct()
    first = F.split(F.substring_index("key", ".", 1), "-")
    return keys.where(F.arrays_overlap(first, F.array(*map(F.lit, words))))


ORACLE = rf"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{URL}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages),
rules(says, own, start) AS (VALUES {", ".join(map(str, RULES))}),
fits AS (SELECT page_id, arg_max(own || start, length(own || start)) AS rule, arg_max(says, length(own || start)) AS says
  FROM p JOIN rules ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, start) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN list_has_any(string_split_regex(host, '[.-]'), {list(WORDS)}) THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN fits USING (page_id)
"""
