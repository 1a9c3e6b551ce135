"""Removal of byte strings that repeat anywhere, by a hash-compared suffix sort (operator 6).

A string of ``length`` bytes that starts in two places is removed in both. The
corpus cannot be sorted by suffixes in one place, so suffixes are dealt out by
an anchor: the least hashed 32-gram inside each window of ``length`` bytes, the
leftmost of equals. Equal windows have equal anchors, so every repeat meets in
one group, and about one byte position in ``length`` / 2 is an anchor.

Anchors whose whole context (all windows that share the anchor) is equal, known
by a cryptographic digest, are one entry; an anchor hash seen once cannot
repeat. In a group, the texts to the right of the anchor and, reversed, to its
left are sorted by a mergesort that compares two suffixes by binary search over
prefix polynomial hashes; adjacent common extensions are then verified byte by
byte. A window that starts j bytes before the anchor repeats where another
entry agrees for j bytes to the left and the rest to the right: both orders,
cut where the extension is shorter, give classes, and a pair of classes held
twice is a repeat.

A group whose different contexts take more than ``group_bytes`` is dealt anew
by the next least 32-gram of each window, and so on: windows that are equal stay
together, and those that differ part sooner or later.

Repeats are first looked for at ``passage`` bytes. That tells which passages of
over ``passage_words`` words repeat, and which documents can hold a longer
repeat at all: only those are searched for strings of ``length`` bytes.

Defined cases: null text is empty; texts shorter than ``length`` stay whole;
matches never cross documents; repeated rows repeat each other; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import drop, mapped, small, written

GRAM = 32
#: Bytes handled at once; positions inside must fit the low bits that break ties.
FLAT = 1 << 19
LOW = np.uint64((1 << 20) - 1)
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


UP, DOWN = powers(BASE, FLAT + 1024), powers(BACK, FLAT + 1024)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each GRAM bytes, from prefix sums of a polynomial modulo 2**64."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(TABLE[data] * UP[: len(data)])])
    h = (sums[GRAM:] - sums[:-GRAM]) * DOWN[: len(data) - GRAM + 1]
    h ^= h >> np.uint64(29)
    h *= MIX
    h ^= h >> np.uint64(32)
    return h


def least_positions(h: np.ndarray, width: int) -> np.ndarray:
    """For each full window of ``width`` hashes, the position of the least one, leftmost of equals."""
    n = len(h)
    key = (h & ~LOW) | np.arange(n, dtype=np.uint64)
    pad = -n % width
    rows = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[: n - width + 1], ahead[width - 1 : n]) & LOW).astype(np.int64)


def flat_anchors(data: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchor position, first and last window start, hash; of the windows that ``valid`` marks."""
    h = gram_hashes(data)
    at = least_positions(h, length - GRAM + 1)
    start = np.flatnonzero(valid)
    p = at[start]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p))[: len(first)] - 1
    return p[first], start[first], start[last], h[p[first]]


def anchors(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text an array of rows (anchor, first window, last window, anchor hash)."""
    out: list[list[np.ndarray]] = [[] for _ in texts]

    def flush(own: list[tuple[int, int, int]]) -> None:
        """own: (text, first byte, end) of the stretches taken together."""
        if not own:
            return
        data = np.frombuffer(b"".join(texts[k][a:b] for k, a, b in own), dtype=np.uint8)
        valid = np.zeros(len(data) - length + 1, dtype=bool)
        sizes = np.array([b - a for _, a, b in own])
        base = np.cumsum(sizes) - sizes
        for o, n in zip(base.tolist(), sizes.tolist(), strict=True):
            valid[o : o + n - length + 1] = True
        p, lo, hi, h = flat_anchors(data, valid, length)
        owner = np.searchsorted(base, p, side="right") - 1
        cuts = np.searchsorted(owner, np.arange(len(own) + 1))
        for j, (k, a, _) in enumerate(own):
            s = slice(cuts[j], cuts[j + 1])
            move = a - base[j]
            out[k].append(np.stack([p[s] + move, lo[s] + move, hi[s] + move, h[s].view(np.int64)], axis=1))

    own, total = [], 0
    for k, text in enumerate(texts):
        n = len(text)
        if n < length:
            continue
        step = FLAT - length
        for a in range(0, n - length + 1, step):
            b = min(n, a + step + length - 1)
            if total + b - a > FLAT:
                flush(own)
                own, total = [], 0
            own.append((k, a, b))
            total += b - a
    flush(own)
    none = np.zeros((0, 4), dtype=np.int64)
    return [np.concatenate(x) if x else none for x in out]


def digests(parts: Iterator[tuple[bytes, int]]) -> np.ndarray:
    """128 bits of the SHA-256 of each (bytes, offset), as rows of two longs."""
    sha = hashlib.sha256
    return np.frombuffer(b"".join([sha(off.to_bytes(4, "little") + t).digest()[:16] for t, off in parts]), dtype=">i8").astype(np.int64).reshape(-1, 2)


def anchored(docs: DataFrame, length: int) -> DataFrame:
    """Each row of docs (row_id, doc_id, text) with its text's anchors and digests of their contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(2).to_pylist()]
                found = anchors(texts, length)
                marks = ((t[a : b + length], p - a) for t, x in zip(texts, found, strict=True) for p, a, b in x[:, :3].tolist())
                flat = np.concatenate(found)
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                cols = [*flat.T, *digests(marks).T]
                kinds = [np.int32, np.int32, np.int32, np.int64, np.int64, np.int64]
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(c).astype(k))) for c, k in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *lists], names=["row_id", "doc_id", "text", "at", "lo", "hi", "kh", "c1", "c2"])

    schema = "row_id long, doc_id long, text string, at array<int>, lo array<int>, hi array<int>, kh array<long>, c1 array<long>, c2 array<long>"
    return mapped(docs.select("row_id", "doc_id", "text"), run, schema)


class Suffixes:
    """Texts of at most ``width`` bytes, each in a group, sorted by hash comparison."""

    def __init__(self, texts: list[bytes], group: np.ndarray, width: int) -> None:
        self.n, self.group = len(texts), group
        self.size = np.fromiter(map(len, texts), dtype=np.int64, count=self.n)
        self.bytes = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), dtype=np.uint8).reshape(self.n, width)
        sums = np.cumsum(TABLE[self.bytes] * UP[:width], axis=1)
        self.hashes = np.concatenate([np.zeros((self.n, 1), np.uint64), sums], axis=1)
        self.width = width

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefix by binary search over prefix hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b])
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.hashes[a, mid] == self.hashes[b, mid]
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a comes before b: by group, first different byte, length, number."""
        lcp = self.common(a, b)
        at = np.minimum(lcp, self.width - 1)
        ended = (lcp == self.size[a]) | (lcp == self.size[b])
        by_text = np.where(ended, np.where(self.size[a] != self.size[b], self.size[a] < self.size[b], a < b), self.bytes[a, at] < self.bytes[b, at])
        return np.where(self.group[a] != self.group[b], self.group[a] < self.group[b], by_text)

    def sorted(self) -> np.ndarray:
        """Mergesort, all merges of a level together: an entry's place is its own rank plus its rank in the other run."""
        order = np.arange(self.n)
        run = 1
        while run < self.n:
            place = np.arange(self.n)
            block = place // (2 * run) * (2 * run)
            mid = np.minimum(block + run, self.n)
            left = place < mid
            other = np.where(left, mid, block)
            low, high = other.copy(), np.where(left, np.minimum(block + 2 * run, self.n), mid)
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                m = (low[open_] + high[open_]) >> 1
                less = self.before(order[m], order[open_])
                low[open_] = np.where(less, m + 1, low[open_])
                high[open_] = np.where(less, high[open_], m)
            to = np.where(left, place, place - (mid - block)) + (low - other)
            merged = np.empty_like(order)
            merged[to] = order
            order, run = merged, 2 * run
        return order

    def ordered(self) -> tuple[np.ndarray, np.ndarray]:
        """The order and each entry's verified common prefix with the one before it (-1: another group)."""
        order = self.sorted()
        for _ in range(2):
            lcp = np.full(self.n, -1, dtype=np.int64)
            a, b = order[:-1], order[1:]
            real = self.verified(a, b)
            if (real == self.common(a, b)).all():
                break
            # Two different texts share a hash: sort by the bytes themselves.
            keys = [(g, t[:s]) for g, t, s in zip(self.group.tolist(), map(bytes, self.bytes), self.size.tolist(), strict=True)]
            order = np.array(sorted(range(self.n), key=keys.__getitem__))
            a, b = order[:-1], order[1:]
            real = self.verified(a, b)
            break
        lcp = np.full(self.n, -1, dtype=np.int64)
        lcp[1:] = np.where(self.group[a] == self.group[b], real, -1)
        return order, lcp

    def verified(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = np.minimum(self.size[a], self.size[b])
        out = np.empty(len(a), dtype=np.int64)
        for k in range(0, len(a), 4096):
            differ = self.bytes[a[k : k + 4096]] != self.bytes[b[k : k + 4096]]
            first = np.where(differ.any(axis=1), differ.argmax(axis=1), self.width)
            out[k : k + 4096] = np.minimum(first, most[k : k + 4096])
        return out


def repeats(texts: list[bytes], left: np.ndarray, twice: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which windows repeat: entry x, distance j from window start to anchor.

    texts: contexts; left: bytes before the anchor; twice: contexts that occur
    more than once, whose windows all repeat.
    """
    far = length - GRAM + 1
    right = Suffixes([t[a : a + length] for t, a in zip(texts, left.tolist(), strict=True)], group, length)
    back = Suffixes([t[:a][::-1] for t, a in zip(texts, left.tolist(), strict=True)], group, far)
    n = len(texts)
    fits = (np.arange(far) <= left[:, None]) & (length - np.arange(far) <= right.size[:, None])
    out = fits & twice[:, None]
    (ro, rl), (bo, bl) = right.ordered(), back.ordered()
    rmost, bmost = np.empty(n, np.int64), np.empty(n, np.int64)
    rmost[ro] = np.maximum(rl, np.append(rl[1:], -1))
    bmost[bo] = np.maximum(bl, np.append(bl[1:], -1))
    rclass, bclass = np.empty(n, np.int64), np.empty(n, np.int64)
    for j in range(far):
        may = np.flatnonzero(fits[:, j] & (rmost >= length - j) & (bmost >= j))
        if len(may) < 2:
            continue
        rclass[ro] = np.cumsum(rl < length - j)
        bclass[bo] = np.cumsum(bl < j)
        key = rclass[may] * (n + 1) + bclass[may]
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        out[may[count[which] > 1], j] = True
    return out


def spans_of(hits: np.ndarray, length: int) -> list[list[dict]]:
    """Byte ranges, counted from the anchor, that each entry's repeating windows cover."""
    out: list[list[dict]] = [[] for _ in hits]
    edge = np.diff(np.pad(hits.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    for (x, a), (_, b) in zip(np.argwhere(edge == 1).tolist(), np.argwhere(edge == -1).tolist(), strict=True):
        out[x].append({"start": 1 - b, "stop": length - a})
    return out


KEY = ["kh", "c1", "c2"]
SPANS = "spans array<struct<start: int, stop: int>>"


def contexts(table: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """KEY, n, the bytes and the bytes before the anchor of each wanted entry (row_id, at, lo, hi, KEY, n); a written table."""
    listed = written(wanted.groupBy("row_id").agg(F.collect_list(F.struct("at", "lo", "hi", *KEY, "n")).alias("own")), "wanted")
    some = table.select("row_id", "text").join(small(listed.select("row_id")), "row_id", "left_semi")
    names = [*KEY, "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten()
            lo, hi = (flat.field(c).to_numpy().tolist() for c in ("lo", "hi"))
            found, at = [], 0
            for text, n in zip(batch.column(0), batch.column(1).value_lengths().to_pylist(), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                found += [data[a : b + length] for a, b in zip(lo[at : at + n], hi[at : at + n], strict=True)]
                at += n
            left = flat.field("at").to_numpy() - flat.field("lo").to_numpy()
            yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in names), pa.array(found, pa.binary()), pa.array(left.astype(np.int32))], names=[*names, "context", "left"])

    out = written(mapped(some.join(listed, "row_id").select("text", "own"), run, "kh long, c1 long, c2 long, n long, context binary, left int"), "contexts")
    drop(listed)
    return out


def sorted_repeats(entries: DataFrame, length: int, parts: int) -> DataFrame:
    """Spans of entries whose groups fit a task; several groups are sorted together."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("kh", kind="stable", ignore_index=True)
        starts = np.flatnonzero(np.diff(rows["kh"].to_numpy(), prepend=rows["kh"].iloc[0] - 1))
        found: list[list[dict]] = []
        lo = 0
        while lo < len(rows):
            # Whole groups, about 4,000 entries at a time.
            k = np.searchsorted(starts, lo + 4000, side="left")
            hi = int(starts[k]) if k < len(starts) else len(rows)
            own = rows.iloc[lo:hi]
            hits = repeats(own["context"].tolist(), own["left"].to_numpy(np.int64), (own["n"] > 1).to_numpy(), own["kh"].to_numpy(), length)
            found += spans_of(hits, length)
            lo = hi
        some = np.array([bool(x) for x in found])
        return rows[KEY].assign(spans=pd.Series(found, dtype=object))[some]

    dealt = entries.withColumn("deal", F.pmod(F.xxhash64("kh"), F.lit(parts)))
    return dealt.groupBy("deal").applyInPandas(run, f"kh long, c1 long, c2 long, {SPANS}")


def dealt_anew(entries: DataFrame, length: int) -> DataFrame:
    """Pieces of entries: the windows that share the next least gram too, beside those in skip (places, from the anchor, of grams that are used up)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.to_pylist():
                data, left = np.frombuffer(r["context"], dtype=np.uint8), r["left"]
                h = gram_hashes(data)
                for k in r["skip"]:
                    if 0 <= left + k < len(h):
                        h[left + k] = np.iinfo(np.uint64).max
                at = least_positions(h, length - GRAM + 1)
                first = np.flatnonzero(np.diff(at, prepend=-1))
                for lo, hi in zip(first.tolist(), np.append(first[1:], len(at)).tolist(), strict=True):
                    k = int(at[lo]) - left
                    key = int(digests([(h[at[lo]].tobytes() + r["kh"].to_bytes(8, "little", signed=True), k % (1 << 32))])[0, 0])
                    rows.append((r["kh"], r["c1"], r["c2"], key, r["n"], r["context"][lo : hi - 1 + length], left - lo, [*r["skip"], k]))
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            sub = digests(zip(cols[5], cols[6], strict=True))
            kinds = [pa.int64()] * 5 + [pa.binary(), pa.int32(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), pa.array(sub[:, 0]), pa.array(sub[:, 1])], names=["kh", "c1", "c2", "key", "n", "context", "left", "skip", "d1", "d2"])

    schema = "kh long, c1 long, c2 long, key long, n long, context binary, left int, skip array<int>, d1 long, d2 long"
    return mapped(entries.select(*KEY, "n", "context", "left", "skip"), run, schema)


def group_repeats(entries: DataFrame, length: int, largest_group: int) -> DataFrame:
    """KEY and spans of entries (KEY, n, context, left, skip), of which some windows repeat.

    Deeper levels come from written tables, so that plans stay short; a level
    deals out only the groups that are still too large.
    """
    groups = written(entries.groupBy("kh").agg(F.sum("n").alias("total"), F.count("*").alias("differ")).where("total > 1"), "groups")
    rows = entries.join(groups, "kh")
    # A context that is alone in its group and occurs several times repeats whole.
    whole = F.array(F.struct((-F.col("left")).alias("start"), (F.octet_length("context") - F.col("left")).alias("stop")))
    found = rows.where("differ = 1").select(*KEY, whole.alias("spans"))
    size = groups.agg(F.coalesce(F.sum(F.when(F.col("differ") > 1, F.col("differ"))), F.lit(0)), F.max("differ")).first()
    parts = max(1, -(-size[0] // 8000), int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = found.unionByName(sorted_repeats(rows.where(F.col("differ").between(2, largest_group)).select(*KEY, "n", "context", "left"), length, parts))
    if (size[1] or 0) <= largest_group:
        return found
    pieces = written(dealt_anew(rows.where(F.col("differ") > largest_group), length), "pieces")
    own = pieces.groupBy(F.col("key").alias("kh"), F.col("d1").alias("c1"), F.col("d2").alias("c2")).agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("context", "left", "skip")))
    deeper = written(own, "deeper")
    spans = group_repeats(deeper, length, largest_group).toDF("key", "d1", "d2", "spans")
    spans = pieces.select(*KEY, "key", "d1", "d2").join(spans, ["key", "d1", "d2"]).groupBy(*KEY).agg(F.flatten(F.collect_list("spans")).alias("spans"))  # at most one piece a window
    spans = written(spans, "spans")
    drop(pieces, deeper)
    return found.unionByName(spans)


def repeated_spans(table: DataFrame, length: int, group_bytes: int, hot_share: int = 2000) -> DataFrame:
    """row_id and the byte ranges to remove, of the documents that have some; a written table."""
    each = table.select("row_id", F.explode(F.arrays_zip("at", "lo", "hi", "kh", "c1", "c2")).alias("a")).select("row_id", "a.*")
    entries = each.groupBy(*KEY).agg(F.count("*").alias("n"), F.min(F.struct("row_id", "at", "lo", "hi")).alias("first"))
    entries = written(entries, "entries")
    groups = entries.groupBy("kh").agg(F.sum("n").alias("total"), F.count("*").alias("differ")).where("total > 1")
    held = written(entries.join(groups, "kh"), "held")
    drop(entries)
    texts = contexts(table, held.where("differ > 1").select("first.row_id", "first.at", "first.lo", "first.hi", *KEY, "n"), length)
    found = group_repeats(texts.withColumn("skip", F.array(F.lit(0))), length, max(1, group_bytes // (2 * length)))
    whole = F.array(F.struct((F.col("first.lo") - F.col("first.at")).alias("start"), (F.col("first.hi") - F.col("first.at") + length).alias("stop")))
    found = found.unionByName(held.where("differ = 1").select(*KEY, whole.alias("spans")))
    found = written(found.join(held.select(*KEY, "n"), KEY), "repeats")
    total = held.agg(F.sum("n")).first()[0] or 0
    drop(held, texts)
    # Entries that more than one anchor in hot_share belongs to are at most hot_share rows and go to all tasks.
    hot = F.col("n") > total // hot_share + 1
    few = F.broadcast(found.where(hot).drop("n"))
    own = each.select("row_id", "at", *KEY)
    many = own.join(few.select(*KEY), KEY, "left_anti").join(found.where(~hot).drop("n"), KEY)
    spans = own.join(few, KEY).unionByName(many).select("row_id", F.transform("spans", lambda s: F.struct((s.start + F.col("at")).alias("start"), (s.stop + F.col("at")).alias("stop"))).alias("spans"))
    spans = written(spans.groupBy("row_id").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    drop(found)
    return spans


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted ranges, those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans or []):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def passages(table: DataFrame, spans: DataFrame, length: int, most_words: int) -> DataFrame:
    """row_id, the number of repeated ranges of over ``most_words`` words, and whether one has ``length`` bytes; a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, long = [], []
            for text, own in zip(batch.column(1), batch.column(2), strict=True):
                data, ranges = text.as_py().encode("utf-8", "surrogatepass"), merged(own.as_py())
                n.append(sum(len(data[a:b].split()) > most_words for a, b in ranges))
                long.append(any(b - a >= length for a, b in ranges))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(long, pa.bool_())], names=["row_id", "n_passages", "long"])

    some = table.select("row_id", "text").join(small(spans.select("row_id")), "row_id", "left_semi")
    return written(mapped(some.join(spans, "row_id").select("row_id", "text", "spans"), run, "row_id long, n_passages long, long boolean"), "passages")


def without(texts: DataFrame, with_text: bool) -> DataFrame:
    """Rows (row_id, doc_id, text, spans) after removal of the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, runs, sha, kept = [], [], [], [], []
            for text, own in zip(batch.column(2), batch.column(3), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                ranges = merged(own.as_py())
                cuts = [0, *(x for r in ranges for x in r), len(data)]
                whole = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                n.append(len(data))
                gone.append(len(data) - len(whole))
                runs.append(len(ranges))
                sha.append(hashlib.sha256(whole).hexdigest())
                kept.append(whole)
            cols = [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n, gone, runs)), pa.array(sha, pa.string())]
            names = ["row_id", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols, names = [*cols, pa.array(kept, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return mapped(texts, run, "row_id long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def remove_repeats(docs: DataFrame, length: int = 400, passage: int = 200, passage_words: int = 50, group_bytes: int = 16 << 20, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept bytes) and n_passages of every document.

    passage: bytes from which on repeats are told to n_passages, ``length`` at most.
    group_bytes: contexts that one task sorts together; its arrays take about 40 times as much.
    """
    passage = min(passage, length)
    table = written(anchored(docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text"), passage), "anchored", compression="zstd")
    spans = repeated_spans(table, passage, group_bytes)
    told = passages(table, spans, length, passage_words)
    drop(spans)
    asked = small(written(told.where("long").select("row_id"), "asked"))
    texts = table.select("row_id", "doc_id", "text")
    some = written(anchored(texts.join(asked, "row_id", "left_semi"), length), "long", compression="zstd")
    cut = some.select("row_id", "doc_id", "text").join(repeated_spans(some, length, group_bytes), "row_id", "left")
    out = without(cut.select("row_id", "doc_id", "text", "spans"), with_text)
    text = F.coalesce("text", F.lit(""))
    rest = texts.join(asked, "row_id", "left_anti").select(
        "row_id", "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"),
        *([text.cast("binary").alias("kept")] if with_text else []),
    )
    counts = told.where("n_passages > 0").select("row_id", "n_passages")
    out = out.unionByName(rest).join(small(written(counts, "counts")), "row_id", "left")
    return out.select(*(c for c in out.columns if c not in ("row_id", "n_passages")), F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"))
