"""Language-model scoring by context-tree weighting over bytes (operator 3).

A byte is eight binary decisions. For each context of 0 to ``depth`` preceding
bytes and each node of the byte's binary tree, counts from the training texts
give a Krichevsky-Trofimov estimate; a context's weighted probability is half
its own estimate and half the product of its children's, and the conditional
probability of a bit mixes all depths by these weights. Trained once, the model
gives each (depth+1)-gram of bytes one log probability, so texts are scored by
looking up their grams.

Documents are taken in blocks of about ``block_bytes``. A block is one row that
holds its texts packed; a task unpacks one block at a time and goes through it
by slices of about ``SLICE`` bytes of whole texts, so that Python objects are
made for one slice only. A block sends each
distinct gram and word once, with its training count, packed; a shard sums the
counts by key and weights the tree from the deepest contexts upwards, and what
a block asked for returns to it. With more than ``FAN`` blocks the way to the
shards and back has several rounds: each deals a unit's keys to at most ``FAN``
parts and makes one new unit of the same part of up to ``FAN`` units, so parts
stay in proportion to the blocks, and no row holds more than ``FAN`` of them.

Grams are dealt out by the last two bytes of their context; the ``HEAVY`` pairs
of bytes that a first look finds most often are dealt out by three bytes, so no
pair kept whole holds more than one in ``HEAVY`` grams of that look. The nodes
above (65,536, and 255 for each heavy pair) are finished on the driver. Words
are known by 64-bit hashes.

Texts are framed by the byte 0xFF, which UTF-8 never holds: it stands for the
contexts before a text and codes its end.

Defined cases: null text is empty (one end token, one end byte); without
training documents every bit has probability one half and the base score is
that of zero counts; repeated rows count and are scored once each; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import Table, crc32_text, mapped, written

EDGE = 0xFF
#: Parts that a unit is dealt to in a round, and pairs of bytes that are dealt out by a third one.
FAN, HEAVY = 128, 256
#: Bytes of text that are Python objects at a time, and keys that wait until they are summed.
SLICE, WAITING = 1 << 20, 1 << 19
#: Tables of large rows: a reader holds a row group in memory, so each has one row.
ROW_BY_ROW = {"parquet.block.row.count.limit": "1"}
END = b""
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight."""
    low = np.ones_like(x)
    for k in range(8):
        low = low * (x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(low)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of such a sequence of bits under the Krichevsky-Trofimov estimator."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1.0)


def blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Rows of about ``block_bytes`` of text: block, doc_ids, sizes (bytes of each text), n_bytes, texts (packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        base, made, ids, texts, size = TaskContext.get().partitionId() << 20, 0, [], [], 0
        pack = zstandard.ZstdCompressor(level=1)

        def row() -> pa.RecordBatch:
            data = b"".join(texts)
            longs = pa.list_(pa.int64())
            cols = [pa.array([base + made], pa.int64()), pa.array([ids], longs), pa.array([[len(t) for t in texts]], longs), pa.array([len(data)], pa.int64())]
            return pa.RecordBatch.from_arrays([*cols, pa.array([pack.compress(data)], pa.binary())], names=["block", "doc_ids", "sizes", "n_bytes", "texts"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                ids.append(doc_id)
                texts.append(text.as_py() or b"")
                size += len(texts[-1]) + 1
                if size >= block_bytes:
                    yield row()
                    made, ids, texts, size = made + 1, [], [], 0
        if ids:
            yield row()

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, "block long, doc_ids array<long>, sizes array<long>, n_bytes long, texts binary")


class Block:
    """The texts of a block, as one string of bytes."""

    def __init__(self, sizes: pa.ListScalar, texts: pa.BinaryScalar) -> None:
        import zstandard

        self.data = zstandard.ZstdDecompressor().decompress(texts.as_py(), max_output_size=1 << 31)
        self.ends = np.cumsum(sizes.values.to_numpy())

    def slices(self) -> Iterator[tuple[int, list[bytes]]]:
        """Successive texts of about ``SLICE`` bytes, or one that is longer, and the number of the first."""
        first, at = 0, 0
        while first < len(self.ends):
            last = max(first + 1, int(np.searchsorted(self.ends, at + SLICE, side="right")))
            ends = self.ends[first:last].tolist()
            yield first, [self.data[a:b] for a, b in zip([at, *ends], ends, strict=False)]
            first, at = last, ends[-1]


def word_keys(words: list[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(w) for w in words]), dtype=">i8").astype(np.int64)


def tokens(text: bytes) -> list[bytes]:
    own = text.lower().split()  # ASCII only, both
    own.append(END)
    return own


def gram_stream(texts: list[bytes], depth: int, piece: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams of all texts, each with its end, and the text of each gram; about ``piece`` at a time."""
    pad = bytes([EDGE]) * depth
    data = np.frombuffer(pad + b"".join(t + bytes([EDGE]) + pad for t in texts), dtype=np.uint8)
    n = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    starts = np.cumsum(n + depth) - n
    for lo in range(depth, len(data), piece):
        hi = min(len(data), lo + piece)
        grams = np.zeros(hi - lo, dtype=np.uint64)
        for k in range(depth + 1):
            grams <<= np.uint64(8)
            grams |= data[lo - depth + k : hi - depth + k]
        first, last = np.searchsorted(starts, [lo, hi - 1], side="right") - 1
        own = np.arange(first, last + 1)
        edges = np.append(starts[own], starts[last + 1] if last + 1 < len(starts) else len(data)).clip(lo, hi)
        # Between texts the pads stand, whose grams belong to none.
        pads = ((starts + n)[own][:, None] + np.arange(depth) - lo).ravel()
        keep = np.ones(hi - lo, dtype=bool)
        keep[pads[(pads >= 0) & (pads < hi - lo)]] = False
        yield grams[keep], np.repeat(own, np.diff(edges))[keep]


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and how often each occurs."""
    values = np.sort(values)
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.append(first, len(values)))


def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their summed counts."""
    every, times = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(every)
    every = every[order]
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    return every[first], np.add.reduceat(times[order], first)


def gathered(pieces: Iterable[tuple], joined: Callable[[list[tuple]], tuple]) -> tuple:
    """``joined`` of all pieces, of which no more than about twice the result waits at a time."""
    held, size, most = [], 0, WAITING
    for piece in pieces:
        held.append(piece)
        size += len(piece[0])
        if size > most:
            held = [joined(held)]
            size = len(held[0][0])
            most = size + max(WAITING, size)
    return joined(held)


def gram_counts(own: Block, depth: int, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a block, sorted, and how often the training texts hold them."""

    def pieces() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for first, texts in own.slices():
            for grams, text in gram_stream(texts, depth):
                seen = train[first + text]
                yield runs(grams[seen])
                other, _ = runs(grams[~seen])
                yield other, np.zeros(len(other), np.int64)

    return gathered(pieces(), summed)


def distinct_grams(own: Block, depth: int) -> np.ndarray:
    """Distinct grams of a block, sorted."""
    every = ((runs(grams)[0],) for _, texts in own.slices() for grams, _ in gram_stream(texts, depth))
    return gathered(every, lambda held: (runs(np.concatenate([x for x, in held]))[0],))[0]


def word_counts(own: Block, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of a block, as sorted keys, and how often the training texts hold them."""

    def pieces() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for first, texts in own.slices():
            seen: Counter[bytes] = Counter()
            for text, t in zip(texts, train[first : first + len(texts)].tolist(), strict=True):
                words = tokens(text)
                seen.update(words) if t else seen.update(dict.fromkeys(words, 0))
            yield word_keys(list(seen)).view(np.uint64), np.fromiter(seen.values(), np.int64, len(seen))

    return gathered(pieces(), summed)


def packed(values: np.ndarray) -> bytes:
    """Differences of an array, byte plane by byte plane, compressed."""
    import zstandard

    diff = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(diff.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.cumsum(np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel(), dtype=kind)


def context_pair(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(8)) & np.uint64(0xFFFF)


def is_heavy(grams: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    marked = np.zeros(1 << 16, dtype=bool)
    marked[heavy] = True
    return marked[context_pair(grams)]


class Deal:
    """Which shard a key goes to. fans: parts of each round; their product is the number of shards."""

    def __init__(self, fans: list[int], heavy: np.ndarray) -> None:
        self.fans, self.heavy, self.shards = fans, heavy, math.prod(fans)

    def shard(self, keys: np.ndarray, grams: bool) -> np.ndarray:
        by = keys
        if grams:
            by = np.where(is_heavy(keys, self.heavy), np.uint64(1 << 32) | (keys >> np.uint64(8)) & np.uint64(0xFFFFFF), context_pair(keys))
        return (((by * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) % np.uint64(self.shards)).astype(np.int64)

    def order(self, keys: np.ndarray, grams: bool) -> np.ndarray:
        """Order of sorted keys by (shard, key)."""
        return np.argsort(self.shard(keys, grams), kind="stable")

    def cuts(self, shard: np.ndarray, done: int) -> np.ndarray:
        """Where the parts of round ``done`` begin in the ordered shards of one unit."""
        inner = math.prod(self.fans[done + 1 :])
        base = shard[0] // (inner * self.fans[done]) * inner * self.fans[done] if len(shard) else 0
        return np.searchsorted(shard, base + inner * np.arange(self.fans[done] + 1))


PART = "digit int, wk binary, wn binary, gk binary, gn binary"


def parts_of(wk: np.ndarray, wn: np.ndarray, gk: np.ndarray, gn: np.ndarray, deal: Deal, done: int) -> list[dict]:
    """What a unit, its keys in order, sends to each part of a round."""
    wcut, gcut = deal.cuts(deal.shard(wk, False), done), deal.cuts(deal.shard(gk, True), done)
    out = []
    for k in range(deal.fans[done]):
        w, g = slice(wcut[k], wcut[k + 1]), slice(gcut[k], gcut[k + 1])
        if w.stop > w.start or g.stop > g.start:
            out.append({"digit": k, "wk": packed(wk[w]), "wn": packed(wn[w]), "gk": packed(gk[g]), "gn": packed(gn[g])})
    return out


def count_blocks(made: DataFrame, depth: int, mod: int, rest: int, deal: Deal) -> DataFrame:
    """For each block and part of the first round, its distinct words and grams with their training counts, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, sizes, texts in zip(*(batch.column(k) for k in range(4)), strict=True):
                train = np.array([crc32_text(d) % mod != rest for d in ids.as_py()], dtype=bool)
                all_of = Block(sizes, texts)
                wk, wn = word_counts(all_of, train)
                gk, gn = gram_counts(all_of, depth, train)
                del all_of
                worder, gorder = deal.order(wk, False), deal.order(gk, True)
                own = parts_of(wk[worder], wn[worder], gk[gorder], gn[gorder], deal, 0)
                kinds = {"digit": pa.int32(), **dict.fromkeys(("wk", "wn", "gk", "gn"), pa.binary())}
                cols = [pa.array([block.as_py()] * len(own), pa.int64()), *(pa.array([p[c] for p in own], t) for c, t in kinds.items())]
                yield pa.RecordBatch.from_arrays(cols, names=["unit", *kinds])

    return mapped(made.select("block", "doc_ids", "sizes", "texts"), run, f"unit long, {PART}")


def token_slices(own: Block) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The tokens of a block's texts, by slices."""
    for first, texts in own.slices():
        yield first, [tokens(t) for t in texts]


def named(split: list[list[bytes]]) -> list[bytes]:
    """Distinct tokens, in order of their first place."""
    return list(dict.fromkeys(chain.from_iterable(split)))


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch, of which one is a Python object at a time."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def merged_units(rows: DataFrame, deal: Deal, done: int) -> DataFrame:
    """One new unit of each row's parts: unit, digit and path, the parts of the next round, and where each child's keys stand in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                parts, fields, places = row["parts"], [], []
                for keys, counts, grams in (("wk", "wn", False), ("gk", "gn", True)):
                    key, n, of, sizes = merged(parts, keys, counts)
                    order = deal.order(key, grams)
                    at = np.empty_like(order)
                    at[order] = np.arange(len(order))
                    fields += [key[order], n[order].astype(np.int64)]
                    places.append(np.split(at[of].astype(np.int64), np.cumsum(sizes)[:-1]))
                children = [{"unit": p["unit"], "wi": packed(w), "gi": packed(g)} for p, w, g in zip(parts, *places, strict=True)]
                cols = [pa.array([row[c]], t) for c, t in (("unit", pa.int64()), ("digit", pa.int32()), ("path", pa.int64()))]
                child = pa.struct([("unit", pa.int64()), ("wi", pa.binary()), ("gi", pa.binary())])
                part = pa.struct([("digit", pa.int32()), *((c, pa.binary()) for c in ("wk", "wn", "gk", "gn"))])
                cols += [pa.array([children], pa.list_(child)), pa.array([parts_of(*fields, deal, done)], pa.list_(part))]
                yield pa.RecordBatch.from_arrays(cols, names=["unit", "digit", "path", "children", "next"])

    schema = f"unit long, digit int, path long, children array<struct<unit: long, wi: binary, gi: binary>>, next array<struct<{', '.join(x.replace(' ', ': ') for x in PART.split(', '))}>>"
    return mapped(rows.select("unit", "digit", "path", "parts"), run, schema)


def returned(level: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers to the units of a round (unit, digit, wv, gv) dealt back to their children."""
    own = answers.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("digit", "wv", "gv"))).alias("got"))
    rows = level.select("unit", "digit", "children").join(own, "unit").select("digit", "children", "got")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                wv = np.concatenate([unpacked(x["wv"], np.int64) for x in row["got"]])
                gv = np.concatenate([unpacked(x["gv"], np.int32) for x in row["got"]])
                back = [(c["unit"], packed(wv[unpacked(c["wi"], np.int64)]), packed(gv[unpacked(c["gi"], np.int64)])) for c in row["children"]]
                units, words, grams = zip(*back, strict=True)
                cols = [pa.array(units, pa.int64()), pa.array([row["digit"]] * len(back), pa.int32()), pa.array(words, pa.binary()), pa.array(grams, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["unit", "digit", "wv", "gv"])

    return mapped(rows, run, "unit long, digit int, wv binary, gv binary")


class Nodes:
    """Binary nodes of the contexts of one depth that some grams pass.

    of: for each gram and bit, its node. ones, zeros: training counts.
    """

    def __init__(self, grams: np.ndarray, n: np.ndarray, depth: int) -> None:
        own = grams & np.uint64((1 << (8 * (depth + 1))) - 1)
        symbol = (own & np.uint64(0xFF)).astype(np.int64)
        bit = (symbol[:, None] >> np.arange(7, -1, -1)) & 1
        prefix = (symbol[:, None] | 256) >> np.arange(8, 0, -1)
        ids = (own >> np.uint64(8)).astype(np.int64)[:, None] << 8 | prefix
        self.ids, of = np.unique(ids, return_inverse=True)
        self.of, self.bit = of.reshape(ids.shape), bit
        each = np.broadcast_to(n[:, None], bit.shape)
        self.ones = np.bincount(self.of.ravel(), weights=(each * bit).ravel(), minlength=len(self.ids))
        self.zeros = np.bincount(self.of.ravel(), weights=(each * (1 - bit)).ravel(), minlength=len(self.ids))
        self.log_pe = log_kt(self.zeros, self.ones)

    def chance(self) -> np.ndarray:
        """The estimate of each gram's bits at this depth."""
        total = (self.zeros + self.ones + 1)[self.of]
        return (np.where(self.bit == 1, self.ones[self.of], self.zeros[self.of]) + 0.5) / total


def weighted(grams: np.ndarray, n: np.ndarray, depth: int, least: int) -> tuple[np.ndarray, Nodes, np.ndarray]:
    """Mix depths ``depth`` down to ``least``: each gram's bit probabilities, the nodes at ``least`` and their log weighted probabilities."""
    below: tuple[Nodes, np.ndarray] | None = None
    p = np.zeros((len(grams), 8))
    for d in range(depth, least - 1, -1):
        nodes = Nodes(grams, n, d)
        if below is None:
            p, log_pw = nodes.chance(), nodes.log_pe
        else:
            deeper, deeper_pw = below
            parent = np.searchsorted(nodes.ids, deeper.ids & ((1 << (8 * d + 8)) - 1))
            children = np.bincount(parent, weights=deeper_pw, minlength=len(nodes.ids))
            share = 1 / (1 + np.exp(np.clip(children - nodes.log_pe, -700, 700)))
            w = share[nodes.of]
            p = w * nodes.chance() + (1 - w) * p
            log_pw = np.logaddexp(nodes.log_pe, children) - math.log(2)
        below = (nodes, log_pw)
    return p, below[0], below[1]


def own_share(pe: np.ndarray, children: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(children - pe, -700, 700)))


def top_table(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(mask, nodes, share of the own estimate, estimate of a one) of depth 2, for heavy pairs, and of depths 1 and 0.

    node: ids of depth 1, and of depth 2 (heavy pairs) from 1 << 32 on.
    """
    out = []
    deep = node >= 1 << 32
    at = np.argsort(node[deep])
    ids, z, o, c = (x[deep][at] for x in (node & 0xFFFFFF, zeros, ones, children))
    above = [[node[~deep], zeros[~deep], ones[~deep], children[~deep]]]
    for depth, mask in ((2, 0xFFFFFF), (1, 0xFFFF), (0, 0xFF)):
        if depth < 2:
            raw, *sums = (np.concatenate(x) for x in zip(*above, strict=True))
            ids, of = np.unique(raw & mask, return_inverse=True)
            z, o, c = (np.bincount(of, weights=x, minlength=len(ids)) for x in sums)
            above = []
        pe = log_kt(z, o)
        out.append((mask, ids, own_share(pe, c), (o + 0.5) / (z + o + 1)))
        above.append([ids, z, o, np.logaddexp(pe, c) - math.log(2)])
    return out


def kinds_of(grams: np.ndarray, heavy: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Places of grams by the least depth that a shard sees whole: 3 for heavy pairs, else 2."""
    deep = is_heavy(grams, heavy)
    yield 3, np.flatnonzero(deep)
    yield 2, np.flatnonzero(~deep)


def merged(parts: list[dict], keys: str, counts: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Distinct keys of a shard, their summed counts, each entry's key, and the sizes of the blocks' parts."""
    own = [unpacked(p[keys], np.uint64) for p in parts]
    key, of = np.unique(np.concatenate(own), return_inverse=True)
    n = np.bincount(of, weights=np.concatenate([unpacked(p[counts], np.int64) for p in parts]).astype(float), minlength=len(key))
    return key, n, of, [len(x) for x in own]


def stretches(grams: np.ndarray, least: int, most: int = 100_000) -> Iterator[np.ndarray]:
    """Places of the grams, whole contexts of ``least`` bytes together, about ``most`` at a time."""
    context = (grams >> np.uint64(8)) & np.uint64((1 << 8 * least) - 1)
    order = np.argsort(context, kind="stable")
    context = context[order]
    lo = 0
    while lo < len(order):
        hi = min(len(order), lo + most)
        hi = int(np.searchsorted(context, context[hi - 1], side="right"))
        yield order[lo:hi]
        lo = hi


def shard_totals(shards: DataFrame, depth: int, heavy: np.ndarray) -> DataFrame:
    """node, zeros, ones, children of the topmost contexts that shards see whole; node -1 holds the words' total and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column(0):
                parts = row.as_py()
                _, n, _, _ = merged(parts, "wk", "wn")
                found = [np.array([[-1], [n.sum()], [(n > 0).sum()], [0]], dtype=float)]
                grams, times, _, _ = merged(parts, "gk", "gn")
                for least, own in kinds_of(grams, heavy):
                    for at in stretches(grams[own], least):
                        _, nodes, log_pw = weighted(grams[own[at]], times[own[at]], depth, least)
                        ids, of = np.unique(nodes.ids & ((1 << 8 * least) - 1), return_inverse=True)
                        sums = [np.bincount(of, weights=w, minlength=len(ids)) for w in (nodes.zeros, nodes.ones, log_pw)]
                        found.append(np.stack([ids + (1 << 32 if least == 3 else 0), *sums]))
                node, *cols = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int64)), *map(pa.array, cols)], names=["node", "zeros", "ones", "children"])

    each = mapped(shards.select("parts"), run, "node long, zeros double, ones double, children double")
    return each.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("children").alias("children"))


def shard_values(shards: DataFrame, depth: int, heavy: np.ndarray, top: list) -> DataFrame:
    """What each unit asked of a shard, in its order: training counts of words, log10 probabilities of grams."""
    shared = shards.sparkSession.sparkContext.broadcast(top)  # at most 65,536 nodes and 255 for each heavy pair

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = shared.value
        for batch in batches:
            for digit, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts = row.as_py()
                _, n, of, wsize = merged(parts, "wk", "wn")
                grams, times, gof, gsize = merged(parts, "gk", "gn")
                value = np.zeros(len(grams), dtype=np.float32)
                for least, own in kinds_of(grams, heavy):
                    for at in stretches(grams[own], least):
                        p, nodes, _ = weighted(grams[own[at]], times[own[at]], depth, least)
                        for mask, ids, share, one in top[3 - least :]:
                            node = np.searchsorted(ids, nodes.ids & mask)[nodes.of]
                            mine = np.where(nodes.bit == 1, one[node], 1 - one[node])
                            p = share[node] * mine + (1 - share[node]) * p
                        value[own[at]] = np.log10(p).sum(axis=1)
                words = np.split(n[of].astype(np.int64), np.cumsum(wsize)[:-1])
                scores = np.split(value[gof], np.cumsum(gsize)[:-1])
                cols = [pa.array([p["unit"] for p in parts], pa.int64()), pa.array([digit] * len(parts), pa.int32())]
                cols += [pa.array([packed(w) for w in words], pa.binary()), pa.array([packed(s.view(np.int32)) for s in scores], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["unit", "digit", "wv", "gv"])

    return mapped(shards.select("digit", "parts"), run, "unit long, digit int, wv binary, gv binary")


def heavy_pairs(block: DataFrame) -> np.ndarray:
    """The HEAVY pairs of bytes with the most different grams in a block; they only say how work is dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sizes, texts in zip(batch.column(0), batch.column(1), strict=True):
                grams = distinct_grams(Block(sizes, texts), 5)
                n = np.bincount(context_pair(grams).astype(np.int64), minlength=1 << 16)
                pair = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n[pair])], names=["pair", "n"])

    seen = mapped(block.select("sizes", "texts"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return np.array(sorted(r["pair"] for r in seen.orderBy(F.desc("n"), "pair").limit(HEAVY).collect()), dtype=np.int64)  # at most HEAVY rows


def score_documents(docs: DataFrame, depth: int = 5, mod: int = 7, rest: int = 2, block_bytes: int = 12 << 20, shard_bytes: int = 24 << 20) -> DataFrame:
    """RESULT for every document, learning from those whose crc32(doc_id) mod ``mod`` is not ``rest``.

    ``shard_bytes``: text per shard of the counts, which sets their number.
    """
    if not 2 <= depth <= 7:
        raise ValueError("depth is 2 to 7 bytes")
    made = written(blocks(docs, block_bytes), "blocks", compression="zstd", **ROW_BY_ROW)
    count = made.agg(F.count("*"), F.sum("n_bytes"), F.min("block")).first()
    shards = max(1, -(-(count[1] or 0) // shard_bytes))
    fans = []
    while FAN ** (len(fans) + 1) < count[0]:
        fans.append(FAN)
    fans.append(max(1, min(FAN, -(-shards // math.prod(fans)))))
    deal = Deal(fans, heavy_pairs(made.where(F.col("block") == count[2])) if depth > 2 and count[0] else np.zeros(0, np.int64))
    parts, levels, path = count_blocks(made, depth, mod, rest, deal), [], F.lit(0).cast("long")
    for done in range(1, len(fans) + 1):
        # Places of units in their path, dealt by a hash: lots of about FAN.
        lots = max(1, -(-count[0] // FAN**done))
        rows = parts.withColumn("path", path if done == 1 else F.col("path")).withColumn("lot", F.pmod(F.xxhash64("unit"), F.lit(lots)))
        rows = rows.groupBy("path", "digit", "lot").agg(F.collect_list(F.struct("unit", "wk", "wn", "gk", "gn")).alias("parts"))
        rows = written(rows.withColumn("path", F.col("path") * FAN + F.col("digit")), f"units{done}", **ROW_BY_ROW)
        if done < len(fans):
            rows = rows.withColumn("unit", F.col("path") * lots + F.col("lot"))
            levels.append(written(merged_units(rows, deal, done), f"level{done}", **ROW_BY_ROW))
            parts = levels[-1].select("unit", "path", F.explode("next").alias("p")).select("unit", "path", "p.*")
    totals = shard_totals(rows, depth, deal.heavy).toArrow()  # at most 65,536 nodes, 255 for each heavy pair, and one row
    node, zeros, ones, children = (totals[c].to_numpy() for c in ("node", "zeros", "ones", "children"))
    real = node >= 0
    train_tokens, distinct = round(zeros[~real].sum()), round(ones[~real].sum())
    answers = shard_values(rows, depth, deal.heavy, top_table(node[real], zeros[real], ones[real], children[real]))
    for level in reversed(levels):
        answers = written(returned(level, answers), "answers")

    def run(own: pa.Table, back: pa.Table) -> pa.Table:
        (ids,), (sizes,), (texts,) = own["doc_ids"].to_pylist(), own["sizes"], own["texts"]  # a unit is one block
        back, all_of, rows = back.sort_by("digit"), Block(sizes, texts), []
        asked = [word_keys(named(split)).view(np.uint64) for _, split in token_slices(all_of)]
        words = np.unique(np.concatenate(asked))
        count = np.empty(len(words), np.int64)
        count[deal.order(words, False)] = np.concatenate([unpacked(x.as_py(), np.int64) for x in back["wv"]])
        scale = math.log10(train_tokens + distinct + 1)
        for (first, split), keys in zip(token_slices(all_of), asked, strict=True):
            names, times = named(split), count[np.searchsorted(words, keys)]
            base = dict(zip(names, (np.log10(times + 1) - scale).tolist(), strict=True))
            unknown = {w for w, k in zip(names, (times > 0).tolist(), strict=True) if not k}
            for d, w in zip(ids[first : first + len(split)], split, strict=True):
                lost = sum(map(unknown.__contains__, w)) if unknown else 0
                rows.append((d, crc32_text(d) % mod == rest, len(w), len(w) - lost, train_tokens, math.fsum(map(base.__getitem__, w))))
        grams = distinct_grams(all_of, depth)
        table = Table(grams[deal.order(grams, True)], np.concatenate([unpacked(x.as_py(), np.int32) for x in back["gv"]]).view(np.float32))
        for first, split in all_of.slices():
            score = np.zeros(len(split))
            for grams, text in gram_stream(split, depth):
                score += np.bincount(text, weights=table.get(grams), minlength=len(split))
            for at, (t, s) in enumerate(zip(split, score.tolist(), strict=True), first):
                rows[at] += (s, -s * math.log2(10) / (len(t) + 1))
        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
        fields = [f.split() for f in RESULT.split(", ")]
        return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[f for f, _ in fields])

    texts = made.select(F.col("block").alias("unit"), "doc_ids", "sizes", "texts")
    return texts.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(run, RESULT)
