"""Best-fit packing with large-item matching (operator 9).

A document becomes its token ids and one end id; only documents longer than the
capacity are cut. The packing is planned over the histogram of piece lengths,
which has at most ``capacity`` entries whatever the size of the corpus: lengths
above one third of the capacity pair at most twice per bin by greedy matching
(the longest with the longest that fits), shorter ones go, longest first, into
the smallest gap that takes them. The plan names, for each length, runs of
ranks and the sequences they go to; every piece then finds its place from its
rank among pieces of its length.

Defined cases: null text counts as empty (one end id); repeated rows are packed
once each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.common import mapped, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_TOKENIZERS: dict[str, object] = {}
_WORDS: dict[str, dict[str, bytes]] = {}
#: The word cache starts anew at this many entries, so a worker's memory stays bounded.
CACHE_WORDS = 500_000
TAIL = ".,!?;:"
#: Byte-level vocabularies write a byte that has no visible Latin-1 character as 256 and up, in order.
BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE))}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(name: str):
    if name not in _TOKENIZERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        path = name if "/" in name else tokenizer_path(name)
        _TOKENIZERS[name] = Tokenizer.from_file(str(path))
        _WORDS[name] = {}
    return _TOKENIZERS[name], _WORDS[name]


def _ids(tokens: list) -> bytes:
    return b"".join([x.id.to_bytes(4, "little") for x in tokens])


def token_bytes(texts: list[str | None], tokenizer: str = "word_bpe_49k.json") -> list[bytes]:
    """Ids of each text as little-endian uint32 bytes.

    This vocabulary's patterns never cross a space, so a text's ids are those of
    its space-separated chunks in order; a chunk is encoded once and remembered.
    Latin-1 chunks are folded to lower case and lose closing punctuation first,
    which the patterns split off anyway. A word of Latin-1 letters is one match of
    the patterns and goes to the merges directly; any other chunk takes the whole
    tokenizer.
    """
    t, known = _tokenizer(tokenizer)
    out: list[bytes] = []
    for at in range(0, len(texts), 256):
        part = [("" if x is None else x).replace("\n", " ").split(" ") for x in texts[at : at + 256]]
        if len(known) > CACHE_WORDS:
            known.clear()
        odd = []
        for c in [c for c in set().union(*part) if c not in known]:
            core = c.lower()
            bare = core.rstrip(TAIL)
            tail = core[len(bare) :]
            if not (bare.isalpha() and max(c) < "\u0100"):
                odd.append(c)
                continue
            if bare not in known:
                known[bare] = _ids(t.model.tokenize(bare if bare.isascii() else bare.encode().decode("latin-1").translate(BYTE_CHARS)))
            if tail and tail not in known:
                known[tail] = _ids(t.model.tokenize(tail))
            known[c] = known[bare] + known[tail] if tail else known[bare]
        for c, e in zip(odd, t.encode_batch(odd, add_special_tokens=False), strict=True):
            known[c] = np.array(e.ids, dtype="<u4").tobytes()
        get = known.__getitem__
        out += [b"".join(map(get, chunks)) for chunks in part]
    return out


def pieces(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str = "word_bpe_49k.json", with_ids: bool = False) -> DataFrame:
    """One row per piece of each document; ``with_ids`` adds the ids themselves."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = int(end_id).to_bytes(4, "little")
        width = 4 * capacity
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for at in range(0, len(doc_ids), 512):
                for d, ids in zip(doc_ids[at : at + 512], token_bytes(texts[at : at + 512].to_pylist(), tokenizer), strict=True):
                    ids += end
                    for k, lo in enumerate(range(0, len(ids), width)):
                        own = ids[lo : lo + width]
                        rows["doc_id"].append(d)
                        rows["piece"].append(k)
                        rows["start"].append(lo // 4)
                        rows["length"].append(len(own) // 4)
                        rows["ids_crc32"].append(zlib.crc32(own))
                        if with_ids:
                            rows["ids"].append(np.frombuffer(own, dtype="<u4").astype(np.int32).tolist())
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            cols = [pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)][: 6 if with_ids else 5]
            yield pa.RecordBatch.from_arrays(cols, names=list(rows)[: len(cols)])

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), cut, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first sequence, offset) that place every piece.

    Pieces of a run go to successive sequences at one offset. The number of runs
    depends on the number of distinct lengths, not on the number of pieces.
    """
    left, rank = dict(counts), dict.fromkeys(counts, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}
    next_seq = 0

    def put(length: int, n: int, seq: int, offset: int) -> None:
        runs.append((length, rank[length], n, seq, offset))
        rank[length] += n
        left[length] -= n

    def open_gap(gap: int, seq: int, n: int) -> None:
        if gap and n:
            if gap not in groups:
                bisect.insort(gaps, gap)
                groups[gap] = []
            groups[gap].append((seq, n))

    large = sorted(x for x in left if 3 * x > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        k = bisect.bisect_right(large, capacity - a) - 1
        while k >= 0 and (not left[large[k]] or large[k] == a and left[a] < 2):
            k -= 1
        if k < 0:
            n = left[a]
            put(a, n, next_seq, 0)
            open_gap(capacity - a, next_seq, n)
        else:
            b = large[k]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            put(a, n, next_seq, 0)
            put(b, n, next_seq, a)
            open_gap(capacity - a - b, next_seq, n)
        next_seq += n

    for s in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[s]:
            at = bisect.bisect_left(gaps, s)
            if at == len(gaps):
                n = -(-left[s] // (capacity // s))
                open_gap(capacity, next_seq, n)
                next_seq += n
                continue
            gap = gaps[at]
            seq, n = groups[gap].pop()
            if not groups[gap]:
                del groups[gap]
                gaps.pop(at)
            each = gap // s
            full = min(n, left[s] // each)
            for k in range(each if full else 0):
                put(s, full, seq, capacity - gap + k * s)
            open_gap(gap - each * s, seq, full)
            rest = min(left[s], each) if full < n else 0
            for k in range(rest):
                put(s, 1, seq + full, capacity - gap + k * s)
            open_gap(gap - rest * s, seq + full, 1 if rest else 0)
            open_gap(gap, seq + full + (1 if rest else 0), n - full - (1 if rest else 0))
    return runs


def place(cut: DataFrame, capacity: int = 4096, per_rank_group: int = 50_000) -> DataFrame:
    """Add sequence_id and offset to pieces. ``cut`` is read three times: pass a written table."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    runs = plan(counts, capacity)
    salts = -(-max(counts.values(), default=1) // per_rank_group)
    keyed = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    sizes = keyed.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = keyed.withColumn("_rank", F.row_number().over(own) - 1).join(base, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_base")).drop("_salt", "_base")

    by = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    shared = cut.sparkSession.sparkContext.broadcast(by)  # bounded by the number of lengths
    names = ranked.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        keys = (runs[:, 0] << 44) + runs[:, 1]
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(names.index("_rank")).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = runs[np.searchsorted(keys, (length << 44) + rank, side="right") - 1] if len(length) else runs[:0]
            seq = hit[:, 3] + rank - hit[:, 1]
            cols = [batch.column(k) for k, n in enumerate(names) if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(hit[:, 4])], names=[*(n for n in names if n != "_rank"), "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return mapped(ranked, assign, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str = "word_bpe_49k.json", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and offset that each goes to."""
    return place(written(pieces(docs, capacity, end_id, tokenizer, with_ids), "pieces"), capacity)
