"""Quality classifier: random-indexing word vectors and a small network (operator 7).

Words are runs of letters, digits or other marks, known by a hash into a fixed
number of rows; the shape of a word (its kind, case and length) counts as a word
too. Every row has a sparse ternary index vector; a row's word vector is the sum
of its neighbours' index vectors over all documents. A document is the mean of
its words' vectors, with the norms of those means, the share of words that
repeat the one before, and its length. A two-layer
network in numpy learns the labels from at most ``sample_rows`` labelled rows
(the least hashes of doc_id), and a temperature fitted on a fifth of them
calibrates its probabilities. The word vectors cover all rows; tables that go
to all tasks have a fixed size.

Defined cases: null and empty texts get the network's answer to a document
without words; with no labels, or one label only, every score is the share of
label 1 (one half without any); repeated rows are scored once each; an empty
table gives an empty result; extra columns are ignored, and labels, lang,
source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import crc32_mod, mapped, written

ROWS, DIM, NONZERO = 1 << 15, 32, 4
FLAT = 1 << 19
_RNG = np.random.default_rng(7)
#: Of each row: the places of its index vector's nonzero entries, and their signs.
PLACES = np.argsort(_RNG.random((ROWS, DIM)), axis=1)[:, :NONZERO].astype(np.int32)
SIGNS = _RNG.choice(np.array([-1.0, 1.0]), size=(ROWS, NONZERO))
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
POWER = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(FLAT, STEP)]))
BACK = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(FLAT, np.uint64(pow(int(STEP), -1, 1 << 64)))]))
SPACES = [bytes([c]) for c in b" \t\n\r\v\f"]
#: Kinds of bytes: 0 white space, 1 letters, 2 digits, 3 other marks.
KIND = np.array([0 if c in b" \t\n\r\v\f" else 1 if c >= 128 or chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(256)], dtype=np.int8)
UPPER = np.array([65 <= c <= 90 for c in range(256)])
FEATURES = 2 * DIM + 4


def index_matrix() -> np.ndarray:
    out = np.zeros((ROWS, DIM), dtype=np.float32)
    np.put_along_axis(out, PLACES.astype(np.int64), SIGNS.astype(np.float32), axis=1)
    return out


def scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of STEP and of its inverse; a word longer than a stretch needs more of them than are kept."""
    if n <= FLAT:
        return POWER, BACK
    return tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, x)])) for x in (STEP, np.uint64(pow(int(STEP), -1, 1 << 64))))


def stretches(text: bytes) -> Iterator[bytes]:
    """A text in parts of about FLAT bytes, cut at white space only."""
    at = 0
    while len(text) - at > FLAT - 1:
        space = max(text.rfind(x, at, at + FLAT - 1) for x in SPACES)
        if space < 0:
            ahead = [k for k in (text.find(x, at + FLAT - 1) for x in SPACES) if k >= 0]
            space = min(ahead, default=len(text))
        yield text[at:space]
        at = space + 1
    if at < len(text):
        yield text[at:]


def word_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the words of all texts in order, rows of their shapes, and each text's number of words.

    Long texts are hashed in stretches that end at white space.
    """
    words, shapes, counts = [], [], np.zeros(len(texts), dtype=np.int64)
    own: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        if not own:
            return
        data = np.frombuffer(b" ".join(t for _, t in own), dtype=np.uint8)
        up, back = scales(len(data))
        kind = KIND[data]
        edge = np.flatnonzero(np.diff(kind, prepend=np.int8(-1)) != 0)
        stop = np.append(edge[1:], len(data))
        real = kind[edge] > 0
        start, stop = edge[real], stop[real]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * up[: len(data)])])
        h = (sums[stop] - sums[start]) * back[start]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        words.append((h >> np.uint64(64 - 15)).astype(np.int32))
        ups = np.concatenate([[0], np.cumsum(UPPER[data])])
        n, up = stop - start, ups[stop] - ups[start]
        case = np.where(up == 0, 0, np.where((up == n) & (n > 1), 2, 1))
        shape = (kind[start] * 3 + case) * 16 + np.minimum(n, 15)
        shapes.append((shape.astype(np.uint64) * np.uint64(2654435761) % np.uint64(ROWS)).astype(np.int32))
        ends = np.cumsum([len(t) + 1 for _, t in own])
        counts[:] += np.bincount([k for k, _ in own], weights=np.diff(np.searchsorted(start, ends), prepend=0), minlength=len(texts)).astype(np.int64)

    for k, t in enumerate(texts):
        for part in stretches(t):
            if size + len(part) + 1 > FLAT:
                flush()
                own, size = [], 0
            own.append((k, part))
            size += len(part) + 1
    flush()
    none = np.zeros(0, np.int32)
    return np.concatenate([none, *words]), np.concatenate([none, *shapes]), counts


def _bytes(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def word_vectors(docs: DataFrame) -> np.ndarray:
    """ROWS x DIM: unit word vectors over all documents."""
    names = [f"v{k}" for k in range(DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ROWS * DIM)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                words, shapes, counts = word_rows(_bytes(batch.column(0)[at : at + 1024]))
                first = np.zeros(len(words) + 1, dtype=bool)
                first[np.cumsum(counts) - counts] = True  # no neighbours across documents
                inner = np.flatnonzero(~first[1 : len(words)])
                for near, of in ((words[inner], words[inner + 1]), (words[inner + 1], words[inner]), (shapes[inner], words[inner + 1]), (words, shapes)):
                    for k in range(NONZERO):
                        total += np.bincount(of.astype(np.int64) * DIM + PLACES[near, k], weights=SIGNS[near, k], minlength=ROWS * DIM)
        table = total.reshape(ROWS, DIM)
        row = np.flatnonzero(table.any(axis=1))
        for lo in range(0, len(row), 8192):
            own = row[lo : lo + 8192]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *(pa.array(table[own, k].astype(np.float32)) for k in range(DIM))], names=["row", *names])

    parts = mapped(docs.select("text"), run, "row int, " + ", ".join(f"{n} float" for n in names))
    sums = parts.groupBy("row").agg(*(F.sum(n).alias(n) for n in names)).toPandas()  # at most ROWS rows
    out = np.zeros((ROWS, DIM), dtype=np.float32)
    out[sums["row"].to_numpy(dtype=np.int64)] = sums[names].to_numpy(dtype=np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def features(texts: list[bytes], vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    words, shapes, counts = word_rows(texts)
    out = np.zeros((len(texts), FEATURES))
    full = np.flatnonzero(counts)
    if len(full):
        at = (np.cumsum(counts) - counts)[full]
        n = counts[full][:, None]
        context = np.add.reduceat(vectors[words] + vectors[shapes], at, axis=0, dtype=np.float64) / n
        own = np.add.reduceat(index[shapes] + 0.5 * index[words], at, axis=0, dtype=np.float64) / n
        one = np.add.reduceat(index[words], at, axis=0, dtype=np.float64) / n
        same = np.zeros(len(words))
        same[1:] = words[1:] == words[:-1]
        twice = np.add.reduceat(same, at)[:, None] / n
        out[full] = np.hstack([context, own, np.linalg.norm(one, axis=1, keepdims=True), np.linalg.norm(context, axis=1, keepdims=True), np.log1p(n), twice])
    return out


@dataclass
class Network:
    """Standardisation, two layers, and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 1) -> Network:
    """Adam on the logistic loss over four fifths; the temperature on the rest."""
    rng = np.random.default_rng(seed)
    share = float(y.mean()) if len(y) else 0.5
    constant = Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    if len(y) < 10 or share in (0.0, 1.0):
        return constant
    order = rng.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-6
    net = Network(mean, scale, rng.normal(0, FEATURES**-0.5, (FEATURES, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    z, t = np.clip((x[own] - mean) / scale, -8, 8), y[own].astype(float)
    params = [net.w1, net.b1, net.w2, np.array([0.0])]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(t)), max(1, len(t) // 128)):
            h = np.tanh(z[at] @ params[0] + params[1])
            g = (1 / (1 + np.exp(-(h @ params[2] + params[3]))) - t[at]) / len(at)
            back = np.outer(g, params[2]) * (1 - h * h)
            grads = [z[at].T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ g + 1e-4 * params[2], g.sum(keepdims=True)]
            step += 1
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                params[k] -= 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    raw, truth = net.logits(x[held]), y[held].astype(float)

    def loss(temperature: float) -> float:
        s = raw / temperature
        return float(np.mean(np.logaddexp(0, s) - truth * s))

    net.temperature = min(np.geomspace(0.5, 10, 60), key=loss)
    return net


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 20_000, mod: int = 4, rest: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    spark = docs.sparkSession
    context = spark.sparkContext
    shared = context.broadcast((word_vectors(docs), index_matrix()))  # of a fixed size
    draw = F.xxhash64("doc_id")
    picked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc32_mod(F.col("doc_id"), mod) != rest))
    picked = written(picked.select("doc_id", F.col(label).alias("y")).orderBy(draw, "y").limit(sample_rows), "sample")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(_bytes(batch.column(1)), *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    known = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", F.col("y").cast("int").alias("y"))
    rows = mapped(known, take, "doc_id long, y int, x array<double>").orderBy(draw, "y", "x").limit(sample_rows).collect()  # at most sample_rows
    x = np.array([r["x"] for r in rows], dtype=float).reshape(-1, FEATURES)
    net = context.broadcast(train(x, np.array([r["y"] for r in rows], dtype=float)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [net.value.probability(features(_bytes(batch.column(1)[at : at + 1024]), *shared.value)) for at in range(0, batch.num_rows, 1024)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0), *p]))], names=["doc_id", "score"])

    scored = mapped(docs.select(F.col("doc_id").cast("long"), "text"), score, "doc_id long, score double")
    return scored.select("doc_id", (crc32_mod(F.col("doc_id"), mod) == rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
