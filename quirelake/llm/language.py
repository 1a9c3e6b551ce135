"""Language identification by cross-parsing entropy (operator 10).

For each language, labelled text becomes a suffix automaton. A text is parsed
against each automaton into the longest pieces that occur there; the language
that needs the fewest phrases, normalised by the logarithm of its sample's
length, wins.

The labelled text is a bounded sample: at most ``sample_symbols`` letters in
all, shared evenly by the languages, or ``least_symbols`` for each where that is
more, from about ``sample_docs`` documents per language that a hash of doc_id
picks, a short passage from each. Every label is learned, so the model grows with
the number of languages alone. Every text is then scored whole. Long texts are parsed in stretches of ``STRETCH`` symbols, a
phrase ending at each stretch's end, so that many stretches advance together.
Longest-match parsing needs the fewest phrases of all parses into pieces of the
sample; the parse in stretches is one of those, and cutting the plain parse at
the stretches' ends is another. So a text of k stretches has at most k - 1 more
phrases than the plain parse, under any language: less than one in ``STRETCH``
symbols, which moves a language's bits a symbol by log2(sample) / STRETCH (0.02
at 96,000) at most.

An automaton's edges, at most three for each symbol of its sample, stand in a
dense array for the ``DENSE`` most frequent symbols of all samples, which is
made where it is used, and in a hash table for the others, whatever their number.

Defined cases: a null text, one without any letter (marks alone are none), and
any text when nothing labelled was learned give ``und`` with score 0; equal phrase counts go to the
name that sorts first; repeated rows are scored once each; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import Table, crc32_mod, mapped

STRETCH = 1024
#: Symbols whose edges are looked up in an array.
DENSE = 48
#: Texts are parsed in groups of about this many characters.
GROUP_CHARS = 4_000_000


class Edges:
    """Next states of an automaton by state and symbol (from 1), 0 where there is none."""

    def __init__(self, states: np.ndarray, symbols: np.ndarray, to: np.ndarray, width: int) -> None:
        self.states, self.symbols, self.to = (x.astype(np.int32) for x in (states, symbols, to))
        self.width = width
        self.dense: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"dense": None, "rest": None}

    def open(self) -> None:
        often = self.symbols < DENSE
        self.dense = np.zeros((int(self.states.max(initial=1)) + 2) * DENSE, dtype=np.int32)
        self.dense[self.states[often] * DENSE + self.symbols[often]] = self.to[often]
        rest = ~often
        self.rest = Table(self.states[rest].astype(np.uint64) * np.uint64(self.width) + self.symbols[rest].astype(np.uint64), self.to[rest].astype(np.int64))

    def get(self, state: np.ndarray, symbol: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """rare: places of symbols from DENSE on."""
        if self.dense is None:
            self.open()
        at = state * DENSE + symbol
        at[rare] = 0
        out = self.dense[at].astype(np.int64)
        if len(rare):
            out[rare] = self.rest.get((state[rare] * self.width + symbol[rare]).view(np.uint64))
        return out


@dataclass
class Model:
    """languages: names in order. symbols: symbol of each code point, 0 for no letter, frequent ones first.
    lettered: which code points are letters. width: number of symbols. tables: the edges of each language."""

    languages: list[str]
    symbols: np.ndarray
    lettered: np.ndarray
    width: int
    tables: list[Edges]
    sample_lengths: list[int]


def letters() -> tuple[np.ndarray, np.ndarray]:
    """The lower-case form of each code point that is a letter or a mark, else a space; and which are letters."""
    import unicodedata

    out, real = np.full(0x110000, 32, dtype=np.uint32), np.zeros(0x110000, dtype=bool)
    for c in range(0x110000):
        x = chr(c)
        real[c] = x.isalpha()
        if real[c] or (c > 127 and unicodedata.category(x)[0] == "M"):
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out, real


def automaton(symbols: np.ndarray, width: int) -> Edges:
    """Edges of the suffix automaton of a sequence of symbols (1 and up); the root is state 1."""
    nxt: list[dict[int, int]] = [{}, {}]
    link, length, last = [0, 0], [0, 0], 1
    for s in symbols.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and s not in nxt[p]:
            nxt[p][s] = cur
            p = link[p]
        if p:
            q = nxt[p][s]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p and nxt[p].get(s) == q:
                    nxt[p][s] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    states = np.repeat(np.arange(len(nxt)), [len(edges) for edges in nxt])
    own, to = (np.array([x for edges in nxt for x in side(edges)], dtype=np.int64) for side in (dict.keys, dict.values))
    return Edges(states, own, to, width)


def squeeze(codes: np.ndarray) -> np.ndarray:
    """Keep one of each run of spaces."""
    space = codes == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[:1] = True
    return codes[keep]


def build(samples: dict[str, list[str]], sample_symbols: int = 96_000, least_symbols: int = 4_000) -> Model:
    """A model from passages per language."""
    low, lettered = letters()
    names = sorted(samples)
    each = max(least_symbols, sample_symbols // max(1, len(names)))
    texts = {}
    for n in names:
        codes = [squeeze(low[np.frombuffer((" " + t).encode("utf-32-le", "replace"), dtype="<u4")]) for t in samples[n]]
        texts[n] = np.concatenate(codes)[:each] if codes else np.zeros(0, np.uint32)
    alphabet, often = np.unique(np.concatenate([np.array([32], np.uint32), *texts.values()]), return_counts=True)
    alphabet = alphabet[np.argsort(-often, kind="stable")]
    # Symbols: 0 for a space, 1.. for known letters, the most frequent first, the last for other letters.
    dense = np.zeros(0x110000, dtype=np.int32)
    dense[alphabet[alphabet != 32]] = np.arange(1, len(alphabet))
    other = len(alphabet)
    symbols = np.where(low == 32, 0, np.where(dense[low] > 0, dense[low], other)).astype(np.uint16)
    tables = [automaton(dense[texts[n]] + 1, other + 2) for n in names]
    return Model(names, symbols, lettered, other + 2, tables, [len(texts[n]) for n in names])


def fit(docs: DataFrame, sample_symbols: int = 96_000, sample_docs: int = 120, passage: int = 400, least_symbols: int = 4_000) -> Model:
    """Learn from the rows of docs whose lang and text are not null."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    labels = known.groupBy("lang").agg(F.count("*").alias("n"))
    counts = {r["lang"]: r["n"] for r in labels.collect()}  # a row for each language
    if not counts:
        return build({})
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample_docs / n))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    start = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(8)), F.greatest(F.char_length("text") - passage, F.lit(0)) + 1) + 1
    picked = known.where(draw <= share[F.col("lang")]).select("lang", "doc_id", F.substring("text", start, F.lit(passage)).alias("text"))
    samples: dict[str, list[str]] = {lang: [] for lang in counts}
    for r in sorted(picked.collect(), key=lambda r: (r["lang"], str(r["doc_id"]), r["text"])):  # about sample_docs passages per language
        samples[r["lang"]].append(r["text"])
    return build(samples, sample_symbols, least_symbols)


def count_phrases(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of each text (0 without any letter), and phrases of each text (rows) under each language (columns)."""
    raw = [("" if t is None else t) for t in texts]
    ends = np.cumsum([0, *map(len, raw)])
    codes = np.frombuffer("".join(raw).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sym = model.symbols[codes]
    first = np.zeros(len(sym), dtype=bool)
    first[ends[:-1][np.diff(ends) > 0]] = True
    keep = sym > 0
    keep[1:] |= (sym[:-1] > 0) & ~first[1:]
    owner = np.repeat(np.arange(len(raw)), np.diff(ends))
    real = np.bincount(owner, weights=model.lettered[codes], minlength=len(raw)) > 0
    owner = owner[keep]
    sym = sym[keep].astype(np.int64) + 1
    n = np.bincount(owner, minlength=len(raw))
    starts = np.cumsum(n) - n
    # A lane is a stretch of one text; lanes go longest first, so that those still running are a prefix.
    per = -(-n // STRETCH)
    doc = np.repeat(np.arange(len(raw)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    at = starts[doc] + nth * STRETCH
    size = np.minimum(STRETCH, n[doc] - nth * STRETCH)
    order = np.argsort(-size, kind="stable")
    doc, at, size = doc[order], at[order], size[order]
    alive = np.searchsorted(-size, -np.arange(STRETCH), side="left")
    phrases = np.zeros((len(raw), len(model.languages)))
    state = [np.ones(len(doc), dtype=np.int64) for _ in model.tables]
    count = [np.zeros(len(doc), dtype=np.int64) for _ in model.tables]
    for step in range(STRETCH):
        m = alive[step]
        if not m:
            break
        s = sym[at[:m] + step]
        rare = np.flatnonzero(s >= DENSE)
        for table, st, ct in zip(model.tables, state, count, strict=True):
            here = table.get(st[:m], s, rare)
            stuck = here == 0
            # A stuck stretch ends its phrase and starts the next with this symbol; one the language lacks is a phrase of its own.
            ct[:m] += stuck & (st[:m] != 1)
            again = s[stuck]
            fresh = table.get(np.ones(len(again), dtype=np.int64), again, np.flatnonzero(again >= DENSE))
            ct[:m][stuck] += fresh == 0
            here[stuck] = np.where(fresh == 0, 1, fresh)
            st[:m] = here
    for k, (st, ct) in enumerate(zip(state, count, strict=True)):
        phrases[:, k] = np.bincount(doc, weights=ct + (st != 1), minlength=len(raw))
    return np.where(real, n, 0), phrases


def decide(model: Model, n: np.ndarray, phrases: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and phrases per symbol of each text."""
    if not model.languages:
        return ["und"] * len(n), np.zeros(len(n)), np.ones(len(n))
    bits = phrases * np.log2(np.maximum(2, np.array(model.sample_lengths))) / np.maximum(n, 1)[:, None]
    best = bits.argmin(axis=1)
    score = 1 / np.exp(4 * (bits.min(axis=1, keepdims=True) - bits)).sum(axis=1)
    empty = n == 0
    names = ["und" if e else model.languages[b] for e, b in zip(empty, best, strict=True)]
    rate = np.take_along_axis(phrases, best[:, None], axis=1)[:, 0] / np.maximum(n, 1)
    return names, np.where(empty, 0.0, score), np.where(empty, 1.0, rate)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str, str] = ("lang_pred", "score", "phrase_rate")) -> DataFrame:
    """lang_pred, score and phrase_rate, by the names given, beside the columns named in ``keep``.

    phrase_rate is the winner's phrases per symbol: near 1 for text that no
    learned language explains.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by sample_symbols
    kinds = dict(docs.dtypes)
    fields = [*keep, *(() if "text" in keep else ("text",))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(fields.index("text"))
            lengths = np.concatenate([[0], np.cumsum([len(t or "") for t in texts.to_pylist()])])
            cuts = [0, *np.flatnonzero(np.diff(lengths // GROUP_CHARS)).tolist(), len(texts)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                found, sure, rate = decide(model, *count_phrases(model, texts[lo:hi].to_pylist()))
                cols = [batch.column(k)[lo:hi] for k, c in enumerate(fields) if c in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(found, pa.string()), pa.array(sure), pa.array(rate)], names=[*keep, *names])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", `{names[0]}` string, `{names[1]}` double, `{names[2]}` double"
    return mapped(docs.select(*fields), score, schema)


def identify(docs: DataFrame, held_out_mod: int = 4, held_out_rest: int = 2) -> DataFrame:
    """Predict each document's language, learning only from those not held out."""
    out = crc32_mod(F.col("doc_id"), held_out_mod) == held_out_rest
    return predict(docs, fit(docs.where(~out))).select("doc_id", out.alias("held_out"), "lang_pred", "score", "phrase_rate")
