"""Retrieval against plain versions that score everything."""

import math
import random
import re
from collections import Counter

import pytest

from quirelake.operators import context, linking, retrieval, vectors

SPANS = "path string, ordinal int, span_type string, text string"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(spans, queries, k):
    rows = [(p, o, words_of(t)) for p, o, kind, t in spans if kind != "scene"]
    n, mean = len(rows), sum(len(w) for *_, w in rows) / len(rows)
    df = Counter(t for *_, w in rows for t in set(w))
    weight = {t: math.floor(math.log((n - d + 0.5) / (d + 0.5) + 1) * 1024) for t, d in df.items()}
    out = []
    for q, text in queries:
        scored = []
        for p, o, w in rows:
            tf = Counter(w)
            shared = set(words_of(text)) & set(tf)
            if shared:
                scored.append((-sum(weight[t] * math.floor(tf[t] * 2.2 / (tf[t] + (len(w) / mean * 0.75 + 0.25) * 1.2) * 1024) for t in shared), p, o))
        out += [(q, rank, p, o, -s) for rank, (s, p, o) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 4, 60])
def test_lexical_search_equals_scoring_everything(spark, k, monkeypatch):
    monkeypatch.setattr(retrieval, "NEAR", 4)
    rng = random.Random(k)
    word = lambda: f"W{int(rng.random() ** 3 * 120)}"
    spans = [(f"d{n % 17}.md", n, rng.choice(["heading", "paragraph", "paragraph", "scene"]), "The " + " ".join(word() for _ in range(rng.randrange(30)))) for n in range(300)]
    spans += [("e.md", 0, "paragraph", ""), ("e.md", 1, "paragraph", None), ("e.md", 2, "heading", "the THE the"), *[(f"same{n}.md", 0, "paragraph", "w1 w2 w100 rare") for n in range(40)]]
    queries = [(q, " ".join(word() for _ in range(rng.randrange(1, 25)))) for q in range(12)] + [(50, "the"), (51, "rare w1"), (52, "nowhere"), (53, ""), (54, None)]
    index = retrieval.build(spark.createDataFrame(spans, SPANS).repartition(5))
    got = sorted(tuple(r[c] for c in ("query", "rank", "path", "ordinal", "score")) for r in retrieval.search(index, spark.createDataFrame(queries, "query long, text string"), k).collect())
    assert got == plain_search(spans, queries, k)


def test_nothing_is_found_in_nothing(spark):
    index = retrieval.build(spark.createDataFrame([], SPANS))
    assert retrieval.search(index, spark.createDataFrame([(1, "word")], "query long, text string")).count() == 0


def test_a_search_makes_no_row_for_each_query_and_span(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "NEAR", 8)
    monkeypatch.setattr(retrieval, "HELD", 700)
    rng = random.Random(9)
    spans = [(f"d{n:04}.md", 0, "paragraph", " ".join(f"w{rng.randrange(30)}" for _ in range(12))) for n in range(1500)]
    index = retrieval.build(spark.createDataFrame(spans, SPANS).repartition(2))
    asked = [(q, " ".join(f"w{rng.randrange(30)}" for _ in range(10))) for q in range(20)]
    terms = spark.createDataFrame([(q, w) for q, text in asked for w in set(text.split())], "query long, term string").join(index.terms, "term").selectExpr("0 AS part", "query", "term", "weight", "0L AS floor")
    rows = retrieval.scored(index.blocks, terms, 3).collect()
    groups = index.blocks.select("near").distinct().count()
    assert len(rows) <= 20 * 3 * groups < 20 * 1500 / 10
    got = sorted(tuple(r[c] for c in ("query", "rank", "path", "ordinal", "score")) for r in retrieval.search(index, spark.createDataFrame(asked, "query long, text string"), 3).collect())
    assert got == plain_search(spans, asked, 3)


# --- vectors


def directions(rng, n, width=12):
    centre = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    return [[rng.choice(centre)[d] * 0 + c + rng.gauss(0, 0.6) for d, c in enumerate(rng.choice(centre))] for _ in range(n)]


def plain_neighbours(rows, query, k):
    unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, v in rows if v and any(v)}
    if query not in unit:
        return []
    return sorted(((-sum(a * b for a, b in zip(unit[query], v, strict=True)), i) for i, v in unit.items() if i != query))[:k]


@pytest.fixture(scope="module")
def vector_rows():
    rng = random.Random(4)
    rows = list(enumerate(directions(rng, 900))) + [(5000 + n, [1.0] * 12) for n in range(400)]
    return rows + [(9000, None), (9001, []), (9002, [0.0] * 12), (9003, [1.0] * 5)]


def test_everything_searched_is_everything_found(spark, vector_rows, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 100)
    monkeypatch.setattr(vectors, "ASKED", 8)
    df = spark.createDataFrame(vector_rows, "id long, vector array<float>").repartition(3)
    asked = df.where("id % 30 = 0").selectExpr("id AS query", "vector")
    got = {}
    for r in sorted(vectors.exhaustive(df, asked, 7, others=True).collect(), key=lambda r: (r.query, r["rank"])):
        got.setdefault(r.query, []).append((r.id, r.score))
    good = [(i, v) for i, v in vector_rows if v and len(v) == 12]
    for query in {i for i, _ in vector_rows if i % 30 == 0}:
        want = plain_neighbours(good, query, 7)
        assert len(got.get(query, [])) == len(want)
        for (_, score), (less, _) in zip(got.get(query, []), want, strict=True):
            assert score == pytest.approx(-less, abs=1e-6)


def test_an_index_finds_nine_in_ten(spark, vector_rows, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 4)
    df = spark.createDataFrame(vector_rows, "id long, vector array<float>").repartition(3)
    asked = df.where("id % 20 = 0").selectExpr("id AS query", "vector")
    index = vectors.build(df, parts=6)
    probes = vectors.probes_for(index, asked, recall=0.97)
    assert probes < len(index.codes.coarse)
    got = {}
    for r in vectors.search(index, asked, 10, probes, 80, others=True).collect():
        got.setdefault(r.query, []).append(r.score)
    hits = wanted = 0
    good = [(i, v) for i, v in vector_rows if v and len(v) == 12]
    for query in {i for i, _ in good if i % 20 == 0}:
        least = -plain_neighbours(good, query, 10)[-1][0]
        hits += sum(s >= least - 1e-6 for s in got.get(query, []))
        wanted += 10
    assert hits >= 0.9 * wanted and set(got) == {i for i, _ in good if i % 20 == 0}
    assert max(r.n for r in index.blocks.selectExpr("size(ids) AS n").collect()) < 400  # one direction that a third share is many blocks


def test_no_vectors(spark):
    none = spark.createDataFrame([], "id long, vector array<float>")
    asked = spark.createDataFrame([(1, [1.0])], "query long, vector array<float>")
    assert vectors.search(vectors.build(none), asked).count() == 0 and vectors.exhaustive(none, asked).count() == 0
    one = spark.createDataFrame([(7, [2.0, 0.0])], "id long, vector array<float>")
    asked = spark.createDataFrame([(1, [5.0, 0.0]), (2, [1.0]), (3, None)], "query long, vector array<float>")
    assert [tuple(r) for r in vectors.search(vectors.build(one), asked).collect()] == [(1, 1, 7, 1.0)]


def test_trusted_rankings_come_first(spark):
    ranking = lambda *rows: spark.createDataFrame(list(rows), "query long, rank int, item long")
    got = vectors.fused([ranking((1, 1, 10), (1, 2, 11), (2, 1, 5)), ranking((1, 1, 12), (1, 2, 11), (3, 4, 1))], 2).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 11, 0, 2 * (1_000_000 // 62)), (1, 2, 10, 0, 1_000_000 // 61), (2, 1, 5, 0, 1_000_000 // 61), (3, 1, 1, 1, 1_000_000 // 64)]


# --- context


def test_room_is_filled_in_order_and_never_passed(spark):
    rng = random.Random(2)
    rows = [(f"r{n % 9}", rng.randrange(4), rng.randrange(30), rng.choice([0, 1, 5, 40, 90, 500]), f"k{n}") for n in range(700)] + [("r0", 0, 0, None, "null"), ("r0", 0, 0, -1, "less"), ("none", 0, 0, 1, "x")]
    budgets = [(f"r{n}", [0, 100, 300, 1000][n % 4]) for n in range(10)]
    got = context.assemble(spark.createDataFrame(rows, "request_id string, class int, rank int, size long, key string").repartition(4), spark.createDataFrame(budgets, "request_id string, budget long")).collect()
    want = {}
    for request, budget in budgets:
        used = 0
        for _, c, k, size, key in sorted(r for r in rows if r[0] == request and r[3] is not None and 0 <= r[3] <= budget):
            taken = used + size <= budget
            used += size * taken
            want[key] = (taken, used)
    assert {r.key: (r.taken, r.used) for r in got if r.used is not None} == want
    assert {r.key for r in got if r.used is None} == {r[4] for r in rows if r[4] not in want and r[0] != "none"} and not any(r.taken for r in got if r.used is None)


# --- links


def plain_links(text, names):
    out, at = [], 0
    while text and at < len(text):
        fits = [n for n in names if n and text.startswith(n, at) and not (at and text[at - 1].isalnum()) and not text[at + len(n) : at + len(n) + 1].isalnum()]
        if fits:
            name = max(fits, key=len)
            out.append((at, at + len(name), name))
            at += len(name)
        else:
            at += 1
    return out


@pytest.mark.parametrize("shard_names", [50_000, 7])
def test_links_are_those_of_a_plain_search(spark, shard_names):
    rng = random.Random(shard_names)
    names = ["Ada", "Ada Lo", "Lo", "Lo Ve", "Ve lace", "a", "é", "Ångström 5", "5", "x-y", "-", "(q)", "", None, "Ada", "Lo Ve lace Ada Lo"]
    texts = ["", None, "Ada", "Adam Ada.", "Ada Lo Ve lace", "Lo Ve lace Ada Lov", "éé é", "Ångström 5 Ångström 55", "(q)x-y--", "a" * 5000] + [" ".join(rng.choice([*filter(None, names), "z", "Lo Ve", "Adal"]) for _ in range(rng.randrange(12))) for _ in range(200)]
    spans = spark.createDataFrame([(f"p{n % 5}", n, t) for n, t in enumerate(texts)], "path string, ordinal int, text string").repartition(3)
    got = linking.link(spans, spark.createDataFrame([(n,) for n in names], "name string"), shard_names).collect()
    want = [(f"p{n % 5}", n, *m) for n, t in enumerate(texts) for m in plain_links(t, set(filter(None, names)))]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert linking.link(spans, spark.createDataFrame([], "name string")).count() == 0
