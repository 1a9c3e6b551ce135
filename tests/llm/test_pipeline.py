"""The pipeline's stages: each one's decision takes effect, and clean documents stay."""

import itertools
import random

import pytest

import corpus_pipeline
from quirelake.llm import near_copies


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(11)
    stock = {"aa": ["the", "house", "with", "garden", "and", "river", "stone"], "bb": ["das", "haus", "mit", "garten", "und", "fluss", "stein"]}
    prose = lambda lang, n: " ".join(rng.choice(stock[lang]) + rng.choice(["", "s", "en", "ly"]) for _ in range(n))
    rows = [(k, prose("aa" if k % 2 else "bb", 80), "aa" if k % 2 else "bb", "s", 0) for k in range(60)]
    clean = set(range(60))
    rows += [(60, rows[3][1].upper(), "aa", "s", 0), (61, None, "aa", "s", 0), (62, "12 !!", "bb", "s", 0)]
    passage = prose("aa", 30)
    rows.append((63, rows[5][1] + " " + passage, "aa", "s", 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), (clean - {3}) | {60}


def test_run_keeps_clean_documents_only(spark, folder):
    path, want = folder
    got = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in got} == want


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder[0]).columns == docs.columns


def overlap(a, b):
    a, b = ({tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_stage_takes_near_copies_out(spark, tmp_path):
    rng = random.Random(23)
    texts, want = [], set()
    # Shingles in common of 400: just over an overlap of 0.8, about 0.9, 0.97, and two that are too far apart.
    for tail, copy in [(43, True), (20, True), (6, True), (60, False), (120, False)]:
        for _ in range(12):
            base = [f"w{rng.randrange(5000)}" for _ in range(404)]
            near = base[: 404 - tail] + [f"v{rng.randrange(5000)}" for _ in range(tail)]
            want.add(len(texts))
            texts.append(" ".join(base))
            if not copy:
                want.add(len(texts))
            texts.append(" ".join(near))
            assert (overlap(texts[-2], texts[-1]) >= 0.8) == copy
    hot = [f"h{k}" for k in range(200)]
    want.add(len(texts))
    for k in range(80):  # a crowd of near copies, none of them equal
        texts.append(" ".join([*hot, f"x{k}"]))
    rows = [(k, t, "aa", "s", 0) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.near_stage(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == want and len(got) == len(want)


CLASH = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string, phrase_rate string, row string, _row string, component string, id string"


def test_stages_leave_clashing_columns_and_odd_rows_alone(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, *(f"{c}{k}" for c in "abcdefg")) for k, r in enumerate(docs)]
    rows += [(None, docs[7].text + " more", "bb", "s", 0, *"abcdefg"), (None, None, None, None, None, *[None] * 7), (3, docs[3].text, "aa", "s", 0, *"xxxxxxx")]
    table = spark.createDataFrame(rows, CLASH)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, table, folder[0])
        assert got.columns == table.columns, name
        assert set(got.collect()) <= set(table.collect()), name
        assert stage(spark, table.limit(0), folder[0]).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, table, folder[0]).where("doc_id IS NULL").count() == 2


def test_a_crowd_of_variants_is_joined_as_all_its_pairs_are(spark):
    rng = random.Random(31)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = []
    for _ in range(300):
        own = list(base)
        for at in rng.sample(range(200), rng.randrange(6)):
            own[at] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    texts += [" ".join(base[:100] + [f"u{k}x{j}" for j in range(100)]) for k in range(40)]  # half alike, in no group
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    want = {}
    for k in range(len(texts)):
        want.setdefault(root(k), []).append(k)
    want = {tuple(v) for v in want.values() if len(v) > 1}
    rows = near_copies.groups(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)).collect()
    got = {}
    for r in rows:
        got.setdefault(r.component, []).append(r.id)
    assert {tuple(sorted(v)) for v in got.values()} == want


def test_members_that_are_in_no_group_do_not_all_meet(spark, monkeypatch):
    rng = random.Random(47)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = []
    for _ in range(250):  # nine words of 150 changed, far apart: their neighbours by keys are below the overlap
        own = list(base)
        for at in range(rng.randrange(16), 150, 16):
            own[at] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    counts, whole = [], near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda docs, pairs: (counts.append(pairs.count()), whole(docs, pairs))[1])
    rows = near_copies.groups(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)).collect()
    assert rows == [] and sum(counts) < 250 * 40
