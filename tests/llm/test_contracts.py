"""Each training-data operator against a brute-force version or its SQL, on rows with planted trouble."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import pytest

from quirelake.llm import context_tree, decontamination, exact_dedup, language, line_dedup, packing, quality, quotation, simhash, suffix_dedup
from quirelake.llm import queries as llm
from tests.compare import same

SCHEMA = "doc_id long, text string, lang string, source string, fp string, row_id string, length string"


def table(spark, texts, langs=None):
    rows = [(k, t, langs[k] if langs else "en", "s", "x", "y", "z") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = words(rng, 300)
    out = [base, base.upper(), base + " tail", base.replace("w1 ", "w2 ", 1), "", None, "   ", "one", "two words", "Ünïcödé ß " * 80, "a" * 3000, words(rng, 20_000)]
    return out + [words(rng, rng.randrange(1, 120), 30) for _ in range(60)] + ["same old text"] * 40


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same(spark, llm.queries()[name], llm.oracle_sql()[name])


def benchmark_of(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item_id long, text string")


def labels_of(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


BY_DOCUMENT = {
    "decontaminate": lambda s, d: decontamination.decontaminate(d, benchmark_of(s, "two words", None)),
    "exact": lambda s, d: exact_dedup.exact_dedup(d),
    "simhash": lambda s, d: simhash.near_dedup(d),
    "suffix": lambda s, d: suffix_dedup.remove_repeats(d),
    "score": lambda s, d: context_tree.score_documents(d),
    "quality": lambda s, d: quality.classify(d, labels_of(s, (1, 1, 0), (1, 1, 0), (None, 0, 0), (2, None, 0))),
    "language": lambda s, d: language.identify(d),
}


@pytest.mark.parametrize("name", sorted(BY_DOCUMENT))
def test_null_and_repeated_ids_keep_their_rows(spark, name):
    long = words(random.Random(8), 200)
    rows = [(None, long), (None, None), (7, long), (7, long), (7, ""), (3, "two words"), (None, "two words")]
    docs = spark.createDataFrame([(d, t, None if k % 2 else "en", "s", "f", "r", "l") for k, (d, t) in enumerate(rows)], SCHEMA)
    got = BY_DOCUMENT[name](spark, docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in rows)


@pytest.mark.parametrize("name", sorted(BY_DOCUMENT))
def test_empty_tables_give_empty_results(spark, name):
    assert BY_DOCUMENT[name](spark, table(spark, ["x"]).limit(0)).count() == 0


def test_other_empty_tables(spark):
    none = table(spark, ["x"]).limit(0)
    assert line_dedup.line_dedup(none).count() == 0
    assert packing.pack(none).count() == 0
    assert quotation.reply_ordered(spark.createDataFrame([], "conv_id string, turn long, role string, text string")).count() == 0
    got = decontamination.digest(decontamination.decontaminate(table(spark, ["one two"]), benchmark_of(spark).limit(0))).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(2, 0, False)]


def test_lines_and_pieces_of_null_and_repeated_ids(spark):
    rows = [(None, "a line of some length\nb"), (7, "a line of some length"), (7, "a line of some length"), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", "f", "r", "l") for d, t in rows], SCHEMA)
    got = line_dedup.line_dedup(docs).collect()
    assert sorted((str(r.doc_id), r.line_no, r.n_copies, r.kept) for r in got) == [("7", 0, 3, False), ("7", 0, 3, False), ("None", 0, 3, True), ("None", 1, 1, True)]
    assert sorted(str(r.doc_id) for r in packing.pack(docs).collect()) == ["7", "7", "None", "None"]


def test_proximity_takes_words_near_their_places(spark):
    made = ["the old red fox ran", "the red old fox ran", "the old and red and fox", "fox red old the"]
    found = decontamination.decontaminate(table(spark, made), benchmark_of(spark, "the old red fox"), slack=1)
    assert {r.doc_id for r in found.collect() if r["items"]} == {0, 1}


def test_blocks_of_the_benchmark_add_up(spark, texts):
    items = benchmark_of(spark, *(" ".join(t.split()[:30]) for t in texts if t and t.split()), "one", None)
    docs = table(spark, texts)
    whole = decontamination.digest(decontamination.decontaminate(docs, items)).collect()
    assert sorted(whole) == sorted(decontamination.digest(decontamination.decontaminate(docs, items, block_bytes=2000)).collect())
    assert any(r.contaminated for r in whole)


def test_decontamination_finds_every_window(spark, texts):
    def split(t):
        folded = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
        return "".join(chr(c) if chr(c).isalnum() or c > 127 else " " for c in folded).split()

    items = [("b1", " ".join(texts[0].split()[40:60])), ("b2", "Two, WORDS"), ("b3", None), ("b4", "..."), ("b5", "nowhere at all"), (None, "one"), ("b1", "same old text")]
    got = decontamination.digest(decontamination.decontaminate(table(spark, texts), spark.createDataFrame(items, "item_id string, text string"))).collect()
    windows = {}
    for item, text in items:
        w = split(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(item or "")
    for r in got:
        w, hit, found = split(texts[r.doc_id]), set(), set()
        for win, names in windows.items():
            for at in range(len(w) - len(win) + 1):
                if tuple(w[at : at + len(win)]) == win:
                    hit |= set(range(at, at + len(win)))
                    found |= names
        want = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), want, bool(hit))
    assert len(got) == len(texts)


def test_exact_dedup_survives_clashing_fingerprints(spark, texts):
    from pyspark.sql import functions as F

    bad = lambda c: F.length(c).cast("long") % 3
    for how in ({}, {"fingerprint": bad, "pattern": exact_dedup.cut_pattern(8, 32)}):
        got = exact_dedup.groups(exact_dedup.recipes(table(spark, texts), **how)).collect()
        norm = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for t in texts]
        last = {t: k for k, t in enumerate(norm)}
        sizes = Counter(norm)
        for r in got:
            t = norm[r.doc_id]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (last[t], sizes[t], last[t] == r.doc_id, hashlib.sha256(t.encode()).hexdigest())
        assert len(got) == len(texts)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def close(a, b):
    n = min(len(a), len(b))
    most = 2 if n >= 30 else 1 if n >= 10 else 0
    return abs(len(a) - len(b)) <= most and distance(a, b) <= most


def edited(rng, line, times):
    line = list(line)
    for _ in range(times):
        at = rng.randrange(len(line))
        line[at : at + rng.randrange(2)] = rng.choice(["", "q", "é"])
    return "".join(line)


def test_line_dedup_links_lines_within_their_edits(spark):
    rng = random.Random(2)
    base = [words(rng, n) for n in (12, 12, 12, 12, 9, 8, 7, 3, 3, 4, 4, 2)] + ["twelve chars", "x" * 29, "x" * 30, "x" * 32, "short one"]
    own = [edited(rng, line, rng.randrange(4)) for line in base * 4] + base
    made = ["\n".join(own[k : k + 4]) for k in range(0, len(own), 4)] + [None, "", "\n \n", "short\nshort"]
    got = line_dedup.line_dedup(table(spark, made)).collect()
    at = {(r.doc_id, r.line_no): made[r.doc_id].split("\n")[r.line_no] for r in got}
    near = {x: {x} for x in at.values()}
    degree = Counter()
    for a, b in itertools.combinations(sorted(near), 2):
        if close(a, b):
            degree[a] += 1
            degree[b] += 1
            joined = near[a] | near[b]
            for x in joined:
                near[x] = joined
    for r in got:
        line = at[r.doc_id, r.line_no]
        first = min(k for k, x in at.items() if x in near[line])
        assert ((r.class_doc_id, r.class_line_no), r.n_links, r.kept) == (first, degree[line], first == (r.doc_id, r.line_no))


def test_a_byte_order_mark_is_a_character(spark):
    line, other = "\ufeffharbour wardens keep", "harQour wardens keep"
    pairs = [(line, other), (line, line[1:]), (line[1:], other), ("har\ufeffbour wardens keep", "harbour wardens keep"), ("har\ufeffbour wardens keep", other), (line, "\ufeff" + other)]
    for x, y in pairs:
        rows = line_dedup.line_dedup(table(spark, [x, y])).collect()
        assert {r.n_links for r in rows} == {int(close(x, y))}, (x, y)


@pytest.mark.parametrize(("crowd", "apart"), [(2, 2), (2, 30)])
def test_crowded_segments_lose_no_link(spark, crowd, apart):
    rng = random.Random(6)
    made = set()
    for n in (4, 9, 26):
        base = words(rng, n)
        made |= {edited(rng, base, rng.randrange(4)) for _ in range(70)}
        made |= {base + f" {k} of {k % 7}" for k in range(40)}
    made = sorted(made)
    entries = spark.createDataFrame(list(enumerate(made)), "id long, line string")
    found = line_dedup.candidates(entries, crowd, apart).collect()
    assert len({(r.a, r.b) for r in found}) == len(found)
    want = {(a, b) for a, b in itertools.combinations(range(len(made)), 2) if close(made[a], made[b])}
    assert want and want <= {(r.a, r.b) for r in found}


def test_context_tree_counts_and_favours_seen_text(spark, texts):
    got = {r.doc_id: r for r in context_tree.score_documents(table(spark, texts)).collect()}
    split = [bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split() + [None] for t in texts]
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))]
    seen = Counter(w for k, ws in enumerate(split) if not held[k] for w in ws)
    total = sum(seen.values())
    import math

    for k, ws in enumerate(split):
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(ws), sum(w in seen for w in ws), total)
        base = sum(math.log10((seen[w] + 1) / (total + len(seen) + 1)) for w in ws)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0


def test_context_tree_equals_a_plain_one(spark):
    import math

    depth, edge = 3, 255
    made = ["abracadabra abra", "abra cad é", "", None, "zzz", "cadabra", "abracadabra", "q"] * 2
    kept = [(k, [edge] * depth + list((t or "").encode()) + [edge]) for k, t in enumerate(made)]
    node = Counter()
    bits = lambda byte: [(byte >> (8 - k) | 1 << k, byte >> (7 - k) & 1) for k in range(8)]
    for k, data in kept:
        if zlib.crc32(str(k).encode()) % 7 != 2:
            for at in range(depth, len(data)):
                for branch, bit in bits(data[at]):
                    for d in range(depth + 1):
                        node[tuple(data[at - d : at]), branch, bit] += 1
    own, deep = {}, {}
    for c, branch, _ in node:
        n0, n1 = node[c, branch, 0], node[c, branch, 1]
        own[c, branch] = math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(n0 + n1 + 1)
    for c, branch in sorted(own, key=lambda x: -len(x[0])):
        if len(c) == depth:
            deep[c, branch] = own[c, branch]
        else:
            below = sum(v for (x, b), v in deep.items() if len(x) == len(c) + 1 and x[1:] == c and b == branch)
            deep[c, branch] = math.log(0.5) + max(own[c, branch], below) + math.log1p(math.exp(-abs(own[c, branch] - below)))
    got = {r.doc_id: r.score for r in context_tree.score_documents(table(spark, made), depth=depth).collect()}
    for k, data in kept:
        score = 0.0
        for at in range(depth, len(data)):
            for branch, bit in bits(data[at]):
                for d in range(depth, -1, -1):
                    c = tuple(data[at - d : at])
                    n = node[c, branch, 0] + node[c, branch, 1]
                    here = (node[c, branch, bit] + 0.5) / (n + 1)
                    share = 0.5 * math.exp(own.get((c, branch), 0.0) - deep.get((c, branch), 0.0))
                    p = here if d == depth else share * here + (1 - share) * p
                score += math.log10(p)
        assert got[k] == pytest.approx(score, rel=1e-5), made[k]


def test_long_texts_score_alike_in_any_blocks(spark):
    rng = random.Random(15)
    made = [words(rng, 240_000), words(rng, 300), "", None, words(rng, 20)]
    assert len(made[0]) > 1 << 20
    got = {r.doc_id: r for r in context_tree.score_documents(table(spark, made), depth=3).collect()}
    cut = {r.doc_id: r for r in context_tree.score_documents(table(spark, made), depth=3, block_bytes=1 << 10, shard_bytes=1 << 16).collect()}
    assert [got[k].n_tokens for k in range(5)] == [240_001, 301, 1, 1, 21]
    for k in range(5):
        assert (got[k].n_known, got[k].train_tokens, got[k].base_score) == (cut[k].n_known, cut[k].train_tokens, pytest.approx(cut[k].base_score))
        assert got[k].score == pytest.approx(cut[k].score, rel=1e-5)


@pytest.mark.parametrize("fan, heavy", [(2, 3), (3, 256), (128, 1)])
def test_rounds_and_heavy_pairs_change_nothing(spark, monkeypatch, fan, heavy):
    rng = random.Random(18)
    made = [words(rng, rng.randrange(1, 90), 50) for _ in range(40)] + ["", None]
    want = {r.doc_id: r for r in context_tree.score_documents(table(spark, made)).collect()}
    monkeypatch.setattr(context_tree, "FAN", fan)
    monkeypatch.setattr(context_tree, "HEAVY", heavy)
    got = context_tree.score_documents(table(spark, made), block_bytes=400, shard_bytes=1000).collect()
    assert len(got) == len(made)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (w.n_tokens, w.n_known, w.train_tokens, pytest.approx(w.base_score))
        assert r.score == pytest.approx(w.score, rel=1e-5)


def test_simhash_components(spark, texts):
    import xxhash

    prints = []
    for t in texts:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    label = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2 and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    got = simhash.digest(simhash.near_dedup(table(spark, texts))).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == [(k, f"{prints[k]:016x}", label[k]) for k in range(len(texts))]


def test_simhash_index_misses_no_link(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(300)]
    every = {x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in base} | set(base)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in every]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), node_rows=40).collect()
    want = {(a, b) for (a,), (b,) in itertools.permutations(signed, 2) if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert {(r.a, r.b) for r in found} == want
    assert len(found) == len(want)


@pytest.mark.parametrize("group_bytes", [16 << 20, 7_200])
def test_suffix_dedup_removes_what_starts_twice(spark, texts, group_bytes):
    rng = random.Random(7)
    passage = words(rng, 160)
    made = [*texts, "x " + passage + " y", passage[30:], "z" + passage[:420], passage + passage[:399], words(rng, 40) + passage[200:500] + words(rng, 40), "q " * 90 + words(rng, 9)]
    made += [words(rng, 30) + passage[600 : 700 + 12 * k] + words(rng, 60) for k in range(30)]  # one hot group of contexts that differ
    raw = [(t or "").encode() for t in made]

    def ranges(size):
        seen = Counter(r[k : k + size] for r in raw for k in range(len(r) - size + 1))
        for r in raw:
            gone = bytearray(len(r))
            for at in range(len(r) - size + 1):
                if seen[r[at : at + size]] > 1:
                    gone[at : at + size] = b"\1" * size
            yield gone

    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(table(spark, made), group_bytes=group_bytes).collect()}
    assert len(got) == len(made)
    for k, (r, gone, found) in enumerate(zip(raw, ranges(400), ranges(200), strict=True)):
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        spans = sum(1 for g, _ in itertools.groupby(gone) if g)
        held = [bytes(c for c, _ in own) for g, own in itertools.groupby(zip(r, found, strict=True), lambda x: x[1]) if g]
        want = (len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest(), sum(len(x.split()) > 50 for x in held))
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256, got[k].n_passages) == want


def test_repeats_across_stretches_of_long_texts(spark):
    rng = random.Random(16)
    text = "".join(rng.choice("abcdefgh ") for _ in range(1_150_000))
    edge = suffix_dedup.FLAT
    passage = text[edge - 300 : edge + 300]
    made = [text, "start " + passage + " end", text[:100] + text[1_100_000:1_100_500]]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(table(spark, made)).collect()}
    assert [(got[k].n_removed, got[k].n_spans) for k in range(3)] == [(1100, 2), (600, 1), (500, 1)]


def test_quality_learns_what_is_marked(spark):
    rng = random.Random(1)
    good = ["".join(rng.choice(["the ", "calm ", "river ", "runs ", "to ", "sea "]) for _ in range(60)) for _ in range(120)]
    bad = [" ".join(rng.choice(["click!!", "WIN", "$$$", "now"]) for _ in range(60)) for _ in range(120)]
    made = [x for pair in zip(good, bad, strict=True) for x in pair] + ["", None]
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(240)], "doc_id long, quality int, toxic int")
    got = quality.classify(table(spark, made), labels).collect()
    held = [r for r in got if r.held_out and r.doc_id < 240]
    assert sum((r.score >= 0.5) == (r.doc_id % 2 == 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert len(got) == len(made)


def plain_words(text):
    """(word, shape) of runs of letters, digits and other marks."""
    import re

    out = []
    for m in re.finditer(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff \t\n\r\v\f]+", text):
        w = m[0]
        kind = 1 if w[0] >= 128 or chr(w[0]).isalpha() else 2 if chr(w[0]).isdigit() else 3
        ups = sum(65 <= c <= 90 for c in w)
        out.append((w, (kind * 3 + (0 if not ups else 2 if ups == len(w) > 1 else 1)) * 16 + min(len(w), 15)))
    return out


def plain_row(word):
    mask = (1 << 64) - 1
    h, scale = 0, 1
    for c in word:
        h, scale = (h + int(quality.BYTE[c]) * scale) & mask, scale * int(quality.STEP) & mask
    h = (h ^ h >> 31) * 0xD6E8FEB86659FD93 & mask
    return h >> 49


def test_word_vectors_and_features_equal_plain_ones(spark):
    import numpy as np

    made = ["The calm river, the sea!", "WIN 100 now now", "", None, "Éa b  c\td e", "x"]
    split = [[(plain_row(w), s * 2654435761 % quality.ROWS) for w, s in plain_words((t or "").encode())] for t in made]
    vectors = np.zeros((quality.ROWS, quality.DIM))
    index = quality.index_matrix()
    for own in split:
        for k, (w, s) in enumerate(own):
            vectors[s] += index[w]
            for other, shape in own[max(0, k - 1) : k]:
                vectors[w] += index[other] + index[shape]
                vectors[other] += index[w]
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = (vectors / np.maximum(norm, 1e-9)).astype(np.float32)
    got = quality.word_vectors(table(spark, made))
    assert np.allclose(got, vectors, atol=1e-5)
    x = quality.features([(t or "").encode() for t in made], got, index)
    for k, own in enumerate(split):
        if not own:
            assert not x[k].any()
            continue
        n = len(own)
        context = sum(vectors[w] + vectors[s] for w, s in own) / n
        marks = sum(index[s] + 0.5 * index[w] for w, s in own) / n
        one = sum(index[w] for w, _ in own) / n
        twice = sum(a[0] == b[0] for a, b in zip(own, own[1:], strict=False)) / n
        want = np.concatenate([context, marks, [np.linalg.norm(one), np.linalg.norm(context), np.log1p(n), twice]])
        assert np.allclose(x[k], want, atol=1e-5)


def test_network_equals_a_plain_one():
    import math

    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, quality.FEATURES))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    net = quality.train(x, y)
    for row, p in zip(x[:5], net.probability(x[:5]), strict=True):
        z = [max(-8, min(8, (v - m) / s)) for v, m, s in zip(row, net.mean, net.scale, strict=True)]
        hidden = [math.tanh(sum(a * w for a, w in zip(z, net.w1[:, j], strict=True)) + net.b1[j]) for j in range(net.w1.shape[1])]
        logit = (sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + net.b2) / net.temperature
        assert p == pytest.approx(1 / (1 + math.exp(-logit)))
    assert ((net.probability(x) >= 0.5) == y).mean() > 0.9


def test_long_texts_are_cut_at_white_space_only():
    rng = random.Random(14)
    long = words(rng, 260_000).encode()
    assert len(long) > 1 << 20
    odd = b"x" * (quality.FLAT + 10) + b" " + b"y z" + b"w" * 2 * quality.FLAT
    got_words, got_shapes, counts = quality.word_rows([b"a b", long, odd, b""])
    plain = [plain_words(t) for t in (b"a b", long)]
    assert counts.tolist() == [2, len(plain[1]), 3, 0]
    known = {}
    want = [known[w] if w in known else known.setdefault(w, plain_row(w)) for own in plain for w, _ in own]
    assert got_words[: len(want)].tolist() == want
    assert got_words[len(want)] == plain_row(odd.split()[0])


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(table(spark, ["a", None]), none).collect()} == {0.5}


def test_quotes_link_to_what_they_quote(spark):
    talk = [
        ("c", 0, "user", "The tide turns at nine.\nBring the lamp."),
        ("c", 1, "bot", "Noted."),
        ("c", 2, "user", "Ana wrote:\n> the TIDE turns, at nine\n>> unknown words\nWhich day?"),
        ("c", 3, "bot", "> Which day?\nMonday."),
        ("c", 4, "user", None),
        ("d", 7, "user", "> Noted.\nAlone."),
        (None, 0, "user", "lost"),
        ("e", None, "user", ""),
    ]
    rows = spark.createDataFrame([(*t, "x") for t in talk], "conv_id string, turn long, role string, text string, head string")
    got = {(r.conv_id, r.turn): r for r in quotation.reply_ordered(rows).collect()}
    assert len(got) == len(talk)
    assert [(got["c", k].parent_turn, got["c", k].root_turn, got["c", k].depth) for k in range(5)] == [(None, 0, 0), (0, 0, 1), (0, 0, 1), (2, 0, 2), (3, 0, 3)]
    assert (got["c", 2].own_text, got["c", 2].n_quoted, got["c", 2].n_linked) == ("Which day?", 2, 1)
    assert (got["d", 7].parent_turn, got["d", 7].n_linked) == (None, 0)


def test_wrapped_and_partial_quotes_link(spark):
    long = "The tide turns at nine and the harbour master wants every boat out of the inner basin before the lock is shut for the night. Bring the lamp."
    talk = [
        ("c", 0, "user", long + "\nAnd a rope."),
        ("c", 1, "bot", "Noted, the boat is ready."),
        ("c", 2, "user", "Nothing of that."),
        ("c", 3, "bot", "> The tide turns at nine and the harbour master wants every boat out\n> of the inner basin before the lock is shut for the\n> night.\nWhy?"),
        ("c", 4, "user", "Fine."),
        ("c", 5, "bot", "> Bring the lamp.\nWhich?"),
        ("c", 6, "bot", "> the harbour master wants every boat out of the inner basin before the lock\n\nDoes he?"),
        ("c", 7, "bot", ">> shut for the night. Bring the lamp. And a\n>> rope.\n> which\nNo."),
        ("c", 8, "bot", "> The tide turns at nine and the harbour master wants no boat at all\n> the\nNo."),
    ]
    rows = spark.createDataFrame(talk * 2, "conv_id string, turn long, role string, text string")
    got = {r.turn: r for r in quotation.reply_ordered(rows).collect()}
    assert [(got[k].parent_turn, got[k].n_quoted, got[k].n_linked) for k in (3, 5, 6, 7, 8)] == [(0, 6, 6), (0, 2, 2), (0, 2, 2), (5, 6, 6), (7, 4, 0)]
    assert (got[3].root_turn, got[3].depth, got[7].depth) == (0, 1, 2)


def test_threads_cross_blocks_of_turns(spark):
    rng = random.Random(4)
    parents = [None] + [k - 1 if rng.random() < 0.97 else rng.randrange(k) for k in range(1, 1500)]
    depth = []
    for p in parents:
        depth.append(0 if p is None else depth[p] + 1)
    links = spark.createDataFrame([("c", k, p, 0, 0) for k, p in enumerate(parents)], "conv_id string, turn long, parent_turn long, n_quoted long, n_linked long")
    got = quotation.threads(links).orderBy("turn").collect()
    assert [(r.root_turn, r.depth) for r in got] == [(0, d) for d in depth]


def test_packing_is_whole_gapless_and_tight(spark, texts):
    from tokenizers import Tokenizer

    assert packing.token_bytes(["ab<|endoftext|>cd"])[0] == b"".join(x.to_bytes(4, "little") for x in (3937, 49407, 4480))
    rng = random.Random(17)
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "Don't", "é", "ß", "漢", " ", "  ", "\n", ".", "!!", "12", "a", "Ünï", "\u0301", "\u00a0", "x's", "ﬁ", "<|", "|>"]
    mixed = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(400)]
    odd = [*mixed, "don't stop—now <|endoftext|> x<|startoftext|>", "ﬁne ½ ① nbsp\tTab\r\nİstanbul ẞ", "é café naïve ŒUVRE 漢字 ,,,a... ((b)) 12ab's"]
    made = [*texts, *odd]
    got = packing.pack(table(spark, made)).collect()
    t = Tokenizer.from_file(packing.tokenizer_path())
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(made)))
    total = 0
    for k, rows in by_doc.items():
        ids = [*t.encode(made[k] or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for n, r in enumerate(sorted(rows, key=lambda r: r.piece)):
            own = ids[n * 4096 : (n + 1) * 4096]
            assert (r.piece, r.start, r.length) == (n, n * 4096, len(own)), made[k]
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own)), made[k]
        assert len(rows) == -(-len(ids) // 4096)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert len(by_sequence) <= -(-total // 4096) + 2


def test_phrases_are_those_of_a_plain_cross_parse(spark):
    import numpy as np

    rng = random.Random(12)
    prose = lambda stock, n: " ".join(rng.choice(stock) for _ in range(n))
    stock = {"aa": ["tree", "treason", "reason", "on"], "bb": ["baum", "grund", "und"], "zh": ["山水", "水火", "火山口"]}
    samples = {k: [prose(v, 40) for _ in range(3)] for k, v in stock.items()}
    model = language.build(samples)
    low, _ = language.letters()
    code = lambda t: "".join(map(chr, low[np.frombuffer(t.encode("utf-32-le"), dtype="<u4")]))
    norm = lambda t: " ".join(code(t).split(" ")) if t else ""

    def squeezed(t):
        out = ""
        for c in norm(t):
            if c != " " or not out.endswith(" "):
                out += c
        return out

    def phrases(text, sample):
        at = count = 0
        while at < len(text):
            n = 1
            while at + n <= len(text) and text[at : at + n] in sample:
                n += 1
            at, count = at + max(1, n - 1), count + 1
        return count

    made = ["tree reason", prose(stock["bb"], 30), "山水 水火?", "xyz 123 baum", prose(stock["aa"], 600), "", "!!", "\u0301\u0302"]
    n, got = language.count_phrases(model, made)
    sample = {k: "".join(squeezed(" " + t) for t in v) for k, v in samples.items()}
    for k, t in enumerate(made):
        own = squeezed(t).rstrip(" ") if not any(c.isalpha() for c in t) else squeezed(t)
        own = own[1:] if own.startswith(" ") else own
        if not any(c.isalpha() for c in t):
            assert n[k] == 0
            continue
        for j, lang in enumerate(model.languages):
            plain = phrases(own, sample[lang])
            assert plain <= got[k, j] <= plain + len(own) // language.STRETCH, (t[:20], lang)


def test_language_tables_do_not_grow_with_the_alphabet(spark):
    rng = random.Random(13)
    made = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(400)) for _ in range(150)]
    model = language.build({"zh": made, "xx": ["plain words"]})
    for t in model.tables:
        t.open()
    size = sum(t.dense.nbytes + sum(a.nbytes for layer in t.rest.layers for a in layer[2:]) for t in model.tables)
    assert model.width > 2500 and size < 40 << 20
    assert [r.lang_pred for r in language.identify(table(spark, ["\u0301", "山"], ["zh", "zh"])).orderBy("doc_id").collect()] == ["und", "zh"]


def test_every_label_is_learned(spark):
    rng = random.Random(3)
    words_of = [[f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + rng.randrange(26))}{chr(97 + k // 7 % 26)}" for _ in range(6)] for k in range(300)]
    rows = [(k, " ".join(rng.choice(words_of[k]) for _ in range(60)), f"l{k}", "s", "f", "r", "l") for k in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.fit(docs)
    got = {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()}
    assert len(model.languages) == 300 and sum(got[k] == f"l{k}" for k in range(300)) >= 295


def test_languages_are_told_apart(spark):
    rng = random.Random(9)
    stock = {"aa": ["the", "house", "with", "garden", "and", "river"], "bb": ["das", "haus", "mit", "garten", "und", "fluss"], "cc": ["la", "maison", "avec", "jardin", "et", "rivière"]}
    made, langs = [], []
    for k in range(150):
        lang = sorted(stock)[k % 3]
        made.append(" ".join(rng.choice(stock[lang]) for _ in range(25)))
        langs.append(lang)
    made += [None, "", "123 !!"]
    langs += ["aa", None, "bb"]
    got = language.identify(table(spark, made, langs)).collect()
    assert all(r.lang_pred == langs[r.doc_id] for r in got if r.doc_id < 150)
    assert {(r.lang_pred, r.score) for r in got if r.doc_id >= 150} == {("und", 0.0)}
