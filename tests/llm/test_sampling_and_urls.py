"""URL filters, importance resampling and fill-in-middle against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirelake.llm import middle, resampling, url_filter

SCHEMA = "doc_id long, text string, row_id string, lengths string, words string, buckets string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "r", "l", "w", "b") for d, t in rows], SCHEMA).repartition(3)


def number(seed, doc_id, k):
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return int(digits[8 * k : 8 * k + 8], 16)


# --- fill in the middle

TEXTS = ["", None, "\n", "\n\n\n", "one", "one\n", "one\ntwo", "a <P> b\nc\n", "x<\nS>\n<\n", "<M", "<S><P>", "é\U0001f600\nß\r\n\u2028x\n", "tail\n" * 3000, "y" * 200_000]


def cut(doc_id, text, seed, rate, spm_rate):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted(number(seed, doc_id, k) % (len(units) + 1) for k in (0, 1))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or number(seed, doc_id, 2) % 100 >= rate:
        return len(units), "plain", None, None, text
    prefix, mid, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if number(seed, doc_id, 3) % 100 < spm_rate:
        return len(units), "spm", len(prefix), len(mid), f"<S>{suffix}<P>{prefix}<M>{mid}"
    return len(units), "psm", len(prefix), len(mid), f"<P>{prefix}<S>{suffix}<M>{mid}"


@pytest.mark.parametrize(("seed", "rate", "spm_rate"), [(7, 100, 50), (3, 60, 20)])
def test_middles_are_cut_and_rebuilt_exactly(spark, seed, rate, spm_rate):
    rng = random.Random(seed)
    rows = [(k, t) for k in (0, 1, 2) for k, t in enumerate(TEXTS, 20 * k)] + [(None, "n\nu\nl"), (5, "again\nand"), (5, "again\nand"), (-4, "minus\n\n\none")]
    rows += [(1000 + k, "\n".join("ab<PSM>"[rng.randrange(7)] * rng.randrange(4) for _ in range(rng.randrange(9)))) for k in range(150)]
    found = middle.fill_in_middle(table(spark, rows), seed, rate, spm_rate)
    got = found.select("*", middle.restore(F.col("output"), F.col("form")).alias("back")).collect()
    columns = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back")
    want = [(d, *cut(d, t, seed, rate, spm_rate), t or "") for d, t in rows]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got))) == sorted(map(str, want))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_middles_of_nothing(spark):
    assert middle.digest(middle.fill_in_middle(table(spark, [(1, "x")]).limit(0))).count() == 0


# --- importance resampling


def runs(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def plain_resample(rows, target, percent, least, longest, buckets, seed):
    bucket = lambda run: zlib.crc32(run.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in runs(t, longest)[1])
    t = Counter(bucket(f) for x in target for f in runs(x, longest)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for doc_id, text in rows:
        words, own = runs(text, longest)
        weight = sum(gain(bucket(f)) for f in own)
        noise = math.floor(-1000 * math.log(-math.log((number(seed, doc_id, 0) + 0.5) / 4294967296)))
        out.append((doc_id, len(own), weight, weight + noise, len(words) >= least))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: len(able) * percent // 100]
    return out, [(*r[:4], k) for k, r in enumerate(drawn, 1)]


@pytest.mark.parametrize(("percent", "least", "longest", "buckets"), [(10, 20, 1, 10_000), (50, 2, 2, 40), (100, 0, 3, 7), (0, 0, 1, 5)])
def test_resampling_draws_the_highest_scores(spark, percent, least, longest, buckets):
    rng = random.Random(percent)
    texts = [None, "", "...", "one", "Ünï ÇÖ\u00a0dé x9", "w " * 30_000] + [" ".join(f"W{int(rng.random() ** 3 * 90)}" for _ in range(rng.randrange(60))) for _ in range(150)]
    rows = list(enumerate(texts, -20)) + [(7, texts[9]), (7, texts[9]), (None, texts[12]), (None, None)]
    target = [" ".join(f"w{rng.randrange(30)}" for _ in range(40)) for _ in range(6)] + [None]
    items = spark.createDataFrame([(k, t, "r") for k, t in enumerate(target)], "item_id long, text string, row_id string")
    got = [tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in resampling.resample(table(spark, rows), items, percent, least, longest, buckets).collect()]
    every, drawn = plain_resample(rows, target, percent, least, longest, buckets, 2024)
    assert sorted(map(str, (r[:4] for r in got))) == sorted(map(str, (r[:4] for r in every)))
    assert sorted((r for r in got if r[4]), key=lambda r: r[4]) == drawn


@pytest.mark.parametrize("k", [0, 1, 7, 250, 499, 500, 900])
def test_radix_selection_finds_the_exact_kth_key(spark, k):
    rng = random.Random(k)
    ids = [None, None, -(1 << 62), (1 << 63) - 1, -(1 << 63), 0] + [rng.choice([rng.randrange(-5, 5), rng.randrange(1 << 40)]) for _ in range(494)]
    rows = [(n, d, rng.choice([0, -1, 70_000, -70_000, rng.randrange(-9, 9)])) for n, d in enumerate(ids)]
    df = spark.createDataFrame(rows, "row_id long, doc_id long, score long").repartition(5)
    got = {r.row_id for r in df.where(resampling.first_k(df, resampling.sort_key(), k)).collect()}
    assert got == {r[0] for r in sorted(rows, key=lambda r: (-r[2], r[1] is None, r[1] or 0, r[0]))[:k]}


def test_ranks_go_on_across_ranges(spark):
    rows = [(n, n % 50, n % 7) for n in range(700)]
    got = resampling.ranked(spark.createDataFrame(rows, "row_id long, doc_id long, score long"), parts=9).collect()
    want = sorted(rows, key=lambda r: (-r[2], r[1], r[0]))
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r["rank"])] == want and {r["rank"] for r in got} == set(range(1, 701))


def test_resampling_of_nothing(spark):
    none, items = table(spark, [(1, "x")]).limit(0), spark.createDataFrame([], "text string")
    assert resampling.resample(none, items).count() == 0
    assert [(r.weight, r["rank"]) for r in resampling.resample(table(spark, [(1, "x")]), items).collect()] == [(-694, None)]  # floor(1000 ln(10001 / 20000))


# --- url filters


def judged(url, listed, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k]), rest[k:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: (len(r[1] + r[2]), len(r[1])), default=None)
    labels = host.split(".")
    hit = any(".".join(labels[k:]) in listed for k in range(len(labels)) if ".".join(labels[k:]))
    return host, path, best and best[1] + best[2], best[0] if best else "block" if hit else "allow"


@pytest.mark.parametrize("block_keys", [1 << 24, 60])
def test_cascades_tell_exactly_what_is_listed(spark, block_keys):
    rng = random.Random(3)
    hosts = [f"{rng.choice(['www.', 'm.', '', 'a.b.'])}{'xyz'[rng.randrange(3)]}{rng.randrange(900)}.{rng.choice(['org', 'com', 'example.org', 'net'])}" for _ in range(1500)]
    urls = [f"http{'s' * rng.randrange(2)}://{h.upper() if rng.random() < 0.2 else h}{rng.choice(['', '/', '/es/', '/en/1?x', '/fr/a#b/de/', '?/fr/', '/de/é'])}" for h in hosts]
    urls += [None, "", "no scheme", "http://", "://x1.org", "a://b://c.org/", "http://.../", "http://x1.org:80/", "http://\u00dcber.ORG/es/\n", "HTTP://example.org", "x" * 70_000 + "://x5.net/"]
    listed = {".".join(h.split(".")[rng.randrange(2) :]) for h in rng.sample(hosts, 250)} - {"org", "com", "net", "example.org"} | {"never.seen"}
    pages = spark.createDataFrame([(None if k == 9 else k, u, "h", "p", "l") for k, u in enumerate(urls * 2)], "page_id long, url string, host string, path string, listed string").repartition(4)
    keys = spark.createDataFrame([(k.upper() if rng.random() < 0.5 else k, "o") for k in [*listed, "", *list(listed)[:9]]] + [(None, "o")], "key string, one string")
    got = url_filter.judge(pages, keys, url_filter.RULES, block_keys).collect()
    want = [(None if k == 9 else k, *judged(u, listed, url_filter.RULES)) for k, u in enumerate(urls * 2)]
    assert sorted(map(str, (tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in got))) == sorted(map(str, want))
    assert len({r.verdict for r in got}) == 2 and len({r.rule for r in got}) == 6


def test_a_cascade_needs_several_levels_and_is_small(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("one"), F.xxhash64("id", F.lit(1)).alias("two"), (F.col("id") % 40 == 0).alias("listed"))
    levels = url_filter.fit(keys)
    rows = keys.toPandas()
    assert list(url_filter.listed_keys(levels, rows.one.to_numpy().view("u8"), rows.two.to_numpy().view("u8"))) == list(rows.listed)
    assert 2 < len(levels) < 25 and sum(x.bits for x in levels) < 500 * 16


@pytest.mark.parametrize(("urls", "listed"), [([], ["x.org"]), (["http://x.org/"], []), ([], [])])
def test_filters_of_nothing(spark, urls, listed):
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = url_filter.judge(pages, spark.createDataFrame([(k,) for k in listed], "key string")).collect()
    assert [r.verdict for r in got] == ["allow"] * len(urls)
