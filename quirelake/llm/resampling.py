"""Importance resampling towards a target distribution (operator 12).

Runs of 1 to ``longest`` words are features, hashed to ``buckets`` buckets. A
bucket's gain is the floored log-ratio, times 1,000, of its share among the
target's features to its share among all documents' (one added to each count).
A document's weight is the sum of its features' gains: each document is written
once as the array of its buckets, and the gains are one array, so that a weight
is a sum of look-ups. The score adds Gumbel noise that belongs to the doc_id, so
that the documents with the highest scores are a sample without replacement,
drawn in proportion to exp(weight / 1,000).

The k highest are found by radix selection. The key of a row is its score
(descending), doc_id and row id, as digits of 16 bits from the leading one that
differs; a round counts the rows at each value of one digit among those that
share the digits found so far, and takes the value at which the k-th row lies.
The exact k-th key tells who is drawn by comparison alone; only drawn rows are
sorted by range and numbered. A round sends at most 65,536 counts to the driver.

Defined cases: null texts have no words; documents of fewer than ``least_words``
words have scores but are never drawn; equal scores go to the smaller doc_id (null
last), equal doc_ids to the earlier row; an empty table or target works; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import ASCII_UPPER, lower_ascii, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DIGIT = 16
SIGN = -(1 << 63)


def features(text: Column, longest: int, buckets: int) -> tuple[Column, Column]:
    """The words of a text, and the bucket of each of its runs of words."""
    words = F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))

    def runs(n: int) -> Column:
        if n == 1:
            return F.transform("words", bucket)
        starts = F.sequence(F.lit(1), F.size("words") - (n - 1))
        some = F.transform(starts, lambda k: bucket(F.array_join(F.slice("words", k, n), " ")))
        return F.when(F.size("words") >= n, some).otherwise(F.array().cast("array<int>"))

    def bucket(run: Column) -> Column:
        return (F.crc32(run.cast("binary")) % buckets).cast("int")

    return words, F.concat(*[runs(n) for n in range(1, longest + 1)]) if longest > 1 else runs(1)


def featured(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """row_id, doc_id, n_words and the buckets of every document."""
    words, own = features(F.col("text"), longest, buckets)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", words.alias("words"))
    return rows.select("row_id", "doc_id", F.size("words").cast("long").alias("n_words"), own.alias("buckets"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """The gain of each bucket: one row a bucket, whatever the corpus holds."""
    count = lambda df: df.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    both = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(count(corpus).withColumnRenamed("n", "s"), "bucket", "left").join(count(target).withColumnRenamed("n", "t"), "bucket", "left").na.fill(0)
    total = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    s, t = (F.col(c).cast("double") for c in ("s", "t"))
    both = both.crossJoin(F.broadcast(total.select(F.col("s").alias("all_s"), F.col("t").alias("all_t"))))  # one row
    ratio = ((t + 1) * (F.col("all_s") + buckets)) / ((s + 1) * (F.col("all_t") + buckets))
    rows = both.select("bucket", F.floor(F.ln(ratio) * 1000).cast("long").alias("gain")).collect()
    return [gain for _, gain in sorted((r.bucket, r.gain) for r in rows)]


def noise(seed: int) -> Column:
    """1,000 times a Gumbel variate of the doc_id, rounded down."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digits, 1, 8), 16, 10).cast("double")
    return F.floor(F.ln(-F.ln((h + 0.5) / 4294967296.0)) * -1000).cast("long")


def scored(rows: DataFrame, gain: list[int], seed: int) -> DataFrame:
    """row_id, doc_id, n_words, n_features, weight and score of featured documents."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<long>")  # folded to one constant
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda sum_, b: sum_ + F.get(table, b))
    out = rows.select("row_id", "doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))
    return out.withColumn("score", F.col("weight") + noise(seed))


def unsigned(value: Column) -> Column:
    """Longs whose bits, taken as unsigned, are in the order of the values."""
    return value.bitwiseXOR(F.lit(SIGN))


def sort_key() -> list[Column]:
    """Unsigned 64-bit parts of the key, most significant first: the highest score, then the smallest doc_id, comes first."""
    return [F.bitwise_not(unsigned(F.col("score"))), F.when(F.col("doc_id").isNull(), 1).otherwise(0).cast("long"), unsigned(F.coalesce("doc_id", F.lit(0).cast("long"))), F.col("row_id")]


def first_k(rows: DataFrame, key: list[Column], k: int) -> Column:
    """A condition that holds for the k rows of smallest key; keys are unsigned parts and unlike.

    Radix selection: of each part the leading bits that all rows share are known
    from its extremes; each further digit of 16 bits takes a round of counting.
    """
    if k <= 0:
        return F.lit(False)
    left, equal, before = k, F.lit(True), []
    for part in key:
        inside = rows.where(equal)
        least, most, n = inside.agg(F.min(part.bitwiseXOR(F.lit(SIGN))), F.max(part.bitwiseXOR(F.lit(SIGN))), F.count("*")).first()
        if n <= left:
            return reduce(Column.__or__, before, equal)
        shift = (least ^ most).bit_length() if (least < 0) == (most < 0) else 64
        if shift < 64:
            equal = equal & (F.shiftrightunsigned(part, shift) == ((least ^ SIGN) & 0xFFFFFFFFFFFFFFFF) >> shift)
        while shift:
            width = min(DIGIT, shift)
            shift -= width
            digit = F.shiftrightunsigned(part, shift).bitwiseAND(F.lit((1 << width) - 1))
            counts = sorted(tuple(r) for r in rows.where(equal).groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect())
            for value, n in counts:
                if n >= left:
                    break
                left -= n
            before.append(equal & (digit < value))
            equal = equal & (digit == value)
            if n == left:
                return reduce(Column.__or__, before, equal)
    return reduce(Column.__or__, before, equal)


def ranked(drawn: DataFrame, parts: int | None = None) -> DataFrame:
    """Drawn rows with their rank: ranges of the order, sorted each for itself; a row's rank is its place plus the rows before its range."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row_id").asc()]
    ranges = drawn.repartitionByRange(parts, *order) if parts else drawn.repartitionByRange(*order)
    placed = written(ranges.sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "drawn")
    sizes = placed.groupBy(F.shiftright("place", 33).alias("range")).agg(F.count("*").alias("n")).collect()
    start, before = [0] * (max((r["range"] for r in sizes), default=0) + 1), 0
    for r in sorted(sizes, key=lambda r: r["range"]):
        start[r["range"]], before = before, before + r["n"]
    starts = F.split(F.lit(",".join(map(str, start))), ",").cast("array<long>")
    rank = F.get(starts, F.shiftright("place", 33).cast("int")) + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("rank", rank).drop("place")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document; ``percent`` of those with enough words are drawn."""
    rows = written(featured(docs, longest, buckets), "features", compression="zstd")
    other = featured(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, buckets)
    found = written(scored(rows, gains(rows, other, buckets), seed), "scores")
    long = F.col("n_words") >= least_words
    able = found.where(long)
    chosen = long & first_k(able, sort_key(), able.count() * percent // 100)
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = found.where(~chosen).select(*columns, F.lit(None).cast("long").alias("rank"))
    return rest.unionByName(ranked(found.where(chosen)).select(*columns, "rank"))


_CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))"""
ORACLE = f"""
WITH RECURSIVE crc AS (SELECT CAST(i AS BIGINT) AS i, 0 AS bit, CAST(i AS BIGINT) AS c FROM range(256) r(i)
  UNION ALL SELECT i, bit + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE bit < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM crc WHERE bit = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
words AS (SELECT w, hex(encode(w)) AS hx FROM (SELECT unnest(w) AS w FROM d UNION SELECT unnest(w) FROM b)),
hashed AS (SELECT w, xor({_CRC}, 4294967295) % 10000 AS bucket
  FROM (SELECT w, list_transform(range(0, len(hx) // 2), lambda k: CAST(('0x' || substr(hx, 2 * k + 1, 2)) AS BIGINT)) AS bytes FROM words), tab),
s AS (SELECT bucket, count(*) AS s FROM (SELECT unnest(w) AS w FROM d) JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(w) AS w FROM b) JOIN hashed USING (w) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE) / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM hashed) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weighed AS (SELECT doc_id, sum(gain) AS weight FROM (SELECT doc_id, unnest(w) AS w FROM d) JOIN hashed USING (w) JOIN g USING (bucket) GROUP BY doc_id),
scored AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('2024:' || d.doc_id), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weighed USING (doc_id)),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CAST(rank AS BIGINT) AS rank FROM scored LEFT JOIN (SELECT * FROM able WHERE rank <= (SELECT count(*) FROM able) * 10 // 100) USING (doc_id)
"""
