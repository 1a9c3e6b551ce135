"""Fill-in-middle transformation by relational units (operator 13).

A text is a row of units (lines, by default) for each of its places: the units'
lengths, exploded with their ordinals, get running sums in a window by text, so
that each unit knows the offset at which it ends. A cut is a request for a unit
by its ordinal; joined to the units it becomes an offset. The offsets of a text
are gathered to one row and meet the text itself, which is only then cut, by
``substring``, and put together anew. Units travel as numbers, texts once. A
text is known by a digest of its doc_id and itself; texts that share it, however
many, have one row of offsets, and are joined to it as plain skewed rows.

Of n units the prefix takes the smaller and the prefix with the middle the
larger of two draws from 0 to n; the draws are the first two groups of eight
digits of the SHA-256 of "seed:doc_id". The third decides whether a text is
transformed at all (``rate`` in a hundred), the fourth its form (``spm_rate`` in
a hundred): psm is <P>prefix<S>suffix<M>middle, spm is <S>suffix<P>prefix<M>middle.

Defined cases: a null text counts as empty; texts that are empty, or hold a
sentinel themselves, stay as they are (form plain), and so can always be told
from transformed ones; a null doc_id is drawn as the empty string; repeated rows
are transformed alike, each for itself; an empty table gives an empty result;
extra columns are ignored. Offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.common import drop, written

#: Units that make up a text: each ends with its line feed, the last one may lack it.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draw(k: int, seed: int) -> Column:
    """The k-th number of 32 bits that belongs to a document."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a key of both: rows that share it are transformed alike."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("key", F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")), 256)))


def requests(rows: DataFrame, seed: int) -> DataFrame:
    """key, n, and the ordinals, from 1, of the units before the two cuts; a cut at the very start asks for none, 0."""
    n = F.size("lengths").cast("long")
    first, second = (draw(k, seed) % (n + 1) for k in (0, 1))
    return rows.select(F.col("key").alias("asked"), n.alias("n"), F.least(first, second).alias("first"), F.greatest(first, second).alias("second"))


def offsets(rows: DataFrame, seed: int = 7) -> DataFrame:
    """key, n and the code points before each of the two cuts, of rows (key, doc_id, lengths of the units).

    Units and requests are dealt by key once, for the window, the join and the
    aggregation; a window holds the units of one text. Neither side is sent to
    all tasks: how many units a text explodes to is not known beforehand.
    """
    units = rows.select("key", F.posexplode("lengths").alias("place", "length"))
    before = Window.partitionBy("key").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = units.select("key", (F.col("place") + 1).alias("ordinal"), F.sum("length").over(before).alias("end"))
    asked = requests(rows, seed)
    met = asked.hint("merge").join(ends, (F.col("key") == F.col("asked")) & F.col("ordinal").isin(F.col("first"), F.col("second")), "left")
    at = lambda cut: F.coalesce(F.max(F.when(F.col("ordinal") == F.col(cut), F.col("end"))), F.lit(0)).cast("long")
    return met.groupBy(F.col("asked").alias("key"), "n").agg(at("first").alias("start"), at("second").alias("stop"))


def restore(output: Column, form: Column) -> Column:
    """The text that was transformed."""
    after = lambda mark: F.locate(mark, output)

    def between(mark: str, to: str | None) -> Column:
        start = after(mark) + len(mark)
        return F.substring(output, start, (F.locate(to, output) if to else F.char_length(output) + 1) - start)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, unit: str = LINES) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every document. ``unit``: a pattern whose matches make up any text."""
    texts = keyed(docs)
    lengths = F.transform(F.regexp_extract_all("text", F.lit(unit), F.lit(0)), F.char_length)
    rows = written(texts.select("key", "doc_id", lengths.alias("lengths")).dropDuplicates(["key"]), "units", compression="zstd")
    cuts = written(offsets(rows, seed), "offsets")
    drop(rows)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (draw(2, seed) % 100 >= rate)
    out = texts.join(cuts, "key", "left")
    start, stop = F.coalesce("start", F.lit(0).cast("long")), F.coalesce("stop", F.lit(0).cast("long"))
    form = F.when(plain, "plain").when(draw(3, seed) % 100 < spm_rate, "spm").otherwise("psm")
    out = out.select("doc_id", "n", "text", form.alias("form"), start.alias("start"), stop.alias("stop"))
    length = F.char_length("text")
    prefix, middle, suffix = (F.substring("text", a + 1, b - a) for a, b in ((F.lit(0), F.col("start")), (F.col("start"), F.col("stop")), (F.col("stop"), length)))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    changed = F.col("form") != "plain"
    return out.select(
        "doc_id",
        "n",
        "form",
        F.when(changed, F.col("start")).alias("prefix_chars"),
        F.when(changed, F.col("stop") - F.col("start")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"),
    )


def digest(found: DataFrame) -> DataFrame:
    """The outputs, and the texts rebuilt from them, as SHA-256."""
    out = found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", restore(F.col("output"), F.col("form")).alias("restored"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digits FROM documents),
h AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, CAST(('0x' || substr(digits, 1, 8)) AS BIGINT) AS h1, CAST(('0x' || substr(digits, 9, 8)) AS BIGINT) AS h2,
  CAST(('0x' || substr(digits, 17, 8)) AS BIGINT) AS h3, CAST(('0x' || substr(digits, 25, 8)) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM h),
p AS (SELECT doc_id, text, n, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
