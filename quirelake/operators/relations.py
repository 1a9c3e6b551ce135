"""Relationships, timelines, and facts that contradict each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.scratch import kept
from quirelake.functions.text import squash

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_MONTH = "|".join(MONTHS)
#: 1895-03-07; 7 March 1895; March 7, 1895; March 1895.
DATE = rf"(?<![\p{{L}}\p{{N}}-])(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}} (?:{_MONTH}) \d{{4}}|(?:{_MONTH}) \d{{1,2}}, \d{{4}}|(?:{_MONTH}) \d{{4}})(?![\p{{L}}\p{{N}}-])"


def related(mentions: DataFrame, spans: int, reach: int = 0, least: int = 2) -> DataFrame:
    """Pairs of names (first < second, in lower case) that occur together at least ``least`` times: n, and how strongly they attract, score.

    mentions: path, ordinal, name; ``spans`` is how many spans there are. Two
    names occur together where their spans of a document are at most ``reach``
    apart. score is 1,000 times the logarithm of how much more often that is
    than chance would have it, rounded down. Spans meet by place, so a join's
    groups are the names of a span, however common a name is.
    """
    at = kept(mentions.select("path", "ordinal", F.lower("name").alias("name")).distinct())
    left = at.select("path", F.col("name").alias("x"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(reach)), lambda d: F.struct((F.col("ordinal") + d).alias("ordinal"), (d == 0).alias("same")))).alias("o")).select("path", "x", "o.*")
    met = left.join(at.withColumnRenamed("name", "y"), ["path", "ordinal"]).where((F.col("x") < F.col("y")) | (~F.col("same") & (F.col("x") > F.col("y"))))
    pairs = met.groupBy(F.least("x", "y").alias("first"), F.greatest("x", "y").alias("second")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    count = kept(at.groupBy("name").agg(F.count("*").alias("n")))
    one, two = (count.select(F.col("name").alias(c), F.col("n").alias(f"n_{c}")) for c in ("first", "second"))
    chance = F.col("n").cast("double") * F.lit(float(spans)) / (F.col("n_first").cast("double") * F.col("n_second"))
    return pairs.join(one, "first").join(two, "second").select("first", "second", "n", F.floor(F.ln(chance) * 1000).cast("long").alias("score"))


def day_of(said: Column) -> tuple[Column, Column]:
    """First day of a date expression, as text that need not be a date, and whether it tells a day or a month."""
    month = F.regexp_extract(said, f"({_MONTH})", 1)
    number = F.array_position(F.array(*map(F.lit, MONTHS)), month)
    year = F.when(month == "", F.left(said, F.lit(4))).otherwise(F.right(said, F.lit(4)))
    day = F.when(month == "", F.right(said, F.lit(2))).otherwise(F.regexp_extract(said, r"^(\d{1,2}) | (\d{1,2}),", 0))
    day = F.regexp_replace(day, r"[ ,]", "")
    number = F.when(month == "", F.substring(said, 6, 2)).otherwise(number.cast("string"))
    full = F.concat(year, F.lit("-"), F.lpad(number, 2, "0"), F.lit("-"), F.when(day == "", "01").otherwise(F.lpad(day, 2, "0")))
    return full, F.when(day == "", "month").otherwise("day")


def timeline(spans: DataFrame) -> DataFrame:
    """Date expressions of spans (path, ordinal, text) in the order of time: path, position, ordinal, nth (place in the span), said, day, precision.

    Expressions of days that do not exist are left out; equal days are in the order of the text.
    """
    rows = spans.select("path", "ordinal", F.posexplode(F.regexp_extract_all("text", F.lit(DATE), F.lit(0))).alias("nth", "said"))
    day, precision = day_of(F.col("said"))
    rows = rows.withColumn("full", day).withColumn("precision", precision).withColumn("day", F.expr("try_cast(full as date)")).where("day IS NOT NULL")
    order = Window.partitionBy("path").orderBy("day", "ordinal", "nth")
    return rows.select("path", (F.row_number().over(order) - 1).alias("position"), "ordinal", "nth", "said", "day", "precision")


def classes(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """name and least, the smallest name that it can be reached from by pairs (a, b), of every name in them.

    Each round takes the least label among neighbours and then that label's own,
    so that the number of rounds follows the logarithm of the longest chain.
    """
    both = kept(pairs.select(F.col("a").alias("name"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("name"), F.col("a").alias("other"))).where("name IS NOT NULL AND other IS NOT NULL").distinct())
    label = kept(both.groupBy("name").agg(F.min("other").alias("m")).select("name", F.least("name", "m").alias("least")))
    for _ in range(most_rounds):
        near = both.join(label.select(F.col("name").alias("other"), F.col("least").alias("near")), "other").groupBy("name").agg(F.min("near").alias("near"))
        step = label.join(near, "name").select("name", F.col("least").alias("old"), F.least("least", "near").alias("new"))
        hook = step.where("new < old").groupBy(F.col("old").alias("name")).agg(F.min("new").alias("hook"))
        step = kept(step.join(hook, "name", "left").select("name", "old", F.least("new", "hook").alias("new")))
        far = step.select(F.col("name").alias("new"), F.col("new").alias("far"))
        new = kept(step.join(far, "new", "left").select("name", F.least("new", "far").alias("least"), "old"))
        label = new.select("name", "least")
        if new.where("least < old").isEmpty():
            return label
    raise RuntimeError(f"names did not settle in {most_rounds} rounds")


def contradictions(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Facts (path, ordinal, subject, predicate, object) of which another document says something else of the same subject.

    Subjects are the same if their names are, or are joined by aliases (a, b);
    names and objects are compared in lower case with single spaces. Adds
    entity, the class's least name. A group of facts is judged by its smallest
    and largest document and object: two documents and two objects always hold
    two facts that disagree.
    """
    plain = lambda c: F.lower(squash(F.col(c)))
    known = classes(aliases.select(plain("a").alias("a"), plain("b").alias("b")))
    # Only what is judged or returned: other columns, such as ids, are not made.
    rows = facts.select("path", "ordinal", "subject", "predicate", "object", plain("object").alias("said"), plain("subject").alias("name")).where("name <> '' AND said <> ''")
    rows = kept(rows.join(known, "name", "left").withColumn("entity", F.coalesce("least", "name")).drop("least", "name"))
    group = rows.groupBy("entity", "predicate").agg(F.min("said").alias("a"), F.max("said").alias("b"), F.min("path").alias("p"), F.max("path").alias("q"))
    return rows.join(group.where("a < b AND p < q").select("entity", "predicate"), ["entity", "predicate"]).select("entity", "predicate", "path", "ordinal", "subject", "object")
