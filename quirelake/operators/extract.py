"""Entity candidates, reference facts and extractive summaries from parsed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.ids import stable_id
from quirelake.functions.text import has_letter, squash, strip
from quirelake.operators import parse

#: Marks taken off both ends of a token.
EDGE = r"[!-/:-@\[-`{-~“”‘’—–…]+"
SUMMARY_LIMIT = 240


def mentions(spans: DataFrame) -> DataFrame:
    """Runs of capitalised tokens in headings and paragraphs: path, ordinal, start, name, and the span's range."""
    text = spans.where("span_type IN ('heading', 'paragraph') AND normalized_text <> ''")
    bare = lambda t: F.regexp_replace(t, f"^{EDGE}|{EDGE}$", "")
    named = F.transform(F.transform(F.split("normalized_text", " "), bare), lambda t: F.when(t.rlike(r"^\p{IsUppercase}") & has_letter(t), t).otherwise(""))
    # A span's tokens stay one row; the generator keeps them from being made anew wherever they are used. Other tokens than names are empty.
    tokens = text.select("path", "ordinal", "start_char", "end_char", F.explode(F.array(named)).alias("tokens"))
    full = lambda k: F.coalesce(F.get("tokens", k), F.lit("")) != ""
    places = F.sequence(F.lit(0), F.size("tokens") - 1)
    ends = F.arrays_zip(F.filter(places, lambda k: full(k) & ~full(k - 1)).alias("start"), F.filter(places, lambda k: full(k) & ~full(k + 1)).alias("stop"))
    run = lambda e: F.struct(e["start"].alias("start"), F.array_join(F.slice("tokens", e["start"] + 1, e["stop"] - e["start"] + 1), " ").alias("name"))
    runs = tokens.select("path", "ordinal", "start_char", "end_char", F.inline(F.transform(ends, run)))
    runs = runs.withColumn("name", F.regexp_replace("name", "^((The|A|An) )+(?=.)", ""))
    return runs.where("name NOT IN ('The', 'A', 'An')")


def candidates_of(found: DataFrame) -> DataFrame:
    """One row per document and lower-cased name of mentions: first form, count, anchors; single words need two mentions."""
    found = found.withColumn("pos", F.struct("ordinal", "start"))
    own = found.groupBy("path", F.lower("name").alias("key")).agg(
        F.min_by("name", "pos").alias("name"),
        F.count("*").alias("mentions"),
        F.array_sort(F.collect_set("ordinal")).alias("anchors"),
        F.min_by("start_char", "pos").alias("start_char"),
        F.min_by("end_char", "pos").alias("end_char"),
        F.min("pos").alias("pos"),
    )
    return own.where("mentions > 1 OR size(split(name, ' ')) > 1")


def entity_candidates(docs: DataFrame) -> DataFrame:
    """The candidates of each document in the order in which they are first named."""
    own = candidates_of(mentions(parse.spans(docs)))
    order = F.row_number().over(Window.partitionBy("path").orderBy("pos")) - 1
    return own.select(
        "path", "name", "mentions", "anchors", "start_char", "end_char", order.cast("int").alias("position"), F.lit("pending").alias("review_state"), F.lit("current").alias("staleness_state")
    ).withColumn("id", stable_id(F.col("path"), F.col("name")))


def fact_part(c: Column) -> Column:
    c = strip(F.regexp_replace(strip(c), "^[:—-]+|[:—-]+$", ""))
    return strip(F.regexp_replace(c, r"\.+$", ""))


def reviewable_facts(docs: DataFrame) -> DataFrame:
    """Subject-is-object lines of reference documents (path, text, document_type)."""
    spans = parse.spans(docs.where("document_type = 'reference'")).where("span_type = 'paragraph'")
    lines = spans.select("path", "ordinal", "start_char", "end_char", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    bare = strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(F.col("line")), r"^(- )+", ""), r"^(\* )+", ""), r"^(\+ )+", ""))
    lines = lines.withColumn("line", bare)
    mark = F.when(F.instr("line", ":") > 0, ":").when(F.instr("line", " - ") > 0, " - ").when(F.instr("line", " — ") > 0, " — ")
    lines = lines.withColumn("mark", mark).where("mark IS NOT NULL").withColumn("at", F.expr("locate(mark, line)"))
    lines = lines.withColumn("subject", fact_part(F.expr("left(line, at - 1)"))).withColumn("object", fact_part(F.expr("substring(line, at + length(mark))")))
    lines = lines.where(has_letter(F.col("subject")) & has_letter(F.col("object")))
    return lines.select(
        "path", "ordinal", "line_no", "subject", F.lit("is").alias("predicate"), "object", "start_char", "end_char", F.lit("pending").alias("review_state"), F.lit("current").alias("staleness_state")
    ).withColumn("id", stable_id(F.col("path"), F.col("ordinal"), F.col("subject"), F.col("object")))


def summary_text(text: Column) -> Column:
    """Leading lines without heading marks, joined by spaces, at most SUMMARY_LIMIT characters; null when nothing is left."""
    marked = lambda x: F.when(x.isin("", "---", "***", "___"), "").otherwise(squash(F.regexp_replace(x, "^#+", "")))

    def add(done: Column, line: Column) -> Column:
        used = F.length(done)
        room = F.lit(SUMMARY_LIMIT) - used - F.when(used > 0, 1).otherwise(0)
        more = F.concat(done, F.when(used > 0, " ").otherwise(""), F.substring(line, F.lit(1), room))
        return F.when((room <= 0) | (line == ""), done).otherwise(more)

    def read(done: Column, line: Column) -> Column:
        # Arrays of one: a line is cleaned once, and only while there is room.
        clean = F.transform(F.transform(F.array(line), strip), marked)
        return F.when(F.length(done) >= SUMMARY_LIMIT - 1, done).otherwise(F.aggregate(clean, done, add))

    return F.nullif(F.aggregate(F.split(text, "\n"), F.lit(""), read), F.lit(""))


def reviewable_summaries(docs: DataFrame) -> DataFrame:
    """A document's summary, and its sections' when more than one has text."""
    sections = parse.sections(docs).select("path", "ordinal", "text", "start_char", "end_char", summary_text(F.col("text")).alias("summary"))
    own = sections.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text", "start_char", "end_char", "summary"))).alias("parts"))  # a document's sections

    def row(scope, text, anchors, start, end):
        return F.struct(scope.alias("scope"), text.alias("text"), anchors.alias("anchors"), start.alias("start_char"), end.alias("end_char"))

    parts = F.col("parts")
    whole = row(
        F.lit("document"),
        summary_text(F.array_join(F.transform(parts, lambda p: p.text), "\n\n")),
        F.transform(parts, lambda p: p.ordinal),
        F.array_min(F.transform(parts, lambda p: p.start_char)),
        F.array_max(F.transform(parts, lambda p: p.end_char)),
    )
    full = F.filter(parts, lambda p: p.summary.isNotNull())
    each = F.transform(full, lambda p: row(F.concat(F.lit("section:"), p.ordinal.cast("string")), p.summary, F.array(p.ordinal), p.start_char, p.end_char))
    rows = own.select("path", F.explode(F.concat(F.array(whole), F.when(F.size(full) > 1, each).otherwise(F.slice(each, 1, 0)))).alias("s")).select("path", "s.*")
    rows = rows.where("text IS NOT NULL").withColumn("review_state", F.lit("pending")).withColumn("staleness_state", F.lit("current"))
    return rows.withColumn("id", stable_id(F.col("path"), F.col("scope"), F.col("text")))
