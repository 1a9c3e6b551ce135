"""Text selections: offsets, overlapping spans, validation, panes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.text import strip


def chars_before(text: Column, units: Column) -> Column:
    """Code points in the first ``units`` UTF-16 code units of a text; half a pair counts as one."""
    count = lambda s, c: F.struct(
        (s.units + F.when(F.octet_length(c) == 4, 2).otherwise(1)).alias("units"), (s.chars + F.when(s.units < units, 1).otherwise(0)).alias("chars")
    )
    zero = F.struct(F.lit(0).alias("units"), F.lit(0).alias("chars"))
    return F.aggregate(F.split(text, ""), zero, count, lambda s: s.chars)


def ordered(anchor: Column, head: Column) -> tuple[Column, Column]:
    return F.least(anchor, head), F.greatest(anchor, head)


#: Widths of bins: of level 0, and how many times wider each further level is; the last holds any text.
BIN, WIDER, LEVELS = 256, 8, 9


def bins(start: Column, end: Column, level: Column) -> tuple[Column, Column]:
    """First and last bin of a level that the characters from start up to end touch."""
    width = (F.lit(float(BIN)) * F.pow(F.lit(float(WIDER)), level)).cast("long")
    return F.floor(start / width).cast("long"), F.floor((end - 1) / width).cast("long")


def overlap(selections: DataFrame, spans: DataFrame) -> DataFrame:
    """Each selection (sel_id, path, sel_start, sel_end) with the ordinals of the spans it touches, and the first.

    A join of intervals by bins: a span lies in the one or two bins that it
    touches at the level whose bins are as wide as it, a selection in all bins
    that it touches at each level that its document has. A pair counts in the
    first bin that both touch, so none is found twice. Work follows the number
    of bins and of pairs that share one, not selections times spans.
    """
    size = F.greatest(F.col("end_char") - F.col("start_char"), F.lit(1))
    level = F.least(F.greatest(F.ceil(F.log(float(WIDER), size / F.lit(float(BIN)))), F.lit(0)), F.lit(LEVELS - 1)).cast("int")
    s = spans.where("end_char > start_char").select("path", "ordinal", "start_char", "end_char", level.alias("level"))
    first, last = bins(F.col("start_char"), F.col("end_char"), F.col("level"))
    placed = s.withColumn("own", first).withColumn("bin", F.explode(F.sequence(first, last)))
    levels = s.groupBy("path").agg(F.collect_set("level").alias("levels"))
    real = selections.where("sel_end > sel_start").select("sel_id", "path", "sel_start", "sel_end")
    asked = real.join(levels, "path").select("sel_id", "path", "sel_start", "sel_end", F.explode("levels").alias("level"))
    begin, end = bins(F.col("sel_start"), F.col("sel_end"), F.col("level"))
    asked = asked.withColumn("begin", begin).withColumn("bin", F.explode(F.sequence(begin, end)))
    met = placed.join(asked, ["path", "level", "bin"]).where((F.col("start_char") < F.col("sel_end")) & (F.col("end_char") > F.col("sel_start")) & (F.col("bin") == F.greatest("own", "begin")))
    found = met.groupBy("sel_id").agg(F.array_sort(F.collect_list("ordinal")).alias("ordinals"), F.min("ordinal").alias("primary"))
    return selections.join(found, "sel_id", "left").withColumn("ordinals", F.coalesce("ordinals", F.array().cast("array<int>")))


def validate(selections: DataFrame) -> DataFrame:
    """Adds error_code (first that holds) and span anchors to selections with document_path, selected_text, start_char, end_char, ordinals."""
    error = (
        F.when(strip(F.coalesce("document_path", F.lit(""))) == "", "missing_document_path")
        .when(F.coalesce("selected_text", F.lit("")) == "", "empty_selection")
        .when(F.col("start_char").isNull() | F.col("end_char").isNull() | (F.col("start_char") < 0) | (F.col("end_char") <= F.col("start_char")), "invalid_range")
        .when(F.exists("ordinals", lambda o: o < 0), "invalid_span_ordinal")
    )
    anchors = F.transform("ordinals", lambda o: F.struct(F.lit("span").alias("kind"), o.alias("ordinal")))
    return selections.withColumn("error_code", error).withColumn("anchors", F.when(error.isNull(), anchors))


def ordinals_of(anchors: Column, kind: str) -> Column:
    return F.transform(F.filter(anchors, lambda a: a.kind == kind), lambda a: a.ordinal)


TARGET = ("document_path", "selected_text", "start_char", "end_char", "anchors")


def latest_by_pane(events: DataFrame) -> DataFrame:
    """The last selection of each pane (seq, pane_id and those of TARGET that events has)."""
    held = [c for c in TARGET if c in events.columns]
    return events.groupBy("pane_id").agg(F.max_by(F.struct("seq", *held), "seq").alias("s")).select("pane_id", "s.*")


def active_target(events: DataFrame) -> DataFrame:
    """The target, anchors included, of the pane that selected last; no row if that selection is empty."""
    held = [c for c in TARGET if c in events.columns]
    last = events.agg(F.max_by(F.struct("pane_id", *held), "seq").alias("s")).select("s.*")
    return last.where("selected_text <> ''")


def pin(panes: DataFrame, new: DataFrame) -> DataFrame:
    """Panes with those new ones whose pane_id is not there yet."""
    return panes.unionByName(new.dropDuplicates(["pane_id"]).join(panes, "pane_id", "left_anti").select(*panes.columns))
