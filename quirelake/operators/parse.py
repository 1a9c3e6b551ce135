"""Markdown structure as windows over lines: spans, sections and scenes.

Input: path, text. All windows and groups share one exchange on path; a
document's lines are the largest group. Documents too large for that come as
lines in pieces (``marked_pieces``), each of which is a group of its own: what a
piece does to the state of its reader is summed up in a row, the rows of a
document are scanned in order, and each piece goes on from the state before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.functions.scratch import kept
from quirelake.functions.text import squash, strip, strip_left, without_space, word_count

SPAN_TYPES = ("heading", "paragraph", "scene")
#: Characters that may end a sentence, and that may start one.
ENDS = r"""[.!?"')\]}”’…]$"""
STARTS = r"""^[\p{IsUppercase}\p{N}"'(\[{“‘—]"""


def source_lines(docs: DataFrame) -> DataFrame:
    """path, line_no, line, start_char, start_byte; lines end at newlines only, a last empty one is none."""
    split = docs.select("path", F.split("text", "\n", -1).alias("ls")).select("path", F.size("ls").alias("n"), F.posexplode("ls").alias("line_no", "line"))
    rows = split.where(~((F.col("line_no") == F.col("n") - 1) & (F.col("line") == "")))
    before = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c + 1).over(before), F.lit(0)).cast("long")
    return rows.select("path", "line_no", "line", total(F.char_length("line")).alias("start_char"), total(F.octet_length("line")).alias("start_byte"))


def line_kind(line: Column) -> Column:
    return (
        F.when(strip(line).rlike("^#+ "), "heading")
        .when(without_space(line).rlike(r"^(-{3,}|\*{3,}|_{3,})$"), "scene")
        .when(strip(line) == "", "blank")
        .otherwise("text")
    )


def marked_lines(docs: DataFrame, mode: str = "conservative_heuristic") -> DataFrame:
    """Lines with their kind, section and scene group, span ordinal, and whether they start a span."""
    doc = Window.partitionBy("path").orderBy("line_no")
    rows = source_lines(docs).withColumn("kind", line_kind(F.col("line")))
    rows = rows.withColumn("section", F.sum(F.col("kind").isin("heading", "scene").cast("int")).over(doc))
    rows = rows.withColumn("scene", F.sum((F.col("kind") == "scene").cast("int")).over(doc))
    rows = rows.withColumn("before", F.lag("kind").over(doc)).withColumn("above", F.lag("line").over(doc))
    own = Window.partitionBy("path", "section").orderBy("line_no")
    rows = rows.withColumn("open", F.max(F.col("kind").isin("heading", "text")).over(own))
    rows = rows.withColumn("spaced", F.max((F.col("kind") == "blank") & F.col("open")).over(own))
    rows = rows.withColumn("starts", starts_span(mode))
    return rows.withColumn("ordinal", (F.sum(F.col("starts").cast("int")).over(doc) - 1).cast("int")).drop("before", "above", "open", "spaced")


def may_end(line: Column) -> Column:
    return strip(line).rlike(ENDS)


def may_start(line: Column) -> Column:
    fresh = strip_left(line)
    return ((F.octet_length(fresh) >= 20) | (word_count(fresh) >= 4)) & fresh.rlike(STARTS)


def starts_span(mode: str, ended: Column | None = None, fresh: Column | None = None, spaced: Column | None = None) -> Column:
    """Whether a line starts a span, by its kind, that of the line above it (before), whether that one may end a sentence (ended) and this one
    start one (fresh), by default as the lines (above, line) tell, and whether its section has had a blank line after text (spaced)."""
    ended = may_end(F.col("above")) if ended is None else ended
    fresh = may_start(F.col("line")) if fresh is None else fresh
    new = ~F.col("before").eqNullSafe(F.lit("text"))
    if mode == "conservative_heuristic":
        new = new | (~(F.col("spaced") if spaced is None else spaced) & ended & fresh)
    elif mode != "strict_blank_lines":
        raise ValueError(f"unknown mode {mode}")
    return F.col("kind").isin("heading", "scene") | ((F.col("kind") == "text") & F.coalesce(new, F.lit(False)))


def pieces_of(docs: DataFrame, lines: int = 4_096) -> DataFrame:
    """path, chunk, place, line of documents (path, text) cut after every so many lines."""
    split = docs.select("path", F.split("text", "\n", -1).alias("ls")).select("path", F.size("ls").alias("n"), F.posexplode("ls").alias("place", "line"))
    rows = split.where(~((F.col("place") == F.col("n") - 1) & (F.col("line") == "")))
    return rows.select("path", F.floor(F.col("place") / lines).cast("long").alias("chunk"), F.col("place").cast("long").alias("place"), "line")


def read_pieces(spark: SparkSession, *paths: str) -> DataFrame:
    """path (as Spark names the file), chunk, place, line of text files; a large file is read by several tasks, a chunk for each."""
    rows = spark.read.option("lineSep", "\n").text(list(paths))
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("chunk"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))


def marked_pieces(lines: DataFrame, mode: str = "conservative_heuristic") -> DataFrame:
    """As marked_lines, of lines that come in pieces: path, chunk (in the order of the document), place (in that of the chunk), line.

    No task holds more than a piece, or a row for each piece of a document. Lines
    are dealt twice, for what their piece tells and with the state before it; of
    other lines and pieces only lengths and truths travel, no text.
    """
    boundary, scene = F.col("kind").isin("heading", "scene").cast("int"), (F.col("kind") == "scene").cast("int")
    own = Window.partitionBy("path", "chunk").orderBy("place")
    above = own.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long")
    rows = lines.withColumn("kind", line_kind(F.col("line")))
    text = F.col("kind") == "text"
    rows = rows.withColumn("ends", F.when(text, may_end(F.col("line")))).withColumn("fresh", F.when(text, may_start(F.col("line"))))
    rows = rows.select(
        "*",
        (F.row_number().over(own) - 1).cast("long").alias("nth"),
        total(F.char_length("line") + 1, above).alias("chars"),
        total(F.octet_length("line") + 1, above).alias("bytes"),
        total(boundary, own).alias("section"),
        total(scene, own).alias("scene"),
        F.lag("kind").over(own).alias("before"),
        F.lag("ends").over(own).alias("ended"),
    )
    part = Window.partitionBy("path", "chunk", "section").orderBy("place")
    seen = lambda c, w: F.max(c).over(w)
    rows = rows.withColumn("open", seen(F.col("kind").isin("heading", "text"), part)).withColumn("blank", seen(F.col("kind") == "blank", part))
    rows = kept(rows.withColumn("spaced", seen((F.col("kind") == "blank") & F.col("open"), part)), compression="zstd")
    # What a piece adds, and the state that it ends in. How many spans its lines start but for the first follows from whether the
    # section that it begins in is open or spaced already, so it is counted for each case.
    early, spaced, starts = F.col("section") == 0, F.col("spaced"), lambda s: starts_span(mode, F.col("ended"), F.col("fresh"), s)
    counts = [F.sum(F.when(F.col("nth") > 0, starts(s).cast("long")).otherwise(0)).alias(n) for n, s in (("fresh_n", spaced), ("open_n", spaced | (early & F.col("blank"))), ("spaced_n", spaced | early))]
    last = F.struct("nth", (F.col("chars") + F.char_length("line") + 1).alias("chars"), (F.col("bytes") + F.octet_length("line") + 1).alias("bytes"), "section", "scene", "kind", "ends", "open", "blank", "spaced")
    ends = rows.groupBy("path", "chunk").agg(F.max_by(last, "place").alias("z"), F.min_by(F.struct(F.col("kind").alias("first_kind"), F.col("fresh").alias("first_fresh")), "place").alias("a"), *counts)
    ends = ends.select("path", "chunk", "z.*", "a.*", "fresh_n", "open_n", "spaced_n").withColumn("turn", (F.col("section") > 0).cast("int"))
    doc = Window.partitionBy("path").orderBy("chunk")
    so_far = doc.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("run", F.sum("turn").over(doc))
    # Pieces without a boundary go on in the run of the last one that has one.
    run = Window.partitionBy("path", "run").orderBy("chunk")
    ends = ends.withColumn("open_after", seen(F.col("open"), run))
    ends = ends.withColumn("open_in", F.coalesce(F.lag("open_after").over(doc), F.lit(False)))
    ends = ends.withColumn("spaced_after", seen(F.col("spaced") | ((F.col("turn") == 0) & F.col("open_in") & F.col("blank")), run))
    ends = ends.withColumn("spaced_in", F.coalesce(F.lag("spaced_after").over(doc), F.lit(False))).withColumn("before_in", F.lag("kind").over(doc)).withColumn("ended_in", F.lag("ends").over(doc))
    # A first line of text is in the section that the piece begins in, and no blank line of the piece is above it.
    first = ends.select("path", "chunk", F.col("first_kind").alias("kind"), F.col("before_in").alias("before"), F.col("ended_in").alias("ended"), F.col("first_fresh").alias("fresh"), F.col("spaced_in").alias("spaced"), *(c for c in ends.columns if c not in ("path", "chunk", "kind", "spaced")))
    more = F.when(F.col("spaced_in"), F.col("spaced_n")).when(F.col("open_in"), F.col("open_n")).otherwise(F.col("fresh_n"))
    state = first.withColumn("n_starts", more + starts(spaced).cast("long")).select(
        "path",
        "chunk",
        "open_in",
        "spaced_in",
        "before_in",
        "ended_in",
        total(F.col("nth") + 1, so_far).alias("nth_in"),
        total(F.col("chars"), so_far).alias("chars_in"),
        total(F.col("bytes"), so_far).alias("bytes_in"),
        total(F.col("section"), so_far).alias("section_in"),
        total(F.col("scene"), so_far).alias("scene_in"),
        total(F.col("n_starts"), so_far).alias("started"),
    )
    rows = rows.drop("open", "ends").join(state, ["path", "chunk"])
    first = F.col("nth") == 0
    rows = rows.withColumn("before", F.when(first, F.col("before_in")).otherwise(F.col("before"))).withColumn("ended", F.when(first, F.col("ended_in")).otherwise(F.col("ended")))
    rows = rows.withColumn("spaced", F.col("spaced") | ((F.col("section") == 0) & (F.col("spaced_in") | (F.col("open_in") & F.col("blank")))))
    sums = [(F.col(c) + F.col(f"{c}_in")).alias(name) for c, name in (("nth", "line_no"), ("chars", "start_char"), ("bytes", "start_byte"), ("section", "section"), ("scene", "scene"))]
    rows = rows.select("path", "chunk", "place", "line", "kind", "started", *sums, starts(F.col("spaced")).alias("starts"))
    local = F.sum(F.col("starts").cast("int")).over(own)
    return rows.withColumn("ordinal", (local + F.col("started") - 1).cast("int")).drop("chunk", "place", "started")


def _extent(rows: DataFrame, *keys: str) -> DataFrame:
    end_byte, end_char = F.col("start_byte") + F.octet_length("line"), F.col("start_char") + F.char_length("line")
    listed = F.array_sort(F.collect_list(F.struct("line_no", "kind", "line", "ordinal", end_byte.alias("end_byte"), end_char.alias("end_char"))))
    return rows.groupBy(*keys).agg(
        listed.alias("rows"),
        F.min("line_no").alias("start_line"),
        F.max("line_no").alias("end_line"),
        F.min("start_byte").alias("start_byte"),
        F.max(end_byte).alias("end_byte"),
        F.min("start_char").alias("start_char"),
        F.max(end_char).alias("end_char"),
    )


EXTENT = ("start_line", "end_line", "start_byte", "end_byte", "start_char", "end_char")


def spans(docs: DataFrame, mode: str = "conservative_heuristic") -> DataFrame:
    """path, ordinal, span_type, text, normalized_text and extents."""
    return spans_of(marked_lines(docs, mode))


def spans_of(marked: DataFrame) -> DataFrame:
    """The spans of marked lines."""
    own = _extent(marked.where("kind <> 'blank'"), "path", "ordinal")
    kind = F.col("rows")[0].kind
    text = F.array_join(F.transform("rows", lambda r: r.line), "\n")
    text = F.when(kind == "scene", strip(text)).otherwise(text)
    return own.select("path", "ordinal", F.when(kind == "text", "paragraph").otherwise(kind).alias("span_type"), text.alias("text"), squash(text).alias("normalized_text"), *EXTENT)


def _bodies(docs: DataFrame, mode: str, group: str) -> DataFrame:
    """Lines of each section or scene between its first and last that is not blank, blank ones emptied, with the line that opened it."""
    whole = Window.partitionBy("path", group)
    boundary = F.col("kind").isin("heading", "scene") if group == "section" else F.col("kind") == "scene"
    opening = F.first(F.when(boundary, F.struct("kind", "line"))).over(whole.orderBy("line_no"))
    rows = marked_lines(docs, mode).withColumn("opening", opening).where("kind <> 'scene'")
    full = F.when(F.col("kind") != "blank", F.col("line_no"))
    rows = rows.withColumn("first", F.min(full).over(whole)).withColumn("last", F.max(full).over(whole))
    return rows.where("line_no BETWEEN first AND last").withColumn("body", F.when(F.col("kind") == "blank", "").otherwise(F.col("line")))


def _texts(rows: DataFrame, group: str) -> DataFrame:
    end_byte, end_char = F.col("start_byte") + F.octet_length("line"), F.col("start_char") + F.char_length("line")
    listed = F.array_sort(F.collect_list(F.struct("line_no", "body")))
    out = rows.groupBy("path", group).agg(
        F.first("opening").alias("opening"),  # the same in all lines of a group
        F.array_join(F.transform(listed, lambda r: r.body), "\n").alias("text"),
        F.min(F.when(F.col("kind") != "blank", F.col("ordinal"))).alias("start_span_ordinal"),
        F.max(F.when(F.col("kind") != "blank", F.col("ordinal"))).alias("end_span_ordinal"),
        F.min("line_no").alias("start_line"),
        F.max("line_no").alias("end_line"),
        F.min("start_byte").alias("start_byte"),
        F.max(end_byte).alias("end_byte"),
        F.min("start_char").alias("start_char"),
        F.max(end_char).alias("end_char"),
    )
    return out.withColumn("ordinal", (F.row_number().over(Window.partitionBy("path").orderBy(group)) - 1).cast("int")).withColumn("normalized_text", squash(F.col("text")))


def sections(docs: DataFrame, mode: str = "conservative_heuristic") -> DataFrame:
    """path, ordinal, text, boundary_kind, boundary_text and extents."""
    kind, line = F.col("opening.kind"), F.col("opening.line")
    return _texts(_bodies(docs, mode, "section"), "section").select(
        "path",
        "ordinal",
        "text",
        "normalized_text",
        F.when(kind == "scene", "scene_break").when(kind == "heading", "heading").otherwise("file_start").alias("boundary_kind"),
        F.when(kind == "scene", strip(line)).otherwise(line).alias("boundary_text"),
        *EXTENT,
    )


def scenes(docs: DataFrame, mode: str = "conservative_heuristic") -> DataFrame:
    """path, ordinal, text, separator, span range and extents."""
    own = _texts(_bodies(docs, mode, "scene"), "scene")
    return own.select("path", "ordinal", "text", "normalized_text", strip(F.col("opening.line")).alias("separator"), "start_span_ordinal", "end_span_ordinal", *EXTENT)
