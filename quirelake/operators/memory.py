"""The review-gated memory store: upsert, state filters, review and staleness.

Records carry id, source_document_path, review_state, staleness_state, payload
columns, and seq, the order in which they were saved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANCHORS = "array<struct<kind: string, ordinal: int>>"
ANCHOR_KINDS = ("span", "section", "scene", "window")
STATES = {"review_state": ("pending", "approved", "rejected"), "staleness_state": ("current", "stale")}
FILTERS = ("all", "pending", "approved", "rejected", "stale", "reusable")


def reusable() -> Column:
    return (F.col("review_state") == "approved") & (F.col("staleness_state") == "current")


def state_filter(name: str) -> Column:
    if name not in FILTERS:
        raise ValueError(f"unknown filter {name}")
    if name == "all":
        return F.lit(True)
    if name == "stale":
        return F.col("staleness_state") == "stale"
    return reusable() if name == "reusable" else F.col("review_state") == name


def encode_anchors(anchors: Column) -> Column:
    """Anchors as stored: a JSON text."""
    return F.to_json(anchors)


def decode_anchors(text: Column) -> Column:
    """Stored anchors; null where the text is not exactly a list of them.

    An anchor is an object with a known kind and a whole ordinal of at least 0
    (other keys are ignored, repeated ones are wrong), or a list of just these
    two. Ordinals go up to 2**63 - 1. Each text is parsed between brackets of
    both sorts, as the parser alone would pass over what follows a whole value.
    """
    inside = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    alone = F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}"))).isNotNull() & (F.size(F.try_variant_get(inside, "$", "array<variant>")) == 1)
    listed = F.try_variant_get(inside, "$[0]", "array<variant>")

    def anchor(v: Column) -> Column:
        pair = F.try_variant_get(v, "$", "array<variant>")
        kind = F.coalesce(F.try_variant_get(v, "$.kind", "variant"), F.when(F.size(pair) == 2, F.try_variant_get(v, "$[0]", "variant")))
        ordinal = F.coalesce(F.try_variant_get(v, "$.ordinal", "variant"), F.when(F.size(pair) == 2, F.try_variant_get(v, "$[1]", "variant")))
        name = F.when(F.schema_of_variant(kind) == "STRING", F.try_variant_get(kind, "$", "string"))
        number = F.when(F.schema_of_variant(ordinal) == "BIGINT", F.try_variant_get(ordinal, "$", "long"))
        return F.when(name.isin(*ANCHOR_KINDS) & (number >= 0), F.struct(name.alias("kind"), number.alias("ordinal")))

    anchors = F.transform(listed, anchor)
    return F.when(alone & ~F.exists(anchors, lambda a: a.isNull()), anchors)


def stored_errors(records: DataFrame) -> DataFrame:
    """Adds error_code: the first state of a stored record that no one knows, or its anchors if they cannot be read (source_anchors_json)."""
    known = lambda c: F.coalesce(F.col(c).isin(*STATES[c]), F.lit(False))
    error = F.when(~known("review_state"), "invalid_stored_review_state").when(~known("staleness_state"), "invalid_stored_staleness_state")
    return records.withColumn("error_code", error.when(decode_anchors(F.col("source_anchors_json")).isNull(), "invalid_stored_anchors"))


def upsert(saves: DataFrame, preserve_review: bool = False) -> DataFrame:
    """The latest save of each id at the place of its first; a new save overwrites the review state unless preserved."""
    columns = [c for c in saves.columns if c not in ("id", "seq")]
    rows = saves.groupBy("id").agg(F.max_by(F.struct(*columns), "seq").alias("last"), F.min("seq").alias("seq"), F.max_by("review_state", F.when(F.col("review_state") != "pending", F.col("seq"))).alias("reviewed"))
    out = rows.select("id", "seq", "last.*", "reviewed")
    if preserve_review:
        out = out.withColumn("review_state", F.coalesce("reviewed", "review_state"))
    return out.drop("reviewed")


def list_records(records: DataFrame, name: str = "all") -> DataFrame:
    return records.where(state_filter(name)).orderBy("seq")


def review(records: DataFrame, updates: DataFrame) -> DataFrame:
    """Records after the latest review of each id (id, review_state, seq); unknown ids come back with an error_code."""
    last = updates.groupBy("id").agg(F.max_by("review_state", "seq").alias("to"))
    out = records.join(last, "id", "left").withColumn("review_state", F.coalesce("to", "review_state")).drop("to").withColumn("error_code", F.lit(None).cast("string"))
    lost = last.join(records.select("id"), "id", "left_anti").select("id", F.lit("memory_record_not_found").alias("error_code"))
    return out.unionByName(lost, allowMissingColumns=True)


def mark_stale(records: DataFrame, paths: DataFrame) -> DataFrame:
    """Records of the given source documents (path) become stale; nothing becomes current again."""
    gone = paths.select(F.col("path").alias("source_document_path"), F.lit(True).alias("gone")).distinct()
    out = records.join(gone, "source_document_path", "left")
    return out.withColumn("staleness_state", F.when(F.col("gone"), "stale").otherwise(F.col("staleness_state"))).drop("gone")


def matched(records: DataFrame, paths: DataFrame) -> DataFrame:
    """How many records each path's staleness call matches, stale ones included."""
    return records.join(paths.select(F.col("path").alias("source_document_path")).distinct(), "source_document_path", "left_semi").groupBy("source_document_path").agg(F.count("*").alias("matched"))


def replay(actions: DataFrame) -> DataFrame:
    """State of each record after a log of actions (seq, id, path, action: upsert, approved, rejected, pending, stale).

    A save resets both states; a review counts from the last save on, staleness
    too. saved is the last save; seq, the first, is the record's place in lists.
    """
    save = F.when(F.col("action") == "upsert", F.col("seq"))
    last = actions.groupBy("id").agg(F.max(save).alias("saved"), F.min(save).alias("first"), F.max_by("path", save).alias("source_document_path")).where("saved IS NOT NULL")
    after = actions.join(last.select("id", "saved"), "id").where("seq > saved")
    state = after.groupBy("id").agg(
        F.max_by("action", F.when(F.col("action").isin("approved", "rejected", "pending"), F.col("seq"))).alias("review"), F.bool_or(F.col("action") == "stale").alias("stale")
    )
    out = last.join(state, "id", "left")
    return out.select(
        "id",
        F.col("first").alias("seq"),
        "source_document_path",
        "saved",
        F.coalesce("review", F.lit("pending")).alias("review_state"),
        F.when(F.col("stale"), "stale").otherwise("current").alias("staleness_state"),
    ).withColumn("reusable", reusable())
