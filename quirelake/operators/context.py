"""Context selection for tasks, deterministic task results, and their contract."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODES = ("analysis", "editing", "ideation")
TASK_TYPES = {"analysis": "analyze_selection", "editing": "rewrite_selection", "ideation": "ideate_selection"}


def allowed(mode: Column, kind: Column) -> Column:
    """Whether a mode takes a source of this kind by default."""
    shared = kind.isin("reference/story_summary", "reference/world_summary", "reference/character_bible")
    editing = shared | kind.isin("reference/timeline", "reference/terminology")
    return F.coalesce(kind.startswith("guide/") | F.when(mode == "analysis", kind.startswith("reference/")).when(mode == "editing", editing).when(mode == "ideation", shared), F.lit(False))


def trusted() -> Column:
    return F.col("review_state").isin("user_authored", "approved")


def included_by_default(mode: Column) -> Column:
    return F.col("activation_policy").isin("pinned", "retrieved") & trusted() & allowed(mode, F.col("kind"))


def select_context(requests: DataFrame, sources: DataFrame, explicit: DataFrame) -> DataFrame:
    """Every source of a request's project with whether it is included.

    requests: request_id, project, mode; sources: project, path, kind,
    activation_policy, review_state; explicit: request_id, path. Explicit paths
    pass by mode and activation, not by review.
    """
    named = explicit.select("request_id", "path", F.lit(True).alias("named")).distinct()
    rows = requests.join(sources, "project").join(named, ["request_id", "path"], "left")
    return rows.withColumn("included", F.when(F.col("named"), trusted()).otherwise(included_by_default(F.col("mode")))).drop("named")


def run_tasks(requests: DataFrame) -> DataFrame:
    """One output per request (mode, selected_text): its type and text."""
    mode = F.col("mode")
    kind = F.when(mode == "analysis", "analysis_comment").when(mode == "editing", "draft_change").when(mode == "ideation", "idea_card")
    text = (
        F.when(mode == "analysis", "Deterministic analysis placeholder for the selected text.")
        .when(mode == "editing", F.concat("selected_text", F.lit(" [deterministic edit]")))
        .when(mode == "ideation", "Placeholder idea tied to the current task target.")
    )
    title = F.when(mode == "ideation", "Deterministic idea")
    return requests.withColumn("schema_version", F.lit(1).cast("short")).withColumn("output_type", kind).withColumn("title", title).withColumn("output_text", text)


def default_scope(mode: Column) -> Column:
    """What a task takes into view when nothing else is asked: the selection, in each mode."""
    return F.when(mode.isin(*MODES), "selection")


def new_requests(requests: DataFrame) -> DataFrame:
    """Requests with a random id, the schema version, the task type of their mode, and their own target as the context's (context_target)."""
    kinds = F.create_map(*[F.lit(x) for pair in TASK_TYPES.items() for x in pair])
    out = requests.withColumn("request_id", F.uuid()).withColumn("schema_version", F.lit(1).cast("short")).withColumn("task_type", F.coalesce(kinds[F.col("mode")], F.lit("chat")))
    return out.withColumn("context_target", F.col("target")) if "target" in requests.columns else out


def check_outputs(requests: DataFrame, outputs: DataFrame) -> DataFrame:
    """First contract error of each request, or null.

    requests: request_id, mode, document_path, start_char, end_char; outputs:
    request_id, pos, output_type, out_path, out_start, out_end.
    """
    inside = (F.col("out_path") == F.col("document_path")) & (F.col("out_start") >= F.col("start_char")) & (F.col("out_end") <= F.col("end_char"))
    draft = F.col("output_type") == "draft_change"
    error = F.when(draft & (F.col("mode") != "editing"), "draft_changes_not_allowed").when(draft & ~inside, "draft_change_outside_target")
    rows = requests.join(outputs, "request_id", "left").withColumn("error", error)
    return rows.groupBy("request_id").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("pos"))).alias("error_code"))


def active_paths(requested: Column, available: Column) -> Column:
    return F.filter(F.array_distinct(requested), lambda p: F.array_contains(available, p))


def toggle_path(active: Column, available: Column, path: Column) -> Column:
    return F.when(F.array_contains(active, path), F.array_remove(active, path)).when(F.array_contains(available, path), F.array_append(active, path)).otherwise(active)


def chat_log(messages: DataFrame) -> DataFrame:
    """Messages in the order they were appended (seq), whatever their clocks say, each with its place in the thread and a random id."""
    order = Window.partitionBy("thread_id").orderBy("seq")
    return messages.withColumn("position", F.row_number().over(order) - 1).withColumn("message_id", F.uuid())


def rescoped(threads: DataFrame, changes: DataFrame) -> DataFrame:
    """Threads (thread_id, mode, scope) after the last change of scope (thread_id, scope, seq) of each; the mode stays."""
    last = changes.groupBy("thread_id").agg(F.max_by("scope", "seq").alias("to"))
    return threads.join(last, "thread_id", "left").withColumn("scope", F.coalesce("to", "scope")).drop("to")


def assemble(candidates: DataFrame, budgets: DataFrame) -> DataFrame:
    """What goes into each request's context: candidates with ``taken`` and ``used``, the room that is taken after them.

    candidates: request_id, class, rank, size and any columns that tell them
    apart; budgets: request_id, budget. In the order of class, rank and the other
    columns each takes its room if it fits, else it is passed over and smaller
    ones may follow. The rows of a request are sorted and run through one task
    as a stream, of which only the room is held; those that could never fit are
    set apart first.
    """
    rows = candidates.join(budgets, "request_id")
    names = [c for c in candidates.columns if c not in ("request_id", "class", "rank", "size")]
    order = ["request_id", "class", "rank", "size", *names]
    fits = (F.col("size") >= 0) & (F.col("size") <= F.col("budget"))
    able = rows.where(fits).repartition("request_id").sortWithinPartitions(*order)
    schema = T.StructType([*able.schema.fields, T.StructField("taken", T.BooleanType()), T.StructField("used", T.LongType())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used = None, 0
        for batch in batches:
            taken, room = [], []
            for request, size, budget in zip(*(batch.column(c).to_pylist() for c in ("request_id", "size", "budget")), strict=True):
                if request != at:
                    at, used = request, 0
                taken.append(used + size <= budget)
                used += size if taken[-1] else 0
                room.append(used)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(taken, pa.bool_()), pa.array(room, pa.int64())], names=[*batch.schema.names, "taken", "used"])

    out = able.mapInArrow(fill, schema)
    rest = rows.where(~F.coalesce(fits, F.lit(False))).withColumn("taken", F.lit(False)).withColumn("used", F.lit(None).cast("long"))
    return out.unionByName(rest)
