"""The registered queries over the reference's own operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.functions.scratch import kept, scratch
from quirelake.operators import classify, context, extract, memory, parse, selection
from quirelake.plans import corpus
from quirelake.sources import files, projects

Query = Callable[[SparkSession, str], DataFrame]


def flat(df: DataFrame) -> DataFrame:
    """Scalar columns only: whole numbers as long, arrays of plain values as comma-joined text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.IntegerType):
            c = c.cast("long")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def literal(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans and characters per language and span type over all documents."""
    lang = corpus.table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/doc_"), "doc_id", F.lit(".md")).alias("path"), "lang")
    spans = parse.spans(corpus.prose(spark, sf_dir)).select("path", "span_type", (F.col("end_char") - F.col("start_char")).alias("n"))
    return spans.join(lang, "path").groupBy("lang", "span_type").agg(F.count("*").alias("n_spans"), F.sum("n").alias("n_chars"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.reviewable_facts(corpus.typed(spark, sf_dir).withColumn("document_type", F.lit("reference")))


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.explode(F.array(*map(F.lit, classify.CANDIDATE_KINDS))).alias("candidate_kind")
    rows = classify.archetypes(corpus.typed(spark, sf_dir)).select("path", "archetype", kinds)
    return rows.withColumn("intended_use", classify.intended_use(F.col("archetype"), F.col("candidate_kind")))


def source_rows(spark: SparkSession) -> DataFrame:
    return literal(spark, [(p, t, n) for n, (p, t) in enumerate(corpus.SOURCES)], "path string, document_type string, n int")


def sources_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context source of one of the kinds of names for each document."""
    d = corpus.table(spark, sf_dir, "documents")
    pick = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in corpus.SOURCES)), (F.col("doc_id") % len(corpus.SOURCES) + 1).cast("int"))
    return d.select(F.concat("source", F.lit("/"), "doc_id", F.lit("/"), pick(0)).alias("path"), pick(1).alias("document_type"))


def source_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources_of(spark, sf_dir).select("path", "document_type", classify.source_kind(F.col("document_type"), F.col("path")).alias("kind"))


def mappings(spark: SparkSession) -> DataFrame:
    return literal(spark, [(*m, k) for k, m in enumerate(corpus.MAPPINGS)], "path string, role string, enabled boolean, seq int")


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings as users may write them: a few odd projects, and one for each source."""
    odd = literal(spark, [(p, k, d, r, e) for k, (p, d, r, e) in enumerate(corpus.DRAFTS)], "project string, seq int, path string, role string, enabled boolean")
    return odd.unionByName(config_drafts(spark, sf_dir).withColumnRenamed("root_path", "project"))


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project roots and their numbers."""
    d = corpus.table(spark, sf_dir, "documents").select("source").distinct()
    return d.select(F.concat(F.lit("/home/"), "source").alias("root_path"), F.regexp_extract("source", "[0-9]+$", 0).cast("int").alias("n"))


def config_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual mappings of each root, and one more that is wrong for some; some roots have none."""
    usual = [F.struct(F.lit(k).alias("seq"), F.lit(p).alias("path"), F.lit(r).cast("string").alias("role"), F.lit(e).alias("enabled")) for k, p, r, e in corpus.CONFIG]
    wrong = F.filter(F.array(*(F.struct(F.lit(n).alias("n"), F.struct(F.lit(9).alias("seq"), F.lit(p).alias("path"), F.lit(r).alias("role"), F.lit(True).alias("enabled")).alias("m")) for n, p, r in corpus.WRONG)), lambda x: x.n == F.col("n") % 10)
    rows = roots(spark, sf_dir).where("n % 10 <> 7").select("root_path", F.explode(F.concat(F.array(*usual), F.transform(wrong, lambda x: x.m))).alias("m"))
    return rows.select("root_path", "m.*")


def config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store gives back after saving all drafts; one more project in it has a role that no one knows."""
    store = scratch(spark)
    projects.save_config(config_drafts(spark, sf_dir), store)
    literal(spark, [("old", "lore_master", True, "/home/stale")], projects.SCHEMA).write.mode("append").partitionBy("root_path").parquet(store)
    return projects.load_config(spark, store, every_root(spark, sf_dir))


def every_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roots(spark, sf_dir).select("root_path").unionByName(literal(spark, [("/home/stale",), ("/home/none",)], "root_path string"))


def opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects.open_projects(kept(every_root(spark, sf_dir)), kept(config(spark, sf_dir)), corpus.tree(spark, sf_dir))


def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = corpus.tree(spark, sf_dir)
    k = F.regexp_extract("path", "[0-9]+", 0).cast("long") % 8
    odd = [F.concat(F.lit("../"), "path"), F.concat("path", F.lit("/")), F.concat(F.lit("not/"), "path"), F.concat(F.lit("./"), "path"), F.replace("path", F.lit("/"), F.lit("//")), F.replace("path", F.lit("/"), F.lit("/./"))]
    asked = tree.select("root_path", F.coalesce(*(F.when(k == n, p) for n, p in enumerate(odd)), "path").alias("path"))
    return projects.load_documents(asked, opened(spark, sf_dir), tree)


def loaded_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = projects.parsed(loaded(spark, sf_dir))
    return spans.groupBy("root_path", "path", "span_type").agg(F.count("*").alias("n_spans"), F.sum(F.col("end_char") - F.col("start_char")).alias("n_chars"))


def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal(spark, [(p,) for p in corpus.FILES], "path string").unionByName(corpus.tree(spark, sf_dir).select("path"))


def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return project_files(spark, sf_dir).select(p, files.is_text_file(p).alias("supported"), files.fits_role(p, F.lit("primary_manuscript")).alias("manuscript"), files.inside_hidden(p).alias("hidden"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.import_candidates(project_files(spark, sf_dir), literal(spark, [("void",), ("lore",), (".git",)], "path string"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.table(spark, sf_dir, "events")
    kind = F.col("event_type")
    action = F.when(kind == "purchase", "approved").when(kind == "error", "rejected").when(kind == "signup", "stale").when(kind == "view", "pending").otherwise("upsert")
    path = F.concat(F.lit("src"), F.col("user_id") % 20, F.lit("/doc_"), "user_id", F.lit(".md"))
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("user_"), "user_id").alias("id"), path.alias("path"), action.alias("action"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.replay(actions(spark, sf_dir)).drop("reusable")


def upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    saves = actions(spark, sf_dir).select("id", "seq", F.col("path").alias("source_document_path"), F.col("action").alias("last_action"), F.lit("pending").alias("review_state"))
    return memory.upsert(saves).select("id", "seq", "source_document_path", "last_action")


def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = corpus.table(spark, sf_dir, "documents").where("lang <> 'en'").select(F.concat("source", F.lit("/doc_"), "doc_id", F.lit(".md")).alias("path"))
    return memory.mark_stale(records(spark, sf_dir), gone)


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.table(spark, sf_dir, "customer")
    state = F.element_at(F.array(*map(F.lit, ("approved", "rejected", "pending"))), (F.col("c_nationkey") % 3 + 1).cast("int"))
    updates = c.select(F.concat(F.lit("user_"), F.col("c_custkey") % 170).alias("id"), state.alias("review_state"), F.col("c_custkey").alias("seq"))
    return memory.review(records(spark, sf_dir), updates).select("id", "review_state", "staleness_state", "error_code")


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids that each filter lets through."""
    rows = memory.review(records(spark, sf_dir), reviewed(spark, sf_dir).where("error_code IS NULL").select("id", "review_state", F.lit(1).alias("seq"))).drop("error_code")
    out = None
    for name in memory.FILTERS:
        part = memory.list_records(rows, name).select(F.lit(name).alias("filter"), "id", "seq")
        out = part if out is None else out.unionByName(part)
    return out


def gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.table(spark, sf_dir, "events").where("user_id % 3 = 0")
    return e.select(F.concat(F.lit("src"), F.col("user_id") % 20, F.lit("/doc_"), "user_id", F.lit(".md")).alias("path"))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as stored, many of them damaged, and the anchors read back."""
    e, n = corpus.table(spark, sf_dir, "events"), F.col("event_id")
    anchors = F.array(F.struct(F.lit("span").alias("kind"), (n % 9).cast("int").alias("ordinal")), F.struct(F.lit("scene").alias("kind"), (n % 4).cast("int").alias("ordinal")))
    odd = F.get(F.array(*(F.lit(t) for t, _ in corpus.ANCHOR_TEXTS)), (n % 61).cast("int"))
    text = F.coalesce(odd, memory.encode_anchors(anchors))
    rows = e.select(n.alias("id"), F.when(n % 13 == 0, "lost").otherwise("approved").alias("review_state"), F.when(n % 11 == 0, "old").otherwise("current").alias("staleness_state"), text.alias("source_anchors_json"))
    out = memory.stored_errors(rows)
    each = F.transform(memory.decode_anchors(F.col("source_anchors_json")), lambda a: F.concat(a.kind, F.lit(" "), a.ordinal))
    return out.withColumn("anchors", F.array_join(each, ","))


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection for each turn of each conversation, somewhere in its transcript."""
    c, t = corpus.table(spark, sf_dir, "conversations"), F.col("turn")
    start = t * 137 % 900
    chosen = c.select(F.concat("conv_id", F.lit("/"), "turn").alias("sel_id"), F.concat(F.lit("transcript/conv_"), "conv_id", F.lit(".md")).alias("path"), start.alias("sel_start"), (start + t * 53 % 150 - 3).alias("sel_end"))
    return selection.overlap(chosen, parse.spans(corpus.transcripts(spark, sf_dir)))


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets in UTF-16 units of texts with characters of two, as characters."""
    p = corpus.table(spark, sf_dir, "part")
    text = F.concat(F.substring("p_name", 1, 7), F.lit("\U0001f600é"), F.substring("p_type", 1, 5), F.lit("\U0001d11e."))
    return p.select("p_partkey", selection.chars_before(text, F.col("p_size") % 20).cast("long").alias("chars"))


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = corpus.table(spark, sf_dir, "part"), F.col("p_partkey")
    rows = p.select(
        k.alias("sel_id"),
        F.when(k % 11 == 0, " ").otherwise(F.lit("a.md")).alias("document_path"),
        F.when(k % 7 == 0, "").otherwise(F.lit("text")).alias("selected_text"),
        F.lit(5).alias("start_char"),
        F.when(k % 5 == 0, 5).otherwise(9).alias("end_char"),
        F.array(F.col("p_size"), F.when(k % 3 == 0, -1).otherwise(F.col("p_size"))).alias("ordinals"),
    )
    return selection.validate(rows).select("sel_id", "error_code", selection.ordinals_of(F.col("anchors"), "span").alias("span_ordinals"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = corpus.table(spark, sf_dir, "customer"), F.col("c_custkey")
    mode = F.element_at(F.array(*map(F.lit, context.MODES)), (k % 3 + 1).cast("int"))
    return c.select(k.alias("request_id"), (k % 5).cast("int").alias("project"), mode.alias("mode"), F.col("c_name").alias("selected_text"))


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = source_rows(spark)
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), k + 1)
    sources = base.withColumn("project", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(
        "project",
        "path",
        classify.source_kind(F.col("document_type"), F.col("path")).alias("kind"),
        pick(("pinned", "retrieved", "explicit_only"), (F.col("n") + F.col("project")) % 3).alias("activation_policy"),
        pick(("user_authored", "approved", "pending_review", "stale"), (F.col("n") * 3 + F.col("project")) % 4).alias("review_state"),
    )
    reqs = requests(spark, sf_dir)
    numbers = F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(corpus.SOURCES) - 1)), lambda n: (F.col("request_id") + n) % 7 == 0)).alias("n")
    explicit = reqs.select("request_id", numbers).join(base, "n").select("request_id", "path")
    return context.select_context(reqs, sources, explicit).select("request_id", "mode", "path", "kind", "included")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.run_tasks(requests(spark, sf_dir)).select("request_id", "mode", "schema_version", "output_type", "title", "output_text")


def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = corpus.table(spark, sf_dir, "orders")
    start = F.col("o_orderkey") % 97
    kind = F.when(F.col("o_orderkey") % 2 == 0, "draft_change").otherwise("analysis_comment")
    outputs = o.select(F.col("o_custkey").alias("request_id"), F.col("o_orderkey").alias("pos"), kind.alias("output_type"), F.lit("a.md").alias("out_path"), start.alias("out_start"), (start + 5).alias("out_end"))
    reqs = requests(spark, sf_dir).select("request_id", "mode", F.lit("a.md").alias("document_path"), F.lit(10).alias("start_char"), F.lit(90).alias("end_char"))
    return context.check_outputs(reqs, outputs)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New task requests without their random ids."""
    c, k = corpus.table(spark, sf_dir, "customer"), F.col("c_custkey")
    mode = F.element_at(F.array(*map(F.lit, (*context.MODES, "other"))), (k % 4 + 1).cast("int"))
    rows = c.select(k.alias("n"), mode.alias("mode"), F.struct(F.col("c_name").alias("document_path"), k.alias("start_char")).alias("target"), F.struct(F.lit("old").alias("document_path"), F.lit(0).cast("long").alias("start_char")).alias("context_target"))
    out = context.new_requests(rows)
    return out.select("n", "mode", "schema_version", "task_type", context.default_scope(F.col("mode")).alias("scope"), F.col("context_target.document_path").alias("context_path"), F.col("context_target.start_char").alias("context_start"), (F.length("request_id") == 36).alias("has_id"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").cast("string").alias("thread_id"), F.col("role").alias("author"), (F.col("turn") * 7 % 5).alias("created_at_ms"), F.col("turn").alias("seq"))
    return context.chat_log(rows).drop("message_id")


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.table(spark, sf_dir, "conversations")
    threads = c.groupBy(F.col("conv_id").cast("string").alias("thread_id")).agg(F.lit("editing").alias("mode"), F.lit("project").alias("scope"))
    changes = c.where("turn % 3 = 1").select(F.col("conv_id").cast("string").alias("thread_id"), F.concat(F.lit("document "), "turn").alias("scope"), F.col("turn").alias("seq"))
    return context.rescoped(threads, changes)


def rail(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = corpus.table(spark, sf_dir, "part")
    own = F.concat(F.lit("x"), "p_size")
    available = F.array(F.col("p_type"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.lit("none")), own)
    path = F.when(F.col("p_size") % 3 == 0, F.col("p_type")).when(F.col("p_size") % 3 == 1, own).otherwise(F.col("p_name"))
    rows = p.select("p_partkey", F.array("p_brand", "p_type", "p_brand", "p_name").alias("requested"), available.alias("available"), path.alias("path"))
    rows = rows.withColumn("active", context.active_paths(F.col("requested"), F.col("available")))
    return rows.select("p_partkey", "active", context.toggle_path(F.col("active"), F.col("available"), F.col("path")).alias("toggled"))


def pane_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("pane_id"), F.lit("a.md").alias("document_path"), F.lit("t").alias("selected_text"), F.col("user_id").alias("start_char"), F.col("user_id").alias("end_char"), F.array(F.struct(F.lit("span").alias("kind"), F.col("user_id").alias("ordinal"))).alias("anchors"))


def panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.latest_by_pane(pane_events(spark, sf_dir)).select("pane_id", "seq", "start_char", selection.ordinals_of(F.col("anchors"), "span").alias("spans"))


def pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = selection.latest_by_pane(pane_events(spark, sf_dir)).select("pane_id", "seq")
    return selection.pin(last.where("pane_id IN ('view', 'click')"), last.where("pane_id <> 'view'").withColumn("seq", F.col("seq") + 1))


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.active_target(pane_events(spark, sf_dir)).select("pane_id", "start_char", selection.ordinals_of(F.col("anchors"), "span").alias("spans"))


def queries() -> dict[str, Query]:
    made: dict[str, Query] = {
        "flagship_span_counts": flagship,
        "line_offsets": lambda s, d: parse.source_lines(corpus.prose(s, d)),
        "parse_spans": lambda s, d: parse.spans(corpus.transcripts(s, d)),
        "parse_spans_prose": lambda s, d: parse.spans(corpus.prose(s, d)),
        "parse_spans_pieces": lambda s, d: parse.spans_of(parse.marked_pieces(parse.pieces_of(corpus.prose(s, d), 5))),
        "parse_spans_strict": lambda s, d: parse.spans(corpus.transcripts(s, d), "strict_blank_lines"),
        "parse_sections": lambda s, d: parse.sections(corpus.transcripts(s, d)),
        "parse_scenes": lambda s, d: parse.scenes(corpus.transcripts(s, d)),
        "entity_candidates": lambda s, d: extract.entity_candidates(corpus.transcripts(s, d)),
        "reviewable_facts": facts,
        "reviewable_summaries": lambda s, d: extract.reviewable_summaries(corpus.typed(s, d)),
        "line_features": lambda s, d: classify.line_features(corpus.typed(s, d)),
        "archetypes": lambda s, d: classify.archetypes(corpus.typed(s, d)),
        "intended_use": uses,
        "context_source_kind": source_kinds,
        "project_context_sources": lambda s, d: classify.context_sources(sources_of(s, d)),
        "mapping_classify": lambda s, d: files.classify_paths(corpus.prose(s, d), mappings(s)),
        "discover_documents": lambda s, d: files.discover(corpus.prose(s, d), mappings(s)),
        "file_filters": filters,
        "import_candidates": candidates,
        "mapping_normalize": lambda s, d: files.normalize_mappings(drafts(s, d)).select("project", "seq", "path", "error_code", "normalized"),
        "mapping_validate": lambda s, d: files.validate_mappings(drafts(s, d)),
        "persisted_mappings": lambda s, d: files.persisted_mappings(drafts(s, d)),
        "memory_upsert": upserts,
        "memory_replay": lambda s, d: memory.replay(actions(s, d)),
        "memory_mark_stale": stale,
        "memory_review": reviewed,
        "selection_overlap": overlaps,
        "selection_validate": validated,
        "context_selection": selected,
        "task_results": results,
        "task_contract": contract,
        "latest_pane_selection": panes,
        "pinned_panes": pinned,
        "active_target": target,
        "selection_offsets": offsets,
        "memory_filters": listed,
        "memory_matched": lambda s, d: memory.matched(records(s, d), gone(s, d)),
        "memory_stored": stored,
        "task_requests": asked,
        "chat_threads": chats,
        "chat_scopes": scopes,
        "rail_paths": rail,
        "project_config_errors": lambda s, d: projects.checked(config_drafts(s, d)),
        "project_config": config,
        "open_projects": lambda s, d: projects.in_order(opened(s, d)),
        "load_documents": lambda s, d: loaded(s, d).select("root_path", "path", "document_type", "error_code", F.length("text").alias("n_chars")),
        "loaded_spans": loaded_spans,
        "entity_candidates_prose": lambda s, d: extract.entity_candidates(corpus.prose(s, d)),
        "reviewable_summaries_prose": lambda s, d: extract.reviewable_summaries(corpus.prose(s, d)),
    }
    return {name: (lambda s, d, q=q: flat(q(s, d))) for name, q in made.items()}
