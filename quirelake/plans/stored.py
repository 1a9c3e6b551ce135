"""Registered queries over what is stored: trees on disk, saved mappings, remembered records and streams; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.functions.scratch import kept, scratch
from quirelake.operators import drafts
from quirelake.plans import corpus, oracles
from quirelake.plans import queries as base
from quirelake.sources import files, memory_store, projects, tree
from quirelake.streaming import staleness

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# --- trees


def on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of all projects, written to a folder and read from there: some empty, some not UTF-8."""
    k = F.regexp_extract("path", "([0-9]+)[.]", 1).cast("long")
    data = F.encode("text", "UTF-8")
    content = F.when(k % 13 == 0, F.concat(F.unhex(F.lit("FF")), data)).when(k % 11 == 0, F.lit(b"")).otherwise(data)
    root = scratch(spark)
    tree.write_tree(corpus.tree(spark, sf_dir).select(F.concat(F.substring("root_path", 2, 1_000), F.lit("/"), "path").alias("path"), content.alias("content")), root)
    return tree.read_tree(spark, root)


def disk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_disk(spark, sf_dir).select("path", "error_code", F.char_length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"))


def disk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every discovered document of every configured project, loaded from disk."""
    names = F.split("path", "/")
    below = kept(on_disk(spark, sf_dir).select(F.concat(F.lit("/"), F.array_join(F.slice(names, 1, 2), "/")).alias("root_path"), F.array_join(F.slice(names, 3, F.size(names)), "/").alias("path"), "text", "error_code"))
    opened = kept(projects.open_projects(base.every_root(spark, sf_dir), kept(base.config(spark, sf_dir)), below))
    asked = opened.where("error_code IS NULL").select("root_path", "path")
    return projects.load_documents(asked, opened, below).select("root_path", "path", "document_type", "error_code", F.char_length("text").alias("n_chars"))


# --- saved and scanned mappings

SAVED = [("Zeta", "reference", True), ("archive", "ignore", False), ("Beta", "notes", True)]


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directories of each project as scanned, with what its configuration says of them."""
    roots = base.roots(spark, sf_dir)
    listed = roots.select("root_path", F.explode(F.array(F.lit("void"), F.lit(".cache"))).alias("path"))
    found = files.import_candidates(corpus.tree(spark, sf_dir), listed, by=("root_path",))
    found = found.withColumn("seq", F.row_number().over(Window.partitionBy("root_path").orderBy("path")))
    more = base.literal(spark, SAVED, "path string, role string, enabled boolean")
    saved = base.config(spark, sf_dir).select("root_path", "path", "role", "enabled").unionByName(roots.where("n % 3 = 0").select("root_path").join(F.broadcast(more)))
    return files.merge_mappings(found, saved, by=("root_path",))


# --- remembered records


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = corpus.table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(
        F.concat(F.lit("e"), k % 1_000_003).alias("id"),
        F.col("c_custkey").alias("seq"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("nation/"), "c_nationkey", F.lit(".md")).alias("source_document_path"),
        memory_store.anchors_json("span", (k % 50).cast("int")).alias("source_anchors_json"),
        (k % 90).alias("source_start_char"),
        (k % 90 + 7).alias("source_end_char"),
        F.lit("pending").alias("review_state"),
        F.lit("current").alias("staleness_state"),
    )


def remembered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after saves, reviews, staleness calls and saves again, as each kind is listed."""
    store, k = scratch(spark), F.regexp_extract("id", "[0-9]+", 0).cast("long")
    first = entities(spark, sf_dir)
    memory_store.save(first, store, "entity_candidates")
    facts = corpus.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("f"), "s_suppkey").alias("id"), (-F.col("s_suppkey")).alias("seq"), F.col("s_name").alias("subject"), F.lit("is").alias("predicate"), F.concat(F.lit("in "), "s_nationkey").alias("object"),
        F.concat(F.lit("nation/"), "s_nationkey", F.lit(".md")).alias("source_document_path"), F.when(F.col("s_suppkey") % 4 == 0, "[{}]").otherwise("[]").alias("source_anchors_json"),
        F.lit(0).cast("long").alias("source_start_char"), F.lit(1).cast("long").alias("source_end_char"), F.when(F.col("s_suppkey") % 3 == 0, "approved").otherwise("pending").alias("review_state"), F.lit("current").alias("staleness_state"),
    )
    memory_store.save(facts, store, "reviewable_facts")
    updates = first.where(k % 3 > 0).select("id", F.when(k % 3 == 1, "approved").otherwise("rejected").alias("review_state"), F.lit(1).alias("seq"))
    memory_store.review(updates.unionByName(base.literal(spark, [("unknown", "approved", 1)], "id string, review_state string, seq int")), store, "entity_candidates")
    gone = corpus.table(spark, sf_dir, "nation").where("n_nationkey % 4 = 0").select(F.concat(F.lit("nation/"), "n_nationkey", F.lit(".md")).alias("path"))
    memory_store.mark_stale(gone, store)
    memory_store.save(first.where(k % 5 == 0).withColumn("name", F.concat(F.lit("again "), "name")), store, "entity_candidates")
    out = None
    for kind, name in (("entity_candidates", "name"), ("reviewable_facts", "subject"), ("reviewable_summaries", "text")):
        rows = memory_store.listed(spark, store, kind)
        part = rows.select(F.lit(kind).alias("kind"), "id", F.col(name).alias("name"), "first.op", "first.nth", "review_state", "staleness_state", "error_code")
        out = part if out is None else out.unionByName(part)
    return out


# --- staleness as a stream

VERSIONS = 3


def versions(spark: SparkSession, sf_dir: str, turn: int) -> DataFrame:
    """The events of a turn: versions of documents, and records saved after them."""
    d, k = corpus.table(spark, sf_dir, "documents"), F.col("doc_id")
    path = F.concat("source", F.lit("/"), "doc_id").alias("path")
    texts = (
        F.col("text"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 4 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")),
        F.when(k % 5 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" again"))),
    )
    who = (F.lit(True), (k % 5 == 0) | (k % 2 == 0), (k % 5 == 0) | (k % 7 == 0))
    saved = ((F.lit(True), ("a", "b")), (k % 3 == 0, ("a",)), (k % 11 == 0, ("b", "c")))
    held = d.where(who[turn]).select(path, F.lit(2 * turn).cast("long").alias("seq"), F.lit(None).cast("string").alias("id"), texts[turn].alias("text"))
    cond, names = saved[turn]
    made = d.where(cond).select(path, F.lit(2 * turn + 1).cast("long").alias("seq"), F.explode(F.array(*(F.concat("doc_id", F.lit(f"/{n}")) for n in names))).alias("id"), F.lit(None).cast("string").alias("text"))
    return held.unionByName(made)


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that became stale, over turns that come one by one; a run after each turn, and one more that finds nothing new."""
    base_dir = scratch(spark)
    source, out, checkpoint = (f"{base_dir}/{x}" for x in ("events", "stale", "state"))
    for turn in range(VERSIONS):
        versions(spark, sf_dir, turn).write.mode("append").parquet(source)
        staleness.stale_records(spark, source, out, checkpoint)
    staleness.stale_records(spark, source, out, checkpoint)
    return spark.read.schema(staleness.STALE).parquet(out)


# --- drafts


def drafted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and drafts of them: digests once all hunks are accepted or rejected, and where the last line lies then, if it is the same."""
    d, k = corpus.table(spark, sf_dir, "documents"), F.col("doc_id")
    lines = F.split("text", "\n", -1)
    last = F.size(lines) - 1

    def edited(x: Column, i: Column) -> Column:
        new = F.when((i + k) % 7 == 0, F.concat(x, F.lit(" (edited)"))).when((i + k) % 11 == 3, F.lit(None).cast("string")).otherwise(x)
        return F.when((i + k) % 13 == 5, F.concat(F.coalesce(new, F.lit("")), F.lit("\ninserted"))).otherwise(new)

    new = F.array_join(F.array_compact(F.transform(lines, lambda x, i: F.when(i < last, edited(x, i)).when(k % 3 == 0, F.concat(x, F.lit("!"))).otherwise(x))), "\n")
    pairs = d.select(k.cast("string").alias("path"), F.col("text").alias("old"), new.alias("new"), F.char_length(F.element_at(lines, -1)).cast("long").alias("tail"))
    hunks = kept(drafts.diff(pairs))
    size = F.char_length("old").cast("long")
    ends = drafts.moved(pairs.select("path", (size - F.col("tail")).alias("start_char"), size.alias("end_char")), hunks).select("path", "new_start", "new_end")
    digest = lambda name, h: drafts.applied(pairs, h).select("path", F.sha2("text", 256).alias(name))
    return digest("accepted", hunks).join(digest("rejected", hunks.limit(0)), "path").join(ends, "path")


def queries() -> dict[str, base.Query]:
    return {
        "healthcheck": lambda s, d: projects.healthcheck({t: corpus.table(s, d, t) for t in TABLES}),
        "disk_tree": disk_tree,
        "disk_documents": disk_documents,
        "mapping_merge": merged,
        "memory_store": remembered,
        "staleness_stream": streamed,
        "draft_review": drafted,
    }


_DISK = f"""files AS MATERIALIZED (SELECT *, CASE WHEN k % 13 = 0 THEN 'document_not_utf8' END AS bad, CASE WHEN k % 13 = 0 THEN NULL WHEN k % 11 = 0 THEN '' ELSE text END AS held
  FROM (SELECT *, CAST(regexp_extract(path, '([0-9]+)[.]', 1) AS BIGINT) AS k FROM ({oracles.TREE})) WHERE NOT regexp_matches(path, '(^|/)\\.'))"""
_RECORDS = """e AS (SELECT 'entity_candidates' AS kind, 'e' || c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'again ' ELSE '' END || c_name AS name, 1 AS op, c_custkey AS nth,
  CASE WHEN c_custkey % 5 = 0 THEN 'pending' WHEN c_custkey % 3 = 1 THEN 'approved' WHEN c_custkey % 3 = 2 THEN 'rejected' ELSE 'pending' END AS review_state,
  CASE WHEN c_custkey % 5 <> 0 AND c_nationkey % 4 = 0 THEN 'stale' ELSE 'current' END AS staleness_state, NULL AS error_code FROM customer),
f AS (SELECT 'reviewable_facts' AS kind, 'f' || s_suppkey AS id, s_name AS name, 2 AS op, -s_suppkey AS nth, CASE WHEN s_suppkey % 3 = 0 THEN 'approved' ELSE 'pending' END AS review_state,
  CASE WHEN s_nationkey % 4 = 0 THEN 'stale' ELSE 'current' END AS staleness_state, CASE WHEN s_suppkey % 4 = 0 THEN 'invalid_stored_anchors' END AS error_code FROM supplier)"""
_STREAM = """v AS (SELECT source || '/' || doc_id AS path, 0 AS seq, text FROM documents
  UNION ALL SELECT source || '/' || doc_id, 2, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN text || ' edited' ELSE text END FROM documents WHERE doc_id % 5 = 0 OR doc_id % 2 = 0
  UNION ALL SELECT source || '/' || doc_id, 4, CASE WHEN doc_id % 5 = 0 THEN text ELSE text || ' again' END FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0),
saved AS (SELECT source || '/' || doc_id AS path, doc_id || '/' || n AS id, 1 AS seq FROM documents, (SELECT unnest(['a', 'b']) AS n)
  UNION ALL SELECT source || '/' || doc_id, doc_id || '/a', 3 FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT source || '/' || doc_id, doc_id || '/' || n, 5 FROM documents, (SELECT unnest(['b', 'c']) AS n) WHERE doc_id % 11 = 0),
changes AS (SELECT path, seq, CASE WHEN text IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM (SELECT *, lag(text) OVER w AS old, row_number() OVER w AS k FROM v WINDOW w AS (PARTITION BY path ORDER BY seq)) WHERE k > 1 AND text IS DISTINCT FROM old)"""


def oracle_sql() -> dict[str, str]:
    opened = f"WITH {oracles.CONFIG}, tree AS MATERIALIZED ({oracles.TREE}), {oracles.OPENED.replace('EXT', oracles.EXTENSION)}"
    own = f"CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS path, {oracles.EXTENSION} IN ('md', 'markdown', 'mdown', 'txt') AS own"
    return {
        "healthcheck": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, 'quirelake engine ready' AS status FROM {t}" for t in TABLES),
        "disk_tree": f"WITH {_DISK} SELECT substr(root_path, 2) || '/' || path AS path, bad AS error_code, length(held) AS n_chars, sha256(held) AS digest FROM files",
        "disk_documents": f"{opened}, {_DISK} SELECT root_path, path, document_type, bad AS error_code, length(held) AS n_chars FROM shown JOIN files USING (root_path, path)",
        "mapping_merge": f"""{opened}, seen AS (SELECT root_path, {own} FROM tree WHERE NOT regexp_matches(path, '(^|/)\\.[^/]+/')),
c AS (SELECT root_path, path FROM seen GROUP BY root_path, path HAVING path <> '.' OR bool_or(own) UNION ALL SELECT root_path, 'void' FROM roots),
s AS (SELECT root_path, path, role, enabled FROM saved UNION ALL SELECT root_path, m.path, m.role, m.enabled FROM roots, {oracles.values(SAVED, 'path, role, enabled')} m WHERE num % 3 = 0),
both_ AS (SELECT c.root_path, c.path, CASE WHEN s.path IS NOT NULL THEN role WHEN c.path = 'chapters' THEN 'primary_manuscript' WHEN c.path = 'notes' THEN 'notes' END AS role, coalesce(enabled, TRUE) AS enabled, TRUE AS scanned FROM c LEFT JOIN s USING (root_path, path)
  UNION ALL SELECT root_path, path, role, enabled, FALSE FROM s ANTI JOIN c USING (root_path, path))
SELECT *, row_number() OVER (PARTITION BY root_path ORDER BY scanned DESC, CASE WHEN scanned THEN path ELSE lower(path) END) - 1 AS position FROM both_""",
        "memory_store": f"WITH {_RECORDS} SELECT * FROM e UNION ALL SELECT * FROM f",
        "draft_review": """WITH d AS (SELECT doc_id AS k, text, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT k, text, ls, list_filter(list_transform(ls, lambda x, i: CASE WHEN i < len(ls) THEN CASE WHEN (i - 1 + k) % 13 = 5 THEN
    coalesce(CASE WHEN (i - 1 + k) % 7 = 0 THEN x || ' (edited)' WHEN (i - 1 + k) % 11 = 3 THEN NULL ELSE x END, '') || chr(10) || 'inserted'
    WHEN (i - 1 + k) % 7 = 0 THEN x || ' (edited)' WHEN (i - 1 + k) % 11 = 3 THEN NULL ELSE x END WHEN k % 3 = 0 THEN x || '!' ELSE x END), lambda x: x IS NOT NULL) AS ns FROM d),
n AS (SELECT *, array_to_string(ns, chr(10)) AS new FROM e)
SELECT CAST(k AS VARCHAR) AS path, sha256(new) AS accepted, sha256(text) AS rejected, CASE WHEN k % 3 <> 0 THEN length(new) - length(ls[-1]) END AS new_start, CASE WHEN k % 3 <> 0 THEN length(new) END AS new_end FROM n""",
        "staleness_stream": f"WITH {_STREAM} SELECT DISTINCT s.id, s.path, min(c.seq) AS seq, arg_min(c.change, c.seq) AS change FROM saved s JOIN changes c ON c.path = s.path AND c.seq > s.seq GROUP BY s.id, s.path, s.seq",
    }
