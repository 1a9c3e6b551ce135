"""Registered queries over retrieval and what comes of it; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.functions.scratch import kept
from quirelake.operators import context, extract, linking, parse, relations, retrieval, vectors
from quirelake.plans import corpus, oracles
from quirelake.plans import queries as base

TOP = 10


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.spans(corpus.prose(spark, sf_dir)).select("path", "ordinal", "span_type", "text")


def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best spans of all documents for each benchmark text."""
    items = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    return retrieval.search(retrieval.build(spans(spark, sf_dir)), items, TOP)


# --- vectors


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def neighbours(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What the index and what a search through everything find for every vector whose id is divisible by 100."""
    rows = embeddings(spark, sf_dir)
    asked = rows.where("id % 100 = 0").select(F.col("id").alias("query"), "vector")
    index = vectors.build(rows)
    found = vectors.search(index, asked, TOP, vectors.probes_for(index, asked), others=True)
    return found, vectors.exhaustive(rows, asked, TOP, others=True)


def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many neighbours are wanted, and whether the index finds nine in ten of them; one as alike as the last wanted one counts."""
    found, wanted = neighbours(spark, sf_dir)
    least = wanted.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    met = least.join(found, "query", "left").groupBy("query", "n").agg(F.count_if(F.col("score") >= F.col("least") - 1e-6).alias("hits"))
    return met.agg(F.count("*").alias("n_queries"), F.sum("n").alias("n_wanted"), (F.sum(F.least("hits", "n")) >= 0.9 * F.sum("n")).alias("enough"))


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for each benchmark text: those with its words, then those whose vectors are like the best such document's."""
    spans_ = lexical(spark, sf_dir).withColumn("item", F.regexp_extract("path", "doc_([0-9]+)", 1).cast("long"))
    first = Window.partitionBy("query").orderBy(F.min("rank"))
    words = kept(spans_.groupBy("query", "item").agg(F.row_number().over(first).alias("rank")))
    rows = embeddings(spark, sf_dir)
    asked = words.join(rows, words["item"] == rows["id"]).groupBy("query").agg(F.min_by("vector", "rank").alias("vector"))
    alike = vectors.exhaustive(rows, kept(asked), TOP).select("query", "rank", F.col("id").alias("item"))
    return vectors.fused([words, alike], 15)


# --- context


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark text: its best span, the spans near that one, and the next best spans, as far as the room allows."""
    items = corpus.table(spark, sf_dir, "benchmark")
    all_ = kept(spans(spark, sf_dir))
    found = kept(retrieval.search(retrieval.build(all_), items.select(F.col("item_id").alias("query"), "text"), TOP))
    text = all_.select("path", "ordinal", F.char_length("text").cast("long").alias("size"))
    target = found.where("rank = 1").select("query", "path", F.col("ordinal").alias("at"))
    apart = F.col("ordinal") - F.col("at")
    near = target.join(text, "path").where(F.abs(apart) <= 3).select("query", F.when(apart == 0, 0).otherwise(1).alias("class"), (F.abs(apart) * 2 + (apart < 0).cast("int")).alias("rank"), "path", "ordinal", "size")
    rest = found.where("rank > 1").join(text, ["path", "ordinal"]).select("query", F.lit(2).alias("class"), "rank", "path", "ordinal", "size")
    rows = near.unionByName(rest).groupBy("query", "path", "ordinal", "size").agg(F.min(F.struct("class", "rank")).alias("k")).select(F.col("query").alias("request_id"), "k.class", "k.rank", "path", "ordinal", "size")
    budgets = items.select(F.col("item_id").alias("request_id"), (F.lit(200) + F.col("item_id") % 7 * 400).cast("long").alias("budget"))
    return context.assemble(rows, budgets).select("request_id", "class", "rank", "path", "ordinal", "size", "budget", "taken", "used")


# --- links


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place in the prose that names an approved entity: here, one that some document mentions at least twice."""
    prose = kept(parse.spans(corpus.prose(spark, sf_dir)).select("path", "ordinal", "span_type", "normalized_text", "start_char", "end_char"))
    names = extract.candidates_of(extract.mentions(prose)).where("mentions > 1").select("name")
    return linking.link(prose.where("span_type <> 'scene'").select("path", "ordinal", F.col("normalized_text").alias("text")), kept(names))


# --- relationships, timelines, contradictions


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that the prose names together, in one span or in the next."""
    prose = kept(parse.spans(corpus.prose(spark, sf_dir)).select("path", "ordinal", "span_type", "normalized_text", "start_char", "end_char"))
    return relations.related(extract.mentions(prose), prose.where("span_type <> 'scene'").count(), reach=1, least=3)


def timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as each customer's orders have them, written in four ways, two to a span."""
    o, k = corpus.table(spark, sf_dir, "orders"), F.col("o_orderkey") % 4
    day = F.to_date("o_orderdate")
    said = F.when(k == 0, day.cast("string")).when(k == 1, F.date_format(day, "d MMMM yyyy")).when(k == 2, F.date_format(day, "MMMM d, yyyy")).otherwise(F.date_format(day, "MMMM yyyy"))
    text = F.concat(F.lit("On "), said, F.lit(" they wrote; not on 1995-02-31, nor 9"), day.cast("string"), F.lit("."))
    rows = o.select(F.concat(F.lit("ledger/"), "o_custkey", F.lit(".md")).alias("path"), F.col("o_orderkey").cast("int").alias("ordinal"), text.alias("text"))
    return relations.timeline(rows).withColumn("day", F.col("day").cast("string"))


def people(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two reference documents for each customer, the second under another name and at times with another segment; and the names that are one."""
    c, k = corpus.table(spark, sf_dir, "customer"), F.col("c_custkey")
    other = F.when(k % 7 == 0, "UNKNOWN TRADE").otherwise(F.lower("c_mktsegment"))
    first = c.select(F.concat(F.lit("people/"), k, F.lit(".md")).alias("path"), F.concat("c_name", F.lit(": "), "c_mktsegment", F.lit("\n")).alias("text"))
    second = c.select(F.concat(F.lit("ledger/"), k, F.lit(".md")).alias("path"), F.concat(F.lit("Account  of "), k, F.lit(" - "), other, F.lit("\n")).alias("text"))
    names = c.select(F.col("c_name").alias("a"), F.concat(F.lit("Holder "), k).alias("b")).unionByName(c.select(F.concat(F.lit("account of "), k).alias("a"), F.concat(F.lit("holder "), k).alias("b")))
    return first.unionByName(second).withColumn("document_type", F.lit("reference")), names


def contradicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, names = people(spark, sf_dir)
    return relations.contradictions(extract.reviewable_facts(docs), names)


def queries() -> dict[str, base.Query]:
    return {"lexical_retrieval": lexical, "vector_recall": recall, "hybrid_retrieval": hybrid, "context_assembly": assembled, "entity_links": linked, "relationships": relationships, "timelines": timelines, "contradictions": contradicted}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
BM25 = f"""sp AS MATERIALIZED (SELECT path, ordinal, {_WORDS} AS w FROM spans WHERE span_type IN ('heading', 'paragraph')),
n AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean FROM sp),
tf AS MATERIALIZED (SELECT path, ordinal, len(w) AS length, term, count(*)::DOUBLE AS tf FROM (SELECT *, unnest(w) AS term FROM sp) GROUP BY ALL),
wt AS (SELECT term, CAST(floor(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * 1024) AS BIGINT) AS weight FROM (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term), n),
im AS (SELECT path, ordinal, term, CAST(floor(tf * 2.2::DOUBLE / (tf + (length / mean * 0.75::DOUBLE + 0.25::DOUBLE) * 1.2::DOUBLE) * 1024) AS BIGINT) AS impact FROM tf, n),
ask AS (SELECT DISTINCT query, unnest({_WORDS}) AS term FROM asked),
lexical AS (SELECT query, path, ordinal, CAST(sum(weight * impact) AS BIGINT) AS score FROM ask JOIN wt USING (term) JOIN im USING (term) GROUP BY query, path, ordinal),
top AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, path, ordinal) AS rank, path, ordinal, score FROM lexical QUALIFY rank <= {TOP})"""


def oracle_sql() -> dict[str, str]:
    prose = oracles.parsed(oracles.PROSE)
    asked = "asked AS (SELECT item_id AS query, text FROM benchmark)"
    names, clean = oracles.MENTIONS, oracles.CLEAN.format("text")
    return {
        "lexical_retrieval": f"WITH RECURSIVE {prose}, {asked}, {BM25} SELECT * FROM top",
        "vector_recall": f"SELECT count(*) FILTER (vec_id % 100 = 0) AS n_queries, count(*) FILTER (vec_id % 100 = 0) * least(count(*) - 1, {TOP}) AS n_wanted, TRUE AS enough FROM embeddings",
        "hybrid_retrieval": f"""WITH RECURSIVE {prose}, {asked}, {BM25},
hits AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY first) AS rank FROM (SELECT query, CAST(regexp_extract(path, 'doc_([0-9]+)', 1) AS BIGINT) AS item, min(rank) AS first FROM top GROUP BY ALL)),
vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings),
own AS (SELECT query, arg_min(v, rank) AS q, arg_min(norm, rank) AS q_norm FROM hits JOIN vec ON vec_id = item GROUP BY query),
alike AS (SELECT query, vec_id AS item, row_number() OVER (PARTITION BY query ORDER BY round(list_inner_product(q, v) / q_norm / norm, 9) DESC, vec_id) AS rank FROM own, vec QUALIFY rank <= {TOP}),
sums AS (SELECT query, item, min(place) AS place, CAST(sum(floor(1000000 / (rank + 60))) AS BIGINT) AS score FROM (SELECT query, item, rank, 0 AS place FROM hits UNION ALL SELECT query, item, rank, 1 FROM alike) GROUP BY query, item)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY place, score DESC, item) AS rank, item, place, score FROM sums QUALIFY rank <= 15""",
        "context_assembly": f"""WITH RECURSIVE {prose}, {asked}, {BM25}, target AS (SELECT query, path, ordinal AS mid FROM top WHERE rank = 1),
all_rows AS (SELECT query, CASE WHEN s.ordinal = mid THEN 0 ELSE 1 END AS class, abs(s.ordinal - mid) * 2 + CAST(s.ordinal < mid AS INT) AS rank, path, s.ordinal, length(text) AS size FROM target JOIN spans s USING (path) WHERE abs(s.ordinal - mid) <= 3
  UNION ALL SELECT query, 2, rank, path, ordinal, length(s.text) FROM top JOIN spans s USING (path, ordinal) WHERE rank > 1),
cands AS (SELECT query AS request_id, min(class * 1000 + rank) AS k, path, ordinal, size, 200 + query % 7 * 400 AS budget FROM all_rows GROUP BY query, path, ordinal, size),
turns AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY k, size, path, ordinal) AS turn FROM cands WHERE size <= budget),
fill AS (SELECT request_id, 0::BIGINT AS turn, FALSE AS taken, 0::BIGINT AS used FROM (SELECT DISTINCT request_id FROM turns)
  UNION ALL SELECT t.request_id, t.turn, used + size <= budget, CASE WHEN used + size <= budget THEN used + size ELSE used END FROM fill f JOIN turns t ON t.request_id = f.request_id AND t.turn = f.turn + 1)
SELECT request_id, k // 1000 AS class, k % 1000 AS rank, path, ordinal, size, budget, taken, used FROM turns JOIN fill USING (request_id, turn)
UNION ALL SELECT request_id, k // 1000, k % 1000, path, ordinal, size, budget, FALSE, NULL FROM cands WHERE size > budget""",
        "entity_links": f"""WITH RECURSIVE {prose}, {names}, known AS MATERIALIZED (SELECT DISTINCT name FROM entities WHERE mentions > 1),
texts AS MATERIALIZED (SELECT path, ordinal, {clean} AS text FROM spans WHERE span_type <> 'scene'),
met AS (SELECT path, ordinal, text, name, unnest(range(1, length(text) - length(name) + 2)) AS pos FROM texts JOIN known ON contains(text, name)),
good AS (SELECT path, ordinal, pos - 1 AS start, max(pos - 1 + length(name)) AS stop, arg_max(name, length(name)) AS name FROM met WHERE substr(text, pos, length(name)) = name
  AND NOT regexp_matches(substr(text, pos - 1, CASE WHEN pos > 1 THEN 1 ELSE 0 END), '[\\p{{L}}\\p{{N}}]') AND NOT regexp_matches(substr(text, pos + length(name), 1), '[\\p{{L}}\\p{{N}}]') GROUP BY path, ordinal, pos),
turns AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY path, ordinal ORDER BY start) AS turn FROM good),
walk AS (SELECT path, ordinal, turn, start, stop, name, TRUE AS taken, stop AS end_ FROM turns WHERE turn = 1
  UNION ALL SELECT t.path, t.ordinal, t.turn, t.start, t.stop, t.name, t.start >= end_, CASE WHEN t.start >= end_ THEN t.stop ELSE end_ END FROM walk w JOIN turns t ON t.path = w.path AND t.ordinal = w.ordinal AND t.turn = w.turn + 1)
SELECT path, ordinal, start, stop, name FROM walk WHERE taken""",
        "relationships": f"""WITH {prose}, {names}, spot AS MATERIALIZED (SELECT DISTINCT path, ordinal, lower(name) AS name FROM ment WHERE name NOT IN ('The', 'A', 'An')),
met AS (SELECT least(x.name, y.name) AS first, greatest(x.name, y.name) AS second FROM spot x JOIN spot y ON y.path = x.path AND (y.ordinal = x.ordinal AND x.name < y.name OR y.ordinal = x.ordinal + 1 AND x.name <> y.name)),
pairs AS (SELECT first, second, count(*) AS n FROM met GROUP BY ALL HAVING count(*) >= 3), c AS (SELECT name, count(*) AS n FROM spot GROUP BY name)
SELECT first, second, p.n, CAST(floor(1000 * ln(p.n::DOUBLE * (SELECT count(*) FROM spans WHERE span_type <> 'scene') / (a.n::DOUBLE * b.n))) AS BIGINT) AS score FROM pairs p JOIN c a ON a.name = first JOIN c b ON b.name = second""",
        "timelines": """WITH o AS (SELECT 'ledger/' || o_custkey || '.md' AS path, o_orderkey AS ordinal, CAST(o_orderdate AS DATE) AS d, o_orderkey % 4 AS k FROM orders),
s AS (SELECT path, ordinal, CASE k WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN day(d) || strftime(d, ' %B %Y') WHEN 2 THEN strftime(d, '%B ') || day(d) || strftime(d, ', %Y') ELSE strftime(d, '%B %Y') END AS said,
  CASE k WHEN 3 THEN date_trunc('month', d)::DATE ELSE d END AS day, CASE k WHEN 3 THEN 'month' ELSE 'day' END AS precision FROM o)
SELECT path, row_number() OVER (PARTITION BY path ORDER BY day, ordinal) - 1 AS position, ordinal, 0 AS nth, said, CAST(day AS VARCHAR) AS day, precision FROM s""",
        "contradictions": """SELECT least('account of ' || c_custkey, lower(c_name)) AS entity, 'is' AS predicate, d AS path, 0 AS ordinal, s AS subject, o AS object
FROM (SELECT c_custkey, c_name, unnest(['people/' || c_custkey || '.md', 'ledger/' || c_custkey || '.md']) AS d, unnest([c_name, 'Account  of ' || c_custkey]) AS s, unnest([c_mktsegment, 'UNKNOWN TRADE']) AS o FROM customer WHERE c_custkey % 7 = 0)""",
    }
