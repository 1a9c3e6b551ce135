"""The registered queries of this subpackage, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import context_tree, decontamination, exact_dedup, language, line_dedup, middle, packing, quality, quotation, resampling, simhash, suffix_dedup, url_filter
from quirelake.llm.common import documents


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.digest(decontamination.decontaminate(documents(spark, sf_dir, "doc_id", "text"), benchmark))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir, "doc_id", "text"))


def op3_context_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score_documents(documents(spark, sf_dir, "doc_id", "text"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir, "doc_id", "text"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_dedup(documents(spark, sf_dir, "doc_id", "text")))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir, "doc_id", "text"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.reply_ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def quoted_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 over the table's messages with quotes put in: each but the first of a conversation quotes an earlier one, every third the first one as well, a level deeper."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    marked = lambda text, mark: F.concat(F.lit(f"{mark} "), F.replace(text, F.lit("\n"), F.lit(f"\n{mark} ")), F.lit("\n"))
    asked = c.where("conv_id % 4 <> 0 AND turn > 0").select("conv_id", "turn", ((F.col("turn") * 3 + F.col("conv_id")) % F.col("turn")).alias("from"))
    earlier = c.select(F.col("conv_id").alias("own"), F.col("turn").alias("at"), F.col("text").alias("quoted"))
    first = c.where("turn = 0").select(F.col("conv_id").alias("own"), F.col("text").alias("first"))
    rows = asked.join(earlier, (F.col("conv_id") == F.col("own")) & (F.col("from") == F.col("at"))).drop("own", "at").join(first, F.col("conv_id") == F.col("own"), "left").drop("own")
    deep = F.when(F.col("turn") % 3 == 0, marked(F.coalesce("first", F.lit("")), ">>")).otherwise("")
    rows = rows.select("conv_id", "turn", F.concat(F.lit("They wrote:\n"), deep, marked(F.coalesce("quoted", F.lit("")), ">")).alias("head"))
    return quotation.reply_ordered(c.join(rows, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", F.concat(F.coalesce("head", F.lit("")), F.coalesce("text", F.lit(""))).alias("text")))


QUOTED = """quoted AS (SELECT c.conv_id, c.turn, c.role, CASE WHEN q.conv_id IS NOT NULL THEN 'They wrote:' || chr(10) || CASE WHEN c.turn % 3 = 0 THEN '>> ' || replace(coalesce(f.text, ''), chr(10), chr(10) || '>> ') || chr(10) ELSE '' END
  || '> ' || replace(coalesce(q.text, ''), chr(10), chr(10) || '> ') || chr(10) ELSE '' END || coalesce(c.text, '') AS text
  FROM conversations c LEFT JOIN conversations q ON c.conv_id % 4 <> 0 AND c.turn > 0 AND q.conv_id = c.conv_id AND q.turn = (c.turn * 3 + c.conv_id) % nullif(c.turn, 0) LEFT JOIN conversations f ON f.conv_id = c.conv_id AND f.turn = 0)"""


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir, "doc_id", "text"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is made from the corpus: domains with a word of url_filter.WORDS in their first label."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.judge(pages, url_filter.listed_by_words(pages), url_filter.RULES)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digest(middle.fill_in_middle(documents(spark, sf_dir, "doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_line_dedup": op2_line_dedup,
        "op3_context_tree_scoring": op3_context_tree_scoring,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_simhash_near_dedup": op5_simhash_near_dedup,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_quality": op7_quality,
        "op8_quotation_linking": op8_quotation_linking,
        "quoted_threads": quoted_threads,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_language_id": op10_language_id,
        "op11_url_filters": op11_url_filters,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontamination.ORACLE,
        "op2_line_dedup": line_dedup.ORACLE,
        "op4_exact_dedup": exact_dedup.ORACLE,
        "op8_quotation_linking": quotation.ORACLE,
        "quoted_threads": quotation.ORACLE.replace("FROM conversations", "FROM quoted").replace("WITH RECURSIVE", f"WITH RECURSIVE {QUOTED},", 1),
        "op11_url_filters": url_filter.ORACLE,
        "op12_importance_resampling": resampling.ORACLE,
        "op13_fill_in_middle": middle.ORACLE,
    }
