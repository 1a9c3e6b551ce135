"""What operator 8 sends through the driver."""

from pyspark.sql import functions as F

from quirelake.llm import quotation
from quirelake.llm.common import lookup, written


def executed(df):
    """The result's number of rows, and the plan that ran."""
    n = len(df.collect())
    return n, df._jdf.queryExecution().executedPlan().toString()


def test_threads_reach_their_messages_without_the_driver(spark):
    messages = spark.range(3_000).select(
        F.expr("id div 10").alias("conv_id"), F.expr("id % 10").alias("turn"), F.lit("user").alias("role"), F.concat(F.when(F.expr("id % 10 = 5"), "> line 2\n").otherwise(""), F.lit("line "), F.expr("id % 10")).alias("text")
    )
    n, plan = executed(quotation.reply_ordered(messages))
    assert n == 3_000
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_a_lookup_in_a_small_file_is_no_broadcast(spark):
    """Equal values take next to no room in a file, and each row is repeated by salt."""
    right = written(spark.range(5_000).select("id", F.lit(0).alias("a"), F.lit(None).cast("long").alias("b")))
    n, plan = executed(lookup(spark.range(6_000), right, ["id"]))
    assert n == 6_000
    assert "BroadcastExchange" not in plan
