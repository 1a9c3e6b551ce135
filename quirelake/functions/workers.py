"""What Python workers on this machine need."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def workers_see_package(spark: SparkSession) -> None:
    """Let Python workers import the package when it is not installed."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
