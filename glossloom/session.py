"""Sessions, and what Python workers need."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def workers_find_us(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when the driver runs outside its folder; a cluster installs it or ships it with --py-files."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
    return spark
