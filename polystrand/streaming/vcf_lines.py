"""Structured Streaming over variant lines: parsed rows and running counts by status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vcf


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as they arrive under ``path``; vcf_id is the file's path;
    lines have no number, as they come in any order."""
    return spark.readStream.text(path).select(F.input_file_name().alias("vcf_id"), F.lit(None).cast("long").alias("line_no"), F.col("value").alias("line"))


def skip_counts(lines: DataFrame) -> DataFrame:
    return vcf.parse(lines).groupBy("vcf_id", "status").agg(F.count("*").alias("n"))
