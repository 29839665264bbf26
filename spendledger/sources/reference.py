"""Supplied reference lists: countries and the two code schemes."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SourceSpec
from .delimited import read_delimited


def read_reference_csv(spark: SparkSession, path: str) -> DataFrame:
    """A comma-separated list with a header; a byte-order mark does not reach the first name."""
    return read_delimited(spark, path, SourceSpec("", multiline=True)).drop("source_file", "_extra")


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    rows = read_reference_csv(spark, path)
    last = F.max_by(F.struct("country_name", "primary_currency",
                             *(["language"] if "language" in rows.columns else [])), "row_no")
    listed = rows.groupBy("country_code").agg(last.alias("_r")).select("country_code", "_r.*")
    return listed if "language" in rows.columns else listed.withColumn("language", F.lit(None).cast("string"))


def read_scheme(spark: SparkSession, path: str, scheme: str) -> DataFrame:
    """``code, description, notes`` of scheme ``sha`` or ``srhr``; a repeated code keeps its last row."""
    rows = read_reference_csv(spark, path).select(
        F.col(f"{scheme}_code").alias("code"), F.col(f"{scheme}_description").alias("description"),
        F.nullif("notes", F.lit("")).alias("notes"), "row_no")
    return rows.groupBy("code").agg(F.max_by(F.struct("description", "notes"), "row_no").alias("_r")).select(
        "code", "_r.*")
