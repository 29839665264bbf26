"""JSON feeds: an array of records in one document, or one record per line."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SourceSpec
from ..functions.dates import parse_date
from ..operators.landing import json_path, stage
from .blocks import json_elements
from .positions import mark_blocks, number_records


def read_json_array(spark: SparkSession, path: str, spec: SourceSpec) -> DataFrame:
    """Records of a JSON document at the root or under a dotted path, numbered from 1.

    A document of any size is cut by all tasks that read its blocks; each record is a
    variant of its own, so number and text stay distinct.  What is not JSON stays as it is.
    """
    records = json_elements(spark, path, [k for k in spec.records_path.split(".") if k])
    return records.select("source_file", F.col("ordinal").alias("row_no"),
                          F.coalesce(F.to_json(F.try_parse_json("element")), "element").alias("payload"))


def _metadata_line(spec: SourceSpec | None) -> Column:
    """Whether a line carries the feed's metadata block instead of a record."""
    if spec is None or not spec.metadata_path:
        return F.lit(False)
    block = F.try_variant_get(F.try_parse_json("payload"), json_path(spec.metadata_path), "variant")
    return F.coalesce(F.to_json(block).startswith("{"), F.lit(False))


def read_json_lines(spark: SparkSession, path: str, spec: SourceSpec | None = None) -> DataFrame:
    """One record per line, read in parallel blocks; the number is the line's.

    Blank lines are dropped, and so is a line that holds the source's metadata block.
    """
    lines = spark.read.text(path).withColumnRenamed("value", "payload")
    return number_records(mark_blocks(lines), first=1).where(F.trim("payload") != "").where(~_metadata_line(spec))


def source_metadata(spark: SparkSession, path: str, spec: SourceSpec) -> DataFrame:
    """The source's own metadata block per file: declared record count and extraction day."""
    if spec.reader == "jsonl":
        lines = spark.read.text(path).withColumnRenamed("value", "payload").where(_metadata_line(spec))
        docs = lines.select(F.try_parse_json("payload").alias("_doc"), "_metadata")
    else:
        docs = spark.read.option("multiLine", True).option("singleVariantColumn", "_doc").json(path)
    block = F.try_variant_get("_doc", json_path(spec.metadata_path or "metadata"), "variant")
    stamp = F.try_variant_get(block, json_path(spec.metadata_extracted_at or "extractedAt"), "string")
    return docs.select(
        F.col("_metadata.file_path").alias("source_file"),
        F.to_json(block).alias("source_metadata"),
        F.try_variant_get(block, "$.recordCount", "long").alias("declared_records"),
        (parse_date(stamp, ["%Y-%m-%d"]) if spec.metadata_extracted_at else F.lit(None).cast("date"))
        .alias("extracted_on"),
    )


def stage_json(spark: SparkSession, path: str, spec: SourceSpec, batch_id: str, ingested_at: datetime) -> DataFrame:
    """A JSON feed staged verbatim; nested children stay inside the record."""
    records = read_json_lines(spark, path, spec) if spec.reader == "jsonl" else read_json_array(spark, path, spec)
    return stage(records, spec, batch_id, ingested_at)
