"""Delimited text: every value as text, surplus fields kept, records numbered from 2."""
from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..config import SourceSpec
from ..operators.landing import stage
from .blocks import quoted_records
from .positions import mark_blocks, number_records

_RAW = "_raw_record"
EXTRA = "_extra"


def read_header(spark: SparkSession, path: str, spec: SourceSpec) -> list[str]:
    """Column names from the first record, byte-order mark removed; reads one row."""
    first = (
        spark.read.option("sep", spec.delimiter).option("encoding", spec.encoding).option("header", False)
        .option("escape", '"').csv(path).first()
    )
    if first is None:
        raise ValueError(f"{path}: no header")
    names = [v or "" for v in first]
    names[0] = names[0].lstrip("﻿")
    return names


def _tokens(raw: Column, delimiter: str) -> Column:
    """All fields of a raw record; a quoted field may contain the delimiter."""
    d = re.escape(delimiter)
    pattern = rf'(?s)(?:^|{d})(?:"(?:[^"]|"")*"|[^{d}]*)'
    fields = F.regexp_extract_all(raw, F.lit(pattern), F.lit(0))
    return F.transform(
        fields,
        lambda t: F.regexp_replace(
            F.regexp_replace(F.regexp_replace(t, f"^{d}", ""), '^"((?s).*)"$', "$1"), '""', '"'),
    )


def read_delimited(spark: SparkSession, path: str, spec: SourceSpec) -> DataFrame:
    """Records as ``source_file, row_no`` and one text column per header field.

    Fields beyond the header are kept as an array in ``_extra``; an empty field is ``''``,
    a field missing from a short record is NULL.  Large files are read in blocks, with
    ``multiline`` too, which quoted line breaks require.
    """
    names = read_header(spark, path, spec)
    safe = [f"c{i}" for i in range(len(names))]
    schema = StructType([StructField(c, StringType()) for c in (*safe, _RAW)])
    if spec.multiline:
        options = {"sep": spec.delimiter, "escape": '"', "columnNameOfCorruptRecord": _RAW}
        parsed = F.from_csv("record", F.lit(schema.simpleString()), options).alias("_v")
        numbered = quoted_records(spark, path, encoding=spec.encoding).where("ordinal > 1").select(
            "source_file", F.col("ordinal").alias("row_no"), parsed).select("source_file", "row_no", "_v.*")
    else:
        scan = (
            spark.read.schema(schema)
            .option("sep", spec.delimiter).option("encoding", spec.encoding)
            .option("header", True).option("enforceSchema", True).option("escape", '"')
            .option("columnNameOfCorruptRecord", _RAW)
            .csv(path)
        )
        numbered = number_records(mark_blocks(scan), first=2)
    found = _tokens(F.col(_RAW), spec.delimiter)
    width = len(names)
    numbered = numbered.withColumn("_fields", found)
    present = F.coalesce(F.size("_fields"), F.lit(width))
    values = [
        F.when(F.lit(i) < present, F.coalesce(c, F.lit(""))).alias(name)
        for i, (c, name) in enumerate(zip(safe, names))
    ]
    extra = F.when(present > width, F.slice("_fields", width + 1, F.greatest(present - width, F.lit(1))))
    return numbered.select("source_file", "row_no", *values, extra.alias(EXTRA))


def stage_delimited(spark: SparkSession, path: str, spec: SourceSpec, batch_id: str,
                    ingested_at: datetime) -> DataFrame:
    """A delimited file staged verbatim; ``_extra`` appears in the payload only where it exists."""
    records = read_delimited(spark, path, spec)
    fields = [c for c in records.columns if c not in ("source_file", "row_no", EXTRA)]
    plain = F.to_json(F.struct(*[F.col(f"`{c}`") for c in fields]), {"ignoreNullFields": "false"})
    with_extra = F.to_json(F.struct(*[F.col(f"`{c}`") for c in (*fields, EXTRA)]), {"ignoreNullFields": "false"})
    payload = F.when(F.col(EXTRA).isNull(), plain).otherwise(with_extra)
    return stage(records, spec, batch_id, ingested_at, payload)
