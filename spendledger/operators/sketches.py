"""Column profiles that can be merged: distinct values and lengths as sketches, in one pass.

A profile of a load is one small row for each column and group.  Profiles of loads merge
without going back to the data, so a country's or the whole ledger's profile is an
aggregate over stored rows.  Distinct counts are HyperLogLog estimates (standard error
1.04 / 2**(``LOG_K`` / 2), 0.8 % here), lengths are KLL quantiles (rank error below 1.65 %
at the default size, 99 % of the time).  ``column_profile`` gives exact figures.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

LOG_K = 14


def sketch_columns(rows: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``(by…), column_name, n_rows, n_null, n_blank, values, lengths, max_length`` in one aggregate; the last but one are sketches."""
    columns = list(columns or [c for c in rows.columns if c not in by])
    parts = []
    for i, c in enumerate(columns):
        text = F.col(f"`{c}`").cast("string")
        parts += [
            F.count_if(text.isNull()).alias(f"null{i}"), F.count_if(strip(text) == "").alias(f"blank{i}"),
            F.hll_sketch_agg(text, LOG_K).alias(f"values{i}"),
            F.kll_sketch_agg_bigint(F.char_length(text).cast("long")).alias(f"lengths{i}"),
            F.max(F.char_length(text)).alias(f"max{i}"),
        ]
    wide = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *parts)
    return wide.select(*by, F.inline(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col("n_rows"), F.col(f"null{i}").alias("n_null"), F.col(f"blank{i}").alias("n_blank"),
        F.col(f"values{i}").alias("values"), F.col(f"lengths{i}").alias("lengths"), F.col(f"max{i}").alias("max_length"),
    ) for i, c in enumerate(columns)])))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Profiles of any number of groups as those of fewer (``by``)."""
    return sketches.groupBy(*by, "column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.sum("n_blank").alias("n_blank"),
        F.hll_union_agg("values").alias("values"), F.kll_merge_agg_bigint("lengths").alias("lengths"),
        F.max("max_length").alias("max_length"))


def estimates(sketches: DataFrame, quantiles: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """The figures of profiles; a column without a value has no lengths."""
    some = F.col("n_rows") > F.col("n_null")
    return sketches.select(
        *[c for c in sketches.columns if c not in ("values", "lengths")],
        F.hll_sketch_estimate("values").alias("n_distinct"),
        *[F.when(some, F.kll_sketch_get_quantile_bigint("lengths", F.lit(float(q)))).alias(f"length_{round(q * 100)}") for q in quantiles])
