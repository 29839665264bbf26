"""Domain constraints as violation counts, one row per constraint."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_checks(rows: DataFrame, table: str, not_null: Sequence[str] = (),
                  domains: Mapping[str, Sequence] | None = None) -> DataFrame:
    """NOT NULL and closed-list checks of one table in a single aggregate."""
    domains = domains or {}
    counts = [F.count_if(F.col(c).isNull()).alias(f"not_null:{c}") for c in not_null]
    counts += [
        F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*allowed)).alias(f"domain:{c}")
        for c, allowed in domains.items()
    ]
    names = [f"not_null:{c}" for c in not_null] + [f"domain:{c}" for c in domains]
    wide = rows.agg(*counts)
    pairs = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"`{n}`").alias("violations")) for n in names])
    return wide.select(F.lit(table).alias("table_name"), F.inline(pairs))


def unique_check(rows: DataFrame, table: str, key: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key (NULL keys are exempt)."""
    present = rows.dropna(subset=list(key))
    surplus = present.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return surplus.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit("unique:" + ",".join(key)).alias("check_name"), "violations")


def foreign_key_check(rows: DataFrame, table: str, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose key is missing from the parent.

    Keys are counted first, so the anti-join sees each key once however often it occurs.
    """
    keys = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    orphans = keys.join(parent.select(F.col(parent_column).alias("_k")).distinct(), "_k", "left_anti")
    return orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit(f"foreign_key:{column}").alias("check_name"), "violations")
