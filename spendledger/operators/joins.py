"""Two ways to look something up, neither of which trusts a side to be small or even."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def row_salt(row_key: Sequence[str | Column], salts: int = SALTS) -> Column:
    """A salt that depends on the row alone, so a recomputed task repeats it."""
    return F.pmod(F.xxhash64(*row_key), F.lit(salts)).cast("int")


def salted_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    row_key: Sequence[str],
    how: str = "left",
    salts: int = SALTS,
) -> DataFrame:
    """Join rows to a lookup with one row per key, spreading a hot (or NULL) key over ``salts`` tasks.

    The lookup is copied once per salt; the rows are shuffled once, never grouped.
    """
    spread = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keyed = rows.withColumn("_salt", row_salt(row_key, salts))
    return keyed.join(spread, [*on, "_salt"], how).drop("_salt")


def reference_lookup(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join to a reference table, leaving the way to Spark.

    A table of configured values has a known size in bytes and is broadcast when it is
    below Spark's own threshold; anything else is shuffled, unless its shuffled size turns
    out to be small, and skewed keys are split at run time.  Nothing is counted beforehand.
    """
    return rows.join(table, list(on), how)
