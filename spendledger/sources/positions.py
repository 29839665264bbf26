"""Record ordinals for files that Spark reads in parallel blocks."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = ("_file", "_block")


def mark_blocks(scan: DataFrame) -> DataFrame:
    """Add the file, the block within it and an id that rises inside a block."""
    return scan.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mid"),
    )


def number_records(marked: DataFrame, first: int) -> DataFrame:
    """Replace the marks by ``source_file`` and ``row_no``, counting records per file from ``first``.

    Blocks are counted in parallel; only one row per block is ordered.  Record order
    inside a block is the id's order, so no data row is sorted.
    """
    blocks = marked.groupBy(*BLOCK).agg(F.min("_mid").alias("_start"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select(
        *BLOCK, "_start", "_before")
    kept = [c for c in marked.columns if c not in (*BLOCK, "_mid")]
    return marked.join(offsets, list(BLOCK)).select(
        F.col("_file").alias("source_file"),
        (F.col("_before") + F.col("_mid") - F.col("_start") + first).alias("row_no"),
        *kept,
    )
