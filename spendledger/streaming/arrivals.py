"""Re-delivered extracts picked up from a folder, each replacing its country's load."""
from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import SourceSpec
from ..plans.load import Reference, classify_country, load_source
from ..sources.warehouse import Warehouse


def load_arrivals(
    spark: SparkSession,
    warehouse: Warehouse,
    spec: SourceSpec,
    folder: str,
    reference: Reference,
    checkpoint: str,
) -> StreamingQuery:
    """Load every new file of one source once; the stream's checkpoint remembers what was seen.

    A micro-batch is one file, so each arrival is loaded in its turn and a re-delivery supersedes the one before.
    """

    def load(arrived: DataFrame, _: int) -> None:
        newest = arrived.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()
        if newest is None or newest["path"] is None:
            return
        at = datetime.now(timezone.utc).replace(tzinfo=None)
        load_source(spark, warehouse, spec, newest["path"], reference, at)
        classify_country(spark, warehouse, reference, at, spec.country_code)

    files = (
        spark.readStream.format("binaryFile").option("maxFilesPerTrigger", 1)
        .schema("path string, modificationTime timestamp, length long, content binary").load(folder)
        .select("path", "modificationTime")
    )
    return (
        files.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
