"""Session helpers: where shared scratch tables live, and sane local defaults."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def local_session(app: str = "spendledger", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the local benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # The JVM never compiles methods above this size; unfused operators beat them.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


def compiled(spark: SparkSession) -> SparkSession:
    """The session, set so that Spark does not fuse operators into methods that the JVM never compiles (over 8,000 bytes).

    For programs that harmonise or classify; a limit below the default that somebody has set stays.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key)) > 8000:
        spark.conf.set(key, "8000")
    return spark


def values_table(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """Configured values as a table whose size the planner knows, unlike one made from Python rows."""
    schema = StructType.fromDDL(ddl)
    columns = list(zip(*rows)) or [()] * len(schema)
    return spark.createDataFrame(pa.table({f.name: list(c) for f, c in zip(schema, columns)}), schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Read from ``spark.checkpoint.dir``.  Only a local session without the setting
    gets a temporary folder of its own; on a cluster a missing setting is an error,
    because a folder on one machine would be lost with that machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        made = tempfile.mkdtemp(prefix="spendledger-")
        spark.conf.set("spark.checkpoint.dir", made)
        return made
    raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/spendledger/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table that is read more than once to the shared folder and read it back.

    The shuffle files of the write go when it ends, so they do not stand on the disks beside those of its readers.
    """
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = scratch_path(spark, name), spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)
