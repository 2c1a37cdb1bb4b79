"""Session settings the plans are written for, and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE picks join strategies from measured sizes, splits skewed join partitions even
# where that costs a shuffle, and merges small shuffle partitions.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


_MB, _GB = 1 << 20, 1 << 30


def settings_for(input_bytes: int, cores: int) -> dict[str, str]:
    """Settings for an input size: scans and shuffles in parts that fit a task.

    Scan parts grow from 128 MB to 512 MB so that hundreds of terabytes stay below a
    few hundred thousand tasks. Shuffles start with a part per GB of input, at least
    one per core; adaptive execution merges those that turn out small.
    """
    scan_part = min(max(input_bytes // 200_000, 128 * _MB), 512 * _MB)
    shuffle_parts = min(max(input_bytes // _GB, cores), 100_000)
    return CLUSTER_SETTINGS | {
        "spark.sql.files.maxPartitionBytes": str(scan_part),
        "spark.sql.shuffle.partitions": str(shuffle_parts),
    }


def working_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder of ``spark.checkpoint.dir``.

    Where that is not set, a local session uses its warehouse folder. On a cluster that
    folder may be one machine's own, so there the setting must be given.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/riskflow/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the working folder, computed now and only once."""
    path = working_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
