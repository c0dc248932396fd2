"""A session with the settings that the library expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "driftgauge", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC and adaptive execution; on a cluster give neither master nor partitions, so that its own settings hold."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", shuffle_partitions)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def _folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Where it is unset, a local session uses a temporary folder; a cluster, whose machines share none, gets an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="driftgauge-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` worked out once and cut from its lineage by a reliable checkpoint in the shared folder."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt over all cores by ``by``, before each of its rows becomes many: a small file is one task, whatever is made of it.

    The number of parts is given, as adaptive execution would merge small ones: four a core, and no fewer than a shuffle has.
    """
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def few(table: DataFrame, most: int = 100_000) -> DataFrame:
    """A table that is cheap to count, broadcast if it is small."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder."""
    return f"{_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
