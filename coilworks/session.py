"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Parquet pushes filters and columns into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir).

    Only where the session names none (tests, one machine) a temporary folder is
    set, since a folder of one machine would be lost with that machine.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = os.path.join(tempfile.gettempdir(), f"checkpoint-{uuid.uuid4().hex}")
    spark.sparkContext.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(folder: str | None, name: str, key: object, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` written as Parquet under ``folder``, or read from there if the same key was written before.

    The key names everything the result depends on. Only a stage that was
    finished counts; without a folder the result is a checkpoint of this run.
    """
    if folder is None:
        return checkpoint(make())
    spark = SparkSession.active()
    path = f"{folder.rstrip('/')}/{name}-{hashlib.sha256(repr(key).encode()).hexdigest()[:32]}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, for rows that are few bytes but costly to process in Python.

    Adaptive execution joins small shuffle partitions by their bytes; a
    repartition by number is left as it is.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def fan_out(scanned: DataFrame) -> DataFrame:
    """A scan whose rows multiply: over all cores if its files make fewer partitions than there are cores, else as it is.

    Only for plans without a shuffle, whose number of partitions is known before they run.
    """
    cores = scanned.sparkSession.sparkContext.defaultParallelism
    return scanned.repartition(cores) if scanned._jdf.queryExecution().toRdd().getNumPartitions() < cores else scanned
