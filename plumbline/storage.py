"""Where results of a round are written, so that later rounds neither repeat it nor depend on one executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the one that the session has set.

    Where there is neither, a temporary folder serves on a local master; on a cluster, whose executors could not see
    that, it is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="plumbline-rounds-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut at files that survive the loss of any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def rounds(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes a table and reads it again, for rounds that build on each other; all go when the block ends.

    What leaves the block must be durable. Unlike checkpoints, which carry what a plan knows of its columns along, these
    tables begin anew, so that plans do not grow from round to round.
    """
    folder = f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"

    def keep(df: DataFrame) -> DataFrame:
        name = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(name)
        return spark.read.schema(df.schema).parquet(name)

    try:
        yield keep
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
