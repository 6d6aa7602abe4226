"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words of every operator here, as Java and Python patterns.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir, or else the one that the session has set.

    Where there is neither, a temporary one on a local master; on a cluster, whose executors could not see that, an error.
    """
    sc = spark.sparkContext
    if (named := sc.getConf().get("spark.checkpoint.dir")) is None and (named := sc.getCheckpointDir()) is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="plumbline-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Run df once and cut its lineage at files that survive the loss of any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def scratch_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A new folder in the shared one, for tables that nothing needs once the block has ended; removed then."""
    folder = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def rows_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just (doc_id, text), text null as empty, so that no other column of df can clash with an operator's own."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of df as they are, also where a name has a dot or a backtick in it."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the decimal id, modulo parts; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
