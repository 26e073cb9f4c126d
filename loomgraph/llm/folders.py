"""The shared folder for checkpoints: the session's own, else (in local sessions, as in tests) a temporary one."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.  Where it is unset, a local session gets one of our
    own; on a cluster, whose machines share no such folder, that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints_"))
    return sc.getCheckpointDir()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file, in whatever store it is."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there; its lineage ends."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of our own, in whatever store it is."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
