"""SparkSession settings for local runs; on a cluster the submitted configuration wins."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "loomgraph", master: str | None = None, shuffle_partitions: int | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """A session with adaptive execution and UTC; ``master`` defaults to all local cores."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "20g",
        "spark.sql.shuffle.partitions": str(shuffle_partitions or os.cpu_count() or 8),
    } | (extra or {})
    spark = SparkSession.builder.master(master or "local[*]").appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
