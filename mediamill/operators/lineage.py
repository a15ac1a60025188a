"""Results kept in the folder that all executors share, so that later steps neither repeat nor plan them again; rows dealt to all cores."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """The rows from a reliable checkpoint in ``spark.checkpoint.dir``; where that is unset, in local mode only, in a folder of its own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="kept-"))
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt evenly (or by keys) to all cores before dear expressions: a file of short repeated values has few splits for its rows."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
