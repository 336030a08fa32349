"""Tables written to the shared folder of a session, to be read more than once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder's path below spark.checkpoint.dir; where none is set, in a temporary folder, on one machine only."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        shared = tempfile.mkdtemp(prefix="termloom-")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/termloom-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows, written once and read again: what follows doesn't work them out anew, and survives lost executors."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
