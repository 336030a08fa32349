"""What several operators share: reading tables, scratch tables, batches, ASCII lower case."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch; a batch of long texts stays within a Python worker's memory.
ARROW_ROWS = 1000
#: Bytes in one Arrow batch, where Spark has the setting.
ARROW_BYTES = 16 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A document id that stands for null inside an operator; sorts after all others.
NO_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_limits(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def scratch(spark: SparkSession) -> str:
    """A new folder's path in the shared folder of the session, or, on one machine, in a temporary one where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        shared = tempfile.mkdtemp(prefix="termloom-")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/termloom-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes all scratch tables of the shared folder; no result may be read afterwards that isn't stored elsewhere."""
    shared = scratch(spark).rpartition("/")[0]
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in store.globStatus(jvm.org.apache.hadoop.fs.Path(path, "termloom-*")) or ():
        store.delete(found.getPath(), True)


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(df: DataFrame) -> DataFrame:
    """The same rows, below which no later filter moves.

    A filter that moves below a projection takes its columns' expressions
    along, and inside a lambda these would be evaluated for each element.
    Filters don't move below a projection that isn't deterministic.
    """
    return df.withColumn("__held", F.monotonically_increasing_id()).where("__held >= 0").drop("__held")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. lower() does that at once where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
