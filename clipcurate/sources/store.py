"""Tables between jobs, and what is written for readers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new place in the folder of spark.checkpoint.dir. Only where that is unset, with a local master, as in tests, a local
    folder is taken."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(path)
    return f"{path.rstrip('/')}/clipcurate/{uuid.uuid4().hex}"


def settled(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` computed once, written as Parquet to a new place and read back: its lineage is cut, and lost executors don't change it."""
    path = scratch(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: tuple[str, ...] = ()) -> None:
    """Write features, decisions, audits, results or summaries as ``parquet``, ``json`` or ``csv`` (with a header), in folders
    by the columns ``by``; what is there is replaced."""
    writer = df.write.mode("overwrite").partitionBy(*by)
    writer = writer.option("header", True) if kind == "csv" else writer
    writer.format(kind).save(path)
