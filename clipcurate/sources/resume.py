"""Ingest in batches that a second run takes up where the first one stopped: a batch's frames are staged, then its ledger commits them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipcurate.sources.ingest import pending

#: What a pull says of an episode; ``error`` is NULL where it went well.
LEDGER = "status string, total_frames long, padded_len long, sql_num_frames long, n_annotations long, error string"


def ledger(spark: SparkSession, path: str, key: str = "episode_hash") -> DataFrame:
    """(key, status, lengths, error, batch) of every committed batch; empty before the first."""
    try:
        return spark.read.parquet(f"{path}/ledger")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{key} string, {LEDGER}, batch long")


def committed(spark: SparkSession, path: str, key: str = "episode_hash") -> DataFrame:
    """The frames that a ledger commits, each once: what a stopped batch has left behind isn't seen."""
    done = ledger(spark, path, key).where("status = 'ok'").select("batch", key)
    return spark.read.parquet(f"{path}/frames").join(done, ["batch", key], "left_semi").drop("batch")


def ingest(
    spark: SparkSession, catalog: DataFrame, pull: Callable[[DataFrame], tuple[DataFrame, DataFrame]], path: str, key: str = "episode_hash", batches: int = 8,
    before_commit: Callable[[int], None] | None = None,
) -> DataFrame:
    """Take what ``catalog`` has and no ledger calls ``ok``, in ``batches`` by a hash of the key; returns the ledger.

    ``pull`` gets a batch of the catalog and returns its frames, with ``key``, and a log of the columns of ``LEDGER``, a row an
    episode. A batch's frames are written to a folder of its number, which replaces that folder alone if it is there
    (dynamic overwrite), and then its log, which commits it. A batch's number is one more than the largest committed one,
    so the run after a crash writes over the batch that was not committed, and nothing is ever there twice. Episodes that
    failed are pending again. ``before_commit`` is called between the two writes (tests stop there).
    """
    for bucket in range(batches):
        known = ledger(spark, path, key)
        number = (known.agg(F.max("batch")).first()[0] or 0) + 1
        own = catalog.where(F.pmod(F.xxhash64(key), F.lit(batches)) == bucket)
        todo = pending(own, known.where("status = 'ok'").withColumn(key, F.col(key).cast(catalog.schema[key].dataType)), key)
        if todo.isEmpty():
            continue
        frames, log = pull(todo)
        write = lambda df, name, n=number: df.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{name}")
        write(frames, "frames")
        if before_commit is not None:
            before_commit(number)
        write(log, "ledger")
    return ledger(spark, path, key)


def run_log(catalog: DataFrame, before: DataFrame, after: DataFrame, key: str = "episode_hash") -> DataFrame:
    """(key, status) of a run, by the ledgers before and after it: ``cached`` if it was done before, else what this run says last;
    NULL for what it didn't get to."""
    cached = before.where("status = 'ok'").select(F.col(key).alias("__key"), F.lit("cached").alias("__status"))
    latest = after.groupBy(F.col(key).alias("__key")).agg(F.max_by("status", "batch").alias("__status"))
    new = latest.join(cached.select("__key"), "__key", "left_anti")
    return catalog.select(key).join(cached.unionByName(new), F.col(key).cast("string") == F.col("__key").cast("string"), "left").select(key, F.col("__status").alias("status"))
