"""Shuffling a corpus into shards by a two-pass external shuffle, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipcurate.llm.common import free_name, materialize

#: Starts of buckets are broadcast up to this many (16 bytes each), and joined by an exchange beyond.
BROADCAST_BUCKETS = 500_000
#: Partitions at most that buckets are exchanged by; beyond, a task shuffles several buckets, one after the other.
MAX_PARTITIONS = 10_000


def shuffle_into_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", seed: int = 17, bucket_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` with a struct column ``placement`` (or see ``free_name``): shard, slot and bucket of each row.

    First pass: rows scatter uniformly, by a seeded hash of their key and their place in the input, into buckets of about
    ``bucket_bytes``; a bucket's records are gathered in memory, shuffled there (Fisher-Yates) and written to the shared
    folder. Second pass, without an exchange: where each bucket starts is the sum of the counts of those before it, and from
    there its records are dealt to the shards in turn. So shards differ by one row at most, slots are gapless from 0, and
    a shard's neighbours come from anywhere in the corpus. What is placed is read from the written buckets, so lost
    executors don't change it.

    Every row is placed, nulls, empty texts and repeated rows too; rows of equal or null keys are spread like any other. A
    bucket holds more than ``bucket_bytes`` only by chance, or where one record is that long. Empty table: no rows. Other
    columns are carried along.
    """
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    rid = F.monotonically_increasing_id()
    whole = F.struct(*docs.columns).alias("record")
    rows = docs.select(whole, F.xxhash64(F.lit(seed), F.col(key), rid).alias("draw"))
    rows = rows.withColumn("bucket", F.pmod("draw", F.lit(buckets)).cast("int"))
    rows = rows.repartition(min(buckets, MAX_PARTITIONS), "bucket").sortWithinPartitions("bucket", "draw")
    shuffled = rows.groupBy("bucket").agg(F.shuffle(F.collect_list("record"), seed).alias("records"))
    written = materialize(shuffled.select("bucket", F.posexplode("records").alias("at", "record")), "buckets")
    counts = written.groupBy("bucket").count()
    before = F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))  # one row a bucket
    starts = materialize(counts.select("bucket", F.coalesce(before, F.lit(0)).alias("before")), "starts")
    if buckets <= BROADCAST_BUCKETS:
        starts = F.broadcast(starts)
    place = F.col("before") + F.col("at")
    placement = F.struct((place % shards).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"), F.col("bucket").alias("bucket"))
    return written.join(starts, "bucket").select("record.*", placement.alias(free_name(docs, "placement")))


def write_shards(placed: DataFrame, path: str, placement: str = "placement", rows_per_file: int = 1_000_000) -> None:
    """Write what shuffle_into_shards placed as folders ``shard=0``, 1, ... (``shard_``, if there is such a column). Each task
    writes its own buckets' slots in order, so nothing is exchanged again; ``placement`` is kept, for readers that want the
    slots of several files in one order."""
    shard = free_name(placed, "shard")
    out = placed.withColumn(shard, F.col(placement)["shard"]).sortWithinPartitions(shard, F.col(placement)["slot"])
    out.write.option("maxRecordsPerFile", rows_per_file).partitionBy(shard).parquet(path)


def read_shards(spark, path: str, schema) -> DataFrame:
    """All rows of written shards, with the columns of ``schema`` (that of what was written)."""
    return spark.read.schema(schema).parquet(path)
