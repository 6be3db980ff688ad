"""The driver's tables in the shapes that the operators read. Stand-ins of raw columns; nothing here is motion data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Points of a hand in ``frames``.
POINTS = 4


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as what frames are made of: a supplier is an episode, its nation the lab, its lines in order of shipping the
    frames."""
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    own = _read(spark, sf_dir, "lineitem").withColumn("frame_idx", F.row_number().over(w) - 1)
    own = own.select(F.col("l_suppkey").alias("episode_hash"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", "frame_idx")
    return own.join(_labs(spark, sf_dir), "episode_hash")


def _labs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("episode_hash"), F.concat(F.lit("lab"), (F.col("s_nationkey") % 3).cast("string")).alias("lab"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lines`` with the frames' tracks and keypoints."""
    return tracks(lines(spark, sf_dir))


def tracks(lines: DataFrame) -> DataFrame:
    q, e, d, t = F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_discount") * 100, F.col("l_tax") * 100
    one = F.lit(1.0)
    points = lambda x, y, z: F.array(x, y, z, x + 1, y + z, z, x, y - 2, z + d, x / 2, y, z - 3)
    return lines.select(
        "episode_hash", F.array(q, e, d, q / 50, d / 10, t / 8, one).alias("left_ee"), F.array(t, q, d, t / 8, q / 50, d / 10, one).alias("right_ee"),
        F.array(q / 10, t, d, t / 8, d / 10, q / 50, one).alias("head"), points(q, d, t - 5).alias("left_kp"), points(t, d, q - 30).alias("right_kp"), "frame_idx", "lab",
    )


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The episodes of ``frames``: the nation is the operator, an eighth of the ids a scene."""
    s = _read(spark, sf_dir, "supplier")
    lab = F.concat(F.lit("lab"), (F.col("s_nationkey") % 3).cast("string"))
    return s.select(F.col("s_suppkey").alias("episode_hash"), lab.alias("lab"), F.concat(F.lit("o"), F.col("s_nationkey").cast("string")).alias("operator"), F.concat(F.lit("s"), (F.col("s_suppkey") % 8).cast("string")).alias("scene"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a catalog of clips: language is the lab, source the operator, a 16th of the ids a scene."""
    d = _read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("episode_hash"), F.col("lang").alias("lab"), F.col("source").alias("operator"), (F.col("doc_id") % 16).cast("string").alias("scene"), F.col("n_chars").cast("double").alias("num_frames"), (F.col("n_chars") / 30.0).alias("duration_s"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as results of runs: user is the seed, event type the condition, mean value the error."""
    e = _read(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("seed"), F.col("event_type").alias("condition")).agg(F.avg("value").alias("mse"), F.count(F.lit(1)).alias("n_train_win"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("episode_hash"), F.transform("embedding", lambda x: x.cast("double")).alias("z"), F.col("label").alias("pool"))
