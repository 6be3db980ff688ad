"""What several corpus operators share: written tables, connected components, bounded pair blocks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII upper-case letters, for lower-casing that touches nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_tables: dict[str, object] = {}


def worker_tables(owner: str, make: Callable[[], object]) -> object:
    """What tasks of one operator keep in a Python worker, made when the first of them asks. Workers outlive stages, so the
    tables of the operator before are dropped then, and free memory goes back to the system."""
    if owner not in _tables:
        _tables.clear()
        release_memory()
        _tables[owner] = make()
    return _tables[owner]


def release_memory() -> None:
    """Hand memory that earlier tasks of this process have freed back to the system, where its allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt anew where it lies in fewer partitions than there are cores, as a small file of one row group does; rows are
    the same, in no order. Which partitions have rows is asked for without reading a column."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.select(F.spark_partition_id().alias("part")).distinct().count()
    return df if parts >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local one is made for a local
    master (tests); on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        path = tempfile.mkdtemp(prefix="clipcurate-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/clipcurate/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors,
    and fixes the values of anything that would come out differently when computed again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or where ``df`` has such a column, in whatever case, the name with as many underscores as make it new."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``(node, component)`` for every node on an edge; component is the smallest node reachable.

    Labels only fall, by hooking a root onto the smallest label next to its tree and by halving paths, so that a
    chain takes a logarithmic number of rounds. Each round reads tables that the round before has written; both
    sides of the joins on a label or a neighbour are plain exchanges, so a hub's rows can be split at run time.
    Edges with a null end or from a node to itself say nothing. No edges: no rows. Nodes are longs.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    pairs = materialize(e.union(e.select("v", "u")).distinct(), "pairs")
    f = materialize(pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    total = F.sum(F.col("label").cast("decimal(38,0)"))
    before = f.agg(total).first()[0]
    while before is not None:
        g = f.join(f.select(F.col("node").alias("label"), F.col("label").alias("grand")), "label")
        near = pairs.join(g.select(F.col("node").alias("v"), "grand"), "v").groupBy("u").agg(F.min("grand").alias("near"))
        step = g.join(near, g.node == near.u)
        moves = F.array(F.struct(F.col("node"), F.least("grand", "near").alias("label")), F.struct(F.col("label").alias("node"), F.least("grand", "near").alias("label")))
        f = materialize(step.select(F.explode(moves).alias("x")).select("x.*").groupBy("node").agg(F.min("label").alias("label")), "labels")
        now = f.agg(total).first()[0]
        if now == before:
            break
        before = now
    return f.select("node", F.col("label").alias("component"))


def with_components(values: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """``values`` with ``group`` and ``component``: which nodes (its column ``node``, a long for each row) the edges ``(a, b)``
    connect, and the smallest ``label`` of a group; labels may be of any kind, shared or null."""
    comp = connected_components(edges, "a", "b").select(F.col("node").alias("__node"), F.col("component").alias("__comp"))
    joined = values.join(comp, values.node == comp["__node"], "left").drop("__node")
    least = materialize(joined.where("__comp is not null").groupBy(F.col("__comp").alias("__of")).agg(F.min(label).alias("__least")), "least")
    out = joined.join(least, joined["__comp"] == least["__of"], "left")
    return out.select(*values.columns, F.coalesce("__comp", "node").alias("group"), F.coalesce("__least", label).alias("component"))


def pair_blocks(rows: DataFrame, keys: list[str], spread: Column, max_rows: int, keys_only: DataFrame | None = None) -> DataFrame:
    """Lay rows of one key out so that every pair of them meets in exactly one group ``(keys, bi, bj)`` of at most about
    ``2 * max_rows`` rows, however many rows the key has.

    A key with more than ``max_rows`` rows is cut into blocks by ``spread`` (a hash of the row), and each row is sent
    once to each pair of blocks that holds its own; ``block`` says which it is in. Keys of few rows stay whole. The
    partial count of rows by key is all that is gathered to find the large ones; ``keys_only`` has the same keys as ``rows``
    where those are cheaper to come by alone.
    """
    counts = (rows if keys_only is None else keys_only).groupBy(*keys).count()
    large = materialize(counts.where(F.col("count") > max_rows).select(*keys, F.ceil(F.col("count") / max_rows).cast("int").alias("parts")), "large")
    parts = F.coalesce("parts", F.lit(1))
    out = rows.join(large, keys, "left").withColumn("parts", parts).withColumn("block", F.pmod(spread, F.col("parts")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return out.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("parts", "other")


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of a stream of record batches that is sorted by integer ``keys``; only the open group is kept."""
    open_: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        k = np.stack([t.column(c).to_numpy() for c in keys], axis=1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1), len(k)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(k[a])
            if open_ and key != last:
                yield pa.concat_tables(open_).combine_chunks()
                open_ = []
            open_.append(t.slice(a, b - a))
            last = key
    if open_:
        yield pa.concat_tables(open_).combine_chunks()


def spanning_edges(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most n - 1 edges that connect what the pairs (i, j) over 0..n-1 connect: (root, member)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    member = np.flatnonzero(label != np.arange(n))
    return label[member], member
