"""Profiles of a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipcurate.functions.numbers import number
from clipcurate.sources.store import settled


def running_sums(df: DataFrame, by: list[str], order: str, weight: str) -> DataFrame:
    """``df`` with ``before``, the sum of ``weight`` over a group's rows of a smaller ``order``, and ``total``, over all of the
    group. (by, order) names a row. Rows are dealt by range of both, summed there, and the sums of a group's ranges
    before, at most as many as there are partitions, are added; so no task needs a whole group."""
    dealt = settled(df.repartitionByRange(*by, order).withColumn("__range", F.spark_partition_id()))
    w = Window.partitionBy(*by)
    sums = dealt.groupBy(*by, "__range").agg(F.sum(weight).alias("__sum"))
    earlier = F.coalesce(F.sum("__sum").over(w.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__range").alias("__of"), earlier.alias("__start"), F.sum("__sum").over(w).alias("total"))
    inside = F.coalesce(F.sum(weight).over(Window.partitionBy(*by, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    on = [F.col("__range") == F.col("__of"), *(F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by)]
    out = dealt.withColumn("__inside", inside).join(starts, on)
    return out.withColumn("before", F.col("__inside") + F.col("__start")).drop("__range", "__of", "__start", "__inside", *[f"__{c}" for c in by])


def exact_percentiles(df: DataFrame, by: list[str], col: str, points: dict[str, float]) -> DataFrame:
    """(by, a column for each point): percentiles with linear interpolation, as numpy's, NULL and NaN skipped. Values are counted
    first; the two that a point lies between are found by running sums of the counts, so no task holds a group's values."""
    value = number(F.col(col))
    counts = df.select(*by, value.alias("__v")).where("__v is not null").groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__n"))
    ranked = running_sums(counts, by, "__v", "__n")
    at = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("__n")), F.col("__v")))
    ends = []
    for name, p in points.items():
        place = F.lit(float(p)) * (F.col("total") - 1)
        ends += [at(F.floor(place)).alias(f"__lo_{name}"), at(F.ceil(place)).alias(f"__hi_{name}"), F.max(place - F.floor(place)).alias(f"__part_{name}")]
    found = ranked.groupBy(*by).agg(*ends)
    return found.select(*by, *[(F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__part_{n}")).alias(n) for n in points])


def value_counts(df: DataFrame, cols: list[str], n: int) -> DataFrame:
    """(column, value, rows, n_distinct): the n commonest values of each column, NULL left out, ties by value."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("x")
    seen = df.select(each).select("x.*").where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))
    seen = settled(seen)
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("rows"), "value"))
    top = seen.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")  # each partition sends its own n at most
    distinct = seen.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    return top.join(distinct, "column").select("column", "value", "rows", "n_distinct")


def describe(df: DataFrame, cols: list[str], points: tuple[float, ...] = (0.25, 0.5, 0.75), by: tuple[str, ...] = ()) -> DataFrame:
    """(by, metric, count, mean, std, min, p*, max), NaN skipped; std is the sample's."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), number(F.col(c)).alias("v")) for c in cols])).alias("x")
    long_ = df.select(*by, each).select(*by, "x.*")
    stats = [F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")]
    keys = [*by, "metric"]
    names = {f"p{round(100 * p)}": p for p in points}
    ranks = exact_percentiles(long_, keys, "v", names).select(*[F.col(c).alias(f"__{c}") for c in keys], *names)
    out = long_.groupBy(*keys).agg(*stats).join(ranks, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys], "left")
    return out.select(*keys, "count", "mean", "std", "min", *names, "max")


def length_sanity(catalog: DataFrame, low: int = 30, high: int = 3000, col: str = "num_frames") -> DataFrame:
    """One row: unset lengths (negative), lengths over ``high``, under ``low``, and the ten smallest distinct odd ones."""
    counts = catalog.agg(F.count_if(F.col(col) < 0).alias("unset"), F.count_if(F.col(col) > high).alias("too_long"), F.count_if(F.col(col).between(0, low - 1)).alias("too_short"))
    odd = catalog.where((F.col(col) < low) | (F.col(col) > high)).select(col).distinct().orderBy(col).limit(10)
    return counts.join(F.broadcast(odd.agg(F.array_sort(F.collect_list(col)).alias("odd"))), how="cross")  # one row each


def lab_structure(catalog: DataFrame, path: str | None = None) -> DataFrame:
    """Per lab, the largest first: episodes, operators, scenes, median length, and how many have a ``path`` that isn't blank."""
    with_path = [] if path is None else [F.count_if(F.trim(F.coalesce(F.col(path), F.lit(""))) != "").alias("with_path")]
    return catalog.groupBy("lab").agg(F.count(F.lit(1)).alias("episodes"), F.countDistinct("operator").alias("operators"), F.countDistinct("scene").alias("scenes"), F.floor(F.median("num_frames")).cast("long").alias("median_frames"), *with_path).orderBy(F.desc("episodes"), "lab")


def grid_occupancy(catalog: DataFrame, by: str = "lab") -> DataFrame:
    """Share of a group's operator x scene cells that have an episode; rows with a NULL in either are left out."""
    both = catalog.where("operator is not null and scene is not null")
    cells, full = F.countDistinct("operator", "scene"), F.countDistinct("operator") * F.countDistinct("scene")
    return both.groupBy(by).agg(cells.alias("cells"), full.alias("possible"), (cells / full).alias("occupancy"))


def per_key_load(catalog: DataFrame, key: str = "operator", by: str = "lab") -> DataFrame:
    """Per group: fewest, median and most episodes of a key."""
    load = catalog.where(F.col(key).isNotNull()).groupBy(by, key).agg(F.count(F.lit(1)).alias("n"))
    return load.groupBy(by).agg(F.min("n").alias("fewest"), F.median("n").alias("middle"), F.max("n").alias("most"))


def first_values(catalog: DataFrame, col: str = "scene", n: int = 15) -> DataFrame:
    """The first ``n`` distinct values in sorted order."""
    return catalog.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col).limit(n)


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """(bin, rows): equal widths from the smallest to the largest value, the last bin closed; empty bins are left out."""
    ends = F.broadcast(df.agg(F.min(col).alias("__low"), F.max(col).alias("__high")))
    place = F.floor((F.col(col) - F.col("__low")) / (F.col("__high") - F.col("__low")) * bins)
    at = F.when(F.col("__high") == F.col("__low"), F.lit(0)).otherwise(F.least(place, F.lit(bins - 1))).cast("int")
    return df.where(F.col(col).isNotNull()).join(ends, how="cross").groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


def ordinal_codes(df: DataFrame, col: str) -> DataFrame:
    """(value, code): sorted distinct values, NULL as '', numbered from 0."""
    seen = df.select(F.coalesce(F.col(col).cast("string"), F.lit("")).alias("value")).distinct()
    return running_sums(seen.withColumn("__one", F.lit(1).cast("long")), [], "value", "__one").select("value", F.col("before").alias("code"))
