"""Reading the catalog and frames, trimming, and what the ingest ledger says."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_catalog(spark: SparkSession, source: str, jdbc: dict[str, str] | None = None, key: str | None = None, parts: int = 16, prefix: int = 2) -> DataFrame:
    """The episode table: a Parquet folder, or a database table if ``jdbc`` has the reader's options. With a text ``key`` that is
    read in up to ``parts`` ranges at a time (see ``key_ranges``)."""
    if jdbc is None:
        return spark.read.parquet(source)
    if key is None:
        return spark.read.format("jdbc").options(dbtable=source, **jdbc).load()
    options = {k: v for k, v in jdbc.items() if k != "url"}
    return spark.read.jdbc(jdbc["url"], source, predicates=key_ranges(spark, source, jdbc, key, parts, prefix), properties=options)


def key_ranges(spark: SparkSession, source: str, jdbc: dict[str, str], key: str, parts: int = 16, prefix: int = 2) -> list[str]:
    """Predicates that cut a database table into at most ``parts`` ranges of a text key, of about as many rows each.

    Spark can split a read by numbers and dates only. So the database is asked how many rows begin with each ``prefix``
    characters, and ranges begin where that is a share of all. Each bound is compared as the database compares texts, and
    every row fits exactly one predicate, those without a key the first.
    """
    counts = f"(SELECT {_start(key, prefix)} AS START_, COUNT(*) AS ROWS_ FROM {source} WHERE {key} IS NOT NULL GROUP BY {_start(key, prefix)}) counts_"
    found = spark.read.format("jdbc").options(dbtable=counts, **jdbc).load().toDF("start", "rows")
    w = Window.orderBy("start")
    total = F.sum("rows").over(Window.partitionBy())
    upto = F.coalesce(F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = found.select("start", F.floor(upto * parts / total).alias("part"))
    bounds = [row["start"] for row in share.groupBy("part").agg(F.min("start").alias("start")).orderBy("start").collect()][1:]  # fewer than parts
    text = ["'" + b.replace("'", "''") + "'" for b in bounds]
    if not text:
        return ["1 = 1"]
    middle = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(text[:-1], text[1:], strict=True)]
    return [f"{key} < {text[0]} OR {key} IS NULL", *middle, f"{key} >= {text[-1]}"]


def _start(key: str, prefix: int) -> str:
    return f"SUBSTR({key}, 1, {prefix})"


def read_frames(spark: SparkSession, source: str | DataFrame, columns: list[str], lab: str | None = None, lab_column: str = "lab") -> DataFrame:
    """Only the wanted tracks of a Parquet folder or of a table (see ``lay_out_frames``), and of one lab if that is asked for: both
    reach the scan."""
    frames = source if isinstance(source, DataFrame) else spark.read.parquet(source)
    return (frames if lab is None else frames.where(F.col(lab_column) == lab)).select(*columns)


def lay_out_frames(frames: DataFrame, name: str, path: str, lab: str = "lab", episode: str = "episode_hash", order: str = "frame_idx", buckets: int = 200, then: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Write frames once as the table ``name`` at ``path``: a folder a lab, and in it ``buckets`` files by a hash of the episode,
    each sorted by episode and frame. Windows and groupings by episode over ``spark.table(name)`` exchange no frames, and a
    lab's filter reads its folder alone. A null lab has a folder; frames without an episode are of one bucket. ``then`` makes
    the frames' wide columns of the given ones when rows are where they will be written, so that only what they are made of
    is exchanged; it keeps lab, episode and order."""
    dealt = frames.repartition(buckets, episode)
    wide = dealt if then is None else then(dealt)
    writer = wide.write.option("compression", "zstd").partitionBy(lab).bucketBy(buckets, episode).sortBy(episode, order)
    writer.option("path", path).mode("overwrite").saveAsTable(name)


def trim_padding(frames: DataFrame, attrs: DataFrame, key: str = "episode_hash") -> DataFrame:
    """Frames before ``total_frames``; 0 or NULL keeps all."""
    known = attrs.select(key, F.col("total_frames").alias("__total"))
    out = frames.join(known, key, "left")
    return out.where((F.coalesce("__total", F.lit(0)) <= 0) | (F.col("frame_idx") < F.col("__total"))).drop("__total")


def pending(catalog: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return catalog.join(done.select(key), key, "left_anti")


def having(catalog: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return catalog.join(done.select(key), key, "left_semi")


def ingest_report(log: DataFrame) -> DataFrame:
    """Per status: episodes, stored length unlike the catalog's, annotated, padded."""
    differs = F.col("total_frames").isNotNull() & F.col("sql_num_frames").isNotNull() & (F.col("total_frames") != F.col("sql_num_frames"))
    return log.groupBy("status").agg(
        F.count(F.lit(1)).alias("episodes"), F.count_if(differs).alias("length_differs"), F.count_if(F.coalesce("n_annotations", F.lit(0)) > 0).alias("annotated"),
        F.count_if(F.col("padded_len") > F.col("total_frames")).alias("padded"),
    )


def storage_by_array(listing: DataFrame, key: str = "key", size: str = "size", episode: str = "episode", prefix: str | None = None) -> DataFrame:
    """(array, episodes, bytes, mean_bytes, is_image): the first part of a key, after the row's ``prefix`` if there is such a
    column, names the array."""
    name = F.col(key) if prefix is None else F.when(F.startswith(key, prefix), F.substring(F.col(key), F.length(prefix) + 1, F.length(key))).otherwise(F.col(key))
    array = F.substring_index(F.ltrim(name, F.lit("/")), "/", 1)
    out = listing.groupBy(array.alias("array")).agg(F.countDistinct(episode).alias("episodes"), F.sum(size).alias("bytes"), (F.sum(size) / F.countDistinct(episode)).alias("mean_bytes"))
    return out.withColumn("is_image", F.col("array").startswith("images"))


def storage_projection(by_array: DataFrame, episodes_seen: int, episodes: int) -> DataFrame:
    """(is_image, bytes, projected_bytes): images against the rest, and what ``episodes`` would take at the mean of those seen."""
    return by_array.groupBy("is_image").agg(F.sum("bytes").alias("bytes")).withColumn("projected_bytes", F.col("bytes") / episodes_seen * episodes)


def join_meta(features: DataFrame, catalog: DataFrame, columns: list[str], key: str = "episode_hash") -> DataFrame:
    """``features`` with catalog columns; an episode that the catalog lacks keeps NULLs. A key that it has twice counts once."""
    return features.join(catalog.select(key, *columns).dropDuplicates([key]), key, "left")


def has_annotations(log: DataFrame, key: str = "episode_hash") -> DataFrame:
    return log.select(key, (F.coalesce("n_annotations", F.lit(0)) > 0).cast("int").alias("has_annotations"))


def live(catalog: DataFrame, flag: str = "is_deleted") -> DataFrame:
    """Rows not marked deleted; NULL, or no such column, counts as live."""
    return catalog.where(~F.coalesce(F.col(flag), F.lit(False))) if flag in catalog.columns else catalog


def slice_catalog(catalog: DataFrame, path: str | None = None, **equal: str) -> DataFrame:
    """Rows with the given values, and with a path that is not blank."""
    out = catalog
    for c, v in equal.items():
        out = out.where(F.col(c) == v)
    return out if path is None else out.where(F.trim(F.coalesce(F.col(path), F.lit(""))) != "")


def attr_constancy(attrs: DataFrame, json: str, path: str = "$", n: int = 5, expected: list | float | None = None, leaf: str | None = None, atol: float = 1e-6) -> DataFrame:
    """(value, episodes, is_constant[, matches]): the n commonest values at a path of a JSON attribute, ties by value.

    Values are compared as JSON, not as text: ``value`` is written from the parsed variant, with sorted keys and no spaces.
    What doesn't parse is the value ``ERROR`` and constant of nothing; a path that isn't there, and NULL, don't count.
    ``matches``: the number, vector or matrix at ``leaf``, a path within the value, has ``expected`` as its first rows and
    columns, within atol + 1e-5 * |expected|; text, NULL or anything of another shape doesn't match.
    """
    parsed, given = F.try_parse_json(json), F.col(json).isNotNull()
    at = F.try_variant_get(parsed, path, "variant")
    value = F.when(given & parsed.isNull(), F.lit("ERROR")).otherwise(F.to_json(at))
    seen = attrs.select(value.alias("value")).where("value is not null and value <> 'null'").groupBy("value").agg(F.count(F.lit(1)).alias("episodes"))
    kinds = F.broadcast(seen.agg(((F.count(F.lit(1)) == 1) & (F.max("value") != "ERROR")).alias("is_constant")))
    out = seen.orderBy(F.desc("episodes"), "value").limit(n).join(kinds, how="cross")
    if expected is None:
        return out
    found = F.try_parse_json("value")

    def near(place: str, want: float) -> Column:
        kind, number = F.schema_of_variant(F.try_variant_get(found, place, "variant")), F.try_variant_get(found, place, "double")
        ok = (kind != "STRING") & (F.abs(number - want) <= atol + 1e-5 * abs(want))
        return F.coalesce(ok, F.lit(False))

    def leaves(place: str, want: list | float) -> list[Column]:
        return [c for i, x in enumerate(want) for c in leaves(f"{place}[{i}]", x)] if isinstance(want, list) else [near(place, float(want))]

    return out.withColumn("matches", reduce(lambda a, b: a & b, leaves(leaf or "$", expected)))


def evenly_spaced(total: Column, n: int, low: float = 0.08, high: float = 0.92) -> Column:
    """Array of n frame numbers, evenly spaced over the middle of an episode."""
    a, b = F.floor(total * low), F.floor(total * high)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(a + (b - a) * i / max(1, n - 1)).cast("int"))


def fixed_frames(total: Column) -> Column:
    """Array of the frames at a quarter, the middle and three quarters of an episode."""
    return F.array(*[F.floor(total * x).cast("int") for x in (0.25, 0.5, 0.75)])


def sampled_frames(frames: DataFrame, attrs: DataFrame, picks: Column, key: str = "episode_hash") -> DataFrame:
    """The frames at the places that ``picks``, an array over ``attrs``, names; ``pick`` numbers them from 0."""
    places = attrs.select(key, F.posexplode(picks).alias("pick", "frame_idx"))
    return frames.join(places, [key, "frame_idx"])
