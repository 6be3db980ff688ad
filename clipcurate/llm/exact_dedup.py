"""Exact duplicates by deterministic block naming, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipcurate.llm.common import ascii_lower, free_name, materialize


def normal_text(text: Column) -> Column:
    """The text in UTF-8, A-Z lower-cased; null counts as empty. Where all letters are ASCII, ``lower`` does that, and faster."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(ascii_lower(t)).cast("binary")


def _numbered(items: DataFrame, order: list[str], near: Column, weight: str) -> DataFrame:
    """``items`` with ``name``: the sum of ``weight`` of all items before them in the order of ``near``, a long, and then
    ``order``. Each of 4096 ranges of ``near`` is sorted by a task; the sums of the ranges before are added."""
    ranged = items.withColumn("range", F.shiftright(near, 52).cast("int"))
    sums = ranged.groupBy("range").agg(F.sum(weight).alias("in_range"))
    before = F.sum("in_range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # 4096 rows at most
    inside = F.sum(weight).over(Window.partitionBy("range").orderBy(near, *order).rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(sums.select("range", F.coalesce(before, F.lit(0)).alias("start")))
    placed = ranged.withColumn("name", F.coalesce(inside, F.lit(0))).join(starts, "range")
    return placed.withColumn("name", F.col("name") + F.col("start")).drop("range", "start")


def name_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = 16384, hash_fn=F.xxhash64) -> DataFrame:
    """``(rid, doc_id, text_sha256, blocks, root)``, one row per input row.

    ``(blocks, root)`` is the identity: equal for two rows exactly when their normalised texts are equal. The text is cut
    into blocks of ``block`` bytes. All distinct blocks are sorted, by hash and then by content, and a block's name is
    its number in that order. Then distinct pairs of adjacent names are sorted and numbered in turn (an odd last name
    is paired with none), level by level, until a document has one name. Names are numbers in a sorted list of contents,
    so no two contents share one; texts of a different number of blocks differ by that number.

    Text moves once, distinct blocks only; from then on rows are integers, and only documents of several blocks go on.
    """
    t = F.col("t")
    count = F.ceil(F.octet_length(t) / block)
    several = F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: F.substring(t, i * block + 1, F.lit(block)))
    cut = docs.select(F.col(doc_id).alias("doc_id"), normal_text(F.col(text)).alias("t"))
    cut = cut.select("doc_id", F.sha2("t", 256).alias("text_sha256"), F.when(count <= 1, F.array("t")).otherwise(several).alias("parts"))
    flat = cut.select(F.explode("parts").alias("content")).select(hash_fn("content").alias("h"), "content")
    hashes = materialize(flat.distinct().groupBy("h").agg(F.count(F.lit(1)).alias("k")), "hashes")
    shared, places = hashes.where("k > 1").select("h"), None
    rid = F.monotonically_increasing_id()
    if not shared.isEmpty():  # hashes of several contents: these are numbered within their hash, by content
        cut = materialize(cut.withColumn("rid", rid), "cut")
        rid = F.col("rid")
        each = cut.select("rid", F.posexplode("parts").alias("pos", "content")).withColumn("h", hash_fn("content")).join(shared, "h", "left_semi")
        contents = each.select("h", "content").distinct().withColumn("place", F.row_number().over(Window.partitionBy("h").orderBy("content")) - 1)
        places = each.join(contents, ["h", "content"]).select("rid", "pos", "place")
    rows = materialize(cut.select(rid.alias("rid"), "doc_id", "text_sha256", F.size("parts").alias("blocks"), F.transform("parts", lambda b: hash_fn(b)).alias("hs")), "rows")
    names = _numbered(hashes, [], F.col("h"), "k").select("h", "name")
    level = rows.select("rid", "blocks", F.posexplode("hs").alias("pos", "h")).join(names, "h")
    if places is not None:
        level = level.join(places, ["rid", "pos"], "left").withColumn("name", F.col("name") + F.coalesce("place", F.lit(0)))
    level = materialize(level.select("rid", F.col("blocks").alias("n"), "pos", "name"), "level")
    roots = level.where("n = 1").select("rid", "name")
    most = rows.agg(F.max("blocks")).first()[0] or 0
    while most > 1:
        most = -(-most // 2)
        level = materialize(_paired(level.where("n > 1")), "level")
        roots = roots.unionByName(level.where("n = 1").select("rid", "name"))
    return rows.drop("hs").join(roots.withColumnRenamed("name", "root"), "rid")


def _paired(level: DataFrame) -> DataFrame:
    """One level up: names of adjacent pairs in place of the names."""
    half = F.floor(F.col("pos") / 2).cast("int").alias("pos")
    left, right = (F.max(F.when(F.col("pos") % 2 == k, F.col("name"))) for k in (0, 1))
    pairs = level.groupBy("rid", "n", half).agg(left.alias("l"), F.coalesce(right, F.lit(-1)).alias("r"))
    distinct = pairs.select("l", "r").distinct().withColumn("one", F.lit(1).cast("long"))
    names = _numbered(distinct, ["l", "r"], F.xxhash64("l", "r"), "one").select("l", "r", "name")
    return pairs.join(names, ["l", "r"]).select("rid", F.ceil(F.col("n") / 2).cast("int").alias("n"), "pos", "name")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = 16384, hash_fn=F.xxhash64) -> DataFrame:
    """``(rid, doc_id, keep_id, group_size, kept, text_sha256)`` for every row.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest
    doc_id stays; if that row is repeated, one of the repeats does (``rid`` tells rows apart). A null doc_id is smaller than
    any other. Empty table: no rows. Other columns are not read.
    """
    named = materialize(name_documents(docs, doc_id, text, block, hash_fn), "named")
    best = F.max(F.struct("doc_id", "rid"))
    groups = named.groupBy("blocks", "root").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = groups.select("blocks", "root", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"), "group_size")
    groups = materialize(groups, "groups")  # so that the rows of a text that very many share can be split in the join
    out = named.join(groups, ["blocks", "root"], "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "rid", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"), "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns. Rows that agree in id and text are told apart by nothing else, one stays."""
    found = materialize(exact_duplicates(docs, doc_id, text), "dups").select("kept", F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    gone = materialize(found.where("not kept").select("id", "sha").distinct(), "gone")
    repeated = materialize(found.where("kept").select("id", "sha").intersect(gone), "repeated")  # id and text of a row that stays and of one that goes
    own = free_name(docs, "__text")
    keyed = docs.withColumn(own, F.sha2(normal_text(F.col(text)), 256))
    same = lambda other: keyed[doc_id].eqNullSafe(other["id"]) & (keyed[own] == other["sha"])
    gone = gone.hint("merge")  # what goes grows with the input: one plan at every size
    stays = keyed.join(gone, same(gone), "left_anti").drop(own)
    if repeated.isEmpty():
        return stays
    return stays.unionByName(keyed.join(repeated, same(repeated), "left_semi").dropDuplicates([doc_id, own]).drop(own))
