"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipcurate.llm.common import materialize, sorted_groups

#: Words: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Sources, by code point and null last, weigh ``weights`` in turn. They share the sum of all sizes by weight; a target
    stops at ``most`` times its source's size, and what is left over is shared again by weight until none is above.
    Where that ends, all open sources stand at one level per weight. With sources sorted by cap per weight, the level that
    is left if the first k are capped rises with k until none of the others is above its cap, and falls from there: it is
    the largest. One row a source goes through the windows.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    t = totals.withColumn("w", w).withColumn("cap", most * F.col("source_size").cast("double"))
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("w"), F.col("source").isNull(), F.col("source"))
    all_ = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("capped", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("open_w", F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(all_) - F.col("capped")) / F.col("open_w"))
    t = t.withColumn("level", F.max("level").over(all_))
    return t.select("source", "source_size", F.least(F.col("level") * F.col("w"), F.col("cap")).alias("target"))


def pivot(rows: list[tuple[float, float, float]]) -> tuple[list[int], int | None, float]:
    """Round the probabilities of ``(size, p, u)`` to 0 or 1, in order, keeping sum(size * p); u are uniform draws.
    With the large sizes first, the row that is left open at the end is a small one as a rule.

    One row is open at a time. It and the next exchange size * p in the direction that the draw picks, with odds that
    keep both expectations, until one of them is 0 or 1; the other stays open. Returns the decisions (0 for the open
    row), the open row and its p.
    """
    taken = [0] * len(rows)
    at, p = None, 0.0
    for k, (size, q, u) in enumerate(rows):
        if q <= 0 or q >= 1 or size <= 0:
            taken[k] = int(q >= 1)
            continue
        if at is None:
            at, p = k, q
            continue
        a = rows[at][0]
        up, down = min(a * (1 - p), size * q), min(a * p, size * (1 - q))  # moved to the open row, or from it
        move = up if u * (up + down) < down else -down
        p, q = p + move / a, q - move / size
        for row, x in ((at, p), (k, q)):
            if x >= 1 - 1e-12:
                taken[row] = 1
        open_p, open_q = 1e-12 < p < 1 - 1e-12, 1e-12 < q < 1 - 1e-12
        if open_p and open_q:  # rounding error only: close the one that is nearer to an end
            taken[at], open_p = int(p > 0.5), False
        at, p = (at, p) if open_p else (k, q) if open_q else (None, 0.0)
    return taken, at, p


ROUNDED = "rid long, node long, source_key long, size long, more int, p double, open boolean"


def _round_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (source_key, node): pivot each such group. ``more`` is the decision; ``p`` stays where a row is open."""
    for g in sorted_groups(batches, ["source_key", "node"]):
        taken, at, p = pivot(list(zip(*(g.column(c).to_pylist() for c in ("size", "p", "u")), strict=True)))
        ps, open_ = [0.0] * len(taken), [False] * len(taken)
        if at is not None:
            ps[at], open_[at] = p, True
        same = [g.column(c).chunk(0) for c in ("rid", "node", "source_key", "size")]
        yield pa.record_batch([*same, pa.array(taken, pa.int32()), pa.array(ps), pa.array(open_)], names=["rid", "node", "source_key", "size", "more", "p", "open"])


def _with_turns(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` with ``turn``: 0, but for rows that agree in id, source and size with over ``most`` others their number among
    these. Each task's rows are numbered apart, and the counts of the tasks before are added."""
    key = ["doc_id", "source", "size"]
    hot = materialize(rows.groupBy(*key).count().where(F.col("count") > most).drop("count"), "hot")  # few: each has many rows
    if hot.isEmpty():
        return rows.withColumn("turn", F.lit(0).cast("long"))
    other = hot.select(*[F.col(c).alias(f"__{c}") for c in key])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]
    of = rows.withColumn("task", F.shiftright("rid", 33))
    many = of.join(other, same, "left_semi")
    counts = many.groupBy(*key, "task").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(*key).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(c).alias(f"__{c}") for c in key], F.col("task").alias("__task"), before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*key, "task").orderBy("rid")) - 1
    numbered = many.withColumn("inside", inside).join(starts, [*same, F.col("task") == F.col("__task")]).select(*rows.columns, (F.col("inside") + F.col("__before")).cast("long").alias("turn"))
    return rows.join(other, same, "left_anti").withColumn("turn", F.lit(0).cast("long")).unionByName(numbered)


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 29, leaf_rows: int = 512, fan_in: int = 16) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies)`` for each row of ``docs``: how often the mix takes it.

    Size: words of the text (null: 0). A row is wanted target / source_size times (at most ``most``). The whole part is
    taken; the fraction is rounded by pivotal dependent rounding that keeps each source's sum of size * fraction: rows are
    dealt by a seeded hash to their source's leaves, of about ``leaf_rows``, and rounded there; the one row that a leaf
    leaves open meets those of the next leaves, ``fan_in`` to a node, and so on up a reduction tree. The last open row of
    a source is rounded by its probability. So a source comes within one document's size of its target.

    A source of any size is spread over many leaves, and so are rows that agree in id, source and size, if there are more of
    them than a leaf has. Leaves and draws come from hashes of these three and of the number among such rows, so that
    reruns agree; repeated rows are interchangeable. Empty and null texts are taken 0 times. A null source is a source of
    its own, the last. Empty table: no rows. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    rows = materialize(_with_turns(materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "sizes"), leaf_rows), "turns")
    totals = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), "totals")
    leaves = F.ceil(F.col("rows") / leaf_rows).cast("long").alias("leaves")
    targets = source_targets(totals.drop("rows"), weights, most).withColumnRenamed("source", "__of")
    targets = materialize(targets.join(totals.select(F.col("source").alias("__source"), leaves), F.col("__of").eqNullSafe(F.col("__source"))).drop("__of"), "targets")
    most_leaves = targets.agg(F.max("leaves")).first()[0] or 1
    draw = lambda tag: F.xxhash64(F.lit(seed), F.lit(tag), F.col("doc_id"), F.col("source"), F.col("size"), F.col("turn"))
    uniform = lambda c: F.pmod(c, F.lit(1 << 40)) / float(1 << 40)
    known = rows.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    wanted = F.when(F.col("size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    known = known.withColumn("whole", F.floor(wanted + 1e-12).cast("int")).withColumn("p", F.greatest(F.lit(0.0), wanted - F.col("whole")))
    known = known.withColumn("node", F.pmod(draw("leaf"), F.col("leaves"))).withColumn("source_key", F.xxhash64("source")).withColumn("order", draw("order"))
    open_ = known.where("p > 0").select("rid", "node", "source_key", "size", "p", "order", uniform(draw("u0")).alias("u"))
    decided, level = None, 0
    while True:
        dealt = open_.repartition("source_key", "node").sortWithinPartitions("source_key", "node", F.desc("size"), "order")
        done = materialize(dealt.mapInArrow(_round_groups, ROUNDED), "rounded")
        last = most_leaves == 1
        closed = done if last else done.where("not open")
        u = uniform(F.xxhash64(F.lit(seed), F.lit(f"end{level}"), "source_key"))
        more = F.when(F.col("open"), (u < F.col("p")).cast("int")).otherwise(F.col("more"))
        closed = closed.select("rid", more.alias("more")).where("more > 0")
        decided = closed if decided is None else decided.unionByName(closed)
        if last:
            break
        level += 1
        most_leaves = -(-most_leaves // fan_in)
        key = [F.col(c) for c in ("node", "source_key", "size")]
        open_ = done.where("open").select(
            "rid", F.floor(F.col("node") / fan_in).alias("node"), "source_key", "size", "p", F.xxhash64(F.lit(seed + level), *key).alias("order"), uniform(F.xxhash64(F.lit(seed - level), *key)).alias("u")
        )
    out = known.join(materialize(decided, "decided"), "rid", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.coalesce("more", F.lit(0))).cast("int").alias("copies"), "rid")


def take_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of the mix: each row of ``docs``, all columns, as often as mix_sources says.

    Rows that agree in id, source and size share the sum of their copies, one more or less each. ``copies`` has as many
    rows as the mix has documents, so both sides are exchanged at every size.
    """
    mixed = mix_sources(docs, doc_id, text, source, **how)
    keys = [F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size")]
    counts = materialize(mixed.groupBy(*keys).agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__n")).where("__copies > 0"), "copies")
    sized = docs.select(F.struct(*docs.columns).alias("__row"), word_count(F.col(text)).alias("__words"))
    own = F.col("__row")
    out = sized.join(counts.hint("merge"), own[doc_id].eqNullSafe(F.col("__id")) & own[source].eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size")))
    repeat = lambda df, n: df.withColumn("__turn", F.explode(F.sequence(F.lit(1), n.cast("int")))).select("__row.*")
    if counts.where("__n > 1").isEmpty():
        return repeat(out, F.col("__copies"))
    turn = F.row_number().over(Window.partitionBy("__id", "__source", "__size").orderBy(own[text]))
    each = F.floor(F.col("__copies") / F.col("__n")) + (turn <= F.col("__copies") % F.col("__n")).cast("int")
    again = out.where("__n > 1").withColumn("__each", each).where("__each > 0")
    return repeat(out.where("__n = 1"), F.col("__copies")).unionByName(repeat(again, F.col("__each")))
