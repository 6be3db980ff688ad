"""How filters overlap: what each removes in every order, and its labels, from counts by the set of filters a text fails."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipcurate.llm.common import materialize

#: In place of a condition: the text is identical to that of a row with a smaller id.
REPEATS = "repeats"
MEASURES = ("n", "good", "toxic")


def failure_masks(docs: DataFrame, filters: dict[str, Column | str], doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``(doc_id, part, mask, n)``: how many rows fail which filters; bit k of ``mask`` is set where the k-th filter fails them.

    Texts stay where they are; what moves of a row is its id, part, mask and the digest of its text. Rows are counted by these
    first, and the smallest id of a digest is joined on digest and id, so that copies of a text don't meet in a task.
    """
    own = [F.coalesce(c, F.lit(False)).cast("int") * (1 << k) if isinstance(c, Column) else F.lit(0) for k, c in enumerate(filters.values())]
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("digest")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), sum(own).cast("int").alias("mask"), digest)
    rows = materialize(rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n")), "masks")
    repeats = [1 << k for k, c in enumerate(filters.values()) if not isinstance(c, Column)]
    if not repeats:
        return rows.drop("digest")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    found = rows.join(first, ["digest", "doc_id"], "left")
    late = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), F.lit(sum(repeats))).otherwise(0)
    return found.select("doc_id", "part", (F.col("mask") + late).alias("mask"), "n")


def mask_counts(masks: DataFrame, labels: DataFrame, label_id: str = "doc_id", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """``(part, mask, n, good, toxic)``: rows, and those of them whose id any label calls good or toxic (1)."""
    masks = materialize(masks, "failed")
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long"))
    known = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("doc_id")).agg(is_one(good).alias("good"), is_one(toxic).alias("toxic"))
    known = materialize(known.where("good + toxic > 0"), "known")
    marked = masks.join(known, "doc_id").select("part", "mask", F.lit(0).cast("long").alias("n"), (F.col("good") * F.col("n")).alias("good"), (F.col("toxic") * F.col("n")).alias("toxic"))
    plain = masks.select("part", "mask", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return plain.unionByName(marked).groupBy("part", "mask").agg(*[F.sum(m).alias(m) for m in MEASURES])


def subset_zeta(counts: np.ndarray) -> np.ndarray:
    """Over the last axis, of length 2 ** k: at each set the sum over all of its subsets, in k passes."""
    out, k = counts.copy(), counts.shape[-1].bit_length() - 1
    for bit in range(k):
        halves = out.reshape(*out.shape[:-1], -1, 2, 1 << bit)  # without and with that bit
        halves[..., 1, :] += halves[..., 0, :]
    return out


def _survivors(pdf: pd.DataFrame, k: int) -> np.ndarray:
    """(part, measure, set of filters): how many rows none of these filters fails."""
    counts = np.zeros((len(pdf), len(MEASURES), 1 << k), dtype=np.int64)
    for i, found in enumerate(pdf["counts"]):
        for c in found:
            counts[i, :, c["mask"]] = [c[m] for m in MEASURES]
    return subset_zeta(counts)[..., ::-1]  # what fails only filters outside a set; reversal is the complement


def _by_part(counts: DataFrame) -> DataFrame:
    return counts.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("counts"))  # 2 ** k at most


def filter_survivors(counts: DataFrame, names: str) -> DataFrame:
    """``(part, filters, kept, good, toxic)`` for every set of filters, written as its letters in order."""
    k = len(names)
    sets = ["".join(x for b, x in enumerate(names) if s >> b & 1) for s in range(1 << k)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                own = pdf.iloc[at : at + 256]
                left = _survivors(own, k)
                kept, good, toxic = (left[:, m].ravel() for m in range(3))
                yield pd.DataFrame({"part": own["part"].repeat(1 << k).to_numpy(), "filters": sets * len(own), "kept": kept, "good": good, "toxic": toxic})

    return _by_part(counts).mapInPandas(run, "part string, filters string, kept long, good long, toxic long")


def filter_orders(counts: DataFrame, names: str) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)`` of all orders.

    ``counts`` is ``mask_counts``' result, ``names`` one letter a filter. Steps are differences of neighbouring subsets'
    survivors, so texts are read once whatever the number of orders; k filters have k! orders, seven at most are taken.
    """
    k = len(names)
    if not 1 <= k <= 7:
        raise ValueError("one to seven filters: every order is written")
    orders = np.array(list(permutations(range(k))))
    after = np.cumsum(1 << orders, axis=1)
    before, last = after - (1 << orders), (1 << k) - 1
    texts = np.repeat(["".join(names[x] for x in o) for o in orders], k)
    steps = np.tile(np.arange(1, k + 1, dtype=np.int32), factorial(k))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                own = pdf.iloc[at : at + 64]
                left = _survivors(own, k)
                removed, good, toxic = (left[:, m][:, before] - left[:, m][:, after] for m in range(3))  # part, order, step
                total, single = left[:, 0, 0], left[:, 0][:, 1 << np.arange(k)]
                fails, alone = total[:, None] - single, left[:, 0][:, last - (1 << np.arange(k))] - left[:, 0, last, None]
                shapley = np.stack([removed[:, orders == x].sum(axis=1) for x in range(k)], axis=1)
                flat = {
                    "kept": left[:, 0][:, after], "removed": removed, "redundant": fails[:, orders] - removed, "unique_fails": alone[:, orders], "good_lost": good, "toxic_lost": toxic,
                    "shapley": shapley[:, orders],
                }
                keys = {"part": own["part"].repeat(len(texts)).to_numpy(), "filter_order": np.tile(texts, len(own)), "step": np.tile(steps, len(own))}
                yield pd.DataFrame(keys | {c: v.ravel() for c, v in flat.items()})

    kind = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return _by_part(counts).mapInPandas(run, kind)


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | str], doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``filter_orders`` of ``docs``: ``filters`` names (a letter each) conditions under which a text fails, or ``REPEATS``.

    Every row counts, repeated ones too. A null condition doesn't fail a text; a null part is the empty string; a row without an id
    repeats none and is repeated by none, and has no label; rows that share both the smallest id and the text repeat none.
    Labels of one id are taken together: good if one says so. Other columns aren't read. Empty table: no rows.
    """
    names = "".join(filters)
    if len(names) != len(filters):
        raise ValueError("name each filter by one letter")
    return filter_orders(mask_counts(failure_masks(docs, filters, doc_id, text, part), labels), names)
