"""Near-duplicate documents by 64-bit SimHash fingerprints, compared through BK-trees."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipcurate.llm.common import connected_components, free_name, materialize, pair_blocks, sorted_groups, with_components, worker_tables

BITS = 64
#: Of similar_components: minimal hashes in a sketch, shards of a row and hashes in their keys, radius of the trees.
HASHES, BANDS, BAND_ROWS, RADIUS = 512, 16, 4, 24
_factors = np.random.default_rng(42).integers(1, 2**62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles in order, in arrays of at most 4096, which bounds the memory of a very long text.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Fewer words than a shingle: the whole sequence is
    the only shingle. No words, or null: none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    n = max(1, len(words) - shingle + 1)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    line, width, starts = b" ".join(words), min(shingle, len(words)), [0, *ends]
    for a in range(0, n, 4096):
        yield np.array([xxhash.xxh64_intdigest(line[starts[i] : ends[i + width - 1] - 1], seed) for i in range(a, min(n, a + 4096))], dtype="<u8")


def majority(hashes: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of the hashes; of none, 0."""
    one, n = np.zeros(BITS, dtype=np.int64), 0
    for h in hashes:
        one += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * one > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 5, seed: int = 42) -> int:
    """SimHash of the word shingles, repeats counted."""
    return majority(shingle_hashes(text, shingle, seed))


def distinct_shingles(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The set of shingle_hashes, sorted."""
    parts = list(shingle_hashes(text, shingle, seed))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype="<u8")


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 5, name: str = "fingerprint") -> DataFrame:
    """``docs`` with a long column that holds the fingerprint's 64 bits."""

    @F.pandas_udf(T.LongType())
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn(name, udf(F.col(text)))


class BKTree:
    """Distinct fingerprints; a node's children are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.root: tuple[int, int, dict] | None = None

    def add(self, value: int, row: int) -> None:
        if self.root is None:
            self.root = (value, row, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            child = node[2].get(d)
            if child is None:
                node[2][d] = (value, row, {})
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        """Rows of all values at most ``radius`` away; only edges d - radius .. d + radius can lead to one."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            at, row, children = todo.pop()
            d = (at ^ value).bit_count()
            if d <= radius:
                found.append(row)
            if children:
                if len(children) > 2 * radius + 1:
                    todo += [children[k] for k in range(d - radius, d + radius + 1) if k in children]
                else:
                    todo += [c for k, c in children.items() if -radius <= k - d <= radius]
        return found


def shard_keys(fp: Column, radius: int, n: int, per_shard: int = 64) -> Column:
    """Array of (shard table, key): values at most ``radius`` bits apart share a key in one table at least.

    The 64 bits are cut into radius + r pieces; two values within the radius agree on r pieces, so one table for each
    choice of r pieces loses no pair. r grows with the number n of values, so that a key has about ``per_shard`` of
    them at any size.
    """
    r = 1
    while r < 6 and n / 2 ** (BITS * r // (radius + r)) > per_shard:
        r += 1
    cuts = [BITS * k // (radius + r) for k in range(radius + r + 1)]
    tables = []
    for t, chosen in enumerate(itertools.combinations(range(radius + r), r)):
        mask = sum(((1 << (cuts[k + 1] - cuts[k])) - 1) << cuts[k] for k in chosen)
        tables.append(F.struct(F.lit(t).alias("shard"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("key")))
    return F.array(*tables)


#: What _tree_edges returns with a band: links, of which only a and b are set, and members of groups, of which b is null.
FOUND = "shard long, key long, bi int, bj int, a long, b long"


def _tree_edges(radius: int, band: tuple[float, float] | None = None):
    """Links that the trees find. With ``band``, links are pairs whose sketches show at least its upper end; if a group has
    pairs between its two ends that these links leave apart, the rows of such pairs are returned too, with their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a, out_b = [], []
        for g in sorted_groups(batches, ["shard", "key", "bi", "bj"]):
            if g.num_rows < 2:
                continue
            fp, node, block = g.column("fp").to_pylist(), g.column("node").to_numpy(), g.column("block").to_numpy()
            bi, bj = g.column("bi")[0].as_py(), g.column("bj")[0].as_py()
            tree, i, j = BKTree(), [], []
            sketch, open_a, open_b = None if band is None else unpacked(g.column("sketch").to_pylist()), [], []
            for row, value in enumerate(fp):
                value &= 0xFFFFFFFFFFFFFFFF
                if bi == bj:
                    found = tree.within(value, radius)
                    tree.add(value, row)
                elif block[row] == bi:  # rows come sorted by block: the tree of block bi is complete before block bj asks
                    tree.add(value, row)
                    continue
                else:
                    found = tree.within(value, radius)
                if found and sketch is not None:
                    near = np.array(found)
                    about = resemblance((sketch[near] == sketch[row]).mean(axis=1))
                    found, doubtful = near[about >= band[1]].tolist(), near[(about >= band[0]) & (about < band[1])]
                    if len(doubtful):
                        open_a.append(doubtful)
                        open_b.append(np.full(len(doubtful), row))
                i += found
                j += [row] * len(found)
                if len(i) > 1_000_000:
                    a, b = spanning(len(fp), i, j)
                    i, j = a.tolist(), b.tolist()
            label = np.arange(len(fp))
            if i:
                a, b = spanning(len(fp), i, j)
                out_a.append(node[a])
                out_b.append(node[b])
                label[b] = a
            if band is not None and open_a:
                a, b = np.concatenate(open_a), np.concatenate(open_b)
                apart = label[a] != label[b]
                members = np.unique(np.concatenate([a[apart], b[apart]]))
                if len(members):
                    group = [pa.array([g.column(c)[0].as_py()] * len(members), schema.field(c).type) for c in names[:4]]
                    yield pa.record_batch([*group, pa.array(node[members]), pa.nulls(len(members), pa.int64())], names=names)
            if len(out_a) > 500:
                yield links(out_a, out_b)
                out_a, out_b = [], []
        if out_a:
            yield links(out_a, out_b)

    names = ["shard", "key", "bi", "bj", "a", "b"]
    schema = pa.schema([(c, pa.int32() if c in ("bi", "bj") else pa.int64()) for c in names])

    def links(a, b):
        a, b = np.concatenate(a), np.concatenate(b)
        if band is None:
            return pa.record_batch({"a": a, "b": b})
        return pa.record_batch([*(pa.nulls(len(a), schema.field(c).type) for c in names[:4]), pa.array(a), pa.array(b)], names=names)

    def spanning(n, i, j):
        from clipcurate.llm.common import spanning_edges

        return spanning_edges(n, np.asarray(i), np.asarray(j))

    return run


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, radius: int = 3, max_rows: int = 1024) -> DataFrame:
    """``(doc_id, fp, component)`` for each row: its fingerprint's bits as a long, and the smallest doc_id reachable over
    links of at most ``radius`` differing bits.

    Copies share a fingerprint and count as one value from then on. Values are dealt into shards (see shard_keys) that
    any two linked values share; each shard of at most ``max_rows`` values gets a BK-tree that its own values query. A
    shard with more is cut into subtrees, each of which goes to one task per block of queries. A task returns a
    spanning forest of the links that it found, never the pairs.

    Null and empty texts have fingerprint 0 and link like any other. Rows with a null doc_id take part like any other; where
    no row of a component has an id, it is null. Ids may be of any kind. Repeated rows each get a row. Empty tables give
    empty results; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = materialize(with_fingerprint(rows, "text", shingle, "fp").select("doc_id", "fp"), "prints")
    values = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")).withColumn("node", F.monotonically_increasing_id()), "values")
    n = values.count()
    keyed = values.select("fp", "node", F.explode(shard_keys(F.col("fp"), radius, n)).alias("s")).select("s.*", "fp", "node")
    keyed = keyed.withColumn("shard", F.col("shard").cast("long"))
    laid = pair_blocks(keyed, ["shard", "key"], F.xxhash64("fp"), max_rows)
    order = ["shard", "key", "bi", "bj"]
    laid = laid.repartition(*order).sortWithinPartitions(*order, "block", "fp")
    edges = laid.mapInArrow(_tree_edges(radius), "a long, b long")
    named = materialize(with_components(values, materialize(edges.distinct(), "edges"), "low").select("fp", "component"), "named")
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component")


def unpacked(sketches: list[bytes]) -> np.ndarray:
    """One row of HASHES small numbers for each sketch."""
    both = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    return np.concatenate([both & 15, both >> 4], axis=1)


def resemblance(same: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal 4-bit entries, of which 1 in 16 is equal by chance."""
    return (same - 1 / 16) / (15 / 16)


def signature(text: str | None, shingle: int = 5, seed: int = 42) -> tuple[int, bytes, np.ndarray]:
    """``(fingerprint, sketch, keys)`` of the set of shingles: repeats, which a Jaccard similarity ignores, don't count.
    Sketch: four bits of each of HASHES minimal hashes. Keys: a hash of each of BANDS groups of BAND_ROWS whole ones. No
    words: zeros and no keys."""
    hashes = distinct_shingles(text, shingle, seed)
    if not len(hashes):
        return 0, bytes(HASHES // 2), np.zeros(0, np.int64)
    least = np.full(HASHES, 2**64 - 1, dtype=np.uint64)
    for k in range(0, len(hashes), 128):
        np.minimum(least, (hashes[k : k + 128, None] * _factors).min(axis=0), out=least)
    small = ((least >> np.uint64(32)) & np.uint64(15)).astype(np.uint8)
    bands, width = least[: BANDS * BAND_ROWS].astype("<u8").tobytes(), 8 * BAND_ROWS
    keys = np.array([xxhash.xxh64_intdigest(bands[k * width : (k + 1) * width], k) for k in range(BANDS)], dtype=np.uint64).view(np.int64)
    return majority(hashes[k : k + 4096] for k in range(0, len(hashes), 4096)), (small[: HASHES // 2] | small[HASHES // 2 :] << 4).tobytes(), keys


def with_signature(docs: DataFrame, text: str = "text", shingle: int = 5) -> DataFrame:
    """``docs`` with a struct ``signature`` of fp (the fingerprint's bits as a long), sketch and keys."""

    @F.pandas_udf("fp long, sketch binary, keys array<long>")
    def udf(texts: pd.Series) -> pd.DataFrame:
        worker_tables("simhash", dict)  # none of its own; those of other operators go
        fp, sketch, keys = zip(*(signature(t, shingle) for t in texts), strict=True) if len(texts) else ((), (), ())
        return pd.DataFrame({"fp": np.array(fp, dtype=np.uint64).view(np.int64), "sketch": list(sketch), "keys": list(keys)})

    return docs.withColumn("signature", udf(F.col(text)))


def _exact_edges(similarity: float):
    """Links between the components of the rows of a group whose sets have at least ``similarity``, as few as connect them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, ["group"]):
            comp = g.column("comp").to_numpy()
            sets = [np.frombuffer(h, "<u8") for h in g.column("hashes").to_pylist()]
            sizes = np.array([len(h) for h in sets])
            starts = np.concatenate([[0], np.cumsum(sizes)])
            values, ids = np.unique(np.concatenate(sets), return_inverse=True)
            mark, label, out_a, out_b = np.zeros(len(values), dtype=np.int32), comp.copy(), [], []
            for row in range(1, len(sets)):
                own = ids[starts[row] : starts[row + 1]]
                mark[own] = 1
                both = np.add.reduceat(mark[ids[: starts[row]]], starts[:row])
                mark[own] = 0
                near = np.flatnonzero((both >= similarity * (sizes[:row] + sizes[row] - both)) & (label[:row] != label[row]))
                if len(near):
                    joined, first = np.unique(label[near], return_index=True)
                    out_a += comp[near[first]].tolist()
                    out_b += [comp[row]] * len(first)
                    label[np.isin(label, joined)] = label[row]
                    if (label == label[0]).all():
                        break
            if out_a:
                yield pa.record_batch({"a": np.array(out_a, dtype=np.int64), "b": np.array(out_b, dtype=np.int64)})

    return run


def exact_links(rows: DataFrame, values: DataFrame, found: DataFrame, comp: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``(a, b)``: links of components of ``comp`` by exact similarity, for the members of groups in ``found``.

    Groups whose members are all of one component need no answer, and groups of equal members are asked once. Only the
    texts of the members left are hashed again, one row of ``rows`` for each; a group has as many as a group of
    pair_blocks at most.
    """
    own = ["shard", "key", "bi", "bj"]
    asked = found.where("b is null").select(*own, F.col("a").alias("node"))
    asked = asked.join(comp.select("node", F.col("component").alias("of")), "node", "left").select(*own, "node", F.coalesce("of", "node").alias("comp"))
    groups = asked.groupBy(*own).agg(F.sort_array(F.collect_set(F.struct("node", "comp"))).alias("members"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    groups = materialize(groups.where("low < high").select("members").distinct().withColumn("group", F.monotonically_increasing_id()), "groups")
    members = groups.select("group", F.explode("members").alias("m")).select("group", "m.*")
    needed = values.join(members.select("node").distinct(), "node").select("node", "one.*").withColumnRenamed("doc_id", "id")
    needed = needed.hint("merge")  # grows with the input: one plan at every size

    @F.pandas_udf("binary")
    def udf(texts: pd.Series) -> pd.Series:
        worker_tables("simhash", dict)
        return texts.map(lambda t: distinct_shingles(t, shingle).tobytes())

    keyed = rows.select("doc_id", "text", text_hash(F.col("text")).alias("own"))
    texts = keyed.join(needed, keyed.doc_id.eqNullSafe(needed.id) & (keyed.own == needed.h)).select("node", "text").dropDuplicates(["node"])
    sets = materialize(texts.select("node", udf("text").alias("hashes")).where(F.length("hashes") > 0), "sets")
    laid = members.join(sets.hint("merge"), "node").select("group", "node", "comp", "hashes").repartition("group").sortWithinPartitions("group", "node")
    return materialize(laid.mapInArrow(_exact_edges(similarity), "a long, b long").distinct(), "exact")


def text_hash(text: Column) -> Column:
    """Tells the texts of rows of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _grouped(docs: DataFrame, doc_id: str, text: str, shingle: int, similarity: float, max_rows: int) -> DataFrame:
    """``(doc_id, h, group, component)`` for each row; h is the text_hash."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = with_signature(rows, "text", shingle).select("doc_id", text_hash(F.col("text")).alias("h"), "signature.*")
    signed = materialize(signed, "signed")
    values = signed.groupBy("fp", "sketch").agg(F.min("doc_id").alias("low"), F.min("keys").alias("keys"), F.min(F.struct("doc_id", "h")).alias("one"))
    values = materialize(values.withColumn("node", F.monotonically_increasing_id()), "values")
    keyed = values.select("node", F.posexplode("keys").alias("shard", "key")).withColumn("shard", F.col("shard").cast("long"))
    common = keyed.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("shard", "key")
    shared = materialize(keyed.join(common, ["shard", "key"]), "shared")
    laid = pair_blocks(shared.join(values.select("node", "fp", "sketch"), "node"), ["shard", "key"], F.xxhash64("fp", "sketch"), max_rows, shared)
    order = ["shard", "key", "bi", "bj"]
    laid = laid.select(*order, "block", "node", "fp", "sketch").repartition(*order).sortWithinPartitions(*order, "block", "fp")
    error = math.sqrt((similarity + (1 - similarity) / 16) * (1 - similarity) * 15 / 16 / HASHES) / (15 / 16)
    found = materialize(laid.mapInArrow(_tree_edges(RADIUS, (similarity - 4 * error, similarity + 4 * error)), FOUND), "found")
    sure = materialize(found.where("b is not null").select("a", "b").distinct(), "edges")
    more = exact_links(rows, values, found, connected_components(sure, "a", "b"), shingle, similarity)
    named = materialize(with_components(values, sure.unionByName(more), "low").select("fp", "sketch", "group", "component"), "named")
    return signed.join(named, ["fp", "sketch"], "left").select("doc_id", "h", "group", "component")


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, max_rows: int = 1024) -> DataFrame:
    """``(doc_id, component)`` for each row: the smallest doc_id reachable over links between texts whose sets of
    ``shingle``-word shingles have a Jaccard similarity of at least ``similarity``.

    Fingerprints alone don't tell 0.8 from 0.6: their distances spread too widely. So BK-trees find candidates within a
    wide radius (such pairs differ in 9 bits on the median, and hardly ever in more than RADIUS), and sketches of HASHES
    minimal hashes sort them: their estimate errs by 0.018 at 0.8. Pairs from four such errors above ``similarity`` on are
    links, pairs from four below are none, and those between that no link connects are decided by their sets of shingles.
    Trees are sharded by BANDS groups of minimal hashes; a pair of similarity 0.8 misses all common shards with odds of
    2 in 10,000. Only rows whose key another row has are laid out, each with 256 bytes, not with its text. A shard of more
    than ``max_rows`` values is cut into subtrees, each of which meets each block of queries in one task. A task returns a
    spanning forest of the links that it found, and the rows of open pairs, never the pairs.

    Rows of equal signature (copies, null and empty texts) count as one value. Rows with a null doc_id take part like any
    other; where no row of a component has an id, it is null. Repeated rows each get a row. Empty tables give empty
    results; other columns are not read.
    """
    return _grouped(docs, doc_id, text, shingle, similarity, max_rows).select("doc_id", "component")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, max_rows: int = 1024) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each component that with the smallest doc_id (null last; of rows of one
    id, by a hash of the text). Rows are told apart by id and text, so a row of another text stays whatever its id. Of
    rows that agree in both, one stays."""
    found = materialize(_grouped(docs, doc_id, text, shingle, similarity, max_rows), "grouped")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    groups = found.groupBy("group").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").select("group", "best")
    several = materialize(found.join(groups, "group").select("doc_id", "h", (rank == F.col("best")).alias("stays")), "several")
    gone = several.where("not stays").select(F.col("doc_id").alias("id"), F.col("h").alias("sha")).distinct()
    again = several.where("stays").groupBy(F.col("doc_id").alias("id"), F.col("h").alias("sha")).count().where("count > 1").drop("count")
    own = free_name(docs, "__text")
    keyed = docs.withColumn(own, text_hash(F.col(text)))
    same = lambda other: keyed[doc_id].eqNullSafe(other["id"]) & (keyed[own] == other["sha"])
    again = materialize(again, "again")
    left_out = gone if again.isEmpty() else gone.unionByName(again)
    left_out = materialize(left_out, "gone").hint("merge")  # grows with the input: one plan at every size
    stays = keyed.join(left_out, same(left_out), "left_anti").drop(own)
    if again.isEmpty():
        return stays
    return stays.unionByName(keyed.join(again, same(again), "left_semi").dropDuplicates([doc_id, own]).drop(own))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
