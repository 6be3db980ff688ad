"""A trie of conversations by their turns: each family's small trie first, then only combined family nodes meet."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipcurate.llm.common import materialize

ROOT = bytes(16)
FAMILY_NODE = "family long, key binary, parent binary, depth long, conv long, n_convs long, n_ends long, chars long, first_end long, last_end long, ends string"


def base_of_hundred(conv: Column) -> Column:
    return conv - conv % 100


def six_by_checksum(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % 6).cast("int")


def _turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str, base: Callable[[Column], Column], take: Callable[[Column], Column]) -> DataFrame:
    """``(family, conv, take, turn, digest, chars)``: what of a turn moves, in place of its text. The digest names (role, text)."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary"), 256)), 1, 16)
    out = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.length(t).cast("long").alias("chars"))
    return out.select(base(F.col("conv")).cast("long").alias("family"), "conv", take(F.col("conv")).cast("int").alias("take"), "turn", "digest", "chars")


def _in_order(turns: pa.Table) -> Iterator[tuple[int, int, list[tuple[bytes, int]]]]:
    """(conv, take, turns as (digest, chars) in order) of each conversation, ascending; turns of no number come first, ties by
    digest."""
    order = pc.sort_indices(turns, [("conv", "ascending"), ("turn", "ascending"), ("digest", "ascending")], null_placement="at_start")
    t = turns.take(order)
    conv, take = t.column("conv").to_numpy(), t.column("take").to_numpy()
    pairs = list(zip(t.column("digest").to_pylist(), t.column("chars").to_pylist(), strict=True))
    cuts = [0, *(np.flatnonzero(conv[1:] != conv[:-1]) + 1), len(conv)] if len(conv) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(conv[a]), int(take[a]), pairs[a:b]


def family_trie(key: tuple, members: pa.Table, head: pa.Table) -> pa.Table:
    """All nodes of a family: of the rebuilt ``members`` and the base conversation itself, ``head``. A node's key is a chain of
    digests over the turns that lead to it, so that it is the same in every family."""
    opening = next((turns for _, _, turns in _in_order(head)), [])
    rebuilt = [(conv, opening[:take] + own[take:]) for table in (head, members) for conv, take, own in _in_order(table)]
    nodes: dict[bytes, list] = {}  # parent, depth, smallest conversation, conversations, characters, those that end here
    for conv, turns in sorted(rebuilt, key=lambda x: x[0]):
        at = ROOT
        node = nodes.setdefault(at, [ROOT, 0, conv, 0, 0, []])
        node[3] += 1
        for depth, (digest, chars) in enumerate(turns, 1):
            parent, at = at, hashlib.blake2b(at + digest, digest_size=16).digest()
            node = nodes.setdefault(at, [parent, depth, conv, 0, chars, []])
            node[3] += 1
        node[5].append(conv)
    cells = list(nodes.values())
    own = {
        "family": [key[0].as_py()] * len(cells), "key": list(nodes), "parent": [c[0] for c in cells], "depth": [c[1] for c in cells], "conv": [c[2] for c in cells], "n_convs": [c[3] for c in cells],
        "n_ends": [len(c[5]) for c in cells], "chars": [c[4] for c in cells], "first_end": [c[5][0] if c[5] else None for c in cells], "last_end": [c[5][-1] if c[5] else None for c in cells],
        "ends": [",".join(map(str, c[5])) if c[5] else None for c in cells],
    }
    longs = ("family", "depth", "conv", "n_convs", "n_ends", "chars", "first_end", "last_end")
    kinds = {c: pa.int64() for c in longs} | {"key": pa.binary(), "parent": pa.binary(), "ends": pa.string()}
    return pa.table({c: pa.array(v, kinds[c]) for c, v in own.items()})


def subtree_sums(key: tuple, trie: pa.Table, owned: pa.Table) -> pa.Table:
    """What the nodes that a family owns add to the family's nodes: children, childless nodes and saved tokens below. A node is
    owned by the family of its smallest conversation, which runs through all nodes above it, so each is added once."""
    keys, depth = trie.column("key").to_pylist(), trie.column("depth").to_numpy()
    place = {k: i for i, k in enumerate(keys)}
    parent = np.array([place[p] for p in trie.column("parent").to_pylist()], dtype=np.int64)
    sums = np.zeros((len(keys), 3), dtype=np.int64)
    at = np.array([place[k] for k in owned.column("key").to_pylist()], dtype=np.int64)
    n, ends, chars = (owned.column(c).to_numpy() for c in ("n_convs", "n_ends", "chars"))
    sums[at, 1], sums[at, 2] = n == ends, (n - 1) * chars
    below = at[depth[at] > 0]
    np.add.at(sums[:, 0], parent[below], 1)
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        if depth[level[:1]].any():
            np.add.at(sums[:, 1:], parent[level], sums[level, 1:])
    some = np.flatnonzero(sums.any(axis=1))
    return pa.table({"key": pa.array([keys[i] for i in some], pa.binary())} | {c: pa.array(sums[some, k]) for k, c in enumerate(("n_children", "n_leaves", "saved_tokens"))})


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ends, block by block as they come, sorted by node and first id; only the hash's state is kept."""
    node, state, last = None, None, None
    for batch in batches:
        done: tuple[list, list] = ([], [])
        for key, first, until, ends in zip(*(batch.column(c).to_pylist() for c in ("key", "first_end", "last_end", "ends")), strict=True):
            if key != node:
                if state is not None:
                    done[0].append(node), done[1].append(state.hexdigest())
                node, state = key, hashlib.sha256()
            elif first <= last:
                raise ValueError("families must be ranges of ids: all ids of one before all of another")
            else:
                state.update(b",")
            state.update(ends.encode())
            last = until
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], ["key", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends_sha256"])


def conversation_trie(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    base: Callable[[Column], Column] = base_of_hundred, take: Callable[[Column], Column] = six_by_checksum,
) -> DataFrame:
    """``(key, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)`` of each distinct
    sequence of first turns of the rebuilt conversations (see ``rebuilt_turns``), the empty one, the root, included.

    ``conv_id`` is the smallest conversation through a node, the ends are those that stop there. ``n_leaves`` and
    ``saved_tokens``, (conversations - 1) times the code points of a node's text, are of the whole subtree.

    Conversations are cogrouped by base with the base's own turns; a family's trie is built in one call, and what leaves it is
    one row a node. These are added up by key with map-side sums; a node's totals go back once, to the family that owns it,
    for its subtree, and what that finds is added up by key again. The list of ends is hashed as a stream of blocks, a
    family each, because such a hash can only be taken in order; a node's blocks pass through one task, none is gathered.

    Ids are longs; ``base`` of a base is itself, and families are ranges of ids, which is checked. Rows without an id belong to
    no conversation. A null turn comes first, ties go by a digest of (role, text); null role or text is empty; repeated rows
    are turns of their own. Other columns aren't read. Empty table: no rows. A family's turns are held in one task, as
    numbers and 16 bytes each, not as texts.
    """
    turns = _turns(conversations, conv_id, turn, role, text, base, take)
    head, members = turns.where("conv = family"), turns.where("conv <> family")
    families = materialize(members.groupBy("family").cogroup(head.groupBy("family")).applyInArrow(family_trie, FAMILY_NODE), "families")
    same = ["key", "parent", "depth", "chars"]  # a key has one of each
    nodes = materialize(families.groupBy(*same).agg(F.min("conv").alias("conv"), F.sum("n_convs").alias("n_convs"), F.sum("n_ends").alias("n_ends")), "nodes")
    owned = nodes.select(base(F.col("conv")).cast("long").alias("family"), "key", "n_convs", "n_ends", "chars")
    sums = families.select("family", "key", "parent", "depth").groupBy("family").cogroup(owned.groupBy("family")).applyInArrow(subtree_sums, "key binary, n_children long, n_leaves long, saved_tokens long")
    blocks = families.where("ends is not null").select("key", "first_end", "last_end", "ends")
    hashes = blocks.repartition("key").sortWithinPartitions("key", "first_end").mapInArrow(_hash_ends, "key binary, ends_sha256 string")
    over = nodes.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id"))
    out = nodes.join(over, "parent").select("key", "parent", "conv", "depth", "n_convs", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"))
    added = sums.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    out = out.join(added, "key", "left").join(hashes, "key", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "key", "parent", F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", count("n_children"), count("n_leaves"), count("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def rebuilt_turns(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    base: Callable[[Column], Column] = base_of_hundred, take: Callable[[Column], Column] = six_by_checksum,
) -> DataFrame:
    """``(conv_id, depth, role, text)``: each conversation as its base's first ``take`` turns (all, if there are fewer; none, if there
    is no base) and its own after as many, numbered from 1. With a node's (conv_id, depth), its texts."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary"), 256)
    rows = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), r.alias("role"), t.alias("text"), digest.alias("digest"))
    own = rows.withColumn("at", F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "digest"))).drop("digest", "turn")
    ids = own.select("conv").distinct().select("conv", base(F.col("conv")).cast("long").alias("family"), take(F.col("conv")).cast("int").alias("take"))
    opening = own.where(F.col("conv") == base(F.col("conv"))).withColumnRenamed("conv", "family")
    first = ids.join(opening, "family").where("at <= take").select("conv", "at", "role", "text")
    rest = own.where(F.col("at") > take(F.col("conv"))).select("conv", "at", "role", "text")
    depth = F.row_number().over(Window.partitionBy("conv").orderBy("at")).cast("long")
    return first.unionByName(rest).select(F.col("conv").alias("conv_id"), depth.alias("depth"), "role", "text")
