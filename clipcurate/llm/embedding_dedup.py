"""Near-duplicate embeddings by randomised-rotation binary codes with stored correction factors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipcurate.llm.common import materialize, pair_blocks, sorted_groups, spanning_edges, with_components


@lru_cache(maxsize=64)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng((dim, seed)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def band_plan(n: int, cosine: float, miss: float = 1e-5, per_bucket: int = 128, most: int = 30) -> tuple[int, int]:
    """(bits of a band, number of bands): a pair at the threshold has another code in all bands with probability ``miss``.

    Bits of two vectors at angle a differ with probability a / pi. Bits grow with log2 of the number of vectors, so that
    a bucket of unlike vectors keeps about ``per_bucket``, and the bands with them as the miss rate asks.
    """
    bits = min(most, max(4, math.ceil(math.log2(max(2, n / per_bucket)))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - same))


def encode(x: np.ndarray, bits: int, bands: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors x (n, dim): binary codes (n, ceil(dim / 8)), correction factors (n,), band keys (n, bands).

    Code: the signs of the rotated vector. Factor: inner product of the vector and its code as a unit vector, the one
    number that makes estimates from the code unbiased. Bands take signs under further rotations.
    """
    n, dim = x.shape
    turned = x @ rotation(dim, seed).T
    code, factor = np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(dim)
    signs = np.concatenate([turned > 0, *((x @ rotation(dim, seed + k).T) > 0 for k in range(1, math.ceil(bits * bands / dim)))], axis=1)
    power = 1 << np.arange(bits, dtype=np.int64)
    return code, factor, signs[:, : bits * bands].reshape(n, bands, bits) @ power


def estimate(code: np.ndarray, factor: np.ndarray, query: np.ndarray, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates (n, m) of inner products of coded vectors with rotated unit queries, and their bounds (n, 1).

    Estimate: <code, query> / factor. Its error is that of a random direction: at most sigmas * sqrt((1 - f^2) / f^2 / (dim - 1))
    but for a chance that falls as exp(-sigmas^2 / 2).
    """
    dim = query.shape[1]
    bits = np.unpackbits(code, axis=1, count=dim).astype(np.float64) * 2 - 1
    f = factor[:, None]
    return bits @ query.T / math.sqrt(dim) / f, sigmas * np.sqrt(np.maximum(0, 1 - f * f) / (f * f) / max(1, dim - 1))


def quantize(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated unit vectors on a grid of 256 levels: (levels as bytes, step of the grid, distance of the vector from its grid point)."""
    step = np.abs(turned).max(axis=1) / 127.5
    grid = np.clip(np.floor(turned / step[:, None]), -128, 127).astype(np.int8)
    return grid, step, np.linalg.norm(turned - on_grid(grid, step), axis=1)


def on_grid(grid: np.ndarray, step: np.ndarray) -> np.ndarray:
    return (grid.astype(np.float64) + 0.5) * step[:, None]


def unit_rows(packed: list[bytes], kind: str) -> np.ndarray:
    """The vectors in double precision and of unit length; scaled first, so that no square over- or underflows."""
    x = np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _codes(cosine: float, n: int, seed: int, kind: str, keys_only: bool = False):
    bits, bands = band_plan(n, cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, copies, vec = batch.column("node").to_numpy(), batch.column("copies").to_numpy(), batch.column("vec").to_pylist()
            by_dim: dict[int, list[int]] = {}
            for row, v in enumerate(vec):
                by_dim.setdefault(len(v) // np.dtype(kind).itemsize, []).append(row)
            for dim, rows in by_dim.items():
                x = unit_rows([vec[r] for r in rows], kind)
                code, factor, keys = encode(x, bits, bands, seed)
                grid, step, rest = quantize(x @ rotation(dim, seed).T)
                signs = np.packbits((keys[:, :, None] >> np.arange(bits) & 1).astype(bool).reshape(len(rows), -1), axis=1)
                for a in range(0, len(rows), 256):
                    part = rows[a : a + 256]
                    m = len(part)
                    place = {"band": np.tile(np.arange(bands, dtype=np.int64), m), "key": (keys[a : a + m] * 65536 + dim % 65536).ravel()}
                    if keys_only:
                        yield pa.record_batch(place)
                        continue
                    each = lambda of: np.repeat(of[a : a + m], bands)  # noqa: E731,B023
                    rep = lambda of: pa.array([v for row in of[a : a + m] for v in [row.tobytes()] * bands], pa.binary())  # noqa: E731,B023
                    yield pa.record_batch(place | {
                        "node": np.repeat(node[part], bands), "copies": np.repeat(copies[part], bands), "code": rep(code), "factor": each(factor),
                        "grid": rep(grid), "step": each(step), "rest": each(rest), "signs": rep(signs),
                    })

    return run


def _links(cosine: float, n: int, sigmas: float, emit: int = 262144):
    """What the codes say of the pairs of each group: rows ``(a, b, n)`` that are an edge of a spanning forest of certain links
    (n = 0), a number of certain links of one value (a = b, n > 0), or a pair that is still open (n = -1). A pair that meets in
    an earlier band too is left to that band."""
    bits, bands = band_plan(n, cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush():
            a, b, n = (np.concatenate(c) for c in zip(*out, strict=True))
            out.clear()
            return pa.record_batch({"a": a, "b": b, "n": n})

        for g in sorted_groups(batches, ["band", "key", "bi", "bj"]):
            m = g.num_rows
            if m < 2:
                continue
            band, bi, bj = (g.column(c)[0].as_py() for c in ("band", "bi", "bj"))
            node, copies, block, factor, step, rest = (g.column(c).to_numpy() for c in ("node", "copies", "block", "factor", "step", "rest"))
            get = lambda c, of: np.frombuffer(b"".join(g.column(c).to_pylist()), of).reshape(m, -1)  # noqa: E731,B023
            left, right = (np.arange(m),) * 2 if bi == bj else (np.flatnonzero(block == bi), np.flatnonzero(block == bj))
            if not len(left) or not len(right):
                continue
            query = on_grid(get("grid", np.int8), step)
            about, bound = estimate(get("code", np.uint8)[left], factor[left], query[right], sigmas)
            i, j = np.nonzero(about + bound * (1 + rest[right]) + rest[right] >= cosine)
            i, j = left[i], right[j]
            i, j = (i[i < j], j[i < j]) if bi == bj else (i, j)
            if band and len(i):
                sig = np.unpackbits(get("signs", np.uint8), axis=1, count=bits * bands).reshape(m, bands, bits)[:, :band] @ (1 << np.arange(bits, dtype=np.int32))
                fresh = np.concatenate([~(sig[i[k : k + 65536]] == sig[j[k : k + 65536]]).any(axis=1) for k in range(0, len(i), 65536)])
                i, j = i[fresh], j[fresh]
            if not len(i):
                continue
            # inner products on the grid, which can be off by no more than the distances from it (and rounding)
            dot = np.concatenate([np.einsum("ij,ij->i", query[i[k : k + 65536]], query[j[k : k + 65536]]) for k in range(0, len(i), 65536)])
            off = rest[i] + (1 + rest[i]) * rest[j] + 1e-9
            sure, open_ = dot - off >= cosine, np.abs(dot - cosine) <= off
            open_ &= ~sure
            if open_.any():
                out.append((node[i[open_]], node[j[open_]], np.full(open_.sum(), -1, np.int64)))
            i, j = i[sure], j[sure]
            if len(i):
                root, member = spanning_edges(m, i, j)
                out.append((node[root], node[member], np.zeros(len(root), np.int64)))
                got = np.bincount(i, copies[j], m) + np.bincount(j, copies[i], m)
                at = np.flatnonzero(got)
                out.append((node[at], node[at], got[at].astype(np.int64)))
            if len(out) > 400 or sum(len(x[0]) for x in out) > emit:
                yield flush()
        if out:
            yield flush()

    return run


def _exact(cosine: float, kind: str):
    """Of open pairs with both vectors: those whose cosine, in double precision, is high enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = batch.select(["a", "b", "copies_a", "copies_b"])
            left, right = batch.column("vec_a").to_pylist(), batch.column("vec_b").to_pylist()
            linked, dims = np.zeros(batch.num_rows, bool), np.array([len(v) for v in left])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x, y = (unit_rows([side[k] for k in at], kind) for side in (left, right))
                linked[at] = np.einsum("ij,ij->i", x, y) >= cosine
            yield pair.filter(pa.array(linked))

    return run


def embedding_components(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.95, seed: int = 11, sigmas: float = 5.0, max_rows: int = 1024) -> DataFrame:
    """``(vec_id, n_links, component_id)`` for each row of ``vectors``.

    Two vectors of one dimension link if their cosine in double precision is ``cosine`` or more. Equal vectors are one
    value with a number of copies. Each value gets a binary code with its correction factor, its rotated vector on a grid of
    256 levels (the query that estimates need), and a key in each of several bands of code bits; these, not the vectors, go
    out by key, and values that share one meet in groups of bounded size (see pair_blocks). There the estimate from the
    code and its confidence bound rule most pairs out. The distances of two vectors from the grid bound what their inner
    product there can be off by: that decides most others for certain. Only what is still open, within about 0.02 of the
    threshold, is joined with its two vectors, once a pair, and decided by their cosine. A link is missed only if all bands
    separate it (1e-5 at the threshold, far less above it) or its estimate errs by ``sigmas`` deviations. Tasks return
    counts and a spanning forest of links, not the links.

    Vectors that are null, empty, all zero or hold null or non-finite components link with nothing. Rows that repeat an id
    are vectors of their own, each with its links; a component is named by the smallest id of its vectors. Rows without an
    id link too; where no vector of a component has an id, it is null. Components of floats are kept as such, all others
    as doubles. Empty table: no rows. Other columns are not read.
    """
    narrow = vectors.schema[embedding].dataType.simpleString() == "array<float>"
    kind, v = ("<f4" if narrow else "<f8"), F.col("v").cast("array<float>" if narrow else "array<double>")
    bad = F.coalesce(F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))), F.lit(True)) | ~F.coalesce(F.exists("v", lambda c: c != 0), F.lit(False))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v")).withColumn("v", v)
    rows = rows.withColumn("v", F.when(bad, F.lit(None)).otherwise(F.col("v")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [None if x is None else (np.asarray(x, kind) + 0).tobytes() for x in b.column("v").to_pylist()]
            yield pa.record_batch({"vec_id": b.column("vec_id"), "vec": pa.array(packed, pa.binary())})

    packed = materialize(rows.mapInArrow(pack, "vec_id long, vec binary"), "packed")
    values = packed.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    values = materialize(values.withColumn("node", F.monotonically_increasing_id()), "values")
    n = values.count()
    sent = values.select("node", "copies", "vec")
    coded = sent.mapInArrow(_codes(cosine, n, seed, kind), "band long, key long, node long, copies long, code binary, factor double, grid binary, step double, rest double, signs binary")
    keys = sent.mapInArrow(_codes(cosine, n, seed, kind, True), "band long, key long")
    laid = pair_blocks(coded, ["band", "key"], F.xxhash64("node"), max_rows, keys)
    order = ["band", "key", "bi", "bj"]
    found = materialize(laid.repartition(*order).sortWithinPartitions(*order).mapInArrow(_links(cosine, n, sigmas), "a long, b long, n long"), "links")
    pairs = found.where("n < 0").select("a", "b")
    for end in "ab":
        pairs = pairs.join(sent.select(F.col("node").alias(end), F.col("copies").alias(f"copies_{end}"), F.col("vec").alias(f"vec_{end}")), end)
    exact = materialize(pairs.mapInArrow(_exact(cosine, kind), "a long, b long, copies_a long, copies_b long"), "exact")
    links = found.where("n > 0").select("a", "n").union(exact.select("a", "copies_b")).union(exact.select("b", "copies_a"))
    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    edges = found.where("n = 0").select("a", "b").union(exact.select("a", "b")).distinct()
    named = with_components(values, edges, "low").join(counts, "node", "left")
    named = materialize(named.select("vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component"), "named")
    out = packed.join(named, "vec", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id"))
