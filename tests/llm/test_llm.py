"""Each corpus operator against a plain version, on rows with nulls, empty and long texts, ties, repeats and clashing names."""

import datetime
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clipcurate.llm import common, embedding_dedup, exact_dedup, mixing, packing, pii, sharding, simhash, toxicity, url_filter, warc
from clipcurate.llm.queries import HOST_RULES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string"
WORDS = [f"w{i}" for i in range(400)]


def documents(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, " ".join(rng.choice(WORDS, rng.integers(5, 60))), "en", f"src{i % 4}", 1, "x", "y") for i in range(n)]
    rows += [(n, None, None, None, None, None, None), (n + 1, "", "en", "src0", 0, None, None), (n + 2, rows[0][1].upper(), "en", "src1", 1, None, None), rows[3], (n + 4, "long " * 9000 + "é", "en", "src0", 1, None, None), (n + 5, "long " * 9000 + "è", "en", "src0", 1, None, None)]
    return spark.createDataFrame(rows, SCHEMA), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("hash_fn", [F.xxhash64, lambda *c: F.pmod(F.xxhash64(*c), F.lit(3))])
def test_exact_dedup_even_where_hashes_collide(spark, hash_fn):
    df, rows = documents(spark)
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = {}
    for r in rows:
        groups.setdefault(low(r[1]), []).append(r[0])
    out = exact_dedup.exact_duplicates(df, block=64, hash_fn=hash_fn).collect()
    assert len(out) == len(rows)
    want = {i: (max(g), len(g)) for g in groups.values() for i in g}
    assert all((r["keep_id"], r["group_size"]) == want[r["doc_id"]] for r in out)
    assert sum(r["kept"] for r in out) == len(groups)


def test_exact_dedup_stage_keeps_one_of_each(spark):
    df, rows = documents(spark)
    kept = exact_dedup.drop_exact_duplicates(df)
    assert kept.columns == df.columns and kept.count() == len({(r[1] or "").lower() for r in rows})
    assert exact_dedup.drop_exact_duplicates(empty(spark)).count() == 0


def _fingerprint(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64(" ".join(w[i : i + n]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark):
    df, rows = documents(spark)
    out = simhash.simhash_components(df, shingle=4, radius=12, max_rows=4).collect()
    fp = [(r[0], _fingerprint(r[1], 4)) for r in rows]
    assert sorted((r["doc_id"], r["fp"] % 2**64) for r in out) == sorted(fp)
    label = {x: min(i for i, y in fp if y == x) for _, x in fp}
    for _ in fp:
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= 12:
                    label[a] = min(label[a], label[b])
    assert all(r["component"] == label[r["fp"] % 2**64] for r in out)
    assert simhash.drop_near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("max_rows", [4, 1024])
def test_near_copies_equal_brute_force(spark, max_rows):
    rng = np.random.default_rng(5)
    texts = [None, "", "", "one two", "One Two", "é long " * 9000]
    for g, size in enumerate([1] * 30 + [2] * 12 + [40]):  # one text, pairs, and a group larger than a block
        base = rng.choice(WORDS, 300)
        for k in range(size):
            own = base.copy()
            own[rng.choice(300, k and 1 + (k + g) % 4, replace=False)] = "x"  # up to four words change: 20 of 296 shingles
            texts.append(" ".join(own))
        far = base.copy()
        far[::12] = "y"  # shares the words, but few shingles
        texts.append(" ".join(far))
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for t in texts]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((want[i], want[j]))
                want = [a if x == b else x for x in want]
    df = spark.createDataFrame([*enumerate(texts), (None, texts[3]), (None, "of its own"), (7, texts[7])], "doc_id long, text string").withColumn("fp", F.lit("clash"))
    out = simhash.similar_components(df, max_rows=max_rows).collect()
    assert sorted((r["doc_id"], r["component"]) for r in out if r["doc_id"] is not None) == sorted([*enumerate(want), (7, want[7])])
    assert sorted((r["component"] for r in out if r["doc_id"] is None), key=str) == [3, None]
    kept = simhash.drop_near_duplicates(df, max_rows=max_rows)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([*set(want), None], key=str)


def test_near_copies_of_repeated_ids(spark):
    """Rows of one id stand for themselves: what is unlike everything stays, of equal rows one does."""
    rng = np.random.default_rng(6)
    base = [str(x) for x in rng.integers(0, 10**9, 300)]
    near, other = " ".join(base[:-2] + ["x", "y"]), " ".join(str(x) for x in rng.integers(0, 10**9, 300))
    rows = [(1, " ".join(base)), (2, near), (2, other), (None, near), (3, other), (3, other), (None, "alone"), (None, "alone"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__text", F.lit(1))
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([rows[0], rows[2], (None, "alone"), (4, None)], key=str)
    out = simhash.simhash_components(df, shingle=4, radius=4).collect()
    assert {r["component"] for r in out if r["fp"] == 0} == {4} and all(r["component"] is None for r in out if r["fp"] not in (0, *(x["fp"] for x in out if x["doc_id"] is not None)))


def _jaccard_components(texts, least=0.8):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in map(str.split, texts)]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_near_copies_with_repeated_lines(spark):
    rng = np.random.default_rng(8)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 10**9, n)]
    texts = []
    for _ in range(12):
        base = word(250)
        texts += [" ".join(base + 20 * word(12)), " ".join(base + 20 * word(12))]
    want = _jaccard_components(texts)
    assert want == [i - i % 2 for i in range(24)]
    out = simhash.similar_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r["component"] for r in out.orderBy("doc_id").collect()] == want


@pytest.mark.parametrize("max_rows", [4, 1024])
def test_near_copies_about_the_threshold(spark, max_rows):
    """Sets of 200 shingles and parts of them: similarities of exactly 0.78 to 0.82, and a chain over 0.79 and 0.81."""
    rng = np.random.default_rng(9)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 10**9, n)]
    texts = []
    for left in [156, 158, 160, 162, 164] * 8:
        base = word(204)
        texts += [" ".join(base), " ".join(base[: left + 4])]
    base = word(204)
    texts += [" ".join(base), " ".join(base[:162]), " ".join(base[:166]), " ".join(base[:138])]
    want = _jaccard_components(texts)
    assert len(set(want)) == 40 + 16 + 1
    out = simhash.similar_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), max_rows=max_rows)
    assert [r["component"] for r in out.orderBy("doc_id").collect()] == want


def test_bk_tree_and_shards():
    rng = np.random.default_rng(1)
    values = [int(x) for x in rng.integers(0, 2**20, 300)]
    tree = simhash.BKTree()
    for i, v in enumerate(values):
        tree.add(v, i)
    for q in values[:40]:
        assert sorted(tree.within(q, 4)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 4]


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 16))
    x = np.concatenate([base + rng.normal(size=base.shape) * 0.05 * k for k in range(6)])
    rows = [(i, [float(v) for v in r], 1, "z") for i, r in enumerate(x.astype("f4"))] + [(500, None, 1, "z"), (501, [0.0] * 16, 1, "z"), (502, [float("nan")] * 16, 1, "z"), (503, [float(v) for v in x.astype("f4")[0]], 1, "z"), (504, [], 1, "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string")
    out = {r["vec_id"]: r for r in embedding_dedup.embedding_components(df, max_rows=8).collect()}
    good = [(i, np.array(v, dtype="f4").astype(float)) for i, v, *_ in rows if v and np.isfinite(v).all() and any(v)]
    e = np.stack([v / np.linalg.norm(v) for _, v in good])
    link = e @ e.T >= 0.95
    np.fill_diagonal(link, False)
    ids = [i for i, _ in good]
    assert all(out[i]["n_links"] == link[k].sum() for k, i in enumerate(ids))
    label = np.array(ids)
    for _ in ids:
        label = np.array([min([label[k], *label[link[k]]]) for k in range(len(ids))])
    assert all(out[i]["component_id"] == c for i, c in zip(ids, label, strict=True))
    assert all(out[i]["n_links"] == 0 and out[i]["component_id"] == i for i in (500, 501, 502, 504))


def test_embeddings_near_the_threshold_are_decided_by_their_cosines(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((3, 16))
    noise = rng.standard_normal((180, 16))
    x = base[np.arange(180) % 3] + noise * (0.23 * np.linalg.norm(base[np.arange(180) % 3], axis=1) / np.linalg.norm(noise, axis=1))[:, None]
    x = np.concatenate([x, x[:5]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    close = np.abs(unit @ unit.T - 0.95)[np.triu_indices(len(x), 1)]
    assert (close < 0.01).sum() > 500  # pairs that bytes can't decide
    out = {r["vec_id"]: r for r in embedding_dedup.embedding_components(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"), max_rows=32).collect()}
    low = np.arange(len(x))
    for _ in range(len(x)):
        low = np.minimum(low, np.where(linked, low[None, :], len(x)).min(axis=1))
    assert [out[k]["n_links"] for k in range(len(x))] == linked.sum(axis=1).tolist()
    assert [out[k]["component_id"] for k in range(len(x))] == low.tolist()


def test_embeddings_of_repeated_ids_and_in_doubles(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [1e300, 0.0, 0.0]), (None, [0.0, 0.0, 1e-300]), (None, [0.0, 0.0, 2.0])]
    out = embedding_dedup.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (None, 1, None), (None, 1, None)], key=str)
    edge = [(0, [1.0, 0.0]), (1, [0.95, float(np.sqrt(1 - 0.95**2)) - 1e-12]), (2, [0.95 - 1e-12, float(np.sqrt(1 - (0.95 - 1e-12) ** 2))])]
    out = embedding_dedup.embedding_components(spark.createDataFrame(edge, "vec_id long, embedding array<double>")).orderBy("vec_id").collect()
    assert [r["n_links"] for r in out] == [1, 2, 1]
    assert embedding_dedup.embedding_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_rabitq_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code, factor, _ = embedding_dedup.encode(x, 8, 4, seed=5)
    about, bound = embedding_dedup.estimate(code, factor, x[:50] @ embedding_dedup.rotation(64, 5).T, 5.0)
    error = about - x @ x[:50].T
    assert abs(error.mean()) < 0.005 and (np.abs(error) <= bound).all()


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101 + i) for i in range(30)] + [(None, 5), (7, 7)]
    out = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(out[i] == 0 for i in range(41)) and all(out[100 + i] == 100 for i in range(31))


def test_sharding_law_and_round_trip(spark):
    df, rows = documents(spark)
    df = df.unionByName(df.where("doc_id is null").crossJoin(spark.range(300)).drop("id")).withColumn("placement", F.lit("own")).withColumn("shard", F.lit("own"))
    rows = rows + [r for r in rows if r[0] is None] * 300
    placed = sharding.shuffle_into_shards(df, 8, bucket_bytes=4000)
    assert placed.columns == [*df.columns, "placement_"]
    path = common.scratch_path(spark, "shards")
    sharding.write_shards(placed, path, "placement_")
    got = sharding.read_shards(spark, path, placed.schema).collect()
    assert sorted((tuple(r[:7]) for r in got), key=str) == sorted(map(tuple, rows), key=str)
    shards = {s: sorted(r["placement_"]["slot"] for r in got if r["placement_"]["shard"] == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in shards.values()) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    in_bucket = {}
    for r in got:
        in_bucket[r["placement_"]["bucket"]] = in_bucket.get(r["placement_"]["bucket"], 0) + (r["doc_id"] is None)
    assert max(in_bucket.values()) < 60  # rows without an id are spread
    again = sharding.shuffle_into_shards(df, 8, bucket_bytes=4000).collect()
    assert sorted(map(str, again)) == sorted(map(str, sharding.read_shards(spark, path, placed.schema).select(placed.columns).collect()))
    assert sharding.shuffle_into_shards(empty(spark), 8).count() == 0


def test_sharding_moves_rows_anywhere(spark):
    """Slots of one shard: no order of the input is left, and each eighth of the input is spread over all shards."""
    out = sharding.shuffle_into_shards(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), 8, bucket_bytes=20_000)
    got = out.select("doc_id", "placement.*").collect()
    order = np.array([r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))])
    assert abs(np.corrcoef(order, np.arange(4000))[0, 1]) < 0.06
    table = np.zeros((8, 8))
    for r in got:
        table[r["doc_id"] // 500, r["shard"]] += 1
    assert ((table - 62.5) ** 2 / 62.5).sum() < 100


def plain_ids(text):
    """As the tokenizer itself says, without anything of the operator."""
    if "tokenizer" not in _PLAIN:
        _PLAIN["tokenizer"] = Tokenizer.from_file(packing.default_tokenizer())
    return _PLAIN["tokenizer"].encode(text or "", add_special_tokens=False).ids


_PLAIN = {}


def test_ten_thousand_buckets_share_partitions(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MAX_PARTITIONS", 5)
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.lit("t" * 36).alias("text"))
    got = sharding.shuffle_into_shards(docs, 8, bucket_bytes=120).select("doc_id", "placement.*").collect()
    assert len({r["bucket"] for r in got}) > 5000 and sorted(r["doc_id"] for r in got) == list(range(12_000))
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(1500))


def test_packing_round_trip(spark):
    df, rows = documents(spark)
    rows = [*rows, (900, "a <|endoftext|>b <|endoftext|>", "en", "src0", 1, "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = packing.pack(df, size=64, keep_ids=True).collect()
    want = sorted((r[0], plain_ids(r[1]) + [2]) for r in rows)
    placed = {}
    for r in out:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in placed.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 64
    once = {}
    for r in sorted(out, key=lambda r: r["start"]):
        once.setdefault(r["doc_id"], []).append(r)
    for doc, ids in dict(want).items():
        pieces = {r["start"]: np.frombuffer(r["ids"], "<u4").tolist() for r in once[doc]}
        assert sum((pieces[s] for s in sorted(pieces)), []) == ids
    total = sum(r["length"] for r in out)
    assert len(placed) <= -(-total // 64) + 3
    assert packing.pack(empty(spark)).count() == 0


def test_plan_uses_each_piece_once():
    rng = np.random.default_rng(0)
    counts = {int(x): int(n) for x, n in zip(rng.choice(np.arange(1, 101), 40, replace=False), rng.integers(1, 50, 40), strict=True)}
    used = {}
    for lengths, n in packing.plan(counts, 100):
        assert sum(lengths) <= 100
        for x in lengths:
            used[x] = used.get(x, 0) + n
    assert used == counts


@pytest.mark.parametrize("text", ["", " a", "a  b", "a\n b", "don't stop.\nNow, é ñ!", "x\t y", "<|endoftext|> a", "a <|endoftext|>\n<|endoftext|><|endoftext|>b", "<|endoftext|", "日本 語", "a ", "end.\n\nB"])
def test_encoder_equals_tokenizer(text):
    enc = packing.encoder(packing.default_tokenizer())
    ids = np.array(plain_ids(text), "<u4").tobytes()
    assert enc.text(text) == ids == enc.text(text)


def test_mixing_meets_targets(spark):
    df, rows = documents(spark, 300)
    out = mixing.mix_sources(df, leaf_rows=16, fan_in=2).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["source"], []).append(r)
    names = sorted((s for s in by if s is not None)) + [None]
    sizes = np.array([sum(r["size"] for r in by[s]) for s in names], float)
    w, cap, fixed = np.array([1 + k % 3 for k in range(len(names))], float), 3 * sizes, np.zeros(len(names), bool)
    while True:
        want = np.where(fixed, cap, (sizes.sum() - cap[fixed].sum()) * w / w[~fixed].sum())
        if not (over := ~fixed & (want > cap)).any():
            break
        fixed |= over
    for s, t in zip(names, want, strict=True):
        assert by[s][0]["target"] == pytest.approx(t) and abs(sum(r["copies"] * r["size"] for r in by[s]) - t) <= max(r["size"] for r in by[s]) and all(0 <= r["copies"] <= 3 for r in by[s])
    again = mixing.mix_sources(df.repartition(5), leaf_rows=16, fan_in=2).collect()
    key = lambda rs: sorted((r["doc_id"], r["copies"]) for r in rs)
    assert key(out) == key(again)
    mixed = mixing.take_mix(df)
    assert mixed.columns == df.columns and mixing.take_mix(empty(spark)).count() == 0


def test_mixing_spreads_rows_that_agree(spark):
    rows = [(None, "a b c", "s0")] * 900 + [(i, "a b c d", "s1") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    out = mixing.mix_sources(df, leaf_rows=32, fan_in=4)
    got = out.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("words"), F.first("target").alias("target"), F.count(F.lit(1)).alias("n")).collect()
    assert all(abs(r["words"] - r["target"]) <= 4 and r["n"] == 900 for r in got) and len(got) == 2
    assert mixing.take_mix(df.withColumn("__row", F.lit(1))).count() == out.agg(F.sum("copies")).first()[0]


def test_url_rules_clashing_and_empty(spark):
    rules = [url_filter.wildcard_rule("x*", "block"), url_filter.wildcard_rule("/ads/", "block"), url_filter.wildcard_rule("y", "allow", rank=2)]
    df = spark.createDataFrame([(1, "http://ax/", 5), (2, "http://b/ads/", 6), (3, "http://xy/" + "z" * 200_000, 7)], "page_id long, url string, url_verdict int")
    out = url_filter.judge_urls(df, rules)
    assert out.columns == ["page_id", "url", "url_verdict", "url_verdict_"]
    assert {r["page_id"]: (r["url_verdict"], r["url_verdict_"]["verdict"]) for r in out.collect()} == {1: (5, "block"), 2: (6, "block"), 3: (7, "allow")}
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0


def test_url_rules(spark):
    urls = ["https://A.Example.org/es/x", "http://example.org/en/12", "http://example.org/en/2?x=/es/", "http://b.com/fr/a", "http://b.com/de/", "http://example.org?x", None, "", "no scheme/org/", "http://notexample.org/es/", "http://x.com/ads/1"]
    df = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)] + [(0, urls[0], "k")], "page_id long, url string, rule string")
    rules = [url_filter.prefix_rule(r, a) for a, r in HOST_RULES] + [url_filter.wildcard_rule("/ads/", "block")]
    out = {r["page_id"]: (r["url_verdict"]["rule"], r["url_verdict"]["verdict"]) for r in url_filter.judge_urls(df, rules).collect()}
    want = [("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("org/", "allow"), ("/ads/", "block")]
    assert [out[i] for i in range(len(urls))] == want


def test_pseudonyms(spark):
    texts = ["card 4539578763621486, ip 10.0.0.1. born 2001-02-29 or 2000-02-29", "again 4539578763621486 and 4539578763621487", None, "", "mail bob.1@mail.example.com now", "nothing to see", "12/31/1999 and 31.12.1999"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pii2 string")
    out = {r["doc_id"]: r for r in pii.pseudonymize(df, key="k").collect()}
    card = lambda t: re.findall(r"\d{16}", t)
    luhn = lambda s: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0
    a, b = card(out[0]["text"]), card(out[1]["text"])
    assert a[0] == b[0] != "4539578763621486" and luhn(a[0]) and b[1] == "4539578763621487"
    assert "2001-02-29" in out[0]["text"] and "2000-02-29" not in out[0]["text"] and "10.0.0.1" not in out[0]["text"]
    assert out[2]["text"] is None and out[3]["text"] == "" and out[5]["text"] == "nothing to see"
    assert "bob.1@" not in out[4]["text"] and out[4]["text"].endswith("@mail.example.com now") and out[6]["pii"]["date"] == 2


def _python_pseudonym(kind, m, key="k"):
    """The same pseudonyms by plain Python over integers and strings; None where a value isn't valid."""
    sha = lambda *parts: hashlib.sha512("|".join(map(str, (key, *parts))).encode()).hexdigest()

    def number(v, ra, rb, tweak):
        a, b = divmod(v, rb)
        for i in range(8):
            if i % 2 == 0:
                a = (a + int(sha(tweak, i, b)[:15], 16)) % ra
            else:
                b = (b + int(sha(tweak, i, a)[:15], 16)) % rb
        return a * rb + b

    def digits(d, tweak):
        a, b = d[: len(d) // 2], d[len(d) // 2 :]
        for i in range(8):
            stream = bytes.fromhex(sha(tweak, i, b))
            a, b = b, "".join(str((int(c) + stream[j % 64]) % 10) for j, c in enumerate(a))
        return a + b

    def check(d):
        return str(-sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10)

    def respell(new):
        it = iter(new)
        return "".join(next(it) if c.isdigit() else c for c in m)

    d = re.sub(r"\D", "", m)
    if kind == "card":
        new = digits(d[:-1], "card")
        return respell(new + check(new)) if check(d[:-1]) == d[-1] else None
    if kind == "phone":
        kept = max(0, len(d) - 9)
        return respell(d[:kept] + digits(d[kept:], "phone"))
    if kind == "ssn":
        areas = [x for x in range(1, 900) if x != 666]
        a, g, s = map(int, m.split("-"))
        if a not in areas or not g or not s:
            return None
        v, s = divmod(number((areas.index(a) * 99 + g - 1) * 9999 + s - 1, 898 * 99, 9999, "ssn"), 9999)
        return f"{areas[v // 99]:03}-{v % 99 + 1:02}-{s + 1:04}"
    first = datetime.date(1800, 1, 1)
    day, month, year = map(int, m.split("/"))  # day first: the day is over 12
    v = (datetime.date(year, month, day) - first).days
    while True:
        v = number(v, 189, 773, "date")
        new = first + datetime.timedelta(v)
        if new.day > 12:
            return f"{new.day:02}/{new.month:02}/{new.year}"


def test_pseudonyms_equal_plain_python_and_stay_valid(spark):
    rng = np.random.default_rng(2)
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    body = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    full = lambda b: next(b + c for c in "0123456789" if luhn(b + c))
    cards = [full(body(15)) for _ in range(600)] + [full(body(14)) for _ in range(100)] + [body(16) for _ in range(100)]
    cards += [f"{c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]}" for c in cards[:50]] + [f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}" for c in cards[:50]] + [f"{c[:4]} {c[4:10]} {c[10:]}" for c in cards[600:620]]
    ssns = [f"{a:03}-{g:02}-{s:04}" for a, g, s in zip(rng.integers(0, 1000, 900), rng.integers(0, 100, 900), rng.integers(0, 10000, 900), strict=True)]
    tens = [f"{a}{b:03}{c:04}" for a, b, c in zip(rng.integers(200, 1000, 300), rng.integers(0, 1000, 300), rng.integers(0, 10000, 300), strict=True)]
    phones = [f for t in tens for f in (f"({t[:3]}) {t[3:6]}-{t[6:]}", f"{t[:3]}-{t[3:6]}-{t[6:]}", f"+1 {t[:3]} {t[3:6]} {t[6:]}", f"+1{t}")]
    dates = [f"{d:02}/{mo:02}/{y}" for d, mo, y in zip(rng.integers(13, 29, 300), rng.integers(1, 13, 300), rng.integers(1800, 2200, 300), strict=True)]
    rows = [(k, m) for k, ms in (("card", cards), ("ssn", ssns), ("phone", phones), ("date", dates)) for m in ms]
    df = spark.createDataFrame([(i, k, f"see {m}, please") for i, (k, m) in enumerate(rows)], "i long, pii string, text string")
    out = sorted(pii.pseudonymize(df, "k").collect(), key=lambda r: r["i"])
    got = [(k, m, r["text"][4:-8], r["pii_"][k]) for (k, m), r in zip(rows, out, strict=True)]
    for k, m, new, n in got:
        want = _python_pseudonym(k, m)
        assert (new, n) == ((m, 0) if want is None else (want, 1)) or want is None and k == "card" and new != m and sum(c.isdigit() for c in m) <= 15, (k, m, new)
    for k in ("card", "ssn", "phone", "date"):
        maps = {m: new for kind, m, new, n in got if kind == k and n}
        assert len(set(maps.values())) == len(maps) and all(a != b for a, b in maps.items())
    new = {m: x for _, m, x, _ in got}
    assert all(luhn(re.sub(r"\D", "", new[c])) for c in cards if luhn(re.sub(r"\D", "", c)))
    plain = lambda m: re.sub(r"\D", "", new[m])
    assert all(plain(f"{c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]}") == plain(f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}") == new[c] for c in cards[:50])
    assert all(len({plain(p)[-10:] for p in phones[k : k + 4]}) == 1 for k in range(0, len(phones), 4))
    assert all(_python_pseudonym("ssn", new[s]) for s in ssns if _python_pseudonym("ssn", s))


def test_pseudonyms_of_cards_beside_other_digits(spark):
    texts = ["4111 1111 1111 1111 123", "4111111111111111 12/27", "12 4111 1111 1111 1111", "call +15551234567 now", "31/12/1999 12/31/1999", "", None, "x" * 300_000 + " 4111111111111111"]
    out = [r["text"] for r in pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert all("4111" not in out[k] for k in (0, 1, 2, 7)) and out[0].endswith(" 123") and out[1].endswith(" 12/27") and out[2].startswith("12 ")
    assert "5551234567" not in out[3] and out[5:7] == ["", None] and "1999" not in out[4]
    assert pii.pseudonymize(spark.createDataFrame([], "doc_id long, text string, pii int"), "k").columns == ["doc_id", "text", "pii", "pii_"]


def test_pseudonyms_of_very_long_addresses(spark):
    """Linear in the text and without a stack: 100,000 labels, a long local part, an endless run, addresses that touch."""
    local = "abc1" * 50
    texts = ["x@a" + ".b" * 100_000, f"to {local}@mail.example now", "q" * 300_000 + "@x.com", "a@b.com_c@d.org", "é" + local + "@ex.org", "w" * 1024 + "@x.com", "." * 100_000, "1." * 50_000]
    out = [r["text"] for r in pii.pseudonymize(spark.createDataFrame([(t,) for t in texts], "text string"), "k").collect()]
    assert out[0].endswith("@a" + ".b" * 100_000) and out[0][0] != "@" and len(out[0]) == len(texts[0])
    for old, new in ((texts[1], out[1]), (texts[4], out[4])):
        assert new != old and local not in new and all(local[k : k + 16] not in new for k in range(0, 184)) and len(new) == len(old)
    assert out[2] == texts[2] and out[6:] == texts[6:]
    assert out[3].split("@")[1].startswith("b.com") and out[3].endswith("@d.org") and "_c@" not in out[3]
    assert out[5] != texts[5] and out[5].endswith("@x.com")


def test_feistel_numbers_are_a_permutation(spark):
    n = spark.range(189 * 7).select(pii.feistel_number(F.col("id"), (189, 7), "k", "t").alias("v"))
    assert sorted(r["v"] for r in n.collect()) == list(range(189 * 7))


def test_archives_share_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MAX_PARTITIONS", 3)
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i % 40}</p>" * 20) for i in range(200)], "page_id long, url string, html string")
    path = f"{tmp_path}/w"
    index = warc.write_warc(warc.warc_records(pages), path, archive_bytes=1000)
    assert index.select("archive").distinct().count() > 20
    out = warc.read_records(index, path, most=500).collect()
    assert sorted(r["page_id"] for r in out) == list(range(200))
    assert all(r["refers_to"] == (None if r["page_id"] >= 160 else r["page_id"] % 40 + 160) for r in out)


def test_warc_round_trip(spark):
    pages = [(1, "http://a/ü\r\nx", "<p>é</p>", "q"), (2, None, "<p>é</p>", "q"), (3, "http://c", None, "q"), (4, "http://d", "", "q"), (5, "http://e", "x" * 100_000, "q")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest string")
    path = common.scratch_path(spark, "warc")
    index = warc.write_warc(warc.warc_records(df), path, archive_bytes=300)
    out = {r["page_id"]: r for r in warc.read_records(index, path).collect()}
    assert {k: (r["record_type"], r["refers_to"], r["payload_bytes"]) for k, r in out.items()} == {1: ("revisit", 2, 9), 2: ("response", None, 9), 3: ("revisit", 4, 0), 4: ("response", None, 0), 5: ("response", None, 100_000)}
    assert bytes(out[2]["payload"]).decode() == "<p>é</p>"
    some = warc.read_records(index.where("page_id = 5"), path).collect()
    assert len(some) == 1 and some[0]["payload_bytes"] == 100_000


def test_warc_of_empty_tables_and_repeated_rows(spark):
    schema = "page_id long, url string, html string"
    path = common.scratch_path(spark, "warc")
    index = warc.write_warc(warc.warc_records(spark.createDataFrame([], schema)), path)
    assert warc.read_records(index, path).count() == 0
    path = common.scratch_path(spark, "warc")
    rows = [(7, "http://a", "x" * 50)] * 400 + [(None, None, None)] * 3
    index = warc.write_warc(warc.warc_records(spark.createDataFrame(rows, schema)), path, archive_bytes=10_000)
    out = warc.read_records(index, path).collect()
    assert len(out) == 403 and sum(r["page_id"] == 7 for r in out) == 400 and index.groupBy("archive").count().agg(F.max("count")).first()[0] < 120


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(WORDS, 30)).replace("w", "abcd") + (" vile" if i % 6 == 0 else "")) for i in range(600)] + [(9000, None), (9001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(600) if i % 12 < 6] + [(None, 1), (3, None)], "doc_id long, toxic int")
    out = {r["doc_id"]: r["toxicity"] for r in toxicity.toxicity_scores(docs, labels).collect()}
    held = [i for i in range(600) if out[i]["held_out"]]
    assert held == [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i]["predicted"] == (i % 6 == 0) for i in held) and all(0 <= t["score"] <= 1 for t in out.values())
    none = toxicity.toxicity_scores(docs.limit(0), labels.limit(0))
    assert none.count() == 0


def test_toxicity_of_rows_without_id(spark):
    """Half a table without ids doesn't train; its rows are scored, and a column of the result's name stays."""
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(WORDS, 30)).replace("w", "abcd") + (" vile" if i % 6 == 0 else "") for i in range(600)]
    docs = spark.createDataFrame([*enumerate(texts), *((None, t) for t in texts)], "doc_id long, text string").withColumn("toxicity", F.lit("own"))
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(600) if i % 12 < 6], "doc_id long, toxic int")
    rows, _ = toxicity.training_rows(docs, labels, F.lit(False), "doc_id", "text", "toxic", 10_000)
    assert rows.where("doc_id is null").count() == 0 and rows.where("not positive").count() == 600
    out = toxicity.toxicity_scores(docs, labels)
    assert out.columns == ["doc_id", "text", "toxicity", "toxicity_"] and out.where("toxicity <> 'own'").count() == 0
    assert out.where("(toxicity_.predicted = 1) <> (text like '%vile')").count() == 0


@pytest.mark.parametrize("toxic_of_20, copied", [(7, False), (12, False), (9, True)])
def test_toxicity_where_toxic_texts_are_common(spark, toxic_of_20, copied):
    """Priors of 0.35, 0.6 and 0.45; in the last, one toxic text is copied into a third of the rows."""
    rng = np.random.default_rng(1)
    toxic = [i % 20 < toxic_of_20 for i in range(1200)]
    texts = [" ".join(rng.choice(WORDS, 30)).replace("w", "abcd") + (" vile" if t else "") for t in toxic]
    texts = [texts[0] if copied and t and i % 20 < 7 else x for i, (x, t) in enumerate(zip(texts, toxic, strict=True))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic) if i % 40 < 20], "doc_id long, toxic int")
    out = {r["doc_id"]: r["toxicity"] for r in toxicity.toxicity_scores(docs, labels).collect()}
    held = [i for i in out if out[i]["held_out"]]
    assert sum(out[i]["predicted"] == toxic[i] for i in held) >= 0.99 * len(held)


def test_encoder_equals_tokenizer_on_random_texts(monkeypatch):
    """Words, spaces and marks in any order, also where a long text is taken in parts of a few characters."""
    rng = np.random.default_rng(11)
    bits = ["a", "b", "Zé", " ", "  ", "\n", "\t", ".", ",", "don't", "日本", "12", "3.5", "ñ!", "…", " ", "<|endoftext|>", "-", "_", "'s", "\r\n", " x", " y", "​", "Ⅷ"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 14))) for _ in range(4000)]
    enc = packing.Encoder(packing.default_tokenizer())
    want = [plain_ids(t) for t in texts]
    for most in (40, 1 << 20):
        monkeypatch.setattr(packing, "PART_CHARS", most)
        assert [g.tolist() for g in enc.documents(iter(texts))] == want
