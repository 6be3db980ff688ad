"""The registered queries themselves, over the driver's smallest tables, and the pipeline over a table of hard cases."""

import json
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"select doc_id, text, source from '{SF}/documents.parquet'").fetchall()


def query(spark, name, sf=SF):
    return __spark_entry__.queries()[name](spark, sf).collect()


def test_op4_is_a_permutation_with_the_texts_digests(spark, documents):
    out = {r["doc_id"]: r for r in query(spark, "op4_sharding")}
    assert len(out) == len(documents)
    for i, text, _ in documents:
        raw = (text or "").encode()
        assert (out[i]["size"], out[i]["text_crc32"], out[i]["law"], out[i]["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    shards = [sorted(r["slot"] for r in out.values() if r["shard"] == s) for s in range(8)]
    assert all(x == list(range(len(x))) for x in shards) and max(map(len, shards)) - min(map(len, shards)) <= 1


def test_op2_held_out_accuracy(spark):
    toxic = dict(duckdb.sql(f"select doc_id, max(toxic) from '{SF2}/labels.parquet' where toxic is not null group by 1").fetchall())
    out = {r["doc_id"]: r for r in query(spark, "op2_toxicity", SF2)}
    assert len(out) == duckdb.sql(f"select count(*) from '{SF2}/documents.parquet'").fetchall()[0][0]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for i, r in out.items())
    held = [i for i in toxic if i in out and out[i]["held_out"]]
    right = [out[i]["predicted"] == toxic[i] for i in held]
    assert len(held) > 30 and np.mean(right) >= 0.95


def test_op8_targets_and_taken_words(spark, documents):
    out = query(spark, "op8_source_mixing")
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in documents}
    assert all(r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"] for r in out) and len(out) == len(documents)
    by = {}
    for i, _, s in documents:
        by.setdefault(s, []).append(i)
    names = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in by if s is None]
    total, weight, open_, target = sum(size.values()), {s: 1 + k % 3 for k, s in enumerate(names)}, set(names), {}
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sum(size[i] for i in by[s])}
        if not over:
            target |= share
            break
        target |= {s: 3 * sum(size[i] for i in by[s]) for s in over}
        open_ -= over
    taken = {r["doc_id"]: r for r in out}
    for s in names:
        assert all(taken[i]["target"] == pytest.approx(target[s]) for i in by[s])
        assert abs(sum(taken[i]["taken"] for i in by[s]) - target[s]) <= max(size[i] for i in by[s])


def test_op6_places_all_tokens(spark, documents):
    from tokenizers import Tokenizer

    from clipcurate.llm import packing

    plain = Tokenizer.from_file(packing.default_tokenizer())
    out = query(spark, "op6_best_fit_packing")
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], []).append(r)
    for i, text, _ in documents:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        assert sorted((r["start"], r["length"], r["ids_crc32"]) for r in got[i]) == [(s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for s, n in packing.cut(len(ids), 1024)]
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(places) <= 1.03 * -(-sum(r["length"] for r in out) // 1024) + 1


def test_op7_equals_brute_force(spark, documents):
    import xxhash

    out = {r["doc_id"]: r for r in query(spark, "op7_simhash_dedup")}
    fp = {}
    for i, text, _ in documents:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        h = np.array([xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else [], dtype=np.uint64)
        fp[i] = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
    assert {i: r["fingerprint"] for i, r in out.items()} == {i: f"{x:016x}" for i, x in fp.items()}
    label = {i: i for i in fp}
    for _ in range(20):
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 4:
                    label[a] = min(label[a], label[b])
    assert {i: r["component_id"] for i, r in out.items()} == label


def test_pipeline_of_hard_cases(spark, tmp_path):
    """Null ids, repeated ids with other texts, equal rows, empty and null texts, a long text, columns of results' names."""
    rng = np.random.default_rng(3)
    words = [f"abcd{x}" for x in rng.integers(0, 10**6, 3000)]
    text = lambda n: " ".join(rng.choice(words, n))
    rows = [(i, text(80) + (" vile" if i % 5 == 0 else ""), "en", f"s{i % 3}") for i in range(300)]
    base = text(200)
    rows += [(1000, base, "en", "s0"), (1001, base + " more", "en", "s0"), (1001, text(150), "en", "s1"), (None, base.upper(), "en", "s1"), (None, text(90), None, None), (1002, None, "en", "s0"), (1003, "", "en", "s1")]
    rows += [(1004, text(60), "en", "s2")] * 3 + [(1005, "long " * 60_000, "en", "s2")]
    rows = [(*r, len(r[1] or ""), json.dumps(r[0]), None) for r in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxicity string, ids binary").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 300, 2)] + [(None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        counts[name] = out.count()
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
    kept = len(rows) - 60
    assert counts["toxicity"] == kept and docs.where("text like '%vile'").count() == 0
    assert counts["exact_dedup"] == kept - 1 - 1 - 2  # upper case copy, null and empty, repeats
    assert counts["simhash_dedup"] == counts["exact_dedup"] - 1
    out = corpus_pipeline.run(spark, str(tmp_path))
    lengths = out.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert lengths and all(r[1] <= 1024 for r in lengths)
