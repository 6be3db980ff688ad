"""Filter audit and quality rules against plain Python, on hard rows, and quality against held-out labels."""

import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipcurate.llm import filter_audit, quality_rules
from clipcurate.llm.queries import op12_filter_audit, op13_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, n long, mask string, votes int, quality string"


def hard_rows(seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = [f"wo{x}" for x in range(300)] + ["The", "AND", "a|b", "x#", "été"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    rows = [(i, text(int(rng.integers(0, 120))), f"s{i % 3}") for i in range(80)]
    rows += [(100, None, None), (101, "", "s0"), (102, "", "s0"), (None, rows[1][1], "s0"), (None, text(70), None), (50, rows[2][1], "s9"), (2, rows[2][1], "s0"), (2, rows[2][1], "s2"), (3, text(60), "s1")]
    rows += [(103, "ab cd\n" * 70 + "\n \n\tab cd", "s1"), (104, "one two three one two three one", "s1"), (105, "a\x0bb\x0cc\rd\te f\ne", "s1"), (106, "Word. " * 30_000, "s2"), (107, " \n\t", "s2")]
    return [(*r, 1, "x", 2, None) for r in rows]


def plain_fails(rows):
    smallest = {}
    for i, t, *_ in rows:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)
    out = []
    for i, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        capitals = len(re.findall("[A-Z]", t))
        out.append((len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * capitals > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > smallest[t]))
    return out


def plain_audit(rows, good, toxic):
    """Every order applied to every part, row by row."""
    fails, want = plain_fails(rows), {}
    for part in {r[2] or "" for r in rows}:
        own = [(r, f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        totals = dict.fromkeys(range(5), 0)
        for order in permutations(range(5)):
            left = own
            for step, k in enumerate(order, 1):
                gone = [x for x in left if x[1][k]]
                left = [x for x in left if not x[1][k]]
                every = sum(f[k] for _, f in own)
                want[part, "".join("ABCDE"[x] for x in order), step] = [
                    len(left), len(gone), every - len(gone), sum(f[k] and sum(f) == 1 for _, f in own), sum(r[0] in good for r, _ in gone), sum(r[0] in toxic for r, _ in gone), k,
                ]
                totals[k] += len(gone)
        for key, v in want.items():
            if key[0] == part:
                v[-1] = totals[v[-1]]
    return want


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    path, rows = str(tmp_path_factory.mktemp("hard")), hard_rows()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 110, 3)] + [(2, 0, 1), (2, 1, None), (None, 1, 1), (None, 1, 1), (999, 1, 1), (4, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, labels


def test_audit_equals_every_order_applied(spark, hard):
    path, rows, labels = hard
    good, toxic = ({i for i, *m in labels if m[k] == 1 and i is not None} for k in (0, 1))
    out = op12_filter_audit(spark, path)
    got = {(r["part"], r["filter_order"], r["step"]): [r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]] for r in out.collect()}
    assert got == plain_audit(rows, good, toxic) and len(got) == 600 * len({r[2] or "" for r in rows})


def test_survivors_of_every_set(spark, hard):
    path, rows, _ = hard
    docs = spark.read.parquet(f"{path}/documents.parquet")
    filters = {"R": filter_audit.REPEATS, "x": F.col("text").contains("#"), "n": F.col("text").isNull() & F.lit(None)}
    masks = filter_audit.failure_masks(docs, filters)
    counts = filter_audit.mask_counts(masks, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = {(r["part"], r["filters"]): r["kept"] for r in filter_audit.filter_survivors(counts, "Rxn").collect()}
    fails = [{"R": f[4], "x": "#" in (r[1] or ""), "n": False} for f, r in zip(plain_fails(rows), rows, strict=True)]
    for (part, chosen), kept in got.items():
        assert kept == sum((r[2] or "") == part and not any(f[x] for x in chosen) for r, f in zip(rows, fails, strict=True))
    assert len(got) == 8 * len({r[2] or "" for r in rows})


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(docs, labels, {"A": F.col("text").isNull()}).count() == 0
    with pytest.raises(ValueError):
        filter_audit.audit_filters(docs, labels, {"AB": F.col("text").isNull()})


def test_zeta_sums_over_subsets():
    counts = np.random.default_rng(1).integers(0, 9, (2, 16))
    want = [[sum(row[m] for m in range(16) if m & s == m) for s in range(16)] for row in counts]
    assert filter_audit.subset_zeta(counts).tolist() == want


def plain_measures(t):
    w = WORD.findall(t or "")
    at = {}
    for k in range(len(w) - 2):
        at.setdefault(tuple(w[k : k + 3]), []).append(k)
    covered = {k + d for ks in at.values() if len(ks) > 1 for k in ks for d in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_plain_counts(spark, hard):
    path, rows, _ = hard
    out = op13_quality_rules(spark, path).collect()
    failed = lambda m: m[0] < 50 or 100 * m[4] > 50 * m[0]
    want = sorted(((r[0], *(m := plain_measures(r[1])), failed(m)) for r in rows), key=str)
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out), key=str)
    assert got == want and not any(r["kept"] and r["base_failed"] for r in out)


def plain_em(votes, prior, rounds=30):
    """Expectation-maximisation over single texts, with matrices."""
    v = np.array(votes)
    (a0, an), (b0, bn), (g0, gn) = prior.right_on_good, prior.right_on_bad, prior.good
    a, b, g = np.full(v.shape[1], a0), np.full(v.shape[1], b0), g0
    post = lambda: 1 / (1 + np.exp(-(np.log(g / (1 - g)) + np.where(v == 1, np.log(a / (1 - b)), np.where(v == -1, np.log((1 - a) / b), 0)).sum(axis=1))))
    for _ in range(rounds):
        p = post()
        a = ((v == 1).T @ p + a0 * an) / ((v != 0).T @ p + an)
        b = ((v == -1).T @ (1 - p) + b0 * bn) / ((v != 0).T @ (1 - p) + bn)
        g = (p.sum() + g0 * gn) / (len(p) + gn)
    return post(), g, a, b


def test_fit_equals_plain_em(spark):
    rng = np.random.default_rng(2)
    good = rng.random(600) < 0.8
    votes = np.where(rng.random((600, 4)) < 0.3, 0, np.where(rng.random((600, 4)) < np.where(good[:, None], 0.95, 0.5), 1, -1) * 1)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(votes)], "i int, votes array<int>")
    model = quality_rules.fit(df, 4)
    m = model.first()["model"]
    p, g, a, b = plain_em(votes, quality_rules.Prior())
    assert m["good"] == pytest.approx(g) and m["right_on_good"] == pytest.approx(list(a)) and m["right_on_bad"] == pytest.approx(list(b))
    got = df.crossJoin(model).select("i", quality_rules.posterior(F.col("votes"), F.col("model"), 4).alias("p")).orderBy("i").collect()
    assert [r["p"] for r in got] == pytest.approx(list(p))


def test_judges_keep_clean_texts_and_find_junk(spark):
    """Against the labels, which no rule has seen; nothing is dropped where all texts are clean."""
    sf = "/root/testdata/sf0.01"
    out = op13_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    for label in (0, 1):
        own = [r["kept"] == bool(label) for r in out if r["quality"] is not None and r[-2] == label]
        assert np.mean(own) >= 0.97
    clean = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id")
    judged = quality_rules.judge_quality(clean)
    assert judged.where("not base_failed and not kept").count() <= 0.01 * clean.count()


def test_keep_good_keeps_columns_and_handles_nothing(spark, hard):
    path, rows, _ = hard
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = quality_rules.keep_good(docs)
    assert kept.columns == [*docs.columns, "quality_"]
    judged = quality_rules.judge_quality(docs)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r["doc_id"] for r in judged.where("kept").collect()), key=str)
    none = spark.createDataFrame([], SCHEMA)
    assert quality_rules.judge_quality(none).count() == 0 and quality_rules.keep_good(none).count() == 0
