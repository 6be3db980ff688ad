"""Operators on small inputs with known answers, and every query against its SQL at the smallest scale."""

import hashlib
import math
import os
import pathlib
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from clipcurate.jobs import queries as jobs
from clipcurate.operators import camera, compare, embed, experiment, gate, profile, ridge, sampling, signals, subset
from clipcurate.sources import ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FRAME = "episode_hash string, lab string, frame_idx int, left_ee array<double>, right_ee array<double>, head array<double>, left_kp array<double>, right_kp array<double>"


def pose(x, y=0.0, z=0.0):
    return [float(x), float(y), float(z), 0.0, 0.0, 0.0, 1.0]


def test_signals_edges(spark):
    kp = [0.0, 0.0, -1.0] * 3
    rows = [("still", "a", t, pose(1), pose(2), pose(0), kp, kp) for t in range(62)]
    rows += [("one", "a", 0, pose(1), None, None, None, None), ("nan", "a", 0, pose(math.nan), pose(1), pose(0), kp, kp), ("nan", "a", 1, pose(math.inf), pose(1), pose(0), kp, kp)]
    out = {r["episode_hash"]: r for r in signals.quality_signals(spark.createDataFrame(rows, FRAME)).collect()}
    s = out["still"]
    assert s["frozen_frac_max"] == 1.0 and s["frozen_run_left_ee"] == 61 and s["frozen_run_max_s"] > 2 and s["offaxis_max"] == 0.0
    o = out["one"]
    assert o["hand_jitter_frac"] == 1.0 and o["path_len_total"] == 0 and o["nan_right_ee"] == 1.0 and o["offaxis_deg_max"] == 90.0 and o["frozen_frac_max"] == 1.0
    assert out["nan"]["nan_left_ee"] == pytest.approx(1 / 7)
    dead = {r["episode_hash"]: r for r in signals.candidate_signals(spark.createDataFrame(rows, FRAME)).collect()}
    assert dead["still"]["dead_air_frac"] == pytest.approx(2.0)


def test_gate_is_strict_and_orders_reasons(spark):
    rows = [("a", "rl2", 0.05, 2.0, 3.0, 0.9), ("b", "rl2", 0.06, 2.5, 2.0, 0.9), ("c", "x", math.nan, None, 100.0, 0.9)]
    out = {r["k"]: r for r in gate.apply_gate(spark.createDataFrame(rows, "k string, lab string, nan_max double, frozen_run_max_s double, duration_s double, offaxis_max double")).collect()}
    assert out["a"]["drop_reason"] == "off_axis" and out["b"]["drop_reason"] == "nan_tracking|frozen|too_short|off_axis" and out["c"]["drop_reason"] == "runaway"
    nolab = gate.apply_gate(spark.createDataFrame(rows, "k string, other string, a double, b double, c double, offaxis_max double"))
    assert nolab.where("not keep").count() == 0


def test_trim_and_join(spark):
    f = spark.createDataFrame([("a", t) for t in range(5)] + [("b", 0), ("c", 7)], "episode_hash string, frame_idx int")
    attrs = spark.createDataFrame([("a", 3), ("b", 0)], "episode_hash string, total_frames int")
    assert ingest.trim_padding(f, attrs).count() == 5


def test_exact_tests():
    assert compare.sign_p(24, 40) == pytest.approx(0.268187, abs=1e-6)
    assert compare.wilcoxon_p(0, 40, False) == pytest.approx(1.8189894035458565e-12, rel=1e-9)
    assert compare.wilcoxon_p(2, 40, False) == pytest.approx(5.4569682106375694e-12, rel=1e-9)
    assert compare.wilcoxon_p(361, 40, False) == pytest.approx(0.5185272742000961, rel=1e-9)
    assert compare.wilcoxon_p(1, 10, False) == pytest.approx(0.00390625)
    assert compare.wilcoxon_p(0, 0, False) is None


def test_sign_test_of_many_pairs():
    ways, total, n = 1, 0, 20_000
    tails = []
    for k in range(n // 2 + 1):
        total += ways
        tails.append(total)
        ways = ways * (n - k) // (k + 1)
    began = time.perf_counter()
    for low in (0, 200, 300, 9000, 9800, 9999):
        want = 2 * tails[low] / 2**n
        assert compare.sign_p(low, n) == pytest.approx(want, rel=1e-10) and compare.sign_p(n - low, n) == pytest.approx(want, rel=1e-10)
    assert compare.sign_p(n // 2, n) == 1.0 and 0.04 < compare.sign_p(45_300, 90_000) < 0.05
    assert time.perf_counter() - began < 10


def _by_definition(z, k, method):
    """Picks straight from what each selector maximises, over matrices of a small pool; scores rounded as stated, ties by place."""
    d, n, out = ((z[:, None] - z[None]) ** 2).sum(-1), len(z), []
    pairs = d[np.triu_indices(n, 1)]
    pairs = pairs[pairs > 1e-12]
    kernel = np.exp(-d / np.median(pairs)) + 1e-6 * np.eye(n) if len(pairs) else np.ones((n, n)) * math.exp(0) + 1e-6 * np.eye(n)
    while len(out) < min(k, n):
        rest = [j for j in range(n) if j not in out]
        if method == "kcenter":
            score = {j: d[out, j].min() if out else 0.0 for j in rest}
        elif method == "facility":
            gap = d[:, out].min(axis=1) if out else None
            score = {j: np.maximum(gap - d[:, j], 0).sum() if out else -d[:, j].sum() for j in rest}
        else:  # what is left of a point's kernel vector outside the span of the picks: a Schur complement
            inner = kernel[np.ix_(out, out)]
            score = {j: kernel[j, j] - kernel[j, out] @ np.linalg.solve(inner, kernel[out, j]) if out else kernel[j, j] for j in rest}
        out.append(max(rest, key=lambda j: (round(float(score[j]), 9), -j)))
    return out


GRID = np.array([[a, b, 0] for a in range(7) for b in range(7)], dtype=float)
HARD_POOLS = {
    "grid": GRID, None: GRID[:20], "copies": np.repeat(np.random.default_rng(0).integers(0, 4, (8, 3)), 5, axis=0).astype(float), "same": np.zeros((6, 3)), "one": GRID[3:4],
    "random": np.random.default_rng(4).normal(size=(60, 3)),
}


def _hard_points(spark):
    rows = [(pool, f"{i:03}", x.tolist(), 1) for pool, xs in HARD_POOLS.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "pool string, id string, z array<double>, block int").repartition(3)


@pytest.mark.parametrize("method", list(subset.DIGITS))
@pytest.mark.parametrize("block, candidates", [(4096, 2048), (8, 5)])
def test_selectors_are_exact_however_a_pool_is_cut(spark, method, block, candidates):
    """Grids and copies, where ties abound; picks of the definition, in one round or in many."""
    out = subset.select_varied(_hard_points(spark), 7, method, "id", "z", ["pool"], block=block, candidates=candidates).collect()
    want = [(str(p), k + 1, f"{j:03}") for p, xs in HARD_POOLS.items() for k, j in enumerate(_by_definition(xs, 7, method))]
    assert sorted((str(r["pool"]), r["rank"], r["id"]) for r in out) == sorted(want)


@pytest.mark.parametrize("block", [4096, 8])
def test_bandwidths_are_of_all_pairs(spark, block):
    out = {r["pool"]: r["gamma"] for r in subset.median_bandwidth(_hard_points(spark), "id", "z", ["pool"], block=block).collect()}
    for p, xs in HARD_POOLS.items():
        d = ((xs[:, None] - xs[None]) ** 2).sum(-1)[np.triu_indices(len(xs), 1)]
        d = d[d > 1e-12]
        assert out[p] == pytest.approx(1 / np.median(d) if len(d) else 1.0, rel=1e-12)


def test_bandwidth_of_five_thousand_points(spark):
    z = np.random.default_rng(6).normal(size=(5000, 4))
    df = spark.createDataFrame([(0, i, x.tolist()) for i, x in enumerate(z)], "pool int, id int, z array<double>")
    n2 = (z**2).sum(axis=1)
    d = (n2[:, None] + n2[None] - 2 * z @ z.T)[np.triu_indices(5000, 1)]
    assert subset.median_bandwidth(df, "id", "z", ["pool"], block=1500).first()["gamma"] == pytest.approx(1 / np.median(d), rel=1e-12)


def test_thousands_of_picks_in_few_rounds(spark):
    """k-center of 20,000 points against plain numpy, 2,000 picks."""
    z = np.random.default_rng(1).normal(size=(20_000, 8))
    df = spark.createDataFrame([(0, i, x.tolist()) for i, x in enumerate(z)], "pool int, id int, z array<double>")
    out = subset.select_varied(df, 2000, "kcenter", "id", "z", ["pool"]).orderBy("rank").collect()
    gap, want = np.full(len(z), np.inf), []
    for _ in range(2000):
        want.append(int(np.round(gap, 9).argmax()))
        gap = np.minimum(gap, ((z - z[want[-1]]) ** 2).sum(axis=1))
        gap[want] = -1
    assert [r["id"] for r in out] == want


def test_logdet_writes_coefficients_once(spark):
    n, k = 1200, 300
    z = np.random.default_rng(5).normal(size=(n, 8))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "id long, z array<double>").withColumn("p", F.lit(0))
    files = lambda: {f: f.stat().st_size for f in pathlib.Path(spark.conf.get("spark.checkpoint.dir")).rglob("*.parquet")}
    before = files()
    picks = subset.select_varied(points, k, "logdet", "id", "z", ["p"], 300, 256).collect()
    d, coef, rest, want = ((z[:, None] - z[None]) ** 2).sum(-1), np.zeros((n, k)), np.full(n, 1 + subset.JITTER), []
    kernel = np.exp(-d / np.median(d[np.triu_indices(n, 1)]))
    for m in range(k):
        j = int(np.where(np.isin(np.arange(n), want), -np.inf, np.round(rest, 12)).argmax())
        coef[:, m] = (kernel[:, j] - coef[:, :m] @ coef[j, :m]) / np.sqrt(rest[j])
        rest = np.maximum(rest - coef[:, m] ** 2, subset.FLOOR)
        want.append(j)
    assert [r["id"] for r in sorted(picks, key=lambda r: r["rank"])] == want
    assert sum(v for f, v in files().items() if f not in before) < 2.5 * 8 * n * k


def test_drops_come_in_strips():
    rng = np.random.default_rng(6)
    a, b, gap = rng.normal(size=(40, 5)), rng.normal(size=(2 * subset.STRIP + 3, 5)), rng.uniform(0, 9, 40)
    parts = list(subset.drops(gap, a, b))
    assert [p for p, _ in parts] == [0, subset.STRIP, 2 * subset.STRIP] and max(d.shape[1] for _, d in parts) == subset.STRIP
    assert np.allclose(np.hstack([d for _, d in parts]), np.maximum(gap[:, None] - ((a[:, None] - b[None]) ** 2).sum(-1), 0))


def test_no_points_no_picks(spark):
    none = spark.createDataFrame([], "pool string, id string, z array<double>")
    for method in subset.DIGITS:
        assert subset.select_varied(none, 3, method, "id", "z", ["pool"]).count() == 0
    assert subset.median_bandwidth(none, "id", "z", ["pool"]).count() == 0


def test_coverage_is_exact_and_skips_most_picks(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 6)) * 20
    z = {"a": np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 6)), None: rng.normal(size=(30, 6)), "none": rng.normal(size=(5, 6))}
    points = spark.createDataFrame([(p, i, x.tolist()) for p, xs in z.items() for i, x in enumerate(xs)], "pool string, id int, z array<double>")
    chosen = points.where("pool is distinct from 'none' and id % 2 = 0")
    out = embed.coverage(points, chosen, "id", "z", ["pool"], block=700, pivots=32).collect()
    assert len(out) == 2035
    for r in out:
        if r["pool"] == "none":
            assert r["nearest"] is None and r["compared"] == 0
        else:
            d = ((z[r["pool"]][::2] - z[r["pool"]][r["id"]]) ** 2).sum(axis=1).min()
            assert r["nearest"] == pytest.approx(d, abs=1e-9)
    assert sum(r["compared"] for r in out if r["pool"] == "a") < 0.3 * 2000 * 1000


def test_whitening_keeps_rows_of_a_null_pool(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", 5.0), ("a", math.nan), ("b", None)]
    out = embed.whiten(spark.createDataFrame(rows, "pool string, x double"), ["x"], ["pool"]).collect()
    assert sorted((str(r["pool"]), round(r["x"], 6)) for r in out) == [("None", -1.0), ("None", 1.0), ("a", -1.0), ("a", 1.0), ("b", 0.0)]


def test_take_until_of_a_null_group(spark):
    rows = [(1, None, i, 2) for i in range(10)] + [(1, "g", i, 3) for i in range(10)]
    pool = spark.createDataFrame(rows, "seed int, grp string, id int, w int")
    target = spark.createDataFrame([(1, None, 7), (1, "g", 7)], "seed int, grp string, target int")
    got = [str(r["grp"]) for r in sampling.take_until(pool, "w", target, "id", ["seed", "grp"]).collect()]
    assert got.count("None") == 4 and got.count("g") == 3


def test_pca_keeps_distances(spark):
    z = np.random.default_rng(2).normal(size=(40, 3))
    out = embed.pca_coords(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(z)], "id int, z array<double>"), "z", 2).orderBy("id").collect()
    c = z - z.mean(axis=0)
    _, _, axes = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(np.abs([r["coords"] for r in out]), np.abs(c @ axes[:2].T))


def test_exact_percentiles(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g in ("a", None, "b") for v in rng.integers(0, 9, 50)] + [("a", math.nan), ("a", None), ("c", math.nan)]
    got = profile.exact_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p10": 0.1, "p50": 0.5, "p100": 1.0}).collect()
    for r in got:
        own = [v for g, v in rows if g == r["g"] and v is not None and not math.isnan(v)]
        assert [r["p10"], r["p50"], r["p100"]] == pytest.approx(list(np.quantile(own, [0.1, 0.5, 1.0])))
    assert {r["g"] for r in got} == {"a", None, "b"}


def _windows(left, right, head, h, horizon, stride=15):
    clean = lambda a: np.nan_to_num(np.array(a, dtype=np.float32))
    seen, act = np.concatenate([clean(left), clean(right), clean(head)], axis=1), np.concatenate([clean(left), clean(right)], axis=1)
    starts = range(h, len(seen) - horizon, stride) if len(seen) > h + horizon else []
    return [(s, seen[s - h : s].ravel(), (act[s : s + horizon] - act[s - 1]).ravel()) for s in starts]


def _tracks(rng, episodes):
    rows, plain = [], {}
    for e, n in episodes.items():
        left, right, head = (rng.normal(size=(n, 3)) for _ in range(3))
        left[n // 2, 0], right[n // 3, 1] = math.nan, math.inf
        plain[e] = left, right, head
        rows += [(e, t, left[t].tolist(), None if e == "no_right" else right[t].tolist(), head[t].tolist()) for t in range(n)]
    return rows, plain


POSES = "episode_hash string, frame_idx int, left_ee array<double>, right_ee array<double>, head array<double>"


def test_windows_equal_numpy(spark):
    rows, plain = _tracks(np.random.default_rng(0), {"a": 100, "b": 41, "c": 40, "no_right": 90})
    out = ridge.episode_windows(spark.createDataFrame(rows, POSES).repartition(5), ["left_ee", "right_ee", "head"]).collect()
    got = {(r["episode_hash"], r["start"]): r for r in out}
    want = {(e, s): (x, y) for e in "abc" for s, x, y in _windows(*plain[e], 10, 30)}
    assert set(got) == set(want) and len(want) == 5
    assert all(np.array_equal(np.array(got[k]["x"], "f4"), x) and np.array_equal(np.array(got[k]["y"], "f4"), y) for k, (x, y) in want.items())


@pytest.mark.parametrize("features", [16, 150])
def test_fit_and_score_equal_numpy(spark, features):
    rng = np.random.default_rng(1)
    rows, plain = _tracks(rng, {f"e{i}": 60 + 20 * i for i in range(8)})
    for x in plain.values():
        for t in x:
            t[~np.isfinite(t)] = 0
    rows = [(e, t, left[t].tolist(), right[t].tolist(), head[t].tolist()) for e, (left, right, head) in plain.items() for t in range(len(left))]
    w = ridge.episode_windows(spark.createDataFrame(rows, POSES), ["left_ee", "right_ee", "head"])
    member = {"r1": ["e0", "e1", "e2", "e6"], "r2": ["e3", "e4"]}
    train = spark.createDataFrame([(r, e, 5) for r, es in member.items() for e in es], "run string, episode_hash string, seed int")
    sides = spark.createDataFrame([(r, s, e) for r in member for s, e in (("x", "e5"), ("x", "e7"), ("y", "e6"), ("none", "absent"))], "run string, side string, episode_hash string")
    out = {(r["run"], r["alpha"], r["side"]): r for r in ridge.fit_and_score(w, train, sides, features, (0.5, 2.0), budget=1).collect()}
    own = {e: _windows(*plain[e], 10, 30) for e in plain}
    stack = lambda es: (np.array([x for e in es for _, x, _ in own[e]], float), np.array([y for e in es for *_, y in own[e]], float))
    models = ridge.fit_models(w, train, features, 2.0)
    for run, es in member.items():
        x, y = stack(es)
        p, b = ridge.random_features(x.shape[1], features, 5)
        lift = lambda v, x=x, p=p, b=b: np.hstack([np.cos((v - x.mean(0)) / (x.std(0) + 1e-6) @ p + b), np.ones((len(v), 1))])
        for alpha in (0.5, 2.0):
            h = lift(x)
            weights = np.linalg.solve(h.T @ h + alpha * np.eye(features + 1), h.T @ y)
            for side, tested in (("x", ["e5", "e7"]), ("y", ["e6"])):
                xe, ye = stack(tested)
                assert out[run, alpha, side]["mse"] == pytest.approx(((lift(xe) @ weights - ye) ** 2).mean(), rel=1e-7) and out[run, alpha, side]["n"] == len(xe)
            assert out[run, alpha, "none"]["mse"] is None and out[run, alpha, "none"]["n"] == 0
        assert np.allclose(models[run]["w"], weights)
    errors = ridge.error_by_window(w.where("episode_hash in ('e5', 'e7')"), models["r2"]).collect()
    assert np.mean([r["mse"] for r in errors]) == pytest.approx(out["r2", 2.0, "x"]["mse"]) and sum(r["shown"] for r in errors) == 2


def test_random_features_are_normal_and_uniform():
    p, b = ridge.random_features(30, 400, 3)
    again, _ = ridge.random_features(30, 400, 3)
    assert np.array_equal(p, again) and not np.array_equal(p, ridge.random_features(30, 400, 4)[0])
    assert abs(p.mean()) < 0.01 and p.std() * 30**0.5 == pytest.approx(1, abs=0.03) and abs((np.abs(p) * 30**0.5 < 1).mean() - 0.6827) < 0.02
    assert 0 < b.min() < 0.1 and 6.1 < b.max() < 2 * math.pi and abs(b.mean() - math.pi) < 0.3


def test_experiment_and_gate_value_rows(spark):
    rng = np.random.default_rng(2)
    rows, _ = _tracks(rng, {f"e{i:02}": 80 + i for i in range(36)})
    frames = spark.createDataFrame(rows, POSES).withColumns({t: F.transform(t, lambda x: F.when(F.abs(x) < 100, x).otherwise(0.0)) for t in ("left_ee", "right_ee")})
    meta = spark.createDataFrame([(f"e{i:02}", f"o{i % 5}", f"s{i % 7}", i % 9 > 0, float(i), float(i * i % 11)) for i in range(36)], "episode_hash string, operator string, scene string, keep boolean, f_a double, f_b double")
    w = ridge.episode_windows(frames, ["left_ee", "right_ee", "head"])
    split = sampling.assign_split(meta, [0, 1])
    out = experiment.run_experiment(w, split, ["f_a", "f_b"], [0.25, 0.5], setting=experiment.Setting(features=8), least=5).collect()
    seen = {(r["seed"], r["k_frac"], r["condition"]) for r in out}
    assert len(seen) == len(out) and {c for *_, c in seen} == {"random", *experiment.VARIED, "concentrated", "random_nogate", "all_gated"}
    pool = {s: split.where(f"seed = {s} and pool_gated").count() for s in (0, 1)}
    for r in out:
        k = pool[r["seed"]] if r["condition"] == "all_gated" else max(5, int(r["k_frac"] * pool[r["seed"]]))
        assert r["n_train_eps"] == k and (r["n_groups"] == -1) == (r["condition"] == "random_nogate") and all(r[m] > 0 for m in experiment.METRICS)
    assert experiment.run_experiment(w, split, ["f_a", "f_b"], [0.25], ("random",), experiment.Setting(features=8), least=10**6).count() == 0
    sweep = experiment.sensitivity_sweep(frames, ["left_ee", "right_ee", "head"], split, ["f_a", "f_b"], (experiment.Setting(features=8), experiment.Setting(alpha=9.0, features=8), experiment.Setting(features=8, history=5)), conditions=("random", "kcenter"), least=5)
    same = {(r["seed"], r["condition"]): r[experiment.METRICS[0]] for r in sweep.where("alpha = 1 and history = 10").collect()}
    assert all(same[r["seed"], r["condition"]] == pytest.approx(r[experiment.METRICS[0]]) for r in out if r["k_frac"] == 0.25 and (r["seed"], r["condition"]) in same) and len(same) == 4
    summary = compare.sensitivity_summary(sweep, experiment.METRICS).collect()
    assert len(summary) == 3 and all(r["condition"] == "kcenter" for r in summary)
    value = experiment.gate_value(w, meta, [0, 1, 2], experiment.Setting(features=8), least=5)
    rows = value.collect()
    assert len(rows) == 12
    by = {(r["seed"], r["condition"]): r for r in rows}
    for s in (0, 1, 2):
        assert by[s, "gated_equal_episodes"]["n_train_eps"] == by[s, "ungated_equal_episodes"]["n_train_eps"]
        assert by[s, "ungated_equal_frames"]["n_train_win"] >= by[s, "gated_equal_frames"]["n_train_win"] == by[s, "gated_equal_episodes"]["n_train_win"]
    for r in compare.gate_value_summary(value).collect():
        d = [by[s, f"gated_{r['mode']}"]["avg_mse"] - by[s, f"ungated_{r['mode']}"]["avg_mse"] for s in (0, 1, 2)]
        assert (r["n"], r["wins"]) == (3, sum(x < 0 for x in d))


def test_reports(spark):
    seen = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("b", None)], "episode_hash string, n_hands int")
    out = {r["episode_hash"]: tuple(r)[1:] for r in camera.visibility_rollup(seen, spark.createDataFrame([("a",), ("b",)], "episode_hash string")).collect()}
    assert out["a"] == (3, pytest.approx(2 / 3), 1.0, 1) and out["b"][:2] == (0, None)
    attrs = spark.createDataFrame([('{"K": [[133.0, 0], [0, 133.0]]}',)] * 2 + [('{"K": [[133.0, 0], [0, 134]]}',)], "json string")
    got = ingest.attr_constancy(attrs, "json", "$.K", expected=[[133, 0], [0, 133]]).collect()
    assert [(r["episodes"], r["is_constant"], r["matches"]) for r in got] == [(2, False, True), (1, False, False)]
    log = spark.createDataFrame([("ok", 5, 9, 5.0, 1), ("ok", 5, 5, None, 0), ("error", None, None, 7.0, None)], "status string, total_frames int, padded_len int, sql_num_frames double, n_annotations int")
    assert {r["status"]: tuple(r)[1:] for r in ingest.ingest_report(log).collect()} == {"ok": (2, 0, 1, 1), "error": (1, 0, 0, 0)}


def test_splits_are_disjoint(spark):
    df = spark.createDataFrame([(i, f"o{i % 7}", f"s{i % 5}", True) for i in range(200)], "k int, operator string, scene string, keep boolean")
    out = sampling.assign_split(df, [0, 1])
    assert out.count() == out.select("seed", "k").distinct().count()
    again = sampling.assign_split(df.repartition(7), [0, 1])
    assert sorted(map(tuple, out.select("seed", "k", "split").collect())) == sorted(map(tuple, again.select("seed", "k", "split").collect()))


def test_running_sums_equal_those_of_one_window(spark):
    rows = [(None if i % 3 == 0 else i % 3, i, 1 + i % 4) for i in range(600)]
    df = spark.createDataFrame(rows, "g int, k int, w long")
    got = sampling.running(df, ["g"], sampling.hash_order(F.lit(1), "t", "k"), "k", "w").collect()
    want, sums = {}, {}
    for g, k, w in sorted(rows, key=lambda r: hashlib.md5(f"1|t|{r[1]}".encode()).hexdigest()):
        want[k] = sums[g] = sums.get(g, 0) + w
    assert len(got) == len(rows) and {r["k"]: r["__upto"] for r in got} == want and all(r["__total"] == sums[r["g"]] for r in got)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _plain(rows):
    return sorted(tuple("-" if v is None else round(float(v), 4) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["quality_signals", "gate_audit", "lab_structure", "heldout_splits", "selection_arms", "equal_footage", "signed_ranks", "select_k_center", "random_split", "picks_per_lab", "length_sanity", "sampled_frames", "flag_prevalence", "run_table", "select_log_det", "select_facility", "bandwidths", "whitened", "coverage_scores", "top_values", "episode_windows", "train_moments", "gate_arms", "episode_records", "keypoints_out_of_frame", "storage_by_array", "exemplars", "headline_stats", "lab_distributions"])
def test_query_equals_sql(spark, duck, name):
    got = jobs.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.execute(f"select {', '.join(f'\"{c}\"' for c in cols)} from ({jobs.SQL[name]})").fetchall()
    assert _plain(got.select(*cols).collect()) == _plain(want)
