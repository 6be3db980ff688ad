"""Paired comparisons of runs: deltas, wins, exact tests and summaries."""

from __future__ import annotations

from math import comb, erfc, exp, log, log1p, pi, sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipcurate.operators.profile import exact_percentiles, running_sums


def paired_deltas(runs: DataFrame, keys: list[str], metrics: list[str], baseline: str) -> DataFrame:
    """(keys, condition, metric, delta, pct) of every run against the baseline's run with the same keys."""
    base = runs.where(F.col("condition") == baseline).select(*keys, *[F.col(m).alias(f"__{m}") for m in metrics])
    both = runs.where(F.col("condition") != baseline).join(base, keys)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(f"__{m}").alias("base")) for m in metrics])).alias("x")
    return both.select(*keys, "condition", each).select(*keys, "condition", "x.metric", (F.col("x.value") - F.col("x.base")).alias("delta"), (100.0 * (F.col("x.value") / F.col("x.base") - 1)).alias("pct"))


def delta_summary(deltas: DataFrame, by: list[str]) -> DataFrame:
    return deltas.groupBy(*by).agg(F.count("delta").alias("n_pairs"), F.avg("pct").alias("mean_pct"), F.count_if(F.col("delta") < 0).alias("wins"))


#: Pairs up to which the sign test adds whole numbers.
WHOLE = 1000


def _stirling(n: int) -> float:
    """What Stirling's formula leaves of ln n!."""
    return 1 / (12 * n) - 1 / (360 * n**3) + 1 / (1260 * n**5)


def sign_p(wins: int, n: int) -> float:
    """Exact two-sided binomial p at one half: all outcomes no likelier than the observed one, which are both tails from it on. Of
    more than ``WHOLE`` pairs the outermost term follows from Stirling's series and the others from it, until none counts in a
    double: a few times the root of n."""
    low = min(wins, n - wins)
    if 2 * low >= n:
        return 1.0
    if n <= WHOLE:
        return min(1.0, 2 * sum(comb(n, k) for k in range(low + 1)) / 2**n)
    if low <= WHOLE // 4:  # small whole numbers, where the series is no good
        return exp(log(2 * sum(comb(n, k) for k in range(low + 1))) - n * log(2))
    x = (n - 2 * low) / n
    term = exp(-n / 2 * ((1 + x) * log1p(x) + (1 - x) * log1p(-x)) + _stirling(n) - _stirling(low) - _stirling(n - low)) * sqrt(n / (2 * pi * low * (n - low)))
    total, k = 0.0, low
    while k >= 0 and term > total * 1e-17:
        total += term
        term *= k / (n - k + 1)
        k -= 1
    return min(1.0, 2 * total)


def wilcoxon_p(smaller: float, n: int, tied: bool, ties: float = 0.0) -> float | None:
    """Two-sided p of a smaller rank sum: exact if there are no ties and at most 50 pairs, else by the normal law."""
    if not n:
        return None
    if not tied and n <= 50:
        ways = [1]
        for r in range(1, n + 1):  # number of subsets of the ranks with each sum
            new = ways + [0] * r
            for s, w in enumerate(ways):
                new[s + r] += w
            ways = new
        return min(1.0, 2 * sum(ways[: int(smaller) + 1]) / 2**n)
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return erfc(abs(smaller - mean) / sqrt(2 * var)) if var > 0 else 1.0


def significance(deltas: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, wins, mean_pct, rank_minus, rank_plus, p_sign, p_wilcoxon): ranks of non-zero |delta| by running sums of
    the counts of each size (ties share the mean rank); the tests themselves see one row a group."""
    nonzero = deltas.where("delta <> 0").withColumn("size", F.abs("delta"))
    sizes = nonzero.groupBy(*by, "size").agg(F.count(F.lit(1)).alias("run"), F.count_if(F.col("delta") < 0).alias("minus"))
    ranked = running_sums(sizes, by, "size", "run").withColumn("rank", F.col("before") + (F.col("run") + 1) / 2)
    sums = ranked.groupBy(*by).agg(
        F.sum(F.col("rank") * F.col("minus")).alias("rank_minus"), F.sum(F.col("rank") * (F.col("run") - F.col("minus"))).alias("rank_plus"),
        F.sum("run").alias("nonzero"), F.max("run").alias("longest"), F.sum(F.col("run").cast("double") ** 3 - F.col("run")).alias("ties"),
    )
    counts = delta_summary(deltas, by).withColumnRenamed("n_pairs", "n")

    @F.pandas_udf("p_sign double, p_wilcoxon double")
    def tests(wins: pd.Series, n: pd.Series, minus: pd.Series, plus: pd.Series, nonzero: pd.Series, longest: pd.Series, ties: pd.Series) -> pd.DataFrame:
        rows = [(sign_p(int(a), int(b)), wilcoxon_p(min(c, d), int(e), f > 1, g)) for a, b, c, d, e, f, g in zip(wins, n, minus, plus, nonzero, longest, ties, strict=True)]
        return pd.DataFrame(rows, columns=["p_sign", "p_wilcoxon"]).astype("float64")

    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = counts.join(sums, by, "left").withColumn("p", tests("wins", "n", zero(F.col("rank_minus")), zero(F.col("rank_plus")), F.coalesce("nonzero", F.lit(0)), F.coalesce("longest", F.lit(1)), zero(F.col("ties"))))
    return out.select(*by, "n", "wins", "mean_pct", "rank_minus", "rank_plus", "p.p_sign", "p.p_wilcoxon")


def summarize_runs(runs: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean and sample deviation of each metric."""
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), *[f(m).alias(f"{m}_{k}") for m in metrics for k, f in (("mean", F.avg), ("std", F.stddev_samp))])


def consistency(deltas: DataFrame, config: list[str]) -> DataFrame:
    """Per condition: configurations whose mean beats the baseline, of how many, the mean and the worst of them."""
    each = deltas.groupBy("condition", *config).agg(F.avg("pct").alias("pct"))
    return each.groupBy("condition").agg(F.count_if(F.col("pct") < 0).alias("better"), F.count(F.lit(1)).alias("configs"), F.avg("pct").alias("mean_pct"), F.max("pct").alias("worst_pct"))


def pivot_runs(runs: DataFrame, rows: str, conditions: list[str], metric: str) -> DataFrame:
    return runs.groupBy(rows).pivot("condition", conditions).agg(F.first(metric))


def gap_closed(runs: DataFrame, metric: str, baseline: str, best: str, ceiling: str) -> DataFrame:
    """One row: percent of the way from the baseline's mean to the ceiling's that the best condition goes."""
    mean = lambda c: F.avg(F.when(F.col("condition") == c, F.col(metric)))
    return runs.agg(mean(baseline).alias("baseline"), mean(best).alias("best"), mean(ceiling).alias("ceiling")).withColumn("gap_closed", 100.0 * (F.col("baseline") - F.col("best")) / (F.col("baseline") - F.col("ceiling")))


def sensitivity_summary(sweep: DataFrame, metrics: tuple[str, ...], config: tuple[str, ...] = ("alpha", "n_features", "history", "horizon"), baseline: str = "random") -> DataFrame:
    """(condition, config, a mean percent for each metric) against the baseline's run of the same setting and seed."""
    deltas = paired_deltas(sweep, [*config, "seed"], list(metrics), baseline)
    return deltas.groupBy("condition", *config).pivot("metric", list(metrics)).agg(F.avg("pct"))


def gate_value_summary(runs: DataFrame, modes: tuple[str, ...] = ("equal_episodes", "equal_frames"), metric: str = "avg_mse") -> DataFrame:
    """(mode, mean errors and sizes of both arms, n, wins, mean_pct, p_sign, p_wilcoxon) of the gated against the ungated arm of
    each seed."""
    arm, mode = F.substring_index("condition", "_", 1), F.substring(F.col("condition"), F.instr("condition", "_") + 1, F.length("condition"))
    split = runs.select("seed", arm.alias("condition"), mode.alias("mode"), metric, "n_train_eps", "n_train_win").where(F.col("mode").isin(*modes))
    of = lambda a, c: F.avg(F.when(F.col("condition") == a, F.col(c)))
    means = split.groupBy("mode").agg(*[of(a, c).alias(f"{a}_{k}") for a in ("gated", "ungated") for c, k in ((metric, "mse"), ("n_train_eps", "eps"), ("n_train_win", "win"))])
    tests = significance(paired_deltas(split, ["seed", "mode"], [metric], "ungated"), ["mode"])
    return means.join(tests.drop("rank_minus", "rank_plus"), "mode")


def headline_stats(gated: DataFrame, length: str = "duration_s", fraction: float = 0.25, least: int = 5) -> DataFrame:
    """One row: episodes, dropped, percent dropped, pool, the budget at ``fraction``, median length, longest dropped."""
    gone = ~F.col("keep")
    out = gated.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(gone).alias("n_dropped"), F.max(F.when(gone, F.col(length))).alias("longest_dropped"))
    out = out.join(F.broadcast(exact_percentiles(gated, [], length, {"median_dur": 0.5})), how="left")  # one row each
    pool = F.col("n_total") - F.col("n_dropped")
    return out.select("*", (100.0 * F.col("n_dropped") / F.col("n_total")).alias("pct_dropped"), pool.alias("n_pool"), F.greatest(F.lit(least), F.floor(pool * fraction)).cast("long").alias("k"))


def condition_headline(runs: DataFrame, metric: str, baseline: str = "random") -> DataFrame:
    """(condition, mean, pct) of each condition's mean against the mean of the baseline."""
    means = runs.groupBy("condition").agg(F.avg(metric).alias("mean"))
    base = F.broadcast(means.where(F.col("condition") == baseline).select(F.col("mean").alias("__base")))  # one row
    return means.join(base, how="cross").select("condition", "mean", (100.0 * (F.col("mean") / F.col("__base") - 1)).alias("pct"))


def export_episodes_json(gated: DataFrame, operators: DataFrame, scenes: DataFrame, key: str = "episode_hash", coords: str | None = None) -> DataFrame:
    """(episode, json): a record for a page, with ordinal codes of operator and scene, the length to a tenth, the motion to a
    thousandth, the decision and its reason, and two coordinates if there are any. No NaN or infinity gets out: they are null."""
    own = gated.withColumn("__op", F.coalesce(F.col("operator").cast("string"), F.lit(""))).withColumn("__sc", F.coalesce(F.col("scene").cast("string"), F.lit("")))
    own = own.join(operators.select(F.col("value").alias("__op"), F.col("code").alias("op")), "__op", "left").join(scenes.select(F.col("value").alias("__sc"), F.col("code").alias("sc")), "__sc", "left")
    finite = lambda c, digits: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.round(c, digits))
    place = [] if coords is None else [finite(F.get(coords, F.lit(k)), 4).alias(a) for k, a in enumerate("xy")]
    record = F.struct(*place, F.coalesce("op", F.lit(0)).alias("op"), F.coalesce("sc", F.lit(0)).alias("sc"), finite(F.col("duration_s").cast("double"), 1).alias("dur"), finite(F.col("motion_energy").cast("double"), 3).alias("motion"), "keep", F.col("drop_reason").alias("why"))
    return own.select(key, F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))
