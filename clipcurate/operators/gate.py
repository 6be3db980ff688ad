"""Threshold rules that give every dropped episode a reason, and audits of what they drop."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipcurate.functions.numbers import number, test
from clipcurate.operators.profile import exact_percentiles


@dataclass(frozen=True)
class GateRule:
    """``signal op bound`` drops an episode; with ``of_median`` the bound is a multiple of the signal's median, with ``labs``
    the rule holds for these only."""

    name: str
    signal: str
    op: str
    bound: float
    meaning: str
    of_median: bool = False
    labs: tuple[str, ...] = ()

    @property
    def text(self) -> str:
        return f"{self.op} {self.bound:g}" + " x median" * self.of_median


# fixed values: thresholds of the gate
RULES = (
    GateRule("nan_tracking", "nan_max", ">", 0.05, "tracking lost"),
    GateRule("frozen", "frozen_run_max_s", ">", 2.0, "track stands still"),
    GateRule("too_short", "duration_s", "<", 3.0, "too short"),
    GateRule("no_motion", "path_len_total", "<", 0.10, "hands do not move"),
    GateRule("jitter", "hand_jitter_frac", ">", 0.01, "hands jump"),
    GateRule("head_jump", "head_speed_max", ">", 20.0, "head jumps"),
    GateRule("off_axis", "offaxis_max", ">", 0.50, "hands out of view", labs=("rl2",)),
    GateRule("runaway", "duration_s", ">", 3.0, "far longer than usual", of_median=True),
    GateRule("fragment", "duration_s", "<", 0.15, "far shorter than usual", of_median=True),
)
#: What is comparable between labs.
CROSS_LAB = tuple(r for r in RULES if r.name not in ("jitter", "head_jump", "off_axis"))


def apply_gate(df: DataFrame, rules: tuple[GateRule, ...] = RULES, median_scope: tuple[str, ...] = (), missing: str = "pass", lab: str = "lab") -> DataFrame:
    """Adds ``rule_*``, ``drop_reason`` (names joined by '|', in the order of the rules) and ``keep``.

    Tests are strict. A missing signal passes (``missing="drop"``: fails); a signal that is no column never fails; a rule for
    some labs needs the column ``lab``. Medians skip NaN and are taken over ``median_scope`` groups, or all rows.
    """
    out = df
    signals = sorted({r.signal for r in rules if r.of_median and r.signal in df.columns})
    if signals:
        for sig in signals:
            few = exact_percentiles(df, list(median_scope), sig, {f"__median_{sig}": 0.5})
            few = few.select(*[F.col(c).alias(f"__{c}") for c in median_scope], f"__median_{sig}")
            on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in median_scope]
            out = out.join(few, on, "left") if on else out.join(F.broadcast(few), how="left")  # without a scope: one row
            out = out.drop(*(f"__{c}" for c in median_scope))
    for r in rules:
        if r.signal not in df.columns or r.labs and lab not in df.columns:
            flag = F.lit(False)
        else:
            bound = F.col(f"__median_{r.signal}") * r.bound if r.of_median else r.bound
            flag = test(F.col(r.signal), r.op, bound)
            if missing == "drop":
                flag = flag | number(F.col(r.signal)).isNull()
            if r.labs:
                flag = flag & F.coalesce(F.col(lab).isin(*r.labs), F.lit(False))
        out = out.withColumn(f"rule_{r.name}", flag)
    reason = derive_reason(rules)
    return out.drop(*(f"__median_{s}" for s in signals)).withColumn("drop_reason", reason).withColumn("keep", F.col("drop_reason") == "")


def derive_reason(rules: tuple[GateRule, ...] = RULES) -> Column:
    return F.concat_ws("|", *[F.when(F.col(f"rule_{r.name}"), r.name) for r in rules])


def gate_audit(gated: DataFrame, rules: tuple[GateRule, ...] = RULES) -> DataFrame:
    """(rule, signal, test, n_flagged, pct, meaning) for each rule, and for ANY of them: one pass."""
    counts = gated.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f"rule_{r.name}").alias(r.name) for r in rules], F.count_if(~F.col("keep")).alias("ANY"))
    rows = [(r.name, r.signal, r.text, r.meaning) for r in rules] + [("ANY", "", "", "any rule")]
    lines = F.array(*[F.struct(F.lit(a).alias("rule"), F.lit(b).alias("signal"), F.lit(c).alias("test"), F.col(a).alias("n_flagged"), (100.0 * F.col(a) / F.col("n")).alias("pct"), F.lit(d).alias("meaning")) for a, b, c, d in rows])
    return counts.select(F.explode(lines).alias("x")).select("x.*")


def cross_group_audit(signals: DataFrame, by: str = "lab", rules: tuple[GateRule, ...] = CROSS_LAB) -> DataFrame:
    """Per group: episodes, percent that each rule flags (medians of the group), ANY, median duration and motion."""
    gated = apply_gate(signals, rules, median_scope=(by,))
    pct = [(100.0 * F.avg(F.col(f"rule_{r.name}").cast("double"))).alias(f"pct_{r.name}") for r in rules]
    out = gated.groupBy(by).agg(F.count(F.lit(1)).alias("n_episodes"), *pct, (100.0 * F.avg((~F.col("keep")).cast("double"))).alias("pct_any"))
    middles = distribution_compare(signals, ["duration_s", "motion_energy"], by, (0.5,))
    of = lambda c: F.max(F.when(F.col("signal") == c, F.col("p50")))
    middles = middles.groupBy(F.col(by).alias("__by")).agg(of("duration_s").alias("median_dur_s"), of("motion_energy").alias("median_motion"))
    return out.join(middles, F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")


def distribution_compare(df: DataFrame, cols: list[str], by: str = "lab", points: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(group, signal, p50, p95, ...), long."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).cast("double").alias("value")) for c in cols])).alias("x")
    return exact_percentiles(df.select(by, each).select(by, "x.*"), [by, "signal"], "value", {f"p{round(100 * p)}": p for p in points})


def exemplars(gated: DataFrame, n: int = 2, key: str = "episode_hash", length: str = "duration_s", off_axis: tuple[str, str] | None = None) -> DataFrame:
    """(kind, episode, value): the n kept episodes nearest the median length, and the n longest dropped ones; if fewer are
    dropped, the shortest dropped fill up. With the names of the angle and share columns, also the n kept ones of the least
    ``off_axis`` angle and the n off-axis ones of the largest share. Ties by key."""
    pick = lambda rows, order, kind, col: rows.orderBy(order, key).limit(n).select(F.lit(kind).alias("kind"), key, F.col(col).cast("double").alias("value"))
    middle = F.broadcast(exact_percentiles(gated, [], length, {"__middle": 0.5}))  # one row
    kept, gone = gated.where("keep"), gated.where("not keep")
    out = pick(kept.join(middle, how="cross"), F.abs(F.col(length) - F.col("__middle")), "typical", length)
    out = out.unionByName(pick(gone, F.desc(length), "longest_dropped", length))
    if off_axis:
        angle, share = off_axis
        out = out.unionByName(pick(kept, F.asc_nulls_last(angle), "least_off_axis", angle)).unionByName(pick(gated.where("rule_off_axis"), F.desc(share), "most_off_axis", share))
    return out


def flag_prevalence(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """(flag, n_flagged, pct) of named predicates; NULL counts as false."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(p).alias(k) for k, p in flags.items()])
    lines = F.array(*[F.struct(F.lit(k).alias("flag"), F.col(k).alias("n_flagged"), (100.0 * F.col(k) / F.col("n")).alias("pct")) for k in flags])
    return counts.select(F.explode(lines).alias("x")).select("x.*")
