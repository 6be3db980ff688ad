"""Per-episode signals, features and candidate signals from frames: one exchange by episode for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipcurate.functions.numbers import clean_array, nonfinite, norm
from clipcurate.functions.points import aperture, off_axis_deg
from clipcurate.sources.store import settled

FPS = 30.0
#: Numbers of a pose: a place and a quaternion.
POSE = 7
TRACKS, HANDS, KEYPOINTS = ("left_ee", "right_ee", "head"), ("left", "right"), ("left_kp", "right_kp")


def frame_scalars(frames: DataFrame, points: int = 21) -> DataFrame:
    """Numbers of each frame alone, before the exchange: what they stand for (the wide keypoints) needn't be shuffled. Poses of
    seven numbers and hands of ``points`` points go through generated code, others through functions of each element."""
    own = {}
    for c in (*TRACKS, *KEYPOINTS):
        own |= {f"bad_{c}": nonfinite(c, POSE if c in TRACKS else 3 * points), f"size_{c}": F.size(c)}
    for h in HANDS:
        own |= {f"angle_{h}": off_axis_deg(f"{h}_kp", points), f"aperture_{h}": aperture(f"{h}_kp", points)}
    clean = {c: clean_array(c, POSE) for c in TRACKS}
    out = frames.withColumns(own | clean).drop(*KEYPOINTS)
    xyz = {f"{c}_{a}": F.get(c, F.lit(k)) for c in TRACKS for k, a in enumerate("xyz")}
    return out.withColumns(xyz | {"hand_dist": norm([F.get("left_ee", F.lit(k)) - F.get("right_ee", F.lit(k)) for k in range(3)])})


def steps(frames: DataFrame, episode: str = "episode_hash", order: str = "frame_idx") -> DataFrame:
    """Adds, for each track: ``step_*`` (distance from the frame before), ``same_*`` (nothing changed), ``run_*`` (unchanged
    steps up to here), the hands' ``acc_*`` and the head's quaternion step ``turn``; all NULL on an episode's first frame.
    The tracks themselves are left behind, but for the coordinates ``*_x``, ``*_y``, ``*_z``."""
    w = Window.partitionBy(episode).orderBy(order)
    now = F.struct(*TRACKS)
    out = frames.withColumns({"pos": F.row_number().over(w), "prev": F.lag(now).over(w)})

    def moved(a: Column, b: Column, low: int, high: int) -> Column:
        return F.when(a.isNotNull() & b.isNotNull(), norm([F.get(a, F.lit(k)) - F.get(b, F.lit(k)) for k in range(low, high)]))

    own = {f"step_{c}": moved(F.col(c), F.col("prev")[c], 0, 3) for c in TRACKS} | {f"same_{c}": F.col(c) == F.col("prev")[c] for c in TRACKS}
    out = out.withColumns(own | {"turn": moved(F.col("head"), F.col("prev")["head"], 3, 7)}).drop("prev", *TRACKS)
    out = out.withColumns({f"acc_{h}": (F.col(f"step_{h}_ee") - F.lag(f"step_{h}_ee").over(w)) * FPS * FPS for h in HANDS})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    broken = lambda c: F.last(F.when(~F.coalesce(F.col(f"same_{c}"), F.lit(False)), F.col("pos")), ignorenulls=True)
    return out.withColumns({f"run_{c}": F.col("pos") - broken(c).over(upto) for c in TRACKS})


def _pooled(of) -> tuple[Column, Column]:
    """Sum and count of a number over both hands' steps."""
    parts = [of(F.col(f"step_{h}_ee") * FPS) for h in HANDS]
    return sum(F.coalesce(F.sum(p), F.lit(0.0)) for p in parts), sum(F.count(f"step_{h}_ee") for h in HANDS)


def signal_columns() -> list[Column]:
    """Aggregates for the quality signals; an absent track has its default, not a missing value."""
    n = F.count("left_ee_x").cast("long")
    out = [n.alias("n_frames"), (n / FPS).alias("duration_s")]
    nan = {c: F.coalesce(F.sum(f"bad_{c}") / F.sum(f"size_{c}"), F.lit(1.0)) for c in (*TRACKS, *KEYPOINTS)}
    out += [v.alias(f"nan_{k}") for k, v in nan.items()] + [F.greatest(*nan.values()).alias("nan_max")]
    frac = {c: F.avg(F.col(f"same_{c}").cast("double")) for c in TRACKS}
    run = {c: F.max(F.when(F.col(f"same_{c}").isNotNull(), F.col(f"run_{c}"))) for c in TRACKS}
    out += [v.alias(f"frozen_frac_{k}") for k, v in frac.items()] + [v.cast("long").alias(f"frozen_run_{k}") for k, v in run.items()]
    out += [F.coalesce(F.greatest(*frac.values()), F.lit(1.0)).alias("frozen_frac_max"), (F.coalesce(F.greatest(*run.values()), F.lit(0)) / FPS).alias("frozen_run_max_s")]
    share = {h: F.coalesce(F.avg((F.col(f"angle_{h}") > 45).cast("double")), F.lit(1.0)) for h in HANDS}
    angle = {h: F.coalesce(F.percentile(f"angle_{h}", F.lit(0.5)), F.lit(90.0)) for h in HANDS}
    out += [v.alias(f"offaxis_{k}") for k, v in share.items()] + [v.alias(f"offaxis_deg_{k}") for k, v in angle.items()]
    out += [F.greatest(*share.values()).alias("offaxis_max"), F.greatest(*angle.values()).alias("offaxis_deg_max")]
    for h in HANDS:
        t = f"{h}_ee"
        there = F.struct(*[f"{t}_{a}" for a in "xyz"])
        first, last = (f(there, F.when(F.col(f"{t}_x").isNotNull(), F.col("pos"))) for f in (F.min_by, F.max_by))
        out += [F.coalesce(F.sum(f"step_{t}"), F.lit(0.0)).alias(f"path_len_{h}"), F.coalesce(F.avg(f"step_{t}") * FPS, F.lit(0.0)).alias(f"speed_mean_{h}")]
        out += [norm([last[f"{t}_{a}"] - first[f"{t}_{a}"] for a in "xyz"]).alias(f"net_disp_{h}")]
    fast, count = _pooled(lambda v: (v > 10).cast("double"))
    total, _ = _pooled(lambda v: v)
    out += [sum(F.coalesce(F.sum(f"step_{h}_ee"), F.lit(0.0)) for h in HANDS).alias("path_len_total")]
    out += [F.coalesce(F.greatest(*(F.max(f"step_{h}_ee") for h in HANDS)) * FPS, F.lit(0.0)).alias("hand_speed_max")]
    out += [F.when(count > 0, fast / count).otherwise(1.0).alias("hand_jitter_frac"), F.coalesce(F.max("step_head") * FPS, F.lit(0.0)).alias("head_speed_max")]
    return out + [F.when(count > 0, total / count).otherwise(0.0).alias("motion_energy")]


def feature_columns() -> list[Column]:
    """Aggregates for the 41 features ``f_*``; a hand or head of fewer than 3 frames has none of its own."""
    n = F.count("left_ee_x").cast("long")
    out = [(n / FPS).alias("f_duration_s"), F.log1p(n / FPS).alias("f_log_duration")]
    for h in HANDS:
        t, enough = f"{h}_ee", F.count(f"{h}_ee_x") >= 3
        v = F.col(f"step_{t}") * FPS
        ext = [F.max(f"{t}_{a}") - F.min(f"{t}_{a}") for a in "xyz"]
        box = F.greatest(ext[0], F.lit(1e-6)) * F.greatest(ext[1], F.lit(1e-6)) * F.greatest(ext[2], F.lit(1e-6))
        own = {"path": F.sum(f"step_{t}"), "speed_mean": F.avg(v), "speed_std": F.stddev_pop(v), "speed_p90": F.percentile(v, F.lit(0.9)), "acc_std": F.stddev_pop(f"acc_{h}")}
        own |= dict(zip(("ext_x", "ext_y", "ext_z"), ext, strict=True)) | {"bbox_vol": box}
        own |= {f"centroid_{a}": F.avg(f"{t}_{a}") for a in "xyz"} | {"active_frac": F.avg((v > 0.02).cast("double"))}
        out += [F.when(enough, x).alias(f"f_{h}_{k}") for k, x in own.items()]
    a, b = (F.when(F.col("step_left_ee").isNotNull() & F.col("step_right_ee").isNotNull(), F.col(f"step_{h}_ee") * FPS) for h in HANDS)
    steady = (F.count(a) <= 2) | (F.stddev_pop(a) <= 1e-9) | (F.stddev_pop(b) <= 1e-9)
    out += [F.when(~steady, F.corr(a, b)).otherwise(0.0).alias("f_bimanual_speed_corr")]
    out += [F.avg("hand_dist").alias("f_hand_dist_mean"), F.stddev_pop("hand_dist").alias("f_hand_dist_std"), F.min("hand_dist").alias("f_hand_dist_min")]
    for h in HANDS:
        c = f"aperture_{h}"
        out += [F.avg(c).alias(f"f_{h}_aperture_mean"), F.stddev_pop(c).alias(f"f_{h}_aperture_std"), (F.max(c) - F.min(c)).alias(f"f_{h}_aperture_range")]
    enough = F.count("head_x") >= 3
    reach = norm([F.max(f"head_{a}") - F.min(f"head_{a}") for a in "xyz"])
    return out + [F.when(enough, F.sum("step_head")).alias("f_head_path"), F.when(enough, reach).alias("f_head_ext"), F.when(enough, F.avg("turn") * FPS).alias("f_head_rot_energy")]


def candidate_columns(still: float = 0.05, idle: float = 0.02) -> list[Column]:
    """Aggregates for signals without a threshold yet. An episode that never moves is dead air from both ends: 2.0."""
    n = F.count("left_ee_x")
    sp = F.greatest(*(F.col(f"step_{h}_ee") * FPS for h in HANDS))
    fast, count = _pooled(lambda v: (v > 5).cast("double"))
    at = F.when(sp > still, F.col("pos") - 2)  # steps are counted from 0
    lead_in = F.coalesce(F.min(at), n) / FPS
    lead_out = F.when(F.max(at).isNull(), n).otherwise(n - 2 - F.max(at)) / FPS
    length = F.greatest(n / FPS, F.lit(1e-6))
    return [
        F.coalesce(F.greatest(*(F.max(f"step_{h}_ee") for h in HANDS)) * FPS, F.lit(0.0)).alias("max_hand_speed"), F.when(count > 0, fast / count).alias("frac_over_5ms"),
        F.coalesce(F.max("step_head") * FPS, F.lit(0.0)).alias("max_head_speed"), F.coalesce(F.max("turn"), F.lit(0.0)).alias("max_quat_step"),
        lead_in.alias("lead_in_s"), lead_out.alias("lead_out_s"), ((lead_in + lead_out) / length).alias("dead_air_frac"),
        (sum(F.coalesce(F.sum(f"step_{h}_ee"), F.lit(0.0)) for h in HANDS) / length).alias("path_per_s"), F.avg((sp < idle).cast("double")).alias("idle_frac"),
    ]


#: What of the steps each family of columns reads.
_USES = {
    "signals": ("left_ee_", "right_ee_", "step_", "same_", "run_", "bad_", "size_", "angle_"), "features": ("left_ee_", "right_ee_", "head_", "step_", "turn", "acc_", "aperture_", "hand_dist"),
    "candidates": ("left_ee_x", "step_", "turn"),
}
_COLUMNS = {"signals": signal_columns, "features": feature_columns, "candidates": candidate_columns}


def per_episode(frames: DataFrame, families: tuple[str, ...] = ("signals", "features", "candidates"), by: tuple[str, ...] = ("episode_hash", "lab"), points: int = 21, most: int = 24) -> DataFrame:
    """One row an episode: all columns of the families ``signals`` (quality), ``features`` (the 41) and ``candidates``, from one pass
    over the frames. What frames and steps say is written once, as narrow numbers; groupings read it, each the columns that
    it needs. Percentiles, which Spark groups without generated code, have a grouping of their own, and of the other
    aggregates ``most`` share one: more in one take the code generator minutes."""
    columns = [c for f in families for c in _COLUMNS[f]()]
    stepped = steps(frame_scalars(frames, points), by[0])
    kept = [c for c in stepped.columns if c in (*by, "pos") or c.startswith(tuple(u for f in families for u in _USES[f]))]
    stepped = settled(stepped.select(kept), "zstd")  # the widest table of all jobs over frames
    slow = [c for c in columns if "percentile(" in str(c)]
    fast = [c for c in columns if not any(c is s for s in slow)]
    out = stepped.groupBy(by[0]).agg(*[F.first(c).alias(c) for c in by[1:]], *fast[:most])
    for part in [fast[k : k + most] for k in range(most, len(fast), most)] + [slow] * bool(slow):
        out = out.join(stepped.groupBy(by[0]).agg(*part), by[0])
    return out


def quality_signals(frames: DataFrame, points: int = 21) -> DataFrame:
    return per_episode(frames, ("signals",), points=points)


def embedding_features(frames: DataFrame, points: int = 21) -> DataFrame:
    return per_episode(frames, ("features",), points=points)


def candidate_signals(frames: DataFrame, points: int = 21) -> DataFrame:
    return per_episode(frames, ("candidates",), points=points)
