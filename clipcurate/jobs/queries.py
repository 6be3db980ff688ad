"""The operators as queries over the driver's tables, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipcurate.functions.points import into_head, pinhole
from clipcurate.jobs import fit_sql
from clipcurate.operators import camera, compare, embed, experiment, gate, profile, ridge, sampling, signals, subset
from clipcurate.sources import bind, ingest, resume
from clipcurate.sources.store import scratch, settled, write_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("count_if(", "count(*) FILTER (WHERE ")  # a BIGINT, as Spark's
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_FRAMES = """
l AS (SELECT l_suppkey AS ep, l_quantity AS q, l_extendedprice / 1000 AS e, l_discount * 100 AS d, l_tax * 100 AS t,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS pos FROM lineitem),
p AS (SELECT *, lag(q) OVER w AS q0, lag(e) OVER w AS e0, lag(d) OVER w AS d0, lag(t) OVER w AS t0 FROM l WINDOW w AS (PARTITION BY ep ORDER BY pos)),
s0 AS (SELECT *, sqrt((q-q0)**2 + (e-e0)**2 + (d-d0)**2) AS sl, sqrt((t-t0)**2 + (q-q0)**2 + (d-d0)**2) AS sr, sqrt(((q-q0)/10)**2 + (t-t0)**2 + (d-d0)**2) AS sh,
  sqrt(((t-t0)/8)**2 + ((d-d0)/10)**2 + ((q-q0)/50)**2) AS turn,
  CASE WHEN q0 IS NOT NULL THEN (q = q0 AND e = e0 AND d = d0 AND t = t0)::INT END AS ml, CASE WHEN q0 IS NOT NULL THEN (q = q0 AND d = d0 AND t = t0)::INT END AS mr,
  sqrt((q-t)**2 + (e-q)**2 + (d-d)**2) AS hd,
  degrees(atan2(sqrt(((q+q+1+q+q/2)/4)**2 + ((d+d+(t-5)+d-2+d)/4)**2), -(((t-5)+(t-5)+(t-5)+d+(t-5)-3)/4 - d/4 + d/4))) AS al,
  degrees(atan2(sqrt(((t+t+1+t+t/2)/4)**2 + ((d+d+(q-30)+d-2+d)/4)**2), -(((q-30)*4+d-3)/4))) AS ar,
  (0 + sqrt(1 + (t-5)**2) + sqrt(4 + d**2) + sqrt((q/2)**2 + 9)) / 4 AS apl, (0 + sqrt(1 + (q-30)**2) + sqrt(4 + d**2) + sqrt((t/2)**2 + 9)) / 4 AS apr FROM p),
s1 AS (SELECT *, (sl - lag(sl) OVER w) * 900 AS accl, (sr - lag(sr) OVER w) * 900 AS accr,
  pos - max(CASE WHEN coalesce(ml, 0) = 0 THEN pos END) OVER w AS rl, pos - max(CASE WHEN coalesce(mr, 0) = 0 THEN pos END) OVER w AS rr FROM s0 WINDOW w AS (PARTITION BY ep ORDER BY pos))
"""
_SIGNALS = f"""{_FRAMES},
g AS (SELECT ep AS episode_hash, count(*) AS n_frames, count(*) / 30.0::DOUBLE AS duration_s, 0.0::DOUBLE AS nan_max, greatest(avg(ml), avg(mr)) AS frozen_frac_max,
  greatest(max(CASE WHEN ml IS NOT NULL THEN rl END), max(CASE WHEN mr IS NOT NULL THEN rr END), 0) / 30.0::DOUBLE AS frozen_run_max_s,
  greatest(avg((al > 45)::INT), avg((ar > 45)::INT)) AS offaxis_max, greatest(median(al), median(ar)) AS offaxis_deg_max,
  avg(ml) AS frozen_frac_left_ee, avg(mr) AS frozen_frac_right_ee, avg(mr) AS frozen_frac_head, max(CASE WHEN ml IS NOT NULL THEN rl END) AS frozen_run_left_ee,
  max(CASE WHEN mr IS NOT NULL THEN rr END) AS frozen_run_right_ee, max(CASE WHEN mr IS NOT NULL THEN rr END) AS frozen_run_head,
  avg((al > 45)::INT) AS offaxis_left, avg((ar > 45)::INT) AS offaxis_right, median(al) AS offaxis_deg_left, median(ar) AS offaxis_deg_right,
  sum(sr) AS path_len_right, avg(sr) * 30 AS speed_mean_right, sqrt((arg_max(t, pos) - arg_min(t, pos))**2 + (arg_max(q, pos) - arg_min(q, pos))**2 + (arg_max(d, pos) - arg_min(d, pos))**2) AS net_disp_right,
  sum(sl) AS path_len_left, avg(sl) * 30 AS speed_mean_left, sqrt((arg_max(q, pos) - arg_min(q, pos))**2 + (arg_max(e, pos) - arg_min(e, pos))**2 + (arg_max(d, pos) - arg_min(d, pos))**2) AS net_disp_left,
  sum(sl) + sum(sr) AS path_len_total, greatest(max(sl), max(sr)) * 30 AS hand_speed_max,
  (sum((sl*30 > 10)::INT) + sum((sr*30 > 10)::INT)) / (count(sl) + count(sr))::DOUBLE AS hand_jitter_frac, max(sh) * 30 AS head_speed_max,
  (sum(sl) + sum(sr)) * 30 / (count(sl) + count(sr)) AS motion_energy FROM s1 GROUP BY ep),
sig AS (SELECT g.*, 'lab' || (s_nationkey % 3) AS lab FROM g JOIN supplier ON s_suppkey = episode_hash)
"""
_SIGNAL_COLUMNS = "n_frames duration_s nan_max frozen_frac_max frozen_run_max_s offaxis_max offaxis_deg_max path_len_left speed_mean_left net_disp_left path_len_total hand_speed_max hand_jitter_frac head_speed_max motion_energy".split()
_PARTS = [f"frozen_{k}_{t}" for k in ("frac", "run") for t in signals.TRACKS] + [f"{k}_{h}" for k in ("offaxis", "offaxis_deg") for h in signals.HANDS] + ["path_len_right", "speed_mean_right", "net_disp_right"]
_KEYS = {"episode_hash", "lab", "n_frames", *(f"frozen_run_{t}" for t in signals.TRACKS)}


def _round_sql(cols: list[str], digits: int = 6) -> str:
    return ", ".join(c if c in _KEYS else f"round({c}, {digits}) AS {c}" for c in cols)


@query(f"WITH {_SIGNALS} SELECT {_round_sql(['episode_hash', 'lab', *_SIGNAL_COLUMNS, *_PARTS])} FROM sig")
def quality_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.quality_signals(bind.frames(spark, sf_dir), bind.POINTS).select("episode_hash", "lab", *_SIGNAL_COLUMNS, *_PARTS))


@query("""WITH l AS (SELECT l_suppkey AS ep, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS f FROM lineitem),
g AS (SELECT ep AS episode_hash, count_if(f % 11 <> 0) AS n_frames, count_if(f % 11 <> 0 AND f % 7 = 0) * 2 / (7.0::DOUBLE * count_if(f % 11 <> 0)) AS nan_left_ee, CASE WHEN ep % 5 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS nan_right_ee,
  count_if(f % 13 = 0) / (7.0::DOUBLE * count(*)) AS nan_head, count_if(f % 17 = 0) * 12 / (12.0::DOUBLE * count(*)) AS nan_left_kp, 0.0::DOUBLE AS nan_right_kp FROM l GROUP BY ep)
SELECT episode_hash, n_frames, round(nan_left_ee, 6) AS nan_left_ee, nan_right_ee, round(nan_head, 6) AS nan_head, round(nan_left_kp, 6) AS nan_left_kp, nan_right_kp,
  round(greatest(nan_left_ee, nan_right_ee, nan_head, nan_left_kp, nan_right_kp), 6) AS nan_max FROM g""")
def tracking_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left poses with NaN and frames without any, no right hand in every fifth episode, infinite heads, frames of NaN keypoints."""
    f, k, nan = bind.frames(spark, sf_dir), F.col("frame_idx"), F.lit(float("nan"))
    spoilt = lambda c, at, x: F.transform(c, lambda v, i: F.when(i.isin(*at), x).otherwise(v))
    f = f.withColumns({
        "left_ee": F.when(k % 11 == 0, F.lit(None)).when(k % 7 == 0, spoilt("left_ee", (1, 5), nan)).otherwise(F.col("left_ee")), "right_ee": F.when(F.col("episode_hash") % 5 != 0, F.col("right_ee")),
        "head": F.when(k % 13 == 0, spoilt("head", (0,), F.lit(float("-inf")))).otherwise(F.col("head")), "left_kp": F.when(k % 17 == 0, F.transform("left_kp", lambda v: nan)).otherwise(F.col("left_kp")),
    })
    found = signals.quality_signals(f, bind.POINTS)
    return rounded(found.select("episode_hash", "n_frames", *[f"nan_{c}" for c in (*signals.TRACKS, *signals.KEYPOINTS)], "nan_max"))


_HAND = {"left": ("sl", "accl", ("q", "e", "d"), "apl"), "right": ("sr", "accr", ("t", "q", "d"), "apr")}
_FEATURE_SQL = ["count(*) / 30.0::DOUBLE AS f_duration_s", "ln(1 + count(*) / 30.0::DOUBLE) AS f_log_duration"]
for _h, (_s, _a, _xyz, _ap) in _HAND.items():
    _ext = [f"(max({c}) - min({c}))" for c in _xyz]
    _FEATURE_SQL += [f"sum({_s}) AS f_{_h}_path", f"avg({_s}*30) AS f_{_h}_speed_mean", f"stddev_pop({_s}*30) AS f_{_h}_speed_std", f"quantile_cont({_s}*30, 0.9) AS f_{_h}_speed_p90", f"stddev_pop({_a}) AS f_{_h}_acc_std"]
    _FEATURE_SQL += [f"{e} AS f_{_h}_ext_{k}" for e, k in zip(_ext, "xyz", strict=True)] + [f"{' * '.join(f'greatest({e}, 1e-6)' for e in _ext)} AS f_{_h}_bbox_vol"]
    _FEATURE_SQL += [f"avg({c}) AS f_{_h}_centroid_{k}" for c, k in zip(_xyz, "xyz", strict=True)] + [f"avg(({_s}*30 > 0.02)::INT) AS f_{_h}_active_frac"]
    _FEATURE_SQL += [f"avg({_ap}) AS f_{_h}_aperture_mean", f"stddev_pop({_ap}) AS f_{_h}_aperture_std", f"max({_ap}) - min({_ap}) AS f_{_h}_aperture_range"]
_FEATURE_SQL += ["corr(sl*30, sr*30) AS f_bimanual_speed_corr", "avg(hd) AS f_hand_dist_mean", "stddev_pop(hd) AS f_hand_dist_std", "min(hd) AS f_hand_dist_min"]
_FEATURE_SQL += ["sum(sh) AS f_head_path", "sqrt(((max(q)-min(q))/10)**2 + (max(t)-min(t))**2 + (max(d)-min(d))**2) AS f_head_ext", "avg(turn) * 30 AS f_head_rot_energy"]
FEATURES = [x.rsplit(" AS ", 1)[1] for x in _FEATURE_SQL]


@query(f"WITH {_FRAMES}, f AS (SELECT ep AS episode_hash, {', '.join(_FEATURE_SQL)} FROM s1 GROUP BY ep) SELECT {_round_sql(['episode_hash', *FEATURES], 5)} FROM f")
def embedding_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.embedding_features(bind.frames(spark, sf_dir), bind.POINTS).drop("lab"), 5)


_MOVES = """c AS (SELECT ep AS episode_hash, count(*) AS n, greatest(max(sl), max(sr)) * 30 AS max_hand_speed, (sum((sl*30 > 5)::INT) + sum((sr*30 > 5)::INT)) / (count(sl) + count(sr))::DOUBLE AS frac_over_5ms,
  max(sh) * 30 AS max_head_speed, max(turn) AS max_quat_step, min(CASE WHEN greatest(sl, sr)*30 > 0.05 THEN pos - 2 END) AS a, max(CASE WHEN greatest(sl, sr)*30 > 0.05 THEN pos - 2 END) AS b,
  sum(sl) + sum(sr) AS path, avg((greatest(sl, sr)*30 < 0.02)::INT) AS idle_frac FROM s1 GROUP BY ep),
k AS (SELECT *, coalesce(a, n) / 30.0::DOUBLE AS lead_in_s, (CASE WHEN b IS NULL THEN n ELSE n - 2 - b END) / 30.0::DOUBLE AS lead_out_s, path / (n / 30.0::DOUBLE) AS path_per_s FROM c),
cand AS (SELECT *, (lead_in_s + lead_out_s) / (n / 30.0::DOUBLE) AS dead_air_frac FROM k)"""
_CANDIDATES = "max_hand_speed frac_over_5ms max_head_speed max_quat_step lead_in_s lead_out_s dead_air_frac path_per_s idle_frac".split()


@query(f"WITH {_SIGNALS}, f AS (SELECT ep AS key, {', '.join(_FEATURE_SQL)} FROM s1 GROUP BY ep), {_MOVES} SELECT {_round_sql(['episode_hash', 'lab', *_SIGNAL_COLUMNS, *_PARTS, *FEATURES], 4)}, {_round_sql(_CANDIDATES, 4)} FROM sig JOIN f ON f.key = episode_hash JOIN cand USING (episode_hash)")
def episode_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals, features and candidates of each episode in one pass over its frames."""
    found = signals.per_episode(bind.frames(spark, sf_dir), points=bind.POINTS)
    return rounded(found.select("episode_hash", "lab", *_SIGNAL_COLUMNS, *_PARTS, *FEATURES, *_CANDIDATES), 4)


@query(f"WITH {_FRAMES}, {_MOVES} SELECT {_round_sql(['episode_hash', *_CANDIDATES])} FROM cand")
def candidate_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.candidate_signals(bind.frames(spark, sf_dir), bind.POINTS).drop("lab"))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that rules and audits read, computed once."""
    return settled(signals.quality_signals(bind.frames(spark, sf_dir), bind.POINTS).select("episode_hash", "lab", *_SIGNAL_COLUMNS))


def _gate_sql(rules, scope: str = "") -> str:
    flags = []
    for r in rules:
        bound = f"(median({r.signal}) OVER ({scope}))*{r.bound}" if r.of_median else f"{r.bound}"
        flags.append(f"({r.signal} {r.op} {bound}{' AND lab IN (' + repr(r.labs[0]) + ')' if r.labs else ''}) AS rule_{r.name}")
    reason = "concat_ws('|', " + ", ".join(f"CASE WHEN rule_{r.name} THEN '{r.name}' END" for r in rules) + ")"
    return f"r0 AS (SELECT *, {', '.join(flags)} FROM sig), gated AS (SELECT *, {reason} AS drop_reason FROM r0)"


#: The gate's bounds on the stand-in's scale, so that every kind of rule fires.
BOUND_RULES = tuple(
    gate.GateRule(r.name, r.signal, r.op, {"frozen": 0.01, "too_short": 19.5, "jitter": 0.999, "head_jump": 300.0, "no_motion": 20000.0, "runaway": 1.05, "fragment": 0.96}.get(r.name, r.bound), r.meaning, r.of_median, ("lab1",) if r.labs else ()) for r in gate.RULES
)
_RULE_COLUMNS = [f"rule_{r.name}" for r in BOUND_RULES]


@query(f"WITH {_SIGNALS}, {_gate_sql(BOUND_RULES)} SELECT episode_hash, lab, {', '.join(_RULE_COLUMNS)}, drop_reason, drop_reason = '' AS keep FROM gated")
def gate_keep_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = gate.apply_gate(_signals(spark, sf_dir), BOUND_RULES)
    return gated.select("episode_hash", "lab", *_RULE_COLUMNS, "drop_reason", "keep")


def _line(r) -> str:
    return f"SELECT '{r.name}' AS rule, '{r.signal}' AS signal, '{r.text}' AS test, count_if(rule_{r.name}) AS n_flagged, round(100.0 * count_if(rule_{r.name}) / count(*), 6) AS pct, '{r.meaning}' AS meaning FROM gated"


@query(f"WITH {_SIGNALS}, {_gate_sql(BOUND_RULES)} {' UNION ALL '.join(map(_line, BOUND_RULES))} UNION ALL SELECT 'ANY', '', '', count_if(drop_reason <> ''), round(100.0 * count_if(drop_reason <> '') / count(*), 6), 'any rule' FROM gated")
def gate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gate.gate_audit(gate.apply_gate(_signals(spark, sf_dir), BOUND_RULES), BOUND_RULES))


_CROSS = tuple(r for r in BOUND_RULES if r.name not in ("jitter", "head_jump", "off_axis"))


@query(
    f"WITH {_SIGNALS}, {_gate_sql(_CROSS, 'PARTITION BY lab')} SELECT lab, count(*) AS n_episodes, {', '.join(f'round(100.0 * avg(rule_{r.name}::INT), 6) AS pct_{r.name}' for r in _CROSS)}, "
    "round(100.0 * avg((drop_reason <> '')::INT), 6) AS pct_any, round(median(duration_s), 6) AS median_dur_s, round(median(motion_energy), 6) AS median_motion FROM gated GROUP BY lab"
)
def cross_lab_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gate.cross_group_audit(_signals(spark, sf_dir), rules=_CROSS))


_COMPARED = ("duration_s", "motion_energy", "path_len_total", "offaxis_deg_max", "frozen_run_max_s")


@query("".join(["WITH ", _SIGNALS, " ", " UNION ALL ".join(f"SELECT lab, '{c}' AS signal, round(median({c}), 6) AS p50, round(quantile_cont({c}, 0.95), 6) AS p95 FROM sig GROUP BY lab" for c in _COMPARED)]))
def lab_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gate.distribution_compare(signals.quality_signals(bind.frames(spark, sf_dir), bind.POINTS).select("lab", *_COMPARED), list(_COMPARED)))


_CATALOG = "cat AS (SELECT doc_id AS episode_hash, lang AS lab, source AS operator, (doc_id % 16)::VARCHAR AS scene, n_chars::DOUBLE AS num_frames, n_chars / 30.0::DOUBLE AS duration_s FROM documents)"


@query(f"WITH {_CATALOG} SELECT lab, count(*) AS episodes, count(DISTINCT operator) AS operators, count(DISTINCT scene) AS scenes, floor(median(num_frames))::BIGINT AS median_frames FROM cat GROUP BY lab")
def lab_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.lab_structure(bind.catalog(spark, sf_dir))


@query(f"WITH {_CATALOG} SELECT lab, count(DISTINCT (operator, scene)) AS cells, count(DISTINCT operator) * count(DISTINCT scene) AS possible, round(count(DISTINCT (operator, scene)) / (count(DISTINCT operator) * count(DISTINCT scene)), 6) AS occupancy FROM cat GROUP BY lab")
def grid_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.grid_occupancy(bind.catalog(spark, sf_dir)))


@query(f"WITH {_CATALOG}, n AS (SELECT lab, operator, count(*) AS n FROM cat GROUP BY ALL) SELECT lab, min(n) AS fewest, round(median(n), 6) AS middle, max(n) AS most FROM n GROUP BY lab")
def operator_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.per_key_load(bind.catalog(spark, sf_dir)))


@query("WITH " + _CATALOG + ", v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS rows FROM cat WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("lab", "operator", "scene")) + ") SELECT \"column\", value, rows, count(*) OVER (PARTITION BY \"column\") AS n_distinct FROM v QUALIFY row_number() OVER (PARTITION BY \"column\" ORDER BY rows DESC, value) <= 5")
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(bind.catalog(spark, sf_dir), ["lab", "operator", "scene"], 5)


@query(f"WITH {_CATALOG} SELECT lab, 'num_frames' AS metric, count(*) AS count, round(avg(num_frames), 6) AS mean, round(stddev_samp(num_frames), 6) AS std, min(num_frames) AS min, round(quantile_cont(num_frames, 0.25), 6) AS p25, round(median(num_frames), 6) AS p50, round(quantile_cont(num_frames, 0.75), 6) AS p75, max(num_frames) AS max FROM cat GROUP BY lab")
def describe_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.describe(bind.catalog(spark, sf_dir), ["num_frames"], by=("lab",)))


@query("WITH e AS (SELECT min(n_chars) AS a, max(n_chars) AS b FROM documents) SELECT least(floor((n_chars - a) / (b - a)::DOUBLE * 50), 49)::INT AS bin, count(*) AS rows FROM documents, e GROUP BY 1")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram(bind.catalog(spark, sf_dir), "num_frames")


@query("SELECT source AS value, row_number() OVER (ORDER BY source) - 1 AS code FROM (SELECT DISTINCT source FROM documents)")
def ordinal_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.ordinal_codes(bind.catalog(spark, sf_dir), "operator").withColumn("code", F.col("code").cast("long"))


_FOCAL = "CASE WHEN event_type = 'view' THEN 133 ELSE 100 + user_id % 4 END"


@query(
    f"WITH k AS (SELECT '{{\"cam1\":[[' || {_FOCAL} || ',0,320],[0,' || {_FOCAL} || ',240],[0,0,1]],\"fps\":{{\"a\":30,\"b\":1.5}}}}' AS value, {_FOCAL} AS f, event_id FROM events), "
    "v AS (SELECT value, count(*) AS episodes, any_value(f) = 133 AS matches FROM k WHERE event_id % 50 <> 0 GROUP BY value UNION ALL SELECT 'ERROR', count(*), false FROM k WHERE event_id % 50 = 0 HAVING count(*) > 0) "
    "SELECT value, episodes, (SELECT count(*) FROM v) = 1 AS is_constant, matches FROM v ORDER BY episodes DESC, value LIMIT 5"
)
def attribute_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera matrices as JSON whose keys, spaces and numbers are written in different ways, some of it broken."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("f", F.when(F.col("event_type") == "view", 133).otherwise(100 + F.col("user_id") % 4).cast("string"))
    matrix = F.concat(F.lit("[["), F.col("f"), F.lit(",0,320],[0,"), F.col("f"), F.lit(".0,240.00],[0, 0,1]]"))
    one = F.concat(F.lit('{"cam1":'), matrix, F.lit(',"fps":{"a":30,"b":1.5}}'))
    other = F.concat(F.lit('{ "fps": {"b":1.50, "a":30.0}, "cam1": '), matrix, F.lit(" }"))
    attrs = e.select(F.when(F.col("event_id") % 50 == 0, F.lit('{"cam1":')).when(F.col("event_id") % 2 == 0, one).otherwise(other).alias("intrinsics"))
    return ingest.attr_constancy(attrs, "intrinsics", expected=[[133, 0, 320], [0, 133, 240], [0, 0, 1]], leaf="$.cam1")


@query("SELECT doc_id AS episode_hash FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("episode_hash"))
    return ingest.pending(bind.catalog(spark, sf_dir), done, "episode_hash").select("episode_hash")


@query(f"WITH {_CATALOG} SELECT lab, episode_hash FROM cat QUALIFY row_number() OVER (PARTITION BY lab ORDER BY md5(concat_ws('|', 7, 'sample', episode_hash)), episode_hash) <= 20")
def sample_per_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_per_group(bind.catalog(spark, sf_dir), 20, 7, ["lab"], "episode_hash").select("lab", "episode_hash")



def _split_sql(short: float = 3, long: float = 3, part: float = 0.15) -> str:
    """CTEs from ``cat`` up to ``sp``, the splits, and ``bud``, the budgets; bounds of the length rules."""
    return f"""seeds AS (SELECT unnest([0, 1, 2]) AS seed),
med AS (SELECT median(duration_s) AS m FROM cat), kept AS (SELECT cat.*, NOT (duration_s < {short} OR duration_s > {long} * m OR duration_s < {part} * m) AS keep FROM cat, med),
ops AS (SELECT seed, operator, row_number() OVER (PARTITION BY seed ORDER BY md5(concat_ws('|', seed, 'operator', operator)), operator) AS k, count(*) OVER (PARTITION BY seed) AS n FROM (SELECT DISTINCT operator FROM cat WHERE operator IS NOT NULL), seeds),
scs AS (SELECT seed, scene, row_number() OVER (PARTITION BY seed ORDER BY md5(concat_ws('|', seed, 'scene', scene)), scene) AS k, count(*) OVER (PARTITION BY seed) AS n FROM (SELECT DISTINCT scene FROM cat), seeds),
sp0 AS (SELECT s.seed, kept.*, coalesce(o.k <= greatest(1, floor(o.n * 0.25)), false) AS op, coalesce(c.k <= greatest(1, floor(c.n * 0.25)), false) AS sc FROM kept CROSS JOIN seeds s LEFT JOIN ops o ON o.seed = s.seed AND o.operator = kept.operator LEFT JOIN scs c ON c.seed = s.seed AND c.scene = kept.scene),
sp AS (SELECT *, CASE WHEN op THEN 'eval_operator' WHEN sc THEN 'eval_scene' ELSE 'pool' END AS split, NOT op AND NOT sc AND keep AS pool_gated FROM sp0 WHERE NOT (op AND sc)),
bud AS (SELECT seed, k_frac, greatest(5, floor(k_frac * count_if(pool_gated)))::BIGINT AS k FROM sp, (SELECT unnest([0.25, 0.5]::DOUBLE[]) AS k_frac) GROUP BY seed, k_frac)"""


_SPLIT = f"{_CATALOG}, {_split_sql()}"
_LENGTH_RULES = tuple(r for r in gate.RULES if r.signal == "duration_s")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.assign_split(gate.apply_gate(bind.catalog(spark, sf_dir), _LENGTH_RULES), [0, 1, 2])


@query(f"WITH {_SPLIT} SELECT seed, episode_hash, split, pool_gated FROM sp")
def heldout_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("seed", "episode_hash", "split", "pool_gated")


@query(f"WITH {_SPLIT} SELECT seed, k_frac, k FROM bud")
def selection_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.budgets(_split(spark, sf_dir), [0.25, 0.5])


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = settled(_split(spark, sf_dir).select("seed", "episode_hash", "operator", "scene", "split", "pool_gated"))
    k, pool = settled(sampling.budgets(split, [0.25, 0.5])), split.where("pool_gated")
    arms = [sampling.select_random(pool, k, "episode_hash"), sampling.select_random(split.where("split = 'pool'"), k, "episode_hash", "random_nogate")]
    return sampling.union_all([*arms, sampling.select_concentrated(pool, k, "episode_hash", ["operator", "scene"])]).withColumn("rank", F.col("rank").cast("long"))


_PICK = "row_number() OVER (PARTITION BY sp.seed, k_frac ORDER BY md5(concat_ws('|', sp.seed, 'pick', episode_hash)), episode_hash)"
_PLAIN_MEMBERS = f"""cs AS (SELECT sp.*, k_frac, k, concat_ws('|', operator, scene) AS grp, count(*) OVER (PARTITION BY sp.seed, k_frac, concat_ws('|', operator, scene)) AS gs FROM sp JOIN bud ON bud.seed = sp.seed WHERE pool_gated),
m AS (SELECT seed, k_frac, condition, rank, episode_hash FROM (
 SELECT sp.seed, k_frac, k, 'random' AS condition, {_PICK} AS rank, episode_hash FROM sp JOIN bud ON bud.seed = sp.seed WHERE pool_gated
 UNION ALL SELECT sp.seed, k_frac, k, 'random_nogate', {_PICK}, episode_hash FROM sp JOIN bud ON bud.seed = sp.seed WHERE split = 'pool'
 UNION ALL SELECT seed, k_frac, k, 'concentrated', row_number() OVER (PARTITION BY seed, k_frac ORDER BY gs DESC, md5(concat_ws('|', seed, 'group', grp)), grp, md5(concat_ws('|', seed, 'pick', episode_hash)), episode_hash), episode_hash FROM cs) WHERE rank <= k)"""
_MEMBERS = f"{_SPLIT}, {_PLAIN_MEMBERS}"


@query(f"WITH {_MEMBERS} SELECT * FROM m")
def selection_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir)


@query(f"WITH {_MEMBERS} SELECT seed, k_frac, condition, count(*) AS k, count(DISTINCT concat_ws('|', operator, scene)) AS n_groups FROM m JOIN cat USING (episode_hash) GROUP BY ALL")
def group_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.group_coverage(_members(spark, sf_dir), bind.catalog(spark, sf_dir), "episode_hash", ["operator", "scene"])


_W = "CASE WHEN num_frames - 40 >= 1 THEN ceil((num_frames - 40) / 15)::BIGINT ELSE 0 END"


@query(f"WITH {_CATALOG}, w AS (SELECT lab, episode_hash, 3 AS seed, {_W} AS n_windows FROM cat), t AS (SELECT lab, floor(sum(n_windows) * 0.25)::BIGINT AS target FROM w GROUP BY lab), o AS (SELECT w.*, target, sum(n_windows) OVER (PARTITION BY w.lab, seed ORDER BY md5(concat_ws('|', seed, 'until', episode_hash)), episode_hash ROWS UNBOUNDED PRECEDING) AS upto FROM w JOIN t USING (lab) WHERE n_windows > 0) SELECT lab, episode_hash, n_windows FROM o WHERE upto - n_windows < target")
def equal_footage(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = bind.catalog(spark, sf_dir).select("lab", "episode_hash", F.lit(3).alias("seed"), ridge.window_count("num_frames").alias("n_windows"))
    target = w.groupBy("lab", "seed").agg(F.floor(F.sum("n_windows") * 0.25).alias("target"))
    return sampling.take_until(w, "n_windows", target, "episode_hash", ["lab", "seed"]).select("lab", "episode_hash", "n_windows")


_RUNS = "res AS (SELECT user_id AS seed, event_type AS condition, avg(value) AS mse, count(*) AS n_train_win FROM events GROUP BY ALL), dl AS (SELECT r.seed, r.condition, r.mse - b.mse AS delta, 100.0 * (r.mse / b.mse - 1) AS pct FROM res r JOIN res b ON b.seed = r.seed AND b.condition = 'view' WHERE r.condition <> 'view')"


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.paired_deltas(bind.results(spark, sf_dir), ["seed"], ["mse"], "view")


@query(f"WITH {_RUNS} SELECT seed, condition, 'mse' AS metric, round(delta, 6) AS delta, round(pct, 6) AS pct FROM dl")
def paired_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_deltas(spark, sf_dir))


@query(f"WITH {_RUNS} SELECT condition, 'mse' AS metric, count(*) AS n_pairs, round(avg(pct), 6) AS mean_pct, count_if(delta < 0) AS wins FROM dl GROUP BY condition")
def paired_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.delta_summary(_deltas(spark, sf_dir), ["condition", "metric"]))


@query(f"WITH {_RUNS}, rk AS (SELECT *, rank() OVER (PARTITION BY condition ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY condition, abs(delta)) - 1) / 2.0 AS r FROM dl WHERE delta <> 0) SELECT condition, count(*) AS n, count_if(delta < 0) AS wins, round(sum(CASE WHEN delta < 0 THEN r ELSE 0 END)::DOUBLE, 6) AS rank_minus, round(sum(CASE WHEN delta > 0 THEN r ELSE 0 END)::DOUBLE, 6) AS rank_plus FROM rk GROUP BY condition")
def signed_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.significance(_deltas(spark, sf_dir), ["condition"]).select("condition", "n", "wins", "rank_minus", "rank_plus"))


#: Sign test: binomial terms by log-gamma. Rank test: counts of rank subsets by sum (up to 50 pairs without ties), else the normal
#: law's tails, integrated by Simpson's rule over 8 units.
_TESTS = """rk AS (SELECT *, rank() OVER (PARTITION BY condition ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY condition, abs(delta)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY condition, abs(delta)) AS tied FROM dl WHERE delta <> 0),
rs AS (SELECT condition, count(*) AS nz, sum(CASE WHEN delta < 0 THEN r ELSE 0 END)::DOUBLE AS rank_minus, sum(CASE WHEN delta > 0 THEN r ELSE 0 END)::DOUBLE AS rank_plus, max(tied) AS longest, sum(tied * tied - 1) AS ties FROM rk GROUP BY condition),
al AS (SELECT condition, count(*) AS n, count_if(delta < 0) AS wins, avg(pct) AS mean_pct FROM dl GROUP BY condition),
ps AS (SELECT condition, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) AS p_sign FROM al, LATERAL (SELECT unnest(range(n + 1)) AS k) WHERE abs(2 * k - n) >= abs(2 * wins - n) GROUP BY condition),
ws(m, ways) AS (SELECT 0::BIGINT, [1.0::DOUBLE] UNION ALL SELECT m + 1, list_transform(range(len(ways) + m + 1), lambda i: coalesce(ways[i + 1], 0) + CASE WHEN i > m THEN coalesce(ways[i - m], 0) ELSE 0 END) FROM ws WHERE m < 50),
z AS (SELECT *, least(rank_minus, rank_plus) AS low, abs(least(rank_minus, rank_plus) - nz * (nz + 1) / 4.0) / sqrt(2 * (nz * (nz + 1) * (2 * nz + 1) / 24.0 - ties / 48.0)) AS z FROM rs),
pw AS (SELECT condition, CASE WHEN nz <= 50 AND longest = 1 THEN (SELECT 2 * list_sum(ways[1:low::BIGINT + 1]) / 2.0**nz FROM ws WHERE m = nz)
  ELSE (SELECT 2 / sqrt(pi()) * sum(exp(-((z + i / 500.0)**2)) * CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) / 1500 FROM range(4001) AS t(i)) END AS p FROM z)"""
_SIGNIFICANCE = f"""WITH RECURSIVE {_RUNS},
{_TESTS}
SELECT condition, n, wins, round(mean_pct, 6) AS mean_pct, round(rank_minus, 6) AS rank_minus, round(rank_plus, 6) AS rank_plus, round(least(1.0, p_sign), 6) AS p_sign, round(least(1.0, p), 6) AS p_wilcoxon
FROM al JOIN rs USING (condition) JOIN ps USING (condition) JOIN pw USING (condition)"""


@query(_SIGNIFICANCE)
def significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.significance(_deltas(spark, sf_dir), ["condition"]))


@query(f"WITH {_RUNS} SELECT condition, count(*) AS runs, round(avg(mse), 6) AS mse_mean, round(stddev_samp(mse), 6) AS mse_std FROM res GROUP BY condition")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.summarize_runs(bind.results(spark, sf_dir), ["condition"], ["mse"]))


@query(f"WITH {_RUNS}, c AS (SELECT condition, seed % 9 AS config, avg(pct) AS pct FROM dl GROUP BY ALL) SELECT condition, count_if(pct < 0) AS better, count(*) AS configs, round(avg(pct), 6) AS mean_pct, round(max(pct), 6) AS worst_pct FROM c GROUP BY condition")
def robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.consistency(_deltas(spark, sf_dir).withColumn("config", F.col("seed") % 9), ["config"]))


_MEAN = lambda c: f"avg(CASE WHEN condition = '{c}' THEN mse END)"


@query(f"WITH {_RUNS} SELECT round({_MEAN('view')}, 6) AS baseline, round({_MEAN('click')}, 6) AS best, round({_MEAN('purchase')}, 6) AS ceiling, round(100.0 * ({_MEAN('view')} - {_MEAN('click')}) / ({_MEAN('view')} - {_MEAN('purchase')}), 3) AS gap_closed FROM res")
def gap_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare.gap_closed(bind.results(spark, sf_dir), "mse", "view", "click", "purchase")
    return out.select(*[F.round(c, 3 if c == "gap_closed" else 6).alias(c) for c in out.columns])


_Z = [f"z{k}" for k in range(64)]
#: Pool 3 goes without a name.
_POOLS = "v AS (SELECT vec_id AS id, nullif(label, 3) AS pool, list_transform(embedding, lambda x: x::DOUBLE) AS z FROM embeddings)"


def _pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.vectors(spark, sf_dir).withColumn("pool", F.when(F.col("pool") != 3, F.col("pool")))


@query(
    f"WITH {_POOLS} SELECT id AS episode_hash, pool, "
    + ", ".join(f"round((z[{k + 1}] - avg(z[{k + 1}]) OVER w) / (stddev_pop(z[{k + 1}]) OVER w + 1e-9), 6) AS z{k}" for k in range(64))
    + " FROM v WINDOW w AS (PARTITION BY pool)"
)
def whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _pools(spark, sf_dir).select("episode_hash", "pool", *[F.get("z", F.lit(k)).alias(c) for k, c in enumerate(_Z)])
    return rounded(embed.whiten(v, _Z, ["pool"])).select("episode_hash", "pool", *_Z)


_DISTANCES = "d AS MATERIALIZED (SELECT a.pool, a.id AS a, b.id AS b, list_sum(list_transform(list_zip(a.z, b.z), lambda p: (p[1] - p[2]) ** 2)) AS d FROM v a JOIN v b USING (pool))"
_PAIRS = """v AS (SELECT vec_id AS id, label AS pool, list_transform(embedding, lambda x: x::DOUBLE) AS z FROM embeddings),
n AS (SELECT pool, least(count(*), greatest(5, floor(0.25 * count(*))))::BIGINT AS k FROM v GROUP BY pool),
""" + _DISTANCES

#: Greedy selectors as CTEs ``pick_*`` (pool, rank, id), from the points ``v`` (pool, id, z), how many are picked ``n`` (pool, k) and
#: the distances ``d`` of all pairs. Log-det: residuals of kernel vectors, with their coefficients on the picks so far as a list.
#: Facility: each point with each candidate, whose gain is a sum over the points.
_GREEDY = {
    "kcenter": """r_k(t, pool, id, gap, pick) AS (SELECT 1, pool, id, 'inf'::DOUBLE, min(id) OVER (PARTITION BY pool) FROM v UNION ALL
  SELECT t + 1, pool, id, gap, first_value(id) OVER (PARTITION BY pool ORDER BY round(gap, 9) DESC, id) FROM (
    SELECT t, r_k.pool, id, CASE WHEN id = pick THEN -1 ELSE least(gap, d.d) END AS gap FROM r_k JOIN d ON d.pool = r_k.pool AND d.a = r_k.id AND d.b = r_k.pick JOIN n ON n.pool = r_k.pool WHERE t < k)),
pick_kcenter AS (SELECT DISTINCT pool, t AS rank, pick AS id FROM r_k)""",
    "logdet": """g_l AS (SELECT pool, 1 / greatest(median(d), 1e-9) AS g FROM d WHERE a < b AND d > 1e-12 GROUP BY pool),
kern AS MATERIALIZED (SELECT pool, a, b, exp(-g * d) + CASE WHEN a = b THEN 1e-6 ELSE 0 END AS k FROM d JOIN g_l USING (pool)),
r_l(t, pool, id, rest, c, pick) AS (SELECT 1, pool, id, 1 + 1e-6::DOUBLE, []::DOUBLE[], {'i': min(id) OVER (PARTITION BY pool), 'r': 1 + 1e-6::DOUBLE, 'c': []::DOUBLE[]} FROM v UNION ALL
  SELECT t + 1, pool, id, rest, c, first_value({'i': id, 'r': rest, 'c': c}) OVER (PARTITION BY pool ORDER BY round(rest, 12) DESC, id) FROM (
    SELECT t, pool, id, CASE WHEN id = pick.i OR rest < 0 THEN -1 ELSE greatest(rest - coef ** 2, 1e-12) END AS rest, list_append(c, coef) AS c FROM (
      SELECT r_l.*, (kern.k - coalesce(list_sum(list_transform(list_zip(c, pick.c), lambda p: p[1] * p[2])), 0)) / sqrt(pick.r) AS coef
      FROM r_l JOIN kern ON kern.pool = r_l.pool AND kern.a = r_l.id AND kern.b = r_l.pick.i JOIN n ON n.pool = r_l.pool WHERE t < n.k))),
pick_logdet AS (SELECT DISTINCT pool, t AS rank, pick.i AS id FROM r_l)""",
    "facility": """m_f AS (SELECT pool, a AS id FROM d GROUP BY pool, a QUALIFY row_number() OVER (PARTITION BY pool ORDER BY round(sum(d), 9), a) = 1),
r_f(t, pool, id, gap, picks) AS (SELECT 1, pool, b, d.d, [m_f.id] FROM m_f JOIN d USING (pool) WHERE d.a = m_f.id UNION ALL
  SELECT t + 1, pool, id, least(gap, max(CASE WHEN a = pick THEN d END) OVER (PARTITION BY pool, id)), list_append(picks, pick) FROM (
    SELECT *, first_value(a) OVER (PARTITION BY pool ORDER BY list_contains(picks, a), round(gain, 9) DESC, a) AS pick FROM (
      SELECT t, r_f.pool, r_f.id, gap, picks, d.a, d.d, sum(greatest(gap - d.d, 0)) OVER (PARTITION BY r_f.pool, d.a) AS gain
      FROM r_f JOIN d ON d.pool = r_f.pool AND d.b = r_f.id JOIN n ON n.pool = r_f.pool WHERE t < n.k))
  QUALIFY a = id),
pick_facility AS (SELECT DISTINCT pool, t AS rank, picks[t] AS id FROM r_f)""",
}


def _varied_sql(method: str) -> str:
    return f"WITH RECURSIVE {_PAIRS}, {_GREEDY[method]} SELECT pool, '{method}' AS condition, rank::INT AS rank, id AS episode_hash FROM pick_{method}"


def _varied(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    """A quarter of each pool, five at least. Greedy picks of a smaller budget are the first of those of a larger one."""
    points = bind.vectors(spark, sf_dir)
    k = settled(points.groupBy("pool").agg(F.greatest(F.lit(5), F.floor(0.25 * F.count(F.lit(1)))).alias("k")))
    most = k.agg(F.max("k")).first()[0] or 0  # one number
    picks = subset.select_varied(points, most, method, "episode_hash", "z", ["pool"])
    return picks.join(k, "pool").where(F.col("rank") <= F.col("k")).drop("k")


@query(_varied_sql("kcenter"))
def select_k_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _varied(spark, sf_dir, "kcenter")


@query(_varied_sql("logdet"))
def select_log_det(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _varied(spark, sf_dir, "logdet")


@query(_varied_sql("facility"))
def select_facility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _varied(spark, sf_dir, "facility")


@query(f"WITH {_PAIRS} SELECT pool, round(1 / greatest(median(d), 1e-9), 6) AS gamma FROM d WHERE a < b AND d > 1e-12 GROUP BY pool")
def bandwidths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(subset.median_bandwidth(bind.vectors(spark, sf_dir), "episode_hash", "z", ["pool"]))


@query("SELECT round(sum((x - m)**2), 4) AS spread FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings) JOIN (SELECT k, avg(x) AS m FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY k) USING (k)")
def pca_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All principal coordinates keep the points' squared distances from their mean."""
    coords = embed.pca_coords(bind.vectors(spark, sf_dir), "z", 64)
    return coords.select(F.explode("coords").alias("c")).agg(F.round(F.sum(F.col("c") ** 2), 4).alias("spread"))


@query()
def pca_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.pca_coords(bind.vectors(spark, sf_dir), "z", 20).select("episode_hash", "coords")


@query(
    f"WITH {_POOLS}, c AS (SELECT * FROM v WHERE pool IS DISTINCT FROM 5 QUALIFY row_number() OVER (PARTITION BY pool ORDER BY id) <= greatest(3, floor(0.25 * count(*) OVER (PARTITION BY pool)))) "
    "SELECT v.pool, v.id AS episode_hash, round(min(list_sum(list_transform(list_zip(v.z, c.z), lambda p: (p[1] - p[2]) ** 2))), 6) AS nearest "
    "FROM v LEFT JOIN c ON v.pool IS NOT DISTINCT FROM c.pool GROUP BY v.pool, v.id"
)
def coverage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool 5 has no pick."""
    v = _pools(spark, sf_dir)
    ranked = embed.rank_within(v, ["pool"], ["episode_hash"]).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("pool")))
    chosen = ranked.where((F.col("rank") <= F.greatest(F.lit(3), F.floor(0.25 * F.col("n")))) & ~F.col("pool").eqNullSafe(5)).drop("rank", "n")
    return rounded(embed.coverage(v, chosen, "episode_hash", "z", ["pool"]).drop("compared"))


def _camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = bind.frames(spark, sf_dir)
    p = into_head([F.get("left_ee", F.lit(k)) for k in range(3)], [F.get("head", F.lit(k)) for k in range(7)])
    u, v, ok = pinhole(p, 133.0, 320.0, 240.0)
    inside: Column = ok & u.between(0, 640) & v.between(0, 480)
    return f.groupBy("episode_hash").agg((1 - F.avg(F.coalesce(inside, F.lit(False)).cast("double"))).alias("out_of_frame"))


@query("""WITH l AS (SELECT l_suppkey AS ep, l_quantity AS q, l_extendedprice/1000 AS e, l_discount*100 AS d, l_tax*100 AS t FROM lineitem),
n AS (SELECT *, sqrt((t/8)**2 + (d/10)**2 + (q/50)**2 + 1) AS m FROM l), u AS (SELECT *, t/8/m AS qx, d/10/m AS qy, q/50/m AS qz, 1/m AS qw, q - q/10 AS px, e - t AS py, d - d AS pz FROM n),
c AS (SELECT ep, px*(1-2*(qy*qy+qz*qz)) + py*2*(qx*qy+qz*qw) + pz*2*(qx*qz-qy*qw) AS x, px*2*(qx*qy-qz*qw) + py*(1-2*(qx*qx+qz*qz)) + pz*2*(qy*qz+qx*qw) AS y, px*2*(qx*qz+qy*qw) + py*2*(qy*qz-qx*qw) + pz*(1-2*(qx*qx+qy*qy)) AS z FROM u)
SELECT ep AS episode_hash, round(1 - avg((CASE WHEN z > 0.01 THEN 133*x/z+320 BETWEEN 0 AND 640 AND 133*y/z+240 BETWEEN 0 AND 480 ELSE false END)::INT), 6) AS out_of_frame FROM c GROUP BY ep""")
def out_of_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_camera(spark, sf_dir))


@query(f"WITH {_CATALOG} SELECT seed, episode_hash, row_number() OVER (PARTITION BY seed ORDER BY md5(concat_ws('|', seed, 'eval', episode_hash)), episode_hash) <= floor(count(*) OVER (PARTITION BY seed) * 0.25) AS is_eval FROM cat, (SELECT unnest([0, 1, 2]) AS seed)")
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.random_split(bind.catalog(spark, sf_dir), [0, 1, 2], "episode_hash").select("seed", "episode_hash", "is_eval")


@query(f"WITH {_MEMBERS} SELECT seed, k_frac, condition, lab, count(*) AS picks FROM m JOIN cat USING (episode_hash) GROUP BY ALL")
def picks_per_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.picks_per_cluster(_members(spark, sf_dir), bind.catalog(spark, sf_dir), "episode_hash", "lab", ["seed", "k_frac", "condition"])


@query(
    f"WITH {_CATALOG} SELECT count_if(num_frames < 0) AS unset, count_if(num_frames > 3000) AS too_long, count_if(num_frames BETWEEN 0 AND 29) AS too_short, "
    "coalesce((SELECT string_agg(v::VARCHAR, ',' ORDER BY v) FROM (SELECT DISTINCT num_frames::BIGINT AS v FROM cat WHERE num_frames < 30 OR num_frames > 3000 ORDER BY v LIMIT 10)), '') AS odd FROM cat"
)
def length_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.length_sanity(bind.catalog(spark, sf_dir)).withColumn("odd", F.concat_ws(",", F.transform("odd", lambda x: x.cast("long").cast("string"))))


@query(f"WITH {_CATALOG}, ends AS (SELECT episode_hash, floor(num_frames * 0.08::DOUBLE) AS a, floor(num_frames * 0.92::DOUBLE) AS b FROM cat) SELECT episode_hash, i::INT AS pick, floor(a + (b - a) * i / 7)::INT AS frame_idx FROM ends, range(8) AS t(i)")
def sampled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.catalog(spark, sf_dir).select("episode_hash", F.posexplode(ingest.evenly_spaced(F.col("num_frames"), 8)).alias("pick", "frame_idx"))


_FLAGS = {"fast_hand": "max_hand_speed > 2500", "fast_head": "max_head_speed > 200", "idle": "idle_frac > 0", "slow_start": "lead_in_s > 0"}


@query(f"WITH {_FRAMES}, {_MOVES} " + " UNION ALL ".join(f"SELECT '{k}' AS flag, count_if({p}) AS n_flagged, round(100.0 * count_if({p}) / count(*), 6) AS pct FROM cand" for k, p in _FLAGS.items()))
def flag_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gate.flag_prevalence(signals.candidate_signals(bind.frames(spark, sf_dir), bind.POINTS), {k: F.expr(p) for k, p in _FLAGS.items()}))


@query(f"WITH {_RUNS} SELECT seed, " + ", ".join(f"round(max(CASE WHEN condition = '{c}' THEN mse END), 6) AS \"{c}\"" for c in ("view", "click", "purchase")) + " FROM res GROUP BY seed")
def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.pivot_runs(bind.results(spark, sf_dir), "seed", ["view", "click", "purchase"], "mse"))



_TRACKS = ["left_ee", "right_ee", "head"]
_SETTING = experiment.Setting(features=64)


def _poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.frames(spark, sf_dir).select("episode_hash", "frame_idx", *[F.slice(t, 1, 3).alias(t) for t in _TRACKS])


def _episodes(spark: SparkSession, sf_dir: str, features: bool = True) -> DataFrame:
    """Gated suppliers with operators, scenes and features."""
    rules = tuple(r for r in BOUND_RULES if r.signal == "duration_s")
    f = signals.embedding_features(bind.frames(spark, sf_dir), bind.POINTS).withColumn("duration_s", F.col("f_duration_s"))
    meta = bind.suppliers(spark, sf_dir)
    return settled(ingest.join_meta(gate.apply_gate(settled(f), rules), meta, ["operator", "scene"]))


_POSES = """po AS (SELECT l_suppkey AS ep, row_number() OVER w - 1 AS f, l_quantity::FLOAT::DOUBLE AS q, (l_extendedprice / 1000)::FLOAT::DOUBLE AS e, (l_discount * 100)::FLOAT::DOUBLE AS d, (l_tax * 100)::FLOAT::DOUBLE AS t, (l_quantity / 10)::FLOAT::DOUBLE AS q10
 FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey)),
wn AS (SELECT ep, unnest(range(10, n - 30, 15)) AS s FROM (SELECT ep, count(*) AS n FROM po GROUP BY ep) WHERE n >= 41),
xs AS (SELECT wn.ep, s, (po.f - (s - 10)) * 9 + k AS k, [q, e, d, t, q, d, q10, t, d][k + 1] AS v FROM wn JOIN po ON po.ep = wn.ep AND po.f BETWEEN s - 10 AND s - 1, range(9) AS r(k)),
ys AS (SELECT wn.ep, s, sum(abs((po.q - b.q)::FLOAT)::DOUBLE + abs((po.e - b.e)::FLOAT)::DOUBLE + abs((po.d - b.d)::FLOAT)::DOUBLE + abs((po.t - b.t)::FLOAT)::DOUBLE + abs((po.q - b.q)::FLOAT)::DOUBLE + abs((po.d - b.d)::FLOAT)::DOUBLE) AS moved FROM wn JOIN po b ON b.ep = wn.ep AND b.f = s - 1 JOIN po ON po.ep = wn.ep AND po.f BETWEEN s AND s + 29 GROUP BY ALL)"""


@query(f"WITH {_POSES} SELECT ep AS episode_hash, s::INT AS start, count(*) AS n_x, round(sum(v * (k + 1)), 2) AS sum_x, round(any_value(moved), 2) AS moved FROM xs JOIN ys USING (ep, s) GROUP BY ep, s")
def episode_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ridge.episode_windows(_poses(spark, sf_dir), _TRACKS)
    total = lambda a, of: F.round(F.aggregate(F.transform(a, of), F.lit(0.0), lambda s, x: s + x), 2)
    return w.select("episode_hash", "start", F.size("x").cast("long").alias("n_x"), total("x", lambda x, i: x.cast("double") * (i + 1)).alias("sum_x"), total("y", lambda x: F.abs(x).cast("double")).alias("moved"))


@query(f"WITH {_POSES} SELECT 'lab' || (s_nationkey % 3) AS run, k::INT AS k, count(*) AS n, round(avg(v), 5) AS mean, round(stddev_pop(v) + 1e-6, 5) AS std FROM xs JOIN supplier ON s_suppkey = ep GROUP BY 1, 2")
def train_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ridge.episode_windows(_poses(spark, sf_dir), _TRACKS)
    return rounded(ridge.moments(w, bind.suppliers(spark, sf_dir).select("episode_hash", F.col("lab").alias("run")), ["run"]), 5)


_HALVES = """su AS (SELECT s_suppkey AS ep, 'lab' || (s_nationkey % 3) AS lab FROM supplier),
hv AS (SELECT seed, ep, row_number() OVER (PARTITION BY seed ORDER BY md5(concat_ws('|', seed, 'eval', ep)), ep) <= floor(count(*) OVER (PARTITION BY seed) * 0.5) AS picked FROM su, (SELECT unnest([0, 1]) AS seed) WHERE lab <> 'lab0'),
tr AS (SELECT 'seed' || seed AS run, seed, ep FROM hv WHERE picked), ev AS (SELECT run, 'unseen_lab' AS side, ep FROM su, (SELECT unnest(['seed0', 'seed1']) AS run) WHERE lab = 'lab0')"""


@query(f"WITH RECURSIVE {fit_sql.POSES}, {fit_sql.windows()}, {_HALVES}, {fit_sql.fit_and_score(experiment.Setting().features)} SELECT run, alpha, side, n, round(mse, 5) AS mse FROM fit_r")
def select_fit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two random halves of the suppliers, fitted at full size and scored on the suppliers of one lab."""
    w, eps = settled(ridge.episode_windows(_poses(spark, sf_dir), _TRACKS)), bind.suppliers(spark, sf_dir)
    seeded = settled(sampling.random_split(eps.where("lab <> 'lab0'"), [0, 1], "episode_hash", 0.5)).where("is_eval")
    train = seeded.select(F.concat(F.lit("seed"), F.col("seed").cast("string")).alias("run"), "episode_hash", "seed")
    sides = eps.where("lab = 'lab0'").withColumn("run", F.explode(F.array(F.lit("seed0"), F.lit("seed1")))).select("run", F.lit("unseen_lab").alias("side"), "episode_hash")
    return rounded(ridge.fit_and_score(w, train, sides, features=experiment.Setting().features), 5)


_ONE_MODEL = "tr AS (SELECT 'all' AS run, 0 AS seed, s_suppkey AS ep FROM supplier WHERE s_nationkey % 3 <> 0), ev AS (SELECT 'all' AS run, 'unseen' AS side, s_suppkey AS ep FROM supplier WHERE s_nationkey % 3 = 0)"


@query(
    f"WITH RECURSIVE {fit_sql.POSES}, {fit_sql.windows()}, {_ONE_MODEL}, {fit_sql.lifted(_SETTING.features)}, {fit_sql.fitted(_SETTING.features)}, "
    "each_w AS (SELECT ep, s, list_sum(list_transform(y, lambda v: abs(v))) / len(y) AS motion, list_sum(list_transform(list_zip(w, y), lambda q: (list_dot_product(h, q[1]) - q[2]) ** 2)) / len(y) AS mse FROM fit_h, fit_w WHERE side = 'unseen') "
    "SELECT ep AS episode_hash, s::INT AS start, round(motion, 5) AS motion, round(mse, 5) AS mse, round(avg(mse) OVER (PARTITION BY ep), 5) AS episode_mse, "
    "row_number() OVER (PARTITION BY ep ORDER BY motion, s) - 1 = floor(count(*) OVER (PARTITION BY ep) * 0.85) AS shown FROM each_w"
)
def window_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, eps = settled(ridge.episode_windows(_poses(spark, sf_dir), _TRACKS)), bind.suppliers(spark, sf_dir)
    models = ridge.fit_models(w, eps.where("lab <> 'lab0'").select(F.lit("all").alias("run"), "episode_hash"), features=_SETTING.features)
    own = w.join(eps.where("lab = 'lab0'").select("episode_hash"), "episode_hash", "left_semi")
    return rounded(ridge.error_by_window(own, models["all"]), 5)


def _experiment_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.assign_split(_episodes(spark, sf_dir), [0, 1, 2])


_BOUND = {r.name: r.bound for r in BOUND_RULES}
_SUPPLIERS = f"""{_FRAMES}, fe AS (SELECT ep AS episode_hash, {', '.join(_FEATURE_SQL)} FROM s1 GROUP BY ep),
cat AS MATERIALIZED (SELECT fe.*, f_duration_s AS duration_s, 'o' || s_nationkey AS operator, 's' || (s_suppkey % 8) AS scene FROM fe JOIN supplier ON s_suppkey = episode_hash)"""
_EXPERIMENT = f"{_SUPPLIERS}, {_split_sql(_BOUND['too_short'], _BOUND['runaway'], _BOUND['fragment'])}, {_PLAIN_MEMBERS}"
_WHITE = ", ".join(f"(coalesce(nullif({c}, 'nan'::DOUBLE), 0) - avg(coalesce(nullif({c}, 'nan'::DOUBLE), 0)) OVER w) / (stddev_pop(coalesce(nullif({c}, 'nan'::DOUBLE), 0)) OVER w + 1e-9)" for c in FEATURES)


def _geometric(methods: tuple[str, ...]) -> str:
    """CTEs from ``sp`` and ``bud`` up to ``geo``: the picks of the geometric conditions."""
    each = " UNION ALL ".join(f"SELECT pool AS seed, k_frac, '{c}' AS condition, rank::BIGINT AS rank, id AS episode_hash FROM pick_{c} JOIN bud ON bud.seed = pool WHERE rank <= k" for c in methods)
    return f"""v AS MATERIALIZED (SELECT seed AS pool, episode_hash AS id, [{_WHITE}] AS z FROM sp WHERE pool_gated WINDOW w AS (PARTITION BY seed)),
n AS (SELECT pool, least(count(*), (SELECT max(k) FROM bud))::BIGINT AS k FROM v GROUP BY pool), {_DISTANCES}, {', '.join(_GREEDY[c] for c in methods)}, geo AS ({each})"""


def _runs_sql(sides: str, least: int = 50, win: str = "win", n: str = "") -> str:
    """CTEs from the membership ``mm`` (seed, k_frac, condition, episode_hash) and the windows up to ``tr`` and ``ev``: runs of enough
    windows, of seeds that have windows on each of ``sides``, a query of (seed, side, ep)."""
    return f"""cw{n} AS (SELECT ep, count(*) AS w FROM {win} GROUP BY ep), si{n} AS ({sides}),
sn{n} AS (SELECT seed, side, count(*) AS n_eval_eps, coalesce(sum(w), 0)::BIGINT AS n_eval_win FROM si{n} LEFT JOIN cw{n} USING (ep) GROUP BY ALL),
ok{n} AS (SELECT seed FROM sn{n} WHERE n_eval_win > 0 GROUP BY seed HAVING count(*) = (SELECT count(DISTINCT side) FROM si{n})),
ru{n} AS (SELECT seed, k_frac, condition, concat_ws('|', seed, k_frac, condition) AS run, count(*) AS n_train_eps, coalesce(sum(w), 0)::BIGINT AS n_train_win FROM mm LEFT JOIN cw{n} ON ep = episode_hash WHERE seed IN (FROM ok{n}) GROUP BY ALL HAVING coalesce(sum(w), 0) >= {least}),
tr{n} AS (SELECT run, mm.seed, episode_hash AS ep FROM mm JOIN ru{n} USING (seed, k_frac, condition)), ev{n} AS (SELECT run, side, ep FROM ru{n} JOIN si{n} USING (seed))"""


_AXES = "SELECT seed, split AS side, episode_hash AS ep FROM sp WHERE split <> 'pool'"
_VARIED_SQL = _geometric(experiment.VARIED)
_BOTH = "max(CASE WHEN side = 'eval_operator' THEN mse END) AS mse_unseen_operator, max(CASE WHEN side = 'eval_scene' THEN mse END) AS mse_unseen_scene"


@query(f"""WITH RECURSIVE {_EXPERIMENT}, {_VARIED_SQL}, mm AS (SELECT seed, k_frac, condition, episode_hash FROM m UNION ALL SELECT seed, k_frac, condition, episode_hash FROM geo UNION ALL SELECT seed, 1.0, 'all_gated', episode_hash FROM sp WHERE pool_gated),
gc AS (SELECT seed, k_frac, condition, CASE WHEN condition = 'random_nogate' THEN -1 ELSE count(DISTINCT operator || '|' || scene) END AS n_groups FROM mm JOIN cat USING (episode_hash) GROUP BY seed, k_frac, condition),
{fit_sql.POSES}, {fit_sql.windows()}, {_runs_sql(_AXES)}, {fit_sql.fit_and_score(_SETTING.features)}, re AS (SELECT run, {_BOTH} FROM fit_r GROUP BY run)
SELECT seed, k_frac, condition, n_train_eps, n_train_win, round(mse_unseen_operator, 5) AS mse_unseen_operator, round(mse_unseen_scene, 5) AS mse_unseen_scene, n_groups FROM ru JOIN re USING (run) JOIN gc USING (seed, k_frac, condition)""")
def experiment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = settled(ridge.episode_windows(_poses(spark, sf_dir), _TRACKS))
    out = experiment.run_experiment(w, _experiment_split(spark, sf_dir), FEATURES, [0.25, 0.5], setting=_SETTING)
    return out.select("seed", "k_frac", "condition", "n_train_eps", "n_train_win", *[F.round(c, 5).alias(c) for c in experiment.METRICS], F.col("n_groups").cast("long").alias("n_groups"))


@query(f"WITH RECURSIVE {_EXPERIMENT}, {_VARIED_SQL} SELECT seed, k_frac, condition, rank, episode_hash FROM geo")
def geometric_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.run_selectors(_experiment_split(spark, sf_dir), FEATURES, [0.25, 0.5], experiment.VARIED)


#: The sweep's nine settings at an eighth of its features.
_SWEEP = tuple(experiment.Setting(g.alpha, g.features // 8, g.history, g.horizon) for g in experiment.GRID)
_SWEPT = ("random", *experiment.VARIED, "concentrated")


def _sweep_sql(grid: tuple[experiment.Setting, ...]) -> str:
    parts, scores, cut = [], [], {}
    for history, horizon in sorted({(g.history, g.horizon) for g in grid}):
        cut[history, horizon] = f"w{len(cut)}"
        name = cut[history, horizon]
        parts += [fit_sql.windows(history, horizon, name), _runs_sql(_AXES, win=name, n=f"_{name}")]
        for features in sorted({g.features for g in grid if (g.history, g.horizon) == (history, horizon)}):
            alphas = tuple(g.alpha for g in grid if (g.history, g.horizon, g.features) == (history, horizon, features))
            n = f"{name}_{features}"
            parts.append(fit_sql.fit_and_score(features, alphas, name, f"tr_{name}", f"ev_{name}", n))
            scores.append(f"SELECT seed, condition, alpha, {features} AS n_features, {history} AS history, {horizon} AS horizon, side, mse FROM {n}_r JOIN ru_{name} USING (run)")
    pct = lambda side: f"round(avg(100.0 * (r.mse / b.mse - 1)) FILTER (r.side = '{side}'), 4)"
    return f"""{', '.join(parts)}, al AS ({' UNION ALL '.join(scores)})
SELECT r.condition, r.alpha, r.n_features, r.history, r.horizon, {pct('eval_operator')} AS mse_unseen_operator, {pct('eval_scene')} AS mse_unseen_scene
FROM al r JOIN al b USING (seed, alpha, n_features, history, horizon, side) WHERE b.condition = 'random' AND r.condition <> 'random' GROUP BY ALL"""


@query(f"WITH RECURSIVE {_EXPERIMENT}, {_VARIED_SQL}, mm AS (SELECT seed, k_frac, condition, episode_hash FROM (FROM m UNION ALL BY NAME FROM geo) WHERE k_frac = 0.25 AND condition IN {_SWEPT}), {fit_sql.POSES}, {_sweep_sql(_SWEEP)}")
def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweep = experiment.sensitivity_sweep(_poses(spark, sf_dir), _TRACKS, _experiment_split(spark, sf_dir), FEATURES, _SWEEP, conditions=_SWEPT)
    return rounded(compare.sensitivity_summary(sweep, experiment.METRICS), 4)


_PRICE_ARM = "row_number() OVER (PARTITION BY ra.seed ORDER BY md5(concat_ws('|', ra.seed, 'pick', episode_hash)), episode_hash)"
_PRICE_UPTO = "sum(n_windows) OVER (PARTITION BY ra.seed ORDER BY md5(concat_ws('|', ra.seed, 'until', episode_hash)), episode_hash ROWS UNBOUNDED PRECEDING) AS upto"
_PRICE = f"""{_SUPPLIERS}, {_split_sql(_BOUND['too_short'], _BOUND['runaway'], _BOUND['fragment'])}, {fit_sql.POSES}, {fit_sql.windows()},
g0 AS (SELECT episode_hash, keep, coalesce(w, 0) AS n_windows FROM kept LEFT JOIN (SELECT ep, count(*) AS w FROM win GROUP BY ep) ON ep = episode_hash),
ra AS MATERIALIZED (SELECT g0.*, seed, row_number() OVER (PARTITION BY seed ORDER BY md5(concat_ws('|', seed, 'eval', episode_hash)), episode_hash) <= floor(count(*) OVER (PARTITION BY seed) * 0.25) AS is_eval FROM g0, seeds),
gb AS (SELECT seed, count(*) AS k, sum(n_windows) AS target FROM ra WHERE keep AND NOT is_eval GROUP BY seed),
mm AS (SELECT seed, 1.0 AS k_frac, condition, episode_hash FROM (
  SELECT seed, 'gated_equal_episodes' AS condition, episode_hash FROM ra WHERE keep AND NOT is_eval
  UNION ALL SELECT seed, 'ungated_equal_episodes', episode_hash FROM (SELECT ra.*, k, {_PRICE_ARM} AS r FROM ra JOIN gb ON gb.seed = ra.seed WHERE NOT is_eval) WHERE r <= k
  UNION ALL SELECT seed, 'gated_equal_frames', episode_hash FROM (SELECT ra.*, target, {_PRICE_UPTO} FROM ra JOIN gb ON gb.seed = ra.seed WHERE keep AND NOT is_eval AND n_windows > 0) WHERE upto - n_windows < target
  UNION ALL SELECT seed, 'ungated_equal_frames', episode_hash FROM (SELECT ra.*, target, {_PRICE_UPTO} FROM ra JOIN gb ON gb.seed = ra.seed WHERE NOT is_eval AND n_windows > 0) WHERE upto - n_windows < target)),
{_runs_sql("SELECT seed, 'unseen' AS side, episode_hash AS ep FROM ra WHERE is_eval AND keep")}, {fit_sql.fit_and_score(_SETTING.features)},
pr AS (SELECT seed, condition, n_train_eps, n_train_win, n_eval_eps, n_eval_win, mse AS avg_mse FROM ru JOIN fit_r USING (run) JOIN sn USING (seed))"""


@query(f"WITH RECURSIVE {_PRICE} SELECT seed, condition, n_train_eps, n_train_win, n_eval_eps, n_eval_win, round(avg_mse, 5) AS avg_mse FROM pr")
def gate_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_gate_value(spark, sf_dir), 5)


def _gate_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = settled(ridge.episode_windows(_poses(spark, sf_dir), _TRACKS))
    return experiment.gate_value(w, _episodes(spark, sf_dir), [0, 1, 2], _SETTING)


_ARM_MEAN = ", ".join(f"round(avg(CASE WHEN arm = '{a}' THEN {c} END), 5) AS {a}_{k}" for a in ("gated", "ungated") for c, k in (("avg_mse", "mse"), ("n_train_eps", "eps"), ("n_train_win", "win")))


@query(f"""WITH RECURSIVE {_PRICE}, ar AS (SELECT *, split_part(condition, '_', 1) AS arm, substr(condition, instr(condition, '_') + 1) AS mode FROM pr),
dl AS (SELECT g.mode AS condition, g.avg_mse - u.avg_mse AS delta, 100.0 * (g.avg_mse / u.avg_mse - 1) AS pct FROM ar g JOIN ar u USING (seed, mode) WHERE g.arm = 'gated' AND u.arm = 'ungated'),
{_TESTS}
SELECT mode, {_ARM_MEAN}, any_value(n) AS n, any_value(wins) AS wins, round(any_value(mean_pct), 4) AS mean_pct, round(any_value(least(1.0, p_sign)), 5) AS p_sign, round(any_value(least(1.0, p)), 5) AS p_wilcoxon
FROM ar JOIN al ON al.condition = mode JOIN ps ON ps.condition = mode JOIN pw ON pw.condition = mode GROUP BY mode""")
def gate_value_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare.gate_value_summary(settled(_gate_value(spark, sf_dir)))
    return out.select(*[F.round(c, 4 if c == "mean_pct" else 5).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


_ARM = "row_number() OVER (PARTITION BY seed ORDER BY md5(concat_ws('|', seed, 'pick', episode_hash)), episode_hash)"
_UPTO = "sum(n_windows) OVER (PARTITION BY seed ORDER BY md5(concat_ws('|', seed, 'until', episode_hash)), episode_hash ROWS UNBOUNDED PRECEDING) AS upto"
_GATE_ARMS = f"""{_CATALOG}, med AS (SELECT median(duration_s) AS m FROM cat), g0 AS (SELECT episode_hash, {_W} AS n_windows, NOT (duration_s < 3 OR duration_s > 3 * m OR duration_s < 0.15 * m) AS keep FROM cat, med),
rs AS (SELECT g0.*, seed, row_number() OVER (PARTITION BY seed ORDER BY md5(concat_ws('|', seed, 'eval', episode_hash)), episode_hash) <= floor(count(*) OVER (PARTITION BY seed) * 0.25) AS is_eval FROM g0, (SELECT unnest([0, 1]) AS seed)),
bud AS (SELECT seed, count(*) AS k, sum(n_windows) AS target FROM rs WHERE keep AND NOT is_eval GROUP BY seed)"""


@query(f"""WITH {_GATE_ARMS} SELECT seed, condition, episode_hash FROM (
SELECT seed, 'gated_equal_episodes' AS condition, episode_hash FROM rs WHERE keep AND NOT is_eval
UNION ALL SELECT seed, 'ungated_equal_episodes', episode_hash FROM (SELECT rs.*, k, {_ARM.replace("seed", "rs.seed")} AS r FROM rs JOIN bud ON bud.seed = rs.seed WHERE NOT is_eval) WHERE r <= k
UNION ALL SELECT seed, 'gated_equal_frames', episode_hash FROM (SELECT rs.seed, episode_hash, n_windows, target, {_UPTO.replace("seed", "rs.seed")} FROM rs JOIN bud ON bud.seed = rs.seed WHERE keep AND NOT is_eval AND n_windows > 0) WHERE upto - n_windows < target
UNION ALL SELECT seed, 'ungated_equal_frames', episode_hash FROM (SELECT rs.seed, episode_hash, n_windows, target, {_UPTO.replace("seed", "rs.seed")} FROM rs JOIN bud ON bud.seed = rs.seed WHERE NOT is_eval AND n_windows > 0) WHERE upto - n_windows < target)""")
def gate_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = gate.apply_gate(bind.catalog(spark, sf_dir), _LENGTH_RULES).withColumn("n_windows", ridge.window_count("num_frames"))
    return experiment.gate_arms(gated, [0, 1])[0].select("seed", "condition", "episode_hash")


_KEPT = f"{_CATALOG}, med AS (SELECT median(duration_s) AS m FROM cat), kept AS (SELECT cat.*, NOT (duration_s < 3 OR duration_s > 3 * m OR duration_s < 0.15 * m) AS keep, concat_ws('|', CASE WHEN duration_s < 3 THEN 'too_short' END, CASE WHEN duration_s > 3 * m THEN 'runaway' END, CASE WHEN duration_s < 0.15 * m THEN 'fragment' END) AS why, m FROM cat, med)"


@query(f"WITH {_KEPT} SELECT count(*) AS n_total, count_if(NOT keep) AS n_dropped, round(max(CASE WHEN NOT keep THEN duration_s END), 6) AS longest_dropped, round(median(duration_s), 6) AS median_dur, round(100.0 * count_if(NOT keep) / count(*), 6) AS pct_dropped, count_if(keep) AS n_pool, greatest(5, floor(count_if(keep) * 0.25))::BIGINT AS k FROM kept")
def headline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.headline_stats(gate.apply_gate(bind.catalog(spark, sf_dir), _LENGTH_RULES)))


@query(f"WITH {_RUNS}, m AS (SELECT condition, avg(mse) AS mean FROM res GROUP BY condition) SELECT condition, round(mean, 6) AS mean, round(100.0 * (mean / (SELECT mean FROM m WHERE condition = 'view') - 1), 6) AS pct FROM m")
def condition_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.condition_headline(bind.results(spark, sf_dir), "mse", "view"))


@query(f"WITH {_KEPT}, o AS (SELECT operator, row_number() OVER (ORDER BY operator) - 1 AS op FROM (SELECT DISTINCT coalesce(operator, '') AS operator FROM cat)), s AS (SELECT scene, row_number() OVER (ORDER BY scene) - 1 AS sc FROM (SELECT DISTINCT scene FROM cat)) SELECT episode_hash, op, sc, round(duration_s, 1) AS dur, keep, why FROM kept JOIN o ON o.operator = coalesce(kept.operator, '') JOIN s USING (scene)")
def episode_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported records, parsed again."""
    cat = bind.catalog(spark, sf_dir)
    gated = gate.apply_gate(cat, _LENGTH_RULES).withColumn("motion_energy", F.lit(float("nan")))
    out = compare.export_episodes_json(gated, profile.ordinal_codes(cat, "operator"), profile.ordinal_codes(cat, "scene"))
    return out.select("episode_hash", F.inline(F.array(F.from_json("json", "op long, sc long, dur double, keep boolean, why string"))))


_SEEN = "SELECT conv_id AS episode_hash, count(*) AS n_frames, round(avg((length(text) % 3 > 0)::INT), 6) AS hand_visible_frac, round(avg(length(text) % 3), 6) AS mean_hands_per_frame, count_if(length(text) % 3 >= 2) AS frames_with_two_hands FROM conversations WHERE text IS NOT NULL GROUP BY conv_id"


@query(_SEEN)
def visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("episode_hash"), (F.length("text") % 3).alias("n_hands"))
    return rounded(camera.visibility_rollup(seen))


_KP = {"left": ("q", "d", "t-5"), "right": ("t", "d", "q-30")}


def _camera_sql() -> str:
    turned = "(SELECT [x + w*(2*(ay*z - az*y)) + ay*2*(ax*y - ay*x) - az*2*(az*x - ax*z), y + w*(2*(az*x - ax*z)) + az*2*(ay*z - az*y) - ax*2*(ax*y - ay*x), z + w*(2*(ax*y - ay*x)) + ax*2*(az*x - ax*z) - ay*2*(ay*z - az*y)])"
    arms = []
    for hand, (a, b, c) in _KP.items():
        pts = [(a, b, c), (f"{a}+1", f"{b}+{c}", c), (a, f"{b}-2", f"{c}+d"), (f"({a})/2", b, f"{c}-3")]
        arms.append(" UNION ALL ".join(f"SELECT ep, f, '{hand}' AS hand, ({x})::DOUBLE AS px, ({y})::DOUBLE AS py, ({z})::DOUBLE AS pz, q/10 AS hx, t AS hy, d AS hz, t/8/m AS ux, d/10/m AS uy, q/50/m AS uz, 1/m AS w FROM n" for x, y, z in pts))
    return f"""WITH l AS (SELECT l_suppkey AS ep, row_number() OVER (PARTITION BY l_suppkey) AS f, l_quantity AS q, l_discount*100 AS d, l_tax*100 AS t FROM lineitem), n AS (SELECT *, sqrt((t/8)**2 + (d/10)**2 + (q/50)**2 + 1) AS m FROM l),
p AS ({" UNION ALL ".join(arms)}), h AS (SELECT *, px-hx AS x, py-hy AS y, pz-hz AS z, -ux AS ax, -uy AS ay, -uz AS az FROM p), c AS (SELECT ep, f, hand, px, py, pz, {turned} AS g FROM h),
s AS (SELECT ep, f, hand, coalesce(pz > 0.01 AND 133*px/pz+320 >= 0 AND 133*px/pz+320 < 640 AND 133*py/pz+240 >= 0 AND 133*py/pz+240 < 480, false) AS raw, coalesce(g[3] > 0.01 AND 133*g[1]/g[3]+320 >= 0 AND 133*g[1]/g[3]+320 < 640 AND 133*g[2]/g[3]+240 >= 0 AND 133*g[2]/g[3]+240 < 480, false) AS head FROM c)
""" + " UNION ALL ".join(f"SELECT ep AS episode_hash, '{m}' AS model, round(1 - avg(CASE WHEN hand = 'left' THEN {m}::INT END), 5) AS left, round(1 - avg(CASE WHEN hand = 'right' THEN {m}::INT END), 5) AS right FROM s GROUP BY ep" for m in ("raw", "head"))


@query(_camera_sql())
def keypoints_out_of_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(camera.out_of_frame_fraction(bind.frames(spark, sf_dir)), 5)


@query("SELECT doc_id AS episode_hash, (quality IS NOT NULL)::INT AS has_annotations FROM labels")
def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("episode_hash"), F.when(F.col("quality").isNotNull(), 1).alias("n_annotations"))
    return ingest.has_annotations(log)


@query("SELECT d.doc_id AS episode_hash, l.quality FROM documents d LEFT JOIN (SELECT doc_id, any_value(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)")
def with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", "episode_hash")
    return ingest.join_meta(bind.catalog(spark, sf_dir).select("episode_hash"), labels, ["quality"])


@query("SELECT doc_id AS episode_hash FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def having_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("episode_hash"))
    return ingest.having(bind.catalog(spark, sf_dir), done, "episode_hash").select("episode_hash")


_LOG = "lg AS (SELECT o_orderstatus AS status, o_orderkey % 50 + 40 AS total_frames, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 51 + 40 END AS sql_num_frames, o_orderkey % 2 AS n_annotations, o_orderkey % 53 + 40 AS padded_len FROM orders)"


@query(f"WITH {_LOG} SELECT status, count(*) AS episodes, count_if(total_frames <> sql_num_frames) AS length_differs, count_if(n_annotations > 0) AS annotated, count_if(padded_len > total_frames) AS padded FROM lg GROUP BY status")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    log = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderstatus").alias("status"), (k % 50 + 40).alias("total_frames"), F.when(k % 3 > 0, k % 51 + 40).alias("sql_num_frames"), (k % 2).alias("n_annotations"), (k % 53 + 40).alias("padded_len"))
    return ingest.ingest_report(log)


@query("SELECT l_suppkey AS episode_hash, count(*) AS frames FROM (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey) - 1 AS f FROM lineitem) WHERE l_suppkey % 3 = 0 OR f < l_suppkey % 7 * 100 OR l_suppkey % 7 = 0 GROUP BY l_suppkey")
def trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("episode_hash")
    attrs = bind.suppliers(spark, sf_dir).select("episode_hash", F.when(k % 3 > 0, k % 7 * 100).alias("total_frames"))
    return ingest.trim_padding(bind.frames(spark, sf_dir).select("episode_hash", "frame_idx"), attrs).groupBy("episode_hash").agg(F.count(F.lit(1)).alias("frames"))


_LIST = '''ls AS (SELECT page_id % 40 AS episode, CASE WHEN page_id % 5 < 2 THEN 'images' || (page_id % 2) WHEN page_id % 5 < 4 THEN 'poses' ELSE 'gaze' END AS "array", length(html) AS size FROM pages)'''


@query(f'''WITH {_LIST} SELECT "array", count(DISTINCT episode) AS episodes, sum(size)::BIGINT AS bytes, round(sum(size) / count(DISTINCT episode), 6) AS mean_bytes, starts_with("array", 'images') AS is_image FROM ls GROUP BY "array"''')
def storage_by_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_storage(spark, sf_dir))


def _storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    name = F.when(k % 5 < 2, F.concat(F.lit("images"), (k % 2).cast("string"))).when(k % 5 < 4, "poses").otherwise("gaze")
    listing = spark.read.parquet(f"{sf_dir}/pages.parquet").select((k % 40).alias("episode"), F.concat(F.lit("data/"), (k % 40).cast("string"), F.lit("/"), name, F.lit("/c/0")).alias("key"), F.length("html").alias("size"), F.concat(F.lit("data/"), (k % 40).cast("string")).alias("prefix"))
    return ingest.storage_by_array(listing, prefix="prefix")


@query(f'''WITH {_LIST} SELECT starts_with("array", 'images') AS is_image, sum(size)::BIGINT AS bytes, round(sum(size) / 40 * 572, 6) AS projected_bytes FROM ls GROUP BY 1''')
def storage_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ingest.storage_projection(_storage(spark, sf_dir), 40, 572))


@query("SELECT doc_id AS episode_hash FROM documents WHERE lang = 'en' AND doc_id % 4 <> 0 AND trim(coalesce(text, '')) <> ''")
def catalog_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ingest.read_catalog(spark, f"{sf_dir}/documents.parquet").withColumn("is_deleted", F.when(F.col("doc_id") % 4 == 0, True))
    return ingest.slice_catalog(ingest.live(d), path="text", lang="en").select(F.col("doc_id").alias("episode_hash"))


@query("SELECT l_suppkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def pruned_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.read_frames(spark, f"{sf_dir}/lineitem.parquet", ["l_suppkey", "l_quantity"], "R", "l_returnflag")


@query(f"WITH {_CATALOG} SELECT DISTINCT scene FROM cat ORDER BY scene LIMIT 15")
def first_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.first_values(bind.catalog(spark, sf_dir))


@query(f"WITH {_KEPT}, t AS (SELECT 'typical' AS kind, episode_hash, duration_s AS value FROM kept WHERE keep ORDER BY abs(duration_s - m), episode_hash LIMIT 2), l AS (SELECT 'longest_dropped' AS kind, episode_hash, duration_s AS value FROM kept WHERE NOT keep ORDER BY duration_s DESC, episode_hash LIMIT 2) SELECT kind, episode_hash, round(value, 6) AS value FROM t UNION ALL SELECT kind, episode_hash, round(value, 6) FROM l")
def exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gate.exemplars(gate.apply_gate(bind.catalog(spark, sf_dir), _LENGTH_RULES)))


@query(f"""WITH {_SIGNALS}, {_gate_sql(BOUND_RULES)}, m AS (SELECT median(duration_s) AS m FROM gated), k AS (SELECT * FROM gated, m)
SELECT kind, episode_hash, round(value, 6) AS value FROM (
  (SELECT 'typical' AS kind, episode_hash, duration_s AS value FROM k WHERE drop_reason = '' ORDER BY abs(duration_s - m), episode_hash LIMIT 2)
  UNION ALL (SELECT 'longest_dropped', episode_hash, duration_s FROM k WHERE drop_reason <> '' ORDER BY duration_s DESC, episode_hash LIMIT 2)
  UNION ALL (SELECT 'least_off_axis', episode_hash, offaxis_deg_max FROM k WHERE drop_reason = '' ORDER BY round(offaxis_deg_max, 9), episode_hash LIMIT 2)
  UNION ALL (SELECT 'most_off_axis', episode_hash, offaxis_max FROM k WHERE rule_off_axis ORDER BY round(offaxis_max, 9) DESC, episode_hash LIMIT 2))""")
def exemplars_off_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = settled(gate.apply_gate(_signals(spark, sf_dir).withColumns({c: F.round(c, 9) for c in ("offaxis_deg_max", "offaxis_max")}), BOUND_RULES))
    return rounded(gate.exemplars(gated, off_axis=("offaxis_deg_max", "offaxis_max")))


class _Stopped(Exception):
    """The run ends between a batch's frames and its ledger."""


@query(
    "WITH f AS (SELECT l_suppkey AS ep, count(*) AS n FROM lineitem GROUP BY 1) SELECT s_suppkey AS episode_hash, CASE WHEN s_suppkey % 11 = 0 THEN 'error' ELSE 'ok' END AS status, "
    "CASE WHEN s_suppkey % 11 <> 0 THEN least(n, 100 + s_suppkey % 600) END AS frames FROM supplier JOIN f ON ep = s_suppkey"
)
def resumed_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of all suppliers, taken in four batches: a run that stops before the second batch is committed, and one that goes on."""
    frames, path = settled(bind.frames(spark, sf_dir).select("episode_hash", "frame_idx", "left_ee")), f"{scratch(spark)}/episodes"
    lengths = settled(frames.groupBy("episode_hash").agg(F.count(F.lit(1)).alias("padded_len")))

    def pull(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        k = F.col("episode_hash")
        log = batch.join(lengths, "episode_hash").withColumn("total_frames", F.least("padded_len", 100 + k % 600))
        log = log.select("episode_hash", F.when(k % 11 == 0, "error").otherwise("ok").alias("status"), "total_frames", "padded_len", F.lit(None).cast("long").alias("sql_num_frames"), F.lit(0).cast("long").alias("n_annotations"), F.when(k % 11 == 0, "unreadable").alias("error"))
        own = frames.join(batch.select("episode_hash"), "episode_hash", "left_semi")
        return ingest.trim_padding(own, log.where("status = 'ok'")), log

    def stop(number: int) -> None:
        if number == 2:
            raise _Stopped

    catalog = bind.suppliers(spark, sf_dir).select("episode_hash").join(lengths.select("episode_hash"), "episode_hash", "left_semi")
    try:
        resume.ingest(spark, catalog, pull, path, batches=4, before_commit=stop)
    except _Stopped:
        pass
    done = resume.ingest(spark, catalog, pull, path, batches=4)
    seen = resume.committed(spark, path).groupBy("episode_hash").agg(F.count(F.lit(1)).alias("frames"))
    last = done.groupBy("episode_hash").agg(F.max_by("status", "batch").alias("status"))
    return last.join(seen, "episode_hash", "left").select("episode_hash", "status", "frames")


@query("SELECT l_suppkey AS episode_hash, i::INT AS pick, f::INT AS frame_idx, round(q, 6) AS left_x FROM (SELECT l_suppkey, l_quantity AS q, row_number() OVER w - 1 AS f, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey)), range(11) t(i) WHERE f = CASE WHEN i < 8 THEN floor(floor(n * 0.08::DOUBLE) + (floor(n * 0.92::DOUBLE) - floor(n * 0.08::DOUBLE)) * i / 7) ELSE floor(n * [0.25, 0.5, 0.75][i - 7]::DOUBLE) END")
def frames_at_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight evenly spaced frames of each episode, then those at its quarters."""
    frames = settled(bind.frames(spark, sf_dir).select("episode_hash", "frame_idx", F.get("left_ee", F.lit(0)).alias("left_x")))
    attrs = settled(frames.groupBy("episode_hash").agg(F.count(F.lit(1)).alias("n")))
    places = F.concat(ingest.evenly_spaced(F.col("n"), 8), ingest.fixed_frames(F.col("n")))
    return rounded(ingest.sampled_frames(frames, attrs, places).select("episode_hash", "pick", "frame_idx", "left_x"))


@query(f"WITH {_SIGNALS}, {_gate_sql(BOUND_RULES)} SELECT lab, episode_hash, drop_reason FROM gated")
def written_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep and drop decisions written as CSV in folders by lab, twice, and read back."""
    gated, path = settled(gate.apply_gate(_signals(spark, sf_dir), BOUND_RULES).select("lab", "episode_hash", "drop_reason")), f"{scratch(spark)}/decisions"
    for _ in range(2):
        write_table(gated, path, "csv", by=("lab",))
    back = spark.read.option("header", True).schema("episode_hash long, drop_reason string, lab string").csv(path)
    return back.select("lab", "episode_hash", F.coalesce("drop_reason", F.lit("")).alias("drop_reason"))


@query(f"WITH {_SIGNALS} SELECT {_round_sql(['episode_hash', 'lab', *_SIGNAL_COLUMNS, *_PARTS])} FROM sig WHERE lab = 'lab1'")
def laid_out_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of one lab, from frames laid out once by lab and episode: no frame is exchanged, and only the lab's folder is read."""
    path = f"{scratch(spark)}/frames"
    name = f"frames_{path.split('/')[-2]}"
    ingest.lay_out_frames(bind.lines(spark, sf_dir), name, path, buckets=8, then=bind.tracks)
    own = ingest.read_frames(spark, spark.table(name), spark.table(name).columns, "lab1")
    return rounded(signals.quality_signals(own, bind.POINTS).select("episode_hash", "lab", *_SIGNAL_COLUMNS, *_PARTS))
