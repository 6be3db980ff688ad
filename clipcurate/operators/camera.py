"""Diagnostics of what the camera sees: kept as evidence of rules that were not adopted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipcurate.functions.points import into_head, pinhole

HANDS = ("left", "right")


def out_of_frame_fraction(frames: DataFrame, f: float = 133.0, size: tuple[int, int] = (640, 480), episode: str = "episode_hash") -> DataFrame:
    """(episode, model, left, right): mean share of a hand's points outside the image, of the points as they are (``raw``) and in
    the head's frame (``head``). Frames without the points or the head don't count. Points are rows, so that their geometry
    is plain column arithmetic; they are summed by episode before anything is exchanged."""
    hands = F.array(*[F.struct(F.lit(h).alias("hand"), F.col(f"{h}_kp").alias("kp")) for h in HANDS])
    each = frames.where("head is not null").select(episode, *[F.get("head", F.lit(k)).alias(f"h{k}") for k in range(7)], F.inline(hands)).where("size(kp) >= 3")
    point = lambda i: F.struct(*[F.get("kp", i * 3 + k).alias(a) for k, a in enumerate("xyz")])
    n = F.floor(F.size("kp") / 3).cast("int")
    points = each.select(episode, "hand", *[f"h{k}" for k in range(7)], (1 / n).alias("weight"), F.inline(F.transform(F.sequence(F.lit(0), n - 1), point)))
    p = [F.col(a) for a in "xyz"]
    turned = into_head(p, [F.col(f"h{k}") for k in range(7)])
    points = points.select(episode, "hand", "weight", *p, *[c.alias(f"t{a}") for c, a in zip(turned, "xyz", strict=True)])

    def outside(q: list[Column]) -> Column:
        u, v, ok = pinhole(q, f, size[0] / 2, size[1] / 2)
        seen = F.coalesce(ok & (u >= 0) & (u < size[0]) & (v >= 0) & (v < size[1]), F.lit(False))
        return F.sum(F.when(seen, 0.0).otherwise(F.col("weight"))) / F.sum("weight")

    models = {"raw": p, "head": [F.col(f"t{a}") for a in "xyz"]}
    shares = points.groupBy(episode, "hand").agg(*[outside(q).alias(m) for m, q in models.items()])
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("share")) for m in models])
    of = lambda h: F.max(F.when(F.col("hand") == h, F.col("share"))).alias(h)
    return shares.select(episode, "hand", F.inline(rows)).groupBy(episode, "model").agg(*[of(h) for h in HANDS])


def visibility_rollup(detections: DataFrame, catalog: DataFrame | None = None, episode: str = "episode_hash", n_hands: str = "n_hands") -> DataFrame:
    """(episode, n_frames, hand_visible_frac, mean_hands_per_frame, frames_with_two_hands) from a row a sampled frame; episodes of
    ``catalog`` without a frame have 0 frames and NULL shares."""
    out = detections.where(F.col(n_hands).isNotNull()).groupBy(episode).agg(
        F.count(F.lit(1)).alias("n_frames"), F.avg((F.col(n_hands) > 0).cast("double")).alias("hand_visible_frac"),
        F.avg(n_hands).alias("mean_hands_per_frame"), F.count_if(F.col(n_hands) >= 2).alias("frames_with_two_hands"),
    )
    if catalog is None:
        return out
    return catalog.select(episode).join(out, episode, "left").withColumn("n_frames", F.coalesce("n_frames", F.lit(0).cast("long")))
