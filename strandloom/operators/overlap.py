"""Time overlap of tracklets: interval joins, gap joins, sweeps, and the characteristics of a clip."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.vectors import clipped, dot, first_match, norm, over, unit
from .distance import Block, rounded, within_clips


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def overlap_ratio(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over the shorter length; 0 where that is 0."""
    return F.coalesce(F.try_divide(overlap(s1, e1, s2, e2).cast("double"), F.least(e1 - s1, e2 - s2)), F.lit(0.0))


def long_enough(tracks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return tracks.where(F.col("end_frame") - F.col("start_frame") >= config.min_length)


def overlapping_pairs(tracks: DataFrame, digits: int | None = None) -> DataFrame:
    """Pairs of one clip, i before j in its order, that share more than an instant: i, j, overlap, ratio.

    The clip's order is by start; tiles of it are compared where they touch in time, so no clip or stretch of time is one task.
    """

    def pairs(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        shared = np.minimum(a["end_frame"][:, None], b["end_frame"][None]) - np.maximum(a["start_frame"][:, None], b["start_frame"][None])
        x, y = np.nonzero(shared > 0)
        short = np.minimum((a["end_frame"] - a["start_frame"])[x], (b["end_frame"] - b["start_frame"])[y])
        overlap_ = shared[x, y]
        return x, y, {"overlap": overlap_, "ratio": rounded(overlap_ / short, digits)}

    return within_clips(tracks, ["start_frame", "end_frame"], pairs, "overlap int, ratio double", touching=True, part=1024)


def fragment_edges(tracks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Pairs of one clip where j starts within the gap after i ends, overlap little and look alike: i, j, gap, similarity.

    The gap join is on bins of the gap's width: i's end looks into its own bin of starts and the next one. A gap above 0
    rules out overlap, and ends before starts, so i precedes j in the clip's order.
    """
    w = config.fragment_gap
    left = tracks.select("clip_idx", F.col("track_id").alias("i"), F.col("end_frame").alias("end_i"), unit(F.col("body")).alias("body_i")).withColumn("bin", F.explode(F.array(F.floor(F.col("end_i") / w), F.floor(F.col("end_i") / w) + 1)))
    right = tracks.select("clip_idx", F.col("track_id").alias("j"), F.col("start_frame").alias("start_j"), unit(F.col("body")).alias("body_j"), F.floor(F.col("start_frame") / w).alias("bin"))
    pairs = left.join(right, ["clip_idx", "bin"]).withColumn("gap", F.col("start_j") - F.col("end_i")).where((F.col("gap") > 0) & (F.col("gap") <= w))
    out = pairs.withColumn("similarity", dot(F.col("body_i"), F.col("body_j")))
    return out.where(F.col("similarity") > config.fragment_similarity).select("clip_idx", "i", "j", "gap", "similarity")


def max_simultaneous(tracks: DataFrame) -> DataFrame:
    """Most tracklets that cover one frame, ends included, of each clip: a sweep over starts and ends, summed by frame first."""
    step = F.explode(F.array(F.struct(F.col("start_frame").alias("frame"), F.lit(1).alias("by")), F.struct((F.col("end_frame") + 1).alias("frame"), F.lit(-1).alias("by"))))
    steps = tracks.select("clip_idx", step.alias("s")).groupBy("clip_idx", "s.frame").agg(F.sum("s.by").alias("by"))
    covered = steps.withColumn("covered", F.sum("by").over(Window.partitionBy("clip_idx").orderBy("frame")))
    return covered.groupBy("clip_idx").agg(F.max("covered").alias("max_simultaneous"))


def mean_pair_distance(tracks: DataFrame, vector: str = "body") -> DataFrame:
    """Mean cosine distance over all pairs of each clip, in one linear pass; null for one tracklet or a zero vector.

    For unit vectors u the sum of u_i . u_j over pairs is (|sum u|^2 - n) / 2, so no pair is made.
    """
    unit_x = tracks.select("clip_idx", norm(F.col(vector)).alias("n"), vector).select("clip_idx", (F.col("n") > 0).alias("ok"), F.posexplode(over(F.col(vector), F.col("n"))).alias("pos", "x"))
    sums = unit_x.groupBy("clip_idx", "pos").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.min("ok").alias("ok"))
    out = sums.groupBy("clip_idx").agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q"), F.min("ok").alias("ok"))
    n = F.col("n").cast("double")
    return out.select("clip_idx", F.when(F.col("ok"), 1 - F.try_divide(F.col("q") - n, n * (n - 1))).alias("mean_distance"))


def clip_characteristics(tracks: DataFrame, vector: str = "body") -> DataFrame:
    """Counts, means, the four banded scores and the target threshold of each clip; a report, no operator reads it."""
    d = tracks.groupBy("clip_idx").agg(F.count("*").alias("n"), F.avg((F.col("end_frame") - F.col("start_frame")).cast("double")).alias("mean_length"), F.avg(F.col("has_face").cast("double")).alias("face_rate"))
    d = d.join(max_simultaneous(tracks), "clip_idx").join(mean_pair_distance(tracks, vector), "clip_idx")
    n, length, rate, dist, m = (F.col(c) for c in ("n", "mean_length", "face_rate", "mean_distance", "max_simultaneous"))
    # fixed values of the rule table
    bands = lambda rules, default: first_match([(c, F.lit(v)) for c, v in rules], F.lit(default))
    scores = {
        "crowding": bands([(n <= 3, 0.0), (n <= 10, 0.02)], 0.04),
        "tracking": bands([(length > 300, 0.0), (length > 100, 0.01)], 0.03),
        "faces": bands([(rate > 0.7, 0.0), (rate > 0.4, 0.01)], 0.02),
        "diversity": F.when(n == 2, -0.20)
        .when(n <= 8, bands([(dist > 0.32, -0.20), (dist > 0.18, -0.18)], -0.15))
        .when(n > 15, bands([(dist > 0.5, -0.05), (dist > 0.4, -0.02), (dist > 0.35, 0.0)], 0.02))
        .otherwise(bands([(dist > 0.5, -0.12), (dist > 0.4, -0.10), (dist > 0.35, -0.08)], -0.05)),
    }
    target = first_match([(m >= 5, F.when(n > 6, 0.24).otherwise(0.08)), (m == 4, F.when(n > 8, 0.12).otherwise(0.10)), (m == 3, F.lit(0.12)), (m == 2, F.lit(0.15))], 0.08 + F.col("crowding") + F.col("tracking") + F.col("faces") + F.col("diversity"))
    return d.withColumns(scores).withColumn("target", clipped(target, 0.01, 0.25))
