"""Features of detections and tracks: boxes, motion, quality, face runs, weighted and smoothed vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.vectors import ZERO, first_match, unit
from ..sources.tables import stored

TRACK = ("clip_idx", "track_id")


def valid(detections: DataFrame) -> DataFrame:
    """Detections with a track and a box that isn't empty."""
    return detections.where(F.col("track_id").isNotNull() & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def sampled(frames: DataFrame, rate: int = DEFAULT.sample_rate) -> DataFrame:
    return frames.where(F.col("frame_idx") % rate == 0)


def with_box(detections: DataFrame) -> DataFrame:
    """bbox_size, v_pos and h_pos relative to the frame."""
    w, h = F.col("frame_w").cast("double"), F.col("frame_h").cast("double")
    return detections.withColumns({"bbox_size": (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / (w * h), "v_pos": (F.col("y1") + F.col("y2")) / (2 * h), "h_pos": (F.col("x1") + F.col("x2")) / (2 * w)})


def with_movement(detections: DataFrame) -> DataFrame:
    """movement: shift of the box centre since the track's last box, as shares of the frame; 0 in the first row."""
    by = Window.partitionBy(*TRACK).orderBy("at")
    cx, cy = (F.col("x1") + F.col("x2")) / 2.0, (F.col("y1") + F.col("y2")) / 2.0
    dx, dy = (cx - F.lag(cx).over(by)) / F.col("frame_w"), (cy - F.lag(cy).over(by)) / F.col("frame_h")
    return detections.withColumn("movement", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))


def long_tracks(detections: DataFrame, least: int = DEFAULT.min_track_rows) -> DataFrame:
    """One row for each track with enough detections: count, first and last frame."""
    return detections.groupBy(*TRACK).agg(F.count("*").alias("num_detections"), F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame")).where(F.col("num_detections") >= least)


def track_lists(detections: DataFrame) -> DataFrame:
    """Frames and boxes of each track in order; a track's rows are one array, so tracks must fit in memory."""
    rows = F.sort_array(F.collect_list(F.struct("at", "frame_idx", F.struct("x1", "y1", "x2", "y2").alias("bbox"))))
    return detections.groupBy(*TRACK).agg(rows.alias("rows")).select(*TRACK, F.col("rows.frame_idx").alias("frames"), F.col("rows.bbox").alias("bboxes"))


def timed(frames: DataFrame, clips: DataFrame) -> DataFrame:
    """frames with seconds, the frame's time by its clip's frame rate; frames of unknown clips are left out."""
    return frames.join(clips.select("clip_idx", "fps"), "clip_idx").withColumn("seconds", F.col("frame_idx") / F.col("fps")).drop("fps")


def motion_vector(detections: DataFrame, least: int = DEFAULT.min_track_rows) -> DataFrame:
    """Mean and population deviation of movement, mean size and positions of each track, scaled to length 1."""
    moved = with_box(with_movement(detections))
    names = ("mv_mean", "mv_std", "size_mean", "v_mean", "h_mean")
    made = (F.avg("movement"), F.stddev_pop("movement"), F.avg("bbox_size"), F.avg("v_pos"), F.avg("h_pos"))
    out = moved.groupBy(*TRACK).agg(F.count("*").alias("n"), *(c.alias(x) for c, x in zip(made, names, strict=True))).where(F.col("n") >= least)
    length = F.sqrt(sum((F.col(x) * F.col(x) for x in names[1:]), F.col(names[0]) * F.col(names[0]))) + ZERO
    return out.select(*TRACK, *((F.col(x) / length).alias(x) for x in names))


def quality(face: Column, pose: Column, bbox: Column) -> Column:
    """Frame quality from a face flag, a pose score and a box score."""
    return 0.6 * face.cast("double") + 0.3 * F.when(pose <= 0, 0.0).otherwise(F.least(pose, F.lit(1.0))) + 0.1 * F.when(bbox <= 0, 0.5).otherwise(F.least(bbox, F.lit(1.0)))


def face_runs(detections: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Longest run of rows with a face in each track's order, face rows, rows and the face flag."""
    by = Window.partitionBy(*TRACK).orderBy("at")
    islands = detections.withColumn("n", F.row_number().over(by)).withColumn("island", F.col("n") - F.row_number().over(Window.partitionBy(*TRACK, "has_face").orderBy("at")))
    runs = islands.groupBy(*TRACK, "has_face", "island").agg(F.count("*").alias("run"))
    longest = F.coalesce(F.max(F.when(F.col("has_face"), F.col("run"))), F.lit(0))
    faces = F.coalesce(F.sum(F.when(F.col("has_face"), F.col("run"))), F.lit(0))
    return runs.groupBy(*TRACK).agg(longest.alias("longest_run"), faces.alias("face_frames"), F.sum("run").alias("num_frames")).withColumn("has_face", F.col("longest_run") >= config.face_run)


def effective_face(longest: Column, count: Column, ratio: Column, frames: Column, flag: Column, config: Config = DEFAULT) -> Column:
    """The face flag by the first of run, count and ratio that is known, else as stored."""
    n = config.face_run
    return first_match([(longest.isNotNull(), longest >= n), (count.isNotNull(), count >= n), (ratio.isNotNull() & frames.isNotNull(), ratio * frames >= n)], flag)


def weighted_mean(rows: DataFrame, by: list[str], vector: str, weight: Column | None, *, scale: bool = True, eps: float = 0.0) -> DataFrame:
    """by, vec array<double>: sum(w x) / (sum(w) + eps) of each position; equal weights where all are zero.

    Positions are summed by partial aggregation, no group's vectors are gathered. With scale a mean of more than one
    row is divided by its length plus 1e-8.
    """
    w = F.lit(1.0) if weight is None else weight
    each = rows.select(*by, w.alias("w"), F.posexplode(vector).alias("pos", "x"))
    sums = each.groupBy(*by, "pos").agg(F.count("*").alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("x")).alias("sx"), F.avg("x").alias("plain"))
    mean = F.when(F.col("sw") == 0, F.col("plain")).when(F.col("n") == 1, F.col("plain")).otherwise(F.col("sx") / (F.col("sw") + F.lit(eps)))
    out = sums.select(*by, "n", "pos", mean.alias("x")).groupBy(*by).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
    vec = F.col("v.x")
    return out.select(*by, "n", (F.when(F.col("n") == 1, vec).otherwise(unit(vec)) if scale else vec).alias("vec"))


def softmax_mean(rows: DataFrame, by: list[str], vector: str, score: str) -> DataFrame:
    """Mean by weights exp(3 score) over their sum, scaled to length 1; a single row is unchanged."""
    return weighted_mean(rows, by, vector, F.exp(3 * F.col(score)), eps=ZERO)


def mean_pose(rows: DataFrame, by: list[str], vector: str = "pose") -> DataFrame:
    """Plain mean, scaled to length 1."""
    return weighted_mean(rows, by, vector, None)


def length_mean(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Mean by track lengths, equal weights where all are zero; not scaled."""
    return weighted_mean(rows, by, vector, (F.col("end_frame") - F.col("start_frame")).cast("double"), scale=False)


def ema_last(rows: DataFrame, by: list[str], order: str, value: str, config: Config = DEFAULT) -> DataFrame:
    """The last exponential mean of each group, alpha = 2 / (window + 1).

    As a weighted sum: the i-th of n values (from 0) has the weight alpha (1 - alpha)^(n - 1 - i), the first
    (1 - alpha)^(n - 1); so it is a partial aggregate and no group is gathered.
    """
    alpha = 2 / (config.smoothing_window + 1)
    at = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(order)) == 1
    w = F.pow(F.lit(1 - alpha), (F.col("back") - 1).cast("double")) * F.when(F.col("first"), 1.0).otherwise(alpha)
    return rows.withColumns({"back": at, "first": first}).groupBy(*by).agg(F.count("*").alias("n"), F.sum(w * F.col(value)).alias("ema"))


def ema_vectors(rows: DataFrame, by: list[str], order: str, vector: str, config: Config = DEFAULT) -> DataFrame:
    """by, order, vec: each row's smoothed vector. Every step is scaled to length 1 (plus 1e-8), so it is no linear sum.

    Rows stream through a task in order, sorted by group; only the last vector of a group is held.
    """
    alpha = 2 / (config.smoothing_window + 1)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, order]) + ", vec array<double>"
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                x = np.asarray(r[-1], float)
                if r[: len(by)] != key:
                    key, last = r[: len(by)], x
                else:
                    last = alpha * x + (1 - alpha) * last
                    last = last / (np.linalg.norm(last) + ZERO)
                out.append(last.tolist())
            yield pdf.iloc[:, :-1].assign(vec=out)

    return rows.select(*by, order, vector).repartition(int(parts), *by).sortWithinPartitions(*by, order).mapInPandas(run, schema)


def numbered(rows: DataFrame, by: list[str], order: str, score: str) -> DataFrame:
    """by, order, place, n: each row's place from 1 in its group, by score downwards, then order; and the group's rows.

    Rows are dealt by ranges of (by, score, order), so that a large group is many tasks' work; only counts of ranges meet
    by group. Null and NaN scores come last.
    """
    own = rows.select(*by, order, F.when(~F.isnan(score), F.col(score)).alias("_score"))
    sort = [F.desc_nulls_last("_score"), F.asc(order)]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(own.repartitionByRange(parts, *by, *sort).withColumn("_part", F.spark_partition_id()), "ranges")
    whole = Window.partitionBy(*by)
    earlier = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_rows")).select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_part").alias("_p"), earlier.alias("_earlier"), F.sum("_rows").over(whole).alias("n"))
    inside = dealt.withColumn("_at", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*sort)))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by), F.col("_part") == F.col("_p"))
    return inside.join(counts, same).select(*by, order, (F.col("_at") + F.col("_earlier")).alias("place"), "n")


def representatives(rows: DataFrame, by: list[str], order: str, vector: str, score: str, most: int = 15, config: Config = DEFAULT) -> DataFrame:
    """by, order of the rows chosen to stand for each group: all if few, else the best by score, the first left, then the farthest.

    The best max(5, 0.3 n) come by score; unless `enforce_budget` is set they may pass `most`. Where they reach `most`, no
    vector is looked at and a group of any size is many tasks' work (numbered); the farthest are chosen only in groups of
    fewer than (most + 1) / 0.3 rows or 6, which are one task's work each. Null and NaN scores come last, null vectors and
    components count as zero; rows alike in all are each counted.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, order])
    best = F.greatest(F.lit(5), F.floor(F.lit(0.3) * F.col("n")))
    places = stored(numbered(rows, by, order, score), "places")
    all_of, by_score = F.col("n") <= most, best >= most
    ranked = places.where(all_of | (by_score & (F.col("place") <= (F.lit(most) if config.enforce_budget else best)))).select(*by, order)
    open_rows = stored(places.where(~all_of & ~by_score).select(*(F.col(c).alias(f"_{c}") for c in [*by, order])), "open")
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, order]))
    left = rows.select(*by, order, vector, score).join(open_rows, same, "left_semi")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        chosen = np.zeros(len(pdf), bool)
        chosen[np.argsort(-pdf[score].to_numpy(float), kind="stable")[: max(5, int(0.3 * len(pdf)))]] = True
        width = max((len(v) for v in pdf[vector] if v is not None), default=0)
        x = np.nan_to_num(np.array([np.zeros(width) if v is None else v for v in pdf[vector]], float))
        x /= np.linalg.norm(x, axis=1, keepdims=True) + ZERO
        near = np.full(len(pdf), np.inf)
        for _ in range(most - int(chosen.sum())):
            free = np.where(chosen, -np.inf, near)
            pick = int(free.argmax())  # the first one left, as long as nothing was picked
            if chosen[pick]:
                break
            chosen[pick] = True
            near = np.minimum(near, 1 - x @ x[pick])
        return pdf.loc[chosen, [*by, order]]

    return ranked.unionByName(left.groupBy(*by).applyInPandas(choose, schema))
