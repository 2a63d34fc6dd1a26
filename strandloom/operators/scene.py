"""Clip scoring: label probabilities, weapon checks, temporal consistency, the decision list and batch statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.vectors import first_match, over, total
from ..sources.proxies import GROUPS

CRIMES = ("SHOPLIFTING", "GUN")


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    shifted = F.zip_with(logits, F.array_repeat(top, F.size(logits)), lambda x, t: F.exp(x - t))
    return over(shifted, total(shifted))


def label_scores(frames: DataFrame, logits: str = "logits") -> DataFrame:
    """frames with the largest probability of each label group, and the label with the largest of all, the lowest index among ties."""
    made = F.transform(F.array(softmax(F.col(logits))), lambda p: F.struct(*(F.array_max(F.slice(p, a + 1, b - a + 1)).alias(name) for name, (a, b) in GROUPS.items()), (F.array_position(p, F.array_max(p)).cast("int") - 1).alias("label_idx")))
    p = frames.withColumn("made", F.get(made, F.lit(0))).select("*", "made.*").drop("made", logits)  # one array, read several times
    category = first_match([(F.col("label_idx") <= b, F.lit(name)) for name, (_, b) in GROUPS.items()], F.lit(None).cast("string"))
    return p.withColumn("category", category)


def clamped(box: tuple[Column, Column, Column, Column], width: Column, height: Column) -> tuple[Column, ...]:
    """A box cut to its frame."""
    x1, y1, x2, y2 = box
    return F.greatest(x1, F.lit(0)), F.greatest(y1, F.lit(0)), F.least(x2, width), F.least(y2, height)


def validation(gun: Column, phone: Column, confidence: Column, empty: Column | None = None) -> Column:
    """struct(valid, score) by how far the gun probability is above the phone's and how sure the detector was."""
    v = lambda ok, s: F.struct(F.lit(ok).alias("valid"), F.lit(s).alias("score"))
    # fixed values of the rule table
    rules = [(gun > phone + 0.25, v(True, 0.9)), ((gun > phone + 0.15) & (confidence > 0.5), v(True, 0.7)), ((gun > phone + 0.05) & (confidence > 0.65), v(True, 0.6))]
    return first_match(([(empty, v(False, 0.0))] if empty is not None else []) + rules, v(False, 0.2))


def validated(weapons: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Detections above the class gate with valid, validation_score and combined_score.

    Where weapons have boxes (x1 to y2, frame_w, frame_h) these are cut to the frame, and one that is empty then is invalid.
    """
    out, empty = weapons.where(F.col("confidence") > config.gun_confidence), None
    if {"x1", "y1", "x2", "y2", "frame_w", "frame_h"} <= set(weapons.columns):
        box = clamped(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), F.col("frame_w"), F.col("frame_h"))
        out = out.withColumns(dict(zip(("x1", "y1", "x2", "y2"), box, strict=True)))
        empty = (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))
    out = out.withColumn("v", validation(F.col("gun_prob"), F.col("phone_prob"), F.col("confidence"), empty))
    return out.withColumns({"valid": F.col("v.valid"), "validation_score": F.col("v.score"), "combined_score": (F.col("confidence") + F.col("v.score")) / 2}).drop("v")


def consistency(frames: DataFrame, hits: DataFrame) -> DataFrame:
    """clip_id, frames with a hit, whether two such frames lie at most 3 sampled frames apart. Both sides have clip_id, at."""
    place = frames.select("clip_id", "at", F.row_number().over(Window.partitionBy("clip_id").orderBy("at")).alias("place"))
    hit = hits.select("clip_id", "at").distinct().join(place, ["clip_id", "at"])
    gap = F.col("place") - F.lag("place").over(Window.partitionBy("clip_id").orderBy("place"))
    return hit.withColumn("near", gap <= 3).groupBy("clip_id").agg(F.count("*").alias("hit_frames"), F.coalesce(F.bool_or("near"), F.lit(False)).alias("consistent"))


def clip_scores(scored: DataFrame) -> DataFrame:
    """Means and maxima of a clip's frame scores."""
    made = [f(x).alias(f"{x}_{n}") for x in ("shoplifting", "weapon", "urgent") for n, f in (("mean", F.avg), ("max", F.max))]
    return scored.groupBy("clip_id").agg(F.count("*").alias("frames"), *made, F.avg("normal").alias("normal_mean"), F.avg("people").alias("people_mean"), F.max("people").alias("people_max"))


def weapon_summary(valid: DataFrame) -> DataFrame:
    """Count, mean and largest combined score, mean validation and the number of types of a clip's accepted detections."""
    return valid.where("valid").groupBy("clip_id").agg(F.count("*").alias("weapons"), F.avg("combined_score").alias("combined_mean"), F.max("combined_score").alias("combined_max"), F.avg("validation_score").alias("validation_mean"), F.count_distinct("type").alias("types"))


def decision(s: Column, s_max: Column, w: Column, w_max: Column, u: Column, u_max: Column, n: Column, c: Column, comb: Column, comb_max: Column, people: Column) -> Column:
    """struct(category, confidence) of the first rule that holds. c: accepted detections, 0 unless consistent."""
    out = lambda name, conf: F.struct(F.lit(name).alias("category"), conf.cast("double").alias("confidence"))
    # fixed values of the rule table
    few = (people > 3) & (c < 5)
    urgent = first_match([(s > 0.3, out("SHOPLIFTING", (u + s) / 2)), (w > 0.2, out("GUN", (u + w) / 2))], out("NO_CRIME", n))
    rules = [
        ((s > 0.5) & (s_max > 0.7), out("SHOPLIFTING", s)),
        ((c > 0) & ((comb > 0.7) | (comb_max > 0.8)), out("GUN", F.lit(0.95))),
        ((c > 0) & ((comb > 0.5) | (comb_max > 0.6)), F.when(few, out("NO_CRIME", n)).otherwise(out("GUN", F.lit(0.90)))),
        (c >= 3, out("GUN", F.lit(0.85))),
        (c > 0, out("NO_CRIME", n)),
        ((u > 0.4) | (u_max > 0.65), urgent),
        ((w > 0.6) | (w_max > 0.8), out("GUN", w)),
    ]
    return first_match(rules, out("NO_CRIME", n))


def decided(frames: DataFrame, weapons: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """clip_scores(), weapon_summary() and consistency() of each clip with frames, and d, the decision."""
    valid = validated(weapons, config)
    hits = consistency(frames, valid.where("valid"))
    d = clip_scores(label_scores(frames)).join(weapon_summary(valid), "clip_id", "left").join(hits, "clip_id", "left")
    d = d.withColumn("accepted", F.coalesce(F.when(F.col("consistent"), F.col("weapons")), F.lit(0)))
    cols = (F.col(x) for x in ("shoplifting_mean", "shoplifting_max", "weapon_mean", "weapon_max", "urgent_mean", "urgent_max", "normal_mean"))
    return d.withColumn("d", decision(*cols, F.col("accepted"), F.coalesce("combined_mean", F.lit(0.0)), F.coalesce("combined_max", F.lit(0.0)), F.col("people_mean")))


def _label() -> Column:
    return F.when(F.col("d.category").isin(*CRIMES), "crime").otherwise("normal").alias("label")


def scene_labels(frames: DataFrame, weapons: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """clip_id, label, category, confidence of each clip with frames."""
    return decided(frames, weapons, config).select("clip_id", _label(), F.col("d.category").alias("category"), F.col("d.confidence").alias("confidence"))


def every_clip(labels: DataFrame, clips: DataFrame) -> DataFrame:
    """Labels of all clips (clip_id, failed): one without frames is NO_CRIME with 0, one that failed is an error."""
    known = clips.join(labels, "clip_id", "left")
    label = F.when(F.col("failed"), "error").otherwise(F.coalesce("label", F.lit("normal"))).alias("label")
    category = F.when(F.col("failed"), "ERROR").otherwise(F.coalesce("category", F.lit("NO_CRIME"))).alias("category")
    return known.select("clip_id", label, category, F.when(F.col("failed"), 0.0).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))


def results(frames: DataFrame, weapons: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One nested object for each clip with frames: the label, the scores of each group, people, and the weapon analysis."""
    group = lambda x: F.struct(F.col(f"{x}_mean").alias("mean"), F.col(f"{x}_max").alias("max")).alias(x)
    found = F.struct(F.col("accepted").alias("detections"), F.coalesce("hit_frames", F.lit(0)).alias("hit_frames"), F.coalesce("consistent", F.lit(False)).alias("consistent"), "combined_mean", "combined_max", "validation_mean", F.coalesce("types", F.lit(0)).alias("types"))
    return decided(frames, weapons, config).select(
        "clip_id", F.struct(_label(), F.col("d.category").alias("category"), F.col("d.confidence").alias("confidence")).alias("result"), "frames",
        F.struct(group("shoplifting"), group("weapon"), group("urgent"), F.col("normal_mean").alias("normal")).alias("scores"), group("people"), found.alias("weapons"),
    )


def batch_statistics(labels: DataFrame) -> DataFrame:
    """One row: clips, counts by label and category, mean confidence by label; an `error` clip is in neither label."""
    is_ = lambda c, v: F.col(c) == v
    return labels.agg(
        F.count("*").alias("clips"), F.count_if(is_("label", "crime")).alias("crime"), F.count_if(is_("label", "normal")).alias("normal"), F.count_if(is_("category", "SHOPLIFTING")).alias("shoplifting"),
        F.count_if(is_("category", "GUN")).alias("gun"), F.avg(F.when(is_("label", "crime"), F.col("confidence"))).alias("crime_confidence"), F.avg(F.when(is_("label", "normal"), F.col("confidence"))).alias("normal_confidence"),
    )
