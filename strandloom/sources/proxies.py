"""Stand-ins for model output, derived from the driver's tables: detections, tracklets, frame scores, weapon detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLIPS, SCENE_CLIPS, LABELS = 25, 64, 18
#: Label ranges of the four groups of scene labels.
GROUPS = {"shoplifting": (0, 2), "weapon": (3, 9), "urgent": (10, 13), "normal": (14, 17)}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.withColumn("k", k).withColumn("minute", F.expr("timestampdiff(MINUTE, CAST('2024-01-01 00:00:00' AS TIMESTAMP), CAST(ts AS TIMESTAMP))").cast("int")).drop("props")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, clip_idx, track_id, frame_idx, x1..y2, frame_w, frame_h, has_face, value; `at` gives the order within a track."""
    e = events(spark, sf_dir)
    x1, y1 = F.floor("value").cast("int"), F.col("k")
    return e.select(
        "event_id", (F.col("user_id") % CLIPS).cast("int").alias("clip_idx"), F.col("user_id").cast("int").alias("track_id"), F.col("minute").alias("frame_idx"),
        x1.alias("x1"), y1.alias("y1"), (x1 + 20 + F.col("k") % 30).alias("x2"), (y1 + 50).alias("y2"), F.lit(1920).alias("frame_w"), F.lit(1080).alias("frame_h"),
        (F.col("event_type") != "error").alias("has_face"), "value", "k", F.struct("ts", "event_id").alias("at"),
    )


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_idx, fps, frame_count, width, height: what a scan of the clips' metadata gives; the frames reach to the last detection."""
    d = detections(spark, sf_dir)
    fps = F.when(F.col("clip_idx") % 2 == 0, 25.0).otherwise(30.0).alias("fps")
    return d.groupBy("clip_idx").agg((F.max("frame_idx") + 1).cast("long").alias("frame_count")).select("clip_idx", fps, "frame_count", F.lit(1920).alias("width"), F.lit(1080).alias("height"))


def tracklets(spark: SparkSession, sf_dir: str, a: float, *more: str) -> DataFrame:
    """track_id, clip_idx, start_frame, end_frame, has_face, label, body and face (array<double>), quality, and more columns of the table."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("track_id"), "embedding", "label")
    hot = lambda x, i: F.lit(a) * x.cast("double") + F.when(i == F.col("label"), 1.0).otherwise(0.0)
    start = (F.col("track_id") * 37 % 900).cast("int")
    face = F.when(F.col("track_id") % 6 == 0, F.transform("embedding", lambda x: F.lit(0.0))).otherwise(F.transform(F.reverse("embedding"), hot))
    return v.select(
        "track_id", (F.col("track_id") % CLIPS).cast("int").alias("clip_idx"), start.alias("start_frame"), (start + 20 + F.col("track_id") * 53 % 600).cast("int").alias("end_frame"),
        (F.col("track_id") % 3 != 0).alias("has_face"), "label", F.transform("embedding", hot).alias("body"), face.alias("face"), (F.col("track_id") % 10 / 10.0).alias("quality"), *more,
    )


def ordered(tracks: DataFrame) -> DataFrame:
    """tracks with ord, the place in the list order of its clip: by start, then id."""
    return tracks.withColumn("ord", F.row_number().over(Window.partitionBy("clip_idx").orderBy("start_frame", "track_id")))


def frame_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, clip_id, at, people, logits (array<double> of 18)."""
    e = events(spark, sf_dir)
    u = F.col("user_id") % SCENE_CLIPS
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (u % 4).cast("int"))

    def logit(i: int) -> Column:
        own = F.when(pick((0, 3, 10, 14)) == i, (2 + F.floor(u / 4) % 4).cast("double")).otherwise(0.0)
        more = F.when((u >= 32) & (pick((3, 0, 0, 10)) == i), 3.5).otherwise(0.0)
        return (F.col("event_id") * (i + 7) % 23) / F.lit(20.0) + own + more

    return e.select("event_id", u.cast("int").alias("clip_id"), F.struct("ts", "event_id").alias("at"), (F.col("k") % 5).alias("people"), F.array(*[logit(i) for i in range(LABELS)]).alias("logits"))


def weapon_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """weapon_detections() with a box of a 640 by 480 frame, some of which lie outside or are empty."""
    x, y = F.col("event_id") * 7 % 700 - 50, F.col("event_id") * 11 % 560 - 50
    return weapon_detections(spark, sf_dir).withColumns({"x1": x, "y1": y, "x2": x + F.col("event_id") % 90 - 5, "y2": y + 40, "frame_w": F.lit(640), "frame_h": F.lit(480)})


def weapon_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, clip_id, at, type, confidence, gun_prob, phone_prob of candidate boxes."""
    e = events(spark, sf_dir).withColumn("clip_id", (F.col("user_id") % SCENE_CLIPS).cast("int"))
    return e.where((F.col("event_type") == "error") & (F.col("clip_id") % 3 == 0)).select(
        "event_id", "clip_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("k") % 2 == 0, "pistol").otherwise("rifle").alias("type"), (F.col("k") / F.lit(100.0)).alias("confidence"),
        (F.col("event_id") * 13 % 40 / F.lit(100.0)).alias("gun_prob"), (F.col("event_id") * 29 % 40 / F.lit(100.0)).alias("phone_prob"),
    )
