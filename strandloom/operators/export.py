"""Id lookups, overlay tables, and the catalogue and summary sinks."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..sources.named import write_named

#: Names of the catalogue's files. Fixed values.
CATALOGUE_CSV, CATALOGUE_JSON = "global_identity_catalogue_v3.csv", "global_identity_catalogue_v3.json"
#: Number of overlay colours.
COLOURS = 15


def colour(gid: Column) -> Column:
    return gid % COLOURS


def filled_ids(tracks: DataFrame, mapping: DataFrame) -> DataFrame:
    """tracks (clip_idx, track_id, global_id) with missing ids from mapping (the same keys, global_id, ord), the last one where a key repeats."""
    last = mapping.groupBy("clip_idx", "track_id").agg(F.max_by("global_id", "ord").alias("mapped"))
    return tracks.join(last, ["clip_idx", "track_id"], "left").withColumn("global_id", F.coalesce("global_id", "mapped")).drop("mapped")


def overlay(detections: DataFrame, mapping: DataFrame) -> DataFrame:
    """Boxes with the id, colour and label of their track; tracks without an id are left out."""
    last = mapping.groupBy("clip_idx", "track_id").agg(F.max_by("global_id", "ord").alias("global_id"))
    return detections.join(last, ["clip_idx", "track_id"]).withColumns({"colour": colour(F.col("global_id")), "label": F.concat(F.lit("ID: "), F.col("global_id").cast("string"))})


def frame_rows(tracks: DataFrame) -> DataFrame:
    """One row for each frame of tracks with arrays frames and bboxes."""
    return tracks.select("clip_idx", "global_id", F.explode(F.arrays_zip("frames", "bboxes")).alias("z")).select("clip_idx", "global_id", F.col("z.frames").alias("frame_idx"), F.col("z.bboxes").alias("bbox"))


def frame_boxes(boxes: DataFrame) -> DataFrame:
    """clip_idx, frame_idx, boxes: the ids and boxes of each frame, sorted by id and box."""
    rows = F.sort_array(F.collect_list(F.struct("global_id", "x1", "y1", "x2", "y2")))
    return boxes.groupBy("clip_idx", "frame_idx").agg(rows.alias("boxes"))


def legend_sizes(boxes: DataFrame) -> DataFrame:
    """clip_idx, frame_idx, seen: how many ids the legend has at each frame, as first sightings counted up."""
    first = boxes.groupBy("clip_idx", "global_id").agg(F.min("frame_idx").alias("frame_idx")).groupBy("clip_idx", "frame_idx").agg(F.count("*").alias("new"))
    frames = boxes.select("clip_idx", "frame_idx").distinct().join(first, ["clip_idx", "frame_idx"], "left")
    return frames.select("clip_idx", "frame_idx", F.sum(F.coalesce("new", F.lit(0))).over(Window.partitionBy("clip_idx").orderBy("frame_idx")).alias("seen"))


def identities(catalogue: DataFrame) -> DataFrame:
    """name (global_id_<n>), clips, appearances: sorted structs of clip, start and end."""
    rows = F.sort_array(F.collect_list(F.struct("clip_idx", "start_frame", "end_frame")))
    return catalogue.groupBy("global_id").agg(rows.alias("appearances"), F.count_distinct("clip_idx").alias("clips")).withColumn("name", F.format_string("global_id_%d", "global_id"))


def report(catalogue: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row: totals and the settings in force."""
    settings = F.create_map(*[x for k, v in asdict(config).items() for x in (F.lit(k), F.lit(str(v)))])
    return catalogue.agg(F.count("*").alias("tracklets"), F.count_distinct("global_id").alias("identities")).withColumn("config", settings)


def write_csv(catalogue: DataFrame, path: str) -> None:
    """The catalogue's four columns with a header; sorted in ranges, so that no one task writes all."""
    out = catalogue.select(F.col("global_id").cast("long"), F.col("clip_idx").cast("int"), F.col("start_frame").cast("int"), F.col("end_frame").cast("int"))
    out.orderBy("clip_idx", "start_frame", "end_frame", "global_id").write.mode("overwrite").option("header", True).csv(path)


def write_json(catalogue: DataFrame, path: str, config: Config = DEFAULT) -> None:
    """identities/: an object for each identity and line; summary/: the totals and settings."""
    identities(catalogue).select("name", "global_id", "appearances").write.mode("overwrite").json(f"{path}/identities")
    report(catalogue, config).select("*").write.mode("overwrite").json(f"{path}/summary")


def document(catalogue: DataFrame, config: Config = DEFAULT, most: int = 100_000) -> DataFrame:
    """One row: summary, config and the map of identities by name, as one object; an error above `most` appearances, which belong into write_json()."""
    if catalogue.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} appearances; write_json() writes any number")
    entries = identities(catalogue).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "appearances")))).alias("identities"))
    totals = report(catalogue, config).select(F.struct("tracklets", "identities").alias("summary"), "config")
    return totals.withColumn("_", F.lit(0)).join(entries.withColumn("_", F.lit(0)), "_").drop("_")


def dataset_summary(labels: DataFrame) -> DataFrame:
    """clip_id, label, category, confidence to 3 places."""
    return labels.select("clip_id", "label", "category", F.round("confidence", 3).alias("confidence"))


def write_scenes(results: DataFrame, path: str) -> None:
    """Scene results, an object for each clip, as JSON in a folder for each clip."""
    results.withColumn("clip", F.col("clip_id")).write.mode("overwrite").partitionBy("clip").json(path)


def scene_file(clip: Column) -> Column:
    """The name of a clip's result file."""
    return F.format_string("clip%s_crime_validated.json", clip)


def base_name(path: Column) -> Column:
    """What follows the last slash of a path; a path that ends in one has an empty base name."""
    return F.substring_index(path, "/", -1)


def write_scene_files(results: DataFrame, path: str) -> list[str]:
    """Scene results as one JSON file a clip, path/clip<n>_crime_validated.json, all of them or none; the names."""
    return write_named(results, scene_file(F.col("clip_id")), path, "json")


def write_catalogue_file(catalogue: DataFrame, path: str, name: str = CATALOGUE_CSV) -> list[str]:
    """The catalogue's four columns with a header as the one file path/name, streamed by one task; write_csv() is for many tasks."""
    out = catalogue.select(F.col("global_id").cast("long"), F.col("clip_idx").cast("int"), F.col("start_frame").cast("int"), F.col("end_frame").cast("int"))
    return write_named(out, F.lit(name), path, "csv", order=["clip_idx", "start_frame", "end_frame", "global_id"], header=True)


def write_catalogue_document(catalogue: DataFrame, path: str, name: str = CATALOGUE_JSON, config: Config = DEFAULT) -> list[str]:
    """document() as the one file path/name."""
    return write_named(document(catalogue, config), F.lit(name), path, "json")
