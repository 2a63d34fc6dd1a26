"""Scene rules at their cuts, temporal consistency, and the sinks against known rows."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from strandloom.operators import encoders, export, scene
from strandloom.sources import proxies, tables
from strandloom.streaming import tracks as streaming

NAMES = ["s", "s_max", "w", "w_max", "u", "u_max", "n", "c", "comb", "comb_max", "people"]


def decide(spark, **given):
    row = dict.fromkeys(NAMES, 0.0) | {"n": 0.1} | given
    df = spark.createDataFrame([Row(**{k: float(v) for k, v in row.items()})])
    d = df.select(scene.decision(*(F.col(n) for n in NAMES)).alias("d")).collect()[0]["d"]
    return d["category"], round(d["confidence"], 6)


@pytest.mark.parametrize(
    "given, want",
    [
        ({"s": 0.51, "s_max": 0.71}, ("SHOPLIFTING", 0.51)), ({"s": 0.5, "s_max": 0.9}, ("NO_CRIME", 0.1)), ({"c": 1, "comb": 0.71}, ("GUN", 0.95)), ({"c": 1, "comb": 0.6, "comb_max": 0.81}, ("GUN", 0.95)),
        ({"c": 1, "comb": 0.51}, ("GUN", 0.90)), ({"c": 4, "comb": 0.51, "people": 3.5}, ("NO_CRIME", 0.1)), ({"c": 5, "comb": 0.51, "people": 3.5}, ("GUN", 0.90)), ({"c": 3, "comb": 0.4}, ("GUN", 0.85)),
        ({"c": 2, "comb": 0.4}, ("NO_CRIME", 0.1)), ({"u": 0.41, "s": 0.31}, ("SHOPLIFTING", 0.36)), ({"u": 0.41, "w": 0.21}, ("GUN", 0.31)), ({"u_max": 0.66, "w": 0.2}, ("NO_CRIME", 0.1)), ({"u_max": 0.65, "w": 0.61}, ("GUN", 0.61)),
        ({"w_max": 0.81, "w": 0.3}, ("GUN", 0.3)), ({}, ("NO_CRIME", 0.1)),
    ],
)
def test_decision_list(spark, given, want):
    assert decide(spark, **given) == want


@pytest.mark.parametrize("gun, phone, conf, want", [(0.51, 0.25, 0.4, (True, 0.9)), (0.41, 0.25, 0.51, (True, 0.7)), (0.41, 0.25, 0.5, (False, 0.2)), (0.31, 0.25, 0.66, (True, 0.6)), (0.31, 0.25, 0.65, (False, 0.2)), (0.2, 0.3, 0.9, (False, 0.2))])
def test_validation(spark, gun, phone, conf, want):
    got = spark.range(1).select(scene.validation(F.lit(gun), F.lit(phone), F.lit(conf)).alias("v")).collect()[0]["v"]
    assert tuple(got) == want


def test_empty_box_is_invalid(spark):
    x1, y1, x2, y2 = scene.clamped(tuple(map(F.lit, (-5, 3, 700, 2))), F.lit(640), F.lit(480))
    got = spark.range(1).select(x1.alias("a"), x2.alias("b"), scene.validation(F.lit(0.9), F.lit(0.0), F.lit(0.9), (x2 <= x1) | (y2 <= y1)).alias("v")).collect()[0]
    assert (got["a"], got["b"], tuple(got["v"])) == (0, 640, (False, 0.0))


@pytest.mark.parametrize("places, want", [([5], False), ([5, 8], True), ([5, 9], False), ([1, 20, 21], True)])
def test_consistency(spark, places, want):
    frames = spark.createDataFrame([(1, i) for i in range(1, 30)], "clip_id int, at int")
    hits = spark.createDataFrame([(1, p) for p in places], "clip_id int, at int")
    assert scene.consistency(frames, hits).collect()[0]["consistent"] is want


# Fixed rows of the known catalogue: id, clip, start, end.
KNOWN = [(0, 0, 0, 607), (1, 0, 2, 597), (2, 1, 2, 1071), (3, 1, 40, 912), (4, 1, 102, 890), (1, 1, 373, 426), (0, 1, 415, 456), (2, 2, 1, 601), (0, 2, 1, 99), (1, 2, 19, 489), (3, 2, 144, 240), (4, 2, 176, 506), (5, 2, 400, 474), (6, 3, 119, 705), (7, 3, 198, 847)]


def test_catalogue_sinks(spark, tmp_path):
    cat = spark.createDataFrame(KNOWN, "global_id long, clip_idx int, start_frame int, end_frame int")
    export.write_csv(cat, f"file://{tmp_path}/csv")
    back = spark.read.csv(f"file://{tmp_path}/csv", header=True, inferSchema=True)
    assert back.columns == ["global_id", "clip_idx", "start_frame", "end_frame"] and sorted(map(tuple, back.collect())) == sorted(KNOWN)
    export.write_json(cat, f"file://{tmp_path}/json")
    people = {r["name"]: [tuple(x.values()) for x in json.loads(r["a"])] for r in spark.read.json(f"file://{tmp_path}/json/identities").select("name", F.to_json("appearances").alias("a")).collect()}
    assert len(people) == 8 and people["global_id_0"] == [(0, 607, 0), (1, 456, 415), (2, 99, 1)]  # read back by name: clip, end, start
    total = spark.read.json(f"file://{tmp_path}/json/summary").collect()[0]
    assert (total["tracklets"], total["identities"]) == (15, 8)


def test_catalogue_as_one_object(spark):
    cat = spark.createDataFrame(KNOWN, "global_id long, clip_idx int, start_frame int, end_frame int")
    one = json.loads(export.document(cat).toJSON().collect()[0])
    assert one["summary"] == {"tracklets": 15, "identities": 8} and one["config"]["min_length"] == "30" and len(one["identities"]) == 8
    assert one["identities"]["global_id_0"][1] == {"clip_idx": 1, "start_frame": 415, "end_frame": 456}
    with pytest.raises(ValueError, match="more than 10"):
        export.document(cat, most=10)


def test_scene_results_sink(spark, sf_dir, tmp_path):
    results = scene.results(proxies.frame_scores(spark, sf_dir), proxies.weapon_detections(spark, sf_dir))
    export.write_scenes(results, f"file://{tmp_path}/scenes")
    back = spark.read.json(f"file://{tmp_path}/scenes")
    labels = {r["clip_id"]: (r["label"], r["category"]) for r in scene.scene_labels(proxies.frame_scores(spark, sf_dir), proxies.weapon_detections(spark, sf_dir)).collect()}
    assert {r["clip_id"]: (r["result"]["label"], r["result"]["category"]) for r in back.collect()} == labels and len(labels) > 10
    assert all(0 <= r["scores"]["weapon"]["mean"] <= r["scores"]["weapon"]["max"] for r in back.collect())


def test_scene_summary_and_statistics(spark):
    rows = [(0, "crime", "SHOPLIFTING", 0.53), (1, "normal", "NO_CRIME", 0.0331), (2, "normal", "NO_CRIME", 0.024), (3, "crime", "GUN", 0.9), (4, "error", "ERROR", 0.0)]
    labels = spark.createDataFrame(rows, "clip_id int, label string, category string, confidence double")
    assert export.dataset_summary(labels).where("clip_id = 1").collect()[0]["confidence"] == 0.033
    s = scene.batch_statistics(labels).collect()[0]
    assert (s["clips"], s["crime"], s["normal"], s["shoplifting"], s["gun"]) == (5, 2, 2, 1, 1) and s["crime_confidence"] == pytest.approx(0.715)


def test_cached_table_is_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(len(made))

    path = f"file://{tmp_path}/cache"
    assert [tables.cached(spark, path, make).count() for _ in range(2)] == [1, 1]
    assert tables.cached(spark, path, make, fresh=True).count() == 2 and len(made) == 2


def test_half_written_cache_is_made_again(spark, tmp_path):
    path = tmp_path / "half"
    spark.range(3).write.parquet(f"file://{path}")
    (path / "_SUCCESS").unlink()
    assert tables.cached(spark, f"file://{path}", lambda: spark.range(5)).count() == 5


def test_scope_deletes_what_it_stored(spark):
    outer = tables.stored(spark.range(4), "outer")
    with tables.scope(spark):
        inside = tables.stored(spark.range(2), "inside")
        path, fs = tables._path(spark, tables.own_dir(spark))
        assert inside.count() == 2 and fs.exists(path)
    assert not fs.exists(path) and outer.count() == 4


def test_no_local_folder_on_a_cluster():
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_dir(Session)


def test_stored_tables_can_be_cleaned(spark):
    t = tables.stored(spark.range(5), "five")
    assert t.count() == 5
    tables.clean(spark)
    path, fs = tables._path(spark, tables.own_dir(spark))
    assert not fs.exists(path)
    assert tables.stored(spark.range(3), "three").count() == 3


def test_no_clips(spark):
    none = spark.createDataFrame([], "clip_id int, label string, category string, confidence double")
    s = scene.batch_statistics(none).collect()[0]
    assert s["clips"] == 0 and s["crime_confidence"] is None


def test_frames_of_tracks(spark):
    t = spark.createDataFrame([(0, 7, [3, 4], [(1, 2), (3, 4)])], "clip_idx int, global_id long, frames array<int>, bboxes array<struct<a:int,b:int>>")
    assert [(r["frame_idx"], r["bbox"]["a"]) for r in export.frame_rows(t).collect()] == [(3, 1), (4, 3)]


def test_encoder_is_stable(spark):
    got = encoders.encoded(spark.createDataFrame([("a",), ("b",), ("a",)], "k string"), "k").collect()
    by = {}
    for r in got:
        assert sum(x * x for x in r["vec"]) == pytest.approx(1) and by.setdefault(r["k"], r["vec"]) == r["vec"]
    assert by["a"] != by["b"]


def test_streams(spark, sf_dir, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    source.select("event_id", "ts", "user_id", "value").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    schema = spark.read.parquet(f"file://{tmp_path}/in").schema
    stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        return spark.sql(f"SELECT * FROM {name}")

    ema = {r["user_id"]: r["ema"] for r in run(streaming.running_ema(stream), "update", "ema_t").collect()}
    want = {}
    for r in source.select("user_id", "value").orderBy("ts", "event_id").collect():
        u = r["user_id"]
        want[u] = want[u] * (1 - 1 / 3) + r["value"] / 3 if u in want else r["value"]
    assert ema == pytest.approx(want)
    assert run(streaming.window_counts(stream), "complete", "win_t").agg(F.sum("rows")).collect()[0][0] == source.count()
    sessions = run(streaming.track_sessions(stream), "append", "ses_t")
    assert sessions.count() > 0 and sessions.where("rows < 1 OR end <= start").count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", "4")
