"""Files with exact names: all of them or none, and the names themselves."""

import csv
import json
import os

import pytest
from pyspark.sql import functions as F

from strandloom.functions.vectors import weighted_concat
from strandloom.operators import export
from strandloom.sources.named import write_named

CATALOGUE = "global_id long, clip_idx int, start_frame int, end_frame int"


def names(path):
    return sorted(f for f in os.listdir(path) if not f.startswith("."))


def test_one_file_a_clip(spark, tmp_path):
    rows = spark.createDataFrame([(k, {"category": f"c{k}"}) for k in (3, 1, 20)], "clip_id long, result struct<category:string>").repartition(5)
    for _ in range(2):  # written again, what was there is replaced
        assert export.write_scene_files(rows, f"file://{tmp_path}/out") == ["clip1_crime_validated.json", "clip20_crime_validated.json", "clip3_crime_validated.json"]
        assert names(tmp_path / "out") == ["clip1_crime_validated.json", "clip20_crime_validated.json", "clip3_crime_validated.json"]
    with open(tmp_path / "out" / "clip20_crime_validated.json") as f:
        assert json.load(f) == {"clip_id": 20, "result": {"category": "c20"}}
    assert names(tmp_path) == ["out"]


def test_one_csv_and_one_object(spark, tmp_path):
    rows = [(k % 3, k % 4, 10 * k, 10 * k + 5) for k in range(40)]
    cat = spark.createDataFrame(rows, CATALOGUE).repartition(6)
    assert export.write_catalogue_file(cat, f"file://{tmp_path}/csv") == [export.CATALOGUE_CSV]
    with open(tmp_path / "csv" / export.CATALOGUE_CSV) as f:
        lines = list(csv.reader(f))
    assert lines[0] == ["global_id", "clip_idx", "start_frame", "end_frame"]
    assert [tuple(map(int, x)) for x in lines[1:]] == sorted(rows, key=lambda r: (r[1], r[2], r[3], r[0]))
    export.write_catalogue_document(cat, f"file://{tmp_path}/json")
    with open(tmp_path / "json" / export.CATALOGUE_JSON) as f:
        got = json.load(f)
    assert got["summary"] == {"tracklets": 40, "identities": 3} and set(got["identities"]) == {"global_id_0", "global_id_1", "global_id_2"}


def test_a_failed_task_leaves_what_was_there(spark, tmp_path):
    first = spark.createDataFrame([("a", 1)], "name string, x int")
    write_named(first, F.col("name"), f"file://{tmp_path}/out", "json")
    broken = spark.range(9).select(F.col("id").cast("string").alias("name"), F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        write_named(broken, F.col("name"), f"file://{tmp_path}/out", "json")
    assert names(tmp_path) == ["out"] and names(tmp_path / "out") == ["a"]


@pytest.mark.parametrize("bad", ["", "a/b", "a:b", None, "..", "_x"])
def test_names_must_be_file_names(spark, tmp_path, bad):
    with pytest.raises(ValueError, match="not a file name"):
        write_named(spark.createDataFrame([("good", 1), (bad, 2)], "name string, x int"), F.col("name"), f"file://{tmp_path}/out", "json")
    assert names(tmp_path) == []


def test_odd_names_and_no_rows(spark, tmp_path):
    odd = ["a b.json", "50%.json", "ü=1.json"]
    assert write_named(spark.createDataFrame([(n, 1) for n in odd], "name string, x int"), F.col("name"), f"file://{tmp_path}/out", "json") == sorted(odd)
    assert names(tmp_path / "out") == sorted(odd)
    assert write_named(spark.createDataFrame([], "name string, x int"), F.col("name"), f"file://{tmp_path}/out", "json") == []
    assert names(tmp_path / "out") == []


def test_base_names_and_weights(spark):
    paths = ["/a/b/c.mp4", "c.mp4", "a/", "", None]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(export.base_name(F.col("p")).alias("x")).collect()
    assert [r["x"] for r in got] == ["c.mp4", "c.mp4", "", "", None]
    rows = spark.createDataFrame([([1.0, 2.0], [10.0]), ([1.0, 2.0], None), ([], [10.0])], "a array<double>, b array<double>")
    got = [r["x"] for r in rows.select(weighted_concat(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got[0] == pytest.approx([0.7, 1.4, 3.0]) and got[1] == [1.0, 2.0] and got[2] == pytest.approx([3.0])
