"""What is shuffled and kept on disk grows no faster than the tables."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import distance, match
from strandloom.sources import tables


def shuffled(spark, run):
    """(bytes that run() shuffles, its result)."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    before = written()
    out = run()
    time.sleep(0.5)  # the listener comes later
    return written() - before, out


def vectors(n, seed=3, width=64):
    return np.random.default_rng(seed).normal(size=(n, width))


@pytest.mark.parametrize("held", [65536, 120])
def test_a_search_sends_few_tables(spark, monkeypatch, held):
    """Sixty tiles that all must meet: they pass by the groups that tasks hold, in rounds; once each tile was sent to each other one."""
    monkeypatch.setattr(distance, "HELD", held)
    monkeypatch.setattr(distance, "SENT", 2)
    x = np.concatenate((vectors(1200), np.zeros((2, 64))))
    x[7], x[900] = x[3], x[3]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, body array<double>")
    sent, got = shuffled(spark, lambda: distance.neighbours(df, "k", 5, tile=20).collect())
    assert sent < (30 if held < 1200 else 16) * x.nbytes
    u = distance.directions(x)
    d = np.round(1 - u @ u.T, 9)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :5]
    assert len(got) == 5 * len(x) and all(want[r["key"], r["rank"] - 1] == r["other"] for r in got)


def test_what_was_shuffled_for_a_stored_table_goes(spark):
    kept = lambda: sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before = kept()
    made = tables.stored(spark.range(1000).repartition(7, "id"), "numbers")
    for _ in range(50):
        if kept() <= before:
            break
        time.sleep(0.1)
    assert kept() <= before and made.count() == 1000
    assert spark.conf.get(tables.FREED, "false") == "false"
    tables.discard(made)
    assert not tables._path(spark, made.inputFiles()[0])[1].exists(tables._path(spark, made.inputFiles()[0])[0])


def lone(spark, n=1200, people=6, width=64):
    """Lone tracklets of some people, a cluster each."""
    rng = np.random.default_rng(2)
    bodies = rng.normal(size=(people, width))
    near = lambda k: (bodies[k % people] + 0.3 * rng.normal(size=width)).tolist()
    rows = [(k, k % 7, 0, 60 + k % 300, k % 3 != 0, near(k), near(k), k) for k in range(n)]
    return spark.createDataFrame(rows, "track_id long, clip_idx int, start_frame int, end_frame int, has_face boolean, body array<double>, face array<double>, local_cluster long").cache()


def test_candidates_send_few_tables(spark, monkeypatch):
    """Sixty tiles of six people: a tile meets those of its own person only, and passes by groups of tiles; once each was sent to all others that are near."""
    tracks = lone(spark)
    want = match.candidates(tracks).count()
    monkeypatch.setattr(distance, "TILE", 20)
    monkeypatch.setattr(distance, "MOST", 20)
    monkeypatch.setattr(distance.near_grid, "__kwdefaults__", distance.near_grid.__kwdefaults__ | {"tile": 20})
    sent, got = shuffled(spark, lambda: match.candidates(tracks).count())
    assert got == want > 20_000 and sent < 20 * tracks.count() * 8 * 3 * 64


def test_pairs_of_clusters_carry_no_vectors(spark, monkeypatch):
    """Of a pair only numbers are gathered; with the vectors of both, half a million pairs at once took a gigabyte."""
    judged = match.judged

    def watched(a, b, *similar):
        assert all(v.ndim == 1 for v in (*a.values(), *b.values(), *similar))
        return judged(a, b, *similar)

    monkeypatch.setattr(match, "judged", watched)
    assert match.candidates(lone(spark, 60)).count() > 50


def test_pairs_of_a_clip_send_few_tables(spark, monkeypatch):
    """A clip of many tiles of 20: tiles grow to a few of the table, each is sent to few others, and is still compared 20 at once."""
    monkeypatch.setattr(distance, "PART", 20)
    monkeypatch.setattr(distance, "PARTS", 4, raising=False)
    monkeypatch.setattr(distance.within_clips, "__kwdefaults__", distance.within_clips.__kwdefaults__ | {"part": 20})
    x = vectors(1200, width=32)
    x[5] = 0.0
    rows = [(k, 0, k + 1, k % 3 != 0, *(v.tolist() for v in (x[k], x[k][::-1], x[k][:4], x[k][-4:]))) for k in range(len(x))]
    df = spark.createDataFrame(rows, "track_id long, clip_idx int, ord int, has_face boolean, body array<double>, face array<double>, pose array<double>, motion array<double>").cache()
    sent, got = shuffled(spark, lambda: distance.hybrid(df, 6).toPandas())
    assert sent < 12 * x.nbytes * 72 / 32
    assert len(got) == len(set(zip(got["i"], got["j"], strict=True))) == 1200 * 1199 // 2 and (got["i"] < got["j"]).all()
    unit = [distance.units(np.ascontiguousarray(v)) for v in (x, x[:, ::-1], x[:, :4], x[:, -4:])]
    body, face, pose, motion = (1 - np.einsum("ij,ij->i", u[got["i"]], u[got["j"]]) for u in unit)
    both = (got["i"] % 3 != 0) & (got["j"] % 3 != 0)
    want = np.where(both, 0.6 * body + 0.2 * face, 0.8 * body) + 0.1 * pose + 0.1 * motion
    assert np.allclose(got["distance"], want, atol=1e-6, equal_nan=True) and got["distance"].isna().sum() == 1199
