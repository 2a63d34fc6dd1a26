"""Both passes of the matching from tiles: no table of all candidates is stored, results are those of going step by step."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.config import Config
from strandloom.operators import distance, match, matching

from .test_linkage import frame


def mixed(seed, n=150, people=6, faceless=0.3):
    """Clusters of two tracklets: with faces, without, and with one of each, so that body alone may pass where faces don't; copies are ties."""
    rng = np.random.default_rng(seed)
    bodies, rows = rng.normal(size=(people, 16)), []
    for c in range(n):
        who, clip, kind = int(rng.integers(people)), int(rng.integers(5)), rng.random()
        for k in range(2):
            body = bodies[who] + rng.choice([0.2, 0.5]) * rng.normal(size=16)
            face = bodies[who][::-1] + rng.choice([0.3, 1.5, 4.0]) * rng.normal(size=16)
            rows.append((2 * c + k, clip, 0, int(rng.integers(60, 400)), bool(kind > faceless and (k or kind > 0.6)), body.tolist(), face.tolist()))
    rows += [(2 * n + k, (rows[k][1] + 1) % 5, *rows[k][2:]) for k in range(20)]
    return rows


def clustered(spark, rows):
    return frame(spark, rows).withColumn("local_cluster", F.floor(F.col("track_id") / 2).cast("long"))


def stepwise(tracks, config=Config()):
    return match.two_passes(match.candidates(tracks, config).toPandas(), tracks.toPandas(), config)


@pytest.mark.parametrize("seed", range(2))
def test_tiles_give_what_steps_give(spark, monkeypatch, seed):
    monkeypatch.setattr(distance, "TILE", 64)
    monkeypatch.setattr(distance, "MOST", 64)
    monkeypatch.setattr(match.first_pass, "__defaults__", (Config(), 500, 0))
    tracks = clustered(spark, mixed(seed)).cache()
    want = stepwise(tracks)
    got = {r["local_cluster"]: r["final_id"] for r in match.matched(tracks).collect()}
    assert {c: p for c, p in got.items() if c != p} == {c: p for c, p in want.items() if c != p}
    assert sum(c != p for c, p in got.items()) > 20


def test_bands_take_what_all_pairs_take(spark):
    tracks = clustered(spark, mixed(7, faceless=0.7)).cache()
    want = {tuple(r) for r in matching.first_pass(match.candidates(tracks)).collect()}
    got = [tuple(r) for r in match.first_pass(tracks, match.clusters(tracks), band=400, width=0).collect()]
    assert len(got) == len(set(got)) > 10 and set(got) == want


def test_no_table_of_all_candidates_is_stored(spark, monkeypatch):
    """One person, 300 lone tracklets: 40,000 pairs pass, while what is stored stays within a few rows a cluster and a band."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(k, k % 9, 0, 200, bool(k % 3), *((base + 0.2 * rng.normal(size=16)).tolist() for _ in range(2))) for k in range(300)]
    tracks = frame(spark, rows).withColumn("local_cluster", F.col("track_id").cast("long")).cache()
    held, stored = {}, match.stored

    def counted(df, name):
        out = stored(df, name)
        held[name] = max(held.get(name, 0), out.count())
        return out

    for module in (match, matching):
        monkeypatch.setattr(module, "stored", counted)
    monkeypatch.setattr(match.first_pass, "__defaults__", (Config(), 8000, 0))
    assert match.candidates(tracks).count() > 30_000
    held.clear()
    want, got = None, {r["local_cluster"]: r["final_id"] for r in match.matched(tracks).collect()}
    assert max(held.values()) < 15_000, held
    want = stepwise(tracks)
    assert all(got[c] == p for c, p in want.items())


def test_rows_of_a_cell_are_a_few_a_target():
    import pandas as pd

    far = np.iinfo(np.int64).max
    rows = pd.DataFrame({"i": [5, 2, 1, 3, 4, 6], "j": [9, 9, 9, 9, 8, 8], "distance": [0.1, 0.1, 0.3, 0.05, 0.45, 0.2], "odd": [False, False, False, True, False, True], "first": [far] * 6})
    got = match.nearest_sources(rows)
    assert sorted(zip(got["j"], got["i"], got["odd"], got["first"], strict=True)) == [(8, 4, False, 4), (8, 6, True, 4), (9, 2, False, 1)]


def test_a_cluster_is_sent_as_one_block(spark):
    """3,000 tracklets of a cluster: as blocks of 512 each pair of clusters met as 36 pairs of blocks, each of which was sent."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 4))
    tracks = spark.createDataFrame([(k, k % 2, bool(k % 3), v.tolist(), v[::-1].tolist()) for k, v in enumerate(x)], "track_id long, local_cluster long, has_face boolean, body array<double>, face array<double>")
    own = matching.blocks(tracks)
    assert own.count() == 2
    got = matching.between(spark.createDataFrame([(0, 1)], "a long, b long"), own).first()
    u = distance.units(x)
    assert np.isclose(got["body"], (1 - u[::2] @ u[1::2].T).min(), atol=1e-11)


def test_no_pass_for_pairs_that_cannot_be(spark, monkeypatch):
    """Where every cluster has a face, nothing is compared for the first pass."""
    tracks = clustered(spark, mixed(2, n=20, faceless=-1.0)).withColumn("has_face", F.lit(True))
    monkeypatch.setattr(match, "best_between", None)
    assert match.first_pass(tracks, match.clusters(tracks)).collect() == []
