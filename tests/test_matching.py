"""Matching in rounds against going through the pairs one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.config import Config
from strandloom.operators import match, matching

from .test_linkage import frame, made, plain_candidates, plain_passes

PAIR = "i long, j long, distance double, body_sim double, threshold double, face_i boolean, face_j boolean, clip_i int, clip_j int"


def together(spark, n, seed, **how):
    """Many small worlds in one table: clusters of world w are numbered from 1000 w."""
    rng = np.random.default_rng(seed)
    pairs, rows, want = [], [], {}
    for w in range(n):
        own = made(seed * 100 + w, n=int(rng.integers(12, 40)), clips=int(rng.integers(3, 8)), labels=int(rng.integers(3, 9)))
        own += [(500 + k, 9 + k % 3, *own[k][2:]) for k in range(4)]  # copies: ties in distance
        own = [(1000 * w + r[0], *r[1:]) for r in own]
        some = plain_candidates(own)
        want |= plain_passes(some, own)
        pairs += some
        rows += own
    cols = [c.split()[0] for c in PAIR.split(", ")]
    typed = [tuple(v.item() if isinstance(v, np.generic) else v for v in (p[c] for c in cols)) for p in pairs]
    return spark.createDataFrame(typed, PAIR), frame(spark, rows).withColumn("local_cluster", F.col("track_id").cast("long")), want


@pytest.mark.parametrize("seed", range(4))
def test_rounds_give_what_steps_give(spark, seed):
    pairs, tracks, want = together(spark, 40, seed)
    got = {r["cluster"]: r["parent"] for r in matching.parents(pairs, tracks, Config()).collect()}
    assert got == {c: p for c, p in want.items() if c != p}
    assert len(got) > 100


def test_a_source_of_many_targets(spark):
    """One source that most others compete for, and chains of sources that are targets too."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=32)
    rows = [(0, 0, 0, 300, True, base.tolist(), base.tolist())]
    for k in range(1, 60):
        near = base + rng.normal(size=32) * rng.choice([0.2, 0.5, 0.8])
        rows.append((k, k % 9, 0, 300, bool(k % 7), near.tolist(), near.tolist()))
    some = plain_candidates(rows)
    want = plain_passes(some, rows)
    cols = [c.split()[0] for c in PAIR.split(", ")]
    pairs = spark.createDataFrame([tuple(v.item() if isinstance(v, np.generic) else v for v in (p[c] for c in cols)) for p in some], PAIR)
    tracks = frame(spark, rows).withColumn("local_cluster", F.col("track_id").cast("long"))
    got = {r["cluster"]: r["parent"] for r in matching.parents(pairs, tracks, Config()).collect()}
    assert got == {c: p for c, p in want.items() if c != p}
    flat = {r["cluster"]: r["parent"] for r in matching.parents(pairs, tracks, Config(one_level_parents=False)).collect()}

    def root(c):
        while got.get(c, c) != c:
            c = got[c]
        return c

    assert flat == {c: root(c) for c in got}


@pytest.mark.parametrize("seed", range(3))
def test_locally_dominant_is_greedy(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 300, (900, 2)) if a != b}
    weighed = [(i, j, int(rng.integers(0, 20))) for i, j in pairs]
    free, want = set(range(300)), set()
    for _, i, j in sorted((w, i, j) for i, j, w in weighed):
        if {i, j} <= free:
            free -= {i, j}
            want.add((i, j))
    df = spark.createDataFrame(weighed, "i long, j long, w int").withColumn("order", F.struct("w", "i", "j"))
    assert {tuple(r) for r in matching.locally_dominant(df).collect()} == want


def test_a_component_of_many_pairs_goes_through_many_tasks(spark):
    """200,000 pairs of one component; no task of the rounds holds them all."""
    n = 200_000
    df = spark.range(n).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"), F.struct(F.xxhash64("id").alias("h"), "id").alias("order"))
    got = matching.locally_dominant(df)
    assert got.select(F.explode(F.array("i", "j")).alias("c")).groupBy("c").count().where("count > 1").isEmpty()
    assert got.count() > n / 3
    free = df.join(got.select("i", F.lit(1).alias("x")), "i", "left_anti")
    ends = got.select(F.explode(F.array("i", "j")).alias("c"))
    left = free.join(ends.withColumnRenamed("c", "i"), "i", "left_anti").join(ends.withColumnRenamed("c", "j"), "j", "left_anti")
    assert left.isEmpty()


def test_nothing_to_match(spark):
    pairs, tracks, _ = together(spark, 1, 1)
    assert matching.parents(pairs.limit(0), tracks, Config()).collect() == []
    assert match.matched(tracks.limit(0)).collect() == []


def test_distances_of_blocks(spark, monkeypatch):
    """Clusters of several blocks, zero faces: least distances are those over all pairs of tracklets."""
    monkeypatch.setattr(matching, "BLOCK", 3)
    rows = made(9, n=40, clips=4, labels=5)
    tracks = frame(spark, rows).withColumn("local_cluster", F.col("track_id") % 4)
    asked = spark.createDataFrame([(0, 1), (1, 2), (2, 2), (0, 1)], "a long, b long")
    got = {(r["a"], r["b"]): r for r in matching.between(asked, matching.blocks(tracks)).collect()}
    from .test_linkage import plain_distance

    assert len(got) == 3
    for (a, b), r in got.items():
        every = [(plain_distance(x, y), x[4] and y[4]) for x in rows for y in rows if x[0] % 4 == a and y[0] % 4 == b]
        assert np.isclose(r["distance"], min(d[0] for d, _ in every))
        assert np.isclose(r["body"], min(d[1] for d, _ in every))
        assert np.isclose(r["faced"], min(d[0] for d, both in every if both))
