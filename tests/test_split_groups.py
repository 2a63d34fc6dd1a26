"""Hausdorff distances by cells, and representatives of groups of any size, against plain versions."""

import numpy as np
import pytest

from strandloom.config import Config
from strandloom.operators import features, spatial
from strandloom.sources.tables import stored


def plain_hausdorff(points):
    groups = {g: np.array([v for _, h, v in points if h == g], float) for g in {h for _, h, _ in points}}
    out = {}
    for g in groups:
        for h in groups:
            if g < h:
                d = np.sqrt(((groups[g][:, None] - groups[h][None]) ** 2).sum(axis=2))
                out[g, h] = max(d.min(axis=1).max(), d.min(axis=0).max())
    return out


def scattered(seed, dims=2):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(0, 1000, (7, dims))
    rows = [(k, int(g := rng.integers(7)), (centres[g] + rng.normal(size=dims) * rng.choice([1.0, 60.0])).round(1).tolist()) for k in range(700)]
    return rows + [(700 + k, 3, rows[0][2]) for k in range(40)] + [(800, 9, [5000.0] + [0.0] * (dims - 1))]


@pytest.mark.parametrize(("seed", "dims", "cells"), [(0, 2, 64), (0, 2, 1), (1, 2, 7), (2, 3, 16), (3, 1, 16)])
def test_hausdorff_is_equal_at_any_cell_width(spark, monkeypatch, seed, dims, cells):
    monkeypatch.setattr(spatial, "POINTS", 16)  # full cells are several blocks
    rows = scattered(seed, dims)
    df = spark.createDataFrame(rows, "k long, g int, at array<double>")
    got = {(r["i"], r["j"]): r["distance"] for r in spatial.hausdorff(df, "k", "g", "at", cells).collect()}
    want = plain_hausdorff(rows)
    assert set(got) == set(want)
    assert all(got[p] == pytest.approx(want[p], abs=1e-9) for p in want)


def test_hausdorff_with_stretches_of_a_group(spark, monkeypatch):
    monkeypatch.setattr("strandloom.operators.distance.STEP", 5)  # a group's cells meet others in several stretches
    rows = scattered(5)
    df = spark.createDataFrame(rows, "k long, g int, at array<double>")
    got = {(r["i"], r["j"]): r["distance"] for r in spatial.hausdorff(df, "k", "g", "at", 32).collect()}
    assert got == pytest.approx(plain_hausdorff(rows))


def test_hausdorff_visits_few_cells(spark):
    rng = np.random.default_rng(4)
    rows = [(k, k % 3, (rng.uniform(0, 1000, 2) + 200 * (k % 3)).tolist()) for k in range(6000)]
    points = spatial.in_cells(spark.createDataFrame(rows, "k long, g int, at array<double>"), "k", "g", "at", 32)
    own = spatial.boxes(points)
    pairs = own.count() * own.count()
    met = spatial.visits(own).selectExpr("sum(size(cells)) n").first()["n"]
    assert met < 0.01 * pairs


def test_hausdorff_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, [0.0, 0.0]), (2, 1, [3.0, 4.0]), (None, 1, [0.0, 0.0]), (3, 1, None), (4, 1, [nan, 0.0]), (5, 0, [inf, 0.0]), (6, 0, [None, 0.0]), (7, None, [9.0, 9.0]), (8, 2, []), (2, 1, [3.0, 4.0])]
    schema = "key long, group int, vec array<double>"
    got = [tuple(r) for r in spatial.hausdorff(spark.createDataFrame(rows, schema), "key", "group", "vec").collect()]
    assert got == [(0, 1, 5.0)]
    assert spatial.hausdorff(spark.createDataFrame([], schema), "key", "group", "vec").count() == 0
    same = spark.createDataFrame([(1, 0, [2.0, 2.0]), (2, 1, [2.0, 2.0])], schema)
    assert [tuple(r) for r in spatial.hausdorff(same, "key", "group", "vec").collect()] == [(0, 1, 0.0)]


def plain_representatives(rows, most, enforce):
    out = []
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        score = [-np.inf if r[3] is None or np.isnan(r[3]) else r[3] for r in own]
        by_score = sorted(range(len(own)), key=lambda i: (-score[i], i))
        best = max(5, int(0.3 * len(own)))
        taken = list(range(len(own))) if len(own) <= most else by_score[: min(best, most) if enforce else best]
        if len(own) > most > len(taken):
            x = [np.array(r[2]) / (np.linalg.norm(r[2]) + 1e-8) for r in own]
            picked = []
            while len(taken) + len(picked) < most:
                left = [i for i in range(len(own)) if i not in taken and i not in picked]
                picked.append(max(left, key=lambda i: (min((1 - x[i] @ x[p] for p in picked), default=0), -i)))
            taken += picked
        out += [(g, own[i][1]) for i in taken]
    return sorted(out, key=str)


@pytest.mark.parametrize(("most", "enforce"), [(15, False), (15, True), (40, False), (3, True)])
def test_representatives_of_groups_of_any_size(spark, most, enforce):
    rng = np.random.default_rng(6)
    sizes = {0: 1, 1: 15, 2: 16, 3: 20, 4: 49, 5: 50, 6: 53, 7: 54, 8: 900, None: 30}
    score = lambda i: None if i % 11 == 3 else float("nan") if i % 13 == 4 else float(i * 7 % 5)
    rows = [(g, i, rng.normal(size=4).tolist(), score(i)) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "g int, at int, body array<double>, q double").repartition(7)
    got = features.representatives(df, ["g"], "at", "body", "q", most, Config(enforce_budget=enforce))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_representatives(rows, most, enforce)


def test_large_group_is_numbered_by_many_tasks(spark):
    df = spark.range(40000).selectExpr("cast(id % 3 = 0 as int) * 7 g", "id at", "double(id % 4) q")
    got = features.numbered(df, ["g"], "at", "q")
    assert got.where("g = 0").selectExpr("count(distinct place) c", "min(place) a", "max(place) b", "max(n) n").first() == (26666, 1, 26666, 26666)
    ranges = df.repartitionByRange(4, "g", "q", "at").selectExpr("g", "spark_partition_id() p").where("g = 0")
    assert ranges.distinct().count() > 1


def test_representatives_of_odd_rows(spark):
    schema = "g int, at int, body array<double>, q double"
    assert features.representatives(spark.createDataFrame([], schema), ["g"], "at", "body", "q").count() == 0
    rows = [(0, i // 2, None if i % 3 else [1.0, None], 1.0) for i in range(20)]
    assert features.representatives(spark.createDataFrame(rows, schema), ["g"], "at", "body", "q").count() == 15


def test_hausdorff_of_groups_that_share_points(spark):
    """Cells that hold the same points in both groups aren't visited; groups of equal points are 0 apart."""
    base = [(float(x), float(y)) for x in range(40) for y in range(40)]
    rows = [(g * 10_000 + i, g, list(p)) for g in range(4) for i, p in enumerate(base)] + [(90_000, 3, [39.0, 44.0])]
    df = spark.createDataFrame(rows, "key long, group long, vec array<double>")
    points = spatial.in_cells(df, "key", "group", "vec", 8)
    assert spatial.visits(stored(spatial.boxes(points), "boxes")).count() <= 6  # before: 61 cells of each of 12 directed pairs or so
    got = {(r["i"], r["j"]): r["distance"] for r in spatial.hausdorff(df, "key", "group", "vec", 8).collect()}
    assert got == {(i, j): 5.0 if j == 3 else 0.0 for i in range(4) for j in range(i + 1, 4)}
