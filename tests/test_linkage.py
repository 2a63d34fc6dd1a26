"""Order-dependent operators against plain versions, rule boundaries and properties."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandloom.config import Config
from strandloom.functions.graph import before, components, dense
from strandloom.operators import cluster, distance, features, match, overlap
from strandloom.sources.proxies import ordered


def made(seed, n=40, clips=3, dims=8, labels=5):
    """Tracklets with near copies of a few people, zero faces and equal spans."""
    rng = np.random.default_rng(seed)
    people = rng.normal(size=(labels, dims))
    out = []
    for i in range(n):
        who = int(rng.integers(labels))
        start = int(rng.choice([0, 10, 100, 200, 300, 400]))
        body = people[who] + rng.normal(size=dims) * rng.choice([0.05, 0.3, 0.6])
        face = np.zeros(dims) if rng.random() < 0.2 else people[who][::-1] + rng.normal(size=dims) * 0.2
        out.append((i, int(rng.integers(clips)), start, start + int(rng.choice([0, 30, 60, 120, 240])), bool(face.any() and rng.random() < 0.8), body.tolist(), face.tolist()))
    return out


SCHEMA = "track_id long, clip_idx int, start_frame int, end_frame int, has_face boolean, body array<double>, face array<double>"


def frame(spark, rows):
    return ordered(spark.createDataFrame(rows, SCHEMA)).cache()


def cos(a, b):
    return 1 - np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) if np.any(a) and np.any(b) else np.nan


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1], r[2], r[0]))


def ratio(a, b):
    short = min(a[3] - a[2], b[3] - b[2])
    return max(0, min(a[3], b[3]) - max(a[2], b[2])) / short if short else 0.0


@pytest.mark.parametrize("seed", range(3))
def test_fragments_follow_the_tail(spark, seed):
    rows = made(seed)
    want = {}
    for clip in {r[1] for r in rows}:
        own, used = [r for r in in_order(rows) if r[1] == clip], set()
        for a, s in enumerate(own):
            if s[0] in used:
                continue
            tail = s
            want[s[0]] = s[0]
            for t in own[a + 1 :]:
                if t[0] not in used and 0 < t[2] - tail[3] <= 120 and ratio(tail, t) <= 0.5 and 1 - cos(tail[5], t[5]) > 0.8:
                    used.add(t[0])
                    want[t[0]] = s[0]
                    tail = t
    got = {r["track_id"]: r["fragment"] for r in cluster.fragments(frame(spark, rows)).collect()}
    assert got == want and len(set(want.values())) < len(want)


@pytest.mark.parametrize("seed", range(3))
def test_greedy_clusters(spark, seed):
    rows = made(seed)
    got = {r["track_id"]: r["local_cluster"] for r in cluster.local_clusters(frame(spark, rows)).collect()}
    next_id = 0
    for clip in sorted({r[1] for r in rows}):
        own, groups = [r for r in in_order(rows) if r[1] == clip], []
        for t in own:
            scores = [np.mean([0.6 * cos(t[5], m[5]) + 0.4 * cos(t[6], m[6]) for m in g]) if ratio(t, g[0]) <= 0.5 else np.inf for g in groups]
            best, at = np.inf, None
            for k, s in enumerate(scores):
                if s < best:
                    best, at = s, k

            def about(m, t=t):
                lengths = sorted((t[3] - t[2], m[3] - m[2]))
                shared = max(0, min(t[3], m[3]) - max(t[2], m[2]))
                return ratio(t, m), lengths[1] / lengths[0] if lengths[0] else np.inf, t[4] and m[4], lengths[0] > 0 and shared >= lengths[0]

            if at is not None and 1 - cos(t[5], groups[at][0][5]) >= cluster.required(*about(groups[at][0])) and all(1 - cos(t[5], m[5]) >= cluster.cohesion(*about(m)) for m in groups[at]):
                groups[at].append(t)
            else:
                groups.append([t])
        for k, g in enumerate(groups):
            for m in g:
                assert got[m[0]] == next_id + k
                assert m is g[0] or ratio(m, g[0]) <= 0.5
        next_id += len(groups)
    assert sorted(set(got.values())) == list(range(next_id))


def test_zero_faces_block_unless_switched_off(spark):
    v = [1.0, 0.0]
    rows = [(0, 0, 0, 50, False, v, [0.0, 0.0]), (1, 0, 60, 110, False, v, [0.0, 0.0])]
    both = lambda c: len({r["local_cluster"] for r in cluster.local_clusters(frame(spark, rows), c).collect()})
    assert both(Config()) == 2 and both(Config(zero_face_blocks=False)) == 1


@pytest.mark.parametrize(
    "args, need",
    [
        ((0.41, 1.9, False, False), 0.80), ((0.41, 2.0, True, False), 0.85), ((0.4, 1.0, False, False), 0.87), ((0.11, 2.0, True, False), 0.85), ((0.11, 2.0, False, False), 0.90),
        ((0.1, 2.0, False, False), 0.90), ((0.1, 1.99, False, False), 0.87), ((0.0, 3.0, True, False), 0.85), ((0.0, 3.0, True, True), 0.90),
    ],
)
def test_required_at_the_cuts(args, need):
    assert cluster.required(*args) == pytest.approx(need)


@pytest.mark.parametrize(
    "args, need",
    [((0.91, 1, False, False), 0.86), ((0.9, 1, False, False), 0.80), ((0.4, 1, True, False), 0.70), ((0.4, 1, False, False), 0.80), ((0.0, 2, True, False), 0.85), ((0.1, 2, True, False), 0.88), ((0.2, 2, True, False), 0.73), ((0.2, 1, True, True), 0.75)],
)
def test_cohesion_at_the_cuts(args, need):
    assert cluster.cohesion(*args) == pytest.approx(need)


def plain_distance(a, b):
    """Weighted distance of two tracklets and their body distance; what is no number counts as 1."""
    body, face = cos(a[5], b[5]), cos(a[6], b[6])
    weighted = 0.55 * body + 0.45 * face if a[4] and b[4] and face < 1 else body
    return (1.0 if np.isnan(weighted) else weighted), (1.0 if np.isnan(body) else body)


def plain_candidates(rows):
    """All pairs of tracklets of unlike clips that look alike, each tracklet a cluster."""
    out = []
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] != b[1] and not np.isnan(cos(a[5], b[5])):
                d, body = plain_distance(a, b)
                if d < 0.51 and 1 - body >= 0.6:
                    out.append({"i": a[0], "j": b[0], "distance": d, "body_sim": 1 - body, "threshold": 0.44 if a[0] % 2 else 0.51, "face_i": a[4], "face_j": b[4], "clip_i": a[1], "clip_j": b[1]})
    return out


def plain_passes(pairs, rows):
    """Both passes step by step: the first locks, the second rescores grown roots and minds claims."""
    track, root = {r[0]: r for r in rows}, {}
    for p in pairs:
        root[p["i"]], root[p["j"]] = p["i"], p["j"]
    locked, confirmed, fed = [], [], {}

    def group(c):
        return [track[x] for x in root if root[x] == c]

    for p in sorted((p for p in pairs if not (p["face_i"] and p["face_j"])), key=lambda p: -p["body_sim"]):
        i, j = p["i"], p["j"]
        if root[i] != i or root[j] != j or p["clip_i"] == p["clip_j"] or i in locked or j in locked:
            continue
        root[j] = i
        locked += [i, j]
    best = {}
    for p in pairs:
        i, j = p["i"], p["j"]
        if not (p["face_i"] and p["face_j"]) or root[i] != i or root[j] != j or p["clip_i"] == p["clip_j"] or (i in locked and j in locked):
            continue
        d = p["distance"]
        if len(group(i)) > 1 or len(group(j)) > 1:
            with_faces = [plain_distance(a, b)[0] for a in group(i) for b in group(j) if a[4] and b[4]]
            d = min(with_faces or [plain_distance(a, b)[0] for a in group(i) for b in group(j)])
        if j not in best or d < best[j][0]:
            best[j] = (d, p)
    for d, p in sorted(best.values(), key=lambda x: x[0]):
        i, j, similar = p["i"], p["j"], p["body_sim"]
        if root[i] != i or root[j] != j:
            continue
        if len(group(i)) > 1 or len(group(j)) > 1:
            d = min(plain_distance(a, b)[0] for a in group(i) for b in group(j))
            similar = 1 - min(plain_distance(a, b)[1] for a in group(i) for b in group(j))
        if d >= p["threshold"] or similar < 0.7 or (i in locked and j in locked):
            continue
        if (i, p["clip_j"]) in confirmed or (j, p["clip_i"]) in confirmed or fed.get((i, p["clip_j"])) == p["clip_i"]:
            continue
        root[j] = i
        fed[i, p["clip_j"]] = p["clip_i"]
        confirmed += [(i, p["clip_i"]), (i, p["clip_j"])]
    return root


@pytest.mark.parametrize("seed", range(40))
def test_two_passes_step_by_step(seed):
    """Zero faces, lone faces, copies and grown roots."""
    rows = made(seed, n=36, clips=6, labels=7)
    rows += [(100 + k, 9 + k, *rows[k][2:]) for k in range(4)]  # copies: ties in distance
    pairs = plain_candidates(rows)
    tracks = pd.DataFrame([{"local_cluster": r[0], "has_face": r[4], "body": np.array(r[5]), "face": np.array(r[6])} for r in rows])
    got = match.two_passes(pd.DataFrame(pairs), tracks, Config())
    want = plain_passes(pairs, rows)
    assert got == want and sum(a != b for a, b in want.items()) > 3


@pytest.mark.parametrize("parents", [True, False])
def test_components_match_as_one_group(spark, parents):
    """Matching each component on its own gives what matching all candidates together gives."""
    config = Config(one_level_parents=parents)
    rows = made(5, n=60, clips=5, labels=9)
    tracks = frame(spark, rows).withColumn("local_cluster", F.col("track_id"))
    pairs = match.candidates(tracks, config).toPandas()
    assert len(pairs) > 3
    whole = match.two_passes(pairs, tracks.toPandas(), config)
    got = {r["local_cluster"]: r["final_id"] for r in match.matched(tracks, config).collect()}
    assert got == {c: whole.get(c, c) for c in got}
    assert any(a != b for a, b in got.items())


def test_catalogue_links_copies_across_clips_and_never_repeats_a_clip(spark):
    rng = np.random.default_rng(8)
    rows = []
    for who in range(4):
        body, face = rng.normal(size=32).tolist(), rng.normal(size=32).tolist()
        rows += [(who * 10 + clip, clip, 5 * who, 5 * who + 300, True, body, face) for clip in range(2)]
    tracks = frame(spark, rows)
    named = tracks.join(cluster.local_clusters(tracks), ["clip_idx", "track_id"])
    got = match.catalogue(named).toPandas()
    assert len(got) == 8 and got["global_id"].nunique() == 4
    assert (got.groupby(got["track_id"] // 10)["global_id"].nunique() == 1).all()


def test_repair_gives_fresh_ids(spark):
    rows = [(0, 0, 0, 1, 0, 100), (0, 0, 1, 2, 0, 50), (0, 1, 2, 3, 0, 50), (1, 0, 3, 4, 0, 10)]
    t = spark.createDataFrame(rows, "global_id long, clip_idx int, local_cluster long, track_id long, start_frame int, end_frame int")
    got = {r["track_id"]: r["global_id"] for r in match.repaired(t).collect()}
    assert got == {1: 0, 2: 2, 3: 0, 4: 1}


def test_components_and_dense(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and got[100] == got[90] == got[95] != got[0]
    values = [5, 70000, 5, 0, 200000]
    ranks = {r["x"]: r["rank"] for r in dense(spark.createDataFrame([(v,) for v in values], "x long"), "x").collect()}
    assert ranks == {0: 0, 5: 1, 70000: 2, 200000: 3}


@pytest.mark.parametrize("seed", range(2))
def test_smoothed_vectors(spark, seed):
    rows = made(seed, n=30)
    got = {r["track_id"]: r["vec"] for r in features.ema_vectors(frame(spark, rows), ["clip_idx"], "track_id", "body").collect()}
    for clip in {r[1] for r in rows}:
        last = None
        for r in sorted(r for r in rows if r[1] == clip):
            x = np.array(r[5])
            if last is not None:
                x = x / 3 + last * (1 - 1 / 3)
                x = x / (np.linalg.norm(x) + 1e-8)
            last = x
            assert got[r[0]] == pytest.approx(last.tolist())


def test_representatives(spark):
    rng = np.random.default_rng(0)
    rows = [(0, i, rng.normal(size=4).tolist(), float(i % 7)) for i in range(60)] + [(1, i, rng.normal(size=4).tolist(), 1.0) for i in range(9)] + [(2, i, rng.normal(size=4).tolist(), float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "g int, at int, body array<double>, q double")
    count = lambda c: features.representatives(df, ["g"], "at", "body", "q", config=c).groupBy("g").count().toPandas().set_index("g")["count"].to_dict()
    assert count(Config()) == {0: 18, 1: 9, 2: 15}
    assert count(Config(enforce_budget=True)) == {0: 15, 1: 9, 2: 15}
    best = {r["at"] for r in features.representatives(df.where("g = 2"), ["g"], "at", "body", "q").collect()}
    assert {14, 15, 16, 17, 18, 19, 0} <= best


def test_average_linkage(spark):
    rows = [(0, 0, 0, 9, True, [1.0, 0.0], [1.0, 0.0]), (1, 0, 1, 9, True, [0.0, 1.0], [1.0, 0.0]), (2, 0, 2, 9, True, [0.9, 0.1], [1.0, 0.0]), (3, 1, 0, 9, True, [1.0, 0.0], [1.0, 0.0])]
    got = {r["track_id"]: r["cluster"] for r in cluster.average_linkage(frame(spark, rows), 0.3).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 2}


def test_overlap_of_empty_and_touching_spans(spark):
    rows = [(0, 0, 0, 100), (1, 0, 100, 200), (2, 0, 50, 50), (3, 0, 99, 400), (4, 0, 700, 1300)]
    t = ordered(spark.createDataFrame(rows, "track_id long, clip_idx int, start_frame int, end_frame int"))
    got = {(r["i"], r["j"]): (r["overlap"], round(r["ratio"], 4)) for r in overlap.overlapping_pairs(t).collect()}
    assert got == {(0, 3): (1, 0.01), (3, 1): (100, 1.0)}
    assert overlap.max_simultaneous(t).collect()[0]["max_simultaneous"] == 3




def test_prefix_sums_over_ranges(spark):
    rows = [(k, v) for k, v in zip([5, 5, 70, 71, 900, 20, 300], [1, 2, 3, 4, 5, 6, 7], strict=True)]
    got = {r["k"]: r["before"] for r in before(spark.createDataFrame(rows, "k long, v long"), "k", F.col("v"), width=64).collect()}
    assert got == {5: 0, 20: 3, 70: 9, 71: 12, 300: 16, 900: 23}


def test_many_tracklets_in_one_clip():
    """Memory grows with the tracklets, not with their pairs."""
    rng = np.random.default_rng(2)
    n, people = 6000, rng.normal(size=(40, 16))
    who = rng.integers(40, size=n)
    body = people[who] + rng.normal(size=(n, 16)) * 0.05
    start = np.sort(rng.integers(10**6, size=n))
    pdf = pd.DataFrame({"start_frame": start, "end_frame": start + 60, "has_face": True, "body": list(body), "face": list(body[:, ::-1])})
    tracemalloc.start()
    got = cluster.greedy(pdf, Config())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6 and len(set(zip(got.tolist(), who.tolist(), strict=True))) == len(set(got.tolist())) == 40


@pytest.mark.parametrize("seed", range(4))
def test_nearest_point(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 50, (300, 2)) / 2.0, rng.integers(0, (5, 90), (200, 2)) / 2.0
    b = b[np.argsort(b[:, 0], kind="stable")]
    want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)).min(axis=1)
    assert distance.nearest(a, b, step=16, margin=2) == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("tile", [8, 8192])
def test_grid_tiles_give_the_same(spark, monkeypatch, tile):
    """Large groups in tiles of their own, small ones in shared tiles, stretches of a tile."""
    rng = np.random.default_rng(1)
    points = [(i, 0 if i < 60 else i % 7, rng.normal(size=2).tolist()) for i in range(100)]
    df = spark.createDataFrame(points, "k long, g long, at array<double>")
    monkeypatch.setattr(distance, "STEP", 5)
    monkeypatch.setattr(distance.grid, "__kwdefaults__", distance.grid.__kwdefaults__ | {"tile": tile})
    got = {(r["key"], r["other"]): r["nearest"] for r in distance.nearest_in_groups(df, "k", "g", "euclidean", "at").collect()}
    want = {}
    for k, g, x in points:
        for _, o, y in points:
            if o != g:
                want[k, o] = min(want.get((k, o), np.inf), float(np.hypot(x[0] - y[0], x[1] - y[1])))
    assert got == pytest.approx(want)
    near = {(r["key"], r["rank"]): r["other"] for r in distance.neighbours(df, "k", 3, "at").collect()}
    for k, _, x in points[::9]:
        order = sorted((round(cos(x, y), 9), o) for o, _, y in points if o != k)
        assert [near[k, r] for r in (1, 2, 3)] == [o for _, o in order[:3]]


def test_pairs_of_a_clip_come_from_many_cells(spark):
    """One clip, one stretch of time: its pairs are dealt over cells of bounded size, whose tasks are many; all pairs are there once."""
    rng = np.random.default_rng(8)
    tracks = [(k, 0, k // 8, k // 8 + 40, k % 3 != 0, *(rng.normal(size=4).tolist() for _ in range(4)), k + 1) for k in range(120)]
    df = spark.createDataFrame(tracks, "track_id long, clip_idx int, start_frame int, end_frame int, has_face boolean, body array<double>, face array<double>, pose array<double>, motion array<double>, ord int")

    def kernel(a, b):
        x, y = np.divmod(np.arange(len(a["ord"]) * len(b["ord"])), len(b["ord"]))
        return x, y, {}

    cells = distance.within_clips(df, ["start_frame", "end_frame"], lambda a, b: (*kernel(a, b)[:2], {"n": np.ones(len(a["ord"]) * len(b["ord"]), np.int64)}), "n long", part=16)
    assert sorted((r["i"], r["j"]) for r in cells.collect()) == [(i, j) for i in range(120) for j in range(i + 1, 120)]
    assert cells.rdd.glom().map(len).filter(lambda n: n > 0).count() >= 8
    far = [(k, 0, 100 * (k // 16), 100 * (k // 16) + 50, True, *tracks[k][5:]) for k in range(64)]
    apart = distance.within_clips(spark.createDataFrame(far, df.schema), ["start_frame", "end_frame"], lambda a, b: (*kernel(a, b)[:2], {"n": np.ones(len(a["ord"]) * len(b["ord"]), np.int64)}), "n long", part=16, touching=True)
    assert apart.count() == 4 * 16 * 15 // 2
    assert distance.rounded(np.array([0.0078125, -1e-9, 0.5]), 6).tolist() == [0.007813, 0.0, 0.5]


def test_chains_keep_no_edges(spark):
    """Many alike tracklets of one clip: a tail's later tracks are looked at some at a time, and the plan joins no edges."""
    n = 1500
    rows = [(k, 0, k % 300, k % 300 + 30 + k % 7, True, [1.0, 0.01 * (k % 5)], [1.0, 0.0]) for k in range(n)]
    assert "Join" not in cluster.fragments(frame(spark, rows))._jdf.queryExecution().optimizedPlan().toString()
    order = in_order(rows)
    pdf = pd.DataFrame({"start_frame": [r[2] for r in order], "end_frame": [r[3] for r in order], "body": [r[5] for r in order]})
    tracemalloc.start()
    got = cluster.chains(pdf, Config())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    used, want = set(), {}
    for s in range(n):
        tail = s
        while s not in used and tail is not None:
            want[tail] = s
            later = next((t for t in range(tail + 1, n) if t not in used and t not in want and 0 < order[t][2] - order[tail][3] <= 120), None)
            tail = later
        used |= set(want)
    assert got.tolist() == [want[k] for k in range(n)] and most < 5e6


def test_nearest_by_cosine_is_sent_in_wide_tiles(spark, monkeypatch):
    """Stretches of a sorted block give the nearest of each group, zero vectors too; a table of many tiles is sent in fewer, wider ones."""
    rng = np.random.default_rng(6)
    rows = [(k, int(rng.integers(0, 4)), rng.normal(size=5).tolist() if k % 20 else [0.0] * 5) for k in range(90)]
    monkeypatch.setattr(distance, "TILE", 2)
    monkeypatch.setattr(distance, "MOST", 30)
    monkeypatch.setattr(distance, "TILES", 3)
    monkeypatch.setattr(distance, "WIDE", 7)
    seen = []
    grid = distance.grid
    monkeypatch.setattr(distance, "grid", lambda *a, **k: seen.append(k.get("tile")) or grid(*a, **k))
    got = {(r["key"], r["other"]): r["nearest"] for r in distance.nearest_in_groups(spark.createDataFrame(rows, "k long, g long, body array<double>"), "k", "g").collect()}
    want = {}
    for k, g, x in rows:
        for _, o, y in rows:
            if o != g:
                d = cos(x, y) if any(x) and any(y) else 1.0
                want[k, o] = min(want.get((k, o), 9.0), d)
    assert got == pytest.approx(want) and seen == [30]
