"""Linking clusters across clips: candidates, two greedy passes, compact ids and repair of repeated clips."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.graph import before, dense
from ..functions.vectors import norm, over
from ..sources.tables import stored
from . import matching
from .distance import Block, best_between, units, weighted_block
from .features import length_mean
from .matching import DIGITS


#: Largest threshold of the rule table; farther clusters aren't looked at. Fixed value.
LARGEST = 0.51


#: Least threshold of two clusters with faces, least similarity of all candidates; fixed values of the rule table.
LEAST, ALIKE = 0.44, 0.65
#: Pairs of a band of the first pass, about: so many, or so many a cluster. Clusters that a band's bound is estimated from.
BAND, WIDTH, SOME = 1 << 24, 256, 2048
#: About a cluster: whether a track has a face, length, clip, direction of the mean body.
ABOUT = ("faced", "length", "of_clip", "mean")


def clusters(tracks: DataFrame) -> DataFrame:
    """local_cluster and ABOUT, stored."""
    cluster = ["local_cluster"]
    about = tracks.groupBy(*cluster).agg(F.bool_or("has_face").alias("face"), F.sum(F.col("end_frame") - F.col("start_frame")).alias("length"), F.min("clip_idx").alias("clip"))
    about = about.join(length_mean(tracks, cluster, "body").select(*cluster, "vec"), cluster)
    return stored(about.select(*cluster, F.col("face").alias("faced"), F.col("length").cast("double").alias("length"), F.col("clip").cast("long").alias("of_clip"), over(F.col("vec"), norm(F.col("vec"))).alias("mean")), "clusters")


def judged(a: Block, b: Block, similar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(limit, threshold) of pairs of clusters with the similarity of their means: the distance must be below the limit, which is the threshold of pairs that are alike."""
    length = (a["length"] + b["length"]) / 2.0
    both, one = a["faced"] & b["faced"], a["faced"] != b["faced"]
    # fixed values of the rule table
    threshold = np.select([both & (length > 500), both & (length > 300), length > 250], [0.44, 0.46, np.where(one, 0.41, 0.49)], np.where(one, 0.43, 0.51))
    good = similar >= np.where(one, 0.65, 0.70)  # what is no number doesn't pass
    return np.where(good, threshold, -np.inf), threshold


def _known(tracks: DataFrame, about: DataFrame) -> DataFrame:
    return tracks.select("track_id", "local_cluster", "clip_idx", "has_face", "body", "face").join(about, "local_cluster")


def candidates(tracks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """i < j local clusters of unlike clips whose best distance and mean similarity pass the banded thresholds.

    Columns: i, j, distance, body_sim, threshold, face_i, face_j, clip_i, clip_j; face_similarity() adds face_sim.
    """

    def passing(a: Block, b: Block, similar: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        limit, threshold = judged(a, b, similar)
        return limit, {"body_sim": similar, "threshold": threshold, "face_i": a["faced"], "face_j": b["faced"], "clip_i": a["of_clip"], "clip_j": b["of_clip"]}

    schema = "body_sim double, threshold double, face_i boolean, face_j boolean, clip_i long, clip_j long"
    out = best_between(_known(tracks, clusters(tracks)), "track_id", "local_cluster", config=config, below=LARGEST, about=ABOUT, passing=(schema, passing), like=("mean", ALIKE))
    return out.select("i", "j", "distance", "body_sim", "threshold", "face_i", "face_j", "clip_i", "clip_j")


def _bound(live: DataFrame, last: float, size: int) -> float | None:
    """A similarity that about `size` pairs of live clusters for the first pass reach, below `last`; None: all of them may be taken.

    Estimated from SOME clusters at most; it decides how many pairs are stored at once, not which ones are taken.
    """
    n = live.count()
    rows = live.orderBy(F.xxhash64("local_cluster"), "local_cluster").select("faced", "of_clip", "mean").limit(SOME).collect()
    if n <= 1 or n * (n - 1) // 2 <= size:
        return None
    faced, clip = np.array([r["faced"] for r in rows]), np.array([r["of_clip"] for r in rows])
    mean = np.array([[np.nan if x is None else x for x in r["mean"]] for r in rows], float)
    similar = (mean @ mean.T)[np.triu(~(faced[:, None] & faced[None]) & (clip[:, None] != clip[None]), 1)]
    similar = np.sort(similar[(similar >= ALIKE) & (similar < last)])
    keep = int(size * (len(rows) / n) ** 2)
    return None if len(similar) <= keep else float(np.floor(similar[-1 - keep] * 1e6) / 1e6)


def first_pass(tracks: DataFrame, about: DataFrame, config: Config = DEFAULT, band: int = BAND, width: int = WIDTH) -> DataFrame:
    """matching.first_pass() of the candidates without storing them all: bands of falling similarity, each among the clusters that the bands before left.

    All pairs of a band come before all of the next, so that what a band takes is final.
    """
    live, taken, last = about, None, np.inf
    while True:
        if live.where("NOT faced").isEmpty():  # all pairs that are left have two faces
            return taken if taken is not None else stored(live.select(F.col("local_cluster").cast("long").alias("i"), F.col("local_cluster").cast("long").alias("j")).limit(0), "partners")
        last = _bound(live, last, max(band, width * about.count()))

        def passing(a: Block, b: Block, similar: np.ndarray, low: float = ALIKE if last is None else last) -> tuple[np.ndarray, dict[str, np.ndarray]]:
            limit, _ = judged(a, b, similar)
            return np.where(~(a["faced"] & b["faced"]) & (similar >= low - 1e-9), limit, -np.inf), {"body_sim": similar, "face_i": a["faced"], "face_j": b["faced"]}

        pairs = best_between(_known(tracks, live), "track_id", "local_cluster", config=config, below=LARGEST, about=ABOUT, passing=("body_sim double, face_i boolean, face_j boolean", passing), like=("mean", ALIKE if last is None else last))
        if last is not None:
            pairs = pairs.where(F.round("body_sim", DIGITS) >= last)
        new = matching.first_pass(pairs)
        taken = new if taken is None else taken.unionByName(new)
        if last is None:
            return stored(taken, "partners")
        ends = new.select(F.explode(F.array("i", "j")).alias("end")).distinct()
        live = stored(live.join(ends, F.col("local_cluster") == F.col("end"), "left_anti"), "live")


def nearest_sources(rows: pd.DataFrame) -> pd.DataFrame:
    """Of rows of a cell those that can hold a target's nearest source or a tie with it, with the target's smallest source as `first`.

    A row that is `odd` has a pair whose distance of two faces isn't below its threshold as far as it is known here; that is at
    least LEAST, so that such rows matter only to targets without a nearer source.
    """
    j, d, i, odd = rows["j"].to_numpy(), rows["distance"].to_numpy(), rows["i"].to_numpy(), rows["odd"].to_numpy(bool)
    names, at = np.unique(j, return_inverse=True)
    first, best = np.full(len(names), np.iinfo(np.int64).max), np.full(len(names), np.inf)
    np.minimum.at(first, at, np.minimum(i, rows["first"].to_numpy()))
    np.minimum.at(best, at, np.where(odd, np.inf, d))
    keep = np.where(odd, best[at] >= LEAST, d <= best[at] + 4 * 10.0**-DIGITS)
    some = rows.assign(first=first[at], who=np.where(odd, i, -1))[keep].sort_values(["j", "distance", "i"])
    return some.drop_duplicates(["j", "distance", "odd", "who"]).drop(columns="who")


def events(tracks: DataFrame, about: DataFrame, partners: DataFrame, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """matching.events() of the candidates without storing them, and the blocks of their clusters: each cell gives a few rows a target."""
    locked = partners.select(F.col("i").alias("local_cluster"), F.lit(True).alias("locked"))
    open_ = about.where("faced").join(partners.select(F.col("j").alias("local_cluster")), "local_cluster", "left_anti")
    open_ = stored(open_.join(locked, "local_cluster", "left").withColumn("locked", F.coalesce("locked", F.lit(False))), "open")

    def passing(a: Block, b: Block, similar: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        limit, threshold = judged(a, b, similar)
        grown = a["locked"] | b["locked"]
        # a grown pair counts by its distance of two faces: a partner of a cluster with a face has none
        return np.where(a["locked"] & b["locked"], -np.inf, limit), {"body_sim": similar, "threshold": threshold, "clip_i": a["of_clip"], "clip_j": b["of_clip"], "grown": grown, "odd": grown & ~(a["seen"] & b["seen"]), "first": np.full(len(limit), np.iinfo(np.int64).max)}

    schema = "body_sim double, threshold double, clip_i long, clip_j long, grown boolean, odd boolean, first long"
    found = best_between(_known(tracks, open_), "track_id", "local_cluster", config=config, below=LARGEST, about=(*ABOUT, "locked"), passing=(schema, passing), like=("mean", ALIKE), joined=nearest_sources)
    found = stored(found.select("i", "j", "clip_i", "clip_j", "threshold", F.round("distance", DIGITS).alias("distance"), F.round("body_sim", DIGITS).alias("similar"), "grown", "odd", "first"), "found")
    sure, odd = found.where("NOT odd").drop("odd"), found.where("odd").drop("odd")
    nearest = sure.groupBy("j").agg(F.min("distance").alias("best"))
    odd = stored(odd.join(nearest, "j", "left").where(f"best IS NULL OR best >= {LEAST}").drop("best"), "odd")
    wanted = found.select(F.explode(F.array("i", "j")).alias("c")).unionByName(partners.select(F.explode(F.array("i", "j")).alias("c"))).distinct()
    own = matching.blocks(tracks.join(wanted, F.col("local_cluster").cast("long") == F.col("c"), "left_semi"))
    seen = matching.between(odd.select(F.col("i").alias("a"), F.col("j").alias("b")), own, config).select(F.col("a").alias("i"), F.col("b").alias("j"), F.coalesce("faced", "distance").alias("again"))
    every = sure.unionByName(odd.join(seen, ["i", "j"]).withColumn("distance", F.col("again")).drop("again"))
    return matching.ranked(every, matching.members_of(every, partners), own, config), own


def face_similarity(pairs: DataFrame, tracks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """pairs (i, j, ...) of clusters with face_sim: the best similarity of two faces, 0 at least."""
    wanted = pairs.select(F.explode(F.array("i", "j")).alias("local_cluster")).distinct()
    own = matching.blocks(tracks.withColumn("local_cluster", F.col("local_cluster").cast("long")).join(wanted, "local_cluster", "left_semi"))
    seen = matching.between(pairs.select(F.col("i").alias("a"), F.col("j").alias("b")), own, config)
    return pairs.join(seen.select(F.col("a").alias("i"), F.col("b").alias("j"), F.greatest(1 - F.col("face"), F.lit(0.0)).alias("face_sim")), ["i", "j"], "left").withColumn("face_sim", F.coalesce("face_sim", F.lit(0.0)))


def two_passes(pairs: pd.DataFrame, tracks: pd.DataFrame, config: Config) -> dict[int, int]:
    """Parent of each cluster of candidates that fit in memory, step by step; matched() gives the same in rounds."""
    pairs = pairs.sort_values(["i", "j"]).reset_index(drop=True)
    parent = {c: c for c in [*pairs["i"], *pairs["j"]]}
    members = {c: [c] for c in parent}
    block = {"body": units(tracks["body"]), "face": units(tracks["face"]), "has_face": tracks["has_face"].to_numpy(bool)}
    places = {c: own for c, own in tracks.groupby("local_cluster").indices.items()}
    locked: set[int] = set()
    one_face = ~(pairs["face_i"] & pairs["face_j"])

    def join(i: int, j: int) -> None:
        parent[j] = i
        members[i].append(j)
        members[j] = [c for c in members[j] if c != j]

    for r in pairs[one_face].sort_values("body_sim", ascending=False, kind="stable").itertuples(index=False):
        if parent[r.i] == r.i and parent[r.j] == r.j and r.clip_i != r.clip_j and not {r.i, r.j} & locked:
            join(r.i, r.j)
            locked |= {r.i, r.j}

    def between(i: int, j: int):
        at = (np.concatenate([places[c] for c in members[x]]) for x in (i, j))
        a, b = ({k: v[own] for k, v in block.items()} for own in at)
        d, body, face = weighted_block(a, b, config.face_weight_across)
        return np.nan_to_num(d, nan=1.0), np.nan_to_num(body, nan=1.0), a["has_face"][:, None] & b["has_face"][None]

    best: dict[int, tuple] = {}
    for r in pairs[~one_face].itertuples(index=False):
        if parent[r.i] != r.i or parent[r.j] != r.j or r.clip_i == r.clip_j or {r.i, r.j} <= locked:
            continue
        distance = r.distance
        if len(members[r.i]) > 1 or len(members[r.j]) > 1:
            d, _, both = between(r.i, r.j)
            distance = float(np.where(both, d, np.inf).min()) if both.any() else float(d.min())
        if r.j not in best or distance < best[r.j][0]:
            best[r.j] = (distance, r)
    confirmed: set[tuple[int, int]] = set()
    fed: dict[tuple[int, int], int] = {}
    for distance, r in sorted(best.values(), key=lambda x: x[0]):
        if parent[r.i] != r.i or parent[r.j] != r.j:
            continue
        similar = r.body_sim
        if len(members[r.i]) > 1 or len(members[r.j]) > 1:
            d, body, _ = between(r.i, r.j)
            distance, similar = float(d.min()), 1 - float(body.min())
        if not distance < r.threshold or similar < 0.70 or {r.i, r.j} <= locked:
            continue
        if (r.i, r.clip_j) in confirmed or (r.j, r.clip_i) in confirmed or fed.get((r.i, r.clip_j)) == r.clip_i:
            continue
        join(r.i, r.j)
        fed[r.i, r.clip_j] = r.clip_i
        confirmed |= {(r.i, r.clip_i), (r.i, r.clip_j)}
    if not config.one_level_parents:
        for c in parent:
            while parent[parent[c]] != parent[c]:
                parent[c] = parent[parent[c]]
    return parent


def matched(tracks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """local_cluster, final_id after both passes, which go in rounds of joins however large a component of the candidates is."""
    about = clusters(tracks)
    partners = first_pass(tracks, about, config)
    made, own = events(tracks, about, partners, config)
    got = matching.joined(partners, made, matching.members_of(made, partners), own, config).select(F.col("cluster").alias("local_cluster"), F.col("parent").alias("final_id"))
    every = tracks.select(F.col("local_cluster").cast("long").alias("local_cluster")).distinct()
    return every.join(got, "local_cluster", "left").select("local_cluster", F.coalesce("final_id", "local_cluster").alias("final_id"))


def compacted(ids: DataFrame, column: str, name: str = "global_id") -> DataFrame:
    """ids with name: the rank from 0 of the column's value among its distinct values."""
    return ids.join(dense(ids, column), column).withColumnRenamed("rank", name)


def repair_order(tracks: DataFrame) -> DataFrame:
    """global_id, clip_idx, local_cluster, length, place: clusters of one id in one clip, the longest (then larger number) first."""
    sums = tracks.groupBy("global_id", "clip_idx", "local_cluster").agg(F.sum(F.col("end_frame") - F.col("start_frame")).alias("length"))
    return sums.withColumn("place", F.row_number().over(Window.partitionBy("global_id", "clip_idx").orderBy(F.desc("length"), F.desc("local_cluster"))))


def repaired(tracks: DataFrame) -> DataFrame:
    """tracks with global_id such that no id has two local clusters in one clip: all but the first of each get fresh ids."""
    order = stored(repair_order(tracks), "repair")
    spare = order.where("place > 1")
    base = F.lit(tracks.agg(F.max("global_id")).first()[0] or 0) + 1
    inside = F.row_number().over(Window.partitionBy("global_id").orderBy("clip_idx", "place")) - 1
    fresh = spare.withColumn("inside", inside).join(before(spare, "global_id", F.lit(1)), "global_id").select("clip_idx", "local_cluster", "global_id", (base + F.col("before") + F.col("inside")).alias("fresh"))
    return tracks.join(fresh, ["clip_idx", "local_cluster", "global_id"], "left").withColumn("global_id", F.coalesce("fresh", "global_id")).drop("fresh")


def unclaimed(pairs: DataFrame, claims: DataFrame) -> DataFrame:
    """Candidates whose (target, clip) no one has claimed: the static form of the claim rule."""
    return pairs.join(claims.select(F.col("target").alias("i"), F.col("clip").alias("clip_j")), ["i", "clip_j"], "left_anti")


def catalogue(tracks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """global_id, clip_idx, track_id, start_frame, end_frame of tracks with local_cluster: match, compact, map back, repair."""
    ids = compacted(matched(tracks, config), "final_id").select("local_cluster", "global_id")
    named = tracks.withColumn("local_cluster", F.col("local_cluster").cast("long")).join(ids, "local_cluster")
    return repaired(named.select("global_id", "clip_idx", "track_id", "local_cluster", "start_frame", "end_frame")).select("global_id", "clip_idx", "track_id", "start_frame", "end_frame")
