"""The two matching passes over candidate pairs of clusters, in rounds of joins: no group holds a component.

Pass 1 takes pairs by falling similarity, each cluster once. That greedy choice is what locally dominant pairs give: a
pair that is the first one of both its clusters is taken, its clusters leave, and so on.

Pass 2 takes events, one for each target, by rising distance; an event is judged by the state of its two clusters
(members, claims, whether taken), which only accepted events of the same clusters change. So an event may be decided
as soon as no earlier event can still change either of its clusters; all such events are decided in one round. A
source accepts at most one event for each clip, and its refusals before the next acceptance are decided together.

Distances are compared as rounded to DIGITS places, so that they don't depend on how rows were blocked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..sources.tables import stored
from .distance import STEP, WIDE, packed, unpacked, units, weighted_block

#: Tracklets of a block of a cluster, about; stretches of it are compared.
BLOCK = 4096
DIGITS = 12
#: Least similarity that a confirmed pair needs. Fixed value.
SIMILAR = 0.70


def locally_dominant(pairs: DataFrame) -> DataFrame:
    """(i, j), stored: the pairs (i, j, order) that greedy matching in rising order takes; order must be unique.

    Equal to going through all pairs one by one and taking those whose ends are both free.
    """
    left, taken = stored(pairs.select("i", "j", "order"), "pairs"), None
    while not left.isEmpty():
        ends = left.select("i", "j", "order", F.explode(F.array("i", "j")).alias("end"))
        first = ends.groupBy("end").agg(F.min(F.struct("order", "i", "j")).alias("p"))
        new = stored(first.groupBy("p.i", "p.j").count().where("count = 2").select("i", "j"), "taken")
        gone = new.select(F.explode(F.array("i", "j")).alias("end"))
        left = stored(left.join(gone.withColumnRenamed("end", "i"), "i", "left_anti").join(gone.withColumnRenamed("end", "j"), "j", "left_anti"), "pairs")
        taken = new if taken is None else taken.unionByName(new)
    return taken if taken is not None else left.select("i", "j")


def blocks(tracks: DataFrame) -> DataFrame:
    """(cluster, part, block), stored: each cluster's tracklets in packed blocks of about BLOCK."""
    rows = tracks.select(F.col("local_cluster").cast("long").alias("cluster"), "track_id", "has_face", *(F.col(c).cast("array<double>").alias(c) for c in ("body", "face")))
    parts = rows.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = rows.join(parts, "cluster").withColumn("part", F.pmod(F.xxhash64("track_id"), F.col("parts"))).drop("track_id", "parts")

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"cluster": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int64()), "block": pa.array([packed(table.drop_columns(["cluster", "part"]))], pa.binary())})

    return stored(dealt.groupBy("cluster", "part").applyInArrow(pack, "cluster long, part long, block binary"), "blocks")


def least_between(x: dict, y: dict, config: Config) -> list[float | None]:
    """Least weighted distance of two blocks, that of two faces, least body and least face distance; in stretches of bounded size."""
    found = np.full(4, np.inf)
    for i in range(0, len(x["body"]), STEP):
        a = {c: v[i : i + STEP] for c, v in x.items()}
        for j in range(0, len(y["body"]), WIDE):
            b = {c: v[j : j + WIDE] for c, v in y.items()}
            d, body, face = (np.nan_to_num(v, nan=1.0) for v in weighted_block(a, b, config.face_weight_across))
            both = a["has_face"][:, None] & b["has_face"][None]
            found = np.minimum(found, [d.min(), d[both].min(initial=np.inf), body.min(), face[both].min(initial=np.inf)])
    return [None if np.isinf(v) else v for v in found]


def between(asked: DataFrame, own: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(a, b, distance, faced, body, face) for each distinct (a, b) of asked: least weighted distance over all pairs of
    tracklets, over those with two faces (else null), least body and least face distance; what is no number counts as 1.

    own: blocks(). A group is a pair of blocks, each of which is sent once to it, reduced where it stands.
    """
    known = own.select("cluster", "part")
    side = lambda s: known.select(F.col("cluster").alias(s), F.col("part").alias(f"part_{s}"))
    cells = stored(asked.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").select("a", "part_a", "b", "part_b"), "cells")
    ends = F.array(*(F.struct(F.col(s).alias("cluster"), F.col(f"part_{s}").alias("part"), F.lit(s).alias("side")) for s in ("a", "b")))
    sent = cells.select("*", F.explode(ends).alias("x")).select("a", "part_a", "b", "part_b", "x.*").join(own, ["cluster", "part"])
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), *((c, pa.float64()) for c in ("distance", "faced", "body", "face"))])

    def ready(block: pa.Scalar) -> dict:
        x = unpacked(block.as_buffer())
        return {"body": units(x["body"]), "face": units(x["face"]), "has_face": x["has_face"].astype(bool)}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        at = dict(zip(table["side"].to_pylist(), table["block"], strict=True))
        found = least_between(ready(at["a"]), ready(at["b"]), config)
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip((key[0].as_py(), key[2].as_py(), *found), schema, strict=True)], schema=schema)

    got = sent.select("a", "part_a", "b", "part_b", "side", "block").groupBy("a", "part_a", "b", "part_b").applyInArrow(run, "a long, b long, distance double, faced double, body double, face double")
    least = lambda c: F.round(F.min(c), DIGITS).alias(c)
    return got.groupBy("a", "b").agg(least("distance"), least("faced"), least("body"), least("face"))


def first_pass(pairs: DataFrame) -> DataFrame:
    """(i, j), stored: pairs of clusters that aren't both with faces, taken by falling similarity, then i and j."""
    order = F.struct((-F.round("body_sim", DIGITS)).alias("s"), "i", "j").alias("order")
    return stored(locally_dominant(pairs.where(~(F.col("face_i") & F.col("face_j"))).select("i", "j", order)), "first_pass")


def _asked(events: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(i, j, a, b): events (i, j) with left's members of i and right's members of j."""
    side = lambda table, s, m: table.select(F.col("root").alias(s), F.col("cluster").alias(m))
    return events.select("i", "j").join(side(left, "i", "a"), "i").join(side(right, "j", "b"), "j").select("i", "j", "a", "b")


def _nearest(asked: DataFrame, own: DataFrame, config: Config) -> DataFrame:
    """(i, j, near, faced, body): the least distances of each event over the pairs (a, b) asked for it."""
    return asked.join(between(asked, own, config), ["a", "b"]).groupBy("i", "j").agg(F.min("distance").alias("near"), F.min("faced").alias("faced"), F.min("body").alias("body"))


def events(pairs: DataFrame, partners: DataFrame, own: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One event for each target j of pairs with two faces, stored: its nearest source i, ties to the smaller one.

    partners: what the first pass took. Columns: rank (order of the events), i, j, clips, threshold, distance, similar, near
    and body (least over all members of both), grown (whether either has a partner).
    """
    taken, locked = partners.select("j"), partners.select(F.col("i").alias("root"), F.lit(True).alias("locked"))
    open_ = pairs.where(F.col("face_i") & F.col("face_j")).join(taken, "j", "left_anti").join(taken.withColumnRenamed("j", "i"), "i", "left_anti")
    flag = lambda s: locked.select(F.col("root").alias(s), F.col("locked").alias(f"locked_{s}"))
    open_ = open_.join(flag("i"), "i", "left").join(flag("j"), "j", "left").where("locked_i IS NULL OR locked_j IS NULL")
    open_ = stored(open_.select("i", "j", "clip_i", "clip_j", "threshold", F.round("distance", DIGITS).alias("distance"), F.round("body_sim", DIGITS).alias("similar"), (F.col("locked_i").isNotNull() | F.col("locked_j").isNotNull()).alias("grown")), "open")
    members = members_of(open_, partners)
    seen = _nearest(_asked(open_.where("grown"), members, members), own, config)
    open_ = open_.join(seen.select("i", "j", F.coalesce("faced", "near").alias("again")), ["i", "j"], "left").withColumn("distance", F.coalesce("again", "distance")).drop("again")
    return ranked(open_.withColumn("first", F.col("i")), members, own, config)


def ranked(open_: DataFrame, members: DataFrame, own: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The event of each target, stored, from rows that hold its nearest source (by distance, then i) and, in `first`, its smallest one."""
    best = open_.groupBy("j").agg(F.min(F.struct("distance", "i", "clip_i", "clip_j", "threshold", "similar", "grown")).alias("e"), F.min("first").alias("first"))
    best = stored(best.select(F.struct(F.col("e.distance").alias("d"), "first", "j").alias("rank"), "e.*", "j"), "best")
    all_ = _nearest(_asked(best, members, members), own, config)
    return stored(best.join(all_.drop("faced"), ["i", "j"]), "events")


def members_of(pairs: DataFrame, partners: DataFrame) -> DataFrame:
    """(root, cluster), stored: each cluster of the pairs with itself and its partner."""
    own = pairs.select(F.explode(F.array("i", "j")).alias("root")).distinct()
    return stored(own.select("root", F.col("root").alias("cluster")).unionByName(partners.select(F.col("i").alias("root"), F.col("j").alias("cluster"))), "members")


def second_pass(pending: DataFrame, members: DataFrame, own: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(i, j), stored: the events that going through them by rank, one by one, accepts; see the module's docstring.

    An event is refused if one of its clusters was taken, if its source has claimed the target's clip or the target
    the source's, or by distance and similarity; a cluster that has grown is measured over all members.
    """
    accepted, rounds = None, 0
    while not pending.isEmpty():
        fits = F.when(F.col("grown"), (F.col("near") < F.col("threshold")) & (F.round(1 - F.col("body"), DIGITS) >= SIMILAR)).otherwise((F.col("distance") < F.col("threshold")) & (F.col("similar") >= SIMILAR))
        judged = pending.withColumn("fits", fits)
        touch = judged.select("rank", "fits", F.explode(F.array(F.struct(F.col("i").alias("own"), F.col("j").alias("other")), F.struct(F.col("j").alias("own"), F.col("i").alias("other")))).alias("x")).select("rank", "fits", "x.*")
        earliest = touch.groupBy(F.col("own").alias("other")).agg(F.min("rank").alias("before"))
        # a refused event may yet be accepted, if an earlier one can change its other cluster
        change = touch.join(earliest, "other").where(F.col("fits") | (F.col("before") < F.col("rank"))).groupBy("own").agg(F.min("rank").alias("change"))
        side = lambda s, change=change: change.select(F.col("own").alias(s), F.col("change").alias(f"change_{s}"))
        free = lambda s: F.col(f"change_{s}").isNull() | (F.col(f"change_{s}") >= F.col("rank"))
        judged = stored(judged.join(side("i"), "i", "left").join(side("j"), "j", "left").withColumn("decided", free("i") & free("j")).drop("change_i", "change_j"), "judged")
        new = judged.where("decided AND fits").select("i", "j", "clip_i", "clip_j")
        rest = judged.where("NOT decided").drop("decided", "fits")
        gone, claims = new.select("j"), new.select(F.col("i").alias("c"), F.explode(F.array("clip_i", "clip_j")).alias("clip")).distinct()
        rest = rest.join(gone, "j", "left_anti").join(gone.withColumnRenamed("j", "i"), "i", "left_anti")
        rest = rest.join(claims, (F.col("i") == F.col("c")) & (F.col("clip_j") == F.col("clip")), "left_anti").join(claims, (F.col("j") == F.col("c")) & (F.col("clip_i") == F.col("clip")), "left_anti")
        accepted = new.select("i", "j") if accepted is None else accepted.unionByName(new.select("i", "j"))
        rounds += 1
        if rounds % 16 == 0:
            accepted = stored(accepted, "accepted")  # so that the plan stays short
        added = new.select(F.col("i").alias("root"), F.col("j").alias("cluster"))
        every = members.unionByName(accepted.select(F.col("i").alias("root"), F.col("j").alias("cluster")))
        rest = stored(rest, "rest")
        asked = stored(_asked(rest, added, every).unionByName(_asked(rest, every, added)).distinct(), "asked")
        seen = _nearest(asked, own, config).select("i", "j", F.col("near").alias("near_now"), F.col("body").alias("body_now"))
        rest = rest.join(seen, ["i", "j"], "left").withColumns({"near": F.least("near", "near_now"), "body": F.least("body", "body_now"), "grown": F.col("grown") | F.col("near_now").isNotNull()})
        pending = stored(rest.drop("near_now", "body_now"), "pending")
    return accepted if accepted is not None else pending.select("i", "j")


def parents(pairs: DataFrame, tracks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(cluster, parent), stored, of the clusters that either pass gave to another one; pairs: stored candidates."""
    partners = first_pass(pairs)
    faced = pairs.where(F.col("face_i") & F.col("face_j"))
    wanted = faced.select(F.explode(F.array("i", "j")).alias("local_cluster")).unionByName(partners.select(F.explode(F.array("i", "j")).alias("local_cluster"))).distinct()
    own = blocks(tracks.withColumn("local_cluster", F.col("local_cluster").cast("long")).join(wanted, "local_cluster", "left_semi"))
    made = events(pairs, partners, own, config)
    return joined(partners, made, members_of(made, partners), own, config)


def joined(partners: DataFrame, made: DataFrame, members: DataFrame, own: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(cluster, parent), stored, from what the first pass took and the events of the second."""
    got = second_pass(made, members, own, config)
    up = stored(partners.unionByName(got).select(F.col("j").alias("cluster"), F.col("i").alias("parent")), "parents")
    while not config.one_level_parents:  # pointers are followed to the root, twice as far each round
        higher = up.select(F.col("cluster").alias("parent"), F.col("parent").alias("higher"))
        far = stored(up.join(higher, "parent", "left").select("cluster", F.coalesce("higher", "parent").alias("parent"), F.col("higher").isNotNull().alias("moved")), "parents")
        up = far.drop("moved")
        if far.where("moved").isEmpty():
            break
    return up
