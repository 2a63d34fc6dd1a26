"""The operators over the proxy views, a query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import weighted_concat
from ..operators import cluster, distance, encoders, export, features, match, overlap, scene, spatial
from ..sources import proxies
from ..sources.tables import stored
from ..streaming import drain
from ..streaming import tracks as streams
from . import folds
from . import oracle as O
from .registry import query

NEAR, FAR = 0.45, 0.80


def _r(*names: str):
    """Doubles as they are compared: to 6 places, without a negative zero."""
    return [(F.round(n, 6) + 0.0).alias(n) for n in names]


def _tracks(spark: SparkSession, sf_dir: str, a: float = NEAR) -> DataFrame:
    return proxies.ordered(proxies.tracklets(spark, sf_dir, a))


def _labelled(spark: SparkSession, sf_dir: str, a: float = FAR) -> DataFrame:
    """Tracklets with a fixed local cluster: clip and label."""
    return proxies.tracklets(spark, sf_dir, a).withColumn("local_cluster", (F.col("clip_idx") * 100 + F.col("label")).cast("long"))


# --- scans, projections, filters ---------------------------------------------------------------------------------


@query("WITH " + O.DETECTIONS + " SELECT event_id, clip_idx, track_id, frame_idx FROM det WHERE x2 > x1 AND y2 > y1 AND track_id IS NOT NULL AND frame_idx % 30 = 0")
def frame_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.sampled(features.valid(proxies.detections(spark, sf_dir))).select("event_id", "clip_idx", "track_id", F.col("frame_idx").cast("long").alias("frame_idx"))


@query(
    "WITH " + O.DETECTIONS + " SELECT event_id, round((x2 - x1) * (y2 - y1) / (frame_w * frame_h)::DOUBLE, 9) AS bbox_size, round((y1 + y2) / (2 * frame_h)::DOUBLE, 9) AS v_pos, round((x1 + x2) / (2 * frame_w)::DOUBLE, 9) AS h_pos FROM det"
)
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.with_box(proxies.detections(spark, sf_dir)).select("event_id", *(F.round(c, 9).alias(c) for c in ("bbox_size", "v_pos", "h_pos")))


@query(
    "WITH " + O.DETECTIONS + ", c AS (SELECT *, (x1 + x2) / 2.0::DOUBLE AS cx, (y1 + y2) / 2.0::DOUBLE AS cy FROM det), m AS (SELECT event_id, (cx - lag(cx) OVER w) / frame_w AS dx, (cy - lag(cy) OVER w) / frame_h AS dy FROM c WINDOW w AS (PARTITION BY clip_idx, track_id ORDER BY ts, event_id))"
    " SELECT event_id, round(coalesce(sqrt(dx * dx + dy * dy), 0), 6) AS movement FROM m"
)
def displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.with_movement(proxies.detections(spark, sf_dir)).select("event_id", *_r("movement"))


@query("WITH " + O.DETECTIONS + " SELECT clip_idx, track_id, count(*) AS num_detections, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame FROM det GROUP BY clip_idx, track_id HAVING count(*) >= 3")
def track_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.long_tracks(proxies.detections(spark, sf_dir)).select("clip_idx", "track_id", "num_detections", F.col("start_frame").cast("long"), F.col("end_frame").cast("long"))


@query(
    "WITH " + O.DETECTIONS + " SELECT event_id, round(0.6::DOUBLE * has_face::INT + 0.3::DOUBLE * CASE WHEN k % 2 = 0 THEN 0.8::DOUBLE ELSE 0 END + 0.1::DOUBLE * 0.7::DOUBLE, 6) AS quality FROM det"
)
def frame_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = features.quality(F.col("has_face"), F.when(F.col("k") % 2 == 0, 0.8).otherwise(0.0), F.lit(0.7))
    return proxies.detections(spark, sf_dir).select("event_id", F.round(q, 6).alias("quality"))


@query(
    f"""WITH {O.tracklets(NEAR)}, v AS (SELECT track_id, CASE WHEN has_face THEN list_concat(list_transform(body, lambda x: x * 0.7::DOUBLE), list_transform(face, lambda x: x * 0.3::DOUBLE)) ELSE body END AS vec FROM trk)
SELECT track_id, pos::INT AS pos, round(value, 6) + 0 AS value FROM (SELECT track_id, generate_subscripts(vec, 1) - 1 AS pos, unnest(vec) AS value FROM v)"""
)
def combined_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body and face in one vector by their weights; the body alone without a face."""
    t = proxies.tracklets(spark, sf_dir, NEAR)
    return _exploded(t.select("track_id", weighted_concat(F.col("body"), F.when(F.col("has_face"), F.col("face"))).alias("vec")), "track_id")


@query("SELECT page_id, split_part(url, '/', -1) AS name, 'clip' || page_id || '_crime_validated.json' AS file FROM pages")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base names of paths, and the names of a clip's result file, over the urls of the pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", export.base_name(F.col("url")).alias("name"), export.scene_file(F.col("page_id")).alias("file"))


@query(f"WITH {O.tracklets(NEAR)} SELECT track_id, clip_idx, start_frame, end_frame FROM trk WHERE end_frame - start_frame >= 30")
def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.long_enough(_tracks(spark, sf_dir)).select("track_id", "clip_idx", "start_frame", "end_frame")


_RUNS = """, o AS (SELECT *, row_number() OVER (PARTITION BY clip_idx, track_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY clip_idx, track_id, has_face ORDER BY ts, event_id) AS island FROM det),
r AS (SELECT clip_idx, track_id, has_face, count(*) AS run FROM o GROUP BY clip_idx, track_id, has_face, island),
runs AS (SELECT clip_idx, track_id, coalesce(max(run) FILTER (has_face), 0) AS longest_run, coalesce(sum(run) FILTER (has_face), 0)::BIGINT AS face_frames, sum(run)::BIGINT AS num_frames FROM r GROUP BY clip_idx, track_id)"""


@query("WITH " + O.DETECTIONS + _RUNS + " SELECT *, longest_run >= 15 AS has_face FROM runs")
def longest_face_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.face_runs(proxies.detections(spark, sf_dir))


@query(
    "WITH " + O.DETECTIONS + _RUNS + " SELECT clip_idx, track_id, CASE WHEN track_id % 4 = 0 THEN longest_run >= 15 WHEN track_id % 4 = 1 THEN face_frames >= 15 WHEN track_id % 4 = 2 THEN face_frames::DOUBLE / num_frames * num_frames >= 15 ELSE longest_run >= 15 END AS has_face FROM runs"
)
def effective_face_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By track number, the run, the count and the ratio are unknown in turn, so that each rule decides some tracks."""
    r, k = features.face_runs(proxies.detections(spark, sf_dir)), F.col("track_id") % 4
    known = features.effective_face(F.when(k == 0, F.col("longest_run")), F.when(k <= 1, F.col("face_frames")), F.when(k <= 2, F.col("face_frames") / F.col("num_frames")), F.col("num_frames"), F.col("has_face"))
    return r.select("clip_idx", "track_id", known.alias("has_face"))


# --- aggregates and sequences ------------------------------------------------------------------------------------

_MOTION = """, c AS (SELECT *, (x1 + x2) / 2.0::DOUBLE AS cx, (y1 + y2) / 2.0::DOUBLE AS cy FROM det),
m AS (SELECT *, (cx - lag(cx) OVER w) / frame_w AS dx, (cy - lag(cy) OVER w) / frame_h AS dy FROM c WINDOW w AS (PARTITION BY clip_idx, track_id ORDER BY ts, event_id)),
v AS (SELECT clip_idx, track_id, coalesce(sqrt(dx * dx + dy * dy), 0) AS mv, (x2 - x1) * (y2 - y1) / (frame_w * frame_h)::DOUBLE AS size, (y1 + y2) / (2 * frame_h)::DOUBLE AS vp, (x1 + x2) / (2 * frame_w)::DOUBLE AS hp FROM m),
a AS (SELECT clip_idx, track_id, avg(mv) AS a1, stddev_pop(mv) AS a2, avg(size) AS a3, avg(vp) AS a4, avg(hp) AS a5 FROM v GROUP BY clip_idx, track_id HAVING count(*) >= 3),
l AS (SELECT *, sqrt(a1 * a1 + a2 * a2 + a3 * a3 + a4 * a4 + a5 * a5) + 1e-8 AS n FROM a)
SELECT clip_idx, track_id, round(a1 / n, 6) AS mv_mean, round(a2 / n, 6) AS mv_std, round(a3 / n, 6) AS size_mean, round(a4 / n, 6) AS v_mean, round(a5 / n, 6) AS h_mean FROM l"""


@query("WITH " + O.DETECTIONS + _MOTION)
def motion_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.motion_vector(proxies.detections(spark, sf_dir)).select("clip_idx", "track_id", *_r("mv_mean", "mv_std", "size_mean", "v_mean", "h_mean"))


def _exploded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("vec").alias("pos", "value")).select(*keys, "pos", *_r("value"))


@query(
    f"""WITH {O.tracklets(NEAR)}, x AS (SELECT clip_idx, exp(3 * quality) AS w, unnest(body) AS v, generate_subscripts(body, 1) - 1 AS pos FROM trk),
g AS (SELECT clip_idx, pos, count(*) AS n, CASE WHEN count(*) = 1 THEN avg(v) ELSE sum(w * v) / (sum(w) + 1e-8) END AS v FROM x GROUP BY clip_idx, pos),
l AS (SELECT *, CASE WHEN n = 1 THEN 1 ELSE sqrt(sum(v * v) OVER (PARTITION BY clip_idx)) + 1e-8 END AS s FROM g)
SELECT clip_idx, pos::INT AS pos, round(v / s, 6) + 0 AS value FROM l"""
)
def softmax_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(features.softmax_mean(_tracks(spark, sf_dir), ["clip_idx"], "body", "quality"), "clip_idx")


@query(
    f"""WITH {O.tracklets(FAR)}, x AS (SELECT clip_idx * 100 + label AS local_cluster, (end_frame - start_frame)::DOUBLE AS w, unnest(body) AS v, generate_subscripts(body, 1) - 1 AS pos FROM trk)
SELECT local_cluster::BIGINT AS local_cluster, pos::INT AS pos, round(CASE WHEN sum(w) = 0 OR count(*) = 1 THEN avg(v) ELSE sum(w * v) / sum(w) END, 6) + 0 AS value FROM x GROUP BY local_cluster, pos"""
)
def length_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(features.length_mean(_labelled(spark, sf_dir), ["local_cluster"], "body"), "local_cluster")


@query(
    "WITH " + O.DETECTIONS + ", s AS (SELECT clip_idx, track_id, list(value ORDER BY ts, event_id) AS v FROM det GROUP BY clip_idx, track_id)"
    " SELECT clip_idx, track_id, len(v) AS n, round(list_reduce(v, lambda a, x: (1 - 1 / 3::DOUBLE) * a + x / 3::DOUBLE), 6) AS ema FROM s"
)
def ema_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.ema_last(proxies.detections(spark, sf_dir), ["clip_idx", "track_id"], "at", "value").select("clip_idx", "track_id", "n", *_r("ema"))


@query(
    f"""WITH {O.tracklets(NEAR)}, g AS (SELECT clip_idx, label, min(start_frame) AS start_frame, max(end_frame) AS end_frame, bool_or(has_face) AS has_face, count(*) AS members FROM trk GROUP BY clip_idx, label),
x AS (SELECT clip_idx, label, has_face, unnest(body) AS b, unnest(face) AS f, generate_subscripts(body, 1) AS pos FROM trk),
m AS (SELECT clip_idx, label, pos, avg(b) AS b, count(*) AS n, coalesce(avg(f) FILTER (has_face), 0) AS f FROM x GROUP BY clip_idx, label, pos),
s AS (SELECT clip_idx, label, CASE WHEN max(n) = 1 THEN sum(b) ELSE sum(b) / (sqrt(sum(b * b)) + 1e-8) END AS body_sum, sum(f) AS face_sum FROM m GROUP BY clip_idx, label)
SELECT clip_idx, label, start_frame, end_frame, has_face, members, round(body_sum, 6) AS body_sum, round(face_sum, 6) + 0 AS face_sum FROM g JOIN s USING (clip_idx, label)"""
)
def merged_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster.merged(proxies.tracklets(spark, sf_dir, NEAR), ["clip_idx", "label"])
    add = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6) + 0.0
    return out.select("clip_idx", "label", "start_frame", "end_frame", "has_face", "members", add("body").alias("body_sum"), add("face").alias("face_sum"))


# --- overlap -----------------------------------------------------------------------------------------------------

_SWEEP = """, st AS (SELECT clip_idx, start_frame AS f, 1 AS d FROM trk UNION ALL SELECT clip_idx, end_frame + 1, -1 FROM trk),
sf AS (SELECT clip_idx, f, sum(d) AS d FROM st GROUP BY clip_idx, f),
sw AS (SELECT clip_idx, sum(d) OVER (PARTITION BY clip_idx ORDER BY f) AS c FROM sf),
mx AS (SELECT clip_idx, max(c)::BIGINT AS max_simultaneous FROM sw GROUP BY clip_idx)"""


@query(f"WITH {O.tracklets(NEAR)}{_SWEEP} SELECT * FROM mx")
def max_simultaneous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.max_simultaneous(_tracks(spark, sf_dir))


@query(
    f"""WITH {O.tracklets(NEAR)}{_SWEEP},
pd AS (SELECT a.clip_idx, avg({O.cosine('a.body', 'b.body')}) AS d FROM trk a JOIN trk b ON a.clip_idx = b.clip_idx AND a.ord < b.ord GROUP BY a.clip_idx),
g AS (SELECT clip_idx, count(*) AS n, avg((end_frame - start_frame)::DOUBLE) AS mean_length, avg(has_face::INT) AS face_rate FROM trk GROUP BY clip_idx),
j AS (SELECT g.*, max_simultaneous AS m, d FROM g JOIN mx USING (clip_idx) LEFT JOIN pd USING (clip_idx)),
s AS (
    SELECT *, CASE WHEN n <= 3 THEN 0 WHEN n <= 10 THEN 0.02::DOUBLE ELSE 0.04::DOUBLE END AS crowding, CASE WHEN mean_length > 300 THEN 0 WHEN mean_length > 100 THEN 0.01::DOUBLE ELSE 0.03::DOUBLE END AS tracking,
        CASE WHEN face_rate > 0.7::DOUBLE THEN 0 WHEN face_rate > 0.4::DOUBLE THEN 0.01::DOUBLE ELSE 0.02::DOUBLE END AS faces,
        CASE WHEN n = 2 THEN -0.2::DOUBLE WHEN n <= 8 THEN CASE WHEN d > 0.32::DOUBLE THEN -0.2::DOUBLE WHEN d > 0.18::DOUBLE THEN -0.18::DOUBLE ELSE -0.15::DOUBLE END
            WHEN n > 15 THEN CASE WHEN d > 0.5::DOUBLE THEN -0.05::DOUBLE WHEN d > 0.4::DOUBLE THEN -0.02::DOUBLE WHEN d > 0.35::DOUBLE THEN 0 ELSE 0.02::DOUBLE END
            ELSE CASE WHEN d > 0.5::DOUBLE THEN -0.12::DOUBLE WHEN d > 0.4::DOUBLE THEN -0.1::DOUBLE WHEN d > 0.35::DOUBLE THEN -0.08::DOUBLE ELSE -0.05::DOUBLE END END AS diversity
    FROM j
)
SELECT clip_idx, n, m AS max_simultaneous, round(mean_length, 6) AS mean_length, round(face_rate, 6) AS face_rate, round(d, 6) AS mean_distance, round(crowding + tracking + faces + diversity, 6) AS scores,
    round(greatest(0.01::DOUBLE, least(0.25::DOUBLE, CASE WHEN m >= 5 THEN CASE WHEN n > 6 THEN 0.24::DOUBLE ELSE 0.08::DOUBLE END WHEN m = 4 THEN CASE WHEN n > 8 THEN 0.12::DOUBLE ELSE 0.1::DOUBLE END WHEN m = 3 THEN 0.12::DOUBLE WHEN m = 2 THEN 0.15::DOUBLE ELSE 0.08::DOUBLE + crowding + tracking + faces + diversity END)), 6) AS target
FROM s"""
)
def clip_characteristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = overlap.clip_characteristics(_tracks(spark, sf_dir)).withColumn("scores", F.col("crowding") + F.col("tracking") + F.col("faces") + F.col("diversity"))
    return c.select("clip_idx", "n", "max_simultaneous", *_r("mean_length", "face_rate", "mean_distance", "scores", "target"))


@query(
    f"WITH {O.tracklets(NEAR)} SELECT a.clip_idx, a.track_id AS i, b.track_id AS j, {O.OVERLAP} AS overlap, round({O.RATIO}, 6) AS ratio FROM trk a JOIN trk b ON a.clip_idx = b.clip_idx AND a.ord < b.ord WHERE {O.OVERLAP} > 0"
)
def temporal_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlapping_pairs(_tracks(spark, sf_dir), 6)


_UNIT = lambda x: f"list_transform({x}, lambda v: v / ({O.norm(x)} + 1e-8))"


@query(
    f"""WITH {O.tracklets(NEAR)}, u AS (SELECT *, {O.norm('body')} + 1e-8 AS n FROM trk),
p AS (SELECT a.clip_idx, a.track_id AS i, b.track_id AS j, b.start_frame - a.end_frame AS gap, {O.dot('a.body', 'b.body')} / (a.n * b.n) AS similarity FROM u a JOIN u b ON a.clip_idx = b.clip_idx AND a.ord < b.ord WHERE b.start_frame - a.end_frame BETWEEN 1 AND 120 AND {O.RATIO} <= 0.5)
SELECT clip_idx, i, j, gap, round(similarity, 6) AS similarity FROM p WHERE similarity > 0.8::DOUBLE"""
)
def fragment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.fragment_edges(_tracks(spark, sf_dir)).select("clip_idx", "i", "j", "gap", *_r("similarity"))


# --- distances ---------------------------------------------------------------------------------------------------

_BOTH = "a.has_face AND b.has_face AND fd < 1"


@query(
    f"""WITH {O.tracklets(FAR)}, l AS (SELECT *, {O.norm('body')} AS nb, {O.norm('face')} AS nf FROM trk WHERE end_frame - start_frame >= 30),
p AS (SELECT a.clip_idx AS ca, b.clip_idx AS cb, 1 - {O.dot('a.body', 'b.body')} / nullif(a.nb * b.nb, 0) AS bd, CASE WHEN a.has_face AND b.has_face THEN 1 - {O.dot('a.face', 'b.face')} / nullif(a.nf * b.nf, 0) END AS fd FROM l a JOIN l b ON a.track_id < b.track_id AND a.clip_idx <> b.clip_idx)
SELECT least(ca, cb)::BIGINT AS clip_i, greatest(ca, cb)::BIGINT AS clip_j, round(min(CASE WHEN fd < 1 THEN 0.55::DOUBLE * bd + 0.45::DOUBLE * fd ELSE bd END), 6) AS best_distance FROM p GROUP BY ALL"""
)
def best_cross_clip_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = overlap.long_enough(proxies.tracklets(spark, sf_dir, FAR))
    out = distance.best_between(tracks, "track_id", "clip_idx", similarity=False)
    return out.select(F.col("i").alias("clip_i"), F.col("j").alias("clip_j"), F.round("distance", 6).alias("best_distance"))


@query(
    f"""WITH {O.tracklets(NEAR)}, l AS (SELECT *, list_transform(embedding[1:16], lambda x: x::DOUBLE) AS pose, list_transform(embedding[49:64], lambda x: x::DOUBLE) AS motion FROM trk),
p AS (SELECT a.clip_idx, a.track_id AS i, b.track_id AS j, a.has_face AND b.has_face AS ff, {O.cosine('a.body', 'b.body')} AS bd, {O.cosine('a.face', 'b.face')} AS fd, 0.1::DOUBLE * {O.cosine('a.pose', 'b.pose')} + 0.1::DOUBLE * {O.cosine('a.motion', 'b.motion')} AS rest FROM l a JOIN l b ON a.clip_idx = b.clip_idx AND a.ord < b.ord)
SELECT clip_idx, i, j, round(CASE WHEN ff THEN 0.6::DOUBLE * bd + 0.2::DOUBLE * fd + rest ELSE 0.8::DOUBLE * bd + rest END, 6) AS distance FROM p"""
)
def hybrid_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = lambda at: F.transform(F.slice("embedding", at, 16), lambda x: x.cast("double"))
    tracks = proxies.ordered(proxies.tracklets(spark, sf_dir, NEAR, "embedding").withColumns({"pose": raw(1), "motion": raw(49)}).drop("embedding"))
    return distance.hybrid(tracks, 6)


_NEAREST = f"""l AS (SELECT *, {O.norm('body')} AS n FROM trk),
p AS (SELECT a.track_id, a.clip_idx AS g, b.clip_idx AS o, min(1 - {O.dot('a.body', 'b.body')} / (a.n * b.n)) AS d FROM l a JOIN l b ON a.clip_idx <> b.clip_idx GROUP BY ALL)"""


@query(f"WITH {O.tracklets(FAR)}, {_NEAREST}, q AS (SELECT g, o, avg(d) AS d FROM p GROUP BY g, o) SELECT least(g, o)::BIGINT AS clip_i, greatest(g, o)::BIGINT AS clip_j, round(avg(d), 6) AS distance FROM q GROUP BY ALL")
def chamfer_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distance.chamfer(proxies.tracklets(spark, sf_dir, FAR), "track_id", "clip_idx").select(F.col("i").alias("clip_i"), F.col("j").alias("clip_j"), *_r("distance"))


@query(
    "WITH " + O.DETECTIONS + """, c AS (SELECT DISTINCT clip_idx, (x1 + x2) / 2.0::DOUBLE AS x, (y1 + y2) / 2.0::DOUBLE AS y FROM det),
p AS (SELECT a.clip_idx AS g, a.x, a.y, b.clip_idx AS o, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM c a JOIN c b ON a.clip_idx <> b.clip_idx GROUP BY ALL),
q AS (SELECT g, o, max(d) AS d FROM p GROUP BY g, o)
SELECT least(g, o)::BIGINT AS clip_i, greatest(g, o)::BIGINT AS clip_j, round(max(d), 6) AS distance FROM q GROUP BY ALL"""
)
def hausdorff_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between clips, over the distinct box centres of each."""
    d = proxies.detections(spark, sf_dir)
    centres = d.select("clip_idx", ((F.col("x1") + F.col("x2")) / 2.0).alias("x"), ((F.col("y1") + F.col("y2")) / 2.0).alias("y")).distinct()
    rows = centres.select(F.xxhash64("clip_idx", "x", "y").alias("key"), "clip_idx", F.array("x", "y").alias("at"))
    return spatial.hausdorff(rows, "key", "clip_idx", "at").select(F.col("i").alias("clip_i"), F.col("j").alias("clip_j"), *_r("distance"))


@query(
    f"""WITH {O.tracklets(FAR)}, l AS (SELECT track_id, body, {O.norm('body')} AS n FROM trk),
p AS (SELECT a.track_id AS i, b.track_id AS j, round(1 - {O.dot('a.body', 'b.body')} / (a.n * b.n), 9) AS d FROM l a JOIN l b ON a.track_id <> b.track_id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM p) WHERE r <= 5),
m AS (SELECT a.i, a.j, a.d FROM k a JOIN k b ON a.i = b.j AND a.j = b.i),
s AS (SELECT i, list(j) AS s FROM m GROUP BY i),
x AS (SELECT m.i, m.j, m.d, len(list_intersect(a.s, b.s)) AS n_both, len(list_distinct(list_concat(a.s, b.s))) AS n_any FROM m JOIN s a ON a.i = m.i JOIN s b ON b.i = m.j WHERE m.i < m.j)
SELECT i, j, round(1 - n_both / n_any::DOUBLE, 6) AS jaccard, round(0.5::DOUBLE * (1 - n_both / n_any::DOUBLE) + 0.5::DOUBLE * d, 6) AS distance FROM x"""
)
def k_reciprocal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distance.k_reciprocal(proxies.tracklets(spark, sf_dir, FAR), "track_id", 5).select("i", "j", *_r("jaccard", "distance"))


# --- scenes ------------------------------------------------------------------------------------------------------


@query(
    f"WITH {O.SCORES} SELECT event_id, clip_id, round(shoplifting, 6) AS shoplifting, round(weapon, 6) AS weapon, round(urgent, 6) AS urgent, round(normal, 6) AS normal, label_idx, CASE WHEN label_idx <= 2 THEN 'shoplifting' WHEN label_idx <= 9 THEN 'weapon' WHEN label_idx <= 13 THEN 'urgent' ELSE 'normal' END AS category FROM scored"
)
def scene_softmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.label_scores(proxies.frame_scores(spark, sf_dir)).select("event_id", "clip_id", *_r("shoplifting", "weapon", "urgent", "normal"), "label_idx", "category")


@query(f"WITH {O.WEAPONS} SELECT event_id, clip_id, valid, validation_score, round(combined_score, 6) AS combined_score FROM wv")
def gun_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.validated(proxies.weapon_detections(spark, sf_dir)).select("event_id", "clip_id", "valid", "validation_score", *_r("combined_score"))


@query(f"WITH {O.WEAPONS}, {O.HITS} SELECT * FROM cons")
def temporal_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = scene.validated(proxies.weapon_detections(spark, sf_dir)).where("valid")
    return scene.consistency(proxies.frame_scores(spark, sf_dir), valid)


@query(
    f"WITH {O.WEAPONS} SELECT clip_id, count(*) AS weapons, round(avg(combined_score), 6) AS combined_mean, round(max(combined_score), 6) AS combined_max, round(avg(validation_score), 6) AS validation_mean, count(DISTINCT type) AS types FROM wv WHERE valid GROUP BY clip_id"
)
def weapon_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.weapon_summary(scene.validated(proxies.weapon_detections(spark, sf_dir))).select("clip_id", "weapons", *_r("combined_mean", "combined_max", "validation_mean"), "types")


@query(
    f"WITH {O.SCORES} SELECT clip_id, count(*) AS frames, {', '.join(f'round({f}({x}), 6) AS {x}_{n}' for x in ('shoplifting', 'weapon', 'urgent') for n, f in (('mean', 'avg'), ('max', 'max')))}, round(avg(normal), 6) AS normal_mean, round(avg(people), 6) AS people_mean, max(people) AS people_max FROM scored GROUP BY clip_id"
)
def clip_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scene.clip_scores(scene.label_scores(proxies.frame_scores(spark, sf_dir)))
    return out.select("clip_id", "frames", *_r(*(f"{x}_{n}" for x in ("shoplifting", "weapon", "urgent") for n in ("mean", "max")), "normal_mean", "people_mean"), "people_max")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.scene_labels(proxies.frame_scores(spark, sf_dir), proxies.weapon_detections(spark, sf_dir))


@query(f"WITH {O.DECIDED} SELECT clip_id, label, category, round(confidence, 6) AS confidence FROM lab")
def scene_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select("clip_id", "label", "category", *_r("confidence"))


@query(
    f"WITH {O.DECIDED} SELECT count(*) AS clips, count_if(label = 'crime')::BIGINT AS crime, count_if(label = 'normal')::BIGINT AS normal, count_if(category = 'SHOPLIFTING')::BIGINT AS shoplifting, count_if(category = 'GUN')::BIGINT AS gun, round(avg(confidence) FILTER (label = 'crime'), 6) AS crime_confidence, round(avg(confidence) FILTER (label = 'normal'), 6) AS normal_confidence FROM lab"
)
def batch_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.batch_statistics(_labels(spark, sf_dir)).select("clips", "crime", "normal", "shoplifting", "gun", *_r("crime_confidence", "normal_confidence"))


# --- ids and exports ---------------------------------------------------------------------------------------------


def _catalogued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracklets whose id is their label, spread out so that compaction has work."""
    t = proxies.tracklets(spark, sf_dir, FAR).withColumn("id", (F.col("label") * 7 + 3).cast("long"))
    return match.compacted(t.select("id", "clip_idx", "track_id", "start_frame", "end_frame"), "id")


_CATALOGUE = f"WITH {O.tracklets(FAR)}, cat AS (SELECT dense_rank() OVER (ORDER BY label * 7 + 3) - 1 AS global_id, clip_idx, track_id, start_frame, end_frame FROM trk)"


@query(f"{_CATALOGUE} SELECT global_id, clip_idx, start_frame, end_frame FROM cat")
def catalogue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalogued(spark, sf_dir).select("global_id", "clip_idx", "start_frame", "end_frame")


@query(f"WITH {O.tracklets(FAR)}, i AS (SELECT DISTINCT (clip_idx * 100 + label)::BIGINT AS local_cluster FROM trk) SELECT local_cluster, dense_rank() OVER (ORDER BY local_cluster) - 1 AS global_id FROM i")
def id_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.compacted(_labelled(spark, sf_dir).select("local_cluster").distinct(), "local_cluster")


@query(
    f"{_CATALOGUE} SELECT 'global_id_' || global_id AS name, count(DISTINCT clip_idx) AS clips, string_agg(clip_idx || ':' || start_frame || '-' || end_frame, ',' ORDER BY clip_idx, start_frame, end_frame) AS appearances FROM cat GROUP BY global_id"
)
def identity_appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.array_join(F.transform("appearances", lambda x: F.concat(x["clip_idx"].cast("string"), F.lit(":"), x["start_frame"].cast("string"), F.lit("-"), x["end_frame"].cast("string"))), ",")
    return export.identities(_catalogued(spark, sf_dir)).select("name", "clips", text.alias("appearances"))


def _mapping(detections: DataFrame) -> DataFrame:
    """Ids of tracks, two for each of which the later holds; every fifth track has none."""
    tracks = detections.select("clip_idx", "track_id").distinct().where("track_id % 5 <> 4")
    return tracks.select("clip_idx", "track_id", F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.lit(99).alias("global_id")), F.struct(F.lit(1).alias("ord"), (F.col("track_id") % 17).alias("global_id")))).alias("m")).select("clip_idx", "track_id", "m.ord", "m.global_id")


@query(
    "WITH " + O.DETECTIONS + " SELECT event_id, clip_idx, frame_idx, track_id % 17 AS global_id, (track_id % 17) % 15 AS colour, 'ID: ' || (track_id % 17) AS label, x1, y1, x2, y2 FROM det WHERE track_id % 5 <> 4"
)
def frame_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = proxies.detections(spark, sf_dir)
    return export.overlay(d, _mapping(d)).select("event_id", "clip_idx", F.col("frame_idx").cast("long").alias("frame_idx"), "global_id", "colour", "label", "x1", "y1", "x2", "y2")


@query(
    "WITH " + O.DETECTIONS + ", b AS (SELECT clip_idx, frame_idx, track_id % 17 AS g FROM det WHERE track_id % 5 <> 4), f AS (SELECT clip_idx, g, min(frame_idx) AS frame_idx FROM b GROUP BY clip_idx, g), d AS (SELECT DISTINCT clip_idx, frame_idx FROM b)"
    " SELECT d.clip_idx, d.frame_idx, (SELECT count(*) FROM f WHERE f.clip_idx = d.clip_idx AND f.frame_idx <= d.frame_idx) AS seen FROM d"
)
def legend_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = proxies.detections(spark, sf_dir)
    return export.legend_sizes(export.overlay(d, _mapping(d))).select("clip_idx", F.col("frame_idx").cast("long").alias("frame_idx"), "seen")


@query(f"WITH {O.tracklets(FAR)} SELECT track_id, CASE WHEN track_id % 2 = 0 THEN label ELSE label + 100 END AS global_id FROM trk")
def filled_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = proxies.tracklets(spark, sf_dir, FAR).select("clip_idx", "track_id", F.when(F.col("track_id") % 2 == 0, F.col("label")).alias("global_id"), "label")
    mapping = t.select("clip_idx", "track_id", (F.col("label") + 100).alias("global_id"), F.lit(1).alias("ord"))
    return export.filled_ids(t, mapping).select("track_id", "global_id")


_CANDIDATES = f"{O.tracklets(FAR)}, {O.LABELLED}, {O.CANDIDATES}"


@query(f"WITH {_CANDIDATES} SELECT i::BIGINT AS i, j::BIGINT AS j, round(distance, 6) AS distance, round(body_sim, 6) AS body_sim, threshold FROM ct WHERE distance < threshold AND body_sim >= CASE WHEN fi <> fj THEN 0.65::DOUBLE ELSE 0.7::DOUBLE END")
def stage2_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.candidates(_labelled(spark, sf_dir)).select("i", "j", *_r("distance", "body_sim"), "threshold")


@query(f"WITH {_CANDIDATES} SELECT i::BIGINT AS i, j::BIGINT AS j FROM ct WHERE distance < threshold AND body_sim >= CASE WHEN fi <> fj THEN 0.65::DOUBLE ELSE 0.7::DOUBLE END AND NOT (i % 3 = 0 AND (j // 100) % 4 = 0)")
def unclaimed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates without those whose target, every third, has claimed every fourth clip."""
    pairs = stored(match.candidates(_labelled(spark, sf_dir)), "candidates")
    claims = pairs.where("i % 3 = 0 AND clip_j % 4 = 0").select(F.col("i").alias("target"), F.col("clip_j").alias("clip")).distinct()
    return match.unclaimed(pairs, claims).select("i", "j")


@query(
    f"""WITH {O.tracklets(FAR)}, s AS (SELECT label::BIGINT AS global_id, clip_idx, (track_id % 3)::BIGINT AS local_cluster, sum(end_frame - start_frame)::BIGINT AS length FROM trk GROUP BY ALL)
SELECT global_id, clip_idx, local_cluster, length FROM (SELECT *, row_number() OVER (PARTITION BY global_id, clip_idx ORDER BY length DESC, local_cluster DESC) AS place FROM s) WHERE place = 1"""
)
def duplicate_repair_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = proxies.tracklets(spark, sf_dir, FAR).withColumns({"global_id": F.col("label").cast("long"), "local_cluster": F.col("track_id") % 3})
    return match.repair_order(t).where("place = 1").select("global_id", "clip_idx", "local_cluster", "length")


@query(
    f"""WITH {O.tracklets(FAR)}, s AS (SELECT label::BIGINT AS global_id, clip_idx, (track_id % 3)::BIGINT AS local_cluster, sum(end_frame - start_frame) AS length FROM trk GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY global_id, clip_idx ORDER BY length DESC, local_cluster DESC) AS place FROM s),
n AS (SELECT *, (SELECT max(global_id) FROM s) + row_number() OVER (ORDER BY global_id, clip_idx, place) AS fresh FROM p WHERE place > 1)
SELECT track_id, coalesce(fresh, label)::BIGINT AS global_id FROM trk LEFT JOIN n ON n.global_id = label AND n.clip_idx = trk.clip_idx AND n.local_cluster = track_id % 3"""
)
def duplicate_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = proxies.tracklets(spark, sf_dir, FAR).withColumns({"global_id": F.col("label").cast("long"), "local_cluster": F.col("track_id") % 3})
    return match.repaired(t).select("track_id", "global_id")


# --- rows of the sinks, sequences of tracks and frames ---------------------------------------------------------------


@query("WITH " + O.DETECTIONS + " SELECT clip_idx, CASE WHEN clip_idx % 2 = 0 THEN 25::DOUBLE ELSE 30::DOUBLE END AS fps, max(frame_idx) + 1 AS frame_count, 1920 AS width, 1080 AS height FROM det GROUP BY clip_idx")
def clip_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proxies.clips(spark, sf_dir)


@query("WITH " + O.DETECTIONS + " SELECT event_id, round(frame_idx / CASE WHEN clip_idx % 2 = 0 THEN 25::DOUBLE ELSE 30::DOUBLE END, 6) AS seconds FROM det")
def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.timed(proxies.detections(spark, sf_dir), proxies.clips(spark, sf_dir)).select("event_id", *_r("seconds"))


def _listed(column: str, *fields: str):
    """An array of structs as text: fields by dots, elements by commas."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws(".", *(x[f].cast("string") for f in fields))), ",")


@query(
    "WITH " + O.DETECTIONS + " SELECT clip_idx, track_id, string_agg(frame_idx, ',' ORDER BY ts, event_id) AS frames, string_agg(x1 || '.' || y1 || '.' || x2 || '.' || y2, ',' ORDER BY ts, event_id) AS boxes FROM det GROUP BY clip_idx, track_id"
)
def track_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = features.track_lists(proxies.detections(spark, sf_dir))
    return t.select("clip_idx", "track_id", F.array_join(F.col("frames").cast("array<string>"), ",").alias("frames"), _listed("bboxes", "x1", "y1", "x2", "y2").alias("boxes"))


@query(
    "WITH " + O.DETECTIONS + ", o AS (SELECT *, row_number() OVER (PARTITION BY clip_idx, track_id ORDER BY ts, event_id) AS nth FROM det)"
    " SELECT clip_idx, track_id % 3 AS part, string_agg(frame_idx, ',' ORDER BY frame_idx, track_id, nth) AS frames, string_agg(x1 || '.' || y2, ',' ORDER BY frame_idx, track_id, nth) AS boxes FROM o GROUP BY ALL"
)
def merged_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = features.track_lists(proxies.detections(spark, sf_dir)).withColumn("part", F.col("track_id") % 3)
    out = cluster.merged_frames(t, ["clip_idx", "part"])
    return out.select("clip_idx", "part", F.array_join(F.col("frames").cast("array<string>"), ",").alias("frames"), _listed("bboxes", "x1", "y2").alias("boxes"))


@query(
    "WITH " + O.DETECTIONS + " SELECT clip_idx, frame_idx, string_agg((track_id % 17) || '.' || x1 || '.' || y1 || '.' || x2 || '.' || y2, ',' ORDER BY track_id % 17, x1, y1, x2, y2) AS boxes FROM det WHERE track_id % 5 <> 4 GROUP BY clip_idx, frame_idx"
)
def frame_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = proxies.detections(spark, sf_dir)
    out = export.frame_boxes(export.overlay(d, _mapping(d)))
    return out.select("clip_idx", F.col("frame_idx").cast("long").alias("frame_idx"), _listed("boxes", "global_id", "x1", "y1", "x2", "y2").alias("boxes"))


@query(
    f"""WITH {O.tracklets(NEAR)}, x AS (SELECT clip_idx, unnest(embedding[1:16])::DOUBLE AS v, generate_subscripts(embedding[1:16], 1) - 1 AS pos FROM trk),
g AS (SELECT clip_idx, pos, avg(v) AS v, count(*) AS n FROM x GROUP BY clip_idx, pos)
SELECT clip_idx, pos::INT AS pos, round(v / CASE WHEN n = 1 THEN 1 ELSE sqrt(sum(v * v) OVER (PARTITION BY clip_idx)) + 1e-8 END, 6) + 0 AS value FROM g"""
)
def mean_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select((F.col("vec_id") % proxies.CLIPS).cast("int").alias("clip_idx"), F.slice("embedding", 1, 16).cast("array<double>").alias("pose"))
    return _exploded(features.mean_pose(raw, ["clip_idx"]), "clip_idx")


@query(f"{_CATALOGUE} SELECT count(*) AS tracklets, count(DISTINCT global_id) AS identities FROM cat")
def catalogue_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.report(_catalogued(spark, sf_dir)).select("tracklets", "identities")


_BOXED = """b AS (SELECT w0.*, event_id * 7 % 700 - 50 AS bx, event_id * 11 % 560 - 50 AS by_ FROM w0 WHERE confidence > 0.35::DOUBLE),
k AS (SELECT *, greatest(bx, 0) AS x1, greatest(by_, 0) AS y1, least(bx + event_id % 90 - 5, 640) AS x2, least(by_ + 40, 480) AS y2 FROM b)"""


@query(
    f"WITH {O.WEAPONS}, {_BOXED} SELECT k.event_id, k.x1, k.y1, k.x2, k.y2, NOT (k.x2 <= k.x1 OR k.y2 <= k.y1) AND valid AS valid, CASE WHEN k.x2 <= k.x1 OR k.y2 <= k.y1 THEN 0 ELSE validation_score END::DOUBLE AS validation_score FROM k JOIN wv USING (event_id)"
)
def box_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.validated(proxies.weapon_boxes(spark, sf_dir)).select("event_id", "x1", "y1", "x2", "y2", "valid", "validation_score")


@query(f"WITH {O.DECIDED} SELECT clip_id, label, category, round(confidence, 3) AS confidence FROM lab")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.dataset_summary(_labels(spark, sf_dir))


@query(
    f"WITH {O.DECIDED} SELECT c::INT AS clip_id, CASE WHEN c % 23 = 5 THEN 'error' ELSE coalesce(label, 'normal') END AS label, CASE WHEN c % 23 = 5 THEN 'ERROR' ELSE coalesce(category, 'NO_CRIME') END AS category, round(CASE WHEN c % 23 = 5 THEN 0 ELSE coalesce(confidence, 0) END, 6)::DOUBLE AS confidence FROM range(0, 70) r(c) LEFT JOIN lab ON lab.clip_id = c"
)
def scene_every_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clips: six have no frames, some failed."""
    clips = spark.range(70).select(F.col("id").cast("int").alias("clip_id"), (F.col("id") % 23 == 5).alias("failed"))
    return scene.every_clip(_labels(spark, sf_dir), clips).select("clip_id", "label", "category", *_r("confidence"))


@query(
    f"""WITH {O.DECIDED}, v AS (SELECT clip_id, avg(validation_score) AS vm, count(DISTINCT type) AS types FROM wv WHERE valid GROUP BY clip_id), m AS (SELECT clip_id, count(*) AS frames, max(people) AS pmax FROM scored GROUP BY clip_id)
SELECT clip_id, lab.category, round(lab.confidence, 6) AS confidence, m.frames, round(j.s, 6) AS shoplifting, round(j.umax, 6) AS urgent_max, m.pmax AS people_max, j.c::BIGINT AS detections, coalesce(cons.hit_frames, 0) AS hit_frames, coalesce(cons.consistent, false) AS consistent, round(v.vm, 6) AS validation_mean, coalesce(v.types, 0) AS types
FROM lab JOIN j USING (clip_id) JOIN m USING (clip_id) LEFT JOIN v USING (clip_id) LEFT JOIN cons USING (clip_id)"""
)
def scene_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scene.results(proxies.frame_scores(spark, sf_dir), proxies.weapon_detections(spark, sf_dir))
    round_ = lambda c, name: (F.round(c, 6) + 0.0).alias(name)
    return r.select(
        "clip_id", "result.category", round_("result.confidence", "confidence"), "frames", round_("scores.shoplifting.mean", "shoplifting"), round_("scores.urgent.max", "urgent_max"), F.col("people.max").alias("people_max"),
        F.col("weapons.detections").cast("long").alias("detections"), "weapons.hit_frames", "weapons.consistent", round_("weapons.validation_mean", "validation_mean"), "weapons.types",
    )


# --- streams ------------------------------------------------------------------------------------------------------


@query("WITH s AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id) SELECT user_id, len(v) AS n, round(list_reduce(v, lambda a, x: (1 - 1 / 3::DOUBLE) * a + x / 3::DOUBLE), 6) AS ema FROM s")
def stream_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain.drained(streams.running_ema(drain.events_stream(spark, sf_dir)), ["user_id"]).select("user_id", "n", *_r("ema"))


@query("SELECT (epoch(date_trunc('hour', ts)))::BIGINT AS start, user_id % 25 AS clip_idx, count(*) AS rows, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drain.drained(streams.window_counts(drain.events_stream(spark, sf_dir)), ["start", "clip_idx"])
    return out.select(F.unix_timestamp("start").alias("start"), "clip_idx", "rows", *_r("mean_value"))


# --- order-dependent operators: recursive SQL where it goes; tests hold all against plain versions ------------------


@query(folds.FRAGMENTS)
def fragment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = stored(_tracks(spark, sf_dir), "tracks")
    return tracks.join(cluster.fragments(tracks), ["clip_idx", "track_id"]).groupBy("clip_idx", "fragment").agg(F.count("*").alias("members"), F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"))


@query(folds.GREEDY)
def stage1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.local_clusters(_tracks(spark, sf_dir))


@query(folds.LINKAGE)
def average_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.average_linkage(_tracks(spark, sf_dir), 0.3)


@query(folds.MATCHES)
def stage2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.matched(stored(_labelled(spark, sf_dir), "tracks"))


@query(folds.SMOOTHED)
def ema_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = proxies.tracklets(spark, sf_dir, NEAR).select("clip_idx", "track_id", "body")
    return _exploded(features.ema_vectors(tracks, ["clip_idx"], "track_id", "body"), "clip_idx", "track_id")


@query(folds.REPRESENTATIVES)
def representative_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.representatives(proxies.tracklets(spark, sf_dir, NEAR), ["clip_idx"], "track_id", "body", "quality")


@query(folds.CATALOGUE)
def global_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length filter, greedy clusters, both passes, compaction, repair."""
    tracks = stored(proxies.ordered(overlap.long_enough(proxies.tracklets(spark, sf_dir, NEAR))), "tracks")
    named = stored(tracks.join(cluster.local_clusters(tracks), ["clip_idx", "track_id"]), "named")
    return match.catalogue(named)


@query()
def encoded_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(encoders.encoded(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id"), "vec_id"), "vec_id")
