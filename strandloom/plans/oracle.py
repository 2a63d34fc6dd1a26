"""The proxy views and vector expressions in DuckDB's SQL."""

from __future__ import annotations

DETECTIONS = """e AS (SELECT *, (props->>'$.k')::INT AS k FROM events),
det AS (
    SELECT event_id, ts, (user_id % 25)::INT AS clip_idx, user_id::INT AS track_id, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) // 60 AS frame_idx,
        floor(value)::INT AS x1, k AS y1, floor(value)::INT + 20 + k % 30 AS x2, k + 50 AS y2, 1920 AS frame_w, 1080 AS frame_h, event_type <> 'error' AS has_face, value, k
    FROM e
)"""


def tracklets(a: float, where: str = "") -> str:
    hot = f"list_transform({{0}}, lambda x, i: {a}::DOUBLE * x::DOUBLE + CASE WHEN i - 1 = label THEN 1::DOUBLE ELSE 0::DOUBLE END)"
    return f"""trk0 AS (
    SELECT vec_id AS track_id, (vec_id % 25)::INT AS clip_idx, (vec_id * 37 % 900)::INT AS start_frame, (vec_id * 37 % 900 + 20 + vec_id * 53 % 600)::INT AS end_frame, vec_id % 3 <> 0 AS has_face, label,
        {hot.format('embedding')} AS body,
        CASE WHEN vec_id % 6 = 0 THEN list_transform(embedding, lambda x: 0::DOUBLE) ELSE {hot.format('list_reverse(embedding)')} END AS face,
        (vec_id % 10)::DOUBLE / 10 AS quality, embedding
    FROM embeddings
),
trk AS (SELECT *, row_number() OVER (PARTITION BY clip_idx ORDER BY start_frame, track_id) AS ord FROM trk0 {where})"""


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


def norm(a: str) -> str:
    return f"sqrt(list_sum(list_transform({a}, lambda x: x * x)))"


def cosine(a: str, b: str) -> str:
    """Distance; null with a zero vector."""
    return f"(1 - {dot(a, b)} / nullif({norm(a)} * {norm(b)}, 0))"


#: Tracklets with a local cluster, lc; the fixed one of clip and label.
LABELLED = f"lt AS (SELECT *, clip_idx * 100 + label AS lc, {norm('body')} AS nb, {norm('face')} AS nf FROM trk)"

#: From lt the pairs of clusters of unlike clips with their distance, similarity and threshold.
CANDIDATES = f"""ab AS (SELECT lc, bool_or(has_face) AS face, sum(end_frame - start_frame) AS len, min(clip_idx) AS clip FROM lt GROUP BY lc),
cx AS (SELECT lc, (end_frame - start_frame)::DOUBLE AS w, unnest(body) AS v, generate_subscripts(body, 1) AS pos FROM lt),
mv AS (SELECT lc, pos, CASE WHEN sum(w) = 0 OR count(*) = 1 THEN avg(v) ELSE sum(w * v) / sum(w) END AS v FROM cx GROUP BY lc, pos),
me AS (SELECT lc, list(v ORDER BY pos) AS vec FROM mv GROUP BY lc),
mn AS (SELECT *, {norm('vec')} AS n FROM me),
cp AS (SELECT a.lc AS i, b.lc AS j, 1 - {dot('a.body', 'b.body')} / (a.nb * b.nb) AS bd, CASE WHEN a.has_face AND b.has_face THEN 1 - {dot('a.face', 'b.face')} / nullif(a.nf * b.nf, 0) END AS fd FROM lt a JOIN lt b ON a.lc < b.lc AND a.clip_idx <> b.clip_idx),
cq AS (SELECT i, j, min(CASE WHEN fd < 1 THEN 0.55::DOUBLE * bd + 0.45::DOUBLE * fd ELSE bd END) AS distance FROM cp GROUP BY i, j),
cc AS (SELECT cq.*, A.face AS fi, B.face AS fj, A.clip AS ci, B.clip AS cj, (A.len + B.len) / 2.0::DOUBLE AS len, {dot('m1.vec', 'm2.vec')} / (m1.n * m2.n) AS body_sim FROM cq JOIN ab A ON A.lc = i JOIN ab B ON B.lc = j JOIN mn m1 ON m1.lc = i JOIN mn m2 ON m2.lc = j),
ct AS (SELECT *, CASE WHEN fi AND fj AND len > 500 THEN 0.44::DOUBLE WHEN fi AND fj AND len > 300 THEN 0.46::DOUBLE WHEN len > 250 THEN CASE WHEN fi <> fj THEN 0.41::DOUBLE ELSE 0.49::DOUBLE END ELSE CASE WHEN fi <> fj THEN 0.43::DOUBLE ELSE 0.51::DOUBLE END END AS threshold FROM cc)"""

OVERLAP = "greatest(0, least(a.end_frame, b.end_frame) - greatest(a.start_frame, b.start_frame))"
RATIO = f"coalesce({OVERLAP}::DOUBLE / nullif(least(a.end_frame - a.start_frame, b.end_frame - b.start_frame), 0), 0)"

_GROUP = {"shoplifting": (0, 2), "weapon": (3, 9), "urgent": (10, 13), "normal": (14, 17)}

SCORES = f"""e AS (SELECT *, (props->>'$.k')::INT AS k, user_id % 64 AS u FROM events),
fs AS (
    SELECT event_id, ts, u::INT AS clip_id, k % 5 AS people, list_transform(range(0, 18), lambda i: ((event_id * (i + 7)) % 23)::DOUBLE / 20
        + CASE WHEN i = [0, 3, 10, 14][u % 4 + 1] THEN (2 + (u // 4) % 4)::DOUBLE ELSE 0 END
        + CASE WHEN u >= 32 AND i = [3, 0, 0, 10][u % 4 + 1] THEN 3.5::DOUBLE ELSE 0 END) AS logits
    FROM e
),
sm0 AS (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS ex FROM fs),
sm AS (SELECT *, list_transform(ex, lambda x: x / list_sum(ex)) AS p FROM sm0),
scored AS (
    SELECT event_id, ts, clip_id, people, {', '.join(f'list_max(p[{a + 1}:{b + 1}]) AS {n}' for n, (a, b) in _GROUP.items())}, list_position(p, list_max(p))::INT - 1 AS label_idx
    FROM sm
)"""

WEAPONS = """w0 AS (
    SELECT event_id, ts, (user_id % 64)::INT AS clip_id, CASE WHEN (props->>'$.k')::INT % 2 = 0 THEN 'pistol' ELSE 'rifle' END AS type, (props->>'$.k')::INT / 100::DOUBLE AS confidence,
        (event_id * 13 % 40) / 100::DOUBLE AS g, (event_id * 29 % 40) / 100::DOUBLE AS p
    FROM events WHERE event_type = 'error' AND (user_id % 64) % 3 = 0
),
w1 AS (
    SELECT *, CASE WHEN g > p + 0.25::DOUBLE THEN 0.9::DOUBLE WHEN g > p + 0.15::DOUBLE AND confidence > 0.5::DOUBLE THEN 0.7::DOUBLE WHEN g > p + 0.05::DOUBLE AND confidence > 0.65::DOUBLE THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END AS validation_score
    FROM w0 WHERE confidence > 0.35::DOUBLE
),
wv AS (SELECT *, validation_score > 0.5::DOUBLE AS valid, (confidence + validation_score) / 2 AS combined_score FROM w1)"""

HITS = """pos AS (SELECT clip_id, ts, event_id, row_number() OVER (PARTITION BY clip_id ORDER BY ts, event_id) AS place FROM (SELECT (user_id % 64)::INT AS clip_id, ts, event_id FROM events)),
hit AS (SELECT pos.*, place - lag(place) OVER (PARTITION BY pos.clip_id ORDER BY place) AS gap FROM pos WHERE event_id IN (SELECT event_id FROM wv WHERE valid)),
cons AS (SELECT clip_id, count(*) AS hit_frames, coalesce(bool_or(gap <= 3), false) AS consistent FROM hit GROUP BY clip_id)"""

DECIDED = f"""{SCORES}, {WEAPONS}, {HITS},
agg AS (
    SELECT clip_id, avg(shoplifting) AS s, max(shoplifting) AS smax, avg(weapon) AS w, max(weapon) AS wmax, avg(urgent) AS u, max(urgent) AS umax, avg(normal) AS n, avg(people) AS people
    FROM scored GROUP BY clip_id
),
ws AS (SELECT clip_id, count(*) AS weapons, avg(combined_score) AS cm, max(combined_score) AS cx FROM wv WHERE valid GROUP BY clip_id),
j AS (SELECT agg.*, CASE WHEN consistent THEN coalesce(weapons, 0) ELSE 0 END AS c, coalesce(cm, 0) AS cm, coalesce(cx, 0) AS cx FROM agg LEFT JOIN ws USING (clip_id) LEFT JOIN cons USING (clip_id)),
d AS (
    SELECT clip_id, CASE
        WHEN s > 0.5::DOUBLE AND smax > 0.7::DOUBLE THEN {{'c': 'SHOPLIFTING', 'f': s}}
        WHEN c > 0 AND (cm > 0.7::DOUBLE OR cx > 0.8::DOUBLE) THEN {{'c': 'GUN', 'f': 0.95::DOUBLE}}
        WHEN c > 0 AND (cm > 0.5::DOUBLE OR cx > 0.6::DOUBLE) THEN CASE WHEN people > 3 AND c < 5 THEN {{'c': 'NO_CRIME', 'f': n}} ELSE {{'c': 'GUN', 'f': 0.90::DOUBLE}} END
        WHEN c >= 3 THEN {{'c': 'GUN', 'f': 0.85::DOUBLE}}
        WHEN c > 0 THEN {{'c': 'NO_CRIME', 'f': n}}
        WHEN u > 0.4::DOUBLE OR umax > 0.65::DOUBLE THEN CASE WHEN s > 0.3::DOUBLE THEN {{'c': 'SHOPLIFTING', 'f': (u + s) / 2}} WHEN w > 0.2::DOUBLE THEN {{'c': 'GUN', 'f': (u + w) / 2}} ELSE {{'c': 'NO_CRIME', 'f': n}} END
        WHEN w > 0.6::DOUBLE OR wmax > 0.8::DOUBLE THEN {{'c': 'GUN', 'f': w}}
        ELSE {{'c': 'NO_CRIME', 'f': n}} END AS d
    FROM j
),
lab AS (SELECT clip_id, CASE WHEN d.c IN ('SHOPLIFTING', 'GUN') THEN 'crime' ELSE 'normal' END AS label, d.c AS category, d.f AS confidence FROM d)"""
