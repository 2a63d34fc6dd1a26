"""DuckDB's SQL for the operators whose decisions depend on those before: a recursive step for each row of a clip."""

from __future__ import annotations

from . import oracle as O

SMOOTHED = f"""WITH RECURSIVE {O.tracklets(0.45)},
s AS (SELECT clip_idx, track_id, body, row_number() OVER (PARTITION BY clip_idx ORDER BY track_id) AS n FROM trk),
r AS (
    SELECT clip_idx, track_id, n, body AS vec FROM s WHERE n = 1
    UNION ALL
    SELECT clip_idx, track_id, n, list_transform(m, lambda x: x / (size + 1e-8)) AS vec
    FROM (SELECT *, {O.norm('m')} AS size FROM (SELECT s.clip_idx, s.track_id, s.n, list_transform(list_zip(s.body, r.vec), lambda p: p[1] / 3::DOUBLE + p[2] * (1 - 1 / 3::DOUBLE)) AS m FROM r JOIN s ON s.clip_idx = r.clip_idx AND s.n = r.n + 1))
)
SELECT clip_idx, track_id, pos::INT AS pos, round(value, 6) + 0 AS value FROM (SELECT clip_idx, track_id, generate_subscripts(vec, 1) - 1 AS pos, unnest(vec) AS value FROM r)"""

FRAGMENTS = f"""WITH RECURSIVE {O.tracklets(0.45)}, u AS (SELECT *, {O.norm('body')} + 1e-8 AS n FROM trk),
e AS (
    SELECT a.clip_idx, list({{'i': a.ord, 'j': b.ord}}) AS e FROM u a JOIN u b ON a.clip_idx = b.clip_idx AND a.ord < b.ord
    WHERE b.start_frame - a.end_frame BETWEEN 1 AND 120 AND {O.RATIO} <= 0.5 AND {O.dot('a.body', 'b.body')} / (a.n * b.n) > 0.8::DOUBLE GROUP BY a.clip_idx
),
c AS (SELECT t.clip_idx, t.rows, coalesce(e.e, []) AS e FROM (SELECT clip_idx, list(ord ORDER BY ord) AS rows FROM trk GROUP BY clip_idx) t LEFT JOIN e USING (clip_idx)),
r AS (
    SELECT clip_idx, 1::BIGINT AS seed, 1::BIGINT AS tail, [1::BIGINT] AS used, [1::BIGINT] AS owner FROM c
    UNION ALL
    SELECT clip_idx, coalesce(CASE WHEN later IS NOT NULL THEN seed END, fresh) AS seed, coalesce(later, fresh) AS tail, list_append(used, coalesce(later, fresh)) AS used,
        list_append(owner, CASE WHEN later IS NOT NULL THEN seed ELSE fresh END) AS owner
    FROM (
        SELECT r.*, list_min(list_filter(list_transform(list_filter(c.e, lambda x: x.i = r.tail), lambda x: x.j), lambda x: NOT list_contains(r.used, x))) AS later, list_min(list_filter(c.rows, lambda x: NOT list_contains(r.used, x))) AS fresh
        FROM r JOIN c USING (clip_idx) WHERE len(r.used) < len(c.rows)
    )
),
d AS (SELECT clip_idx, unnest(used) AS ord, unnest(owner) AS seed FROM r JOIN c USING (clip_idx) WHERE len(used) = len(rows)),
m AS (SELECT d.clip_idx, f.track_id AS fragment, t.start_frame, t.end_frame FROM d JOIN trk t ON t.clip_idx = d.clip_idx AND t.ord = d.ord JOIN trk f ON f.clip_idx = d.clip_idx AND f.ord = d.seed)
SELECT clip_idx, fragment, count(*) AS members, min(start_frame) AS start_frame, max(end_frame) AS end_frame FROM m GROUP BY clip_idx, fragment"""

_NUMBERED = """n AS (SELECT clip_idx, list_max(own) + 1 AS n FROM z),
b AS (SELECT clip_idx, coalesce(sum(n) OVER (ORDER BY clip_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n),
y AS (SELECT clip_idx, generate_subscripts(own, 1) AS ord, unnest(own) AS own FROM z)
SELECT clip_idx, track_id, (before + own)::BIGINT AS {name} FROM y JOIN b USING (clip_idx) JOIN trk USING (clip_idx, ord)"""

LINKAGE = f"""WITH RECURSIVE {O.tracklets(0.45)},
u AS (SELECT clip_idx, ord, list_transform(body, lambda x: x / n) AS x FROM (SELECT *, {O.norm('body')} AS n FROM trk)),
r AS (
    SELECT clip_idx, ord AS i, [{{'s': x, 'n': 1}}] AS cl, [0::BIGINT] AS own FROM u WHERE ord = 1
    UNION ALL
    SELECT clip_idx, i, CASE WHEN near < 0.3::DOUBLE THEN list_transform(cl, lambda c, k: CASE WHEN k = best THEN {{'s': list_transform(list_zip(c.s, x), lambda p: p[1] + p[2]), 'n': c.n + 1}} ELSE c END) ELSE list_append(cl, {{'s': x, 'n': 1}}) END AS cl,
        list_append(own, CASE WHEN near < 0.3::DOUBLE THEN best - 1 ELSE len(cl) END) AS own
    FROM (
        SELECT *, list_min(ms) AS near, list_position(ms, list_min(ms)) AS best
        FROM (SELECT r.clip_idx, u.ord AS i, r.cl, r.own, u.x, list_transform(r.cl, lambda c: 1 - {O.dot('c.s', 'u.x')} / c.n) AS ms FROM r JOIN u ON u.clip_idx = r.clip_idx AND u.ord = r.i + 1)
    )
),
z AS (SELECT clip_idx, arg_max(own, i) AS own FROM r GROUP BY clip_idx),
{_NUMBERED.format(name='cluster')}"""

_OVER = O.OVERLAP
_GREEDY = f"""l AS (SELECT *, end_frame - start_frame AS len, {O.norm('body')} AS nb, {O.norm('face')} AS nf FROM trk),
p0 AS (
    SELECT a.clip_idx, b.ord AS i, a.ord AS j, {O.dot('a.body', 'b.body')} / (a.nb * b.nb) AS sim, {O.dot('a.face', 'b.face')} / nullif(a.nf * b.nf, 0) AS fsim, {O.RATIO} AS o, {_OVER} AS ov, least(a.len, b.len) AS short,
        CASE WHEN least(a.len, b.len) > 0 THEN greatest(a.len, b.len)::DOUBLE / least(a.len, b.len) ELSE 'inf'::DOUBLE END AS lr, a.has_face AND b.has_face AS ff
    FROM l a JOIN l b ON a.clip_idx = b.clip_idx AND a.ord < b.ord
),
p1 AS (
    SELECT *, short > 0 AND ov >= short AS within, CASE WHEN o > 0.1::DOUBLE THEN 0.03::DOUBLE ELSE 0 END AS more,
        CASE WHEN ff THEN CASE WHEN o > 0.1::DOUBLE THEN 0.82::DOUBLE ELSE 0.85::DOUBLE END ELSE CASE WHEN o > 0.4::DOUBLE THEN 0.8::DOUBLE ELSE 0.87::DOUBLE END END AS need1,
        CASE WHEN o > 0.9::DOUBLE THEN 0.86::DOUBLE WHEN o > 0.4::DOUBLE THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END AS need2
    FROM p0
),
p AS (
    SELECT clip_idx, i, list({{'mean': 0.6::DOUBLE * (1 - sim) + 0.4::DOUBLE * (1 - fsim), 'sim': sim, 'apart': ov <= 0.5::DOUBLE * short,
        'first': CASE WHEN lr >= 2 THEN CASE WHEN more > 0 OR ff THEN need1 + more ELSE 0.9::DOUBLE END ELSE need1 END + CASE WHEN within THEN 0.05::DOUBLE ELSE 0 END,
        'each': greatest(need2, CASE WHEN NOT ff OR (o = 0 AND lr >= 2) THEN 0.8::DOUBLE ELSE 0 END, CASE WHEN ff AND o <= 0.1::DOUBLE THEN 0.85::DOUBLE ELSE 0 END) + CASE WHEN within THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN o > 0 AND lr >= 2 THEN 0.03::DOUBLE ELSE 0 END
    }} ORDER BY j) AS p FROM p1 GROUP BY clip_idx, i
),
r AS (
    SELECT clip_idx, 1::BIGINT AS i, [[1::BIGINT]] AS cl, [0::BIGINT] AS own FROM trk WHERE ord = 1
    UNION ALL
    SELECT clip_idx, i, CASE WHEN fits THEN list_transform(cl, lambda m, k: CASE WHEN k = best THEN list_append(m, i) ELSE m END) ELSE list_append(cl, [i]) END AS cl, list_append(own, CASE WHEN fits THEN best - 1 ELSE len(cl) END) AS own
    FROM (
        SELECT *, coalesce(near IS NOT NULL AND p[cl[best][1]].sim >= p[cl[best][1]].first AND len(list_filter(cl[best], lambda j: p[j].sim < p[j].each)) = 0, false) AS fits
        FROM (
            SELECT *, list_min(ms) AS near, list_position(ms, list_min(ms)) AS best
            FROM (SELECT r.clip_idx, q.i, r.cl, r.own, q.p, list_transform(r.cl, lambda m: CASE WHEN q.p[m[1]].apart AND len(list_filter(m, lambda j: q.p[j].mean IS NULL)) = 0 THEN list_avg(list_transform(m, lambda j: q.p[j].mean)) END) AS ms FROM r JOIN p q ON q.clip_idx = r.clip_idx AND q.i = r.i + 1)
        )
    )
),
z AS (SELECT clip_idx, arg_max(own, i) AS own FROM r GROUP BY clip_idx),
{_NUMBERED.format(name='local_cluster')}"""
GREEDY = f"WITH RECURSIVE {O.tracklets(0.45)},\n{_GREEDY}"

REPRESENTATIVES = f"""WITH RECURSIVE {O.tracklets(0.45)},
o AS (SELECT clip_idx, track_id, quality, list_transform(body, lambda x: x / (n + 1e-8)) AS x, row_number() OVER (PARTITION BY clip_idx ORDER BY track_id) AS p, row_number() OVER (PARTITION BY clip_idx ORDER BY quality DESC, track_id) AS q, count(*) OVER (PARTITION BY clip_idx) AS size FROM (SELECT *, {O.norm('body')} AS n FROM trk)),
d AS (SELECT a.clip_idx, a.p, list(1 - {O.dot('a.x', 'b.x')} ORDER BY b.p) AS d FROM o a JOIN o b USING (clip_idx) GROUP BY a.clip_idx, a.p),
c AS (SELECT clip_idx, max(size) AS size, greatest(5, floor(0.3 * max(size))::BIGINT) AS best, list(p ORDER BY p) FILTER (q > greatest(5, floor(0.3 * size)::BIGINT)) AS rest, list(d ORDER BY p) AS d FROM o JOIN d USING (clip_idx, p) GROUP BY clip_idx),
r AS (
    SELECT clip_idx, [rest[1]] AS picked FROM c WHERE size > 15 AND best < 15 AND len(rest) > 0
    UNION ALL
    SELECT clip_idx, list_append(picked, rest[list_position(near, list_max(near))]) AS picked
    FROM (
        SELECT *, list_transform(rest, lambda x: list_min(list_transform(picked, lambda y: d[x][y]))) AS near
        FROM (SELECT r.clip_idx, r.picked, c.d, list_filter(c.rest, lambda x: NOT list_contains(r.picked, x)) AS rest FROM r JOIN c USING (clip_idx) WHERE c.best + len(r.picked) < 15 AND len(r.picked) < len(c.rest))
    )
),
z AS (SELECT clip_idx, arg_max(picked, len(picked)) AS picked FROM r GROUP BY clip_idx)
SELECT o.clip_idx, track_id FROM o JOIN c USING (clip_idx) LEFT JOIN z USING (clip_idx) WHERE o.size <= 15 OR q <= best OR list_contains(coalesce(picked, []), p)"""


_MATCHED = f"""{O.CANDIDATES},
cand AS (SELECT i::BIGINT AS i, j::BIGINT AS j, round(distance, 12) AS d, round(body_sim, 12) AS s, threshold AS th, fi AND fj AS ff, ci, cj FROM ct WHERE distance < threshold AND body_sim >= CASE WHEN fi <> fj THEN 0.65::DOUBLE ELSE 0.7::DOUBLE END),
e1 AS (SELECT i, j, row_number() OVER (ORDER BY s DESC, i, j) AS k FROM cand WHERE NOT ff),
g1 AS (
    SELECT 0::BIGINT AS k, []::BIGINT[] AS locked
    UNION ALL
    SELECT e1.k, CASE WHEN list_contains(locked, i) OR list_contains(locked, j) THEN locked ELSE list_concat(locked, [i, j]) END AS locked FROM g1 JOIN e1 ON e1.k = g1.k + 1
),
pa AS (SELECT locked[2 * n - 1] AS i, locked[2 * n] AS j FROM (SELECT locked, unnest(range(1, len(locked) // 2 + 1)) AS n FROM (SELECT arg_max(locked, k) AS locked FROM g1))),
cl AS (SELECT c, row_number() OVER (ORDER BY c) AS p FROM (SELECT i AS c FROM cand UNION SELECT j FROM cand)),
mem AS (SELECT root, list(p) AS m FROM (SELECT c AS root, c FROM cl UNION SELECT i, j FROM pa) JOIN cl USING (c) GROUP BY root),
dp AS (
    SELECT x.p AS x, y.p AS y, a.has_face AND b.has_face AS faced, coalesce(1 - {O.dot('a.body', 'b.body')} / nullif(a.nb * b.nb, 0), 1) AS bd, CASE WHEN a.has_face AND b.has_face THEN 1 - {O.dot('a.face', 'b.face')} / nullif(a.nf * b.nf, 0) END AS fd
    FROM lt a JOIN cl x ON a.lc = x.c, lt b JOIN cl y ON b.lc = y.c
),
dm AS (
    SELECT list(r ORDER BY x) AS m FROM (SELECT x, list({{'w': w, 'f': f, 'b': b}} ORDER BY y) AS r FROM (SELECT x, y, round(min(d), 12) AS w, round(min(d) FILTER (faced), 12) AS f, round(min(bd), 12) AS b FROM (SELECT *, CASE WHEN fd < 1 THEN 0.55::DOUBLE * bd + 0.45::DOUBLE * fd ELSE bd END AS d FROM dp) GROUP BY x, y) GROUP BY x)
),
op AS (
    SELECT c.*, mi.m AS mi, mj.m AS mj, len(mi.m) + len(mj.m) > 2 AS grown FROM cand c JOIN mem mi ON mi.root = c.i JOIN mem mj ON mj.root = c.j
    WHERE ff AND c.i NOT IN (SELECT j FROM pa) AND c.j NOT IN (SELECT j FROM pa) AND NOT (len(mi.m) > 1 AND len(mj.m) > 1)
),
os AS (
    SELECT op.*, CASE WHEN grown THEN coalesce(list_min(list_transform(near, lambda z: z.f)), list_min(list_transform(near, lambda z: z.w))) ELSE d END AS again
    FROM (SELECT op.*, flatten(list_transform(mi, lambda a: list_transform(mj, lambda b: dm.m[a][b]))) AS near FROM op, dm) op
),
ev AS (SELECT *, row_number() OVER (ORDER BY again, first, j) AS k FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY again, i) AS place, min(i) OVER (PARTITION BY j) AS first FROM os) WHERE place = 1),
g2 AS (
    SELECT 0::BIGINT AS k, []::STRUCT(i BIGINT, j BIGINT, p BIGINT)[] AS acc, []::VARCHAR[] AS claims
    UNION ALL
    SELECT k, CASE WHEN ok THEN list_append(acc, {{'i': i, 'j': j, 'p': p}}) ELSE acc END AS acc, CASE WHEN ok THEN list_concat(claims, [i || ':' || ci, i || ':' || cj]) ELSE claims END AS claims
    FROM (
        SELECT *, CASE WHEN len(ai) + len(aj) > 2 THEN list_min(list_transform(near, lambda z: z.w)) < th AND round(1 - list_min(list_transform(near, lambda z: z.b)), 12) >= 0.7::DOUBLE ELSE again < th AND s >= 0.7::DOUBLE END
            AND len(list_filter(acc, lambda z: z.j = i OR z.j = j)) = 0 AND NOT list_contains(claims, i || ':' || cj) AND NOT list_contains(claims, j || ':' || ci) AS ok
        FROM (
            SELECT *, flatten(list_transform(ai, lambda a: list_transform(aj, lambda b: m[a][b]))) AS near
            FROM (
                SELECT ev.* EXCLUDE (near, k), ev.k, cl.p, g2.acc, g2.claims, dm.m, list_concat(ev.mi, list_transform(list_filter(g2.acc, lambda z: z.i = ev.i), lambda z: z.p)) AS ai, list_concat(ev.mj, list_transform(list_filter(g2.acc, lambda z: z.i = ev.j), lambda z: z.p)) AS aj
                FROM g2 JOIN ev ON ev.k = g2.k + 1 JOIN cl ON cl.c = ev.j, dm
            )
        )
    )
),
up AS (SELECT i, j FROM pa UNION ALL SELECT a.i, a.j FROM (SELECT unnest(acc) AS a FROM (SELECT arg_max(acc, k) AS acc FROM g2))),
fin AS (SELECT every.lc::BIGINT AS local_cluster, coalesce(up.i, every.lc)::BIGINT AS final_id FROM (SELECT DISTINCT lc FROM lt) every LEFT JOIN up ON up.j = every.lc)"""

MATCHES = f"WITH RECURSIVE {O.tracklets(0.8)}, {O.LABELLED}, {_MATCHED} SELECT local_cluster, final_id FROM fin"

CATALOGUE = f"""WITH RECURSIVE {O.tracklets(0.45, 'WHERE end_frame - start_frame >= 30')},
loc AS (WITH RECURSIVE {_GREEDY}),
lt AS (SELECT trk.*, loc.local_cluster AS lc, {O.norm('trk.body')} AS nb, {O.norm('trk.face')} AS nf FROM trk JOIN loc USING (clip_idx, track_id)),
{_MATCHED},
gid AS (SELECT local_cluster, dense_rank() OVER (ORDER BY final_id) - 1 AS gid FROM fin),
cat AS (SELECT lt.*, gid.gid FROM lt JOIN gid ON gid.local_cluster = lt.lc),
sp AS (SELECT gid, clip_idx, lc, row_number() OVER (PARTITION BY gid, clip_idx ORDER BY sum(end_frame - start_frame) DESC, lc DESC) AS place FROM cat GROUP BY gid, clip_idx, lc),
fr AS (SELECT gid, clip_idx, lc, (SELECT max(gid) FROM cat) + row_number() OVER (ORDER BY gid, clip_idx, place) AS fresh FROM sp WHERE place > 1)
SELECT coalesce(fresh, cat.gid)::BIGINT AS global_id, cat.clip_idx, track_id, start_frame, end_frame FROM cat LEFT JOIN fr USING (gid, clip_idx, lc)"""
