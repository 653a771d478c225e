"""SQL for the queries of `catalog`, written for a reader of SQL: common table expressions from the tables on."""

from __future__ import annotations

import math

SUMS = ("sx", "sy", "sz", "sxx", "syy", "szz", "sxy", "sxz", "syz")
MOMENTS = ", ".join(("n", *SUMS))
GROUPED = "count(*) AS n, sum(lx) AS sx, sum(ly) AS sy, sum(z) AS sz, sum(lx * lx) AS sxx, sum(ly * ly) AS syy, sum(z * z) AS szz, sum(lx * ly) AS sxy, sum(lx * z) AS sxz, sum(ly * z) AS syz"


def placed(shift: str = "0.0") -> str:
    """Points with their place in the map; shift: what is added to x of a pose. z follows the uncorrected place."""
    return f"""
  raw AS (SELECT l_orderkey % 40 AS kf_id, CAST((l_partkey * 37 + l_linenumber * 11 + l_orderkey * 101) % 512 - 256 AS DOUBLE) / 64.0 AS bx,
    CAST((l_suppkey * 53 + l_orderkey * 7 + l_linenumber * 29) % 512 - 256 AS DOUBLE) / 64.0 AS byy, l_quantity AS q FROM lineitem),
  turned AS (SELECT *, CASE kf_id % 4 WHEN 0 THEN bx WHEN 1 THEN -byy WHEN 2 THEN -bx ELSE byy END + CAST((kf_id % 8) AS DOUBLE) * 0.5 - 2.0 AS mx,
    CASE kf_id % 4 WHEN 0 THEN byy WHEN 1 THEN bx WHEN 2 THEN -byy ELSE -bx END + CAST(((kf_id * 3) % 8) AS DOUBLE) * 0.5 - 2.0 AS my FROM raw),
  pts AS (SELECT kf_id, bx, byy, mx + CAST({shift} AS DOUBLE) AS x, my AS y, floor(mx * 8) / 64.0 + CASE WHEN my > 1.5 THEN 0.5 ELSE 0.0 END + (q % 4) / 64.0 AS z FROM turned),
  binned AS (SELECT *, CAST(round(x / 0.25) AS INTEGER) AS ci, CAST(round(y / 0.25) AS INTEGER) AS cj, x - round(x / 0.25) * 0.25 AS lx, y - round(y / 0.25) * 0.25 AS ly FROM pts)"""


PLACED = placed()
CELLS = f"{PLACED},\n  cells AS (SELECT CAST(0 AS BIGINT) AS map_id, ci, cj, {GROUPED} FROM binned GROUP BY ci, cj)"
DISC = "offs AS (SELECT CAST(a AS INTEGER) AS di, CAST(b AS INTEGER) AS dj FROM range(-1, 2) t(a), range(-1, 2) u(b))"
VICINITY = f"""{CELLS},
  {DISC},
  sent AS (SELECT map_id, ci - di AS ci, cj - dj AS cj, di = 0 AND dj = 0 AS own, n, sx, sy, sz, sxx, syy, szz, sxy, sxz, syz, di * CAST(0.25 AS DOUBLE) AS dx, dj * CAST(0.25 AS DOUBLE) AS dy FROM cells, offs),
  moved AS (SELECT map_id, ci, cj, own, n, sx + n * dx AS sx, sy + n * dy AS sy, sz, sxx + 2 * sx * dx + n * dx * dx AS sxx, syy + 2 * sy * dy + n * dy * dy AS syy, szz,
    sxy + sx * dy + sy * dx + n * dx * dy AS sxy, sxz + sz * dx AS sxz, syz + sz * dy AS syz FROM sent),
  vic AS (SELECT map_id, ci, cj, max(CASE WHEN own THEN n END) AS own_n, max(CASE WHEN own THEN sz END) AS own_sz, count(*) AS n_cells, min(n) AS least_n, CAST(sum(n) AS BIGINT) AS n, {", ".join(f"sum({c}) AS {c}" for c in SUMS)}
    FROM moved GROUP BY map_id, ci, cj HAVING max(CASE WHEN own THEN 1 ELSE 0 END) = 1)"""
FIT = f"""{VICINITY},
  cov AS (SELECT *, sx / n AS mx, sy / n AS my, sz / n AS mz, sxx / n - (sx / n) * (sx / n) AS axx, syy / n - (sy / n) * (sy / n) AS ayy, szz / n - (sz / n) * (sz / n) AS azz,
    sxy / n - (sx / n) * (sy / n) AS axy, sxz / n - (sx / n) * (sz / n) AS axz, syz / n - (sy / n) * (sz / n) AS ayz FROM vic WHERE n_cells = 9 AND least_n >= 3),
  mean AS (SELECT *, (axx + ayy + azz) / 3.0 AS q FROM cov),
  spread AS (SELECT *, sqrt(((axx - q) * (axx - q) + (ayy - q) * (ayy - q) + (azz - q) * (azz - q) + 2.0 * (axy * axy + axz * axz + ayz * ayz)) / 6.0) AS p FROM mean),
  det AS (SELECT *, ((axx - q) * ((ayy - q) * (azz - q) - ayz * ayz) - axy * (axy * (azz - q) - ayz * axz) + axz * (axy * ayz - (ayy - q) * axz)) / nullif(p * p * p, 0.0) AS d FROM spread),
  eig AS (SELECT *, q + 2.0 * p * cos(acos(greatest(least(d / 2.0, 1.0), -1.0)) / 3.0 + {2 * math.pi / 3!r}) AS low FROM det WHERE d IS NOT NULL),
  crosses AS (SELECT map_id, ci, cj, c.x AS cx, c.y AS cy, c.z AS cz, sqrt(c.x * c.x + c.y * c.y + c.z * c.z) AS len FROM (SELECT map_id, ci, cj, unnest([
      {{'x': axy * ayz - axz * (ayy - low), 'y': axz * axy - (axx - low) * ayz, 'z': (axx - low) * (ayy - low) - axy * axy}},
      {{'x': axy * (azz - low) - axz * ayz, 'y': axz * axz - (axx - low) * (azz - low), 'z': (axx - low) * ayz - axy * axz}},
      {{'x': (ayy - low) * (azz - low) - ayz * ayz, 'y': ayz * axz - axy * (azz - low), 'z': axy * ayz - (ayy - low) * axz}}]) AS c FROM eig) t),
  best AS (SELECT map_id, ci, cj, arg_max(cx, len) AS cx, arg_max(cy, len) AS cy, arg_max(cz, len) AS cz, max(len) AS len FROM crosses GROUP BY map_id, ci, cj HAVING max(len) > 0),
  normal AS (SELECT map_id, ci, cj, CASE WHEN cz < 0 THEN -cx ELSE cx END / len AS nx, CASE WHEN cz < 0 THEN -cy ELSE cy END / len AS ny, abs(cz) / len AS nz FROM best),
  extent AS (SELECT e.map_id, e.ci, e.cj, max((m.sx / m.n - e.mx) * o.nx + (m.sy / m.n - e.my) * o.ny + (m.sz / m.n - e.mz) * o.nz) - min((m.sx / m.n - e.mx) * o.nx + (m.sy / m.n - e.my) * o.ny + (m.sz / m.n - e.mz) * o.nz) AS ext
    FROM eig e JOIN normal o USING (map_id, ci, cj) JOIN moved m ON m.map_id = e.map_id AND m.ci = e.ci AND m.cj = e.cj GROUP BY e.map_id, e.ci, e.cj),
  fits AS (SELECT e.map_id, e.ci, e.cj, least(acos(least(1.0, abs(o.nz))) / 0.4, 1.0) AS slope, least(sqrt(greatest(0.0, e.low)) / 0.15, 1.0) AS roughness, least(x.ext / 0.15, 1.0) AS step, o.nx, o.ny, o.nz
    FROM eig e JOIN normal o USING (map_id, ci, cj) JOIN extent x USING (map_id, ci, cj)),
  haz AS (SELECT v.map_id, v.ci, v.cj, v.own_n AS n, least(v.own_n / 3.0, 1.0) AS border, CASE WHEN v.n_cells = 9 AND v.least_n >= 3 THEN v.own_sz / v.own_n END AS elevation, f.slope, f.step, f.roughness,
    CASE WHEN f.slope IS NOT NULL THEN greatest(f.slope, f.step, f.roughness) END AS hazard, f.nx AS normal_x, f.ny AS normal_y, f.nz AS normal_z FROM vic v LEFT JOIN fits f USING (map_id, ci, cj))"""
OCC = "CASE WHEN {0} IS NULL THEN -1 ELSE CAST(floor(100.0 * least(greatest(round({0}, 6), 0.0), 1.0)) AS INTEGER) END"
EVENTS = "e AS (SELECT user_id AS source, epoch_us(ts) AS t, event_id AS seq, event_type AS kind, value, floor(value * 4) / 64.0 AS x, CAST(event_id % 97 AS DOUBLE) / 8.0 AS y, CAST(0.0 AS DOUBLE) AS z FROM events)"
CLICKS = f"{EVENTS}, l AS (SELECT source, t, seq FROM e WHERE kind = 'click'), r AS (SELECT source, t, seq FROM e WHERE kind = 'view')"
NEAR = "SELECT * FROM (SELECT a.source, a.t, a.seq, b.seq AS hit_seq, b.t AS hit_t, row_number() OVER (PARTITION BY a.seq ORDER BY b.seq IS NULL, abs(a.t - b.t), b.seq) AS rk FROM {a} a LEFT JOIN {b} b ON a.source = b.source) WHERE rk = 1"


def six(*names: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in names)


def rebuilt(where: str, ctes: str = PLACED, map_id: str = "CAST(0 AS BIGINT)") -> str:
    return f"WITH {ctes} SELECT {map_id} AS map_id, ci, cj, {GROUPED} FROM binned WHERE {where} GROUP BY 1, ci, cj"


KEY = "CAST(ci AS BIGINT) * 4294967296 + cj + CASE WHEN cj < 0 THEN 4294967296 ELSE 0 END"
PRUNED = "NOT (bx = 0 AND byy = 0) AND z <= 0.4 AND sqrt(bx * bx + byy * byy + z * z) BETWEEN 0.5 AND 3.5"
GATE = """WITH RECURSIVE {events}, o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY t, seq) AS rn FROM e),
  g AS (SELECT source, rn, t, seq, x, y, {state}, true AS kept FROM o WHERE rn = 1
    UNION ALL SELECT o.source, o.rn, o.t, o.seq, o.x, o.y, {next}, {keep} AS kept FROM g JOIN o ON o.source = g.source AND o.rn = g.rn + 1)
  SELECT {columns} FROM g WHERE kept"""

ORACLES: dict[str, str] = {
    "prune_points": f"WITH {PLACED} SELECT kf_id, bx AS x, byy AS y, z FROM pts WHERE {PRUNED}",
    "bin_points": f"WITH {PLACED} SELECT kf_id, ci, cj, {KEY} AS cell_key, lx, ly, z FROM binned",
    "rebin_partials": f"WITH {PLACED} SELECT CAST(0 AS BIGINT) AS map_id, kf_id, ci, cj, {GROUPED} FROM binned GROUP BY kf_id, ci, cj",
    "fuse_moments": rebuilt("true"),
    "retract_keyframe": rebuilt("kf_id <> 7"),
    "pose_update_rebin": rebuilt("true", placed("CASE WHEN kf_id % 5 = 0 THEN 0.25 ELSE 0.0 END")),
    "reparent_keyframe": rebuilt("true", map_id="CASE WHEN kf_id % 10 = 3 THEN 1 - kf_id % 2 ELSE kf_id % 2 END"),
    "rolling_last_n": rebuilt("kf_id > (SELECT max(kf_id) FROM binned) - 15"),
    "route_keyframes": f"WITH {PLACED} SELECT CASE WHEN kf_id < 30 THEN kf_id % 3 ELSE -1 END AS map_id, count(*) AS n_points FROM pts GROUP BY 1",
    "register_keyframes": f"WITH {PLACED} SELECT DISTINCT kf_id, least(kf_id, 100 - kf_id) AS seq FROM pts WHERE kf_id % 4 <> 0 AND kf_id % 7 <> 1 AND {PRUNED}",
    "vicinity_fuse": f"WITH {VICINITY} SELECT map_id, ci, cj, own_n, n_cells, least_n, {MOMENTS} FROM vic",
    "cell_hazards": f"WITH {FIT} SELECT map_id, ci, cj, n, {six('border', 'elevation', 'slope', 'step', 'roughness', 'hazard', 'normal_x', 'normal_y', 'normal_z')} FROM haz",
    "inflated_step": f"""WITH {FIT}, taps AS (SELECT CAST(a AS INTEGER) AS di, CAST(b AS INTEGER) AS dj, exp(-3.0 * sqrt(a * a + b * b) * 0.25) AS decay FROM range(-2, 3) t(a), range(-2, 3) u(b) WHERE a * a + b * b <= 4),
  reach AS (SELECT map_id, ci + di AS ci, cj + dj AS cj, max(step * decay) AS r FROM haz, taps WHERE step >= 0.95 GROUP BY ALL)
  SELECT h.map_id, h.ci, h.cj, round(h.step, 6) + 0.0 AS step, round(coalesce(r.r, 0.0), 6) + 0.0 AS step_inflated FROM haz h LEFT JOIN reach r USING (map_id, ci, cj)""",
    "occupancy": f"WITH {FIT} SELECT map_id, ci, cj, {OCC.format('hazard')} AS occ FROM haz",
    "threshold": f"WITH {FIT}, o AS (SELECT map_id, ci, cj, {OCC.format('hazard')} AS occ FROM haz) SELECT map_id, ci, cj, CASE WHEN occ >= 55 THEN 100 WHEN occ = -1 THEN -1 ELSE 0 END AS state FROM o",
    "completeness_pool": f"""WITH {CELLS}, b AS (SELECT map_id, ci, cj, least(n / 40.0, 1.0) AS border FROM cells), o AS (SELECT map_id, CAST(floor((ci + 30) / 3.0) AS INTEGER) AS bi, CAST(floor((cj + 30) / 3.0) AS INTEGER) AS bj, min({OCC.format('border')}) AS occ FROM b GROUP BY 1, 2, 3)
  SELECT *, CAST(CASE WHEN occ >= 100 THEN 113 ELSE 128 + round(occ / 100.0 * 126) - CASE WHEN 128 + round(occ / 100.0 * 126) > 127 THEN 256 ELSE 0 END END AS INTEGER) AS byte FROM o""",
    "crop_window": f"WITH {CELLS} SELECT map_id, ci, cj, n, round(least(n / 3.0, 1.0), 6) AS border FROM cells WHERE ci * 0.25 BETWEEN 1.5 - 1.5 AND 1.5 + 1.5 AND cj * 0.25 BETWEEN 0.5 - 1.25 AND 0.5 + 1.25",
    "dense_raster": f"""WITH {FIT}, o AS (SELECT map_id, ci, cj, {OCC.format('hazard')} AS occ FROM haz WHERE ci BETWEEN -8 AND 8 AND cj BETWEEN -8 AND 8)
  SELECT k.map_id, CAST(i AS INTEGER) AS ci, k.cj, coalesce(o.occ, -1) AS occ FROM (SELECT DISTINCT map_id, cj FROM o) k CROSS JOIN range(-8, 9) t(i) LEFT JOIN o ON o.map_id = k.map_id AND o.cj = k.cj AND o.ci = t.i""",
    "sparse_update": f"""WITH {CELLS}, k AS (SELECT map_id, {KEY} AS cell_key, n, least(n / 3.0, 1.0) AS border FROM cells), o AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY cell_key) - 1 AS r FROM k)
  SELECT map_id, 2 * r AS place, cell_key, 'n' AS layer, CAST(n AS DOUBLE) AS value FROM o UNION ALL SELECT map_id, 2 * r + 1, cell_key, 'border', round(CAST(CAST(border AS FLOAT) AS DOUBLE), 4) FROM o""",
    "apply_sparse_update": f"""WITH {PLACED}, early AS (SELECT ci, cj, count(*) AS n FROM binned WHERE kf_id < 20 GROUP BY ci, cj), late AS (SELECT ci, cj, CASE WHEN cj % 5 <> 0 THEN count(*) END AS n FROM binned WHERE ci % 3 = 0 GROUP BY ci, cj),
  g AS (SELECT * FROM late UNION ALL SELECT * FROM early ANTI JOIN late USING (ci, cj)), k AS (SELECT * FROM g WHERE n IS NOT NULL)
  SELECT CAST(0 AS BIGINT) AS map_id, ci, cj, 'n' AS layer, CAST(n AS DOUBLE) AS value FROM k UNION ALL SELECT CAST(0 AS BIGINT), ci, cj, 'border', round(CAST(CAST(least(n / 3.0, 1.0) AS FLOAT) AS DOUBLE), 4) FROM k""",
    "changed_cells": f"""WITH {PLACED}, two AS (SELECT kf_id, CAST(round((x + CASE WHEN kf_id % 5 = 0 THEN 0.25 ELSE 0.0 END) / 0.25) AS INTEGER) AS ci, cj FROM binned),
  a AS (SELECT ci, cj, count(*) AS old_n FROM binned GROUP BY ci, cj), b AS (SELECT ci, cj, count(*) AS new_n FROM two GROUP BY ci, cj),
  t AS (SELECT ci, cj FROM binned WHERE kf_id % 5 = 0 UNION SELECT ci, cj FROM two WHERE kf_id % 5 = 0)
  SELECT CAST(0 AS BIGINT) AS map_id, ci, cj, old_n IS DISTINCT FROM new_n AS count_changed, new_n IS NOT NULL AS observed FROM t LEFT JOIN a USING (ci, cj) LEFT JOIN b USING (ci, cj)""",
    "dilate_cells": f"WITH {CELLS} SELECT DISTINCT map_id, CAST(ci + a AS INTEGER) AS ci, CAST(cj + b AS INTEGER) AS cj FROM cells, range(-2, 3) t(a), range(-2, 3) u(b) WHERE n >= 5 AND a * a + b * b <= 4",
    "grid_bounds": f"WITH {CELLS} SELECT map_id, min(ci) * CAST(0.25 AS DOUBLE) AS min_x, max(ci) * CAST(0.25 AS DOUBLE) AS max_x, min(cj) * CAST(0.25 AS DOUBLE) AS min_y, max(cj) * CAST(0.25 AS DOUBLE) AS max_y, count(*) AS n_cells FROM cells GROUP BY map_id",
    "stitched_voxel_cloud": f"WITH {PLACED} SELECT kf_id % 2 AS map_id, CAST(floor(x / 0.5) AS BIGINT) AS vx, CAST(floor(y / 0.5) AS BIGINT) AS vy, CAST(floor(z / 0.25) AS BIGINT) AS vz, round(sum(x) / count(*), 6) + 0.0 AS x, round(sum(y) / count(*), 6) + 0.0 AS y, round(sum(z) / count(*), 6) + 0.0 AS z FROM pts GROUP BY 1, 2, 3, 4",
    "nearest_cloud": f"WITH {CLICKS} SELECT source, t, seq, hit_seq, hit_t FROM ({NEAR.format(a='l', b='r')})",
    "pose_lookup": f"""WITH {CLICKS}, j AS (SELECT l.source, l.t, l.seq, r.seq AS hit_seq, r.t AS hit_t, row_number() OVER (PARTITION BY l.seq ORDER BY r.seq IS NULL, r.t > l.t, r.t DESC, r.seq DESC) AS rk FROM l LEFT JOIN r ON l.source = r.source)
  SELECT source, t, seq, hit_seq, hit_t FROM j WHERE rk = 1""",
    "approximate_pairs": f"""WITH {CLICKS}, there AS ({NEAR.format(a='l', b='r')}), back AS ({NEAR.format(a='r', b='l')})
  SELECT a.source, a.t, a.seq, a.hit_seq, a.hit_t FROM there a JOIN back b ON a.hit_seq = b.seq AND b.hit_seq = a.seq WHERE abs(a.t - a.hit_t) <= CAST(36000000000 AS BIGINT)""",
    "displacement_gate": GATE.format(events=EVENTS, state="x AS kx, y AS ky", keep="sqrt((o.x - g.kx) * (o.x - g.kx) + (o.y - g.ky) * (o.y - g.ky)) >= 4.0", next="CASE WHEN sqrt((o.x - g.kx) * (o.x - g.kx) + (o.y - g.ky) * (o.y - g.ky)) >= 4.0 THEN o.x ELSE g.kx END, CASE WHEN sqrt((o.x - g.kx) * (o.x - g.kx) + (o.y - g.ky) * (o.y - g.ky)) >= 4.0 THEN o.y ELSE g.ky END", columns="source, t, seq, x, y"),
    "rate_gate": GATE.format(events=EVENTS, state="t AS kt", keep="o.t - g.kt >= 86400000000", next="CASE WHEN o.t - g.kt >= 86400000000 THEN o.t ELSE g.kt END", columns="source, t, seq"),
    "drift_poses": f"""WITH {EVENTS}, p AS (SELECT source, CAST(floor(t / 864000000000.0) AS BIGINT) AS epoch, seq, x, y, CAST(seq % 8 AS DOUBLE) * 0.25 AS yaw FROM e)
  SELECT source, epoch, seq, round(x + sum(0.125 * cos(yaw)) OVER w, 6) + 0.0 AS drift_x, round(y + sum(0.125 * sin(yaw)) OVER w, 6) + 0.0 AS drift_y, round(yaw + count(*) OVER w * 0.015625, 6) + 0.0 AS drift_yaw FROM p WINDOW w AS (PARTITION BY source, epoch ORDER BY seq ROWS UNBOUNDED PRECEDING)""",
    "pair_segments": f"""WITH {EVENTS}, c AS (SELECT source, x, y, z, row_number() OVER (PARTITION BY source ORDER BY seq) AS rk FROM e WHERE kind = 'click')
  SELECT a.source, CAST((a.rk + 1) // 2 AS INTEGER) AS segment, a.x AS x1, a.y AS y1, a.z AS z1, b.x AS x2, b.y AS y2, b.z AS z2 FROM c a JOIN c b ON a.source = b.source AND b.rk = a.rk + 1 WHERE a.rk % 2 = 1""",
    "merge_maps": f"""WITH {PLACED}, one AS (SELECT ci, cj, count(*) AS n FROM binned WHERE kf_id < 25 GROUP BY ci, cj HAVING count(*) >= 4), two AS (SELECT ci, cj, count(*) AS n FROM binned WHERE kf_id >= 20 AND ci < 5 GROUP BY ci, cj HAVING count(*) >= 4)
  SELECT ci, cj, CASE WHEN least(n * 5, 100) > 60 THEN 100 ELSE 0 END AS occ FROM (SELECT * FROM two UNION ALL SELECT * FROM one ANTI JOIN two USING (ci, cj))""",
    "obstacle_ttl": f"WITH {EVENTS} SELECT source, seq, round(t / 1e6, 6) + 0.0 AS recv FROM e WHERE kind = 'error' AND t / 1e6 + 432000 > 1705000000",
    "buffer_retention": f"""WITH {CLICKS}, m AS (SELECT source, min(t) AS a, max(t) AS b FROM r GROUP BY source)
  SELECT r.source, r.t, r.seq FROM r JOIN m USING (source) WHERE b - a <= CAST(20 AS BIGINT) * 86400000000 OR t >= b - CAST(5 AS BIGINT) * 86400000000""",
    "seconds_and_yaw": f"""WITH {EVENTS}, h AS (SELECT seq, t, CAST(seq % 16 AS DOUBLE) * 0.1875 AS half FROM e)
  SELECT seq, round(CAST(t // 1000000 AS DOUBLE) + CAST(t % 1000000 AS DOUBLE) * 1000.0 * 1e-9, 3) AS sec, round(atan2(2 * cos(half) * sin(half), 1 - 2 * sin(half) * sin(half)), 6) + 0.0 AS yaw FROM h""",
    "one_shot_cloud": f"""WITH e AS (SELECT floor(CAST(embedding[1] AS DOUBLE) * 640) / 64.0 AS x, floor(CAST(embedding[2] AS DOUBLE) * 640) / 64.0 AS y, floor(CAST(embedding[3] AS DOUBLE) * 640) / 64.0 AS z FROM embeddings),
  binned AS (SELECT CAST(round(x / 0.25) AS INTEGER) AS ci, CAST(round(y / 0.25) AS INTEGER) AS cj, x - round(x / 0.25) * 0.25 AS lx, y - round(y / 0.25) * 0.25 AS ly, z FROM e WHERE NOT (x = 0 AND y = 0))
  SELECT CAST(0 AS BIGINT) AS map_id, ci, cj, {GROUPED} FROM binned GROUP BY ci, cj""",
}
