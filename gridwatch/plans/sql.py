"""The same queries in ANSI SQL, over the star-schema tables, from shared common table expressions."""

from __future__ import annotations

import math

from ..operators.projection import FORWARD
from ..schemas import CORE, OPTICAL, PANEL, PRIMARY, QUALITY
from .adapter import ELL, HOLE, SQUARE

CORE_LIST = ", ".join(CORE)
INDICES = ("ndvi", "ndbi", "ndwi")


def nd(a: str, b: str) -> str:
    return f"CASE WHEN abs({a} + {b}) > 1e-5 THEN ({a} - {b}) / ({a} + {b}) END"


B = {"b3": "(l_extendedprice / 10) / 10000.0", "b4": "(l_tax * 10000) / 10000.0", "b8": "(l_discount * 10000) / 10000.0", "b11": "(l_quantity * 100) / 10000.0"}
_BANDS = ", ".join(f"{v} AS {k}" for k, v in B.items())

SCENE = """
cell AS (SELECT n_nationkey AS nation, n_regionkey AS region, CAST(n_nationkey // 5 AS INTEGER) AS "row", CAST(n_nationkey % 5 AS INTEGER) AS col,
  printf('cell_%02d_%02d', n_nationkey // 5, n_nationkey % 5) AS cell_id, n_nationkey % 5 + 0.5::DOUBLE AS centroid_lon, n_nationkey // 5 + 0.5::DOUBLE AS centroid_lat FROM nation),
scene AS (SELECT orders.*, strftime(o_orderdate, '%Y-%m') AS month, (o_orderkey * 7) % 100 AS cloud_pct, cell_id, region
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN cell ON c_nationkey = nation),
scene_count AS (SELECT month, count(*) AS raw_scenes, count(*) FILTER (cloud_pct <= 20) AS clean_scenes, count(*) FILTER (cloud_pct <= 40) AS fallback_scenes FROM scene GROUP BY month),
scene_limit AS (SELECT *, CASE WHEN clean_scenes > 0 THEN 20.0::DOUBLE WHEN fallback_scenes > 0 THEN 40.0::DOUBLE END AS used_limit, CASE WHEN clean_scenes > 0 THEN clean_scenes ELSE fallback_scenes END AS used_scenes FROM scene_count),
used AS (SELECT scene.* FROM scene JOIN scene_limit USING (month) WHERE cloud_pct <= used_limit),
span AS (SELECT CAST(date_trunc('month', min(o_orderdate)) AS DATE) AS a, CAST(date_trunc('month', max(o_orderdate)) + INTERVAL 1 MONTH AS DATE) AS b FROM orders),
mon AS (SELECT strftime(m, '%Y-%m') AS month, strftime(m, '%Y-%m-%d') AS start_date, strftime(least(m + INTERVAL 1 MONTH, b), '%Y-%m-%d') AS end_date, CAST(day(last_day(m)) AS INTEGER) AS days_in_month
  FROM (SELECT b, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP - INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS m FROM span))
"""  # fmt: skip
INDEX = f"""
band AS (SELECT cell_id, month, l_suppkey % 16 AS px, {_BANDS} FROM lineitem JOIN used ON l_orderkey = o_orderkey WHERE l_linenumber IN (2, 4, 5, 6, 7)),
idx AS (SELECT *, {nd("b8", "b4")} AS ndvi, {nd("b11", "b8")} AS ndbi, {nd("b3", "b8")} AS ndwi FROM band),
comp AS (SELECT cell_id, month, px, {", ".join(f"median({i}) AS {i}" for i in INDICES)} FROM idx GROUP BY ALL),
zonal AS (SELECT cell_id, month, {", ".join(f"avg({i}) AS {i}_mean, stddev_pop({i}) AS {i}_std" for i in INDICES)}, count(ndvi) AS valid_pixel_count FROM comp GROUP BY ALL),
zonal2 AS (SELECT cell_id, month, {", ".join(f"CASE WHEN valid_pixel_count > 0 THEN {c} END AS {c}" for c in OPTICAL)}, valid_pixel_count, round(least(1.0, valid_pixel_count / 16.0), 4) AS valid_pixel_fraction FROM zonal)
"""
_NEAR = """
node AS (SELECT r_regionkey AS node, r_regionkey + 0.25::DOUBLE AS node_lon, (r_regionkey * 2) % 5 + 0.25::DOUBLE AS node_lat FROM region),
near AS (SELECT cell_id, node, node_lon, node_lat FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY (node_lon - centroid_lon) ** 2 + (node_lat - centroid_lat) ** 2, node) AS k FROM cell, node) WHERE k = 1)
"""
_R9 = lambda cs: ", ".join(f"round({c}, 9) + 0.0 AS {c}" for c in cs.split())
PANEL_CTE = f"""WITH {SCENE}, {INDEX}, {_NEAR},
optical AS (SELECT cell.cell_id, mon.month, start_date, end_date, {_R9(" ".join(OPTICAL))}, coalesce(valid_pixel_count, 0) AS valid_pixel_count, coalesce(valid_pixel_fraction, 0.0) AS valid_pixel_fraction
  FROM cell CROSS JOIN mon LEFT JOIN zonal2 ON cell.cell_id = zonal2.cell_id AND mon.month = zonal2.month),
lights0 AS (SELECT cell_id, month, avg(o_totalprice * 0.00123456789) AS viirs_avg_rad_mean, stddev_pop(o_totalprice * 0.00123456789) AS viirs_avg_rad_std, avg(o_custkey % 10 + 1) AS viirs_cf_cvg_mean, min(o_custkey % 10 + 1) AS viirs_cf_cvg_min,
  max(o_custkey % 10 + 1) AS viirs_cf_cvg_max, count(o_totalprice) AS viirs_valid_pixel_count, round(greatest(0, least(1, avg(CASE WHEN o_orderstatus = 'P' THEN 0.5 ELSE 1.0 END))), 4) AS viirs_valid_pixel_fraction FROM scene GROUP BY ALL),
lights AS (SELECT cell_id, month, start_date, end_date, {_R9("viirs_avg_rad_mean viirs_avg_rad_std viirs_cf_cvg_mean")}, viirs_cf_cvg_min, viirs_cf_cvg_max, viirs_valid_pixel_count, viirs_valid_pixel_fraction FROM lights0 JOIN mon USING (month)),
hour AS (SELECT region AS node, month, (o_totalprice * 0.0000517283917 + 273.15) - 273.15 AS t, ((o_orderkey % 100) / 10000) * 1000.0 AS p, sqrt(((o_custkey % 21) - 10) ** 2 + ((o_orderkey % 15) - 7) ** 2) AS w FROM scene),
weather0 AS (SELECT node, month, avg(t) AS era5_temperature_mean, min(t) AS era5_temperature_min, max(t) AS era5_temperature_max, sum(p) AS era5_precipitation_total, avg(w) AS era5_wind_speed_mean, max(w) AS era5_wind_speed_max, count(*) AS era5_observation_count FROM hour GROUP BY ALL),
weather AS (SELECT cell_id, month, start_date, end_date, {_R9("era5_temperature_mean era5_temperature_min era5_temperature_max era5_precipitation_total era5_wind_speed_mean era5_wind_speed_max")}, era5_observation_count, node_lat AS era5_source_lat, node_lon AS era5_source_lon
  FROM weather0 JOIN near USING (node) JOIN mon USING (month)),
panel AS (SELECT {", ".join(PANEL.names)} FROM optical FULL JOIN lights USING (cell_id, month, start_date, end_date) FULL JOIN weather USING (cell_id, month, start_date, end_date))
"""  # fmt: skip


def long(source: str, ids: str, features: str = CORE_LIST) -> str:
    parts = [f"SELECT {ids}, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM {source}" for f in features.split(", ")]
    return "(" + " UNION ALL ".join(parts) + ")"


CLIM_CTE = f"""{PANEL_CTE},
base AS (SELECT *, CAST(split_part(month, '-', 2) AS INTEGER) AS calendar_month FROM panel WHERE month >= '1995-01' AND month < '2000-01'),
oper AS (SELECT *, CAST(split_part(month, '-', 2) AS INTEGER) AS calendar_month FROM panel WHERE month >= '2001-01' AND month < '2001-07'),
prof AS (SELECT cell_id, calendar_month, feature, count(value) AS n, avg(value) AS mean, median(value) AS median, stddev_samp(value) AS std, mad(value) AS mad, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, min(value) AS lo, max(value) AS hi
  FROM {long("base", "cell_id, calendar_month")} GROUP BY ALL),
clim AS (SELECT cell_id, calendar_month, feature, n AS n_observations, round(mean, 4) AS mean, round(median, 4) AS median, round(CASE WHEN n = 1 THEN 0.0 ELSE std END, 4) AS std, round(mad, 4) AS mad, round(q1, 4) AS q1, round(q3, 4) AS q3,
  round(q3 - q1, 4) AS iqr, round(lo, 4) AS min, round(hi, 4) AS max, coalesce(mad < 1e-9, false) AS zero_mad_flag FROM prof)
"""  # fmt: skip
_MODALITY = "CASE feature " + " ".join(f"WHEN '{f}' THEN '{m}'" for f, m in CORE.items()) + " END"
_ORDINAL = "CASE feature " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(CORE)) + " END"
SCORE_CTE = f"""{CLIM_CTE},
score0 AS (SELECT o.cell_id, o.month, o.calendar_month, o.feature, o.value AS observed_value, c.median, c.mad, o.value - c.median AS residual, 1.4826 * c.mad AS robust_scale, CASE WHEN c.mad > 1e-9 THEN (o.value - c.median) / (c.mad * 1.4826) END AS robust_z,
  coalesce(c.mad <= 1e-9, false) OR coalesce(c.zero_mad_flag, false) AS zero_mad_flag, coalesce(c.n_observations, 0) AS baseline_n FROM {long("oper", "cell_id, month, calendar_month")} o LEFT JOIN clim c USING (cell_id, calendar_month, feature)),
scores AS (SELECT *, abs(robust_z) AS abs_robust_z, abs(residual) AS absolute_deviation, zero_mad_flag AND coalesce(abs(residual) > 1e-6, false) AS zero_mad_deviation, {_MODALITY} AS modality_category FROM score0)
"""  # fmt: skip


def odd(tau: str) -> str:
    return f"(coalesce(abs_robust_z >= {tau}, false) OR zero_mad_deviation)"


def evidence_ctes(keys: str, tau: str, rows: str, skeleton: str) -> str:
    names = {"optical": "optical", "activity": "viirs", "weather": "weather"}
    aggs = ", ".join(f"count(*) FILTER (modality_category = '{m}' AND {odd(tau)}) AS {s}_count, count(*) FILTER (modality_category = '{m}' AND observed_value IS NOT NULL AND median IS NOT NULL) AS {s}_available" for m, s in names.items())
    cols = ", ".join(f"coalesce({s}_{w}, 0) AS {s}_{w}" for s in names.values() for w in ("count", "available"))
    ratio = lambda a, b: f"coalesce(round(CASE WHEN {b} > 0 THEN ({a}) / ({b}) END, 4), 0.0)"
    return f"""
ev0 AS (SELECT {keys}, {aggs}, round(avg(abs_robust_z), 4) AS mean_abs_z FROM {rows} GROUP BY ALL),
ev1 AS (SELECT {keys}, {cols}, mean_abs_z FROM {skeleton} LEFT JOIN ev0 USING ({keys})),
ev2 AS (SELECT *, {ratio("optical_count", "optical_available")} AS optical_ratio, {ratio("weather_count", "weather_available")} AS weather_ratio, viirs_count > 0 AS viirs_anomalous, optical_count + viirs_count AS activity_count, optical_available + viirs_available AS activity_available,
  {ratio("optical_count + viirs_count", "(optical_available + viirs_available)")} AS activity_score FROM ev1),
ev AS (SELECT *, activity_score >= 0.5 AND (optical_count >= 1 OR viirs_anomalous) AS activity_candidate FROM ev2)
"""  # fmt: skip


SKELETON = "skel AS (SELECT cell_id, month FROM oper)"
EVIDENCE_CTE = f"{SCORE_CTE}, {SKELETON}, {evidence_ctes('cell_id, month', '2.0', '(SELECT * FROM scores WHERE baseline_n >= 3)', 'skel')}"
_DOM = f"""
rank0 AS (SELECT *, coalesce(abs_robust_z, absolute_deviation) AS rank_value FROM scores WHERE baseline_n >= 3 AND modality_category IN ('optical', 'activity') AND coalesce(abs_robust_z, absolute_deviation) IS NOT NULL),
rank1 AS (SELECT *, row_number() OVER (PARTITION BY cell_id, month ORDER BY rank_value DESC, {_ORDINAL}) AS k FROM rank0),
dom AS (SELECT skel.cell_id, skel.month, coalesce(feature, 'none') AS dominant_feature, CASE WHEN feature IS NULL THEN 'neutral' WHEN residual > 0 THEN 'positive' ELSE 'negative' END AS dominant_direction, round(rank_value, 4) AS dominant_value
  FROM skel LEFT JOIN rank1 ON skel.cell_id = rank1.cell_id AND skel.month = rank1.month AND k = 1)
"""


def labelled(keys: str) -> str:
    """Candidates (cand: keys, cell_id, "row", col) with their component's number."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""
cand AS (SELECT {keys}, cell_id, "row", col, "row" * 1000 + col AS idx FROM ev JOIN cell USING (cell_id) WHERE activity_candidate),
reach AS (SELECT {keys}, idx, idx AS other FROM cand UNION SELECT {", ".join("a." + k for k in keys.split(", "))}, a.idx, b.idx FROM reach a JOIN cand c ON {on.replace("b.", "c.")} AND c.idx = a.other JOIN cand b ON {on} AND abs(c."row" - b."row") + abs(c.col - b.col) = 1),
first_cell AS (SELECT {keys}, idx, min(other) AS first_idx FROM reach GROUP BY ALL),
evcell AS (SELECT cand.*, CAST(dense_rank() OVER (PARTITION BY {keys} ORDER BY first_idx) AS INTEGER) AS event_number FROM cand JOIN first_cell USING ({keys}, idx))
"""


def rec(sql: str) -> str:
    return "WITH RECURSIVE" + sql.removeprefix("WITH")


EVENT_CTE = rec(f"{EVIDENCE_CTE}, {_DOM}, {labelled('month')}")
_MODE = lambda c: f"(SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM evj x WHERE x.month = e.month AND x.event_number = e.event_number GROUP BY 1) ORDER BY n DESC, v LIMIT 1)"

_PLACE = "place AS (SELECT event_id, value, event_id % 1000 / 37.0 AS lon, (event_id * 7919 + user_id) % 1000 / 41.0 AS lat FROM events)"


def _ring(points: tuple) -> str:
    """Edges (place in the ring, ends) as rows; a ring's direction is that of its points."""
    return ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(points, (*points[1:], points[0]), strict=True))


#: Every edge of every region; the hole runs the other way round.
_EDGES = f"""corner AS (SELECT n_nationkey AS region_id, n_nationkey % 5 * 5.0::DOUBLE + 0.3::DOUBLE AS x, n_nationkey // 5 * 4.5::DOUBLE + 0.2::DOUBLE AS y FROM nation),
edge AS (SELECT region_id, x + a AS x1, y + b AS y1, x + c AS x2, y + d AS y2 FROM corner, (VALUES {_ring(SQUARE)}, {_ring(HOLE[::-1])}) t(a, b, c, d) WHERE region_id % 2 = 0
  UNION ALL SELECT region_id, x + a, y + b, x + c, y + d FROM corner, (VALUES {_ring(ELL)}) t(a, b, c, d) WHERE region_id % 2 = 1)"""
_CROSSED = "count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) % 2 = 1"
_PART = "CASE WHEN u <= x0 THEN 0.0 WHEN u >= x3 THEN (x3 - x0) * (x3 - x0) / 2 + (x3 - x0) * (u - x3) ELSE (u - x0) * (u - x0) / 2 END"
_AXIS, _FLATTENING = 6378137.0, 1 / 298.257223563


def _mercator_ctes() -> str:
    """Krueger's series with the coefficients as numbers."""
    n = _FLATTENING / (2 - _FLATTENING)
    term = [sum(p / q * n ** (j + k) for k, (p, q) in enumerate(row)) for j, row in enumerate(FORWARD, 1)]
    e, r = 2 * math.sqrt(n) / (1 + n), _AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    east = " + ".join(f"{c!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(term, 1))
    north = " + ".join(f"{c!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(term, 1))
    return f"""{_PLACE}, far AS (SELECT event_id, value, radians(lon + 61.5 - 75) AS d, sin(radians(lat + 20)) AS s FROM place),
tau AS (SELECT *, sinh(atanh(s) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * s)) AS t FROM far), ball AS (SELECT *, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM tau),
flat AS (SELECT event_id, value, 500000 + 0.9996::DOUBLE * {r!r}::DOUBLE * (eta + {east}) AS x, 0.9996::DOUBLE * {r!r}::DOUBLE * (xi + {north}) AS y FROM ball)"""


def _cut(new: str, old: str) -> str:
    """The lattice of 35 km's columns (or rows) that an old one of 20 km overlaps."""
    return f"unnest(range(CAST(floor({old} * 20.0 / 35) AS BIGINT), CAST(ceil(({old} + 1) * 20.0 / 35) AS BIGINT))) AS {new}"


_OVERLAP = lambda new, old: f"(least(({old} + 1) * 20000.0::DOUBLE, ({new} + 1) * 35000.0::DOUBLE) - greatest({old} * 20000.0::DOUBLE, {new} * 35000.0::DOUBLE))"
_SHAPE = "count(*) AS n_rows, count(DISTINCT (cell_id, month)) AS n_keys, count(DISTINCT cell_id) AS n_cells, count(DISTINCT month) AS n_months, count(*) - count(DISTINCT (cell_id, month)) AS n_repeated"

ORACLE_SQL = {
    "input_shapes": f"{PANEL_CTE} " + " UNION ALL ".join(f"SELECT {_SHAPE}, '{t}' AS input FROM {t}" for t in ("optical", "lights", "weather")),
    "repeated_keys": f"WITH {SCENE} SELECT cell_id, month, count(*) AS n_rows FROM scene GROUP BY ALL HAVING count(*) > 1",
    "polygon_zonal": f"""WITH {_PLACE}, {_EDGES}, hit AS (SELECT region_id, event_id, any_value(lon) AS lon, any_value(lat) AS lat, any_value(value) AS value FROM place, edge GROUP BY region_id, event_id HAVING {_CROSSED})
SELECT region_id, count(*) AS n_pixels, round(avg(value), 8) AS mean_value, round(min(lon), 4) AS min_lon, round(max(lat), 4) AS max_lat FROM hit GROUP BY region_id""",
    "polygon_weighted": f"""WITH {_PLACE}, {_EDGES},
cut AS (SELECT *, lon - 0.35 AS x0, lon + 0.35 AS x3, greatest(least(y1, y2), lat - 0.35) AS lo, least(greatest(y1, y2), lat + 0.35) AS hi FROM place, edge),
ends AS (SELECT *, x1 + (lo - y1) * (x2 - x1) / nullif(y2 - y1, 0) AS xa, x1 + (hi - y1) * (x2 - x1) / nullif(y2 - y1, 0) AS xb FROM cut),
piece AS (SELECT *, CASE WHEN y1 = y2 OR hi <= lo THEN 0.0 ELSE sign(y2 - y1) * (hi - lo) * CASE WHEN abs(xb - xa) <= 7e-10 THEN least(greatest((xa + xb) / 2, x0), x3) - x0 ELSE ({_PART.replace("u", "xb")} - ({_PART.replace("u", "xa")})) / (xb - xa) END END AS area FROM ends),
part AS (SELECT region_id, event_id, any_value(value) AS v, sum(area) / 0.49 AS w, {_CROSSED} AS centre FROM piece GROUP BY region_id, event_id),
s AS (SELECT region_id, sum(w) FILTER (v IS NOT NULL) AS weight, sum(w * v) AS wv, sum(w * v * v) AS wvv, count(*) FILTER (centre AND v IS NOT NULL) AS pixel_count FROM part WHERE w > 1e-12 OR centre GROUP BY region_id)
SELECT region_id, round(wv / weight, 6) AS value_mean, round(sqrt(greatest(wvv / weight - (wv / weight) * (wv / weight), 0)), 6) AS value_std, round(weight, 6) AS weight, pixel_count FROM s""",
    "transverse_mercator": f"WITH {_mercator_ctes()} SELECT event_id, round(x, 2) AS easting, round(y, 2) AS northing, 0.0::DOUBLE AS missed_by FROM flat",
    "resampled_pixels": f"""WITH {_mercator_ctes()}, fine AS (SELECT CAST(floor(x / 20000) AS BIGINT) AS px, CAST(floor(y / 20000) AS BIGINT) AS py, avg(value) AS value FROM flat GROUP BY ALL),
wide AS (SELECT *, {_cut("qx", "px")} FROM fine), tall AS (SELECT *, {_cut("qy", "py")} FROM wide), weighed AS (SELECT qx, qy, value, {_OVERLAP("qx", "px")} * {_OVERLAP("qy", "py")} AS w FROM tall)
SELECT qx AS px, qy AS py, round(sum(w * value) / sum(w) FILTER (value IS NOT NULL), 8) AS value, round(sum(w) / (35000.0::DOUBLE * 35000.0), 8) AS area FROM weighed GROUP BY ALL""",
    "nearest_of_many": f"""WITH {_PLACE}, node AS (SELECT c_custkey AS node, c_custkey * 7919 % 997 / 37.0 AS node_lon, c_custkey * 104729 % 991 / 41.0 AS node_lat FROM customer),
best AS (SELECT event_id, min(((node_lon - lon) ** 2 + (node_lat - lat) ** 2, node)) AS b FROM place, node GROUP BY event_id)
SELECT event_id AS cell_id, node, round(node_lon, 4) AS node_lon, round(node_lat, 4) AS node_lat FROM best JOIN node ON node = b[2]""",
    "collection_scan": f"""WITH {SCENE}, wanted AS (SELECT o_orderkey, month, scene.region FROM scene JOIN cell USING (cell_id) WHERE o_orderdate >= DATE '1996-02-10' AND o_orderdate < DATE '1997-05-01' AND cloud_pct <= 40 AND col <= 2.5 AND col + 1 >= 0.5 AND cell."row" <= 3.5 AND cell."row" + 1 >= 0.5)
SELECT month, region AS tile, count(*) AS n_pixels, count(DISTINCT l_orderkey) AS n_scenes, round(avg(l_quantity), 4) AS mean_quantity FROM wanted JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""",
    "scene_fallback": f"WITH {SCENE} SELECT * FROM scene_limit",
    "month_ranges": f"WITH {SCENE} SELECT * FROM mon",
    "normalized_difference": f"""WITH {SCENE}, {INDEX} SELECT month, count(*) AS n_pixels, {", ".join(f"count({i}) AS {i}_valid, round(avg({i}), 4) AS {i}_mean" for i in INDICES)} FROM idx GROUP BY month""",
    "raster_sanity": f"""WITH {SCENE}, {INDEX} SELECT index_name, round(min(v), 4) AS min_value, round(avg(v), 4) AS mean_value, round(max(v), 4) AS max_value, coalesce(bool_or(abs(v) > 1.5), false) AS out_of_range
FROM ({" UNION ALL ".join(f"SELECT '{i}' AS index_name, {i} AS v FROM idx" for i in INDICES)}) GROUP BY index_name""",
    "median_composite_zonal": f"""WITH {SCENE}, {INDEX} SELECT cell_id, month, {", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in OPTICAL)}, valid_pixel_count, valid_pixel_fraction FROM zonal2""",
    "coverage_stats": f"{PANEL_CTE} SELECT cell_id, month, round(viirs_avg_rad_mean, 4) AS viirs_avg_rad_mean, round(viirs_avg_rad_std, 4) AS viirs_avg_rad_std, round(viirs_cf_cvg_mean, 4) AS viirs_cf_cvg_mean, viirs_cf_cvg_min, viirs_cf_cvg_max, viirs_valid_pixel_count, viirs_valid_pixel_fraction FROM lights",
    "hourly_to_monthly": """
SELECT node, month, round(avg(t), 4) AS era5_temperature_mean, round(min(t), 4) AS era5_temperature_min, round(max(t), 4) AS era5_temperature_max, round(sum(p), 4) AS era5_precipitation_total, round(avg(w), 4) AS era5_wind_speed_mean, round(max(w), 4) AS era5_wind_speed_max, count(*) AS era5_observation_count,
  days_in_month, CAST(days_in_month * 24 AS BIGINT) AS expected_hours, round(count(*) / (days_in_month * 24), 4) AS completeness_ratio
FROM (SELECT user_id % 5 AS node, strftime(ts, '%Y-%m') AS month, CAST(day(last_day(ts)) AS INTEGER) AS days_in_month, (value * 0.0123456789 + 273.15) - 273.15 AS t, (event_id % 100) / 10000 * 1000.0 AS p, sqrt(((user_id % 21) - 10) ** 2 + (coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) - 3) ** 2) AS w FROM events)
GROUP BY node, month, days_in_month""",
    "nearest_station": f"WITH {SCENE}, {_NEAR} SELECT cell_id, node, node_lon, node_lat, n_scenes FROM near JOIN (SELECT cell_id, count(*) AS n_scenes FROM scene GROUP BY cell_id) USING (cell_id)",
    "panel_full_outer": f"{PANEL_CTE} SELECT cell_id, month, start_date, end_date, {', '.join(f'round({f.name}, 4) + 0.0 AS {f.name}' if f.dataType.simpleString() == 'double' else f.name for f in PANEL[4:])} FROM panel",
    "panel_shape": f"{PANEL_CTE} SELECT count(*) AS n_rows, count(DISTINCT (cell_id, month)) AS n_keys, count(DISTINCT cell_id) AS n_cells, count(DISTINCT month) AS n_months, count(*) - count(DISTINCT (cell_id, month)) AS n_repeated FROM panel",
    "source_probe": " UNION ALL ".join(f"SELECT '{c}' AS column_name, true AS present, count(*) AS n_rows, count({c}) AS n_values, CAST(min({c}) AS DOUBLE) AS min_value, round(avg(CAST({c} AS DOUBLE)), 4) AS mean_value, CAST(max({c}) AS DOUBLE) AS max_value FROM lineitem" for c in ("l_discount", "l_tax", "l_quantity")) + " UNION ALL SELECT 'b99' AS column_name, false, count(*), 0, NULL, NULL, NULL FROM lineitem",
    "grid_generate": """
WITH b AS (SELECT min(value) AS min_lon, max(value) AS max_lon, 20.0::DOUBLE AS min_lat, 20.0::DOUBLE + max(user_id) / 1000.0 AS max_lat FROM events),
c AS (SELECT *, pi() / 180 * 6371000.0 AS per_lat, pi() / 180 * 6371000.0 * cos(radians((min_lat + max_lat) / 2)) AS per_lon FROM b),
d AS (SELECT *, greatest(1, CAST(ceil((max_lon - min_lon) / (1000000 / per_lon)) AS BIGINT)) AS n_cols, greatest(1, CAST(ceil((max_lat - min_lat) / (1000000 / per_lat)) AS BIGINT)) AS n_rows FROM c),
e AS (SELECT *, (max_lon - min_lon) / n_cols AS dx, (max_lat - min_lat) / n_rows AS dy, unnest(range(n_rows * n_cols)) AS i FROM d)
SELECT printf('cell_%02d_%02d', i // n_cols, i % n_cols) AS cell_id, CAST(i // n_cols AS INTEGER) AS "row", CAST(i % n_cols AS INTEGER) AS col, CAST(i AS INTEGER) AS "index", round(min_lon + (i % n_cols) * dx + dx / 2, 6) AS centroid_lon, round(min_lat + (i // n_cols) * dy + dy / 2, 6) AS centroid_lat,
  round(min_lon + (i % n_cols) * dx, 6) AS min_lon, round(min_lon + (i % n_cols) * dx + dx, 6) AS max_lon, round(min_lat + (i // n_cols) * dy, 6) AS min_lat, round(min_lat + (i // n_cols) * dy + dy, 6) AS max_lat, round(dx * per_lon, 1) AS approx_width_m, round(dy * per_lat, 1) AS approx_height_m FROM e""",
    "pixel_to_cell": """
WITH p AS (SELECT event_id, event_id % 1000 / 37.0 AS lon, user_id % 1000 / 41.0 AS lat FROM events),
q AS (SELECT CAST(floor((lat - 1.0) / 2.5) AS INTEGER) AS r, CAST(floor((lon - 1.0) / 3.5) AS INTEGER) AS c FROM p)
SELECT printf('cell_%02d_%02d', r, c) AS cell_id, count(*) AS n_pixels FROM q WHERE r BETWEEN 0 AND 7 AND c BETWEEN 0 AND 5 GROUP BY r, c""",
    "pixel_to_cell_touch": """
WITH p AS (SELECT event_id, event_id % 1000 / 37.0 AS lon, user_id % 1000 / 41.0 AS lat FROM events),
q AS (SELECT unnest(range(CAST(floor((lat - 0.4 - 1.0) / 2.5) AS BIGINT), CAST(floor((lat + 0.4 - 1.0) / 2.5) AS BIGINT) + 1)) AS r, CAST(floor((lon - 0.4 - 1.0) / 3.5) AS BIGINT) AS c0, CAST(floor((lon + 0.4 - 1.0) / 3.5) AS BIGINT) AS c1 FROM p),
s AS (SELECT r, unnest(range(c0, c1 + 1)) AS c FROM q)
SELECT printf('cell_%02d_%02d', r, c) AS cell_id, count(*) AS n_pixels FROM s WHERE r BETWEEN 0 AND 7 AND c BETWEEN 0 AND 5 GROUP BY r, c""",
    "regional_trend": f"{PANEL_CTE} SELECT month, {', '.join(f'round(avg({f}), 4) AS {f}' for f in CORE)} FROM panel GROUP BY month",
    "completeness": f"{PANEL_CTE} SELECT month, count(*) AS total_cells, count(ndvi_mean) AS optical_cells, count(viirs_avg_rad_mean) AS lights_cells, count(era5_temperature_mean) AS weather_cells, CAST(sum(era5_observation_count) AS BIGINT) AS weather_hours FROM panel GROUP BY month",
    "regression_diff": f"""{PANEL_CTE} SELECT feature, count(d) AS n_compared, round(max(d), 4) AS max_diff, round(avg(d), 4) AS mean_diff, count(*) FILTER (d > 1e-6) AS n_exceeding FROM (
{" UNION ALL ".join(f"SELECT '{f}' AS feature, abs(a.{f} - b.{f}) AS d FROM panel a JOIN panel b ON a.cell_id = b.cell_id AND a.month = '1999-03' AND b.month = '1998-03'" for f in ("ndvi_mean", "viirs_avg_rad_mean", "era5_temperature_mean"))}) GROUP BY feature""",
    "seasonal_climatology": f"{CLIM_CTE} SELECT * FROM clim",
    "updated_climatology": f"{CLIM_CTE} SELECT * FROM clim",
    "refreshed_months": f"WITH {SCENE} SELECT month, region, count(*) AS n_scenes, round(sum(o_totalprice), 2) AS total, month = '1996-03' AS rebuilt FROM scene WHERE NOT (month = '1996-03' AND region = 2) GROUP BY month, region",
    "climatology_band": f"{CLIM_CTE} SELECT cell_id, calendar_month, median, round(median - mad * 1.4826, 4) AS low, round(median + mad * 1.4826, 4) AS high FROM clim WHERE cell_id IN ('cell_00_01', 'cell_02_02') AND feature = 'viirs_avg_rad_mean'",
    "march_diagnostic": f"""{CLIM_CTE}, x AS (SELECT o.cell_id, o.feature, o.value AS v, c.median, coalesce(c.n_observations, 0) AS n_observations, CASE WHEN c.mad > 1e-9 THEN (o.value - c.median) / (c.mad * 1.4826) END AS z
FROM {long("(SELECT * FROM oper WHERE month = '2001-03')", "cell_id, calendar_month")} o LEFT JOIN clim c USING (cell_id, calendar_month, feature))
SELECT cell_id, feature, round(v, 4) AS value, median, n_observations, round(z, 4) AS robust_z, coalesce(abs(z) >= 3.0, false) AS beyond FROM x""",
    "score_robust_z": f"""{SCORE_CTE} SELECT cell_id, month, calendar_month, feature, round(observed_value, 4) AS observed_value, median, mad, round(residual, 4) AS residual, round(robust_scale, 4) AS robust_scale, round(robust_z, 4) AS robust_z, round(abs_robust_z, 4) AS abs_robust_z,
  round(absolute_deviation, 4) AS absolute_deviation, zero_mad_flag, zero_mad_deviation, baseline_n, baseline_n >= 1 AS baseline_usable_n1, baseline_n >= 2 AS baseline_usable_n2, baseline_n >= 3 AS baseline_usable_n3, modality_category FROM scores""",
    "feature_anomaly_summary": f"""{SCORE_CTE} SELECT feature, modality_category, count(*) AS total_observations, count(observed_value) AS valid_observations, count(*) FILTER {odd("3.0").join(("(", ")"))} AS anomalies_detected, count(*) FILTER (zero_mad_deviation) AS zero_mad_deviations, round(avg(abs_robust_z), 4) AS mean_abs_robust_z,
  count(*) - count(observed_value) AS missing_observations, round(CASE WHEN count(observed_value) > 0 THEN count(*) FILTER ({odd("3.0")}) * 100 / count(observed_value) END, 2) AS anomaly_rate_pct FROM scores GROUP BY ALL""",
    "evidence_fusion": f"{EVIDENCE_CTE}, q AS (SELECT cell_id, month, coalesce(valid_pixel_fraction, 0.0) AS valid_pixel_fraction, round(coalesce(viirs_cf_cvg_mean, 0.0), 4) AS viirs_cf_cvg_mean FROM panel) SELECT * FROM ev JOIN q USING (cell_id, month)",
    "dominant_feature": f"{EVIDENCE_CTE}, {_DOM} SELECT * FROM dom",
    "event_cells": f"{EVENT_CTE} SELECT month, cell_id, \"row\", col, event_number FROM evcell",
    "streamed_events": f"{EVENT_CTE} SELECT month, cell_id, \"row\", col, event_number FROM evcell",
    "spatial_events": f"""{EVENT_CTE}, evj AS (SELECT evcell.month, event_number, evcell.cell_id, evcell."row" AS r, evcell.col AS c, activity_score, optical_count, viirs_anomalous, weather_count, dominant_feature, dominant_direction FROM evcell JOIN ev ON ev.cell_id = evcell.cell_id AND ev.month = evcell.month JOIN dom ON dom.cell_id = evcell.cell_id AND dom.month = evcell.month),
e AS (SELECT month, event_number, count(*) AS cell_count, round(avg(c + 0.5), 4) AS centroid_lon, round(avg(r + 0.5), 4) AS centroid_lat, min(c)::DOUBLE AS min_lon, max(c + 1)::DOUBLE AS max_lon, min(r)::DOUBLE AS min_lat, max(r + 1)::DOUBLE AS max_lat, round(avg(activity_score), 4) AS mean_score, max(activity_score) AS max_score,
  count(*) FILTER (optical_count >= 1) AS optical_cells, count(*) FILTER (viirs_anomalous) AS viirs_cells, count(*) FILTER (weather_count >= 1) AS weather_cells, string_agg(cell_id, ';' ORDER BY cell_id) AS cells FROM evj GROUP BY ALL)
SELECT printf('EVT_%s_%03d', replace(month, '-', ''), event_number) AS event_id, e.* EXCLUDE (event_number), cell_count >= 2 AS spatially_coherent, {_MODE("dominant_feature")} AS dominant_feature, {_MODE("dominant_direction")} AS dominant_direction FROM e""",
    "monthly_anomaly_summary": f"""{EVENT_CTE}, sizes AS (SELECT month, event_number, count(*) AS n FROM evcell GROUP BY ALL), s AS (SELECT month, count(*) AS t, count(*) FILTER (n >= 2) AS m FROM sizes GROUP BY month),
a AS (SELECT month, count(*) AS total_cells, count(*) FILTER (activity_candidate) AS candidate_anomalous_cells, round(avg(activity_score), 4) AS mean_activity_evidence FROM ev GROUP BY month)
SELECT a.*, coalesce(t, 0) AS total_spatial_events, coalesce(m, 0) AS multi_cell_events, round(candidate_anomalous_cells * 100 / total_cells, 2) AS candidate_pct, coalesce(t, 0) - coalesce(m, 0) AS single_cell_events FROM a LEFT JOIN s USING (month)""",
    "event_map": f"{EVENT_CTE} SELECT cell.cell_id, cell.\"row\", cell.col, event_number FROM cell LEFT JOIN (SELECT * FROM evcell WHERE month = '2001-03') e USING (cell_id)",
    "threshold_sweep": rec(f"""{SCORE_CTE}, {SKELETON}, setting AS (SELECT * FROM (VALUES (2.0::DOUBLE), (2.5), (3.0), (3.5)) t(tau), (VALUES (3), (4), (5)) n(min_n)),
{evidence_ctes("cell_id, month, tau, min_n", "tau", "(SELECT * FROM scores JOIN setting ON baseline_n >= min_n)", "(SELECT * FROM skel CROSS JOIN setting)")}, {labelled("tau, min_n, month")},
f AS (SELECT tau, min_n, count(*) FILTER ({odd("tau")}) AS a, count(*) FILTER (zero_mad_deviation) AS z FROM scores JOIN setting ON baseline_n >= min_n GROUP BY ALL),
sizes AS (SELECT tau, min_n, month, event_number, count(*) AS n FROM evcell GROUP BY ALL), g AS (SELECT tau, min_n, sum(n) AS c, count(*) AS t, count(*) FILTER (n >= 2) AS m FROM sizes GROUP BY ALL)
SELECT tau, min_n, coalesce(a, 0) AS feature_level_anomalies, coalesce(z, 0) AS zero_mad_feature_anomalies, CAST(coalesce(c, 0) AS BIGINT) AS candidate_anomalous_cells, coalesce(t, 0) AS total_spatial_events, coalesce(m, 0) AS multi_cell_coherent_events, coalesce(t, 0) - coalesce(m, 0) AS single_cell_isolated_events
FROM setting LEFT JOIN f USING (tau, min_n) LEFT JOIN g USING (tau, min_n)"""),
    "perturbation_benchmark": f"""{CLIM_CTE}, h AS (SELECT x.*, c.median, c.mad FROM {long("base", "cell_id, month, calendar_month")} x JOIN clim c USING (cell_id, calendar_month, feature) WHERE x.value IS NOT NULL ORDER BY md5(concat_ws('|', cell_id, month, feature)) LIMIT 500),
k AS (SELECT * FROM (VALUES (-3.0::DOUBLE), (-2.0), (-1.0), (1.0), (2.0), (3.0)) a(injected_magnitude_scales), (VALUES (2.0::DOUBLE), (2.5), (3.0), (3.5)) b(threshold_tau)),
r AS (SELECT *, value + CASE WHEN mad > 1e-9 THEN injected_magnitude_scales * (mad * 1.4826) ELSE sign(injected_magnitude_scales) * CASE WHEN feature IN ('viirs_avg_rad_mean', 'era5_precipitation_total') THEN 10.0 ELSE 0.05 END END - median AS res FROM h, k),
d AS (SELECT *, CASE WHEN mad > 1e-9 THEN abs(res / (mad * 1.4826)) >= threshold_tau ELSE abs(res) > 1e-6 END AS hit FROM r)
SELECT injected_magnitude_scales, threshold_tau, count(*) AS n_trials, count(*) FILTER (mad > 1e-9) AS n_robust, count(*) FILTER (NOT mad > 1e-9) AS n_zero_mad, count(*) FILTER (hit) AS detected_count, round(count(*) FILTER (hit) * 100 / count(*), 2) AS detection_sensitivity_pct FROM d GROUP BY ALL""",
}


def _profile(name: str, kind: str) -> str:
    number = kind in ("double", "bigint")
    cat = "primary" if name in PRIMARY else "quality" if name in QUALITY else "identifier"
    x = f"CAST({name} AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"
    return f"""SELECT '{name}' AS column_name, '{cat}' AS category, '{kind}' AS dtype, count(*) AS total_rows, count(*) - count({name}) AS missing_count, round((count(*) - count({name})) * 100 / count(*), 2) AS missing_percentage, count(*) FILTER (isinf({x})) AS infinite_count, count(DISTINCT {name}) AS unique_values,
count(DISTINCT {name}) <= 1 AS is_constant, {str(number).lower()} AND count(DISTINCT {name}) > 1 AND count(DISTINCT {name}) < 5 AS is_near_constant, round(min({x}), 4) AS min_value, round(max({x}), 4) AS max_value FROM panel"""



def _r(x: str, y: str) -> str:
    a, b = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 4)"


def _pair_sql(source: str, pairs: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{x}' AS feature_x, '{y}' AS feature_y, {_r(x, y)} AS r FROM {source}" for x, y in pairs)


_ALL = (*PRIMARY, *QUALITY)
_BASELONG = long("base", "cell_id, month")
_STATS = "round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(stddev_samp(value), 4) AS std"
ORACLE_SQL |= {
    "quality_profile": f"{PANEL_CTE} " + " UNION ALL ".join(_profile(f.name, f.dataType.simpleString()) for f in PANEL),
    "feature_statistics": f"""{CLIM_CTE}, x AS (SELECT feature, value, avg(value) OVER (PARTITION BY feature) AS mu FROM {long("base", "cell_id", ", ".join(_ALL))}) SELECT feature, count(value) AS count, count(*) - count(value) AS missing_count, round((count(*) - count(value)) * 100 / count(*), 2) AS missing_pct, {_STATS}, round(min(value), 4) AS min, round(max(value), 4) AS max,
round(quantile_cont(value, 0.25), 4) AS q1, round(quantile_cont(value, 0.75), 4) AS q3, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS iqr,
round(CASE WHEN stddev_samp(value) < 1e-6 THEN 0.0 ELSE avg((value - mu) ** 3) / nullif(stddev_pop(value), 0) ** 3 END, 4) AS skewness, round(CASE WHEN stddev_samp(value) < 1e-6 THEN 0.0 ELSE avg((value - mu) ** 4) / nullif(stddev_pop(value), 0) ** 4 - 3 END, 4) AS kurtosis FROM x GROUP BY feature""",
    "missingness_month": f"""{PANEL_CTE} SELECT month, count(*) AS total_cells, {", ".join(f"count(*) - count({c}) AS {k}_missing_cells, round((count(*) - count({c})) * 100 / count(*), 2) AS {k}_missing_pct" for k, c in (("s2", "ndvi_mean"), ("viirs", "viirs_avg_rad_mean"), ("era5", "era5_temperature_mean")))} FROM panel GROUP BY month""",
    "missingness_cell": f"{PANEL_CTE} SELECT cell_id, count(ndvi_mean) AS s2_valid_months, count(*) - count(ndvi_mean) AS s2_missing_months, count(viirs_avg_rad_mean) AS viirs_valid_months, count(era5_temperature_mean) AS era5_valid_months FROM panel GROUP BY cell_id",
    "co_missing": f"{PANEL_CTE} SELECT bool_and({' AND '.join(f'({c} IS NULL) = (ndvi_mean IS NULL)' for c in OPTICAL)}) AS optical_together, bool_and(ndvi_mean IS NOT NULL OR (valid_pixel_count = 0 AND valid_pixel_fraction = 0.0)) AS missing_means_zero, count(*) FILTER (ndvi_mean IS NULL) AS missing_rows FROM panel",
    "monthly_summary": f"{CLIM_CTE} SELECT month, feature, {_STATS}, round(min(value), 4) AS min, round(max(value), 4) AS max, count(value) AS valid_count FROM {_BASELONG} GROUP BY month, feature",
    "cell_temporal_stats": f"{CLIM_CTE} SELECT cell_id, " + ", ".join(f"round(avg({f}), 4) AS {f}_mean, round(median({f}), 4) AS {f}_median, round(stddev_samp({f}), 4) AS {f}_std, round(mad({f}), 4) AS {f}_mad, round(min({f}), 4) AS {f}_min, round(max({f}), 4) AS {f}_max, count({f}) AS {f}_count" for f in CORE) + ", CASE WHEN avg(viirs_avg_rad_mean) > 1e-4 THEN round(stddev_samp(viirs_avg_rad_mean) / avg(viirs_avg_rad_mean), 4) END AS viirs_avg_rad_mean_cv FROM base GROUP BY cell_id",
    "pearson_pairs": f"{CLIM_CTE}, c AS (SELECT {', '.join(PRIMARY)} FROM base WHERE {' AND '.join(f'{f} IS NOT NULL' for f in PRIMARY)}) " + _pair_sql("c", [(x, y) for x in PRIMARY for y in PRIMARY]),
    "pearson_pairwise": f"{CLIM_CTE} " + _pair_sql("base", [(x, y) for x in PRIMARY for y in ("valid_pixel_fraction", "viirs_cf_cvg_mean", "era5_observation_count")]),
    "spearman_pairs": f"{CLIM_CTE}, c AS (SELECT {CORE_LIST} FROM base WHERE {' AND '.join(f'{f} IS NOT NULL' for f in CORE)}), k AS (SELECT {', '.join(f'rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2 AS {f}' for f in CORE)} FROM c) " + _pair_sql("k", [(x, y) for x in CORE for y in CORE]),
    "variance_decomposition": f"""{CLIM_CTE}, x AS (SELECT * FROM {_BASELONG} WHERE value IS NOT NULL), t AS (SELECT feature, var_samp(value) AS total FROM x GROUP BY feature), c AS (SELECT feature, cell_id, avg(value) AS m, CASE WHEN count(*) > 1 THEN var_samp(value) END AS v, count(*) AS n FROM x GROUP BY ALL),
p AS (SELECT feature, var_samp(m) AS b, avg(v) AS w, min(n) AS lo, max(n) AS hi FROM c GROUP BY feature)
SELECT feature, round(total, 4) AS total_variance, round(b, 4) AS between_variance, round(w, 4) AS within_variance, round(b * 100 / nullif(total, 0), 2) AS pct_between_cell, round(w * 100 / nullif(total, 0), 2) AS pct_within_cell, lo AS min_obs_per_cell, hi AS max_obs_per_cell, lo = hi AS balanced_panel FROM t JOIN p USING (feature)""",
    "baseline_comparison": f"""{CLIM_CTE}, x AS (SELECT *, avg(value) OVER w AS a, median(value) OVER w AS b, avg(value) OVER (PARTITION BY cell_id, feature ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS c FROM {_BASELONG} WINDOW w AS (PARTITION BY cell_id, feature)),
y AS (SELECT feature, 'A_mean' AS baseline_name, value - a AS r FROM x UNION ALL SELECT feature, 'B_median', value - b FROM x UNION ALL SELECT feature, 'C_lagged_mean', value - c FROM x UNION ALL SELECT feature, 'D_robust', value - b FROM x)
SELECT feature, baseline_name, count(r) AS n_eval_obs, round(avg(abs(r)), 4) AS mae, round(sqrt(avg(r * r)), 4) AS rmse, round(median(abs(r)), 4) AS median_ae, round(stddev_pop(r), 4) AS residual_std FROM y GROUP BY ALL""",
    "representative_cells": f"""{CLIM_CTE}, s0 AS (SELECT cell_id, round(stddev_samp(ndvi_mean), 4) AS s, round(avg(viirs_avg_rad_mean), 4) AS r FROM base GROUP BY cell_id), s1 AS (SELECT *, round((SELECT median(s) FROM s0), 4) AS ms, round((SELECT median(r) FROM s0), 4) AS mr FROM s0),
p1 AS (SELECT cell_id FROM s1 ORDER BY s NULLS LAST, cell_id LIMIT 1), p2 AS (SELECT cell_id FROM s1 WHERE cell_id NOT IN (FROM p1) ORDER BY -s NULLS LAST, cell_id LIMIT 1), q2 AS (FROM p1 UNION ALL FROM p2),
p3 AS (SELECT cell_id FROM s1 WHERE cell_id NOT IN (FROM q2) ORDER BY round(abs(s - ms), 4) NULLS LAST, cell_id LIMIT 1), q3 AS (FROM q2 UNION ALL FROM p3), p4 AS (SELECT cell_id FROM s1 WHERE cell_id NOT IN (FROM q3) ORDER BY -r NULLS LAST, cell_id LIMIT 1), q4 AS (FROM q3 UNION ALL FROM p4),
p5 AS (SELECT cell_id FROM s1 WHERE cell_id NOT IN (FROM q4) ORDER BY round(abs(r - mr), 4) NULLS LAST, cell_id LIMIT 1)
SELECT 1 AS pick, 'stable_ndvi' AS role, cell_id FROM p1 UNION ALL SELECT 2, 'variable_ndvi', cell_id FROM p2 UNION ALL SELECT 3, 'typical_ndvi', cell_id FROM p3 UNION ALL SELECT 4, 'bright', cell_id FROM p4 UNION ALL SELECT 5, 'typical_light', cell_id FROM p5""",
    "histogram_bins": f"""{CLIM_CTE}, x AS (SELECT viirs_avg_rad_mean AS v FROM base WHERE viirs_avg_rad_mean IS NOT NULL), l AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n FROM x),
b AS (SELECT CAST(least(floor((v - lo) / ((hi - lo) / 40)), 39) AS INTEGER) AS bin, lo, hi, n FROM x, l WHERE hi > lo)
SELECT bin, round(lo + bin * ((hi - lo) / 40), 4) AS bin_start, count(*) AS frequency, round(count(*) / (n * ((hi - lo) / 40)), 4) AS density FROM b GROUP BY bin, lo, hi, n""",
    "box_data": f"{CLIM_CTE} SELECT feature, " + ", ".join(f"round(quantile_cont(value, {q}), 4) AS {n}" for q, n in ((0.0, "low"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "high"))) + f" FROM {_BASELONG} GROUP BY feature",
    "percentile_clip": f"{CLIM_CTE}, q AS (SELECT quantile_cont(ndvi_mean, 0.01) AS a, quantile_cont(ndvi_mean, 0.99) AS b FROM base) SELECT 'ndvi_mean' AS feature, round(CASE WHEN a = b THEN a - 0.5 ELSE greatest(-0.2, a) END, 4) AS vmin, round(CASE WHEN a = b THEN b + 0.5 ELSE least(0.9, b) END, 4) AS vmax FROM q",
    "log1p_skew": f"{CLIM_CTE}, x AS (SELECT viirs_avg_rad_mean AS v, avg(viirs_avg_rad_mean) OVER () AS m, ln(1 + viirs_avg_rad_mean) AS u, avg(ln(1 + viirs_avg_rad_mean)) OVER () AS k FROM base) SELECT round(avg((v - m) ** 3) / stddev_pop(v) ** 3, 4) AS skew_raw, round(avg((u - k) ** 3) / stddev_pop(u) ** 3, 4) AS skew_log1p FROM x",
}
#: The stream's rows are the batch's.
ORACLE_SQL["streamed_scores"] = ORACLE_SQL["score_robust_z"]

_SAME_MONTH = "(SELECT * FROM panel WHERE month = '1998-03')"
_COMPLETENESS = "SELECT month, count(*) AS total_cells, count(ndvi_mean) AS optical_cells, count(viirs_avg_rad_mean) AS lights_cells, count(era5_temperature_mean) AS weather_cells, CAST(sum(era5_observation_count) AS BIGINT) AS weather_hours FROM panel GROUP BY month"
ORACLE_SQL |= {
    "parquet_round_trip": ORACLE_SQL["panel_full_outer"],
    "csv_round_trip": ORACLE_SQL["panel_full_outer"],
    "geojson_round_trip": ORACLE_SQL["grid_generate"],
    "checkpoint_reuse": ORACLE_SQL["regional_trend"],
    "canonical_sink": f"{PANEL_CTE} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_late FROM panel",
    "bounds_filter": f"WITH {SCENE} SELECT scene.cell_id, count(*) AS n_scenes FROM scene JOIN cell USING (cell_id) WHERE centroid_lon BETWEEN 0.95 AND 3.05 AND centroid_lat BETWEEN 0.95 AND 2.55 GROUP BY scene.cell_id",
    "label_strip": f"""{PANEL_CTE} SELECT feature, n_values, replace(regexp_replace(regexp_replace(feature, '^(viirs|era5)_', ''), '_(mean|total)$', ''), '_', ' ') AS label FROM ({" UNION ALL ".join(f"SELECT '{f}' AS feature, count({f}) AS n_values FROM panel" for f in CORE)})""",
    "empty_guard": f"WITH {SCENE} SELECT month, count(*) AS used_scenes FROM used GROUP BY month",
    "month_ordinal": f"{PANEL_CTE} SELECT month, CAST(row_number() OVER (ORDER BY month) - 1 AS INTEGER) AS month_ordinal FROM (SELECT DISTINCT month FROM panel)",
    "regression_gate": " UNION ALL ".join(f"SELECT '{f}' AS feature, n AS n_compared, 0.0::DOUBLE AS max_diff, 0.0::DOUBLE AS mean_diff, CAST(0 AS BIGINT) AS n_exceeding, '{m}' AS matched_by FROM ({PANEL_CTE} SELECT count({f}) AS n FROM {_SAME_MONTH})" for m in ("cell_id", "position") for f in ("ndvi_mean", "viirs_avg_rad_mean", "era5_temperature_mean")),
    "ingestion_completeness": f"""{PANEL_CTE}, c AS ({_COMPLETENESS})
SELECT c.* EXCLUDE (h), coalesce(raw_scenes, 0) AS raw_scenes, coalesce(clean_scenes, 0) AS clean_scenes, coalesce(used_scenes, 0) AS used_scenes, coalesce(image_count, 0) AS image_count, CAST(h AS BIGINT) AS expected_hours, round(weather_hours / h, 4) AS hours_ratio
FROM (SELECT *, day(last_day(CAST(month || '-01' AS DATE))) * 24 * total_cells AS h FROM c) c LEFT JOIN scene_limit USING (month) LEFT JOIN (SELECT month, count(DISTINCT CAST(o_orderdate AS DATE)) AS image_count FROM scene GROUP BY month) USING (month)""",
    "choropleth_rows": f"""{PANEL_CTE} SELECT cell.cell_id, CAST(5 AS INTEGER) AS n_points, col::DOUBLE AS lon0, "row"::DOUBLE AS lat0, (col + 1)::DOUBLE AS lon2, ("row" + 1)::DOUBLE AS lat2, round(ndvi_mean, 4) AS value, ndvi_mean IS NOT NULL AS has_value
FROM cell LEFT JOIN {_SAME_MONTH} p ON cell.cell_id = p.cell_id""",
    "hourly_completeness": f"""WITH {SCENE} SELECT node, month, n AS era5_observation_count, CAST(h AS BIGINT) AS expected_hours, round(n / h, 4) AS completeness_ratio
FROM (SELECT region AS node, month, count(*) AS n, day(last_day(CAST(month || '-01' AS DATE))) * 24 AS h FROM scene GROUP BY ALL)""",
    "complete_months": f"{SCORE_CTE} SELECT month FROM scores GROUP BY month HAVING count(DISTINCT cell_id) = (SELECT count(*) FROM cell)",
    "pearson_matrix": f"""SELECT feature_x, {", ".join(f"max(r) FILTER (feature_y = '{f}') AS {f}" for f in PRIMARY)} FROM ({ORACLE_SQL["pearson_pairs"]}) GROUP BY feature_x""",
}
