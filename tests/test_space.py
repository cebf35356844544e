"""Polygons, projections, nearest nodes, collections and nested events, against plain versions."""

import math
import random

import pytest
from gridwatch.operators import events, nearest, panel, polygons, projection
from gridwatch.schemas import PANEL
from gridwatch.sources import catalogue
from pyspark.sql import functions as F

RINGS = "region_id int, rings array<array<array<struct<x: double, y: double>>>>"
SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
HOLE = [(3.0, 3.0), (6.0, 3.0), (6.0, 7.0), (3.0, 7.0)]
ELL = [(20.0, 0.0), (30.0, 0.0), (30.0, 2.5), (24.0, 4.0), (24.0, 9.0), (20.0, 9.0), (20.0, 0.0)]  # closed
STAR = [(40 + (5 if k % 2 else 2) * math.cos(k * math.pi / 8), 5 + (5 if k % 2 else 2) * math.sin(k * math.pi / 8)) for k in range(16)]
SHAPES = {1: [[SQUARE, HOLE]], 2: [[ELL]], 3: [[STAR[::-1]], [[(60.0, 0.0), (61.0, 0.0), (60.5, 1.0)]]]}


@pytest.fixture
def regions(spark):
    return spark.createDataFrame(list(SHAPES.items()), RINGS)


def within(polys, x, y):
    odd = False
    for ring in [r for p in polys for r in p]:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def clipped_area(ring, x0, y0, x1, y1):
    """A ring's area inside a box, by cutting the ring at each side in turn."""
    points = list(ring)
    for axis, limit, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for a, b in zip(points, points[1:] + points[:1], strict=True):
            ina, inb = (sign * (p[axis] - limit) >= 0 for p in (a, b))
            if ina != inb:
                t = (limit - a[axis]) / (b[axis] - a[axis])
                cut = [a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])]
                cut[axis] = limit
                out.append(tuple(cut))
            if inb:
                out.append(b)
        points = out
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True))) / 2


def pixels(spark, n, seed=0):
    rng = random.Random(seed)
    rows = [(i, rng.uniform(-1, 62), rng.uniform(-1, 11), None if i % 9 == 0 else rng.uniform(-1, 1)) for i in range(n)]
    rows += [(n, 0.0, 0.0, 1.0), (n + 1, 3.0, 3.0, 1.0), (n + 2, 10.0, 5.0, 1.0), (n + 3, None, 1.0, 1.0), (n + 4, 5.0, 5.0, 1.0), (n + 5, 6.0, 5.0, 1.0)]
    return rows, spark.createDataFrame(rows, "id int, lon double, lat double, v double")


@pytest.mark.parametrize("tile", [0.7, 1.0, 50.0])
def test_pixels_in_shapes_with_holes(spark, regions, tile):
    rows, df = pixels(spark, 1500)
    got = {(r.id, r.region_id) for r in polygons.in_regions(df, regions, tile).collect()}
    assert got == {(i, k) for i, x, y, _ in rows if x is not None for k, p in SHAPES.items() if within(p, x, y)}


def test_index_has_no_cross_join_and_splits_hot_tiles(spark, regions, monkeypatch):
    rows, df = pixels(spark, 800)
    hot = [(10_000 + i, 2.5, 2.5, 0.5) for i in range(3000)]
    df = df.unionByName(spark.createDataFrame(hot, df.schema))
    monkeypatch.setattr(polygons, "BROADCAST_ROWS", 0)
    out = polygons.in_regions(df, regions, 1.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = {(i, k) for i, x, y, _ in rows if x is not None for k, p in SHAPES.items() if within(p, x, y)} | {(i, 1) for i, *_ in hot}
    assert sorted((r.id, r.region_id) for r in out.collect()) == sorted(want)


def test_shares_against_cut_polygons(spark, regions):
    rows, df = pixels(spark, 600, 3)
    half = 0.45
    got = {}
    for r in polygons.coverage(df, regions, 1.0, half).collect():
        share, centre = got.get((r.id, r.region_id), (0.0, False))
        got[r.id, r.region_id] = (share + r.share, centre or r.centre)
    for i, x, y, _ in rows:
        for k, polys in SHAPES.items():
            if x is None:
                assert (i, k) not in got
                continue
            box = (x - half, y - half, x + half, y + half)
            area = sum((1 if j == 0 else -1) * clipped_area(ring, *box) for p in polys for j, ring in enumerate(p)) / (4 * half * half)
            share, centre = got.get((i, k), (0.0, False))
            assert share == pytest.approx(area, abs=1e-9) and centre == within(polys, x, y)


def test_shares_over_a_tiling_add_up_to_the_pixel(spark):
    """Regions that tile the plane with slanted borders."""
    strips = [(k, [[[(3.0 * k, 0.0), (3.0 * k + 3, 0.0), (3.0 * k + 4.3, 9.0), (3.0 * k + 1.3, 9.0)]]]) for k in range(5)]
    regions = spark.createDataFrame(strips, RINGS)
    df = spark.createDataFrame([(i, 3 + (i * 0.37) % 9, 1 + (i * 0.61) % 7, 1.0) for i in range(300)], "id int, lon double, lat double, v double")
    sums = polygons.coverage(df, regions, 0.8, 0.3).groupBy("id").agg(F.sum("share").alias("s")).collect()
    assert len(sums) == 300 and all(r.s == pytest.approx(1.0, abs=1e-9) for r in sums)


def test_weighted_statistics(spark, regions):
    rows, df = pixels(spark, 500, 5)
    got = {r.region_id: r for r in polygons.zonal_weighted(polygons.coverage(df, regions, 1.0, 0.4), ("region_id",), "v").collect()}
    for k, polys in SHAPES.items():
        w = []
        for _, x, y, v in rows:
            if x is not None and v is not None:
                box = (x - 0.4, y - 0.4, x + 0.4, y + 0.4)
                w.append((sum((1 if j == 0 else -1) * clipped_area(ring, *box) for p in polys for j, ring in enumerate(p)) / 0.64, v))
        total = sum(a for a, _ in w)
        mean = sum(a * v for a, v in w) / total
        assert got[k].weight == pytest.approx(total) and got[k].v_mean == pytest.approx(mean)
        assert got[k].v_std == pytest.approx(math.sqrt(sum(a * (v - mean) ** 2 for a, v in w) / total))


def test_odd_regions(spark):
    odd = [(1, None), (2, []), (3, [[]]), (4, [[[(0.0, 0.0), (1.0, 1.0)]]]), (5, [[[(0.0, 0.0), None, (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]]])]
    df = spark.createDataFrame([(1, 1.0, 1.0, 3.0)], "id int, lon double, lat double, v double")
    assert [r.region_id for r in polygons.in_regions(df, spark.createDataFrame(odd, RINGS), 1.0).collect()] == [5]
    assert polygons.in_regions(df, spark.createDataFrame([], RINGS), 1.0).count() == 0


def test_published_points(spark):
    """Worked examples of national surveys' manuals: a zone on Clarke's ellipsoid of 1866 and the British grid on Airy's."""
    clarke = projection.TransverseMercator(-75.0, 0.0, 0.9996, 0.0, 0.0, 6378206.4, 1 / (1 - math.sqrt(1 - 0.00676866)))
    airy = projection.TransverseMercator(-2.0, 49.0, 0.9996012717, 400000.0, -100000.0, 6377563.396, 6377563.396 / (6377563.396 - 6356256.909))
    cases = [(clarke, -73.5, 40.5, 127106.5, 4484124.4, 0.06), (airy, 1 + 43 / 60 + 4.5177 / 3600, 52 + 39 / 60 + 27.2531 / 3600, 651409.903, 313177.270, 0.002)]
    for p, lon, lat, east, north, near in cases:
        df = spark.createDataFrame([(lon, lat)], "lon double, lat double")
        r = df.select(*[c.alias(n) for c, n in zip(projection.forward(F.col("lon"), F.col("lat"), p), "xy", strict=True)]).first()
        assert abs(r.x - east) < near and abs(r.y - north) < near


def test_round_trip_under_a_millimetre(spark):
    zone = projection.utm(43)
    df = spark.createDataFrame([(75 + dx, lat) for dx in (-6.0, -3.0, -0.01, 0.0, 1.0, 4.5) for lat in (-80.0, -30.0, 0.0, 28.5, 60.0, 84.0)], "lon double, lat double")
    df = df.withColumns(dict(zip("xy", projection.forward(F.col("lon"), F.col("lat"), zone), strict=True)))
    df = df.withColumns(dict(zip(("lon2", "lat2"), projection.inverse(F.col("x"), F.col("y"), zone), strict=True)))
    for r in df.collect():
        metres = math.hypot((r.lon2 - r.lon) * 111_320 * math.cos(math.radians(r.lat)), (r.lat2 - r.lat) * 111_320)
        assert metres < 1e-3
    poles = spark.createDataFrame([(80.0, 90.0), (None, 1.0)], "lon double, lat double").select(projection.forward(F.col("lon"), F.col("lat"), zone)[1].alias("y")).collect()
    assert poles[0].y == pytest.approx(9_997_964.943, abs=0.01) and poles[1].y is None


def test_resampling_keeps_the_sum(spark):
    rows = [(x, y, float(x * 3 + y)) for x in range(-6, 6) for y in range(-6, 6)]
    df = spark.createDataFrame(rows, "px long, py long, v double")
    for to in (2.0, 3.0, 4.5, 1.0, 0.75):
        out = projection.resampled(df, 1.5, to, ("v",)).collect()
        assert sum(r.v * r.area * to * to for r in out) == pytest.approx(sum(v for *_, v in rows) * 2.25)
    same = {(r.px, r.py): r.v for r in projection.resampled(df, 1.5, 1.5, ("v",)).collect()}
    assert same == {(x, y): v for x, y, v in rows}


def test_nearest_of_a_hundred_thousand_nodes(spark):
    """Dense clusters, repeated places, ties, and cells far from all nodes; against all pairs in blocks."""
    import numpy as np

    rng = np.random.default_rng(1)
    at = np.concatenate([rng.normal(0, 0.01, (60_000, 2)), rng.uniform(-50, 50, (39_990, 2)), np.repeat([[7.0, 7.0]], 10, 0)]).round(4)
    cells = np.concatenate([rng.uniform(-60, 60, (300, 2)), rng.normal(0, 0.01, (100, 2)), [[7.0, 7.0], [500.0, 500.0]]]).round(4)
    nodes = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)] + [(-1, None, 0.0)], "node long, node_lon double, node_lat double")
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(cells)] + [(9999, None, 0.0)], "cell_id int, centroid_lon double, centroid_lat double")
    out = nearest.nearest_node(df, nodes)
    assert not any(w in out._jdf.queryExecution().executedPlan().toString() for w in ("Cartesian", "NestedLoop"))
    got = {r.cell_id: r.node for r in out.collect()}
    want = {}
    for i, (x, y) in enumerate(cells):
        d = (at[:, 0] - x) ** 2 + (at[:, 1] - y) ** 2
        want[i] = int(np.argmin(d))
    want[9999] = None
    assert got == want


@pytest.mark.parametrize("limit", [0, 50_000])
def test_nearest_by_broadcast_and_by_shuffle(spark, monkeypatch, limit):
    monkeypatch.setattr(nearest, "BROADCAST_ROWS", limit)
    nodes = [(k, (k * 7919 % 101) / 7.0, (k * 31 % 97) / 5.0) for k in range(900)]
    cells = [(i, (i * 13 % 50) / 3.0, (i * 7 % 60) / 3.0) for i in range(200)]
    got = nearest.nearest_node(spark.createDataFrame(cells, "cell_id int, centroid_lon double, centroid_lat double"), spark.createDataFrame(nodes, "node int, node_lon double, node_lat double"), 4)
    want = {i: min(((a - x) ** 2 + (b - y) ** 2, k) for k, a, b in nodes)[1] for i, x, y in cells}
    assert {r.cell_id: r.node for r in got.collect()} == want


@pytest.mark.parametrize("most", [None, 40])
def test_nearest_moves_cells_once(spark, monkeypatch, most):
    """No pair of a cell and a tile or node is shuffled; with few cells and nodes allowed in a task, several tasks share a box."""
    import numpy as np

    if most:
        monkeypatch.setattr(nearest, "CELLS", most)
        monkeypatch.setattr(nearest, "NODES", most)
    rng = np.random.default_rng(4)
    turn = np.arange(300) / 300 * 2 * np.pi
    at = np.concatenate([np.stack([np.cos(turn), np.sin(turn)], 1) * 40, rng.normal(20, 0.05, (1500, 2)), rng.integers(-9, 9, (600, 2))])
    cells = np.concatenate([np.zeros((90, 2)), rng.normal(20, 0.05, (200, 2)), rng.integers(-9, 9, (200, 2)) + 0.5, rng.uniform(-400, 400, (150, 2)), [[1e6, -3.0], [float("inf"), 1.0], [0.0, float("nan")]]])
    nodes = spark.createDataFrame([(f"n{i * 7 % 2400:05d}", float(x), float(y)) for i, (x, y) in enumerate(at)], "node string, node_lon double, node_lat double")
    out = nearest.nearest_node(spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(cells)], "cell_id int, centroid_lon double, centroid_lat double"), nodes)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Cartesian", "NestedLoop", "Window")) and ("SortAggregate" in plan) == bool(most)
    names = np.array([i * 7 % 2400 for i in range(len(at))])
    want = {}
    for i, (x, y) in enumerate(cells):
        d = np.nan_to_num((at[:, 0] - x) ** 2 + (at[:, 1] - y) ** 2, nan=np.inf)
        want[i] = f"n{names[d == d.min()].min():05d}"
    got = out.collect()
    assert len(got) == len(cells) and {r.cell_id: r.node for r in got} == want


def test_nearest_without_nodes_gives_nulls(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0)], "cell_id int, centroid_lon double, centroid_lat double")
    assert [tuple(r) for r in nearest.nearest_node(df, spark.createDataFrame([], "node int, node_lon double, node_lat double")).collect()] == [(1, None, None, None)]


def test_collection_scan_opens_only_matching_files(spark, tmp_path):
    scenes = [(i, f"2024-{1 + i % 12:02d}", i % 4, i % 100, i % 4 * 10.0) for i in range(480)]
    df = spark.createDataFrame(scenes, "scene_id int, month string, tile int, cloud_pct int, min_x double").selectExpr("*", "to_date(month || '-15') AS date", "0.0D AS min_y", "min_x + 10 AS max_x", "10.0D AS max_y")
    px = spark.createDataFrame([(i % 480, i, 0.5) for i in range(4800)], "scene_id int, px int, value double")
    path = f"{tmp_path}/c"
    catalogue.write_collection(df, px, path)
    wanted = catalogue.SceneFilter("2024-02-01", "2024-04-01", (12.0, 0.0, 18.0, 5.0), 50.0)
    out = catalogue.collection_scan(spark, path, wanted)
    rows = out.collect()
    keep = {i for i, m, t, c, _ in scenes if m in ("2024-02", "2024-03") and t == 1 and c <= 50}
    assert keep and {r.scene_id for r in rows} == keep and len(rows) == 10 * len(keep)
    plan = out._jdf.queryExecution().executedPlan()
    assert "dynamicpruning" in plan.toString()
    folders = catalogue.folders_read(spark, path, wanted).count()
    assert 0 < files_read(plan) <= folders < 10
    with pytest.raises(ValueError, match="no scene"):
        catalogue.collection_scan(spark, path, catalogue.SceneFilter(start="2030-01-01"), strict=True)


def files_read(plan):
    """How many files the scan of the pixels' layout opened, by its metrics."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return files_read(plan.executedPlan())
    if "QueryStage" in name:
        return files_read(plan.plan())
    if name.startswith("Scan parquet"):
        return plan.metrics().apply("numFiles").value() if "dynamicpruning" in plan.toString() else 0
    kids = plan.children()
    return sum(files_read(kids.apply(i)) for i in range(kids.size()))


def flood(cells):
    """Components of (row, col) by rook adjacency, as sets."""
    left, out = set(cells), []
    while left:
        todo, one = [left.pop()], set()
        while todo:
            r, c = todo.pop()
            one.add((r, c))
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        out.append(one)
    return out


def test_nested_events_are_cuts_of_one_forest(spark, monkeypatch):
    monkeypatch.setattr(events, "TILE", 5)
    rng = random.Random(4)
    level = {(m, r, c): rng.choice([None, 0.5, 1.0, 2.2, 3.0, 4.5, math.inf]) for m in ("a", "b") for r in range(17) for c in range(13)}
    rows = [(m, f"{r}-{c}", r, c, v) for (m, r, c), v in level.items() if v is not None]
    df = spark.createDataFrame(rows, "month string, cell_id string, row int, col int, level double")
    taus = (1.0, 2.0, 3.0, 4.0)
    got = {}
    for r in events.nested_event_cells(df, taus).collect():
        got.setdefault((r.month, r.tau, tuple(r.first)), set()).add((r.row, r.col))
    for m in "ab":
        for tau in taus:
            want = sorted(map(sorted, flood({(r, c) for (k, r, c), v in level.items() if k == m and v is not None and v >= tau})))
            assert sorted(sorted(s) for (k, t, _), s in got.items() if (k, t) == (m, tau)) == want
    assert all(first == min(s) for (_, _, first), s in got.items())


def test_forest_is_spanning_and_of_greatest_weight():
    rng = random.Random(9)
    rows, cols = zip(*[(r, c) for r in range(7) for c in range(7)], strict=True)
    levels = [rng.randint(1, 5) for _ in rows]
    forest = events.spanning_forest(list(rows), list(cols), levels)
    assert len(forest) == 48 and [e[0] for e in forest] == sorted((e[0] for e in forest), reverse=True)
    # of a connected graph, the sum over thresholds of (cells reaching it - components) is the greatest weight
    best = sum(len(on := {(r, c) for r, c, v in zip(rows, cols, levels, strict=True) if v >= t}) - len(flood(on)) for t in range(1, 6))
    assert sum(e[0] for e in forest) == best


def test_panel_refuses_repeated_keys(spark):
    keys = ("cell_00_00", "2024-01", "2024-01-01", "2024-02-01")
    schema = "cell_id string, month string, start_date string, end_date string"
    optical = spark.createDataFrame([(*keys, 0.1, 9), (*keys, 0.7, 2)], f"{schema}, ndvi_mean double, valid_pixel_count long")
    lights = spark.createDataFrame([(*keys, 3.0)], f"{schema}, viirs_avg_rad_mean double")
    weather = spark.createDataFrame([(*keys, 20.0)], f"{schema}, era5_temperature_mean double")
    with pytest.raises(Exception, match="repeats the key cell_00_00 2024-01"):
        panel.build_panel(optical, lights, weather).count()
    row = panel.build_panel(optical.limit(1), lights, weather).first()
    assert row.ndvi_mean == 0.1 and row.viirs_avg_rad_mean == 3.0 and list(row.asDict()) == PANEL.names
