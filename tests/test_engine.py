"""Small fixtures for the grid engine: the edge cases of each operator."""

import math

import pytest
from gridwatch import functions as G
from gridwatch import sources
from gridwatch.operators import climatology, events, grid, panel, profile, rasters, scoring
from gridwatch.schemas import CORE, PANEL, EngineConfig
from pyspark.sql import functions as F


def panel_rows(spark, rows):
    """rows: (cell, month, {column: value}); all else missing."""
    full = [tuple({"cell_id": c, "month": m, "start_date": f"{m}-01", "end_date": f"{m}-28", **v}.get(n) for n in PANEL.names) for c, m, v in rows]
    return spark.createDataFrame(full, PANEL)


def test_climatology_profiles(spark):
    tiny = [1.00001, 1.00002, 1.00003]
    rows = [("a", f"{y}-05", {"ndvi_mean": v, "ndbi_mean": 5.0 if y == 2000 else None, "ndwi_mean": t}) for y, v, t in zip((2000, 2001, 2002), (1.0, 2.0, 4.0), tiny, strict=True)]
    got = {r.feature: r for r in climatology.seasonal_climatology(panel_rows(spark, rows)).collect()}
    a, one, none, small = got["ndvi_mean"], got["ndbi_mean"], got["viirs_avg_rad_mean"], got["ndwi_mean"]
    assert (a.n_observations, a.median, a.mad, a.q1, a.q3, a.zero_mad_flag) == (3, 2.0, 1.0, 1.5, 3.0, False)
    assert (one.n_observations, one.std, one.mad, one.zero_mad_flag) == (1, 0.0, 0.0, True)
    assert (none.n_observations, none.median, none.zero_mad_flag) == (0, None, False)
    assert (small.mad, small.zero_mad_flag) == (0.0, False)  # the flag is set before rounding
    assert len(got) == 7


def test_scores(spark):
    prof = [("a", 1, f, 3, 2.0, m, z) for f, m, z in (("ndvi_mean", 1.0, False), ("ndbi_mean", 0.0, True), ("ndwi_mean", 0.0, True))] + [("a", 1, "viirs_avg_rad_mean", 0, None, None, False)]
    clim = spark.createDataFrame(prof, "cell_id string, calendar_month int, feature string, n_observations long, median double, mad double, zero_mad_flag boolean")
    p = panel_rows(spark, [("a", "2001-01", {"ndvi_mean": 6.0, "ndbi_mean": 2.0, "ndwi_mean": 3.0, "viirs_avg_rad_mean": 1.0})])
    got = {r.feature: r for r in scoring.score(p, clim).collect()}
    assert math.isclose(got["ndvi_mean"].robust_z, 4 / 1.4826) and got["ndvi_mean"].modality_category == "optical"
    assert got["ndbi_mean"].robust_z is None and not got["ndbi_mean"].zero_mad_deviation
    assert got["ndwi_mean"].robust_z is None and got["ndwi_mean"].zero_mad_deviation
    assert got["viirs_avg_rad_mean"].residual is None and got["viirs_avg_rad_mean"].baseline_n == 0
    assert got["era5_temperature_mean"].observed_value is None and got["era5_temperature_mean"].baseline_n == 0


def test_evidence_and_dominance(spark):
    cols = "cell_id string, month string, feature string, observed_value double, median double, residual double, abs_robust_z double, absolute_deviation double, zero_mad_deviation boolean, baseline_n long, modality_category string"
    row = lambda c, f, z, n=3: (c, "m", f, 1.0, 0.0, -1.0 if f == "ndbi_mean" else 1.0, z, 1.0, False, n, CORE[f])
    scores = spark.createDataFrame([row("opt", "ndvi_mean", 5.0), row("opt", "ndbi_mean", 5.0), row("half", "ndvi_mean", 5.0), row("half", "ndbi_mean", 0.1), row("few", "ndvi_mean", 9.0, 1), row("air", "era5_temperature_mean", 9.0), row("light", "viirs_avg_rad_mean", 4.0)], cols)
    skel = spark.createDataFrame([(c, "m") for c in ("opt", "half", "few", "air", "light", "none")], "cell_id string, month string")
    e = {r.cell_id: r for r in scoring.evidence(scores, skel).collect()}
    assert [e[c].activity_candidate for c in ("opt", "half", "few", "air", "light", "none")] == [True, True, False, False, True, False]
    assert e["half"].activity_score == 0.5 and e["air"].weather_count == 1 and e["none"].optical_available == 0
    d = {r.cell_id: r for r in scoring.dominant_feature(scores, skel).collect()}
    assert d["opt"].dominant_feature == "ndvi_mean" and d["opt"].dominant_direction == "positive"  # the tie goes to the first
    assert (d["none"].dominant_feature, d["none"].dominant_direction, d["air"].dominant_feature) == ("none", "neutral", "none")


@pytest.mark.parametrize("cells, sizes", [([(0, 0)], [1]), ([(0, 0), (1, 0), (1, 1)], [3]), ([(0, 0), (1, 1)], [1, 1]), ([(0, 0), (0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (2, 2)], [8]), ([(22, c) for c in range(20)], [20]), ([(0, 0), (22, 19)], [1, 1])])
def test_components(spark, cells, sizes):
    rows = [(m, f"cell_{r:02d}_{c:02d}", r, c) for m in ("2001-01", "2001-02") for r, c in cells]
    got = events.event_cells(spark.createDataFrame(rows, "month string, cell_id string, row int, col int")).groupBy("month", "event_number").count().orderBy("month", "event_number").collect()
    assert [r["count"] for r in got] == sizes * 2
    assert [r.event_number for r in got] == [*range(1, len(sizes) + 1)] * 2


def test_months(spark):
    spans = spark.sql("SELECT date'2023-11-17' AS start, date'2024-03-10' AS end")
    got = [tuple(r) for r in grid.month_ranges(spans).orderBy("month").collect()]
    assert got == [("2023-11", "2023-11-01", "2023-12-01", 30), ("2023-12", "2023-12-01", "2024-01-01", 31), ("2024-01", "2024-01-01", "2024-02-01", 31), ("2024-02", "2024-02-01", "2024-03-01", 29), ("2024-03", "2024-03-01", "2024-03-10", 31)]
    assert grid.month_ranges(spark.sql("SELECT date'2022-04-01' AS start, date'2025-04-01' AS end")).count() == 36


def test_grid_tiles_its_bounds(spark):
    g = grid.generate_grid(spark.sql("SELECT 77.10D AS min_lon, 28.55D AS min_lat, 77.20D AS max_lon, 28.65D AS max_lat"), 500).toPandas()
    assert g["min_lon"].min() == 77.10 and g["max_lon"].max() == 77.20 and g["max_lat"].max() == 28.65
    assert len(g) == (g["row"].max() + 1) * (g["col"].max() + 1) == g["cell_id"].nunique() and g["approx_width_m"].max() <= 500


def test_scene_limits(spark):
    rows = [("none_low", 30.0), ("none_low", 60.0), ("clean", 20.0), ("clean", 30.0), ("all_high", 50.0)]
    s = spark.createDataFrame(rows, "month string, cloud_pct double")
    got = {r.month: (r.raw_scenes, r.clean_scenes, r.used_limit, r.used_scenes) for r in rasters.scene_counts(s, EngineConfig()).collect()}
    assert got == {"none_low": (2, 0, 40.0, 1), "clean": (2, 1, 20.0, 1), "all_high": (1, 0, None, 0)}
    assert {r.month for r in rasters.usable_scenes(s, EngineConfig(inclusive=False)).collect()} == {"none_low", "clean"}
    with pytest.raises(ValueError):
        rasters.usable_scenes(s.filter("month = 'all_high'"), EngineConfig(), strict=True)


def test_scalars(spark):
    df = spark.sql("SELECT * FROM VALUES (0D, 0D), (1e-5D, 0D), (2e-5D, 0D), (NULL, 1D) AS t(a, b)")
    assert [r[0] for r in df.select(G.normalized_difference(F.col("a"), F.col("b"))).collect()] == [None, None, 1.0, None]
    one = spark.sql("SELECT CAST(NULL AS double) AS n, 0D AS z, -1D AS neg, 1.5D AS big, '2001-03' AS m")
    r = one.select(G.clipped_fraction(F.col("n")), G.clipped_fraction(F.col("big")), G.safe_ratio(F.col("z"), F.col("z")), G.direction(F.col("n")), G.direction(F.col("neg")), G.event_id(F.col("m"), F.lit(7)), G.is_anomalous(F.col("n"), F.lit(False), F.lit(3.0)), G.valid_fraction(F.col("n"), 625)).first()
    assert tuple(r) == (1.0, 1.0, 0.0, "negative", "negative", "EVT_200103_007", False, 0.0)


def test_baselines_look_back_three_rows(spark):
    p = panel_rows(spark, [("a", f"2000-{m:02d}", {"ndvi_mean": v}) for m, v in enumerate((1.0, None, 3.0, 5.0, None, None, None, 9.0), 1)])
    got = {r.baseline_name: r for r in profile.baseline_comparison(p).filter("feature = 'ndvi_mean'").collect()}
    assert got["C_lagged_mean"].n_eval_obs == 2  # months 3 and 4; the window before month 8 is all missing
    assert math.isclose(got["C_lagged_mean"].mae, (2.0 + 3.0) / 2)
    assert got["B_median"].mae == got["D_robust"].mae


def test_panel_keeps_cells_of_one_modality(spark):
    p = panel_rows(spark, [("a", "2000-01", {"ndvi_mean": 1.0}), ("b", "2000-01", {"viirs_avg_rad_mean": 2.0}), ("c", "2000-01", {"era5_temperature_mean": 3.0})])
    part = lambda cell, prefix: p.filter(F.col("cell_id") == cell).select("cell_id", "month", "start_date", "end_date", *[c for c in PANEL.names[4:] if c.startswith(prefix)])
    got = panel.build_panel(part("a", ("nd", "valid")), part("b", "viirs"), part("c", "era5"))
    assert got.columns == PANEL.names and sorted((r.cell_id, r.ndvi_mean, r.viirs_avg_rad_mean, r.era5_temperature_mean) for r in got.collect()) == [("a", 1.0, None, None), ("b", None, 2.0, None), ("c", None, None, 3.0)]


def test_constant_columns_have_no_correlation(spark):
    p = panel_rows(spark, [("a", f"2000-0{m}", {f: float(m) if f != "ndbi_mean" else 1.0 for f in CORE}) for m in range(1, 6)])
    r = {(x.feature_x, x.feature_y): x.r for x in profile.spearman(p).collect()}
    assert r["ndvi_mean", "ndwi_mean"] == 1.0 and r["ndvi_mean", "ndbi_mean"] is None


def test_files_round_trip_with_missing_as_null(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", float("nan")), ("c", None)], "cell_id string, v double")
    sources.write_parquet(df, f"{tmp_path}/p")
    sources.write_csv(sources.nan_to_null(df), f"{tmp_path}/c")
    want = [("a", 1.0), ("b", None), ("c", None)]
    assert sorted(tuple(r) for r in sources.read_parquet(spark, f"{tmp_path}/p").collect()) == want
    assert sorted(tuple(r) for r in sources.read_csv(spark, f"{tmp_path}/c", df.schema).collect()) == want
    g = grid.generate_grid(spark.sql("SELECT 0D AS min_lon, 0D AS min_lat, 0.02D AS max_lon, 0.02D AS max_lat"), 1000)
    sources.write_geojson_grid(g, f"{tmp_path}/g")
    assert '"Polygon"' in spark.read.text(f"{tmp_path}/g").first()[0]
    (tmp_path / "grid.geojson").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"cell_id": "cell_00_00", "row": 0, "min_lon": 1.5}}]}')
    assert sources.read_geojson_grid(spark, f"{tmp_path}/grid.geojson").select("cell_id", "row", "min_lon").first()[:] == ("cell_00_00", 0, 1.5)


def test_reuse_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert sources.reuse_or_build(spark, f"{tmp_path}/t", build).count() == sources.reuse_or_build(spark, f"{tmp_path}/t", build).count() == 3
    assert len(calls) == 1


def test_regression_and_duplicates(spark):
    a = panel_rows(spark, [("a", "2000-01", {"ndvi_mean": 1.0}), ("b", "2000-01", {"ndvi_mean": None})])
    b = panel_rows(spark, [("a", "2000-01", {"ndvi_mean": 1.5}), ("b", "2000-01", {"ndvi_mean": 2.0})])
    r = panel.regression_diff(a, b, ("ndvi_mean",)).first()
    assert (r.n_compared, r.max_diff, r.n_exceeding) == (1, 0.5, 1)
    assert sources.duplicate_keys(a.union(a.filter("cell_id = 'a'")), ("cell_id", "month")).count() == 1


def test_components_across_tiles(spark, monkeypatch):
    """The same events whatever the tiles' size: a spiral over many tiles, diagonals, single cells, two months."""
    import random

    rng = random.Random(5)
    spiral = [(r, c) for r in range(12) for c in range(12) if (r % 4 == 0) or (r % 4 == 1 and c == 11) or (r % 4 == 2) or (r % 4 == 3 and c == 0)]
    cells = [("2001-01", r, c) for r, c in spiral] + [("2001-02", r, c) for r in range(12) for c in range(12) if rng.random() < 0.55]
    df = spark.createDataFrame([(m, f"cell_{r:02d}_{c:02d}", r, c) for m, r, c in cells], "month string, cell_id string, row int, col int")
    found = {}
    for side in (256, 3, 1):
        monkeypatch.setattr(events, "TILE", side)
        found[side] = {(r.month, r.cell_id): r.event_number for r in events.event_cells(df).collect()}
    assert found[256] == found[3] == found[1] and len(found[256]) == len(cells)
    assert {n for (m, _), n in found[1].items() if m == "2001-01"} == {1}
    assert events.event_cells(df.limit(0)).count() == 0


def test_exact_ranks_and_quantiles(spark):
    import random

    import numpy as np
    from gridwatch.operators import ranks

    rng = random.Random(3)
    rows = [("a", rng.choice([0.0, -0.0, 1.5, rng.random()])) for _ in range(301)] + [("b", 7.0)] + [("c", None)] + [("d", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    got = {r.k: r.q for r in ranks.quantiles(df, ("k",), "v", shares).collect()}
    assert sorted(got) == ["a", "b", "d"]
    for k, q in got.items():
        assert np.allclose(q, np.quantile([v for x, v in rows if x == k], shares))
    assert {r.k: r.q for r in ranks.with_quantiles(df.select("k").distinct(), df, ("k",), "v", (0.5,)).collect()}["c"] is None
    both = spark.createDataFrame([(3.0, 1.0), (3.0, 2.0), (1.0, 2.0), (9.0, 2.0)], "x double, y double")
    assert sorted((r.x, r.y) for r in ranks.average_ranks(both, ("x", "y")).collect()) == [(1.0, 3.0), (2.5, 1.0), (2.5, 3.0), (4.0, 3.0)]
    assert ranks.quantiles(df.limit(0), ("k",), "v", (0.5,)).count() == 0


def test_config_overrides():
    from gridwatch.schemas import EngineConfig

    cfg = EngineConfig.from_environment({"GRIDWATCH_TAU": "2.5", "GRIDWATCH_INCLUSIVE": "false", "GRIDWATCH_CLEAR_CLASSES": "4, 5", "GRIDWATCH_BASELINE": "2020-01,2021-01", "TAU": "9"})
    assert (cfg.tau, cfg.inclusive, cfg.clear_classes, cfg.baseline, cfg.min_baseline) == (2.5, False, (4, 5), ("2020-01", "2021-01"), 2)
    assert EngineConfig.from_environment({}) == EngineConfig()


def test_regression_gate(spark):
    from gridwatch.operators import panel

    new = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "cell_id string, x double")
    moved = spark.createDataFrame([("k", 1.0), ("l", 2.5)], "cell_id string, x double")
    assert panel.regression_gate(new, new, ("x",)).first().n_exceeding == 0
    with pytest.raises(ValueError, match="x \\(1 of 2"):
        panel.regression_gate(panel.by_position(new), panel.by_position(moved), ("x",))
    with pytest.raises(ValueError, match="0 of 0"):
        panel.regression_gate(new, moved, ("x",))


def test_written_grid_reads_back(spark, tmp_path, monkeypatch):
    import json
    import os

    from gridwatch import sources
    from gridwatch.operators import grid

    monkeypatch.setattr(sources, "COLLECTION", 5)
    cells = grid.generate_grid(spark.createDataFrame([(0.0, 0.0, 4.0, 3.0)], "min_lon double, min_lat double, max_lon double, max_lat double"), 111_000)
    sources.write_geojson_grid(cells, f"{tmp_path}/grid")
    assert sorted(map(tuple, sources.read_geojson_grid(spark, f"{tmp_path}/grid").collect())) == sorted(map(tuple, cells.select("cell_id", "row", "col", "index", "centroid_lon", "centroid_lat", "min_lon", "max_lon", "min_lat", "max_lat", "approx_width_m", "approx_height_m").collect()))
    for name in os.listdir(f"{tmp_path}/grid"):
        if name.startswith("part") and os.path.getsize(f"{tmp_path}/grid/{name}"):
            one = json.load(open(f"{tmp_path}/grid/{name}"))
            assert one["type"] == "FeatureCollection" and 1 <= len(one["features"]) <= 5 and one["features"][0]["geometry"]["coordinates"][0][0] == one["features"][0]["geometry"]["coordinates"][0][4]


def test_nearest_node_with_any_depth_of_tiles(spark):
    import random

    from gridwatch.operators.nearest import nearest_node

    rng = random.Random(4)
    cells = spark.createDataFrame([(f"c{i}", rng.random() * 9, rng.random() * 9) for i in range(60)], "cell_id string, centroid_lon double, centroid_lat double")
    nodes = spark.createDataFrame([(i, float(round(rng.random() * 9)), float(round(rng.random() * 9))) for i in range(40)], "node long, node_lon double, node_lat double")
    one = sorted(map(tuple, nearest_node(cells, nodes, leaf=100).collect()))
    assert sorted(map(tuple, nearest_node(cells, nodes, leaf=1).collect())) == one and len(one) == 60


def test_months_close_once_whatever_comes(spark, tmp_path):
    """Shuffled, repeated and late files, and a restart between any two batches."""
    import random

    from gridwatch.streaming.closing import close_months

    grid = spark.createDataFrame([(f"c{r}-{c}", r, c) for r in range(5) for c in range(4)], "cell_id string, row int, col int")
    cells = [f"c{r}-{c}" for r in range(5) for c in range(4)]
    rows = [(m, c) for m in ("2024-01", "2024-02") for c in cells] + [("2024-03", c) for c in cells[:-1]]
    random.Random(3).shuffle(rows)
    src, made = f"{tmp_path}/in", []

    def events_of(months):
        made.extend(months)
        return spark.createDataFrame([(m, len(m)) for m in months], "month string, n int")

    def arrive(some):
        spark.createDataFrame(some, "month string, cell_id string").coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema("month string, cell_id string").option("maxFilesPerTrigger", 1).parquet(src)
        close_months(stream, grid, f"{tmp_path}/tiles", events_of, f"{tmp_path}/out", f"{tmp_path}/cp", tile=2).awaitTermination()

    arrive(rows[:30])
    arrive(rows[10:35])  # some of them again
    run()
    early = list(made)
    arrive(rows[35:])
    run()  # a new query on the same checkpoint
    assert sorted(made) == ["2024-01", "2024-02"]
    arrive(rows)  # late, all once more
    arrive([("2024-03", cells[-1]), (None, cells[0]), ("2024-03", "elsewhere")])
    run()
    run()
    assert sorted(made) == ["2024-01", "2024-02", "2024-03"] and made[: len(early)] == early
    got = sorted((r.month, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("2024-01", 7), ("2024-02", 7), ("2024-03", 7)]


def test_refresh_builds_changed_months_alone(spark, tmp_path):
    from gridwatch.sources import months as M

    path, built = f"{tmp_path}/t", []

    def build(given):
        seen = sorted(r.month for r in given["a"].select("month").distinct().collect())
        built.append(seen)
        return given["a"].groupBy("month").agg(F.sum("v").alias("v"))

    def table(**more):
        values = {"2024-01": [1.0, 2.0], "2024-02": [3.0], "2024-03": [None, 4.0]} | more
        return spark.createDataFrame([(m.replace("_", "-"), v) for m, vs in values.items() for v in vs], "month string, v double")

    rows = lambda version=None: {r.month: r.v for r in M.read_months(spark, path, version).collect()}
    assert M.refresh(spark, path, {"a": table()}, build) == ["2024-01", "2024-02", "2024-03"]
    assert M.refresh(spark, path, {"a": table().repartition(3)}, build) == [] and len(built) == 1  # the same rows in another order
    assert M.refresh(spark, path, {"a": table(**{"2024-02": [3.0, 3.0]})}, build) == ["2024-02"] and built[-1] == ["2024-02"]
    assert rows() == {"2024-01": 3.0, "2024-02": 6.0, "2024-03": 4.0} and rows(1)["2024-02"] == 3.0
    assert M.refresh(spark, path, {"a": table()}, build, {"cloud": 20}) == ["2024-01", "2024-02", "2024-03"]  # other settings
    left = table().filter("month <> '2024-01'")
    assert M.refresh(spark, path, {"a": left}, build, {"cloud": 20}) == [] and set(rows()) == {"2024-02", "2024-03"}

    def broken(given):
        return build(given).withColumn("v", F.raise_error(F.lit("no")).cast("double"))

    before = rows()
    with pytest.raises(Exception, match="no"):
        M.refresh(spark, path, {"a": table(**{"2024-03": [9.0]})}, broken, {"cloud": 20})
    assert rows() == before


def test_state_of_a_climatology_merges_without_the_old_panel(spark):
    import random

    from gridwatch.operators import climatology as C

    rng = random.Random(1)
    rows = [(f"c{c}", f"20{y}-{m:02d}", None if rng.random() < 0.2 else rng.choice([0.5, rng.uniform(-1, 1)])) for c in range(4) for y in range(10, 16) for m in (1, 2)]
    panel = spark.createDataFrame(rows, "cell_id string, month string, v double")
    state = C.profile_state(panel.filter("month < '2014'"), ("v",))
    wrong = panel.filter("month LIKE '2014%'").withColumn("v", F.lit(99.0))
    for new in (wrong, panel.filter("month LIKE '2014%'"), panel.filter("month LIKE '2015%'"), panel.filter("month LIKE '2015%'")):
        state = C.merged_state(state, C.profile_state(new, ("v",)))
    want = {tuple(r) for r in C.seasonal_climatology(panel, ("v",)).collect()}
    assert {tuple(r) for r in C.climatology_of(state).collect()} == want


def test_two_hundred_columns_in_one_pass(spark):
    """Correlations by merged co-moments against numpy, with missing values, a constant column and large offsets."""
    import numpy as np
    from gridwatch.operators.moments import correlations

    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (600, 200)) @ rng.normal(0, 0.3, (200, 200)) + rng.normal(0, 1e6, 200)
    x[:, 7] = 0.1
    x[rng.random(x.shape) < 0.1] = np.nan
    names = tuple(f"f{i}" for i in range(200))
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in r] for r in x], ", ".join(f"{n} double" for n in names)).repartition(7)
    got = {(r.feature_x, r.feature_y): r.r for r in correlations(df, names, digits=8).collect()}
    assert len(got) == 200 * 200 and got["f7", "f3"] is None and got["f7", "f7"] is None
    for i, j in [(0, 1), (5, 199), (13, 13), (150, 42), (8, 9)]:
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert got[names[i], names[j]] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-7)
    assert correlations(df.limit(0), names[:3]).collect() == []
