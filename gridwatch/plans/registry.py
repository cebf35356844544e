"""Queries by name, each (spark, sf_dir) -> DataFrame, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions as G
from .. import streaming
from ..operators import climatology as C
from ..operators import evaluate, events, grid, nearest, panel, polygons, profile, projection, rasters, scoring
from ..schemas import CORE, OPTICAL, PANEL, PRIMARY
from ..session import shared_folder, written
from ..sources import catalogue, duplicate_keys, months, probe, read_csv, read_geojson_grid, read_parquet, reuse_or_build, shape_check, write_csv, write_geojson_grid, write_parquet
from ..streaming import closing
from . import adapter as A
from .sql import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
#: A lower tau and a larger least baseline than the defaults', so that the stand-in data has events and gaps.
CONFIG = replace(A.CONFIG, tau=2.0, min_baseline=3)


def _r4(df, digits=4):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _base(s, d):
    return A.horizon(A.full_panel(s, d), A.CONFIG.baseline)


def _clim(s, d):
    return C.seasonal_climatology(_base(s, d))


def _horizons(s, d):
    """Baseline and operational rows of one written panel."""
    p = written(A.full_panel(s, d), "panel")
    return A.horizon(p, A.CONFIG.baseline), A.horizon(p, A.CONFIG.operational)


def _scored(s, d):
    """Scores and the operational rows that they come from."""
    base, oper = _horizons(s, d)
    return written(scoring.score(oper, C.seasonal_climatology(base), CONFIG), "scores"), oper


def _fused(s, d):
    scores, oper = _scored(s, d)
    return written(scoring.evidence(scores, oper.select("cell_id", "month"), CONFIG), "evidence"), scores, oper


def _cells_of(s, d, evidence):
    return events.event_cells(evidence.filter("activity_candidate").join(A.cells(s, d).select("cell_id", "row", "col"), "cell_id"))


def _event_cells(s, d):
    return _cells_of(s, d, _fused(s, d)[0])


def _spatial_events(s, d):
    evidence, scores, oper = _fused(s, d)
    dominant = scoring.dominant_feature(scores, oper.select("cell_id", "month"), CONFIG).drop("dominant_value")
    geometry = A.cells(s, d).drop("row", "col", "nation", "region")
    return events.spatial_events(_cells_of(s, d, evidence).drop("row", "col"), evidence, dominant, geometry)


def _monthly_anomalies(s, d):
    evidence = _fused(s, d)[0]
    return events.monthly_anomalies(evidence, _cells_of(s, d, evidence))


def _diagnostic(s, d):
    base, oper = _horizons(s, d)
    return C.month_diagnostic(oper, C.seasonal_climatology(base), "2001-03")


def _dominant(s, d):
    scores, oper = _scored(s, d)
    return scoring.dominant_feature(scores, oper.select("cell_id", "month"), CONFIG)


def _perturbed(s, d):
    base = _horizons(s, d)[0]
    return evaluate.perturbation_benchmark(base, C.seasonal_climatology(base), s)


def _indices(s, d):
    return rasters.optical_indices(A.pixels(s, d, rasters.usable_scenes(A.scenes(s, d), A.CONFIG)), A.CONFIG)


def _normalized(s, d):
    aggs = [e for i in rasters.INDICES for e in (F.count(i).alias(f"{i}_valid"), F.round(F.avg(i), 4).alias(f"{i}_mean"))]
    return _indices(s, d).groupBy("month").agg(F.count("*").alias("n_pixels"), *aggs)


def _zonal(s, d):
    return _r4(rasters.zonal_optical(rasters.median_composite(_indices(s, d)), A.CONFIG)).select("cell_id", "month", *OPTICAL, "valid_pixel_count", "valid_pixel_fraction")


def _hourly(s, d):
    e, k = A.table(s, d, "events"), F.col("user_id")
    h = e.select(
        (k % 5).alias("node"), F.date_format("ts", "yyyy-MM").alias("month"), F.dayofmonth(F.last_day("ts")).alias("days_in_month"), (F.col("value") * 0.0123456789 + 273.15).alias("t2m_k"), (F.col("event_id") % 100 / 10000).alias("tp_m"),
        (k % 21 - 10).cast("double").alias("u10"), (F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0)) - 3).alias("v10"),
    )
    monthly = _r4(rasters.hourly_to_monthly(h, ("node", "month", "days_in_month")))
    return monthly.withColumns({"expected_hours": (F.col("days_in_month") * 24).cast("long"), "completeness_ratio": F.round(F.col("era5_observation_count") / (F.col("days_in_month") * 24), 4)})


def _nearest(s, d):
    n = A.scenes(s, d).groupBy("cell_id").agg(F.count("*").alias("n_scenes"))
    return nearest.nearest_node(A.cells(s, d), A.nodes(s, d)).join(n, "cell_id")


def _grid(s, d):
    b = A.table(s, d, "events").agg(F.min("value").alias("min_lon"), F.max("value").alias("max_lon"), F.lit(20.0).alias("min_lat"), (F.lit(20.0) + F.max("user_id") / 1000.0).alias("max_lat"))
    return grid.generate_grid(b, 1_000_000)


def _pixel_cells(edge):
    def run(s, d):
        p = A.table(s, d, "events").select("event_id", (F.col("event_id") % 1000 / 37.0).alias("lon"), (F.col("user_id") % 1000 / 41.0).alias("lat"))
        return grid.assign_cells(p, 1.0, 1.0, 3.5, 2.5, 6, 8, edge, 0.4).groupBy("cell_id").agg(F.count("*").alias("n_pixels"))

    return run


def _regression(s, d):
    p = written(A.full_panel(s, d), "panel")
    return panel.regression_diff(p.filter("month = '1999-03'"), p.filter("month = '1998-03'"), ("ndvi_mean", "viirs_avg_rad_mean", "era5_temperature_mean"))


def _quality_evidence(s, d):
    evidence, _, oper = _fused(s, d)
    return scoring.with_quality(evidence, oper).withColumn("viirs_cf_cvg_mean", F.round("viirs_cf_cvg_mean", 4))


def _sweep(s, d):
    scores, oper = _scored(s, d)
    settings = evaluate.settings_table(s, (2.0, 2.5, 3.0, 3.5), (3, 4, 5))
    return evaluate.threshold_sweep(scores, oper.select("cell_id", "month"), A.cells(s, d), settings, CONFIG)


def _streamed_scores(s, d):
    """The operational months as files, scored by a stream."""
    base, oper = _horizons(s, d)
    clim = written(C.seasonal_climatology(base), "climatology")
    root = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    oper.repartition("month").write.parquet(f"{root}/in")
    query = streaming.score_stream(streaming.panel_stream(s, f"{root}/in", 2), clim, f"{root}/out", f"{root}/checkpoint", CONFIG)
    query.awaitTermination()
    return _r4(s.read.parquet(f"{root}/out").drop("batch"))


def _streamed_events(s, d):
    """The operational months' rows as files in any order; each month's events are made when its last cell has come."""
    base, oper = _horizons(s, d)
    clim, cells = written(C.seasonal_climatology(base), "climatology"), A.cells(s, d).select("cell_id", "row", "col")
    root = f"{shared_folder(s)}/closing-{uuid.uuid4().hex}"
    oper.repartition(8, F.xxhash64("cell_id")).write.parquet(f"{root}/in")

    def of_months(closed):
        rows = s.read.schema(PANEL).parquet(f"{root}/in").filter(F.col("month").isin(closed))
        evidence = scoring.evidence(scoring.score(rows, clim, CONFIG), rows.select("cell_id", "month"), CONFIG)
        return events.event_cells(evidence.filter("activity_candidate").join(cells, "cell_id"))

    rows = streaming.panel_stream(s, f"{root}/in", 3)
    closing.close_months(rows, cells, f"{root}/tiles", of_months, f"{root}/out", f"{root}/checkpoint", 2).awaitTermination()
    return s.read.parquet(f"{root}/out").drop("batch")


def _place(s, tag):
    return f"{shared_folder(s)}/{tag}-{uuid.uuid4().hex}"


def _with_nan(df):
    """Missing doubles as NaN, as a file of another tool has them."""
    return df.select(*[F.coalesce(c, F.lit(float("nan"))).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _parquet_round_trip(s, d):
    path = _place(s, "panel")
    write_parquet(_with_nan(A.full_panel(s, d)), path, ("month",))
    return _r4(read_parquet(s, path, PANEL).select(*PANEL.names))


def _csv_round_trip(s, d):
    path = _place(s, "panel-csv")
    write_csv(_with_nan(A.full_panel(s, d)), path)
    return _r4(read_csv(s, path, PANEL))


def _geojson_round_trip(s, d):
    path = _place(s, "grid")
    write_geojson_grid(_grid(s, d), path)
    return read_geojson_grid(s, path)


def _canonical_sink(s, d):
    """A written panel's rows, and how many come before the row ahead of them in their file."""
    path = _place(s, "sorted")
    write_parquet(A.full_panel(s, d), path)
    rows = read_parquet(s, path).select("cell_id", "month", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    key = F.struct("cell_id", "month")
    rows = rows.withColumn("late", key < F.lag(key).over(Window.partitionBy("file").orderBy("at")))
    return rows.agg(F.count("*").alias("n_rows"), F.count_if("late").alias("n_late"))


def _reused(s, d):
    path = _place(s, "reused")
    reuse_or_build(s, path, lambda: A.full_panel(s, d))
    return panel.regional_trend(reuse_or_build(s, path, lambda: A.full_panel(s, d).limit(0)))


def _bounds(s, d):
    c = A.scenes(s, d).join(A.cells(s, d).select("cell_id", "centroid_lon", "centroid_lat"), "cell_id")
    return grid.within_bounds(c, 1.0, 1.0, 3.0, 2.5, 0.05, "centroid_lon", "centroid_lat").groupBy("cell_id").agg(F.count("*").alias("n_scenes"))


def _labels(s, d):
    x = A.full_panel(s, d).select(*CORE).unpivot([], list(CORE), "feature", "value")
    return x.groupBy("feature").agg(F.count("value").alias("n_values")).withColumn("label", G.plain_label(F.col("feature")))


def _guarded(s, d):
    """Scenes under their limit, where an empty result would be an error."""
    return rasters.usable_scenes(A.scenes(s, d), A.CONFIG, strict=True).groupBy("month").agg(F.count("*").alias("used_scenes"))


def _gate(s, d):
    """A panel against its own written copy by cell_id, and by position against one whose cells have other names."""
    path, features = _place(s, "frozen"), ("ndvi_mean", "viirs_avg_rad_mean", "era5_temperature_mean")
    write_parquet(A.full_panel(s, d), path)
    frozen = read_parquet(s, path).filter("month = '1998-03'")
    new = A.full_panel(s, d).filter("month = '1998-03'")
    renamed = frozen.withColumn("cell_id", F.concat(F.lit("zone"), F.substring("cell_id", 5, 9)))
    by_id = panel.regression_gate(new, frozen, features).withColumn("matched_by", F.lit("cell_id"))
    return by_id.unionByName(panel.regression_gate(panel.by_position(new), panel.by_position(renamed), features, 1e-4).withColumn("matched_by", F.lit("position")))


def _completeness(s, d):
    months = A.months(s, d).select("month", "days_in_month")
    scenes = A.scenes(s, d)
    return panel.ingestion_completeness(A.full_panel(s, d), rasters.scene_counts(scenes, A.CONFIG), A.light_images(scenes), months)


def _choropleth(s, d):
    rows = grid.choropleth(A.cells(s, d), A.full_panel(s, d).filter("month = '1998-03'"), "ndvi_mean")
    corner = lambda i, j: F.col("ring")[i][j]
    return rows.select("cell_id", F.size("ring").alias("n_points"), corner(0, 0).alias("lon0"), corner(0, 1).alias("lat0"), corner(2, 0).alias("lon2"), corner(2, 1).alias("lat2"), F.round("value", 4).alias("value"), "has_value")


def _hours_complete(s, d):
    """Weather nodes' months against the hours of the month."""
    return _r4(rasters.hourly_completeness(rasters.hourly_to_monthly(A.weather_hours(A.scenes(s, d))), A.months(s, d)).select("node", "month", "era5_observation_count", "expected_hours", "completeness_ratio"))


def _complete_months(s, d):
    scores, oper = _scored(s, d)
    return streaming.complete_months(scores, A.cells(s, d).count())


def _written_base(s, d):
    return _horizons(s, d)[0]


def _polygon_zonal(s, d):
    p = polygons.in_regions(A.places(s, d), A.regions(s, d), 1.0)
    return p.groupBy("region_id").agg(F.count("*").alias("n_pixels"), F.round(F.avg("value"), 8).alias("mean_value"), F.round(F.min("lon"), 4).alias("min_lon"), F.round(F.max("lat"), 4).alias("max_lat"))


def _polygon_weighted(s, d):
    """Pixels 0.7 degrees wide, weighed by the part of each that lies inside."""
    return _r4(polygons.zonal_weighted(polygons.coverage(A.places(s, d), A.regions(s, d), 1.0, 0.35), ("region_id",), "value"), 6)


#: A zone with the map's middle on its central meridian.
UTM = projection.utm(43)


def _projected(s, d):
    p = A.places(s, d).withColumns({"lon": F.col("lon") + 61.5, "lat": F.col("lat") + 20.0})
    east, north = projection.forward(F.col("lon"), F.col("lat"), UTM)
    return p.withColumns({"x": east, "y": north})


def _mercator(s, d):
    """Projected places, and how far the way back misses, in millionths of a degree."""
    p = _projected(s, d)
    lon, lat = projection.inverse(F.col("x"), F.col("y"), UTM)
    miss = F.greatest(F.abs(lon - F.col("lon")), F.abs(lat - F.col("lat"))) * 1e6
    return p.select("event_id", F.round("x", 2).alias("easting"), F.round("y", 2).alias("northing"), F.round(miss, 2).alias("missed_by"))


def _resampled(s, d):
    """Means of pixels of 20 km on a lattice of 35 km."""
    fine = projection.pixel_keys(_projected(s, d), 20_000.0).groupBy("px", "py").agg(F.avg("value").alias("value"))
    return _r4(projection.resampled(fine, 20_000.0, 35_000.0, ("value",)), 8)


def _stations(s, d):
    """Each place's nearest of many stations."""
    cells = A.places(s, d).select(F.col("event_id").alias("cell_id"), F.col("lon").alias("centroid_lon"), F.col("lat").alias("centroid_lat"))
    return _r4(nearest.nearest_node(cells, A.stations(s, d)))


def _collection(s, d):
    """A laid-out collection scanned by dates, cloud and bounds."""
    path = _place(s, "collection")
    of = A.Inputs.of(s, d, once=True)
    pixels = A.table(s, d, "lineitem").select(F.col("l_orderkey").alias("scene_id"), "l_quantity")
    catalogue.write_collection(A.catalogue(of.scenes, of.cells), pixels, path)
    wanted = catalogue.SceneFilter("1996-02-10", "1997-05-01", (0.5, 0.5, 2.5, 3.5), 40.0)
    found = catalogue.collection_scan(s, path, wanted, strict=True)
    return found.groupBy("month", "tile").agg(F.count("*").alias("n_pixels"), F.count_distinct("scene_id").alias("n_scenes"), F.round(F.avg("l_quantity"), 4).alias("mean_quantity"))


def _input_shapes(s, d):
    """Shapes of the panel's three inputs, each checked on its own before they are joined."""
    of, out = A.Inputs.of(s, d, once=True), None
    for name, make in (("optical", A.optical), ("lights", A.lights), ("weather", A.weather)):
        one = shape_check(make(s, d, of), ("cell_id", "month"), {"n_cells": "cell_id", "n_months": "month"}).withColumn("input", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def _updated_climatology(s, d):
    """The baseline's climatology from a state of its first years, to which the last one is added."""
    base = written(_base(s, d), "base")
    year = "1999-01"
    state = written(C.profile_state(base.filter(F.col("month") < year)), "state")
    return C.climatology_of(C.merged_state(state, C.profile_state(base.filter(F.col("month") >= year))))


def _refreshed(s, d):
    """Monthly totals as a table by month, refreshed after one month's orders changed; and which months were built again."""
    path = _place(s, "months")
    scenes = written(A.scenes(s, d), "scenes")
    build = lambda given: given["scenes"].groupBy("month", "region").agg(F.count("*").alias("n_scenes"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    months.refresh(s, path, {"scenes": scenes}, build)
    changed = scenes.filter("NOT (month = '1996-03' AND region = 2)")
    again = months.refresh(s, path, {"scenes": changed}, build)
    return months.read_months(s, path).withColumn("rebuilt", F.col("month").isin(again))


def _over(of, source=_base):
    return lambda s, d: of(source(s, d))


QUERIES = {
    "scene_fallback": lambda s, d: rasters.scene_counts(A.scenes(s, d), A.CONFIG),
    "month_ranges": A.months,
    "grid_generate": _grid,
    "pixel_to_cell": _pixel_cells("centroid"),
    "pixel_to_cell_touch": _pixel_cells("touch"),
    "source_probe": lambda s, d: probe(A.table(s, d, "lineitem"), ("l_discount", "l_tax", "l_quantity", "b99")),
    "normalized_difference": _normalized,
    "raster_sanity": lambda s, d: rasters.raster_sanity(_indices(s, d)),
    "median_composite_zonal": _zonal,
    "coverage_stats": lambda s, d: _r4(A.lights(s, d)).drop("start_date", "end_date"),
    "hourly_to_monthly": _hourly,
    "nearest_station": _nearest,
    "panel_full_outer": _over(_r4, A.full_panel),
    "panel_shape": lambda s, d: shape_check(A.full_panel(s, d), ("cell_id", "month"), {"n_cells": "cell_id", "n_months": "month"}),
    "input_shapes": _input_shapes,
    "repeated_keys": lambda s, d: duplicate_keys(A.scenes(s, d), ("cell_id", "month")).withColumnRenamed("count", "n_rows"),
    "polygon_zonal": _polygon_zonal,
    "polygon_weighted": _polygon_weighted,
    "transverse_mercator": _mercator,
    "resampled_pixels": _resampled,
    "nearest_of_many": _stations,
    "collection_scan": _collection,
    "regional_trend": _over(panel.regional_trend, A.full_panel),
    "completeness": _over(panel.completeness, A.full_panel),
    "regression_diff": _regression,
    "regression_gate": _gate,
    "ingestion_completeness": _completeness,
    "parquet_round_trip": _parquet_round_trip,
    "csv_round_trip": _csv_round_trip,
    "geojson_round_trip": _geojson_round_trip,
    "canonical_sink": _canonical_sink,
    "checkpoint_reuse": _reused,
    "bounds_filter": _bounds,
    "label_strip": _labels,
    "empty_guard": _guarded,
    "month_ordinal": lambda s, d: grid.month_ordinals(A.full_panel(s, d)),
    "choropleth_rows": _choropleth,
    "hourly_completeness": _hours_complete,
    "complete_months": _complete_months,
    "seasonal_climatology": _clim,
    "updated_climatology": _updated_climatology,
    "refreshed_months": _refreshed,
    "climatology_band": lambda s, d: C.climatology_band(_clim(s, d), ("cell_00_01", "cell_02_02"), "viirs_avg_rad_mean"),
    "march_diagnostic": _diagnostic,
    "score_robust_z": lambda s, d: _r4(_scored(s, d)[0]),
    "streamed_scores": _streamed_scores,
    "streamed_events": _streamed_events,
    "evidence_fusion": _quality_evidence,
    "dominant_feature": _dominant,
    "event_cells": _event_cells,
    "spatial_events": _spatial_events,
    "monthly_anomaly_summary": _monthly_anomalies,
    "feature_anomaly_summary": lambda s, d: scoring.feature_anomalies(_scored(s, d)[0], A.CONFIG),
    "event_map": lambda s, d: events.event_map(A.cells(s, d).select("cell_id", "row", "col"), _event_cells(s, d), "2001-03"),
    "threshold_sweep": _sweep,
    "perturbation_benchmark": _perturbed,
    "quality_profile": _over(profile.quality_profile, A.full_panel),
    "feature_statistics": _over(profile.feature_statistics),
    "missingness_month": _over(profile.missingness_by_month, A.full_panel),
    "missingness_cell": _over(profile.missingness_by_cell, A.full_panel),
    "co_missing": _over(profile.co_missing, A.full_panel),
    "monthly_summary": _over(profile.monthly_summary),
    "cell_temporal_stats": _over(profile.cell_temporal_stats),
    "pearson_pairs": _over(profile.pearson),
    "pearson_pairwise": _over(profile.pearson_pairwise),
    "pearson_matrix": _over(lambda p: profile.matrix(profile.pearson(p), PRIMARY)),
    "spearman_pairs": _over(profile.spearman, _written_base),
    "variance_decomposition": _over(profile.variance_decomposition, _written_base),
    "baseline_comparison": _over(profile.baseline_comparison),
    "representative_cells": _over(profile.representative_cells, _written_base),
    "histogram_bins": _over(lambda p: profile.histogram(p, "viirs_avg_rad_mean", 40), _written_base),
    "box_data": _over(profile.box_data),
    "percentile_clip": _over(lambda p: profile.percentile_clip(p, "ndvi_mean", -0.2, 0.9)),
    "log1p_skew": _over(profile.log1p_skew),
}
