"""Detector evaluation: a sweep over thresholds, and injected shifts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as G
from ..schemas import EngineConfig
from .climatology import long_features
from .events import nested_event_cells
from .scoring import activation_levels


def settings_table(spark: SparkSession, taus: tuple[float, ...], min_ns: tuple[int, ...]) -> DataFrame:
    return spark.createDataFrame([(float(t), int(n)) for t in taus for n in min_ns], "tau double, min_n int")


def threshold_sweep(scores: DataFrame, skeleton: DataFrame, geometry: DataFrame, settings: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Per (tau, min_n): anomalous features, zero-MAD ones, candidate cells and events; one job for all settings.

    Events of all taus come from one spanning forest per month and min_n, of which each tau is a cut."""
    rows = scores.join(F.broadcast(settings), F.col("baseline_n") >= F.col("min_n"))
    odd = G.is_anomalous(F.col("abs_robust_z"), F.col("zero_mad_deviation"), F.col("tau"))
    per = rows.groupBy("tau", "min_n").agg(F.count_if(odd).alias("feature_level_anomalies"), F.count_if("zero_mad_deviation").alias("zero_mad_feature_anomalies"))
    levels = activation_levels(scores.join(skeleton, ["cell_id", "month"], "left_semi"), settings, cfg).join(geometry.select("cell_id", "row", "col"), "cell_id")
    taus = tuple(sorted({r.tau for r in settings.select("tau").distinct().collect()}))  # a handful of settings
    cells = nested_event_cells(levels, taus, ("min_n", "month")).join(F.broadcast(settings), ["tau", "min_n"], "left_semi")
    sizes = cells.groupBy("tau", "min_n", "month", "first").count()
    ev = sizes.groupBy("tau", "min_n").agg(F.sum("count").alias("candidate_anomalous_cells"), F.count("*").alias("total_spatial_events"), F.count_if(F.col("count") >= cfg.coherent_cells).alias("multi_cell_coherent_events"))
    out = settings.join(per, ["tau", "min_n"], "left").join(ev, ["tau", "min_n"], "left")
    counts = ["feature_level_anomalies", "zero_mad_feature_anomalies", "candidate_anomalous_cells", "total_spatial_events", "multi_cell_coherent_events"]
    out = out.select("tau", "min_n", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])
    return out.withColumn("single_cell_isolated_events", F.col("total_spatial_events") - F.col("multi_cell_coherent_events"))


def ordered_sample(rows: DataFrame, n: int, order: tuple) -> DataFrame:
    """``n`` rows by a fixed order of keys: a sample that any engine can repeat."""
    return rows.orderBy(*order).limit(n)


def perturbation_benchmark(panel: DataFrame, climatology: DataFrame, spark: SparkSession, magnitudes: tuple[float, ...] = (-3, -2, -1, 1, 2, 3), taus: tuple[float, ...] = (2.0, 2.5, 3.0, 3.5), n: int = 500, zero: float = 1e-9) -> DataFrame:
    """Shifts ``n`` observed rows by so many robust scales and counts which are detected, per magnitude and tau.

    Rows without a usable MAD shift by 10 (radiance, precipitation) or 0.05 and are detected by any deviation."""
    x = long_features(panel, ("cell_id", "month")).filter("value IS NOT NULL").withColumn("calendar_month", G.calendar_month(F.col("month")))
    j = x.join(climatology.select("cell_id", "calendar_month", "feature", "median", "mad"), ["cell_id", "calendar_month", "feature"])
    key = F.md5(F.concat_ws("|", "cell_id", "month", "feature"))
    s = ordered_sample(j.withColumn("_k", key), n, ("_k",)).drop("_k")
    conf = spark.createDataFrame([(float(m), float(t)) for m in magnitudes for t in taus], "injected_magnitude_scales double, threshold_tau double")
    s = s.crossJoin(F.broadcast(conf))
    base = F.when(F.col("feature").isin("viirs_avg_rad_mean", "era5_precipitation_total"), 10.0).otherwise(0.05)
    usable = F.col("mad") > zero
    shift = F.when(usable, F.col("injected_magnitude_scales") * G.robust_scale(F.col("mad"))).otherwise(F.signum("injected_magnitude_scales") * base)
    residual = F.col("value") + shift - F.col("median")
    hit = F.when(usable, F.abs(residual / G.robust_scale(F.col("mad"))) >= F.col("threshold_tau")).otherwise(F.abs(residual) > 1e-6)
    return s.groupBy("injected_magnitude_scales", "threshold_tau").agg(F.count("*").alias("n_trials"), F.count_if(usable).alias("n_robust"), F.count_if(~usable).alias("n_zero_mad"), F.count_if(hit).alias("detected_count"), F.round(F.count_if(hit) * 100 / F.count("*"), 2).alias("detection_sensitivity_pct"))
