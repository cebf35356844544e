"""Robust scores of new months against a frozen climatology, and their fusion by cell and month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as G
from ..schemas import CORE, EngineConfig
from .climatology import long_features


def score(panel: DataFrame, climatology: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """One row per cell, month and core feature: observed value, profile, residual, scale, robust z, zero-MAD deviation, baseline size flags and modality."""
    x = long_features(panel.withColumn("calendar_month", G.calendar_month(F.col("month"))), ("cell_id", "month", "calendar_month")).withColumnRenamed("value", "observed_value")
    prof = climatology.select("cell_id", "calendar_month", "feature", "n_observations", "median", "mad", "zero_mad_flag")
    j = x.join(prof, ["cell_id", "calendar_month", "feature"], "left")
    residual = F.col("observed_value") - F.col("median")
    z = G.robust_z(residual, F.col("mad"), cfg.zero_mad)
    zero = F.coalesce(F.col("mad") <= cfg.zero_mad, F.lit(False)) | F.coalesce("zero_mad_flag", F.lit(False))
    out = j.withColumns({"residual": residual, "robust_scale": G.robust_scale(F.col("mad")), "robust_z": z, "zero_mad_flag": zero, "baseline_n": F.coalesce("n_observations", F.lit(0)).cast("long")})
    flags = {f"baseline_usable_n{k}": F.col("baseline_n") >= k for k in (1, 2, 3)}
    return out.withColumns({"abs_robust_z": F.abs("robust_z"), "absolute_deviation": F.abs("residual"), "zero_mad_deviation": F.col("zero_mad_flag") & F.coalesce(F.abs("residual") > 1e-6, F.lit(False)), "modality_category": G.modality(F.col("feature")), **flags}).drop("n_observations")


def _evidence(rows: DataFrame, keys: list[str], tau: Column, cfg: EngineConfig) -> DataFrame:
    odd = G.is_anomalous(F.col("abs_robust_z"), F.col("zero_mad_deviation"), tau)
    usable = F.col("observed_value").isNotNull() & F.col("median").isNotNull()
    n = lambda m, c, name: F.count_if((F.col("modality_category") == m) & c).alias(name)
    names = {"optical": "optical", "activity": "viirs", "weather": "weather"}
    aggs = [n(m, c, f"{short}_{what}") for m, short in names.items() for what, c in (("count", odd), ("available", usable))]
    e = rows.groupBy(*keys).agg(*aggs, F.round(F.avg("abs_robust_z"), 4).alias("mean_abs_z"))
    return _ratios(e, cfg)


def _ratios(e: DataFrame, cfg: EngineConfig) -> DataFrame:
    c = F.col
    e = e.withColumns({"optical_ratio": G.safe_ratio(c("optical_count"), c("optical_available")), "weather_ratio": G.safe_ratio(c("weather_count"), c("weather_available")), "viirs_anomalous": c("viirs_count") > 0})
    e = e.withColumns({"activity_count": c("optical_count") + c("viirs_count"), "activity_available": c("optical_available") + c("viirs_available")})
    e = e.withColumn("activity_score", G.safe_ratio(c("activity_count"), c("activity_available")))
    return e.withColumn("activity_candidate", (c("activity_score") >= cfg.candidate_score) & ((c("optical_count") >= 1) | c("viirs_anomalous")))


def evidence(scores: DataFrame, skeleton: DataFrame, cfg: EngineConfig = EngineConfig(), settings: DataFrame | None = None) -> DataFrame:
    """Evidence of every cell and month of ``skeleton`` (cell_id, month), with zeros where nothing is usable.

    Optical and activity anomalies enter the score, weather's never do. ``settings`` (tau, min_n): all settings in one
    pass, with these columns as further keys."""
    keys = ["cell_id", "month"]
    if settings is None:
        rows, tau = scores.filter(F.col("baseline_n") >= cfg.min_baseline), F.lit(cfg.tau)
    else:
        rows, tau = scores.join(F.broadcast(settings), F.col("baseline_n") >= F.col("min_n")), F.col("tau")
        skeleton, keys = skeleton.crossJoin(F.broadcast(settings)), [*keys, "tau", "min_n"]
    e = _evidence(rows, keys, tau, cfg)
    out = skeleton.join(e, keys, "left")
    counts = [f"{s}_{w}" for s in ("optical", "viirs", "weather") for w in ("count", "available")]
    return _ratios(out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts}), cfg)


def activation_levels(scores: DataFrame, min_ns: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """cell_id, month, min_n and level: the highest tau at which a cell is a candidate (infinity if at every tau); without cells that never are.

    A candidate needs a share of its available optical and activity features to be anomalous, so the level is the level of its
    feature of that rank. One pass for all taus; ``min_ns`` (min_n) is a short table of settings."""
    rows = scores.filter(F.col("modality_category").isin("optical", "activity")).join(F.broadcast(min_ns.select("min_n").distinct()), F.col("baseline_n") >= F.col("min_n"))
    level = F.when(F.col("zero_mad_deviation"), F.lit(float("inf"))).otherwise(F.col("abs_robust_z"))
    usable = F.col("observed_value").isNotNull() & F.col("median").isNotNull()
    e = rows.groupBy("cell_id", "month", "min_n").agg(F.count_if(usable).alias("available"), F.sort_array(F.collect_list(level), False).alias("levels"))  # one value a feature
    needed = F.greatest(F.lit(1), F.ceil(F.col("available") * (cfg.candidate_score - 0.00005))).cast("int")  # shares are rounded to 4 digits
    found = e.select("cell_id", "month", "min_n", F.when(F.col("available") > 0, F.get("levels", needed - 1)).alias("level"))
    return found.filter("level IS NOT NULL")


def dominant_feature(scores: DataFrame, skeleton: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """The optical or activity feature that deviates most: name, direction and rank value; "none" and "neutral" where nothing is observed.

    Ranked by robust z, or absolute deviation where there is none; ties go to the feature that comes first."""
    r = scores.filter((F.col("baseline_n") >= cfg.min_baseline) & F.col("modality_category").isin("optical", "activity"))
    r = r.withColumn("rank_value", F.coalesce("abs_robust_z", "absolute_deviation")).filter("rank_value IS NOT NULL")
    best = r.groupBy("cell_id", "month").agg(F.max(F.struct("rank_value", (-G.ordinal(F.col("feature"))).alias("o"), "feature", "residual")).alias("b"))
    out = skeleton.join(best, ["cell_id", "month"], "left")
    return out.select("cell_id", "month", F.coalesce("b.feature", F.lit("none")).alias("dominant_feature"), F.when(F.col("b").isNull(), "neutral").otherwise(G.direction(F.col("b.residual"))).alias("dominant_direction"), F.round("b.rank_value", 4).alias("dominant_value"))


def with_quality(evidence_rows: DataFrame, panel: DataFrame) -> DataFrame:
    """Adds the month's quality figures: an absent row counts as full quality, a missing figure as none."""
    q = panel.select("cell_id", "month", F.lit(True).alias("_there"), "valid_pixel_fraction", "viirs_cf_cvg_mean")
    j = evidence_rows.join(q, ["cell_id", "month"], "left")
    pick = lambda c, absent: F.when(F.col("_there").isNull(), F.lit(absent)).otherwise(F.coalesce(c, F.lit(0.0)))
    return j.withColumns({"valid_pixel_fraction": pick("valid_pixel_fraction", 1.0), "viirs_cf_cvg_mean": pick("viirs_cf_cvg_mean", 10.0)}).drop("_there")


def feature_anomalies(scores: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Per feature: rows, valid and missing ones, anomalies, their rate over valid rows, zero-MAD deviations and mean size of z."""
    odd = G.is_anomalous(F.col("abs_robust_z"), F.col("zero_mad_deviation"), F.lit(cfg.tau))
    s = scores.groupBy("feature", "modality_category").agg(F.count("*").alias("total_observations"), F.count("observed_value").alias("valid_observations"), F.count_if(odd).alias("anomalies_detected"), F.count_if("zero_mad_deviation").alias("zero_mad_deviations"), F.round(F.avg("abs_robust_z"), 4).alias("mean_abs_robust_z"))
    return s.withColumns({"missing_observations": F.col("total_observations") - F.col("valid_observations"), "anomaly_rate_pct": F.round(F.try_divide(F.col("anomalies_detected") * 100, F.col("valid_observations")), 2)})
