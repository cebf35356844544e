"""From scenes, composites and hourly series to features of a cell and month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as G
from ..schemas import EngineConfig

INDICES = ("ndvi", "ndbi", "ndwi")


def cloud_passes(pct: Column, limit: Column | float, inclusive: bool = True) -> Column:
    return pct <= limit if inclusive else pct < limit


def scene_counts(scenes: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Per month: scenes in all, under the limit and under the fallback limit, the limit used (null: none) and scenes used."""
    first = cloud_passes(F.col("cloud_pct"), cfg.cloud_pct, cfg.inclusive)
    second = cloud_passes(F.col("cloud_pct"), cfg.fallback_cloud_pct, cfg.inclusive)
    c = scenes.groupBy("month").agg(F.count("*").alias("raw_scenes"), F.count_if(first).alias("clean_scenes"), F.count_if(second).alias("fallback_scenes"))
    limit = F.when(F.col("clean_scenes") > 0, F.lit(cfg.cloud_pct)).when(F.col("fallback_scenes") > 0, F.lit(cfg.fallback_cloud_pct))
    used = F.when(F.col("clean_scenes") > 0, F.col("clean_scenes")).otherwise(F.col("fallback_scenes"))
    return c.withColumns({"used_limit": limit, "used_scenes": used})


def usable_scenes(scenes: DataFrame, cfg: EngineConfig, strict: bool = False) -> DataFrame:
    """The scenes under their month's limit; ``strict``: an error where no scene is left at all."""
    limits = scene_counts(scenes, cfg).select("month", "used_limit")
    out = scenes.join(limits, "month").filter(cloud_passes(F.col("cloud_pct"), F.col("used_limit"), cfg.inclusive)).drop("used_limit")
    if strict and out.isEmpty():
        raise ValueError("no scene is under the cloud limit")
    return out


def optical_indices(pixels: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Masked pixels (scl in the clear classes) with ndvi, ndbi and ndwi from scaled bands b3, b4, b8 and b11."""
    p = pixels.filter(F.col("scl").isin(*cfg.clear_classes))
    b = {k: G.reflectance(F.col(k)) for k in ("b3", "b4", "b8", "b11")}
    return p.withColumns({"ndvi": G.normalized_difference(b["b8"], b["b4"]), "ndbi": G.normalized_difference(b["b11"], b["b8"]), "ndwi": G.normalized_difference(b["b3"], b["b8"])})


def median_composite(indices: DataFrame, keys: tuple[str, ...] = ("cell_id", "month", "px")) -> DataFrame:
    """Each pixel's median over its scenes, of each index."""
    return indices.groupBy(*keys).agg(*[F.median(i).alias(i) for i in INDICES])


def zonal_optical(composite: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Mean, population deviation and count over a cell's pixels; without a valid pixel all but the counts are missing."""
    stats = [f(i).alias(f"{i}_{n}") for n, f in (("mean", F.avg), ("std", F.stddev_pop)) for i in INDICES]
    z = composite.groupBy("cell_id", "month").agg(*stats, F.count("ndvi").alias("valid_pixel_count"))
    some = F.col("valid_pixel_count") > 0
    z = z.select("cell_id", "month", *[F.when(some, F.col(f"{i}_{n}")).alias(f"{i}_{n}") for n in ("mean", "std") for i in INDICES], "valid_pixel_count")
    return z.withColumn("valid_pixel_fraction", G.valid_fraction(F.col("valid_pixel_count"), cfg.expected_pixels))


def zonal_lights(pixels: DataFrame) -> DataFrame:
    """Radiance mean, deviation and count, coverage mean, min and max, and valid fraction of a cell and month; input avg_rad, cf_cvg, mask."""
    return pixels.groupBy("cell_id", "month").agg(
        F.avg("avg_rad").alias("viirs_avg_rad_mean"), F.stddev_pop("avg_rad").alias("viirs_avg_rad_std"), F.avg("cf_cvg").alias("viirs_cf_cvg_mean"), F.min("cf_cvg").cast("long").alias("viirs_cf_cvg_min"),
        F.max("cf_cvg").cast("long").alias("viirs_cf_cvg_max"), F.count("avg_rad").alias("viirs_valid_pixel_count"), G.clipped_fraction(F.avg("mask")).alias("viirs_valid_pixel_fraction"),
    )


def hourly_to_monthly(hours: DataFrame, keys: tuple[str, ...] = ("node", "month")) -> DataFrame:
    """Temperature mean/min/max, precipitation sum, wind mean/max and count; wind speed is taken for each hour before it is averaged."""
    t, p, w = G.celsius(F.col("t2m_k")), G.millimetres(F.col("tp_m")), G.wind_speed(F.col("u10"), F.col("v10"))
    return hours.groupBy(*keys).agg(
        F.avg(t).alias("era5_temperature_mean"), F.min(t).alias("era5_temperature_min"), F.max(t).alias("era5_temperature_max"), F.sum(p).alias("era5_precipitation_total"),
        F.avg(w).alias("era5_wind_speed_mean"), F.max(w).alias("era5_wind_speed_max"), F.count("*").alias("era5_observation_count"),
    )


def hourly_completeness(monthly: DataFrame, months: DataFrame) -> DataFrame:
    """Observations against 24 a day of the month."""
    return monthly.join(F.broadcast(months.select("month", "days_in_month")), "month").withColumns({"expected_hours": (F.col("days_in_month") * 24).cast("long"), "completeness_ratio": F.round(F.col("era5_observation_count") / (F.col("days_in_month") * 24), 4)})


def raster_sanity(indices: DataFrame, limit: float = 1.5) -> DataFrame:
    """Per index: min, mean and max over all pixels, and whether any lies beyond +-limit."""
    long = indices.unpivot([], list(INDICES), "index_name", "value")
    return long.groupBy("index_name").agg(F.round(F.min("value"), 4).alias("min_value"), F.round(F.avg("value"), 4).alias("mean_value"), F.round(F.max("value"), 4).alias("max_value"), F.coalesce(F.bool_or(F.abs("value") > limit), F.lit(False)).alias("out_of_range"))
