"""The multimodal panel: one row for each cell and month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import CORE, KEYS, PANEL
from .ranks import cumulative


def build_panel(optical: DataFrame, lights: DataFrame, weather: DataFrame) -> DataFrame:
    """Full outer join of the three feature tables on their four keys, with the panel's columns in order.

    A key has one row in each table at most, so the join is one union and group-by, with a single exchange. Rows of each table are counted
    on the way: a key that repeats in one of them is an error, never a blend of its rows."""
    parts, names = None, ("optical", "lights", "weather")
    for name, df in zip(names, (optical, lights, weather), strict=True):
        one = df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in PANEL], F.lit(name).alias("_part"))
        parts = one if parts is None else parts.unionByName(one)
    rows = [F.count_if(F.col("_part") == name).alias(f"_{name}") for name in names]
    joined = parts.groupBy(*KEYS).agg(*[F.max(c).alias(c) for c in PANEL.names if c not in KEYS], *rows)
    most = F.greatest(*[f"_{name}" for name in names])
    repeated = F.raise_error(F.concat_ws(" ", F.lit("a table repeats the key"), *KEYS))
    return joined.filter(F.when(most <= 1, F.lit(True)).otherwise(repeated.cast("boolean"))).select(*PANEL.names)


def regression_diff(new: DataFrame, frozen: DataFrame, features: tuple[str, ...], tolerance: float = 1e-6) -> DataFrame:
    """Per feature of one month's rows joined on cell_id: compared rows, largest and mean difference, and how many exceed the tolerance."""
    both = new.select("cell_id", *features).join(frozen.select("cell_id", *[F.col(f).alias(f"_{f}") for f in features]), "cell_id")
    long = both.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.abs(F.col(f) - F.col(f"_{f}")).alias("d")) for f in features])).alias("x")).select("x.*")
    return long.groupBy("feature").agg(F.count("d").alias("n_compared"), F.round(F.max("d"), 4).alias("max_diff"), F.round(F.avg("d"), 4).alias("mean_diff"), F.count_if(F.col("d") > tolerance).alias("n_exceeding"))


def by_position(df: DataFrame) -> DataFrame:
    """``df`` with its rows' places by cell_id in place of cell_id, for tables whose ids differ; cell_id must be unique."""
    place = cumulative(df.select(F.lit(1).alias("all"), "cell_id"), ("all",), "cell_id").select("cell_id", F.col("below").cast("string").alias("place"))
    return df.join(place, "cell_id").withColumn("cell_id", F.col("place")).drop("place")


def regression_gate(new: DataFrame, frozen: DataFrame, features: tuple[str, ...], tolerance: float = 1e-6) -> DataFrame:
    """regression_diff's rows; an error if any feature exceeds the tolerance, or nothing could be compared."""
    rows = regression_diff(new, frozen, features, tolerance)
    found = {r.feature: r for r in rows.collect()}  # one row per feature
    wrong = [f"{f} ({r.n_exceeding} of {r.n_compared}, at most {r.max_diff})" if (r := found.get(f)) else f"{f} (0 of 0)" for f in features if f not in found or found[f].n_exceeding or not found[f].n_compared]
    if wrong:
        raise ValueError("changed against the frozen table: " + ", ".join(wrong))
    return rows


def regional_trend(panel: DataFrame) -> DataFrame:
    """Each core feature's mean over all cells, by month."""
    return panel.groupBy("month").agg(*[F.round(F.avg(f), 4).alias(f) for f in CORE])


def ingestion_completeness(panel: DataFrame, scene_counts: DataFrame, images: DataFrame, months: DataFrame) -> DataFrame:
    """completeness with scenes in all, clean and used, night-light images (``images``: month, image_count), and hours against those expected of all cells (24 a day)."""
    scenes = scene_counts.select("month", "raw_scenes", "clean_scenes", "used_scenes")
    c = completeness(panel).join(scenes, "month", "left").join(images.select("month", "image_count"), "month", "left").join(months.select("month", "days_in_month"), "month", "left")
    hours = (F.col("days_in_month") * 24 * F.col("total_cells")).cast("long")
    return c.withColumns({"expected_hours": hours, "hours_ratio": F.round(F.try_divide("weather_hours", hours), 4), **{k: F.coalesce(k, F.lit(0)).cast("long") for k in ("raw_scenes", "clean_scenes", "used_scenes", "image_count")}}).drop("days_in_month")


def completeness(panel: DataFrame) -> DataFrame:
    """Per month: cells, and cells with optical, lights and weather values."""
    return panel.groupBy("month").agg(F.count("*").alias("total_cells"), F.count("ndvi_mean").alias("optical_cells"), F.count("viirs_avg_rad_mean").alias("lights_cells"), F.count("era5_temperature_mean").alias("weather_cells"), F.sum("era5_observation_count").alias("weather_hours"))
