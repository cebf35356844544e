"""Scene collections: a catalogue of scenes, and their pixels in files by month and tile.

A scan filters the catalogue by date, cloud and bounds; the months and tiles of what is left prune the pixels' files when the
query runs, so that files of other months and places are never opened."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a catalogue has of a scene besides its own columns: id, place in the layout, date (half-open spans are of this), cloud and bounds.
CATALOGUE = ("scene_id", "month", "tile", "date", "cloud_pct", "min_x", "min_y", "max_x", "max_y")


@dataclass(frozen=True)
class SceneFilter:
    """Which scenes to take: a half-open span of dates, bounds that they must touch, and a cloud limit; None for all."""

    start: str | None = None
    end: str | None = None
    bounds: tuple[float, float, float, float] | None = None
    cloud_pct: float | None = None
    inclusive: bool = True

    def of(self, scenes: DataFrame) -> DataFrame:
        out = scenes
        if self.start is not None:
            out = out.filter(F.col("date") >= F.lit(self.start).cast("date"))
        if self.end is not None:
            out = out.filter(F.col("date") < F.lit(self.end).cast("date"))
        if self.bounds is not None:
            x0, y0, x1, y1 = map(F.lit, self.bounds)
            out = out.filter((F.col("min_x") <= x1) & (F.col("max_x") >= x0) & (F.col("min_y") <= y1) & (F.col("max_y") >= y0))
        if self.cloud_pct is not None:
            out = out.filter(F.col("cloud_pct") <= self.cloud_pct if self.inclusive else F.col("cloud_pct") < self.cloud_pct)
        return out


def write_collection(scenes: DataFrame, pixels: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The catalogue (CATALOGUE and more), in one order, and the pixels (scene_id and values) laid out by their scene's month and tile.

    Files of one month and tile are sorted by scene, so that scans skip row groups within them as well. Large folders get several files."""
    missing = [c for c in CATALOGUE if c not in scenes.columns]
    if missing:
        raise ValueError(f"the catalogue lacks {', '.join(missing)}")
    place = scenes.select("scene_id", "month", "tile")
    laid = pixels.join(place, "scene_id").hint("rebalance", "month", "tile").sortWithinPartitions("month", "tile", "scene_id")
    laid.write.mode(mode).partitionBy("month", "tile").parquet(f"{path}/pixels")
    scenes.repartitionByRange("date", "scene_id").sortWithinPartitions("date", "scene_id").write.mode(mode).parquet(f"{path}/scenes")


def scenes_of(spark: SparkSession, path: str, wanted: SceneFilter = SceneFilter()) -> DataFrame:
    return wanted.of(spark.read.parquet(f"{path}/scenes"))


def collection_scan(spark: SparkSession, path: str, wanted: SceneFilter = SceneFilter(), strict: bool = False) -> DataFrame:
    """The pixels of the scenes that pass, with their scene's date and cloud_pct. ``strict``: an error where no scene passes."""
    scenes = scenes_of(spark, path, wanted).select("scene_id", "month", "tile", "date", "cloud_pct")
    if strict and scenes.isEmpty():
        raise ValueError("no scene passes the filter")
    found = spark.read.parquet(f"{path}/pixels").schema
    # the layout's columns get the catalogue's types, as a cast would keep files from being pruned
    schema = T.StructType([scenes.schema[f.name] if f.name in ("month", "tile") else f for f in found])
    pixels = spark.read.schema(schema).parquet(f"{path}/pixels")
    return pixels.join(scenes, ["month", "tile", "scene_id"])


def folders_read(spark: SparkSession, path: str, wanted: SceneFilter) -> DataFrame:
    """The months and tiles that a scan touches, with their scenes: what pruning leaves of the layout."""
    return scenes_of(spark, path, wanted).groupBy("month", "tile").agg(F.count("*").alias("n_scenes"))
