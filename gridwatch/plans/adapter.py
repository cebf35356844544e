"""The star-schema tables as raster inputs: nations are cells of a 5 by 5 grid, orders scenes, line items pixels.

Derived features are rounded to 9 digits, so that what follows doesn't depend on the order of sums."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid, nearest, panel, rasters
from ..schemas import EngineConfig
from ..session import written
from ..sources import read_parquet

CONFIG = EngineConfig(expected_pixels=16, baseline=("1995-01", "2000-01"), operational=("2001-01", "2001-07"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, row, col, region and geometry; one cell is one degree wide."""
    k = F.col("n_nationkey")
    row, col = F.floor(k / 5).cast("int"), (k % 5).cast("int")
    c = table(spark, sf_dir, "nation").select(k.alias("nation"), F.col("n_regionkey").alias("region"), row.alias("row"), col.alias("col"), F.format_string("cell_%02d_%02d", row, col).alias("cell_id"))
    at = lambda c_, d: (F.col(c_) + d).cast("double")
    return c.withColumns({"min_lon": at("col", 0), "max_lon": at("col", 1), "min_lat": at("row", 0), "max_lat": at("row", 1), "centroid_lon": at("col", 0.5), "centroid_lat": at("row", 0.5)})


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with month, cloud_pct and their customer's cell and region."""
    o, cust = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    where = cust.join(cells(spark, sf_dir), F.col("c_nationkey") == F.col("nation")).select(F.col("c_custkey").alias("o_custkey"), "cell_id", "region")
    return o.join(where, "o_custkey").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate", "cell_id", "region", F.date_format("o_orderdate", "yyyy-MM").alias("month"), (F.col("o_orderkey") * 7 % 100).alias("cloud_pct"))


def pixels(spark: SparkSession, sf_dir: str, used: DataFrame) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), (F.col("l_suppkey") % 16).alias("px"), F.col("l_linenumber").alias("scl"), (F.col("l_extendedprice") / 10).alias("b3"), (F.col("l_tax") * 10000).alias("b4"), (F.col("l_discount") * 10000).alias("b8"), (F.col("l_quantity") * 100).alias("b11")
    )
    return line.join(used.select("o_orderkey", "cell_id", "month"), "o_orderkey")


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months of the orders, as ranges."""
    span = table(spark, sf_dir, "orders").agg(F.trunc(F.min("o_orderdate").cast("date"), "MM").alias("start"), F.add_months(F.trunc(F.max("o_orderdate").cast("date"), "MM"), 1).alias("end"))
    return grid.month_ranges(span)


def _r9(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@dataclass(frozen=True)
class Inputs:
    """What all three feature tables start from."""

    spark: SparkSession
    sf_dir: str
    scenes: DataFrame
    months: DataFrame
    cells: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str, once: bool = False) -> Inputs:
        """``once``: each made once and read from then on, for use by several feature tables."""
        keep = written if once else lambda df, _: df
        return cls(spark, sf_dir, keep(scenes(spark, sf_dir), "scenes"), keep(months(spark, sf_dir), "months"), keep(cells(spark, sf_dir), "cells"))

    def spans(self) -> DataFrame:
        return self.months.select("month", "start_date", "end_date")


def optical(spark: SparkSession, sf_dir: str, of: Inputs | None = None) -> DataFrame:
    """Optical features of every cell and month; missing where no pixel is left."""
    of = of or Inputs.of(spark, sf_dir)
    used = rasters.usable_scenes(of.scenes, CONFIG)
    z = rasters.zonal_optical(rasters.median_composite(rasters.optical_indices(pixels(spark, sf_dir, used), CONFIG)), CONFIG)
    j = grid.skeleton(of.cells.select("cell_id"), of.spans()).join(z, ["cell_id", "month"], "left")
    return _r9(j.withColumns({"valid_pixel_count": F.coalesce("valid_pixel_count", F.lit(0)).cast("long"), "valid_pixel_fraction": F.coalesce("valid_pixel_fraction", F.lit(0.0))}))


def lights(spark: SparkSession, sf_dir: str, of: Inputs | None = None) -> DataFrame:
    of = of or Inputs.of(spark, sf_dir)
    p = of.scenes.select("cell_id", "month", (F.col("o_totalprice") * 0.00123456789).alias("avg_rad"), (F.col("o_custkey") % 10 + 1).alias("cf_cvg"), F.when(F.col("o_orderstatus") == "P", 0.5).otherwise(1.0).alias("mask"))
    return _r9(rasters.zonal_lights(p)).join(of.spans(), "month")


def light_images(scenes_: DataFrame) -> DataFrame:
    """Night-light images of a month: one a day that has any."""
    return scenes_.groupBy("month").agg(F.count_distinct(F.to_date("o_orderdate")).alias("image_count"))


def weather_hours(scenes_: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return scenes_.select(F.col("region").alias("node"), "month", (F.col("o_totalprice") * 0.0000517283917 + 273.15).alias("t2m_k"), (k % 100 / 10000).alias("tp_m"), (F.col("o_custkey") % 21 - 10).cast("double").alias("u10"), (k % 15 - 7).cast("double").alias("v10"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("r_regionkey")
    return table(spark, sf_dir, "region").select(r.alias("node"), (r + 0.25).cast("double").alias("node_lon"), (r * 2 % 5 + 0.25).cast("double").alias("node_lat"))


def weather(spark: SparkSession, sf_dir: str, of: Inputs | None = None) -> DataFrame:
    of = of or Inputs.of(spark, sf_dir)
    near = nearest.nearest_node(of.cells, nodes(spark, sf_dir))
    w = _r9(rasters.hourly_to_monthly(weather_hours(of.scenes))).join(near, "node")
    return w.drop("node").withColumnsRenamed({"node_lat": "era5_source_lat", "node_lon": "era5_source_lon"}).join(of.spans(), "month")


def full_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = Inputs.of(spark, sf_dir, once=True)
    return panel.build_panel(optical(spark, sf_dir, of), lights(spark, sf_dir, of), weather(spark, sf_dir, of))


def horizon(p: DataFrame, span: tuple[str, str]) -> DataFrame:
    """The rows of a half-open span of months."""
    return p.filter((F.col("month") >= span[0]) & (F.col("month") < span[1]))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pixels of a map of 27 by 25 degrees."""
    return table(spark, sf_dir, "events").select("event_id", "value", (F.col("event_id") % 1000 / 37.0).alias("lon"), ((F.col("event_id") * 7919 + F.col("user_id")) % 1000 / 41.0).alias("lat"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as polygons: squares with a hole, or shapes like an L with a slanted side."""
    k = F.col("n_nationkey")
    x, y = k % 5 * 5.0 + 0.3, F.floor(k / 5) * 4.5 + 0.2
    ring = lambda ps: F.array(*[F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in ps])
    shape = F.when(k % 2 == 0, F.array(ring(SQUARE), ring(HOLE))).otherwise(F.array(ring(ELL)))
    return table(spark, sf_dir, "nation").select(k.alias("region_id"), F.array(shape).alias("rings"))


SQUARE = ((0.0, 0.0), (6.0, 0.0), (6.0, 5.0), (0.0, 5.0))
HOLE = ((2.0, 1.5), (4.0, 1.5), (4.0, 3.5), (2.0, 3.5))
ELL = ((0.0, 0.0), (5.0, 0.0), (4.1, 2.3), (2.0, 2.0), (2.0, 5.0), (0.0, 5.0))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as nodes on the map, several at one place."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("node"), (k * 7919 % 997 / 37.0).alias("node_lon"), (k * 104729 % 991 / 41.0).alias("node_lat"))


def catalogue(scenes_: DataFrame, cells_: DataFrame) -> DataFrame:
    """Scenes as a catalogue's rows: tiles are regions, bounds their cell's."""
    c = cells_.select("cell_id", F.col("min_lon").alias("min_x"), F.col("min_lat").alias("min_y"), F.col("max_lon").alias("max_x"), F.col("max_lat").alias("max_y"))
    return scenes_.join(c, "cell_id").select(F.col("o_orderkey").alias("scene_id"), "month", F.col("region").alias("tile"), F.to_date("o_orderdate").alias("date"), "cloud_pct", "min_x", "min_y", "max_x", "max_y", "cell_id")
