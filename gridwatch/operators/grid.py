"""Grid, calendar and space: generators and assignments."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import ring

EARTH_RADIUS_M = 6_371_000.0


def generate_grid(bounds: DataFrame, cell_m: float) -> DataFrame:
    """Cells that tile each bounding box (min_lon, min_lat, max_lon, max_lat) exactly, row-major from its lower left.

    Steps start from ``cell_m`` at the middle latitude and are then fitted to whole numbers of rows and columns."""
    per_lat = F.lit(math.pi / 180 * EARTH_RADIUS_M)
    b = bounds.withColumn("per_lon", per_lat * F.cos(F.radians((F.col("min_lat") + F.col("max_lat")) / 2)))
    b = b.withColumns({"n_cols": F.greatest(F.lit(1), F.ceil((F.col("max_lon") - F.col("min_lon")) / (cell_m / F.col("per_lon")))), "n_rows": F.greatest(F.lit(1), F.ceil((F.col("max_lat") - F.col("min_lat")) / (F.lit(cell_m) / per_lat)))})
    b = b.withColumns({"dx": (F.col("max_lon") - F.col("min_lon")) / F.col("n_cols"), "dy": (F.col("max_lat") - F.col("min_lat")) / F.col("n_rows")})
    c = b.withColumn("index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") * F.col("n_cols") - 1)))
    c = c.withColumns({"row": F.floor(F.col("index") / F.col("n_cols")), "col": F.col("index") % F.col("n_cols")})
    x0, y0 = F.col("min_lon") + F.col("col") * F.col("dx"), F.col("min_lat") + F.col("row") * F.col("dy")
    return c.select(
        F.format_string("cell_%02d_%02d", "row", "col").alias("cell_id"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("index").cast("int").alias("index"),
        F.round(x0 + F.col("dx") / 2, 6).alias("centroid_lon"), F.round(y0 + F.col("dy") / 2, 6).alias("centroid_lat"), F.round(x0, 6).alias("min_lon"), F.round(x0 + F.col("dx"), 6).alias("max_lon"),
        F.round(y0, 6).alias("min_lat"), F.round(y0 + F.col("dy"), 6).alias("max_lat"), F.round(F.col("dx") * F.col("per_lon"), 1).alias("approx_width_m"), F.round(F.col("dy") * per_lat, 1).alias("approx_height_m"),
    )


def month_ranges(spans: DataFrame) -> DataFrame:
    """Half-open calendar months of each (start date, end date): month, start_date, end_date (clamped to the end), days_in_month (whole)."""
    m = spans.select("end", F.explode(F.sequence(F.trunc("start", "MM"), F.date_sub(F.col("end"), 1), F.expr("interval 1 month"))).alias("m"))
    end = F.least(F.add_months("m", 1), F.col("end"))
    return m.select(F.date_format("m", "yyyy-MM").alias("month"), F.date_format("m", "yyyy-MM-dd").alias("start_date"), F.date_format(end, "yyyy-MM-dd").alias("end_date"), F.dayofmonth(F.last_day("m")).alias("days_in_month"))


def month_ordinals(df: DataFrame, month: str = "month") -> DataFrame:
    """Each distinct month with its place in order, from 0; a calendar's months are few."""
    months = df.agg(F.array_sort(F.collect_set(month)).alias("months"))
    return months.select(F.posexplode("months").alias("month_ordinal", "month")).select("month", "month_ordinal")


def choropleth(grid: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """Every cell's outline with a value and whether it has one (cells without are drawn grey)."""
    return grid.join(values.select("cell_id", value), "cell_id", "left").select("cell_id", ring().alias("ring"), F.col(value).alias("value"), F.col(value).isNotNull().alias("has_value"))


def skeleton(cells: DataFrame, months: DataFrame) -> DataFrame:
    """Every cell in every month; the month list is short and is copied to each cell's row."""
    return cells.crossJoin(F.broadcast(months))


def within_bounds(df: DataFrame, min_lon: float, min_lat: float, max_lon: float, max_lat: float, pad: float = 0.0, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return df.filter(F.col(lon).between(min_lon - pad, max_lon + pad) & F.col(lat).between(min_lat - pad, max_lat + pad))


def assign_cells(pixels: DataFrame, min_lon: float, min_lat: float, dx: float, dy: float, n_cols: int, n_rows: int, edge: str = "centroid", half: float = 0.0) -> DataFrame:
    """Adds row, col and cell_id of the cell under each pixel's centre (lon, lat); ``touch``: of every cell that the pixel's square of half-width ``half`` touches."""
    if edge == "centroid":
        out = pixels.withColumns({"row": F.floor((F.col("lat") - min_lat) / dy).cast("int"), "col": F.floor((F.col("lon") - min_lon) / dx).cast("int")})
    else:
        spread = lambda c, low, step: F.explode(F.sequence(F.floor((F.col(c) - half - low) / step).cast("int"), F.floor((F.col(c) + half - low) / step).cast("int")))
        out = pixels.withColumn("row", spread("lat", min_lat, dy)).withColumn("col", spread("lon", min_lon, dx))
    out = out.filter(F.col("row").between(0, n_rows - 1) & F.col("col").between(0, n_cols - 1))
    return out.withColumn("cell_id", F.format_string("cell_%02d_%02d", "row", "col"))
