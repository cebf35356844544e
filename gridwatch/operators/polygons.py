"""Pixels in polygons: regions of any shape, with holes and several parts, indexed by tiles.

A region is a row with its id and ``rings``: an array of polygons, each an array of rings (the first its outline, all others
holes) of points x, y; rings may be open or closed, in either direction. Every region is cut into the tiles of
a square lattice. A tile that no edge touches lies inside or outside as a whole; others keep those edges of the
region that cross the tile's row and don't lie to its left: a ray to the right meets no others. So a pixel meets regions
by an equi-join on its tile, and few edges a pixel are looked at, however many a region has.

Tiles that hold very many pixels are split by a salt, and their few rows of the index are copied to each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Rows of the index that are sent to all tasks; a larger one is joined by shuffles with salted tiles.
BROADCAST_ROWS = 20_000
#: A tile with more than 1 / HOT_SHARE of all pixels is split; there are fewer of these than HOT_SHARE.
HOT_SHARE = 512
#: Room for rounding at tile borders, in tiles.
_EPS = 1e-9


def edges(regions: DataFrame, region: str = "region_id") -> DataFrame:
    """One row per edge: region, x1, y1, x2, y2 and turn (1 or -1, which makes outlines run against the clock and holes with it).

    Rings of fewer than three points, and null points, have no edges."""
    r = regions.select(region, F.explode("rings").alias("part")).select(region, F.posexplode("part").alias("place", "ring"))
    r = r.withColumn("ring", F.filter("ring", lambda p: p["x"].isNotNull() & p["y"].isNotNull())).filter(F.size("ring") >= 3)
    after = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    r = r.withColumn("edge", F.arrays_zip(F.col("ring").alias("a"), after.alias("b")))
    area = F.aggregate("edge", F.lit(0.0), lambda t, e: t + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))
    r = r.withColumn("turn", F.when((area < 0) == (F.col("place") == 0), -1.0).otherwise(1.0)).select(region, "turn", F.explode("edge").alias("e"))
    flat = r.select(region, F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"), "turn")
    return flat.filter("x1 <> x2 OR y1 <> y2")


def _crossings(found: Column, x: Column, y: Column) -> Column:
    """How many of the edges a ray from (x, y) to the right crosses; an edge has its lower end and not its upper one."""
    crossed = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    return F.size(F.filter(found, crossed))


def inside(found: Column, x: Column, y: Column) -> Column:
    return _crossings(found, x, y) % 2 == 1


def tile_cover(regions: DataFrame, tile: float, region: str = "region_id") -> DataFrame:
    """The index: region, tx, ty, whole (the tile lies inside as a whole) and edges (null for whole tiles).

    A row of tiles of one region is one group: its edges there, and one row per tile of what they span."""
    e = edges(regions, region)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = e.withColumn("ty", F.explode(F.sequence(F.floor(low / tile - _EPS), F.floor(high / tile + _EPS))))
    # the part of the edge in this row of tiles, and the columns that it may touch
    at = lambda y: F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise(F.col("x1") + (F.greatest(low, F.least(high, y)) - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    a, b = at(F.col("ty") * tile), at((F.col("ty") + 1) * tile)
    flat = F.col("y1") == F.col("y2")
    left, right = F.when(flat, F.least("x1", "x2")).otherwise(F.least(a, b)), F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest(a, b))
    e = e.withColumns({"c0": F.floor(left / tile - _EPS), "c1": F.floor(right / tile + _EPS)})
    rows = e.groupBy(region, "ty").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2", "turn", "c0", "c1")).alias("row_edges"), F.min("c0").alias("first"), F.max("c1").alias("last"))
    t = rows.select(region, "ty", "row_edges", F.explode(F.sequence("first", "last")).alias("tx"))
    touched = F.exists("row_edges", lambda x: (x["c0"] <= F.col("tx")) & (x["c1"] >= F.col("tx")))
    middle = inside(F.col("row_edges"), (F.col("tx") + 0.5) * tile, (F.col("ty") + 0.5) * tile)
    t = t.withColumns({"touched": touched, "middle": middle}).filter("touched OR middle")
    near = F.transform(F.filter("row_edges", lambda x: F.greatest(x["x1"], x["x2"]) >= (F.col("tx") - 2 * _EPS) * tile), lambda x: F.struct(*[x[c].alias(c) for c in ("x1", "y1", "x2", "y2", "turn")]))
    return t.select(region, "tx", "ty", (~F.col("touched")).alias("whole"), F.when(F.col("touched"), near).alias("edges"))


def _meet(tiled: DataFrame, cover: DataFrame) -> DataFrame:
    """The equi-join of pixels and index on the tile: by broadcast where the index's size allows it, else with hot tiles split by a salt."""
    cover = written(cover, "tile-cover").withColumnsRenamed({c: f"_{c}" for c in ("tx", "ty", "whole", "edges")})
    if cover.count() <= BROADCAST_ROWS:
        return tiled.join(F.broadcast(cover), ["_tx", "_ty"])
    counts = tiled.groupBy("_tx", "_ty").agg(F.count("*").alias("n"))
    share = F.col("n") * HOT_SHARE / F.col("total")
    hot = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).filter(share > 1).select("_tx", "_ty", F.ceil(share).cast("int").alias("_salts"))
    hot = written(hot, "hot-tiles")
    salted = lambda df: df.join(F.broadcast(hot), ["_tx", "_ty"], "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    left = salted(tiled).withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in tiled.columns]), F.col("_salts")).cast("int")).drop("_salts")
    right = salted(cover).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return left.join(right, ["_tx", "_ty", "_salt"]).drop("_salt")


def in_regions(pixels: DataFrame, regions: DataFrame, tile: float, x: str = "lon", y: str = "lat", region: str = "region_id") -> DataFrame:
    """``pixels`` with the id of each region that holds their centre: one row per region, none outside of all. Pixels with a null place are in none."""
    tiled = pixels.withColumns({"_tx": F.floor(F.col(x) / tile), "_ty": F.floor(F.col(y) / tile)})
    met = _meet(tiled, tile_cover(regions, tile, region))
    return met.filter(F.col("_whole") | inside(F.col("_edges"), F.col(x), F.col(y))).select(*[f"`{c}`" for c in pixels.columns], region)


def _area(found: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The area of a region inside a box, from the edges that aren't to the box's left: along each edge's part between y0 and y1, the integral of
    how far the edge lies to the right of x0, cut at x1."""

    def primitive(u: Column) -> Column:  # of the cut distance
        d = F.least(F.greatest(u, x0), x1) - x0
        return d * d / 2 + F.greatest(u - x1, F.lit(0.0)) * (x1 - x0)

    def one(e: Column) -> Column:
        low, high = F.greatest(F.least(e["y1"], e["y2"]), y0), F.least(F.greatest(e["y1"], e["y2"]), y1)
        slope = (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])
        a, b = e["x1"] + (low - e["y1"]) * slope, e["x1"] + (high - e["y1"]) * slope
        steep = F.abs(b - a) <= (x1 - x0) * 1e-9
        mean = F.when(steep, F.least(F.greatest((a + b) / 2, x0), x1) - x0).otherwise((primitive(b) - primitive(a)) / (b - a))
        return F.when((e["y1"] != e["y2"]) & (high > low), F.signum(e["y2"] - e["y1"]) * e["turn"] * (high - low) * mean).otherwise(0.0)

    return F.aggregate(found, F.lit(0.0), lambda t, e: t + one(e))


def coverage(pixels: DataFrame, regions: DataFrame, tile: float, half: float, x: str = "lon", y: str = "lat", region: str = "region_id") -> DataFrame:
    """``pixels`` (centres of squares of half-width ``half``) with each region that they touch: ``share``, the part of the square's area inside, and
    ``centre``, whether its centre is.

    A square across a tile's border gives a row per tile, whose shares add up; only the centre's tile can have ``centre``. Sums over rows need no merge
    of these. Regions' rings must not cross themselves or each other."""
    spread = lambda c: F.explode(F.sequence(F.floor((F.col(c) - half) / tile), F.floor((F.col(c) + half) / tile)))
    tiled = pixels.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_tx", spread(x)).withColumn("_ty", spread(y))
    met = _meet(tiled, tile_cover(regions, tile, region))
    x0, x1 = F.greatest(F.col(x) - half, F.col("_tx") * tile), F.least(F.col(x) + half, (F.col("_tx") + 1) * tile)
    y0, y1 = F.greatest(F.col(y) - half, F.col("_ty") * tile), F.least(F.col(y) + half, (F.col("_ty") + 1) * tile)
    area = F.when(F.col("_whole"), (x1 - x0) * (y1 - y0)).otherwise(_area(F.col("_edges"), x0, y0, x1, y1))
    here = (F.floor(F.col(x) / tile) == F.col("_tx")) & (F.floor(F.col(y) / tile) == F.col("_ty"))
    centre = here & (F.col("_whole") | inside(F.col("_edges"), F.col(x), F.col(y)))
    out = met.withColumns({"share": area / (4 * half * half), "centre": centre})
    return out.filter((F.col("share") > 1e-12) | F.col("centre")).select(*[f"`{c}`" for c in pixels.columns], region, "share", "centre")


def zonal_weighted(covered: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """Per key: weighted mean and population deviation of ``value`` by share, the sum of the shares of pixels that have a value, and those whose centre is inside.

    All from sums that merge in any order, so partial sums meet in one exchange."""
    w, v = F.when(F.col(value).isNotNull(), F.col("share")), F.col(value)
    s = covered.groupBy(*keys).agg(F.sum(w).alias("weight"), F.sum(w * v).alias("wv"), F.sum(w * v * v).alias("wvv"), F.count_if(F.col("centre") & v.isNotNull()).alias("pixel_count"))
    mean = F.try_divide("wv", "weight")
    return s.select(*keys, mean.alias(f"{value}_mean"), F.sqrt(F.greatest(F.try_divide("wvv", "weight") - mean * mean, F.lit(0.0))).alias(f"{value}_std"), "weight", "pixel_count")
