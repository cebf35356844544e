"""Spatial events: candidate cells of a month that share an edge, directly or through others."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as G
from ..session import written
from .components import least_reachable
from .ranks import cumulative

#: Cells are labelled in square tiles of this side; components that touch across tiles are merged after.
TILE = 256


def _labels(rows: list[int], cols: list[int]) -> list[int]:
    """For each cell, the position of its component's first cell; cells are in row-major order."""
    at = {rc: i for i, rc in enumerate(zip(rows, cols, strict=True))}
    label = [-1] * len(rows)
    for i in range(len(rows)):
        if label[i] >= 0:
            continue
        label[i], todo = i, [i]
        while todo:
            r, c = rows[k := todo.pop()], cols[k]
            for n in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                j = at.get(n)
                if j is not None and label[j] < 0:
                    label[j] = i
                    todo.append(j)
    return label


def _tiled(base: DataFrame) -> DataFrame:
    tile = lambda c: F.floor(F.col(c) / TILE).alias(f"{c}_tile")
    return base.select("*", tile("row"), tile("col"))


def _across_tiles(found: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``found`` (keys, row, col, first: the first cell of the component within the tile) with first as that of the whole component."""
    edges = None
    for along, across in (("row", "col"), ("col", "row")):
        here = found.filter(F.pmod(F.col(along), F.lit(TILE)) == TILE - 1).select(*keys, (F.col(along) + 1).alias(along), across, F.col("first").alias("a"))
        there = found.filter(F.pmod(F.col(along), F.lit(TILE)) == 0).select(*keys, along, across, F.col("first").alias("b"))
        one = here.join(there, [*keys, along, across]).select(*keys, "a", "b")
        edges = one if edges is None else edges.unionByName(one)
    edges = written(edges.distinct(), "tile-borders")
    if edges.isEmpty():
        return found
    merged = least_reachable(edges, keys).withColumnRenamed("node", "first")
    return found.join(merged, [*keys, "first"], "left").withColumn("first", F.coalesce("least", "first")).drop("least")


def event_cells(candidates: DataFrame, keys: tuple[str, ...] = ("month",)) -> DataFrame:
    """``candidates`` (keys, cell_id, row, col) with event_number: components by rook adjacency, numbered within each key by their row-major first cell.

    A group is one key's candidate cells of one tile: TILE * TILE at most, however large the grid. Events are numbered by ranges."""
    base = candidates.select(*keys, "cell_id", "row", "col")
    schema = T.StructType([*base.schema, T.StructField("first_row", T.IntegerType()), T.StructField("first_col", T.IntegerType())])
    columns = base.columns

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[columns].sort_values(["row", "col"], ignore_index=True)
        first = _labels(pdf["row"].tolist(), pdf["col"].tolist())
        return pdf.assign(first_row=pdf["row"].to_numpy()[first].astype("int32"), first_col=pdf["col"].to_numpy()[first].astype("int32"))

    found = written(_tiled(base).groupBy(*keys, "row_tile", "col_tile").applyInPandas(label, schema), "tiles")
    found = _across_tiles(found.withColumn("first", F.struct("first_row", "first_col")).drop("first_row", "first_col"), keys)
    numbers = cumulative(found.select(*keys, "first").distinct(), keys, "first").select(*keys, "first", (F.col("below") + 1).cast("int").alias("event_number"))
    return found.join(numbers, [*keys, "first"]).select(*base.columns, "event_number")


def spanning_forest(rows: list[int], cols: list[int], levels: list[float]) -> list[tuple[float, int, int]]:
    """A maximum spanning forest of cells by rook adjacency, the strongest edges first: (weight, cell, cell). An edge weighs the lower level of its ends."""
    at = {rc: i for i, rc in enumerate(zip(rows, cols, strict=True))}
    found = []
    for i, (r, c) in enumerate(zip(rows, cols, strict=True)):
        for n in ((r + 1, c), (r, c + 1)):
            if (j := at.get(n)) is not None:
                found.append((min(levels[i], levels[j]), i, j))
    found.sort(key=lambda e: -e[0])
    parent = list(range(len(rows)))
    return [e for e in found if _joined(parent, e[1], e[2])]


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _joined(parent: list[int], i: int, j: int) -> bool:
    """Joins two sets under the smaller root; False if they were one."""
    a, b = _root(parent, i), _root(parent, j)
    parent[max(a, b)] = min(a, b)
    return a != b


def cuts(forest: list[tuple[float, int, int]], levels: list[float], taus: tuple[float, ...]) -> list[tuple[float, int, int]]:
    """(tau, cell, first cell of its component) for every cell that reaches tau, of all taus: one walk down the forest, as components only grow."""
    parent, out, k = list(range(len(levels))), [], 0
    for tau in sorted(taus, reverse=True):
        while k < len(forest) and forest[k][0] >= tau:
            _joined(parent, forest[k][1], forest[k][2])
            k += 1
        out += [(tau, i, _root(parent, i)) for i, level in enumerate(levels) if level >= tau]
    return out


def nested_event_cells(levels: DataFrame, taus: tuple[float, ...], keys: tuple[str, ...] = ("month",)) -> DataFrame:
    """Events of all thresholds at once, from ``levels`` (keys, cell_id, row, col, level: the highest threshold at which the cell is a candidate): keys, tau, cell_id, row, col, first.

    Candidates only come in as tau falls, so the events of all taus are cuts of one maximum spanning forest. It is built once
    per key and tile; what touches across tiles is merged per tau on the borders. ``first`` (row, col) names an event."""
    base = levels.select(*keys, "cell_id", "row", "col", F.col("level").cast("double").alias("level")).filter(F.col("level") >= min(taus))
    columns = [c for c in base.columns if c != "level"]
    schema = T.StructType([*[base.schema[c] for c in columns], T.StructField("tau", T.DoubleType()), T.StructField("first_row", T.IntegerType()), T.StructField("first_col", T.IntegerType())])

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"], ignore_index=True)
        rows, cols, level = pdf["row"].tolist(), pdf["col"].tolist(), pdf["level"].tolist()
        found = cuts(spanning_forest(rows, cols, level), level, taus)
        out = pdf.loc[[i for _, i, _ in found], columns].reset_index(drop=True)
        first = [f for _, _, f in found]
        return out.assign(tau=[t for t, _, _ in found], first_row=pd.Series([rows[f] for f in first], dtype="int32"), first_col=pd.Series([cols[f] for f in first], dtype="int32"))

    found = written(_tiled(base).groupBy(*keys, "row_tile", "col_tile").applyInPandas(label, schema), "nested-tiles")
    found = found.withColumn("first", F.struct("first_row", "first_col")).drop("first_row", "first_col")
    return _across_tiles(found, (*keys, "tau")).select(*keys, "tau", "cell_id", "row", "col", "first")


def _mode(c: str):
    return F.mode(c, True)


def spatial_events(cells: DataFrame, evidence: DataFrame, dominant: DataFrame, geometry: DataFrame, coherent: int = 2) -> DataFrame:
    """One row per event: size, coherence, centroid, bounds, scores, supporting cells by modality, most frequent feature and direction (ties to the first by name), cells."""
    j = cells.join(evidence, ["month", "cell_id"]).join(dominant, ["month", "cell_id"]).join(geometry, "cell_id")
    e = j.groupBy("month", "event_number").agg(
        F.count("*").alias("cell_count"), F.round(F.avg("centroid_lon"), 4).alias("centroid_lon"), F.round(F.avg("centroid_lat"), 4).alias("centroid_lat"), F.min("min_lon").alias("min_lon"), F.max("max_lon").alias("max_lon"),
        F.min("min_lat").alias("min_lat"), F.max("max_lat").alias("max_lat"), F.round(F.avg("activity_score"), 4).alias("mean_score"), F.max("activity_score").alias("max_score"), F.count_if(F.col("optical_count") >= 1).alias("optical_cells"),
        F.count_if("viirs_anomalous").alias("viirs_cells"), F.count_if(F.col("weather_count") >= 1).alias("weather_cells"), _mode("dominant_feature").alias("dominant_feature"), _mode("dominant_direction").alias("dominant_direction"), G.string_list(F.col("cell_id")).alias("cells"),
    )
    return e.select(G.event_id(F.col("month"), F.col("event_number")).alias("event_id"), "month", "cell_count", (F.col("cell_count") >= coherent).alias("spatially_coherent"), *e.columns[3:])


def monthly_anomalies(evidence: DataFrame, cells: DataFrame, coherent: int = 2) -> DataFrame:
    """Per month: cells, candidates and their share, events of several cells and of one, mean evidence."""
    m = evidence.groupBy("month").agg(F.count("*").alias("total_cells"), F.count_if("activity_candidate").alias("candidate_anomalous_cells"), F.round(F.avg("activity_score"), 4).alias("mean_activity_evidence"))
    sizes = cells.groupBy("month", "event_number").count().groupBy("month").agg(F.count("*").alias("total_spatial_events"), F.count_if(F.col("count") >= coherent).alias("multi_cell_events"))
    j = m.join(sizes, "month", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("total_spatial_events", "multi_cell_events")})
    return j.withColumns({"candidate_pct": F.round(F.col("candidate_anomalous_cells") * 100 / F.col("total_cells"), 2), "single_cell_events": F.col("total_spatial_events") - F.col("multi_cell_events")})


def event_map(grid: DataFrame, cells: DataFrame, month: str) -> DataFrame:
    """Every cell with its event of one month, or null: the rows of an event map."""
    return grid.join(cells.filter(F.col("month") == month).select("cell_id", "event_number"), "cell_id", "left")
