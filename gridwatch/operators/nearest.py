"""Each cell's nearest node, for any number of either: boxes of cells search through tiles of nodes, and stop where bounds prove the answer.

Nodes lie in a pyramid of tiles: each level halves the side, down to tiles of a few nodes. A cell's box is the smallest tile
around it that has many nodes (cells outside all tiles have boxes of their own), cut to its cells. A box starts with the whole,
and looks level by level at the four parts of the tiles that it still has: some node of a tile is at most as far from any
cell as the two boxes' farthest corners, and none is nearer than the boxes. Tiles beyond the least such distance are dropped.
Cells move once, to meet the nodes of their box's last tiles in a task, which halves the box by the same bounds.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import written

#: About so many nodes in a tile of the last level; levels at most.
LEAF, LEVELS = 16, 24
#: Tiles or nodes that are sent to all tasks; more are joined by shuffles.
BROADCAST_ROWS = 50_000
#: A box has so many nodes at least, or more where there were more than BROADCAST_ROWS such tiles on a level. Cells and nodes that a task holds of a box.
MANY, CELLS, NODES = 256, 1 << 16, 1 << 16
_BOX = ("x0", "x1", "y0", "y1")
_KEY = ("level", "bx", "by")


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def pyramid(nodes: DataFrame, leaf: int = LEAF) -> tuple[list[tuple[DataFrame, int]], DataFrame, Row]:
    """Tables of the levels, from the coarsest with more than one tile to the last, each (tx, ty, the box and the number n of the nodes) with its rows; the nodes with their tile on the last; and what they span (x, y, side and n).

    Nodes at one place are one, the smallest. Levels go on until no tile has more than ``leaf`` places."""
    at = written(nodes.filter("node_lon IS NOT NULL AND node_lat IS NOT NULL").groupBy("node_lon", "node_lat").agg(F.min("node").alias("node")), "nodes")
    span = at.agg(F.min("node_lon").alias("x"), F.min("node_lat").alias("y"), F.greatest(F.max("node_lon") - F.min("node_lon"), F.max("node_lat") - F.min("node_lat")).alias("side"), F.count("*").alias("n")).first()

    def placed(level: int) -> DataFrame:
        side = (span.side or 1.0) / 2**level
        return at.withColumns({"tx": F.least(F.floor((F.col("node_lon") - span.x) / side), F.lit(2**level - 1)), "ty": F.least(F.floor((F.col("node_lat") - span.y) / side), F.lit(2**level - 1))})

    depth = 0
    if span.n > leaf:
        depth = max(1, math.ceil(math.log(span.n / leaf, 4)))
        most = lambda d: placed(d).groupBy("tx", "ty").count().agg(F.max("count")).first()[0]
        while depth < LEVELS and (full := most(depth)) > leaf:
            depth = min(LEVELS, depth + max(1, math.ceil(math.log(full / leaf, 4))))
    last = written(placed(depth), "node-tiles")
    levels = []
    table = last.groupBy("tx", "ty").agg(F.min("node_lon").alias("x0"), F.max("node_lon").alias("x1"), F.min("node_lat").alias("y0"), F.max("node_lat").alias("y1"), F.count("*").alias("n"))
    for level in range(depth, 0, -1):
        table = written(table, f"tiles-{level}")
        levels.append((table, table.count()))
        half = lambda c: F.shiftright(c, 1).alias(c)
        table = table.groupBy(half("tx"), half("ty")).agg(*[(F.min if c in ("x0", "y0") else F.max)(c).alias(c) for c in _BOX], F.sum("n").alias("n"))
    return levels[::-1], last, span


def _bounds() -> tuple[Column, Column]:
    """The least squared distance between the boxes x0, x1, y0, y1 and cx0, cx1, cy0, cy1, and the largest."""
    near = lambda a, b: F.greatest(F.col(a) - F.col(f"c{b}"), F.col(f"c{a}") - F.col(b), F.lit(0.0))
    far = lambda a, b: F.greatest(F.col(b) - F.col(f"c{a}"), F.col(f"c{b}") - F.col(a))
    square = lambda f: f("x0", "x1") * f("x0", "x1") + f("y0", "y1") * f("y0", "y1")
    return square(near), square(far)


def _boxed(cells: DataFrame, levels: list[tuple[DataFrame, int]], span: Row) -> DataFrame:
    """``cells`` with their box: its level, bx and by."""
    x, y = F.col("centroid_lon") - span.x, F.col("centroid_lat") - span.y
    tile = lambda u, level: F.least(F.floor(u / (span.side / 2**level)), F.lit(2**level - 1))
    many = max(MANY, span.n // max(BROADCAST_ROWS, 1))
    box = F.struct(F.lit(0).alias("level"), F.lit(0).cast("long").alias("bx"), F.lit(0).cast("long").alias("by"))
    for level, (table, _) in enumerate(levels, 1):
        dense = table.filter(F.col("n") >= many).select(F.col("tx").alias(f"bx{level}"), F.col("ty").alias(f"by{level}"))
        if dense.isEmpty():
            break
        cells = cells.join(F.broadcast(dense), (tile(x, level) == F.col(f"bx{level}")) & (tile(y, level) == F.col(f"by{level}")), "left")
        box = F.when(F.col(f"bx{level}").isNotNull(), F.struct(F.lit(level).alias("level"), F.col(f"bx{level}").alias("bx"), F.col(f"by{level}").alias("by"))).otherwise(box)
    off = F.greatest(-x, x - span.side, -y, y - span.side) / span.side
    outside = F.greatest(F.floor(F.log2(F.greatest(off, F.lit(2.0**-9)))), F.lit(-3)).cast("int")  # the farther, the larger
    own = lambda u: F.floor(u / span.side / F.pow(F.lit(2.0), outside))
    box = F.when(off > 0, F.struct((-outside - 4096).alias("level"), own(x).alias("bx"), own(y).alias("by"))).otherwise(box)
    return cells.select("cell_id", "centroid_lon", "centroid_lat", box.alias("box")).select("cell_id", "centroid_lon", "centroid_lat", "box.*")


def _search(_: tuple, cells: pa.Table, nodes: pa.Table) -> pa.Table:
    """Each cell's nearest of ``nodes``, and how far it is: cells are halved, and each half keeps the nodes that may be a cell's nearest."""
    nodes = nodes.sort_by("node")  # the first of the nearest is the smallest
    x, y, u, v = (t.column(c).to_numpy().astype(np.float64) for t, c in ((cells, "centroid_lon"), (cells, "centroid_lat"), (nodes, "node_lon"), (nodes, "node_lat")))
    best, d2 = np.zeros(len(x), np.int64), np.zeros(len(x))
    todo = [(np.arange(len(x)), np.arange(len(u)))] if len(x) and len(u) else []
    while todo:
        c, k = todo.pop()
        a, b, p, q = x[c], y[c], u[k], v[k]
        x0, x1, y0, y1 = a.min(), a.max(), b.min(), b.max()
        if len(k) > 16:
            low = np.square(np.maximum(np.maximum(p - x1, x0 - p), 0)) + np.square(np.maximum(np.maximum(q - y1, y0 - q), 0))
            high = np.square(np.maximum(p - x0, x1 - p)) + np.square(np.maximum(q - y0, y1 - q))
            near = low <= high.min() * (1 + 1e-12)
            k, p, q = k[near], p[near], q[near]
        if len(c) > 64 and len(k) > 16 and (x0 < x1 or y0 < y1):
            at = a if x1 - x0 >= y1 - y0 else b
            half = np.argpartition(at, len(c) // 2)
            todo += [(c[half[: len(c) // 2]], k), (c[half[len(c) // 2 :]], k)]
            continue
        few = max(1, (1 << 18) // len(k))
        for i in range(0, len(c), few):
            d = np.square(p - a[i : i + few, None]) + np.square(q - b[i : i + few, None])
            first = d.argmin(1)
            best[c[i : i + few]], d2[c[i : i + few]] = k[first], d[np.arange(len(d)), first]
    found = nodes.take(pa.array(best[: len(u) * len(x)]))
    return pa.table({"cell_id": cells.column("cell_id").slice(0, len(found)), "d2": d2[: len(found)], **{c: found.column(c) for c in ("node", "node_lon", "node_lat")}})


def _candidates(boxes: DataFrame, levels: list[tuple[DataFrame, int]]) -> DataFrame:
    """The tiles of the last level that may have a nearest node of some cell of a box, with the number of their nodes."""
    kept = boxes.select(*_KEY, *[f"c{c}" for c in _BOX], F.lit(0).cast("long").alias("tx"), F.lit(0).cast("long").alias("ty"))
    columns = kept.columns
    shuffled = False
    for table, rows in levels:
        parts = F.explode(F.array(*[F.struct((2 * F.col("tx") + i).alias("tx"), (2 * F.col("ty") + j).alias("ty")) for i in (0, 1) for j in (0, 1)]))
        met = kept.select(*columns[:-2], parts.alias("t")).select(*columns[:-2], "t.*").join(_sized(table, rows), ["tx", "ty"])
        low, high = _bounds()
        met = met.select(*columns, "n", low.alias("low"), F.min(high).over(Window.partitionBy(*_KEY)).alias("least"))
        kept = met.filter(F.col("low") <= F.col("least") * (1 + 1e-12)).select(*columns, "n")
        shuffled = shuffled or rows > BROADCAST_ROWS
        kept = written(kept, "search") if shuffled else kept
    return kept.select(*_KEY, "tx", "ty", "n")


def nearest_node(cells: DataFrame, nodes: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Each cell (cell_id, centroid_lon, centroid_lat) with its nearest node (node_lon, node_lat, node) by squared degrees; ties to the smaller node.

    cell_id must be unique. Without any node, or without a place, a cell has nulls; nodes without a place aren't found. A cell at
    NaN or infinity is as far from all nodes: it gets the smallest."""
    levels, last, span = pyramid(nodes, leaf)
    columns = ("node", "node_lon", "node_lat")
    types = dict(last.dtypes)
    x, y = F.col("centroid_lon"), F.col("centroid_lat")
    cells = cells.select("cell_id", x.cast("double").alias("centroid_lon"), y.cast("double").alias("centroid_lat"))
    literal = lambda row: F.struct(*[F.lit(row[c]).cast(types[c]).alias(c) for c in columns])
    placed = x.isNotNull() & y.isNotNull()
    if not levels:
        few = F.array(*[literal(row) for row in last.orderBy("node").collect()])
        d2 = lambda n: F.pow(n["node_lon"] - x, 2) + F.pow(n["node_lat"] - y, 2)
        best = F.array_min(F.transform(few, lambda n: F.struct(d2(n).alias("d2"), *[n[c].alias(c) for c in columns]))) if span.n else literal(dict.fromkeys(columns))
        return cells.select("cell_id", F.when(placed, best).alias("best")).select("cell_id", *[F.col(f"best.{c}").alias(c) for c in columns])
    finite = F.coalesce((F.abs(x) < float("inf")) & (F.abs(y) < float("inf")), F.lit(False))
    rest = cells.filter(~finite).select("cell_id", F.when(placed, literal(last.orderBy("node").first())).alias("best")).select("cell_id", *[F.col(f"best.{c}").alias(c) for c in columns])
    boxed = _boxed(cells.filter(finite), levels, span)
    boxes = written(boxed.groupBy(*_KEY).agg(*[(F.min if c in ("x0", "y0") else F.max)("centroid_lon" if c[0] == "x" else "centroid_lat").alias(f"c{c}") for c in _BOX], F.count("*").alias("cells")), "boxes")
    near = _candidates(boxes, levels)
    before = F.sum("n").over(Window.partitionBy(*_KEY).orderBy("tx", "ty")) - F.col("n")
    near = written(near.select(*_KEY, "tx", "ty", F.floor(before / NODES).cast("int").alias("part")).join(boxes.select(*_KEY, F.ceil(F.col("cells") / CELLS).cast("int").alias("salts")), list(_KEY)), "near-tiles")
    dealt = near.groupBy(*_KEY).agg(F.max("salts").alias("salts"), (F.max("part") + 1).alias("parts")).filter("salts > 1 OR parts > 1")
    parts = dealt.agg(F.max("parts")).first()[0] or 1
    met = near.join(_sized(last, span.n), ["tx", "ty"]).select(*_KEY, "part", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *columns)
    moved = boxed.join(F.broadcast(dealt), list(_KEY), "left").withColumn("salt", F.pmod(F.xxhash64("cell_id"), F.coalesce("salts", F.lit(1))).cast("int"))
    moved = moved.select("cell_id", "centroid_lon", "centroid_lat", *_KEY, "salt", (F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)) if parts > 1 else F.lit(0)).alias("part"))
    keys = [*_KEY, "salt", "part"]
    kind = StructType([cells.schema["cell_id"], StructField("d2", DoubleType()), *[last.schema[c] for c in columns]])
    found = moved.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(_search, kind)
    if parts > 1:
        found = found.groupBy("cell_id").agg(F.min(F.struct("d2", *columns)).alias("best")).select("cell_id", *[F.col(f"best.{c}").alias(c) for c in columns])
    return found.select("cell_id", *columns).unionByName(rest)
