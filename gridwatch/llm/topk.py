"""Exact top-k inner-product search with vector-approximation files.

Equal vectors are one class with its smallest ids, searched for once and found once; a hash tells which vectors have no
equal, and only the others are grouped. Classes lie in blocks of cells: one byte a component, on a grid that is fitted to
the block. A cell's middle and half-width bound every inner product from both sides. One scan of the cells, in bundles of
blocks, keeps for each query the vectors of a bundle whose upper bound reaches a score that the kth of that bundle surely
reaches; of these the ones stay that reach such a score of all bundles. Only their exact vectors are read, those of the
highest bounds first: the kth best of these is a score that settles which of the others are read at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bit_filter, bit_split

SCALE, CELLS = 256, 256
#: Vectors on one grid. Bytes of cells in a bundle of blocks, of vectors in a block of queries, and of products that a task holds, at most (or one block's).
BLOCK, BUNDLE_BYTES, QUERY_BYTES, HELD_BYTES = 512, 1 << 20, 2 << 20, 16 << 20
BLOCKS = "bundle long, dim int, rows binary, low binary, step binary, half binary, cells binary"
#: Pairs that a task returns at once, about.
PAIRS = 1 << 16
#: Whole numbers below this are exact as 32-bit floats, and so are their sums.
SMALL = 1 << 24
#: From this size on neighbouring whole numbers aren't told apart by 64-bit floats; larger components are whole already.
EXACT = 1 << 53


def integers(emb: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, dim, v) with v = floor(SCALE * x) as 64-bit floats, which hold these whole numbers exactly at any size.

    Without null ids, and vectors that are null or hold null, NaN or infinity. A component of 2**1015 or more is an error."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    d = emb.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter("vec_id IS NOT NULL AND x IS NOT NULL")
    d = d.filter(F.forall("x", lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False))))
    small = F.forall("x", lambda c: F.abs(c) < 2.0**1015)
    d = d.withColumn("x", F.when(small, F.col("x")).otherwise(F.raise_error(F.format_string("vector %d has a component too large to be scaled", F.col("vec_id")))))
    whole = lambda c: F.when(F.abs(c) < EXACT / SCALE, F.floor(c * SCALE).cast("double")).otherwise(c * SCALE)
    return d.select("vec_id", F.size("x").alias("dim"), F.transform("x", whole).alias("v"))


def classes(ints: DataFrame, most: int) -> DataFrame:
    """(row, dim, v, h, members) per distinct vector of ``ints`` (with row and the vectors' hash h), with its ``most`` smallest ids and how many rows each of these has."""
    ids = ints.groupBy("dim", "v", "h", "vec_id").agg(F.count("*").alias("n"), F.min("row").alias("row"))
    first = F.row_number().over(Window.partitionBy("dim", "v", "h").orderBy("vec_id"))
    ids = ids.withColumn("k", first).filter(F.col("k") <= most)
    return ids.groupBy("dim", "v", "h").agg(F.min("row").alias("row"), F.collect_list(F.struct("vec_id", "n")).alias("members")).select("row", "dim", "v", "h", "members")


def distinct(ints: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """``classes`` of a written table: vectors whose hash no other row has are classes as they are, and aren't moved."""
    again = scratch.write(ints.groupBy("h").count().filter("count > 1").select("h"), "va-again")
    shared, lone = bit_split(ints, F.col("h"), again, "h")
    lone = lone.select("row", "dim", "v", "h", F.array(F.struct("vec_id", F.lit(1).cast("long").alias("n"))).alias("members"))
    return lone.unionByName(scratch.write(classes(shared, most), "va-classes"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), dim)


def _middle(low: np.ndarray, step: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The middle of the whole numbers in each cell: the number itself where a cell has one."""
    return low + cells * step + (step - 1) / 2


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lowest value, cell width and half-width (how far any value lies from its cell's middle) of each component, and each value's cell."""
    low = v.min(0)
    step = np.maximum((v.max(0) / CELLS - low / CELLS) * (1 + 2.0**-40), 1.0)
    cells = np.clip(np.floor((v - low) / step), 0, CELLS - 1)
    half = np.abs(v - _middle(low, step, cells)).max(0) * (1 + 2.0**-40)
    return low, step, half, cells.astype(np.uint8)


def _blocks(size: int):
    """Rows of a bundle each, whose blocks of ``size`` vectors follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        at = TaskContext.get().partitionId() << 32
        done = 0

        def row(dim: int, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            grids = [quantised(v[a : a + size]) for a in range(0, len(v), size)]
            cols = [[at + done], [dim], [ids.tobytes()], *[[b"".join(x.tobytes() for x in part)] for part in zip(*grids, strict=True)]]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[2:]]], ["bundle", "dim", "rows", "low", "step", "half", "cells"])

        for batch in batches:
            dims, ids = batch.column("dim").to_numpy(), batch.column("row").to_numpy()
            for dim in np.unique(dims).tolist():
                take = np.flatnonzero(dims == dim)
                parts = held.setdefault(dim, [])
                parts.append((ids[take], _matrix(batch.column("v").take(pa.array(take)), dim)))
                most = max(1, BUNDLE_BYTES // (size * max(dim, 8))) * size
                if sum(len(i) for i, _ in parts) >= most:
                    i, v = (np.concatenate(x) for x in zip(*parts, strict=True))
                    whole = len(i) // most * most
                    for a in range(0, whole, most):
                        yield row(dim, i[a : a + most], v[a : a + most])
                        done += 1
                    held[dim] = [(i[whole:], v[whole:])]
        for dim, parts in held.items():
            i, v = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(i):
                yield row(dim, i, v)
                done += 1

    return run


def _query_block(key: tuple, rows: pa.Table) -> pa.Table:
    dim = key[0].as_py()
    cols = [rows.column("row").to_numpy().tobytes(), _matrix(rows.column("v"), dim).tobytes()]
    return pa.table({"dim": pa.array([dim], pa.int32()), "g": pa.array([key[1].as_py()], pa.int64()), "qrows": pa.array([cols[0]], pa.binary()), "q": pa.array([cols[1]], pa.binary())})


def _grid(low: np.ndarray, step: np.ndarray, half: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells' middles (as 32-bit floats where these are exact), half-widths, and the largest size of each component."""
    middle = _middle(low, step, cells)
    largest = np.abs(middle).max(0, initial=0) + half
    exact = (largest < SMALL).all() and (middle == np.floor(middle)).all()
    return middle.astype(np.float32) if exact else middle, half, largest


def _about(q: np.ndarray, middle: np.ndarray, half: np.ndarray, largest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.abs(q) @ largest
        room = np.abs(q) @ half + 0.5 + (len(half) + 8) * 2.0**-50 * size
        if middle.dtype == np.float32 and (size < SMALL).all() and (np.abs(q) < SMALL).all():
            return (middle @ q.T.astype(np.float32)).T, room  # sums of whole numbers, exact
        about = (middle.astype(np.float64) @ q.T).T
    fine = np.isfinite(about) & np.isfinite(room)[:, None]  # else nothing is known of the score
    return np.where(fine, about, 0.0), np.where(fine.all(1), room, np.inf)


def bounds(q: np.ndarray, low: np.ndarray, step: np.ndarray, half: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For queries and the cells of a block: products with the cells' middles, and how far exact scores lie from these at most.

    The second allows for rounding, in proportion to the largest sum that could arise."""
    return _about(q, *_grid(low, step, half, cells))


def _highest(about: np.ndarray, wide: int) -> np.ndarray:
    """For each query (column) the highest of the vectors (rows) in each of ``wide`` sets: the vectors of one remainder by that."""
    whole = len(about) // wide * wide
    most = about[:whole].reshape(-1, wide, about.shape[1]).max(0)
    rest = len(about) - whole
    most[:rest] = np.maximum(most[:rest], about[whole:])
    return most


def _reaching(k: int, size: int):
    """(qrow, row, lower, upper): for each query and bundle the vectors whose upper bound reaches a score that k vectors of the bundle reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for batch in batches for one in range(batch.num_rows) for r in batch.slice(one, 1).to_pylist()):
            dim, qrows, rows = r["dim"], np.frombuffer(r["qrows"], np.int64), np.frombuffer(r["rows"], np.int64)
            q = np.frombuffer(r["q"], np.float64).reshape(len(qrows), dim)
            cells = np.frombuffer(r["cells"], np.uint8).reshape(len(rows), dim)
            starts = range(0, len(rows), size)
            low, step, half = (np.frombuffer(r[c], np.float64).reshape(len(starts), dim) for c in ("low", "step", "half"))
            grids = [_grid(*g, cells[b : b + size].astype(np.float64)) for b, *g in zip(starts, low, step, half, strict=True)]
            few = max(1, HELD_BYTES // (8 * len(rows)))
            for a in range(0, len(q), few):
                found = [(x.T, room) for x, room in (_about(q[a : a + few], *g) for g in grids)]
                sets = [-(-len(x) // 16) if len(rows) >= 256 * k else len(x) for x, _ in found]
                tops = [_highest(x, w) for (x, _), w in zip(found, sets, strict=True)]
                lower = np.concatenate([(top - room).T for top, (_, room) in zip(tops, found, strict=True)], axis=1)
                least = np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k] if lower.shape[1] >= k else np.full(len(lower), -np.inf)
                out, held = [], 0
                for b, (x, room), w, top in zip(starts, found, sets, tops, strict=True):
                    bar = least - room
                    if x.dtype == np.float32:
                        with np.errstate(over="ignore"):
                            bar = np.nextafter(bar.astype(np.float32), np.float32(-np.inf))
                    one, i = np.nonzero(top >= bar)  # only sets with such a vector are looked into
                    j = np.arange(0, len(x), w) + one[:, None]
                    inside = (j < len(x)) & (x[np.minimum(j, len(x) - 1), i[:, None]] >= bar[i, None])
                    i, j = np.broadcast_to(i[:, None], j.shape)[inside], j[inside]
                    s = x[j, i].astype(np.float64)
                    out.append((qrows[a + i], rows[b + j], s - room[i], s + room[i]))
                    held += len(i)
                    if held >= PAIRS or b == starts[-1]:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["qrow", "row", "lower", "upper"])
                        out, held = [], 0

    return run


def _in_python(digits: int):
    """Exact scores of any size (up to 10**digits), as text of one length whose order is that of the numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            texts = [f"{s + 10**digits:0{digits + 1}d}" for s in scores]
            values = [s if -(2**63) <= s < 2**63 else None for s in scores]
            yield pa.RecordBatch.from_arrays([batch.column("qrow"), batch.column("row"), pa.array(texts, pa.string()), pa.array(values, pa.int64()), pa.array(map(float, scores), pa.float64())], ["qrow", "row", "score", "value", "about"])

    return run


def top_k(emb: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``is_query`` (a condition on the column vec_id) its k highest scores.

    The score is the integer inner product of floor(SCALE * x); ties go to the smaller vec_id; a query's own
    vec_id is no candidate, and vectors of another dimension aren't either. Rows that repeat a vec_id are each
    candidates, and one query (with the least of their vectors). Unusable vectors take no part; fewer than k
    candidates give as many rows; an empty table gives none; other columns are ignored. Vectors without any component
    score 0 with their like. Sums beyond 64 bits are taken in decimals or in Python's integers; only a score in the result that doesn't fit is
    an error, and nothing ever wraps. Every block of queries meets every bundle of cells once, each pair in a task of its own if there are
    as many tasks."""
    spark = emb.sparkSession
    with Scratch(spark) as scratch:
        ints = integers(emb, id_col, vec_col).withColumns({"h": F.xxhash64("dim", "v"), "row": F.monotonically_increasing_id()})
        ints = scratch.write(ints, "va-vectors")
        vectors = distinct(ints, k + 1, scratch)
        asked = ints.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "v", "h")).alias("q"), F.count_distinct("dim", "v").alias("own"))
        asked = scratch.write(asked.select(F.col("vec_id").alias("query_id"), "q.*", "own"), "va-asked")
        hit = bit_filter(vectors.select("row", "dim", "v", "h"), "h", asked, "h")
        asked = scratch.write(asked.join(hit, ["dim", "v", "h"]).select("query_id", F.col("row").alias("qrow"), "dim", "v", "own"), "va-searches-by-id")
        top = k + (asked.agg(F.max("own")).first()[0] or 1)  # so many classes, as those of a query's own id may be among them
        queries = scratch.write(asked.select(F.col("qrow").alias("row"), "dim", "v").dropDuplicates(["row"]), "va-searches")
        asked = scratch.write(asked.select("query_id", "qrow"), "va-queries", keep=True)
        size = vectors.agg(F.max(F.array_max(F.transform("v", lambda c: F.abs(c)))).alias("big"), F.max("dim").alias("dim")).first()
        largest = int(size.big or 0) ** 2 * max(size.dim or 0, 1)
        number = "long" if largest < 2**63 else "decimal(38,0)" if largest < 10**37 and size.big < EXACT else None
        bundles = scratch.write(vectors.select("row", "dim", "v").mapInArrow(_blocks(BLOCK), BLOCKS), "va-cells")
        groups = max(1, -(-queries.count() * max(size.dim or 0, 1) * 8 // QUERY_BYTES))
        blocks = queries.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups))).groupBy("dim", "g").applyInArrow(_query_block, "dim int, g long, qrows binary, q binary")
        blocks = scratch.write(blocks, "va-query-blocks")

        def exact(some: DataFrame) -> DataFrame:
            both = some.join(read.select("row", F.col("v").alias("y")), "row").join(queries.select(F.col("row").alias("qrow"), F.col("v").alias("x")), "qrow")
            if number is None:
                return both.select("qrow", "row", "x", "y").mapInArrow(_in_python(len(str(largest))), "qrow long, row long, score string, value long, about double")
            product = F.aggregate(F.zip_with("x", "y", lambda x, y: (x.cast(number) * y.cast(number)).cast(number)), F.lit(0).cast(number), lambda t, z: (t + z).cast(number))
            return both.select("qrow", "row", product.alias("score")).select("*", F.expr("try_cast(score AS bigint)").alias("value"), F.col("score").cast("double").alias("about"))

        order = lambda by: F.row_number().over(Window.partitionBy("qrow").orderBy(F.desc(by), "row"))
        dealt = blocks.join(F.broadcast(bundles.select("dim", "bundle")), "dim")
        pairs = bundles.join(F.broadcast(blocks.select("dim", "g")), "dim").join(dealt, ["dim", "g", "bundle"])
        near = pairs.mapInArrow(_reaching(top, BLOCK), "qrow long, row long, lower double, upper double")
        near = near.withColumn("at", order("lower")).withColumn("least", F.max(F.when(F.col("at") == top, F.col("lower"))).over(Window.partitionBy("qrow")))
        reach = scratch.write(near.filter(F.col("least").isNull() | (F.col("upper") >= F.col("least"))).select("qrow", "row", "upper"), "va-reach")
        read = scratch.write(bit_filter(vectors.select("row", "v", "members"), "row", reach, "row"), "va-read")
        ahead = exact(reach.withColumn("at", order("upper")).filter(F.col("at") <= 2 * top))
        kth = ahead.withColumn("at", order("score")).filter(F.col("at") == top).select("qrow", F.col("about").alias("kth"))
        kth = scratch.write(kth, "va-kth")
        still = reach.join(kth, "qrow", "left").filter(F.col("kth").isNull() | (F.col("upper") + 0.5 + F.abs("kth") * 2.0**-48 >= F.col("kth")))
        scored = exact(still).join(read.select("row", "members"), "row").select("qrow", "score", "value", F.explode("members").alias("m")).select("qrow", "score", "value", "m.*")
        best = F.row_number().over(Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id"))
        answers = scratch.write(scored.withColumn("at", best).filter(F.col("at") <= top).drop("at"), "va-answers", keep=True)
    found = asked.join(answers, "qrow").filter("vec_id <> query_id")
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    value = F.coalesce("value", F.raise_error(F.lit("a score in the result doesn't fit into 64 bits")).cast("long"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", value.alias("score"))
