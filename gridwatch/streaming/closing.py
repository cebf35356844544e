"""Months that close in the stream: a month's events are made once, when all of its cells have come.

State is kept by month and tile of the grid: which of the tile's cells have come. A tile that is complete says so once; a
month is complete when all of its tiles have said so. Cells may come in any order, in many batches, and again: what has come
already changes nothing, and a closed month never opens again. All state is in the query's checkpoint, so a restart goes on
where it was."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Cells of a tile have one state; tiles are squares of this side.
TILE = 64


def tile_sizes(grid: DataFrame, tile: int = TILE) -> DataFrame:
    """How many cells each tile of a grid (cell_id, row, col) has: tile_row, tile_col, expected."""
    return tiled(grid, tile).groupBy("tile_row", "tile_col").agg(F.count_distinct("cell_id").cast("int").alias("expected"))


def tiled(cells: DataFrame, tile: int = TILE) -> DataFrame:
    return cells.withColumns({"tile_row": F.floor(F.col("row") / tile), "tile_col": F.floor(F.col("col") / tile)})


def _complete(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """One month and tile: a row when the last of its cells comes, and never again."""
    if state.exists:
        seen, done = state.get
        seen = set(seen)
    else:
        seen, done = set(), False
    expected = 0
    for rows in batches:
        seen.update(rows["cell_id"].tolist())
        expected = int(rows["expected"].iloc[0])
    now = not done and len(seen) >= expected
    # of a complete tile, only that it is complete is kept
    state.update(([] if done or now else sorted(seen), done or now))
    if now:
        yield pd.DataFrame({"month": [key[0]], "tile_row": [key[1]], "tile_col": [key[2]]})


def complete_tiles(rows: DataFrame, grid: DataFrame, tile: int = TILE) -> DataFrame:
    """From a stream of rows (month, cell_id), a stream of the months and tiles that are complete, each once."""
    place = tiled(grid.select("cell_id", "row", "col"), tile).select("cell_id", "tile_row", "tile_col").join(tile_sizes(grid, tile), ["tile_row", "tile_col"])
    placed = rows.select("month", "cell_id").filter("month IS NOT NULL").join(place, "cell_id")
    return placed.groupBy("month", "tile_row", "tile_col").applyInPandasWithState(_complete, "month string, tile_row long, tile_col long", "seen array<string>, done boolean", "append", "NoTimeout")


def close_months(rows: DataFrame, grid: DataFrame, table: str, of_months: Callable[[list[str]], DataFrame], out: str, checkpoint: str, tile: int = TILE) -> StreamingQuery:
    """Runs over all that is there and ends. For every month that is complete, ``of_months`` makes its rows (which have ``month``), and they are written
    to ``out``, once.

    ``rows``: the stream; ``of_months`` reads what the stream's rows were written to. Complete tiles are gathered in ``table``, one folder a batch: a
    batch that runs again after a failure replaces its own, there and in ``out``."""
    spark = grid.sparkSession
    tiles = tile_sizes(grid, tile).count()

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        found = spark.read.schema("month string, tile_row long, tile_col long, batch long").parquet(table).filter(F.col("batch") <= batch_id)
        whole = found.groupBy("month").agg(F.count_distinct("tile_row", "tile_col").alias("n"), F.max("batch").alias("last"))
        closed = [r.month for r in whole.filter((F.col("n") == tiles) & (F.col("last") == batch_id)).orderBy("month").collect()]  # months that close in one batch
        if closed:
            of_months(closed).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return complete_tiles(rows, grid, tile).writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
