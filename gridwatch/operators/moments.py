"""Means and co-moments of many columns in one pass, by a stable merge.

A task keeps, for every pair of columns, the count of rows that have both, each one's mean and sum of squared deviations
over these rows, and their co-moment; blocks are merged by the differences of their means, never by differences of large sums.
Tasks' matrices meet in two steps, PARTS groups and then one."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups in which tasks' matrices meet first.
PARTS = 64
_SCHEMA = "part int, n binary, mean binary, dev binary, co binary"


@dataclass
class Moments:
    """Of columns i and j, over rows that have both: ``n``, the mean of i, the sum of i's squared deviations, and the co-moment."""

    n: np.ndarray
    mean: np.ndarray
    dev: np.ndarray
    co: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        """Of rows by columns, NaN for missing. Columns are taken relative to a value of their own, so a constant one has no deviation at all."""
        there = ~np.isnan(x)
        start = np.where(there.any(0), x[there.argmax(0), np.arange(x.shape[1])], 0.0)
        m, d = there.astype(float), np.where(there, x - start, 0.0)
        n, s = m.T @ m, d.T @ m
        each = s / np.maximum(n, 1)
        dev = np.maximum((d * d).T @ m - s * each, 0.0)
        return cls(n, start[:, None] + each, dev, d.T @ d - s * each.T)

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        share = np.divide(other.n, n, out=np.zeros_like(n), where=n > 0)
        apart = np.where((self.n > 0) & (other.n > 0), other.mean - self.mean, 0.0)
        between = self.n * share
        mean = np.where(self.n > 0, self.mean + apart * share, other.mean)
        return Moments(n, mean, self.dev + other.dev + apart * apart * between, self.co + other.co + apart * apart.T * between)

    def row(self, part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (self.n, self.mean, self.dev, self.co)]], ["part", "n", "mean", "dev", "co"])

    @classmethod
    def read(cls, row: dict) -> Moments:
        side = math.isqrt(len(row["n"]) // 8)
        return cls(*[np.frombuffer(row[c]).reshape(side, side) for c in ("n", "mean", "dev", "co")])

    def correlation(self) -> np.ndarray:
        """Pearson's r of each pair; NaN where a side is constant or there is no row."""
        size = np.sqrt(self.dev) * np.sqrt(self.dev.T)
        return np.divide(self.co, size, out=np.full_like(size, np.nan), where=size > 0)


def _of_task(columns: list[str], parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], 1)
                one = Moments.of(x)
                total = one if total is None else total.merged(one)
        if total is not None:
            yield total.row(TaskContext.get().partitionId() % parts)

    return run


def _together(key: tuple, rows: pa.Table) -> pa.Table:
    total = None
    for row in rows.to_pylist():
        one = Moments.read(row)
        total = one if total is None else total.merged(one)
    return pa.Table.from_batches([total.row(0)])


def _pairs_of(xs: tuple[str, ...], ys: tuple[str, ...], columns: list[str]):
    at = {c: i for i, c in enumerate(columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                m = Moments.read(row)
                r = m.correlation()
                pairs = [(x, y, int(m.n[at[x], at[y]]), r[at[x], at[y]]) for x in xs for y in ys]
                a, b, n, v = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n, pa.int64()), pa.array([None if math.isnan(k) else k for k in v], pa.float64())], ["feature_x", "feature_y", "n", "r"])

    return run


def co_moments(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row with the matrices of all pairs of ``columns`` (NaN counts as missing); none without rows. One pass over ``df``."""
    x = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    found = x.mapInArrow(_of_task([f"c{i}" for i in range(len(columns))], PARTS), _SCHEMA)
    for _ in range(2):  # the first gives PARTS rows at most, all of part 0
        found = found.groupBy("part").applyInArrow(_together, _SCHEMA)
    return found


def correlations(df: DataFrame, columns: tuple[str, ...], xs: tuple[str, ...] | None = None, ys: tuple[str, ...] | None = None, digits: int = 4) -> DataFrame:
    """feature_x, feature_y and r for each of ``xs`` with each of ``ys`` (all columns by default), each pair over the rows that have both; null where a side is constant."""
    found = co_moments(df, columns).mapInArrow(_pairs_of(xs or columns, ys or columns, list(columns)), "feature_x string, feature_y string, n long, r double")
    return found.select("feature_x", "feature_y", F.round("r", digits).alias("r"))
