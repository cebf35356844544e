"""Packing along a space-filling curve.

A document's hashed word vector is projected to a few dimensions, and its point's Hilbert key orders
the corpus: neighbours on the curve use similar words. Spark range-sorts by that key, in ranges of equal
bytes; each task then lays its documents' tokens end to end in that order and cuts them at every sequence's end, so only a
task's last sequence can fall short. That rest is cut into sequences of power-of-two lengths, which
need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SLICE, tokenizer_cache
from .common import id_and_text, release, slices, text_bytes
from .shingles import word_hashes

FEATURES, DIMS, BITS = 1024, 4, 12
#: Ranges are cut between cells of the curve: 2**CELL_BITS of them, whose bytes are counted first.
CELL_BITS = 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_PIECE_TYPES = [pa.int64()] * 7 + [pa.binary()]


def vectors(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashed word vectors of length 1: the square root of each of FEATURES buckets' word count."""
    h, at = word_hashes(data, starts)
    n = len(starts) - 1
    text = np.repeat(np.arange(n), np.diff(at))
    v = np.sqrt(np.bincount(text * FEATURES + (h >> np.uint64(54)).astype(np.int64), minlength=n * FEATURES).reshape(n, FEATURES))
    return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)


def grid_points(v: np.ndarray) -> np.ndarray:
    """Each vector on a grid of 2**BITS cells a side in DIMS dimensions, by projection onto fixed random signs."""
    signs = np.random.default_rng(17).choice([-1.0, 1.0], (FEATURES, DIMS))
    return np.clip((v @ signs + 3) / 6 * 2**BITS, 0, 2**BITS - 1).astype(np.int64)


def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """Each point's place on the Hilbert curve (Skilling's transform of axes, then bits interleaved)."""
    x = points.T.copy()
    top = 1 << (BITS - 1)
    q = top
    while q > 1:
        for i in range(DIMS):
            flip = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & (q - 1)
            x[0] = np.where(flip, x[0] ^ (q - 1), x[0] ^ swap)
            if i:
                x[i] = np.where(flip, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, DIMS):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where(x[DIMS - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(BITS - 1, -1, -1):
        for i in range(DIMS):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        key = hilbert_keys(grid_points(vectors(*text_bytes(batch.column("text")))))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key, pa.int64())], ["doc_id", "text", "key"])


def curve_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and key (the document's place on the curve)."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_keyed, "doc_id long, text string, key long")


def range_of_cell(loads: list[tuple[int, int]], n: int) -> list[tuple[int, int, int]]:
    """(cell, first range, number of ranges) for cells in order with their bytes, so that ``n`` ranges hold like bytes. A cell of
    more than a range's share is spread over several."""
    total, before, out = max(1, sum(size for _, size in loads)), 0, []
    for cell, size in loads:
        first, last = before * n // total, max(before, before + size - 1) * n // total
        # a light cell goes where its middle lies
        out.append((cell, first, last - first + 1) if last > first + 1 else (cell, min(n - 1, (2 * before + size) * n // (2 * total)), 1))
        before += size
    return out


def in_ranges(keyed: DataFrame, n: int) -> DataFrame:
    """``keyed`` (doc_id, text, key) in ``n`` partitions that follow the curve and hold like bytes, each sorted along it.

    The driver sees one count a cell, 2**CELL_BITS at most."""
    spark = keyed.sparkSession
    cell = F.shiftright("key", DIMS * BITS - CELL_BITS)
    loads = sorted(tuple(r) for r in keyed.groupBy(cell.alias("cell")).agg(F.sum(F.octet_length("text") + 64).alias("size")).collect())
    # hash partitioning puts the number target[i] in partition i
    ids = spark.range(32 * n + 256).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    target = {r.p: r.id for r in ids}
    ranges = spark.createDataFrame(range_of_cell(loads, n), "cell long, first int, several int")
    numbers = F.array(*[F.lit(target.get(i, i)).cast("long") for i in range(n)])
    salt = F.xxhash64("doc_id")
    at = F.col("first") + F.pmod(salt, F.col("several")).cast("int")
    placed = keyed.join(F.broadcast(ranges), cell == F.col("cell")).select("doc_id", "text", "key", F.get(numbers, at).alias("range"))
    return placed.repartition(n, "range").sortWithinPartitions("range", "key", salt, "doc_id", "text").drop("range")


def power_cuts(n: int) -> list[int]:
    """``n`` as a sum of falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Lays documents end to end in sequences of ``size`` ids; gives the pieces of each sequence once it is full."""

    def __init__(self, size: int, first_id: int):
        self.size, self.sequence, self.fill, self.open = size, first_id, 0, []

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        out, at = [], 0
        for doc, start, ids, total in pieces:
            out.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.sequence, at, ids))
            at += len(ids) // 4
        self.sequence += 1
        return out

    def add(self, doc, ids: bytes) -> list[tuple]:
        out, start, total = [], 0, len(ids) // 4
        while start < total:
            n = min(self.size - self.fill, total - start)
            self.open.append((doc, start, ids[4 * start : 4 * (start + n)], total))
            start, self.fill = start + n, self.fill + n
            if self.fill == self.size:
                out += self._close(self.open)
                self.open, self.fill = [], 0
        return out

    def rest(self) -> list[tuple]:
        """The unfilled sequence, cut into sequences whose lengths are powers of two."""
        out, todo = [], self.open
        for n in power_cuts(self.fill):
            now, later = [], []
            for doc, start, ids, total in todo:
                k = min(n, len(ids) // 4)
                if k:
                    now.append((doc, start, ids[: 4 * k], total))
                    n -= k
                if len(ids) > 4 * k:
                    later.append((doc, start + k, ids[4 * k :], total))
            out, todo = out + self._close(now), later
        return out


def pack(docs: DataFrame, tokenizer_json: str, end_id: int, size: int = 2048, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``tokenizer_json`` is a tokenizers definition; ``end_id`` follows each document. Null text counts as
    empty and gives the end id alone; a repeated doc_id is packed once per row, and so is a null one; equal keys that
    fill more than a range are spread by a hash of doc_id; a very long text is cut over as many sequences as it needs; an empty table gives no rows. Other columns are ignored. sequence_id is unique, not consecutive: the task
    is in its upper half. Every sequence is full or has a power of two as its length."""
    spark = docs.sparkSession
    n = partitions or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    with open(tokenizer_json) as f:
        definition = spark.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = tokenizer_cache(definition.value)
        packer = Packer(size, TaskContext.get().partitionId() << 32)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECE_TYPES, strict=True)], [f.split()[0] for f in PIECES.split(", ")])

        for batch in slices(batches, most=SLICE):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), cache.texts(batch.column("text").to_pylist()), strict=True):
                rows += packer.add(doc, ids + end)
            if rows:
                yield batch_of(rows)
        if rows := packer.rest():
            yield batch_of(rows)
        cache.cut_back()
        release()

    return in_ranges(curve_keys(docs, id_col, text_col), n).mapInArrow(run, PIECES)
