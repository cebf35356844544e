"""Shared helpers: typed input columns, tables in the shared folder, and text as numpy bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete, own, shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes with A-Z mapped to a-z and all else unchanged.
LOWER_BYTES = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Python tasks work on slices of a batch with at most this many bytes of text (or one longer text).
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch at most (or one row): what a task holds outside the JVM's heap for each of its batches.
BATCH_BYTES = 4 << 20
_CAP = "spark.sql.execution.arrow.maxBytesPerBatch"
# buffers come from malloc, so that release() can give all that is free back to the system
pa.set_memory_pool(pa.system_memory_pool())


def bounded_batches(spark: SparkSession) -> None:
    """Caps the session's Arrow batches at BATCH_BYTES, unless its own cap is lower: batches of whole texts stay small, whatever their number of rows."""
    units = {"k": 10, "m": 20, "g": 30}
    now = str(spark.conf.get(_CAP)).lower().removesuffix("b")
    size = int(now[:-1]) << units[now[-1]] if now[-1:] in units else int(now)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(_CAP, str(BATCH_BYTES))


def release() -> None:
    """Gives a Python worker's free memory back: a worker lives on between tasks, and keeps what it once had."""
    pa.default_memory_pool().release_unused()


class Scratch:
    """Tables in the shared folder for one ``with`` block: lineage ends at each, and lost executors lose nothing.

    The block's end deletes them, but for those that a lazy result still reads (``keep``): they go with the caller's scope (session.scope), or
    when the driver's JVM ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []
        bounded_batches(spark)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            delete(self.spark, path)

    def folder(self, tag: str) -> str:
        """The path of a folder of one's own, which goes with the block."""
        self.paths.append(f"{shared_folder(self.spark)}/{tag}-{uuid.uuid4().hex}")
        return self.paths[-1]

    def write(self, df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
        """``df`` written as Parquet and read again."""
        path = f"{shared_folder(self.spark)}/{tag}-{uuid.uuid4().hex}"
        if keep:
            own(self.spark, path)
        else:
            self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; the files go with the caller's scope."""
    return Scratch(df.sparkSession).write(df, tag, keep=True)


#: Bits of a filter for each wanted key, and of a filter at most: 2**(FILTER_BITS - 6) rows are broadcast. Beyond MOST_WANTED keys it would
#: pass too much to be of use.
BITS_A_KEY, FILTER_BITS, MOST_WANTED = 16, 26, 1 << 24


def _marked(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: str) -> tuple[DataFrame, Column]:
    name, n = uuid.uuid4().hex, wanted.agg(F.approx_count_distinct(wanted_key)).first()[0]
    if n > MOST_WANTED:
        return df, F.lit(True)
    bits = min(FILTER_BITS, max(10, (BITS_A_KEY * n).bit_length()))
    slot = lambda c: F.xxhash64(c).bitwiseAND(2**bits - 1)
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(c).bitwiseAND(63).cast("int"))
    word = lambda c: F.shiftright(slot(c), 6)
    words = wanted.groupBy(word(F.col(wanted_key)).alias(f"w{name}")).agg(F.bit_or(bit(F.col(wanted_key))).alias(f"b{name}"))
    joined = df.join(F.broadcast(words), word(key) == F.col(f"w{name}"), "left")
    return joined, F.coalesce(F.col(f"b{name}"), F.lit(0)).bitwiseAND(bit(key)) != 0


def bit_filter(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows of ``df`` whose key may be among those of ``wanted``, a written table: all that are, and a few more.

    The filter grows with the keys, 16 bits each, up to 2**22 keys (8 MB); up to 2**24 fewer rows are kept out, beyond that none, and the join
    that follows moves all."""
    joined, hit = _marked(df, F.col(key), wanted, wanted_key)
    return joined.filter(hit).select(*[f"`{c}`" for c in df.columns])


def bit_split(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: str) -> tuple[DataFrame, DataFrame]:
    """``df`` in two by a filter as in bit_filter: the rows whose key may be among those of ``wanted``, and those whose key surely isn't."""
    joined, hit = _marked(df, key, wanted, wanted_key)
    columns = [f"`{c}`" for c in df.columns]
    return joined.filter(hit).select(*columns), joined.filter(~hit).select(*columns)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the two columns, as doc_id long and text string with null as empty; other columns are left out."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def lower_ascii(col):
    return F.translate(col, UPPER, UPPER.lower())


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, in record batches of about ``most`` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
    release()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each starts (one more entry than texts); null is empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    _, starts, data = texts.buffers()
    at = np.frombuffer(starts, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def random_words(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit words from a seed."""
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64)
