"""Vector code compression: product codes from exact integer clustering.

Vectors become integers, floor(SCALE * x), and are cut into PARTS equal consecutive parts; each part position has a
codebook of up to ENTRIES entries. All distances are exact. A part's products with all entries are matrix products
of float64 limbs: integers are broken into limbs so small that no sum of products reaches 2**53, each pair of limbs
is one BLAS call without any rounding, and the products are recombined in int64. Components that could overflow
int64 are recombined in Python's integers instead, by the same limbs. The nearest entry is the first of the least.

Vectors never move: a task keeps counts and sums of each entry, and only these (one row per task and entry) are
shuffled. The driver gets the new codebooks, whose size depends on the dimension alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors of one block; a block's distances take ROWS * ENTRIES * 8 bytes.
ROWS = 4096
#: Sizes of components from which int64 could overflow in a distance are handled in Python's integers.
_SAFE_BITS = 61
SUMS = "dim int, part int, entry int, count long, sums array<string>"
Codebooks = dict[int, list[np.ndarray]]


def usable(column: pa.Array) -> np.ndarray:
    """Which vectors are neither null nor hold a null, NaN or infinite component."""
    values = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ends = np.cumsum(size)
    return (bad[ends] == bad[ends - size]) & column.is_valid().to_numpy(zero_copy_only=False)


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of float64 values: int64, or Python's integers where some don't fit."""
    with np.errstate(over="ignore"):
        x = np.floor(values * SCALE)
    if np.abs(x).max(initial=0) < 2.0**62:
        return x.astype(np.int64)
    return np.array([int(v) * SCALE if abs(v) > 2.0**60 else int(f) for v, f in zip(values.ravel().tolist(), x.ravel().tolist(), strict=True)], dtype=object).reshape(values.shape)


def of_dimension(batch: pa.RecordBatch, vec_col: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each dimension of the usable vectors of a batch: the rows, and their integers (rows by PARTS by length of a part).

    A dimension that PARTS doesn't divide is filled up with zeros."""
    column = batch.column(vec_col)
    fine = np.flatnonzero(usable(column))
    column = column.take(pa.array(fine))
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for dim in np.unique(size).tolist():
        at = np.flatnonzero(size == dim)
        for a in range(0, len(at), ROWS):
            some = at[a : a + ROWS]
            values = column.take(pa.array(some)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(some), dim)
            values = np.pad(values, ((0, 0), (0, -dim % PARTS)))
            yield dim, fine[some], whole_numbers(values).reshape(len(some), PARTS, -1)


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 matrices L with x = sum of L[i] * 2**(bits * i), each with sizes of 2**bits at most; the last one has the sign."""
    out = []
    while True:
        if not x.size or max(abs(int(x.max())), abs(int(x.min()))) < 1 << bits:
            return [*out, x.astype(np.float64)]
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits


def limb_bits(length: int) -> int:
    """How many bits two limbs may have for a sum of ``length`` of their products to stay within 2**53."""
    return (53 - max(1, length).bit_length()) // 2


def _bits(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))).bit_length() if x.size else 0


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T for integer matrices, without rounding: int64 where it fits surely, else Python's integers."""
    bits = limb_bits(x.shape[1])
    kind = np.int64 if _bits(x) + _bits(y) + x.shape[1].bit_length() < 63 else object
    total = np.zeros((len(x), len(y)), kind)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(limbs(y, bits)):
            one = (a @ b.T).astype(np.int64)
            total = total + ((one if kind is np.int64 else one.astype(object)) << (bits * (i + j)))
    return total


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry of ``book`` (the first of the nearest) and its squared distance."""
    if 2 * (max(_bits(x), _bits(book)) + 1) + x.shape[1].bit_length() >= _SAFE_BITS:
        x, book = x.astype(object), book.astype(object)
    square = lambda m: (m * m).sum(1) if m.shape[1] else np.zeros(len(m), m.dtype)
    far = square(book)[None, :] - 2 * exact_products(x, book)
    first = np.argmin(far, axis=1)
    return first, far[np.arange(len(x)), first] + square(x)


def _sums(books, vec_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for dim, _, x in of_dimension(batch, vec_col):
                own = held.setdefault(dim, [[np.zeros(len(b), np.int64), np.zeros(b.shape, object)] for b in books.value[dim]])
                for p, (count, total) in enumerate(own):
                    part = x[:, p]
                    first, _ = nearest(part, books.value[dim][p])
                    order = np.argsort(first, kind="stable")
                    which, at, n = np.unique(first[order], return_index=True, return_counts=True)
                    count[which] += n
                    if part.shape[1]:
                        whole = part[order] if part.dtype == object or _bits(part) < 62 - ROWS.bit_length() else part[order].astype(object)
                        total[which] += np.add.reduceat(whole, at, axis=0).astype(object)
        for dim, own in held.items():
            for p, (count, total) in enumerate(own):
                some = np.flatnonzero(count)
                texts = [[str(v) for v in total[i]] for i in some]
                cols = [pa.array([dim] * len(some), pa.int32()), pa.array([p] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array(count[some]), pa.array(texts, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in SUMS.split(", ")])

    return run


def _added(key: tuple, rows: pa.Table) -> pa.Table:
    """One entry's counts and sums over all tasks, as its mean, rounded down."""
    n = sum(rows.column("count").to_pylist())
    totals = [sum(map(int, c)) for c in zip(*rows.column("sums").to_pylist(), strict=True)]
    return pa.table([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([[str(t // n) for t in totals]], pa.list_(pa.string()))], ["dim", "part", "entry", "mean"])


def first_codebooks(vectors: DataFrame, id_col: str, vec_col: str) -> Codebooks:
    """For each dimension, the parts of the vectors of the ENTRIES smallest ids, ascending; equal ids by their vectors."""
    ids = vectors.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    d = F.transform("vec", lambda c: c.cast("double"))
    ids = ids.filter(F.forall(d, lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False))))
    books = {}
    for r in ids.select(F.size("vec").alias("dim")).distinct().collect():
        first = ids.filter(F.size("vec") == r.dim).orderBy(F.col("id").asc_nulls_last(), "vec").limit(ENTRIES).toArrow()
        x = np.concatenate([x for b in first.to_batches() for _, _, x in of_dimension(b, "vec")])
        books[r.dim] = [x[:, p] for p in range(PARTS)]
    return books


def train(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", rounds: int = ROUNDS) -> Codebooks:
    """The codebooks of each dimension after ``rounds`` rounds over all vectors: assign every part, then replace each entry that has parts by their mean, rounded down."""
    sc = vectors.sparkSession.sparkContext
    books = first_codebooks(vectors, id_col, vec_col)
    for _ in range(rounds if books else 0):
        shared = sc.broadcast(books)
        sums = vectors.select(vec_col).mapInArrow(_sums(shared, vec_col), SUMS)
        means = sums.groupBy("dim", "part", "entry").applyInArrow(_added, "dim int, part int, entry int, mean array<string>").collect()
        books = {dim: [b.astype(object) for b in parts] for dim, parts in books.items()}
        for r in means:
            books[r.dim][r.part][r.entry] = [int(v) for v in r.mean]
        books = {dim: [b.astype(np.int64) if _bits(b) < 62 else b for b in parts] for dim, parts in books.items()}
        shared.unpersist()
    return books


def codebook_digest(parts: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in parts for v in b.ravel().tolist()).encode()).hexdigest()


def _encoded(books, digests: dict[int, str], names: list[str], vec_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, x in of_dimension(batch, vec_col):
                found = [nearest(x[:, p], b) for p, b in enumerate(books.value[dim])]
                codes = np.stack([c for c, _ in found], 1).astype(np.uint8)
                errors = [int(e) for e in sum(e.astype(object) for _, e in found)]
                kept = batch.take(pa.array(rows))
                cols = [kept.column("id"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array([e if e < 2**63 else None for e in errors], pa.int64()), pa.array([digests[dim]] * len(rows), pa.string()), kept.column("label")]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def compress(emb: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """One row per usable vector: vec_id, code, error, label_error, codebooks_sha256, label.

    Vectors that are null or hold null or non-finite components are left out. Distances are exact at any size of
    components; an error or label_error that doesn't fit into 64 bits is null. Vectors of each dimension have codebooks of their
    own (for dimensions that PARTS doesn't divide as if zeros followed; an empty vector has the code of entry 0 and no error).
    Fewer than ENTRIES vectors give as many entries; equal ones give equal entries, of which the first is used. Null ids come last in the
    order of ids; a null label is a label; repeated rows are each coded; an empty table gives no rows; other columns are ignored."""
    spark = emb.sparkSession
    vectors = emb.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    books = train(vectors, "id", "vec", rounds)
    kind = vectors.schema["label"].dataType
    names = ["vec_id", "code", "error", "codebooks_sha256", "label"]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, (T.LongType(), T.StringType(), T.LongType(), T.StringType(), kind), strict=True)])
    digests = {dim: codebook_digest(parts) for dim, parts in books.items()}
    with Scratch(spark) as scratch:
        coded = scratch.write(vectors.mapInArrow(_encoded(spark.sparkContext.broadcast(books), digests, names, "vec"), schema), "codes", keep=True)
        sums = coded.groupBy(F.col("label").alias("l")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"))
        sums = scratch.write(sums.select("l", F.expr("try_cast(s AS bigint)").alias("label_error")), "label-errors", keep=True)
    found = coded.join(sums, F.col("label").eqNullSafe(F.col("l")))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256", "label")
