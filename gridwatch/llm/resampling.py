"""Target-distribution importance resampling over deduplicated text segments.

Separator newlines cut texts into lines. Each distinct line's features are found once: its buckets of word runs
(1 to n consecutive words), counted as often as the line occurs. Runs across lines are added separately, per document.
The log ratio of target to corpus frequencies of each bucket is its gain; a document's weight is the sum over its lines of
the lines' sums, and over its runs across lines. Documents are drawn without replacement by weight plus Gumbel noise.

Lines that very many documents share (a number bounded by COMMON_LINES) reach the documents by broadcast, all others by
a join, so that no line makes a task hot. The draw's ranks come from a range sort and its ranges' counts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_BYTES, Scratch, lower_ascii, slices, text_bytes

BUCKETS = 10_000
#: A line in more than 1 / COMMON_LINES of all pairs of document and line is common: there are fewer of these than this.
COMMON_LINES = 1 << 13
#: Bytes of words: digits, letters, and all of non-ASCII characters.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: Longer words' checksums are taken one by one.
_LONG_WORD = 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return t


_CRC = _crc_table()


def words_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, where words begin and end, and how many words the texts before each text have (one more entry than texts)."""
    data = LOWER_BYTES[data]
    if not len(data):
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    word, edge = _WORD[data], np.zeros(len(data) + 1, bool)
    edge[starts] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    return data, a, b, np.searchsorted(a, starts)


def extended(crc: np.ndarray, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Checksums carried on over one word each, all words' bytes at the same place at once."""
    order = np.argsort(a - b, kind="stable")
    size, at, state = (b - a)[order], a[order], ~crc[order]
    short = int(np.searchsorted(-size, -_LONG_WORD))
    for i in range(short):
        state[i] = np.uint32(~zlib.crc32(data[at[i] : at[i] + size[i]].tobytes(), int(~state[i])) & 0xFFFFFFFF)
    upto = np.searchsorted(-size[short:], -np.arange(1, _LONG_WORD + 1), side="right") + short
    for j, n in enumerate(upto.tolist()):
        if n <= short:
            break
        state[short:n] = _CRC[(state[short:n] ^ data[at[short:n] + j]) & np.uint32(255)] ^ (state[short:n] >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = ~state
    return out


def runs(data: np.ndarray, a: np.ndarray, b: np.ndarray, text: np.ndarray, n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of 1 to n words: the places of the words that a run begins with, and the runs' buckets. ``text``: each word's text; runs stay in one."""
    crc = np.zeros(len(a), np.uint32)
    space = np.full(1, 32, np.uint8)
    for m in range(1, n + 1):
        at = np.flatnonzero(text[: len(a) - m + 1] == text[m - 1 :]) if len(a) >= m else np.zeros(0, np.int64)
        crc = crc[at] if m > 1 else crc
        if m > 1:
            zero = np.zeros(len(at), np.int64)
            crc = extended(crc, space, zero, zero + 1)
        crc = extended(crc, data, a[at + m - 1], b[at + m - 1])
        yield at, (crc % np.uint32(buckets)).astype(np.int64)
        full = np.zeros(len(a), np.uint32)
        full[at] = crc
        crc = full


def _line_features(n: int, buckets: int):
    """From (line, times): each line's hashes, times, and its buckets as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "line"):
            data, a, b, at = words_of(*text_bytes(batch.column("line")))
            text = np.repeat(np.arange(batch.num_rows), np.diff(at))
            found = list(runs(data, a, b, text, n, buckets))
            owner, bucket = np.concatenate([text[i] for i, _ in found]), np.concatenate([x for _, x in found])
            order = np.argsort(owner, kind="stable")
            bucket, cuts = bucket[order].astype(np.int32), np.searchsorted(owner[order], np.arange(batch.num_rows + 1))
            held = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(bucket))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("h1", "h2", "times")], pa.array(np.diff(at)), held], ["h1", "h2", "times", "words", "buckets"])

    return run


def _across(n: int, buckets: int):
    """Each document's distinct lines with how often it has them, its words, and the buckets of runs that cross a line's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lines = batch.column("lines")
            whose = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
            h1, h2 = (lines.flatten().field(i).to_numpy() for i in (0, 1))
            order = np.lexsort((h2, h1, whose))
            whose, h1, h2 = whose[order], h1[order], h2[order]
            new = np.ones(len(whose), bool)
            new[1:] = (np.diff(whose) != 0) | (np.diff(h1) != 0) | (np.diff(h2) != 0)
            first = np.flatnonzero(new)
            times = np.diff(first, append=len(whose))
            cuts = np.searchsorted(whose[first], np.arange(batch.num_rows + 1)).astype(np.int32)
            uses = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(h1[first]), pa.array(h2[first]), pa.array(times)], ["h1", "h2", "times"]))
            data, a, b, at = words_of(*text_bytes(batch.column("text")))
            text = np.repeat(np.arange(batch.num_rows), np.diff(at))
            ends = np.cumsum(data == 10) if len(data) else np.zeros(0, np.int64)
            line = ends[a] if len(a) else ends
            crossing = [(text[i], x, line[i] != line[i + m]) for m, (i, x) in enumerate(runs(data, a, b, text, n, buckets))] if n > 1 else []
            owner = np.concatenate([np.zeros(0, np.int64), *[t[c] for t, _, c in crossing]])
            bucket = np.concatenate([np.zeros(0, np.int64), *[x[c] for _, x, c in crossing]])
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(batch.num_rows + 1))
            held = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(bucket[order].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), uses, pa.array(np.diff(at)), held], ["doc_id", "lines", "words", "across"])

    return run


def _summed(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    count = np.zeros(buckets, np.int64)
    for batch in batches:
        times = np.repeat(batch.column("times").to_numpy(), pc.list_value_length(batch.column("buckets")).to_numpy(zero_copy_only=False))
        np.add.at(count, batch.column("buckets").flatten().to_numpy(), times)
    some = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some])], ["bucket", "n"])


def _hashes(line: Column) -> Column:
    """Two 64-bit hashes of a line, which tell it from all others."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


class Segments:
    """A table of texts as two tables of the shared folder: distinct lines with their features, and documents with their lines' hashes."""

    def __init__(self, texts: DataFrame, scratch: Scratch, id_col: str, text_col: str, n: int, buckets: int):
        d = texts.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        self.buckets = buckets
        cut = F.filter(F.split(lower_ascii(F.col("text")), "\n"), lambda x: x.rlike(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"))
        lines = d.select(F.explode(cut).alias("line")).groupBy("line").agg(F.count("*").alias("times"))
        lines = lines.select(_hashes(F.col("line")).alias("h"), "line", "times").select("h.*", "line", "times")
        self.lines = scratch.write(lines.mapInArrow(_line_features(n, buckets), "h1 long, h2 long, times long, words long, buckets array<int>"), "lines")
        marked = d.select("doc_id", "text", F.transform(cut, _hashes).alias("lines"))
        found = marked.mapInArrow(_across(n, buckets), "doc_id long, lines array<struct<h1: long, h2: long, times: long>>, words long, across array<int>")
        self.documents = scratch.write(found.withColumn("row", F.monotonically_increasing_id()), "segments")

    def counts(self) -> np.ndarray:
        """How often each bucket occurs in all texts; the driver gets one number a bucket."""
        buckets = self.buckets
        of = lambda df: df.mapInArrow(lambda it: _summed(it, buckets), "bucket int, n long")
        both = of(self.lines.select("times", "buckets")).unionByName(of(self.documents.select(F.lit(1).cast("long").alias("times"), F.col("across").alias("buckets"))))
        out = np.zeros(self.buckets, object)
        for r in both.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
            out[r.bucket] = int(r.n)
        return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(ratio of smoothed frequencies)) of each bucket."""
    t_all, s_all, k = int(target.sum()), int(corpus.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log(float((int(t) + 1) * (s_all + k)) / float((int(s) + 1) * (t_all + k)))) for t, s in zip(target, corpus, strict=True)], np.int64)


def _weighed(gain, keep: list[str], of: str):
    """The columns ``keep``, how many buckets the column ``of`` has, and the sum of their gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column(of)).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(gain.value[batch.column(of).flatten().to_numpy()])]).astype(np.int64)
            ends = np.cumsum(size)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(size), pa.array(upto[ends] - upto[ends - size])], [*keep, "features", "weight"])

    return run


def weights(docs: Segments, gain: np.ndarray, scratch: Scratch) -> DataFrame:
    """row, doc_id, words, n_features and weight of every document."""
    spark = docs.lines.sparkSession
    shared = spark.sparkContext.broadcast(gain)
    held = docs.documents.select("row", F.explode("lines").alias("h")).select("row", "h.*")
    lines = docs.lines.select("h1", "h2", "times", "buckets").mapInArrow(_weighed(shared, ["h1", "h2", "times"], "buckets"), "h1 long, h2 long, times long, features long, weight long")
    lines = scratch.write(lines.withColumnRenamed("times", "total"), "line-weights")
    limit = F.lit(1.0 / COMMON_LINES) * F.col("whole")
    of_all = lines.agg(F.sum("total").alias("whole"))
    marked = lines.crossJoin(F.broadcast(of_all)).withColumn("common", F.col("total") > limit).drop("whole")
    common = scratch.write(marked.filter("common").select("h1", "h2", "features", "weight"), "common-lines")
    rest = marked.filter(~F.col("common")).select("h1", "h2", "features", "weight")
    held = held.join(F.broadcast(common.withColumnsRenamed({"features": "f", "weight": "w"})), ["h1", "h2"], "left")
    held = scratch.write(held, "line-uses")
    summed = lambda df: df.groupBy("row").agg(F.sum(F.col("times") * F.col("features")).alias("features"), F.sum(F.col("times") * F.col("weight")).alias("weight"))
    by_common = held.filter("f IS NOT NULL").select("row", "times", F.col("f").alias("features"), F.col("w").alias("weight"))
    by_join = held.filter("f IS NULL").select("row", "h1", "h2", "times").join(rest.hint("merge"), ["h1", "h2"]).select("row", "times", "features", "weight")
    crossing = docs.documents.select("row", "across").mapInArrow(_weighed(shared, ["row"], "across"), "row long, features long, weight long").select("row", F.lit(1).cast("long").alias("times"), "features", "weight")
    total = summed(reduce(DataFrame.unionByName, (by_common, by_join, crossing)))
    found = docs.documents.select("row", "doc_id", "words").join(total, "row", "left")
    return found.select("row", "doc_id", "words", F.coalesce("features", F.lit(0)).alias("n_features"), F.coalesce("weight", F.lit(0)).alias("weight"))


def noise(seed: int, key: Column) -> Column:
    """floor(-1000 * ln(-ln(u))) for u in (0, 1) from a hash of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(df: DataFrame, order: list[Column], scratch: Scratch) -> DataFrame:
    """``df`` with rank, from 1, over all rows in ``order``: by ranges, with the counts of the ranges before."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.write(df.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "ranges", keep=True)
    before = F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    offsets = ranged.groupBy("range").agg(F.count("*").alias("size")).select("range", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranged.join(F.broadcast(offsets), "range").withColumn("rank", F.col("before") + inside).drop("range", "before")


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (of those drawn; null for all others).

    Of the documents with at least ``least_words`` words, ``percent`` per cent (rounded down) of the highest scores are drawn; ties go to the smaller
    doc_id. Null and empty texts have no features and weight 0; a null doc_id is an empty key of the noise and comes first
    among ties; repeated rows are each scored and drawn, those that tie in any order; an empty table gives no rows, an empty target counts
    as no features; very long texts are cut into lines like all others, and one long line is one segment; other columns are ignored. Counts cover all
    rows of both tables. Lines are told apart by two 64-bit hashes."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        corpus = Segments(docs, scratch, id_col, text_col, n, buckets)
        wanted = Segments(target, scratch, target_id, target_text, n, buckets)
        gain = gains(wanted.counts(), corpus.counts())
        found = weights(corpus, gain, scratch).withColumn("score", (F.col("weight") + noise(seed, F.col("doc_id"))).cast("long"))
        found = scratch.write(found, "scores", keep=True)
        eligible = found.filter(F.col("words") >= least_words)
        drawn = percent * eligible.count() // 100
        rows = ranked(eligible.select("doc_id", "n_features", "weight", "score", "row"), [F.desc("score"), F.asc("doc_id"), F.asc("row")], scratch)
    rows = rows.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank"))
    return rows.unionByName(found.filter(F.col("words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
