"""Exact dedup by content-defined chunk recipes.

A text (A-Z lower-cased, UTF-8) is cut where a rolling hash of its last 16 bytes matches a mask, so
equal passages give equal chunks. Only fingerprints leave the task that reads a text: each chunk's
64-bit hash, length and SHA-256. A hash and length become an identifier once the dictionary of all
chunks has shown that just one SHA-256 stands behind them; otherwise the digests' ranks tell them
apart. Texts are equal when their ordered lists of verified identifiers are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, Scratch, bit_split, id_and_text, lower_ascii, random_words, slices, text_bytes

MIN_CHUNK, MAX_CHUNK, MASK_BITS = 256, 16384, 11
RECIPES = "doc_id long, text_sha256 string, chunks array<struct<h: long, n: int, d: binary>>"
_CHUNK = pa.struct([("h", pa.int64()), ("n", pa.int32()), ("d", pa.binary())])


def cut_candidates(data: np.ndarray) -> np.ndarray:
    """Ends (exclusive) where the hash of the 16 bytes before has its MASK_BITS upper bits at zero."""
    h = (random_words(256, 1) >> np.uint64(32)).astype(np.uint32)[data]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint32(k)
    return np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + 1


def chunk_ends(cuts: np.ndarray, start: int, end: int) -> list[int]:
    """The chunk ends of one text: the first cut at least MIN_CHUNK on, or MAX_CHUNK on without one."""
    ends, at = [], start
    for c in cuts[np.searchsorted(cuts, start) : np.searchsorted(cuts, end)].tolist():
        while c - at > MAX_CHUNK:
            at += MAX_CHUNK
            ends.append(at)
        if c - at >= MIN_CHUNK:
            ends.append(at := c)
    while end - at > MAX_CHUNK:
        ends.append(at := at + MAX_CHUNK)
    return ends + [end] if end > at else ends


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        data, starts = text_bytes(batch.column("text"))
        data = LOWER_BYTES[data]
        cuts, raw = cut_candidates(data), data.tobytes()
        shas, rows = [], []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            shas.append(hashlib.sha256(raw[a:b]).hexdigest())
            row, at = [], a
            for end in chunk_ends(cuts, a, b):
                piece, at = raw[at:end], end
                row.append({"h": xxhash.xxh3_64_intdigest(piece) - 2**63, "n": len(piece), "d": hashlib.sha256(piece).digest()})
            rows.append(row)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shas, pa.string()), pa.array(rows, pa.list_(_CHUNK))], ["doc_id", "text_sha256", "chunks"])


def chunk_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, text_sha256, and its chunks in order as (h hash, n bytes, d SHA-256)."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_recipes, RECIPES)


def verified_recipes(recipes: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``recipe``: the ordered verified identifiers (h, n, v), where v is 0 unless a hash and length stand for several SHA-256s."""
    chunks = recipes.select("doc_id", "text_sha256", F.posexplode("chunks").alias("i", "c")).select("doc_id", "text_sha256", "i", "c.*")
    several = chunks.groupBy("h", "n").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).filter("lo <> hi").select("h", "n")
    several = scratch.write(several, "chunk-keys")  # as a rule empty: two contents behind one 64-bit hash
    ranks = chunks.join(several, ["h", "n"], "left_semi").select("h", "n", "d").distinct().groupBy("h", "n").agg(F.array_sort(F.collect_list("d")).alias("ds"))
    ranks = scratch.write(ranks, "chunk-ranks")
    other = chunks.join(ranks, ["h", "n"]).select("doc_id", "text_sha256", "i", (F.array_position("ds", F.col("d")) - 1).cast("int").alias("v")).filter("v > 0")
    other = other.distinct().groupBy("doc_id", "text_sha256").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("vs"))
    other = scratch.write(other, "chunk-others", keep=True).withColumnsRenamed({"doc_id": "other_id", "text_sha256": "other_sha"})
    joined = recipes.join(other, F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("text_sha256") == F.col("other_sha")), "left")
    recipe = F.transform("chunks", lambda c, i: F.struct(c["h"].alias("h"), c["n"].alias("n"), F.coalesce(F.try_element_at("vs", i), F.lit(0)).alias("v")))
    return joined.select("doc_id", "text_sha256", recipe.alias("recipe"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Of documents with equal text (A-Z and a-z alike, null as empty) the one with the largest doc_id stays.
    Empty texts share the empty recipe and so form one group. A null doc_id counts as smaller than any
    other; rows that repeat a doc_id and its text count in group_size and share its ``kept``. An empty
    table gives no rows; very long texts are cut into chunks like all others; other columns of ``docs``, whatever their names, are ignored."""
    with Scratch(docs.sparkSession) as scratch:
        recipes = verified_recipes(scratch.write(chunk_recipes(docs, id_col, text_col), "recipes", keep=True), scratch)
        groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
        groups = scratch.write(groups, "recipe-groups", keep=True).withColumnRenamed("recipe", "group_recipe")
    joined = recipes.join(groups, F.col("recipe") == F.col("group_recipe"), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", F.size("recipe").alias("n_chunks"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all its columns.

    Of rows that repeat the kept doc_id, the first stays, by all columns as JSON. A row moves only if its doc_id
    may be one that goes or repeats: a bit filter of the marks lets all others, and their texts, pass where they are.
    Columns may have any names."""
    with Scratch(docs.sparkSession) as scratch:
        marks = exact_dedup(docs, id_col, text_col).filter("group_size > 1").groupBy("doc_id", "text_sha256")
        marks = marks.agg(F.max("kept").alias("kept"), F.count("*").alias("n")).filter("NOT kept OR n > 1")
        marks = scratch.write(marks, "exact-marks", keep=True)
    maybe, rest = bit_split(docs, F.col(id_col).cast("long"), marks, "doc_id")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    sha = F.sha2(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256)
    maybe = maybe.select(F.col(id_col).cast("long").alias("doc_id"), sha.alias("text_sha256"), row.alias("row"))
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.text_sha256") == F.col("m.text_sha256"))
    once = maybe.alias("d").join(marks.alias("m"), same, "left_anti").select("row.*")
    repeated = maybe.alias("d").join(marks.filter("kept").alias("m"), same, "left_semi")
    one = repeated.groupBy("doc_id", "text_sha256").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return rest.unionByName(once).unionByName(one)
