"""Language identification by compression.

Each language has a raw-content zstandard dictionary of sample text. A text is cleaned to lower-case
letters and spaces (ASCII signs and digits go), cut into pieces so that the dictionary matters
throughout a long text, and compressed with every dictionary; the language with the smallest sum of
sizes wins. A margin over the second that is too narrow rejects the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bounded_batches, slices

#: The fit's bound: so many labelled rows per language, with their whole texts, of any length.
SAMPLE_ROWS = 48
#: A task holds compressors for so many languages at once; more take turns.
LANGUAGES_AT_ONCE = 64
LEVEL, PIECE = 5, 1024
#: Smallest share of the second-best size that the best must save.
MARGIN = 0.004
UNKNOWN = "und"
_SIGNS = bytes(i for i in range(33, 127) if not chr(i).isalpha())


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves no rest by 5; such rows take no part in fitting. False for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def clean(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(None, _SIGNS)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary per language, from the whole texts of at most SAMPLE_ROWS labelled rows that aren't held out, chosen by a hash of their id.

    Any number of languages: dictionaries are made in tasks, and only they come to the driver. Null ids, texts and
    languages are left out; equal cleaned texts count once in a dictionary; no labelled rows, no dictionaries."""
    d = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    d = d.filter(~held_out(F.col("i")) & F.col("i").isNotNull() & F.col("l").isNotNull() & F.col("t").isNotNull())
    with Scratch(docs.sparkSession) as scratch:
        counts = scratch.write(d.groupBy("l").agg(F.count("*").alias("n")), "languages")
        place = F.pmod(F.xxhash64("i"), F.lit(10**9))
        most = F.floor(F.least(F.lit(1.0), F.lit(2.0 * SAMPLE_ROWS) / F.col("n")) * 10**9) + 1
        rows = d.join(counts, "l").filter(place < most).select("l", F.struct(place.alias("p"), "i", "t").alias("row"))
        found = rows.groupBy("l").agg(F.collect_list("row").alias("rows")).mapInArrow(_dictionaries, "l string, raw binary")
        return {r.l: bytes(r.raw) for r in sorted(found.collect(), key=lambda r: r.l)}


def _dictionaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = []
        for rows in batch.column("rows").to_pylist():
            first = sorted(rows, key=lambda r: (r["p"], r["i"], r["t"]))[:SAMPLE_ROWS]
            raw.append(b"\n".join(dict.fromkeys(clean(r["t"]) for r in first)))
        yield pa.RecordBatch.from_arrays([batch.column("l"), pa.array(raw, pa.binary())], ["l", "raw"])


def compressors(model: dict[str, bytes]) -> dict[str, zstandard.ZstdCompressor]:
    out = {}
    for lang, raw in model.items():
        d = zstandard.ZstdCompressionDict(raw or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
    return out


def two_best(text: str | None, by: dict[str, zstandard.ZstdCompressor]) -> list[tuple[int, str]]:
    """The two smallest compressed sizes (ties by name) with their languages; none for a text without a letter."""
    if text is None or not any(map(str.isalpha, text)):
        return []
    data = clean(text)
    pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
    return sorted((sum(len(c.compress(p)) for p in pieces), lang) for lang, c in by.items())[:2]


def decide(sizes: list[tuple[int, str]]) -> tuple[str, float]:
    """The language whose dictionary compresses a text best, and the share that it saves over the second."""
    if not sizes:
        return UNKNOWN, 0.0
    second = sizes[1][0] if len(sizes) > 1 else 2 * sizes[0][0]
    return sizes[0][1], (second - sizes[0][0]) / max(second, 1)


def identify(docs: DataFrame, model: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1, from the margin) and rejected; columns of these names are replaced.

    ``und`` (score 0, rejected) where text is null or has no letter, or the model has no language."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    docs = docs.select(*kept)
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SAMPLE_ROWS texts a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sorted(sent.value)
        blocks = [{n: sent.value[n] for n in names[i : i + LANGUAGES_AT_ONCE]} for i in range(0, len(names), LANGUAGES_AT_ONCE)]
        only = compressors(blocks[0]) if len(blocks) == 1 else None
        for batch in slices(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            sizes: list[list[tuple[int, str]]] = [[] for _ in texts]
            for block in blocks:
                by = only or compressors(block)
                sizes = [sorted(s + two_best(t, by))[:2] for s, t in zip(sizes, texts, strict=True)]
            found = [decide(s) for s in sizes]
            new = [pa.array([x for x, _ in found], pa.string()), pa.array([m / (m + 0.02) for _, m in found], pa.float64()), pa.array([x == UNKNOWN or m < MARGIN for x, m in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*kept, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, T.StructType([*docs.schema, *T.StructType.fromDDL("lang_pred string, score double, rejected boolean")]))
