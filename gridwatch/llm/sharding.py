"""Sharding by fixed virtual slots.

DataFrame functions only. Records are hashed into SLOTS virtual slots, and rows and bytes are summed per slot. A slot
that holds more than a bounded share is split into parts by a hash of its rows, so one key may hold any share of
the table. The pieces (slots, or parts of split ones) go to shards by a map: the heaviest first, each to the
lightest shard so far. A map is a table of bounded size, stored in versions: a version has the pieces that it
changes only. A rebalance edits the map it starts from: shards above the mean release pieces, shards below it
take them, and nothing else moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Virtual slots. A piece holds at most 1 / SHARE of a shard's even share of rows and bytes (or one record).
SLOTS, SHARE = 4096, 16
#: What a record takes besides its text.
RECORD_BYTES = 8
PIECE = ["vslot", "part"]
_BY_LOAD = "struct<load: decimal(38,0), rows: bigint, shard: int>"
_TO = "array<struct<vslot: int, part: int, shard: int>>"


def records(docs: DataFrame, scratch: Scratch, key: Column | None = None, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table of doc_id, size, text_crc32, vslot and row (unique) for every row. ``key`` is what is hashed: the text by default, so that copies share a slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + RECORD_BYTES).cast("long")
    hashed = F.xxhash64(text if key is None else key)
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.pmod(hashed, F.lit(slots)).cast("int").alias("vslot"), F.monotonically_increasing_id().alias("row"))
    return scratch.write(found, "shard-records")


def pieces(found: DataFrame, shards: int, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """``found`` with part, and one row per piece: vslot, part, bytes, rows. There are at most as many pieces as slots and 2 * shards * share parts of split slots."""
    slots = found.groupBy("vslot").agg(F.sum(F.col("size").cast("decimal(38,0)")).alias("bytes"), F.count("*").alias("rows"))
    whole = slots.agg(F.sum("bytes").alias("all_bytes"), F.sum("rows").alias("all_rows"))
    many = lambda own, total: F.ceil(F.col(own).cast("double") * (shards * share) / F.col(total).cast("double"))
    split = slots.crossJoin(F.broadcast(whole)).select("vslot", F.greatest(F.lit(1), F.least("rows", F.greatest(many("bytes", "all_bytes"), many("rows", "all_rows")))).cast("int").alias("parts"))
    placed = found.join(F.broadcast(split), "vslot").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")
    return placed, placed.groupBy(*PIECE).agg(F.sum(F.col("size").cast("decimal(38,0)")).alias("bytes"), F.count("*").alias("rows"))


def _dealt(todo: DataFrame, loads: DataFrame) -> DataFrame:
    """Pieces (``todo``: vslot, part, bytes, rows) in falling order of bytes, each to the shard of the least load; ``loads``: shard, load, rows. Ties go to fewer rows, then to the smaller shard."""
    heavy = F.collect_list(F.struct((-F.col("bytes")).alias("less"), (-F.col("rows")).alias("fewer"), "vslot", "part"))
    both = todo.agg(F.array_sort(heavy).alias("todo")).crossJoin(F.broadcast(loads.agg(F.collect_list(F.struct(F.col("load").cast("decimal(38,0)").alias("load"), F.col("rows").cast("long").alias("rows"), "shard")).alias("loads"))))
    state = F.struct(F.col("loads").cast(f"array<{_BY_LOAD}>").alias("loads"), F.array().cast(_TO).alias("to"))

    def step(s: Column, x: Column) -> Column:
        least = F.array_min(s["loads"])
        grown = F.transform(s["loads"], lambda one: F.when(one["shard"] == least["shard"], F.struct((one["load"] - x["less"]).cast("decimal(38,0)").alias("load"), (one["rows"] - x["fewer"]).alias("rows"), one["shard"].alias("shard"))).otherwise(one))
        to = F.struct(x["vslot"].alias("vslot"), x["part"].alias("part"), least["shard"].alias("shard"))
        return F.struct(grown.cast(f"array<{_BY_LOAD}>").alias("loads"), F.concat(s["to"], F.array(to)).cast(_TO).alias("to"))

    return both.select(F.explode(F.aggregate("todo", state, step, lambda s: s["to"])).alias("to")).select("to.*")


def first_map(loads: DataFrame, shards: int) -> DataFrame:
    """vslot, part, shard for every piece of ``loads``."""
    empty = loads.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(0).alias("load"), F.lit(0).alias("rows"))
    return _dealt(loads, empty)


def rebalanced(current: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The pieces whose shard changes, as vslot, part, shard: the edit that makes ``current`` even over ``shards`` shards.

    A shard keeps its pieces, the heaviest first, as far as they fit into the mean; what it releases, and pieces that the
    map doesn't have, go to shards that were below the mean. So new shards (numbers from the old count on) take from all
    others, and no piece moves between shards that both stay full. Shards from ``shards`` on are emptied."""
    known = loads.join(F.broadcast(current), PIECE, "left")
    mean = loads.agg((F.sum("bytes") / F.lit(shards)).alias("mean"))
    order = Window.partitionBy("shard").orderBy(F.desc("bytes"), *PIECE)  # the pieces of one shard
    j = known.withColumn("upto", F.sum("bytes").over(order)).crossJoin(F.broadcast(mean))
    stays = F.coalesce((F.col("shard") < shards) & (F.col("upto") <= F.col("mean")), F.lit(False))
    j = j.withColumn("stays", stays)
    was = j.filter("shard IS NOT NULL").groupBy("shard").agg(F.sum("bytes").alias("was"), F.max("mean").alias("mean"), F.sum(F.when(F.col("stays"), F.col("bytes")).otherwise(0)).alias("load"), F.sum(F.when(F.col("stays"), F.col("rows")).otherwise(0)).alias("rows"))
    every = loads.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(F.broadcast(was), "shard", "left")
    takes = every.filter("was IS NULL OR was < mean").select("shard", F.coalesce("load", F.lit(0)).alias("load"), F.coalesce("rows", F.lit(0)).alias("rows"))
    moved = _dealt(j.filter(~F.col("stays")).select(*PIECE, "bytes", "rows"), takes)
    return moved.join(F.broadcast(current.withColumnRenamed("shard", "old")), PIECE, "left").filter("NOT old <=> shard").drop("old")


def store_version(edit: DataFrame, path: str, version: int) -> None:
    """Writes the pieces of one version. A version that is there already is an error, so two editors can't both make it."""
    edit.select(*PIECE, "shard").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def stored_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The map as of a version: each piece's latest entry up to it."""
    entries = spark.read.option("basePath", path).parquet(*[f"{path}/version={v}" for v in range(1, version + 1)])
    return entries.groupBy(*PIECE).agg(F.max_by("shard", "version").cast("int").alias("shard"))


def shard(docs: DataFrame, shards: int = 24, key: Column | None = None, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, part.

    The law is ``bytes``: shards get sizes near equal; a record is never cut, so a text larger than a shard's share makes
    its shard larger. slot numbers a shard's rows from 0 without gaps; grown_shard is null, as the map depends on sizes and not on
    keys alone. Equal texts share a shard unless they take more than 1 / SHARE of one. A null text has the checksum of an empty one
    and no bytes; a null doc_id stays null; repeated rows are each placed; an empty table gives no rows; very long texts count
    like all others; other columns are ignored. Rows of a piece are numbered in one task, and pieces are added up in
    a table of bounded size."""
    with Scratch(docs.sparkSession) as scratch:
        found = records(docs, scratch, key, slots, id_col, text_col)
        placed, loads = pieces(found, shards)
        loads = scratch.write(loads, "shard-loads")
        folder = scratch.folder("shard-map")
        store_version(first_map(loads, shards), folder, 1)
        to = loads.join(F.broadcast(stored_map(docs.sparkSession, folder, 1)), PIECE)
        before = F.sum("rows").over(Window.partitionBy("shard").orderBy(*PIECE).rowsBetween(Window.unboundedPreceding, -1))
        to = to.select(*PIECE, "shard", F.coalesce(before, F.lit(0)).alias("before"))
        number = F.row_number().over(Window.partitionBy(*PIECE).orderBy("row"))
        out = placed.join(F.broadcast(to), PIECE).withColumn("slot", F.col("before") + number - 1)
        out = out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", "part")
        return scratch.write(out, "shards", keep=True)
