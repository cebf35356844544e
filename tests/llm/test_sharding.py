import zlib

import pytest
from gridwatch.llm import sharding as S
from gridwatch.llm.common import Scratch
from pyspark.sql import functions as F


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, -1) for i, t in rows], "doc_id long, text string, shard int, slot int")


def held(rows, shards):
    """What must hold of any placement by bytes, checked plainly."""
    by = {}
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        by.setdefault(r.shard, []).append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return {k: sum(r.size for r in own) for k, own in by.items()}


def test_sizes_checksums_and_even_shards(spark):
    rows = [(i, f"text {i} ç" * (1 + i * i % 90)) for i in range(3000)]
    out = S.shard(frame(spark, rows), 24).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out) == sorted((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in rows)
    sizes = held(out, 24)
    assert len(sizes) == 24 and max(sizes.values()) <= 1.01 * min(sizes.values())


def test_one_text_with_half_of_all_rows(spark):
    rows = [(i % 5, "the same text over and over") for i in range(2000)] + [(5, "") for _ in range(1000)] + [(i, f"other {i}") for i in range(1000)]
    out = S.shard(frame(spark, rows), 8).collect()
    sizes = held(out, 8)
    assert len(out) == 4000 and max(sizes.values()) <= 1.1 * min(sizes.values())


def test_copies_share_a_shard(spark):
    out = S.shard(frame(spark, [(i, f"text {i // 3}") for i in range(3000)]), 8).collect()
    shard_of = {}
    for r in out:
        shard_of.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in shard_of.values())


def test_nulls_empty_texts_long_texts_and_empty_table(spark):
    rows = [(None, "a"), (None, "a"), (1, None), (1, None), (2, ""), (3, "x" * 3_000_000)]
    out = S.shard(frame(spark, rows), 4).collect()
    held(out, 4)
    want = [(str(i), len(t or "") + 8, zlib.crc32((t or "").encode())) for i, t in rows]
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == sorted(want)
    assert S.shard(frame(spark, []), 4).collect() == []


@pytest.fixture
def loads(spark):
    return spark.range(600).select(F.col("id").cast("int").alias("vslot"), F.lit(0).alias("part"), (F.col("id") * 37 % 101 + 20).cast("decimal(38,0)").alias("bytes"), F.lit(1).cast("long").alias("rows"))


def test_map_is_the_greedy_one(loads):
    """Against a plain loop: the heaviest piece goes to the lightest shard."""
    got = {r.vslot: r.shard for r in S.first_map(loads, 7).collect()}
    load, want = [(0, 0, s) for s in range(7)], {}
    for x in sorted(loads.collect(), key=lambda r: (-r.bytes, r.vslot)):
        b, n, s = min(load)
        load[s], want[x.vslot] = (b + x.bytes, n + 1, s), s
    assert got == want


def total(loads, to):
    size = {r.vslot: int(r.bytes) for r in loads.collect()}
    out = {}
    for v, s in to.items():
        out[s] = out.get(s, 0) + size[v]
    return out


def test_growth_moves_slots_into_the_new_shard_alone(spark, loads, tmp_path):
    S.store_version(S.first_map(loads, 6), f"{tmp_path}/map", 1)
    before = S.stored_map(spark, f"{tmp_path}/map", 1)
    edit = S.rebalanced(before, loads, 7)
    S.store_version(edit, f"{tmp_path}/map", 2)
    old = {r.vslot: r.shard for r in before.collect()}
    new = {r.vslot: r.shard for r in S.stored_map(spark, f"{tmp_path}/map", 2).collect()}
    moved = {v: s for v, s in new.items() if s != old[v]}
    assert set(moved.values()) == {6} and len(moved) == edit.count() < 200
    sizes = total(loads, new)
    assert max(sizes.values()) <= 1.05 * min(sizes.values())
    assert {r.vslot: r.shard for r in S.stored_map(spark, f"{tmp_path}/map", 1).collect()} == old  # the old version stays readable
    with pytest.raises(Exception, match="(?i)already exists"):
        S.store_version(edit, f"{tmp_path}/map", 2)


def test_rebalance_after_growth_of_data_and_fewer_shards(loads):
    first = S.first_map(loads, 6)
    heavier = loads.withColumn("bytes", F.when(F.col("vslot") % 10 == 0, F.col("bytes") * 30).otherwise(F.col("bytes")).cast("decimal(38,0)"))
    for shards in (6, 4):
        old = {r.vslot: r.shard for r in first.collect()}
        new = old | {r.vslot: r.shard for r in S.rebalanced(first, heavier, shards).collect()}
        sizes = total(heavier, new)
        assert set(sizes) == set(range(shards)) and max(sizes.values()) <= 1.2 * min(sizes.values())


def test_number_of_pieces_is_bounded(spark):
    rows = [(i, f"text {i}") for i in range(2000)] + [(i, "hot") for i in range(2000)]
    with Scratch(spark) as scratch:
        _, loads = S.pieces(S.records(frame(spark, rows), scratch, slots=64), 4)
        assert 64 <= loads.count() <= 64 + 2 * 4 * S.SHARE + 64
        assert max(r.rows for r in loads.collect()) <= 4000 / (4 * S.SHARE) * 2.5
