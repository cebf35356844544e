import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from gridwatch.llm import packing as P
from tokenizers import Tokenizer

JSON = public_tokenizers.path("byte_bpe_50k.json")


def test_every_id_lies_in_one_piece_and_nothing_is_padded(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "dup", "dup", "<|endoftext|> a", "a b<|endoftext|>c\n<|endoftext|><|endof text|>", "long " * 9000, *[" ".join(rng.choices(["the", "of", "une", "les", "x\ny", "%%%"], k=rng.randint(1, 900))) for _ in range(120)]]
    docs = spark.createDataFrame([(i, t, "k", 0) for i, t in enumerate(texts)], "doc_id long, text string, key string, length int")
    pieces = P.pack(docs, JSON, 1).collect()
    tok = Tokenizer.from_file(JSON)
    assert tok.encode("<|endoftext|> a", add_special_tokens=False).ids == [50256, 257]
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
        assert p.ids_crc32 == zlib.crc32(p.ids) and len(p.ids) == 4 * p.length
    for i, t in enumerate(texts):
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted(by_doc[i], key=lambda p: p.start)
        assert np.frombuffer(b"".join(bytes(p.ids) for p in mine), "<u4").tolist() == want
        assert [p.start for p in mine] == [0, *np.cumsum([p.length for p in mine])[:-1].tolist()] and all(p.doc_tokens == len(want) for p in mine)
    for ps in by_seq.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [0, *np.cumsum([p.length for p in ps])[:-1].tolist()]
        n = sum(p.length for p in ps)
        assert n <= 2048 and n & (n - 1) == 0
    assert P.pack(docs.limit(0), JSON, 1).count() == 0


def test_hilbert_keys_are_a_curve(monkeypatch):
    monkeypatch.setattr(P, "BITS", 2)
    side = np.arange(4)
    points = np.stack(np.meshgrid(*[side] * P.DIMS), -1).reshape(-1, P.DIMS)
    keys = P.hilbert_keys(points)
    assert sorted(keys) == list(range(4**P.DIMS))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_similar_texts_are_near():
    def key(t):
        b = t.encode()
        return P.grid_points(P.vectors(np.frombuffer(b, np.uint8), np.array([0, len(b)])))[0]

    rng = random.Random(0)
    a = " ".join(rng.choices(["the", "of", "and", "in", "to"], k=200))
    b = " ".join(rng.choices(["the", "of", "and", "in", "to"], k=200))
    c = " ".join(rng.choices(["le", "un", "que", "des", "pour"], k=200))
    assert np.abs(key(a) - key(b)).sum() < np.abs(key(a) - key(c)).sum()


def test_ranges_hold_like_bytes(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["the", "of", "and"], k=4000)) for _ in range(60)] + [" ".join(rng.choices([f"w{k}" for k in range(500)], k=rng.randint(1, 60))) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyed = P.curve_keys(docs)
    parts = P.in_ranges(keyed, 8).select(P.F.spark_partition_id().alias("p"), P.F.octet_length("text").alias("n"), "key").groupBy("p").agg(P.F.sum("n").alias("n"), P.F.min("key").alias("lo"), P.F.max("key").alias("hi")).orderBy("p").collect()
    total = sum(map(len, texts))
    assert sum(r.n for r in parts) == total and max(r.n for r in parts) <= 2.2 * total / 8
    cell = lambda k: k >> (P.DIMS * P.BITS - P.CELL_BITS)
    assert all(cell(a.hi) <= cell(b.lo) for a, b in zip(parts, parts[1:], strict=False))


def test_range_of_cell():
    assert P.range_of_cell([], 4) == []
    assert P.range_of_cell([(3, 10)], 4) == [(3, 0, 4)]
    got = P.range_of_cell([(0, 1), (1, 1), (2, 1), (3, 1), (7, 96)], 10)
    assert [g[1] for g in got[:4]] == [0, 0, 0, 0] and got[4] == (7, 0, 10)
    rng = random.Random(1)
    for _ in range(100):
        loads = [(c, rng.choice([0, 1, 5, 300])) for c in range(rng.randint(1, 50))]
        got = P.range_of_cell(loads, 7)
        assert all(0 <= a and a + k <= 7 for _, a, k in got) and [a for _, a, _ in got] == sorted(a for _, a, _ in got)


def test_repeated_rows_nulls_and_clashing_columns(spark):
    rows = [(1, "same words"), (1, "same words"), (None, "same words"), (None, None), (2, "")]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, range int, cell string")
    pieces = P.pack(docs, JSON, 1).collect()
    assert sorted((str(p.doc_id), p.doc_tokens) for p in pieces if p.start == 0) == [("1", 3), ("1", 3), ("2", 1), ("None", 1), ("None", 3)]
    assert sum(p.length for p in pieces) == 11
