import math

import numpy as np
import pytest
from gridwatch.llm import topk as K
from gridwatch.llm.common import Scratch
from pyspark.sql import functions as F


def brute(rows, k):
    ints = {i: [math.floor(256 * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in ints:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    return sorted(tuple(r) for r in K.top_k(df, F.col("vec_id") % 50 == 0, k).collect())


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 64)
    rng = np.random.default_rng(0)
    v = rng.normal(0, 0.2, (700, 8)).astype(np.float32)
    v[100:160] = v[100]  # ties
    rows = [(i, v[i].tolist()) for i in range(700)] + [(700, None), (701, [None] * 8), (702, [float("nan")] * 8), (703, [float("inf")] * 8), (750, [1.0, 2.0]), (751, [0.5, -2.0])]
    assert run(spark, rows) == brute(rows, 5)


def test_few_candidates_and_empty(spark):
    rows = [(0, [0.5, 0.25]), (1, [0.1, 0.1]), (50, [3e5, -2e5])]
    assert run(spark, rows) == brute(rows, 5)
    assert run(spark, []) == []


def test_bounds_hold_at_any_size():
    rng = np.random.default_rng(2)
    for scale in (10, 10**6, 10**13, 2**50):
        v, q = rng.integers(-scale, scale, (200, 16)), rng.integers(-scale, scale, (9, 16))
        low, step, half, cells = K.quantised(v.astype(np.float64))
        about, room = K.bounds(q.astype(np.float64), low, step, half, cells.astype(np.float64))
        true = [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in v] for x in q]
        assert all(int(about[i, j] - room[i]) <= true[i][j] <= math.ceil(about[i, j] + room[i]) for i in range(9) for j in range(200))


def brute_rows(rows, k):
    """Like brute, where ids repeat: each row a candidate, an id one query (with the least of its vectors)."""
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    out = []
    for q in sorted({i for i, _ in ints if i % 50 == 0}):
        x = min((len(v), v) for i, v in ints if i == q)[1]
        scored = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for i, v in ints if i != q and len(v) == len(x))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_repeated_rows_and_one_very_common_vector(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(0, 0.3, (400, 6)).round(3)
    rows = [(i, (v[7] if i % 3 == 0 else v[i]).tolist()) for i in range(400)]
    rows += [(50, v[9].tolist()), (50, v[10].tolist()), (50, v[10].tolist()), (8, v[8].tolist()), (8, v[8].tolist()), (8, (v[8] * 3).tolist()), (0, (v[7] * 9).tolist()), (0, (v[7] * 9).tolist())]
    rows = [(i, np.array(x, np.float32).astype(float).tolist()) for i, x in rows]
    assert run(spark, rows) == brute_rows(rows, 5)


def test_scores_never_wrap(spark):
    big = [(0, [3e8, 1e3]), (1, [2e8, -1.0]), (2, [-3e8, 5.0]), (50, [1.0, 2.0])]
    exact = [(i, [float(np.float32(x)) for x in v]) for i, v in big]
    df = spark.createDataFrame(exact, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        K.top_k(df, F.col("vec_id") == 0, 1).collect()  # 5.9e21 fits no long
    got = K.top_k(df, F.col("vec_id") == 50, 5).collect()  # sums in decimals, results that fit
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [x for x in brute_rows(exact, 5) if x[0] == 50]


def test_huge_components_are_no_error_unless_a_score_is(spark):
    """Components beyond 64-bit integers and beyond exact floats, where only returned scores must fit."""
    rows = [(0, [0.0, 3.0, -1.0]), (1, [1e30, 1.0, 2.0]), (2, [-1e20, -4.5, 0.25]), (3, [3e37, 0.0, 0.0]), (4, [0.0, 2.0, 2.0]), (50, [0.0, -7.0, 5.5]), (100, [0.0, 2.0**40, 1.0])]
    rows += [(200 + i, [0.0, i / 7, -i / 3]) for i in range(1, 60) if i % 50]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert run(spark, rows) == brute(rows, 5)
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(0, [1e30]), (1, [1e30])])
    with pytest.raises(Exception, match="too large"):
        K.top_k(spark.createDataFrame([(1, [1e308])], "vec_id long, embedding array<double>"), F.col("vec_id") == 1).collect()


def test_vectors_without_components(spark):
    rows = [(0, []), (50, []), (7, []), (1, [0.5, 0.5]), (100, [1.0, 2.0])]
    assert run(spark, rows) == brute(rows, 5)
    assert run(spark, [(0, [])]) == []


def test_exact_vectors_are_read_by_falling_bounds(spark, monkeypatch):
    """Exact vectors meet few of the pairs that cells do."""
    seen = {}

    def write(self, df, tag, keep=False, real=Scratch.write):
        out = real(self, df, tag, keep)
        seen[tag] = out.count()
        return out

    monkeypatch.setattr(Scratch, "write", write)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 16).tolist()) for i in range(1500)]
    assert run(spark, rows) == brute([(i, np.array(v, np.float32).tolist()) for i, v in rows], 5)
    assert seen["va-reach"] < 0.05 * 1500 * seen["va-searches"]


def test_one_scan_leaves_few_pairs(spark, monkeypatch):
    """Pairs after the scan are about as many as results, at any number of vectors; vectors without an equal aren't grouped."""
    seen = {}

    def write(self, df, tag, keep=False, real=Scratch.write):
        out = real(self, df, tag, keep)
        seen[tag] = out.count()
        return out

    monkeypatch.setattr(Scratch, "write", write)
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(0, 0.12, (6000, 16)), rng.normal(0, 0.12, 16) + rng.normal(0, 0.01, (500, 16))]).astype(np.float32)
    v[6500 - 7 :] = v[3]
    got = run(spark, [(i, x.tolist()) for i, x in enumerate(v)])
    ints = np.floor(v.astype(np.float64) * 256).astype(np.int64)
    scores = ints[::50] @ ints.T
    want = []
    for q, s in zip(range(0, 6500, 50), scores, strict=True):
        s[q] = -(2**40)
        want += [(q, r + 1, int(i), int(s[i])) for r, i in enumerate(np.lexsort((np.arange(6500), -s))[:5])]
    assert got == want
    assert seen["va-reach"] < 12 * seen["va-searches"]
    assert seen["va-classes"] < 50


@pytest.mark.parametrize("n", [1, 5, 16, 17, 33, 512])
@pytest.mark.parametrize("wide", [1, 3, 16])
def test_highest_of_sets(n, wide):
    x = np.random.default_rng(n).normal(size=(n, 4))
    wide = min(wide, n)
    assert np.array_equal(K._highest(x, wide), [x[w::wide].max(0) for w in range(wide)])
