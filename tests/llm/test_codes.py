import hashlib
import math

import numpy as np
from gridwatch.llm import codes as K


def brute(rows, rounds=4):
    """Plain Python integers: (vec_id, code, error, label_error, digest) of the usable vectors of one dimension."""
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    n = len(kept[0][1]) // 4
    cut = lambda v, p: v[p * n : (p + 1) * n]
    books = [[list(cut(v, p)) for _, v, _ in sorted(kept, key=lambda r: r[0])[:256]] for p in range(4)]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p, book in enumerate(books):
            own = {}
            for _, v, _ in kept:
                own.setdefault(near(cut(v, p), book)[0], []).append(cut(v, p))
            for k, xs in own.items():
                book[k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [(i, [near(cut(v, p), books[p]) for p in range(4)], lab) for i, v, lab in kept]
    found = [(i, "".join(f"{k:02x}" for k, _ in ns), sum(d for _, d in ns), lab) for i, ns, lab in found]
    fits = lambda e: e if e < 2**63 else None
    by = {}
    for _, _, e, lab in found:
        by[lab] = by.get(lab, 0) + e
    return sorted((i, c, fits(e), fits(by[lab]), digest) for i, c, e, lab in found)


def run(spark, rows, kind="float"):
    df = spark.createDataFrame([(i, v, lab, 5) for i, v, lab in rows], f"vec_id long, embedding array<{kind}>, label int, code int")
    return sorted(tuple(r)[:5] for r in K.compress(df).collect())


def sample(n, dim, seed=0, scale=0.3):
    v = np.random.default_rng(seed).normal(0, scale, (n, dim)).astype(np.float32)
    return [(i * 7 % 1009, v[i].tolist(), None if i % 5 == 0 else i % 3) for i in range(n)]


def test_matches_plain_integers(spark):
    rows = sample(600, 8)
    rows += [(2000, None, 1), (2001, [None] * 8, 1), (2002, [float("nan")] * 8, 1), (2003, [float("-inf")] * 8, None)]
    rows += [(3000 + i, rows[3][1], 9) for i in range(150)]  # equal vectors
    assert run(spark, rows) == brute(rows)


def test_large_components_stay_exact(spark):
    rows = sample(60, 8, 1, 1e5) + [(5000 + i, v, lab) for i, v, lab in sample(60, 8, 2, 3e6)]
    assert run(spark, rows) == brute(rows)
    single = lambda v: [float(np.float32(x)) for x in v]
    huge = sample(40, 4, 3) + [(9000, single([1e20, -1e20, 3e38, 0.5]), 1), (9001, single([1e20, -1e20, 2.9e38, 0.5]), 2)]
    assert run(spark, huge) == brute(huge)


def test_errors_beyond_64_bits_are_null(spark):
    rows = [(i, [0.0] * 4, 1) for i in range(256)] + [(300, [2.0**100, 0.0, 0.0, 0.0], 1), (301, [-(2.0**100), 0.0, 0.0, 0.0], 2)]
    got = {r[0]: r for r in run(spark, rows)}
    assert got[300][2] is None or got[300][2] == 0
    assert sorted(got.values()) == brute_null_labels(rows)


def brute_null_labels(rows):
    """As brute, but a null error adds nothing to its label."""
    out = brute(rows)
    lab = {i: x for i, _, x in rows}
    by = {}
    for i, _, e, _, _ in out:
        by.setdefault(lab[i], []).append(e)
    total = {k: sum(x for x in v if x is not None) if any(x is not None for x in v) else None for k, v in by.items()}
    return sorted((i, c, e, total[lab[i]], d) for i, c, e, _, d in out)


def test_other_dimensions_and_edges(spark):
    rows = sample(50, 8) + [(6000 + i, v, lab) for i, v, lab in sample(20, 4, 5)] + [(7000, [], 1), (7001, [], None)]
    got = {r[0]: r for r in run(spark, rows)}
    assert {i: got[i][:3] for i in got if i < 6000} == {r[0]: r[:3] for r in brute(sample(50, 8))}
    assert got[7000][1:3] == ("00000000", 0) == got[7001][1:3]
    three = [(i, [0.1 * i, -0.2, 0.3], 1) for i in range(5)]
    assert [r[:3] for r in run(spark, three)] == [r[:3] for r in brute([(i, [*v, 0.0], lab) for i, v, lab in three])]
    assert run(spark, []) == []
    assert run(spark, [(1, None, None)]) == []
    assert len(run(spark, [(4, [0.5] * 4, 1)] * 3 + [(None, [0.25] * 4, None)])) == 4


def test_limbs_never_round():
    rng = np.random.default_rng(3)
    for top in (10, 2**20, 2**30, 2**45, 2**61):
        x, y = rng.integers(-top, top, (5, 16)), rng.integers(-top, top, (7, 16))
        x[0, 0], y[0, 0] = -top, top - 1
        want = [[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in y] for r in x]
        assert K.exact_products(x, y).tolist() == want
        bits = K.limb_bits(16)
        assert 16 * 4**bits <= 2**53
        for m in (x, y):
            parts = K.limbs(m, bits)
            assert all(np.abs(p).max() <= 2**bits for p in parts)
            assert sum(p.astype(object) * 2 ** (bits * i) for i, p in enumerate(parts)).astype(int).tolist() == m.tolist()


def test_first_of_the_nearest():
    k, d = K.nearest(np.array([[0, 0], [5, 5]]), np.array([[3, 4], [4, 3], [5, 0], [5, 5]]))
    assert k.tolist() == [0, 3] and d.tolist() == [25, 0]


def test_null_ids_stay_as_rows(spark):
    df = spark.createDataFrame([(4, [0.5] * 4, 1)] * 3 + [(None, [0.25] * 4, None)], "vec_id long, embedding array<float>, label int")
    assert sorted(str(r.vec_id) for r in K.compress(df).collect()) == ["4", "4", "4", "None"]


def test_limbs_add_up_as_integers():
    m = np.random.default_rng(3).integers(-(2**61), 2**61, (5, 16))
    bits = K.limb_bits(16)
    back = sum(p.astype(np.int64).astype(object) * 2 ** (bits * i) for i, p in enumerate(K.limbs(m, bits)))
    assert back.astype(int).tolist() == m.tolist()
