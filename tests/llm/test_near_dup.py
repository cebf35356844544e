import random
import re

import numpy as np
from gridwatch.llm import near_dup as N
from gridwatch.llm.common import Scratch
from gridwatch.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            both = len(s & t)
            if s and t and 100 * both >= 75 * (len(s) + len(t) - both):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets}


def corpus(rng, bases, copies, edits):
    vocab = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choices(vocab, k=60))
    texts = [None, "", " \t\n", "one", "ONE", "one two three four", "one  two three\nfour", "a b c d e", "A b c d\x0be", "é Ü ß x y z", "É Ü ß x y z"]
    for _ in range(bases):
        words = rng.choices(vocab, k=rng.randint(20, 300))
        for _ in range(rng.randint(1, copies)):
            w = list(words)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w) + (" " + passage if rng.random() < 0.5 else ""))
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts, strict=True))


def test_matches_brute_force(spark):
    rows = corpus(random.Random(5), 60, 6, 6)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_long_lists(spark, monkeypatch):
    monkeypatch.setattr(N, "LONG", 4)
    monkeypatch.setattr(N, "BLOCK_BYTES", 6000)
    rng = random.Random(6)
    rows = corpus(rng, 3, 60, 9) + [(20_000 + i, "the common line of all these many short texts " + " ".join(f"q{rng.randrange(9)}" for _ in range(3))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(docs).collect()}
    assert got == brute(rows)


def brute_rows(rows):
    """Like brute, for rows that may repeat or lack a doc_id: sorted (doc_id, size, component)."""
    by_row = brute([(k, t) for k, (_, t) in enumerate(rows)])
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            c = by_row[k][1]
            ids[c] = min(ids.get(c, i), i)
    return sorted(((i, by_row[k][0], ids.get(by_row[k][1])) for k, (i, _) in enumerate(rows)), key=str)


def test_repeated_ids_nulls_and_clashing_columns(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (1, b), (2, a + " z"), (3, b + " z"), (None, a + " y"), (None, "alone by itself"), (None, None), (4, ""), (4, None), (5, "c d"), (5, "C  D"), (6, "c d")]
    docs = spark.createDataFrame([(i, t, 0, 1, "x", 2) for i, t in rows], "doc_id long, text string, row int, n int, fp string, component int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(docs).collect()), key=str)
    assert got == brute_rows(rows)


def test_very_long_texts(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    changed = [w if i % 50 else "new" for i, w in enumerate(words)]
    most = [w if i % 20 else "new" for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(most)), (4, "x" * 300_000), (5, "short text of just six words")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def near_copies(n, seed):
    """Copies of one 60-word text with one to three words changed, the text itself left out."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(60)] = f"x{rng.randrange(10**9)}"
        out.append((i, " ".join(w)))
    return out


def test_pairs_grow_no_faster_than_members(spark, monkeypatch):
    """All pairs that leave any step, in a group of near copies of growing size."""
    counts = {}
    for n in (300, 1200, 4800):
        seen = []

        def write(self, df, tag, keep=False, real=Scratch.write, seen=seen):
            out = real(self, df, tag, keep)
            if tag in ("candidates", "pairs", "open-pairs", "links", "block-rows"):
                seen.append(out.count())
            return out

        monkeypatch.setattr(Scratch, "write", write)
        rows = near_copies(n, 3)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        monkeypatch.undo()
        counts[n] = sum(seen)
        if n == 1200:
            assert got == brute(rows)
    assert counts[1200] <= 6 * counts[300] and counts[4800] <= 6 * counts[1200], counts


def test_block_links_are_a_spanning_forest_of_exact_links():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < 0.9], rng.integers(0, 2**63, int(rng.integers(0, 12)), dtype=np.uint64)])) for _ in range(80)]
    comp = rng.integers(0, 30, 80)
    drivers, members = list(range(0, 80, 2)), list(range(80))
    found = N.block_links([sets[i] for i in drivers], comp[drivers], [sets[i] for i in members], comp[members])
    link = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y))

    def merged(edges):
        label = list(range(30))
        for a, b in edges:
            a, b = label[comp[a]], label[comp[b]]
            label = [min(a, b) if x in (a, b) else x for x in label]
        return label

    edges = [(drivers[i], j) for i, j in found]
    assert all(link(sets[a], sets[b]) and comp[a] != comp[b] for a, b in edges)
    assert merged(edges) == merged([(a, b) for a in drivers for b in members if link(sets[a], sets[b])])
    assert len(edges) == 30 - len(set(merged(edges)))


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.random()], rng.integers(0, 2**64, int(rng.integers(0, 900)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        assert both <= (len(x) + len(y) - N._hamming(N.bitmap(x), N.bitmap(y))) // 2
        keys = np.sort(rng.integers(0, 2**32, n, dtype=np.uint64))
        assert (N._keys(N._deltas(keys)) == keys).all()
        assert N.least_overlap(len(x), len(y)) == min(o for o in range(2000) if 100 * o >= 75 * (len(x) + len(y) - o))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(50)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    with Scratch(spark) as scratch:
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == label


def test_counts_of_keys_are_the_same_however_they_are_held(monkeypatch):
    """Counters of a range: held in lists, summed on the way, and as a counter for each key."""
    rng = np.random.default_rng(2)
    low = 10
    blocks = [np.unique(rng.integers(0, 1 << low, 300)) for _ in range(40)]
    want = np.bincount(np.concatenate(blocks), minlength=1 << low)
    for held, dense in ((10**9, 22), (500, 5), (500, 22)):
        monkeypatch.setattr(N, "_HELD", held)
        monkeypatch.setattr(N, "_DENSE_BITS", dense)
        c = N._Counts(low)
        for b in blocks:
            c.add(N._deltas(b), b"", b"")
        c.add(N._deltas(np.array([3, 9])), np.array([1], np.uint32).tobytes(), np.array([5], np.uint32).tobytes())
        k, n = c.summed()
        again = want.copy()
        again[3] += 1
        again[9] += 5
        assert k.tolist() == np.flatnonzero(again).tolist() and n.tolist() == again[again > 0].tolist()


def test_levels_are_bounded_by_the_most_common(spark, monkeypatch):
    """With room for few levelled shingles, only the most frequent have a level, and results stay the same."""
    rows = [(i, "one very common line of many words here " + " ".join(f"w{i}x{j}" for j in range(12))) for i in range(1000, 1060)] + near_copies(30, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(N, "LEVELLED", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df).collect()}
    assert got == brute(rows)
