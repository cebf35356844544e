import hashlib
import math
import re
import zlib

import numpy as np
from gridwatch.llm import resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def features(text, n):
    ws = WORD.findall((text or "").translate(UPPER))
    return len(ws), [zlib.crc32(" ".join(ws[i : i + m]).encode()) for m in range(1, n + 1) for i in range(len(ws) - m + 1)]


def brute(docs, target, n=1, buckets=10_000, percent=10, least=20):
    """Plainly: whole texts, no segments. (doc_id, n_features, weight, score, rank)."""
    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    own = [(i, *features(x, n)) for i, x in docs]
    for _, _, f in own:
        np.add.at(s, [h % buckets for h in f], 1)
    for x in target:
        np.add.at(t, [h % buckets for h in features(x, n)[1]], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    rows = []
    for i, words, f in own:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x % buckets] for x in f)
        rows.append((i, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((k for k in range(len(rows)) if rows[k][1] >= least), key=lambda k: (-rows[k][4], -1 if rows[k][0] is None else rows[k][0]))
    rank = {k: r + 1 for r, k in enumerate(order[: percent * len(order) // 100])}
    return sorted(((i, f, w, sc, rank.get(k)) for k, (i, _, f, w, sc) in enumerate(rows)), key=str)


def run(spark, docs, target, **more):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, rank int, weight int")
    b = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    return sorted((tuple(r) for r in R.resample(d, b, **more).collect()), key=str)


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("Wort", "über", "x9", "la", "_") for b in range(40)]
    seps = [" ", " ", " ", "\n", ", ", "\n\n", "\r\n"]
    text = lambda k: "".join(words[w] + seps[s] for w, s in zip(rng.integers(0, len(words), k), rng.integers(0, len(seps), k), strict=True))
    line = "one Common line that many texts share\n"
    return [(i, line * (i % 4) + text(int(rng.integers(0, 60)))) for i in range(n)], [text(30) for _ in range(20)]


def test_matches_whole_texts(spark):
    docs, target = corpus(400)
    docs += [(500, None), (501, ""), (502, "... \n ,"), (503, "W" * 200 + " é" * 30), (504, "long line " * 20_000), (None, "a b c " * 10)]
    assert run(spark, docs, target) == brute(docs, target)


def test_runs_across_lines_are_added(spark, monkeypatch):
    docs, target = corpus(150, 1)
    docs += [(900, "a\nb\n\nc\nd e\nf"), (901, "\n\n"), (902, "a\nb\n\nc\nd e\nf")]
    for n in (2, 3):
        assert run(spark, docs, target, n=n, buckets=500, least_words=5, percent=33) == brute(docs, target, n, 500, 33, 5)
    monkeypatch.setattr(R, "COMMON_LINES", 4)  # lines beyond a quarter of all are common
    assert run(spark, docs, target, n=2) == brute(docs, target, 2)


def test_ties_repeated_rows_and_empty_tables(spark):
    docs = [(1, "same words here " * 10)] * 30 + [(2, "same words here " * 10)] * 30
    got, want = run(spark, docs, ["words"], percent=50), brute(docs, ["words"], percent=50)
    assert got == want
    assert run(spark, [], ["words"]) == []
    assert run(spark, docs, []) == brute(docs, [])


def test_checksums_of_all_lengths():
    words = ["a" * k for k in range(1, 140)] + ["é", "日本" * 50]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    low, a, b, at = R.words_of(data, np.array([0, len(data)]))
    (_, one), (_, two) = R.runs(low, a, b, np.zeros(len(a), np.int64), 2, 1 << 31)
    assert one.tolist() == [zlib.crc32(w.encode()) % (1 << 31) for w in words]
    assert two.tolist() == [zlib.crc32(f"{u} {v}".encode()) % (1 << 31) for u, v in zip(words, words[1:], strict=False)]
