import math
import random
import re

import numpy as np
from gridwatch.llm import toxicity as T


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(3000)]
    bad = ["vile", "nasty", "rotten", "awful"]
    rows = []
    for i in range(n):
        words, k = rng.choices(vocab, k=rng.randint(10, 300)), rng.choice([0, 0, 0, 1, 2, 4, 6])
        for _ in range(k):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "&&&", ","]))
        rows.append((i, " ".join(words), int(k > 0), k))
    return rows


def test_held_out_accuracy_and_order(spark):
    rows = corpus(900)
    docs = spark.createDataFrame([(r[0], r[1], "x") for r in rows], "doc_id long, text string, grade string")
    labels = spark.createDataFrame([(r[0], r[2], 1) for r in rows if r[0] < 600] + [(5000, 1, 1), (7, None, 1)], "doc_id long, toxic int, quality int")
    model = T.fit(docs, labels)
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    out = rows[600:]
    assert sum(got[i].toxic == bool(t) for i, _, t, _ in out) >= 0.97 * len(out)
    mean = lambda low, high: np.mean([got[i].expected_severity for i, *_, k in out if low <= k <= high])
    assert mean(0, 0) < mean(1, 2) < mean(4, 6)
    assert all(0 <= got[i].expected_severity <= 2 for i, *_ in rows) and (np.diff(model.thresholds) >= 0).all()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "x " * 100_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.fit(docs, none) is None
    got = T.score(docs, None).collect()
    assert len(got) == 4 and all((r.expected_severity, r.grade, r.toxic) == (0.0, 0, False) for r in got)
    assert T.score(docs.limit(0), None).count() == 0
    m = T.Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, bool), np.array([1.0, 2.0]))
    assert not any(r.toxic for r in T.score(docs, m).collect())


def sparse(x):
    row, column = np.nonzero(x)
    return T.Sparse(row, column, x[row, column], x.shape)


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 3, 600)
    x = (rng.random((600, 6)) < np.array([0.05, 0.4, 0.8])[grade][:, None]).astype(float)
    w, t = T.fit_ordinal(sparse(x), grade)
    s = x @ w
    assert (w > 0).all() and t[0] < t[1] and s[grade == 0].mean() < t[0] < s[grade == 1].mean() < t[1] < s[grade == 2].mean()


def test_grades_come_from_the_other_folds():
    """Words that only one text has, however many, say nothing to a model of the other folds."""
    rng = np.random.default_rng(2)
    toxic, fold = np.arange(300) < 120, rng.integers(0, 3, 300)
    x = np.zeros((300, 140))
    x[:60, 0] = 1  # a word that half of the toxic texts share
    x[60:120, 1] = rng.random(60) < 0.2
    x[np.arange(60, 120), 2 + np.arange(60)] = 1  # a word of its own for each other toxic text
    x[120:, 80:] = rng.random((180, 60)) < 0.1
    grade = T.held_out_grades(sparse(x), toxic, fold)
    assert (grade[120:] == 0).all() and grade[:60].mean() > 1.7 and grade[60:120].mean() < 1.3


def test_words_speak_for_both_sides_and_near_copies_count_once(spark):
    rows = [(i, f"common words here {'vile' if i % 2 else 'kind'} number{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}", i % 2) for i in range(200)]
    rows += [(1000 + i, "one passage of a very toxic text that was copied over and over zzcopy", 1) for i in range(100)]
    docs = spark.createDataFrame([r[:2] for r in rows] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    assert T.sample(docs, labels).filter("doc_id >= 1000").count() == 1
    model = T.fit(docs, labels)
    assert sorted(zip(model.against.tolist(), (model.weights > 0).tolist(), strict=True)) == [(False, True), (True, False)]
    got = {r.text: r.toxic for r in docs.dropDuplicates(["doc_id"]).join(T.score(docs.dropDuplicates(["doc_id"]), model), "doc_id").collect()}
    assert all(bad == ("vile" in t) for t, bad in got.items() if "zzcopy" not in t)


def plain_loss(x, grade, w, t):
    """The mean cumulative log-loss with both sides of a threshold weighing alike, term by term."""
    total = 0.0
    for j in range(len(t)):
        share = min(max(sum(g > j for g in grade) / len(grade), 1e-3), 1 - 1e-3)
        for row, g in zip(x, grade, strict=True):
            p = 1 / (1 + math.exp(-(sum(a * b for a, b in zip(row, w, strict=True)) - t[j])))
            total -= 0.5 / share * math.log(p) if g > j else 0.5 / (1 - share) * math.log(1 - p)
    return total / len(grade)


def test_fit_reaches_the_least_cumulative_loss():
    """Against the loss written plainly: no step from the fitted weights and thresholds lowers it, and a plain descent ends no lower."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (60, 4)).astype(float)
    grade = np.clip(np.round(x @ [1.5, 1.0, -1.0, 0.0] + rng.normal(0, 0.7, 60)), 0, 2).astype(int)
    row, column = np.nonzero(x)
    w, t = T.fit_ordinal(T.Sparse(row, column, x[row, column], x.shape), grade, 3, 4000, decay=0.0)
    least = plain_loss(x, grade, w, t)
    for i in range(6):
        for step in (-0.05, 0.05):
            v, u = w.copy(), t.copy()
            (v if i < 4 else u)[i % 4] += step
            assert plain_loss(x, grade, v, np.maximum.accumulate(u)) >= least - 1e-6
    v, u = np.zeros(4), np.array([0.5, 1.5])
    for _ in range(300):  # finite differences alone
        p = np.concatenate([v, u])
        g = [(plain_loss(x, grade, *np.split(p + 1e-4 * e, [4])) - plain_loss(x, grade, *np.split(p - 1e-4 * e, [4]))) / 2e-4 for e in np.eye(6)]
        v, u = np.split(p - 0.5 * np.array(g), [4])
    assert plain_loss(x, grade, v, u) >= least - 1e-3


def test_scores_from_whole_words_again(spark):
    """Severity, grade and verdict of every document by a plain loop over its words, and a null doc_id."""
    rows = corpus(200, 7)
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows] + [(None, "vile vile rotten"), (None, None)], "doc_id long, text string")
    model = T.fit(docs.filter("doc_id IS NOT NULL"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    weight = dict(zip(model.words.tolist(), zip(model.weights.tolist(), model.against.tolist(), strict=True), strict=True))
    hashes = {}
    got = T.score(docs, model).collect()
    texts = [r[1] for r in rows] + ["vile vile rotten", ""]
    assert [r.doc_id for r in got] == [r[0] for r in rows] + [None, None]
    for text, r in zip(texts, got, strict=True):
        ws = re.findall(r"[a-z\x80-\U0010ffff]+", text.lower())
        for word in set(ws) - set(hashes):
            raw = word.encode()
            hashes[word] = int(T.word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), T._BETWEEN)[0][0])
        s = sum(weight[h][0] * (T.SHARE / len(ws) if weight[h][1] else 1.0) for h in {hashes[x] for x in ws} if h in weight)
        above = [1 / (1 + math.exp(t - s)) for t in model.thresholds]
        each = [1 - above[0], above[0] - above[1], above[1]]
        assert abs(r.expected_severity - sum(above)) < 1e-9 and r.toxic == (above[0] >= 0.5) and each[r.grade] >= max(each) - 1e-12
