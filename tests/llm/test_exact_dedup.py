import hashlib
import random
from collections import defaultdict

import numpy as np

from gridwatch.llm import exact_dedup as E
from gridwatch.llm.common import Scratch, bit_split
from pyspark.sql import functions as F


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")].append(i)
    out = {}
    for t, ids in groups.items():
        for i in ids:
            out[i] = (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
    return out


def test_matches_brute_force(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh É\n") for _ in range(60_000))
    rows = [(1, None), (2, ""), (3, "Abc"), (4, "aBC"), (5, "Éa"), (6, "éa"), (7, long), (8, long.upper().replace("É", "É")), (9, long + "x"), (10, long), (11, "x" * 50_000), (12, "x" * 50_000)]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, keep_id string, recipe string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in E.exact_dedup(docs).collect()}
    assert got == brute(rows)
    assert {r.doc_id for r in E.drop_exact_copies(docs).collect()} == {i for i, v in got.items() if v[2]}


def test_empty_table(spark):
    assert E.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cuts_follow_content():
    rng = np.random.default_rng(0)
    a, b = rng.integers(97, 123, 20_000).astype(np.uint8), rng.integers(97, 123, 333).astype(np.uint8)
    whole = np.concatenate([b, a])
    one = {20_000 - e for e in E.chunk_ends(E.cut_candidates(a), 0, len(a))}
    two = {len(whole) - e for e in E.chunk_ends(E.cut_candidates(whole), 0, len(whole))}
    assert len(one & two) > len(one) // 2
    ends = E.chunk_ends(E.cut_candidates(whole), 0, len(whole))
    assert ends[-1] == len(whole) and all(x < y for x, y in zip(ends, ends[1:], strict=False))


def test_hash_collisions_are_told_apart(spark):
    rows = [(1, "s1", [(5, 9, b"a"), (6, 9, b"z")]), (2, "s2", [(5, 9, b"b"), (6, 9, b"z")]), (3, "s1", [(5, 9, b"a"), (6, 9, b"z")])]
    with Scratch(spark) as scratch:
        got = {r.doc_id: r.recipe for r in E.verified_recipes(spark.createDataFrame(rows, E.RECIPES), scratch).collect()}
    assert got[1] == got[3] != got[2]


def test_repeated_rows_nulls_and_clashing_columns(spark):
    rows = [(None, "a", "1"), (1, "A", "2"), (1, "A", "2"), (1, "b", "3"), (None, None, "4"), (None, "", "5"), (2, "alone", "6")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumns({"text_sha256": F.lit("x"), "kept": F.lit(1), "n": F.lit(2), "other.id": F.lit(3)})
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in E.exact_dedup(docs).collect())
    assert got == sorted([("None", "1", 3, False), ("1", "1", 3, True), ("1", "1", 3, True), ("1", "1", 1, True), ("None", "None", 2, True), ("None", "None", 2, True), ("2", "2", 1, True)])
    left = E.drop_exact_copies(docs)
    assert left.columns == docs.columns and sorted(r.row for r in left.collect()) == ["2", "3", "4", "6"]


def test_unmarked_rows_stay_where_they_are(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "CASE WHEN id % 100 < 2 THEN 'same' ELSE concat('t', id) END AS text", "'x' AS _dup_id")
    marks = spark.createDataFrame([(100,), (101,)], "m long")
    maybe, rest = bit_split(docs, F.col("doc_id"), marks, "m")
    assert {100, 101} <= {r.doc_id for r in maybe.collect()} and maybe.count() < 20 and maybe.count() + rest.count() == 2000
    assert "Exchange hashpartitioning(doc_id" not in rest._jdf.queryExecution().toString()
    assert {r.doc_id for r in E.drop_exact_copies(docs).collect()} == {i for i in range(2000) if i % 100 >= 2} | {1901}
