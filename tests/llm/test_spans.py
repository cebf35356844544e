"""Spans in many: positions, overlaps and redaction against plain loops, and time that follows the number of matches."""

import random
import re
import time

import pytest
from gridwatch.llm import pii, secrets
from gridwatch.llm import spans as S
from pyspark.sql import functions as F


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first().x


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000, 40_000])
def test_scans_of_any_length(spark, n):
    values = [(i * 7919) % 1000 - 500 for i in range(n)]
    df = spark.createDataFrame([(values,)], "v array<int>").select(S.scan(F.col("v"), S.plus, 0).alias("sum"), S.scan(F.col("v"), S.larger, -1000).alias("most")).first()
    total, most, sums, mosts = 0, -1000, [], []
    for v in values:
        sums.append(total)
        mosts.append(most)
        total, most = total + v, max(most, v)
    assert df.sum == sums and df.most == mosts


@pytest.mark.parametrize("n", [3, 3000])
def test_matches_overlaps_and_redaction(spark, n):
    rng = random.Random(n)
    text = "".join(rng.choice(["ab", "12", "é𝄞", " ", "a1", "xyz\n", "."]) for _ in range(n * 3))
    words = [(m.start(), m.end()) for m in re.finditer("[a-z]+[0-9]*", text)]
    digits = [(m.start(), m.end()) for m in re.finditer("[0-9]+.?", text, re.S)]
    find = lambda t, p, k: S.matches(t, p, "k", k)
    spans = lambda x: [(s.start, s.end) for s in x]
    assert spans(one(spark, text, lambda t: find(t, "[a-z]+[0-9]*", 0))) == words
    got = one(spark, text, lambda t: S.outside(find(t, "[a-z]+[0-9]*", 0), find(t, "(?s)[0-9]+.?", 1)))
    assert spans(got) == [(a, b) for a, b in words if not any(a < d and c < b for c, d in digits)]
    assert all(text[s.start : s.end] == s.m for s in got)
    out, at = "", 0
    for a, b in sorted(words + digits):
        if a >= at:
            out += text[at:a] + "#"
        at = max(at, b)
    assert one(spark, text, lambda t: S.redact(t, F.concat(find(t, "[a-z]+[0-9]*", 0), find(t, "(?s)[0-9]+.?", 1)), "#")) == out + text[at:]


def test_parts_of_long_texts(spark):
    text = "".join(chr(97 + i % 26) if i % 7 else "𝄞" for i in range(3 * S.CHUNK + 5))
    cuts = [(0, 0), (0, 1), (5, S.CHUNK), (5, S.CHUNK + 1), (S.CHUNK, 2 * S.CHUNK), (S.CHUNK - 1, 3 * S.CHUNK + 5), (3 * S.CHUNK + 4, 3 * S.CHUNK + 5), (9, 9)]
    for t in (text, text[: S.CHUNK]):
        fit = [(a, b) for a, b in cuts if b <= len(t)]
        got = one(spark, t, lambda c, fit=fit: F.array(*[S.part(S.chunks(c), F.lit(a), F.lit(b)) for a, b in fit]))
        assert got == [t[a:b] for a, b in fit]


def timed(of):
    began = time.time()
    result = of()
    return time.time() - began, result


@pytest.mark.parametrize("kind", ["pii", "spans", "redact"])
def test_time_follows_the_number_of_matches(spark, kind):
    """One text of 16,000 and 64,000 matches: planning takes its time whatever the text, what is left may grow with the matches."""

    def run(n):
        if kind == "pii":
            df = spark.createDataFrame([(1, " ".join(f"a{i}@b.com" for i in range(n)))], "doc_id long, text string")
            return timed(lambda: pii.pii_digest(pii.pii_spans(df)).first().n_email)
        df = spark.createDataFrame([(1, " ".join(f"token={i:010d}" for i in range(n)))], "doc_id long, text string")
        if kind == "spans":
            return timed(lambda: secrets.secret_digest(secrets.secret_spans(df)).first().n_assign)
        return timed(lambda: secrets.redact_secrets(df).first().text.count("[SECRET]"))

    run(10)
    base, few = run(10)
    (small, a), (large, b) = run(16_000), run(64_000)
    assert (few, a, b) == (10, 16_000, 64_000)
    assert small - base < 5 and large - base < 4 * max(small - base, 2.0), (base, small, large)
