import random
from collections import defaultdict

import __spark_entry__
import corpus_pipeline as C
import public_tokenizers
from gridwatch.llm import langid
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .test_near_dup import brute as near_brute
from .test_secrets import brute as secret_brute

SYLLABLES = {"aa": ["ka", "mo", "ti", "ru", "shi", "no"], "bb": ["sch", "ein", "ber", "ung", "ach", "pf"]}


def corpus():
    rng = random.Random(9)
    rows = []
    for i in range(60):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(60, 200))]
        if i % 9 == 0:
            words.insert(5, "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"")
        rows.append([lang, " ".join(words)])
        if i % 4 == 0:
            rows.append([lang, " ".join(words).upper() if i % 8 else " ".join([*words[:-1], "changed"])])
    rows += [["aa", None], ["aa", ""], ["bb", "12 34 !!"]]
    return [(k, t, lang, f"s{k % 3}", len(t or ""), "more") for k, (lang, t) in enumerate(rows)]


def brute(rows):
    """What the stages keep, by doc_id: texts after redaction."""
    model_rows = [r for r in rows if any(map(str.isalpha, r[1] or ""))]
    latest = {}
    for r in model_rows:
        latest["".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])] = max(r[0], latest.get(r[1].lower(), -1))
    kept = [r for r in model_rows if r[0] in latest.values()]
    comp = near_brute([(r[0], r[1]) for r in kept])
    out = {}
    for r in kept:
        if comp[r[0]][1] == r[0]:
            text, at, new = r[1], 0, ""
            for a, _, _, b in secret_brute(text):
                if a >= at:
                    new += text[at:a] + "[SECRET]"
                at = max(at, b)
            out[r[0]] = new + text[at:]
    return out


def test_run_matches_brute_force(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert not [r for r in langid.identify(docs, langid.fit(docs)).filter("rejected").collect() if any(map(str.isalpha, r.text or ""))]
    want = brute(rows)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(int)
    for p in C.run(spark, str(tmp_path)).collect():
        assert p.doc_tokens == len(tok.encode(want[p.doc_id], add_special_tokens=False).ids) + 1
        pieces[p.doc_id] += p.length
    assert pieces == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    assert any("[SECRET]" in t for t in want.values()) and len(want) < len(rows) - 10


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() <= docs.count()
    for _, stage in C.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_entry_has_all_eleven():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_repeated_rows_leave_one(spark):
    rows = [(1, "same text", "b"), (1, "same text", "a"), (1, "same text", "a"), (1, "SAME text", "c"), (0, "same text", "a"), (2, "other", "x"), (None, "null", "y"), (None, "null", "z"), (3, None, "x"), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = C.without_exact_copies(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.source or "") for r in got if r.doc_id != 3) == [(0, "y"), (1, "c"), (2, "x")]
    assert sum(r.doc_id == 3 for r in got) == 1
    once = [(1, "a", "x"), (2, "b", "x")]
    twice = spark.createDataFrame(once * 2, docs.schema)
    assert sorted(map(tuple, C.without_exact_copies(spark, twice, "").collect())) == once


def test_repeated_ids_keep_rows_apart(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, "p"), (2, a + " z", "q"), (2, b, "r"), (2, b, "s"), (None, a + " y", "t"), (None, "alone here", "u"), (3, None, "v"), (3, "", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash string").withColumns({c: F.lit(1) for c in ("id", "g.x", "component_id", "row", "text_hash")})
    got = C.without_near_copies(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.hash for r in got.collect()) == ["p", "r", "s", "u", "v", "w"]


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long, kept string")
    docs = docs.withColumnsRenamed({"source": "score", "kept": "_gone"}).withColumns({c: F.lit(7) for c in ("rejected", "others", "_sha", "doc.id", "base", "spans", "key")})
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and {(r.rejected, r["doc.id"]) for r in out.collect()} == {(7, 7)}
    assert C.packed(spark, docs, "").count() >= docs.count()
