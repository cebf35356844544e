import random
import zlib

from gridwatch.llm import langid as L

SYLLABLES = {"aa": ["ka", "mo", "ti", "ru", "shi"], "bb": ["sch", "ein", "ber", "ung", "ach"], "cc": ["que", "oi", "eau", "les", "ré"]}


def corpus(n):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(15, 400))]
        rows.append((i, " ".join(words), lang if i % 7 else None, lang))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = corpus(400)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert sorted(model) == sorted(SYLLABLES) and all(0 < len(x.decode()) < L.SAMPLE_ROWS * 8000 for x in model.values())
    got = {r.doc_id: r for r in L.identify(docs.select("doc_id", "text"), model).collect()}
    out = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].lang_pred == rows[i][3] for i in out) >= 0.95 * len(out)
    assert sum(got[i].rejected for i in out) <= 0.02 * len(out)
    edge = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "12 %", 9), (4, "ka " * 40_000, 9), (None, "ka mo", 9)], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in L.identify(edge, model).collect()}
    assert [(got[i].lang_pred, got[i].score, got[i].rejected) for i in (1, 2, 3)] == [("und", 0.0, True)] * 3
    assert got[4].lang_pred == "aa" and 0 <= got[4].score <= 1 and got[None].lang_pred in SYLLABLES


def test_fit_takes_whole_texts_of_so_many_rows(spark):
    texts = {i: f"row{chr(97 + i // 26)}{chr(97 + i % 26)} " + "abc " * (900 if i % 2 else 2000) + "theend" for i in range(400)}
    docs = spark.createDataFrame([(i, t, "aa") for i, t in texts.items()] * 2 + [(1000 + i, "longonly " * 900, "bb") for i in range(9)] + [(2000, None, "cc"), (None, "x", "cc")], "doc_id long, text string, lang string")
    model = L.fit(docs)
    lines = model["aa"].decode().split("\n")
    assert len(lines) <= L.SAMPLE_ROWS and all(x.endswith("theend") for x in lines) and len({len(x) for x in lines}) == 2
    assert sorted(model) == ["aa", "bb"] and len(model["bb"]) == len("longonly " * 900)


def test_sizes_by_a_plain_loop_over_dictionaries(spark):
    """Predictions, scores and rejections again: a fresh compressor for each text, language and piece."""
    import zstandard

    rows = corpus(160)
    docs = spark.createDataFrame([r[:3] for r in rows] + [(500, "ka mo " * 3000, "aa"), (501, "x", None), (502, None, "aa")], "doc_id long, text string, lang string")
    model = L.fit(docs)
    for r in L.identify(docs.select("doc_id", "text"), model).collect():
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        data = bytes(b for b in r.text.lower().encode() if not (33 <= b < 127 and not chr(b).isalpha()))
        sizes = {}
        for lang, raw in model.items():
            total = 0
            for i in range(0, len(data), 1024):
                c = zstandard.ZstdCompressor(level=5, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
                total += len(c.compress(data[i : i + 1024]))
            sizes[lang] = total
        best, second = sorted((n, lang) for lang, n in sizes.items())[:2]
        margin = (second[0] - best[0]) / second[0]
        assert (r.lang_pred, r.rejected) == (best[1], margin < 0.004) and abs(r.score - margin / (margin + 0.02)) < 1e-12


def test_ties_go_to_the_first_name_and_are_rejected(spark):
    model = {"bb": b"same text in both", "aa": b"same text in both"}
    docs = spark.createDataFrame([(1, "same text", "z"), (1, "same text", "z"), (None, "same text", "y")], "doc_id long, text string, rejected string")
    got = L.identify(docs, model).collect()
    assert [(r.lang_pred, r.score, r.rejected) for r in got] == [("aa", 0.0, True)] * 3


def test_fit_never_reads_held_out_rows(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    other = spark.createDataFrame([(i, "zzz" if zlib.crc32(str(i).encode()) % 5 == 0 else t, lang) for i, t, lang, _ in rows], "doc_id long, text string, lang string")
    assert L.fit(docs) == L.fit(other)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.fit(docs) == {} and L.identify(docs, {}).count() == 0
    one = spark.createDataFrame([(1, "words")], "doc_id long, text string")
    assert L.identify(one, {}).first().lang_pred == "und"


def test_more_languages_than_a_task_holds(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:03}": ["".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(60)] for k in range(150)}
    rows = [(i, " ".join(rng.choices(words[lang], k=60)), lang) for i, lang in enumerate(sorted(words) * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert sorted(model) == sorted(words)
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(docs, model).collect()}
    assert sum(got[i][0] == lang for i, _, lang in rows) >= 0.98 * len(rows)
    by = L.compressors(model)
    for i, text, _ in rows[::40]:
        lang, margin = L.decide(L.two_best(text, by))
        assert got[i] == (lang, margin / (margin + 0.02))
