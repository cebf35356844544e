import random

import public_tokenizers
import tiktoken
from gridwatch.llm import bpe as B
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

RANKS = B.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ENC = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [None, "", " ", "   ", "a  b", "a \n b\n\n c ", "it's we'll  it 's\t\tx", "é€𝄞 \x1c\x1d x\x85y　z   q", "<|endoftext|> x", "a" * 3000 + "ab" * 2000, "\n \n", " lead", "trail ", "12345 67.8%%% q###", "x\n  y"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 'st\n\t.,é1\x1c\x85　𝄞"), max_size=40))
def test_words_and_merges_agree_with_tiktoken(text):
    cache, by_id = B._encoder(RANKS, public_tokenizers.PATTERN)
    ids = cache.texts([text])[0]
    assert B.np.frombuffer(ids, "<u4").tolist() == ENC.encode_ordinary(text)
    assert B.decode(ids, by_id) == text.encode()


def test_operator(spark):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choices("the of and\n ,.é", k=500)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = B.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert len(got) == len(texts)
    for r in got:
        want = ENC.encode_ordinary(texts[r.doc_id] or "")
        assert B.np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert bytes(r.decoded).decode() == (texts[r.doc_id] or "")


def test_tokenizers_cache():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    cache = B.tokenizer_cache(open(path).read())
    texts = [t for t in TEXTS if t]
    for t, ids in zip(texts, cache.texts(texts), strict=True):
        assert B.np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_vocabularies_that_join_white_space_arent_split():
    assert public_tokenizers.PATTERN == B.SPLIT_PATTERN and not B.joins_white_space(RANKS)
    more = dict(RANKS)
    for t in (b" \n", b"\t\n", b"\r\n"):
        more[t] = len(more)
    enc = tiktoken.Encoding("more", pat_str=public_tokenizers.PATTERN, mergeable_ranks=more, special_tokens={})
    cache, _ = B._encoder(more, public_tokenizers.PATTERN)
    assert not cache.splits and B._encoder(RANKS, public_tokenizers.PATTERN)[0].splits
    for t in ("a \n", "a\t\n", "a\r\n b", "x  \n y", *filter(None, TEXTS)):
        assert B.np.frombuffer(cache.texts([t])[0], "<u4").tolist() == enc.encode_ordinary(t)
    digits = r"\p{N}{1,3}| ?\p{L}+|[^\p{L}\p{N}]+"
    enc = tiktoken.Encoding("digits", pat_str=digits, mergeable_ranks=RANKS, special_tokens={})
    cache, _ = B._encoder(RANKS, digits)
    for t in ("a 12345 b, \n c", "x .\n\n  y"):
        assert B.np.frombuffer(cache.texts([t])[0], "<u4").tolist() == enc.encode_ordinary(t)


def test_caches_tell_vocabularies_apart():
    swapped = dict(RANKS)
    last, other = max(RANKS, key=RANKS.get), next(t for t, r in RANKS.items() if r == len(RANKS) - 2)
    swapped[last], swapped[other] = swapped[other], swapped[last]
    assert B._encoder(swapped, public_tokenizers.PATTERN)[1] != B._encoder(RANKS, public_tokenizers.PATTERN)[1]


def test_repeated_rows_nulls_and_empty_table(spark):
    rows = [(1, "same text"), (1, "same text"), (None, "x"), (2, None), (2, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, decoded string")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = B.encode_decode(docs, path, public_tokenizers.PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded).decode(), r.n_tokens) for r in got) == sorted([("1", "same text", 2), ("1", "same text", 2), ("None", "x", 1), ("2", "", 0), ("2", "", 0)])
    assert B.encode_decode(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_cache_is_small_and_exact(monkeypatch):
    """Parts are held in arrays: ids and characters, and 16 bytes a part besides."""
    cache = B.tokenizer_cache(open(public_tokenizers.path("byte_bpe_50k.json")).read())
    cache = B.Cache(cache.encode, cache.splits, cache.apart)
    text = " ".join(f"part{i}" for i in range(200_000))
    want = cache.texts([text, "part7 part8", ""])
    assert len(cache.parts) == len(cache.ids) > 199_000 and cache.parts.nbytes + cache.ids.nbytes < 10_000_000
    assert cache.texts([text, "part7 part8", ""]) == want and len(cache.parts) < 200_100
    monkeypatch.setattr(B, "KEPT_PARTS", 1000)
    cache.cut_back()
    assert len(cache.parts) == len(cache.ids) == 1000 and cache.parts.nbytes + cache.ids.nbytes < 50_000
    assert cache.texts(["", text, "part7 part8"]) == [want[2], want[0], want[1]]


def test_empty_calls_of_the_cache():
    cache = B.Cache(lambda texts: [t.encode() * 4 for t in texts], True)
    assert cache.texts([]) == [] and cache.texts([""]) == [b""]
    assert cache.texts(["  "]) == [b"  " * 4] and len(cache.texts(["a b", "c  d", "a"])) == 3
