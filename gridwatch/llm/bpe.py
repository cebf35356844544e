"""Byte-level BPE encoding and decoding with a segment tree, and encoding by pieces that repeat.

A pre-token's bytes are the leaves of a segment tree. A live leaf holds the rank of the pair that it
starts, with its position; the root is then the leftmost pair of the lowest rank. A merge changes
three leaves: the pair's own, its left neighbour's and the one that it swallows.
"""

from __future__ import annotations

import base64
import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import id_and_text, release, slices

#: What \s stands for in rank files' patterns: Unicode white space, which the regex module's \s exceeds by \x1c-\x1f.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A cache of encoded parts is cut back at so many to those that came first, which are mostly the frequent ones, and so it is between
#: tasks; longer parts aren't kept.
CACHE_PARTS, KEPT_PARTS, CACHE_CHARS = 1_000_000, 500_000, 48
_NONE, _ROW, _FIRST = 1 << 62, 2000, "\0"
_STOPS = ".,"
#: Fixed value: the pattern whose matches never hold white space after another character. Texts are split for it alone.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text whose parts are numbered together.
SLICE = 2 << 20
_WHITE_THEN_SPACE = re.compile(r"[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] ")
ENCODED = "doc_id long, n_tokens long, ids binary, decoded binary"


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def compiled(pattern: str):
    """A pre-token pattern with \\s as WHITE."""
    return regex.compile(pattern.replace(r"[^\s", rf"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the whole if it has a rank, else its bytes after all merges."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    following, before = list(range(1, n + 2)), list(range(-1, n + 1))  # of a live leaf: where the next starts, the one before
    tree = [_NONE] * (2 * size)
    rank = ranks.get
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * n + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            a, b = tree[k], tree[k ^ 1]
            k >>= 1
            tree[k] = a if a < b else b

    while (top := tree[1]) != _NONE:
        i = top % n
        gone = following[i]
        end = following[i] = following[gone]
        before[end] = i
        put(gone, _NONE)
        r = rank(piece[i : following[end]]) if end < n else None
        put(i, _NONE if r is None else r * n + i)
        if (left := before[i]) >= 0:
            r = rank(piece[left:end])
            put(left, _NONE if r is None else r * n + left)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : following[i]]])
        i = following[i]
    return out


def joins_white_space(tokens: Iterable[bytes]) -> bool:
    """Whether a vocabulary has a token that joins a line end to what is before it, other than runs of line ends.

    Only such a token could reach over a split: where white space comes before a space, texts aren't split."""
    return any(re.search(rb"[^\n]\n", t) for t in tokens)


def splittable(text: str) -> bool:
    """Whether a text's parts before single spaces and line ends encode independently.

    No match of the pattern holds white space after another character, so one begins at every space or line end
    after those. Where white space comes before a space, or blank lines mix with spaces, a text stays whole."""
    return not ("  " in text or "\n " in text or _WHITE_THEN_SPACE.search(text) or _FIRST in text or ("\n\n" in text and " \n" in text))


def marked(text: str) -> str:
    """A splittable text with a mark before its first part, and a space before each line end (unless it has blank lines: those stay within their part)."""
    return _FIRST + (text if "\n\n" in text else text.replace("\n", " \n"))


def _whole(part: str) -> str:
    """A part as it stands in the text: split() took the space before all but the first and those that start with a line end."""
    return part[1:] if part[:1] == _FIRST else part if part[:1] == "\n" else " " + part


class Cache:
    """Ids, as little-endian unsigned 32-bit integers, of the parts of texts; ``encode`` gives the ids of each of many texts.

    ``splits``: whether the vocabulary and pattern let texts be encoded in parts; else each is encoded whole. So are texts with one
    of ``apart``, strings that the encoder takes out of a text before all else."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], splits: bool, apart: tuple[str, ...] = ()):
        self.encode, self.splits, self.apart = encode, splits, apart
        # Arrow arrays of like length: Python strings in a dict took ten times the memory
        self.parts, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def cut_back(self) -> None:
        if len(self.parts) > KEPT_PARTS:
            self.parts, self.ids = (pa.concat_arrays([a[:KEPT_PARTS]]) for a in (self.parts, self.ids))

    def place(self, parts: pa.Array) -> np.ndarray:
        """Where the cache has each of some distinct parts, or -1. The hash table is made of these, not of all that the cache has."""
        out = np.full(len(parts), -1)
        found = pc.index_in(self.parts, value_set=parts)
        at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        out[found.drop_null().to_numpy()] = at
        return out

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text: a part is looked up once a call, and encoded if it is new; Arrow splits, numbers and joins the parts."""
        if not self.splits:
            return self.encode(texts)
        if len(self.parts) > CACHE_PARTS:
            self.cut_back()
        fine = [splittable(t) and not any(a in t for a in self.apart) for t in texts]
        odd = iter(self.encode([t for t, ok in zip(texts, fine, strict=True) if not ok]))
        split = pc.split_pattern(pa.array([marked(t) for t, ok in zip(texts, fine, strict=True) if ok], pa.large_string()), " ")
        numbered = split.flatten().dictionary_encode()
        place = self.place(numbered.dictionary)
        unknown = np.flatnonzero(place < 0)
        new = numbered.dictionary.take(pa.array(unknown))
        words = new.to_pylist()
        fresh = pa.array(self.encode([_whole(w) for w in words]), pa.large_binary())
        place[unknown] = np.arange(len(unknown)) + len(self.ids)
        joined = pa.concat_arrays([self.ids, fresh]).take(pa.array(place[numbered.indices.to_numpy()]))
        kept = pa.array([len(w) <= CACHE_CHARS and w[:1] != _FIRST for w in words], pa.bool_())
        self.parts, self.ids = (pa.concat_arrays([a, b.filter(kept)]) for a, b in ((self.parts, new), (self.ids, fresh)))
        raw = memoryview(joined.buffers()[2] or b"")
        cuts = iter(np.frombuffer(joined.buffers()[1], np.int64)[split.offsets.to_numpy()].tolist() if len(joined) else [])
        at, out = next(cuts, 0), []
        for ok in fine:
            if ok:
                out.append(bytes(raw[at : (at := next(cuts))]))
            else:
                out.append(next(odd))
        return out


def _ids(ids: Iterable[int]) -> bytes:
    return array("I", ids).tobytes()


_caches: dict[tuple, tuple] = {}


def _encoder(ranks: dict[bytes, int], pattern: str) -> tuple[Cache, list[bytes]]:
    """This worker's cache for a vocabulary, and the vocabulary's bytes by id."""
    key = (pattern, hash(frozenset(ranks.items())))
    if key not in _caches:
        find, pieces = compiled(pattern).findall, {}
        splits = pattern == SPLIT_PATTERN and not joins_white_space(ranks)

        def piece(p: str) -> bytes:
            out = pieces.get(p)
            if out is None:
                out = _ids(merge_bytes(p.encode(), ranks))
                if len(p) <= CACHE_CHARS:
                    if len(pieces) > CACHE_PARTS:
                        pieces.clear()
                    pieces[p] = out
            return out

        def one(text: str) -> bytes:
            if splits and text[:1] == " " and text[1:].isalpha():  # a space and letters are one match
                return piece(text)
            return b"".join(map(piece, find(text)))

        by_id = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            by_id[i] = token
        _caches[key] = (Cache(lambda texts: list(map(one, texts)), splits), by_id)
    return _caches[key]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded (the bytes that the ids stand for).

    The driver reads the rank file, whose size is the vocabulary's, and broadcasts it. Null text counts as
    empty and has no ids; a null doc_id stays null; repeated rows each get theirs; very long texts are encoded whole, one
    in a batch; other columns are ignored; an empty table gives no rows."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, by_id = _encoder(ranks.value, pattern)
        for batch in slices(batches, most=SLICE):
            ids = cache.texts(batch.column("text").to_pylist())
            decoded = [decode(x, by_id) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])
        cache.cut_back()
        release()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, ENCODED)


def decode(ids: bytes, by_id: list[bytes]) -> bytes:
    """The bytes of ids given as little-endian unsigned 32-bit integers."""
    return b"".join(map(by_id.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def tokenizer_cache(definition: str) -> Cache:
    """This worker's cache for a tokenizers definition (its JSON): ids as encode(text, add_special_tokens=False) gives them, so that a
    special token's string in a text is that token."""
    key = ("json", definition)
    if key not in _caches:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(definition)
        of = json.loads(definition)
        before = of.get("pre_tokenizer") or {}
        bytewise = not of.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if not bytewise or joins_white_space(t.replace("Ġ", " ").replace("Ċ", "\n").encode() for t in of["model"]["vocab"]):
            whole = lambda texts: [_ids(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
            _caches[key] = (Cache(whole, False),)
            return _caches[key][0]
        size = np.array([len(tok.id_to_token(i) or "") for i in range(tok.get_vocab_size())])  # bytes: a token has a character for each

        def encode(texts: list[str]) -> list[bytes]:
            """A space, letters and stops are two matches: such parts are joined from what is encoded once."""
            stems = [t.rstrip(_STOPS) for t in texts]
            stems = [s if s[:1] == " " and s[1:].isalpha() else t for s, t in zip(stems, texts, strict=True)]
            todo = list(dict.fromkeys([*stems, *{t[len(s) :] for s, t in zip(stems, texts, strict=True) if len(s) < len(t)}]))
            ids = dict(zip(todo, encode_new(todo), strict=True))
            return [ids[s] if len(s) == len(t) else ids[s] + ids[t[len(s) :]] for s, t in zip(stems, texts, strict=True)]

        def encode_new(texts: list[str]) -> list[bytes]:
            """Parts that start with white space and end without are encoded in a row, _ROW at a time, and cut by their bytes."""
            out = [b""] * len(texts)
            fit = [i for i, t in enumerate(texts) if t[:1] in (" ", "\n") and not t[-1:].isspace()]
            rest = sorted(set(range(len(texts))) - set(fit))
            for i, e in zip(rest, tok.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = _ids(e.ids)
            rows = [fit[k : k + _ROW] for k in range(0, len(fit), _ROW)]
            for row, e in zip(rows, tok.encode_batch_fast(["".join([texts[i] for i in row]) for row in rows], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                ends = np.searchsorted(np.cumsum(size[ids]), np.cumsum([len(texts[i].encode()) for i in row])) + 1
                raw, at = ids.tobytes(), 0
                for i, end in zip(row, ends.tolist(), strict=True):
                    out[i], at = raw[4 * at : 4 * end], end
            return out

        _caches[key] = (Cache(encode, True, tuple(t["content"] for t in of.get("added_tokens") or [])),)
    return _caches[key][0]
