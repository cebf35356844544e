"""N-gram Jaccard join by set-relation skipping.

Sets of word shingles are put in one global order: shingles that many documents share come last. Two
sets that link must share a shingle within each one's prefix, so inverted lists hold prefixes only.

* Lists skip by position: an entry has its set's size and its place in the set, and a pair is passed
  over when sizes or the rests behind the shared shingle cannot reach the threshold. Shingles that one
  document alone has in its prefix are left out of the lists as far as a table of fixed size tells.
* A long list is joined with its most central member first (the one with the fewest rarer shingles before
  the shared one). What that settles needs no comparison any more: only pairs across components are left,
  and each has an end outside the central member's component. Those ends, the drivers, visit the list in
  blocks of like size and like position; a block whose sizes, positions or components rule out a link
  is skipped whole.
* Inside a block a driver's overlaps with all members come from an inverted index. The next, similar
  driver's overlaps are derived from them: less those of the shingles it lacks, plus those of the ones
  it has besides. Sets are at hand there, so links are verified at once, and a block gives a spanning
  forest of its components at most.
* Equal sets are one class with one representative, and a bitmap of each set bounds the overlap of a
  pair of a short list before its sets are read.

Every pair that could link is verified on its whole sets or already connected, so components are exact.
Rows are told apart by an internal key, never by doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bit_filter, id_and_text, release, slices, text_bytes
from .components import components
from .shingles import shingle_sets

#: Jaccard similarity of a link, as a fraction: NUM / DEN or more.
NUM, DEN = 75, 100
#: Sizes of the two tables of shingle statistics: one bit a slot, and one byte a slot; neither grows with the corpus.
SHARED_BITS, LEVEL_BITS = 27, 22
#: A shingle in fewer documents than this keeps its place in hash order; of the others, so many at most (the most frequent) have a level.
COMMON, LEVELLED = 16, 1 << 20
#: Lists up to LONG are compared in full at once; blocks of longer ones hold about so many bytes of sets on either side.
LONG, BLOCK_BYTES = 48, 4 << 20
#: Occurrences counted in one task at a time, and about so many keys in one range of keys.
_RUN, _RANGE = 1 << 19, 1 << 21
#: Ranges of keys at most, as a power of two: a range then has 2**20 possible keys, and a block some hundred of them.
PARTS_BITS = 12
#: Keys of a range that are held before they are summed, and possible keys (as a power of two) of ranges that get a counter for each.
_HELD, _DENSE_BITS = 1 << 21, 22


def _deltas(keys: np.ndarray) -> bytes:
    """Ascending 32-bit integers as 16-bit differences; 65535 stands for that much and more to come."""
    d = np.diff(keys.astype(np.int64), prepend=0)
    more = d // 65535
    out = np.full(len(d) + int(more.sum()), 65535, np.uint16)
    out[np.cumsum(more + 1) - 1] = d % 65535
    return out.tobytes()


def _keys(deltas: bytes) -> np.ndarray:
    d = np.frombuffer(deltas, np.uint16).astype(np.int64)
    return np.cumsum(d)[d != 65535]


def _in_order(h: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The places of a set's first shingles (its prefix) in the global order: less common ones first, then by hash."""
    return np.argsort(level[h >> np.uint64(64 - LEVEL_BITS)], kind="stable")[: prefix_size(len(h)) if len(h) else 0]


def _counted(parts: int, level=None):
    """Upper halves of shingles (or, with levels, of prefixes' shingles) by range of keys: the distinct ones of a run of documents,
    and how often those with several came."""
    shift = np.uint64(32 - parts.bit_length() + 1)

    def emit(keys: list[np.ndarray]) -> pa.RecordBatch:
        k, times = np.unique(np.concatenate(keys), return_counts=True)
        at = np.searchsorted((k >> shift).astype(np.int64), np.arange(parts + 1))
        some = np.flatnonzero(np.diff(at)).tolist()
        blobs, which, often = [], [], []
        for i in some:
            blobs.append(_deltas(k[at[i] : at[i + 1]] - (np.uint64(i) << shift)))
            several = np.flatnonzero(times[at[i] : at[i + 1]] > 1)
            which.append(several.astype(np.uint32).tobytes())
            often.append(times[at[i] : at[i + 1]][several].astype(np.uint32).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array(x, pa.binary()) for x in (blobs, which, often)]], ["part", "keys", "which", "often"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in slices(batches):
            h, at = shingle_sets(*text_bytes(batch.column("text")))
            if level is not None:
                h = np.concatenate([np.zeros(0, np.uint64), *[h[a:b][_in_order(h[a:b], level.value)] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]])
            held.append(h >> np.uint64(32))
            n += len(h)
            if n >= _RUN:
                yield emit(held)
                held, n = [], 0
        if n:
            yield emit(held)

    return run


class _Counts:
    """Counts of one range of keys, from blocks of distinct ones: sorted keys at first, a counter for each possible key once there are many."""

    def __init__(self, low: int):
        self.low, self.keys, self.times, self.held, self.dense = low, [], [], 0, None

    def add(self, deltas: bytes, which: bytes, often: bytes) -> None:
        k = _keys(deltas).astype(np.uint32)
        n = np.ones(len(k), np.uint32)
        n[np.frombuffer(which, np.uint32)] = np.frombuffer(often, np.uint32)
        if self.dense is not None:
            self.dense[k] += n
            return
        self.keys.append(k)
        self.times.append(n)
        self.held += len(k)
        if self.held > _HELD:
            k, n = self.summed()
            if self.low <= _DENSE_BITS:
                self.dense = np.zeros(1 << self.low, np.int64)
                self.dense[k] = n
            self.keys, self.times, self.held = [k.astype(np.uint32)], [n], 0

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order, and how often each came."""
        if self.dense is not None:
            k = np.flatnonzero(self.dense)
            return k, self.dense[k]
        k, n = np.concatenate(self.keys), np.concatenate(self.times)
        order = np.argsort(k, kind="stable")
        k, n = k[order], n[order]
        first = np.flatnonzero(np.diff(k, prepend=k[:1] + np.uint32(1)))
        return k[first].astype(np.int64), np.add.reduceat(n, first, dtype=np.int64)


def _tables(parts: int):
    """From blocks sorted by range, for each range of keys: a bit for each slot with a key in two documents or more, and the common keys with their levels."""
    low = 32 - parts.bit_length() + 1
    bits = SHARED_BITS - parts.bit_length() + 1

    def table_of(part: int, counts: _Counts) -> pa.RecordBatch:
        k, count = counts.summed()
        shared = np.zeros(1 << bits, bool)
        shared[k[count > 1] >> (low - bits)] = True
        many = count >= COMMON
        slot = (k[many] + (part << low)) >> (32 - LEVEL_BITS)
        level = np.log2(count[many]).astype(np.uint8)
        hist = np.bincount(level, minlength=64)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (np.packbits(shared), slot.astype(np.uint32), level)], pa.array([hist.tolist()], pa.list_(pa.int64()))], ["part", "shared", "slots", "levels", "hist"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = -1, None
        for batch in batches:
            for part, *block in zip(*[batch.column(c).to_pylist() for c in ("part", "keys", "which", "often")], strict=True):
                if part != now:
                    if counts:
                        yield table_of(now, counts)
                    now, counts = part, _Counts(low)
                counts.add(*block)
        if counts:
            yield table_of(now, counts)
        release()

    return run


def _key_counts(d: DataFrame, size: int, scratch: Scratch, level=None) -> DataFrame:
    """Keys are counted in ranges whose number grows with the text (of ``size`` bytes), up to 2**PARTS_BITS. A range's blocks stream through a task in any number."""
    parts = 1 << min(PARTS_BITS, max(3, (size // 6 // _RANGE).bit_length()))
    blocks = d.select("text").mapInArrow(_counted(parts, level), "part int, keys binary, which binary, often binary")
    n = max(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts // 16)
    ordered = blocks.repartition(min(n, parts), "part").sortWithinPartitions("part")
    return scratch.write(ordered.mapInArrow(_tables(parts), "part int, shared binary, slots binary, levels binary, hist array<long>"), "shingle-tables")


def _over(least: int):
    """The slots and levels over ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, levels = [], []
            for s, lv in zip(batch.column("slots").to_pylist(), batch.column("levels").to_pylist(), strict=True):
                some = np.frombuffer(lv, np.uint8) > least
                slots.append(np.frombuffer(s, np.uint32)[some].tobytes())
                levels.append(np.frombuffer(lv, np.uint8)[some].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.binary()), pa.array(levels, pa.binary())], ["slots", "levels"])

    return run


def level_table(d: DataFrame, size: int, scratch: Scratch) -> np.ndarray:
    """How common shingles are, by their upper bits: a table of fixed size (4 MB) from counts over all documents.

    Where more than LEVELLED shingles are common, it has the most frequent ones."""
    made = _key_counts(d, size, scratch)
    hist = {r.pos: r.n for r in made.select(F.posexplode("hist").alias("pos", "n")).groupBy("pos").agg(F.sum("n").alias("n")).collect()}
    least, total = 63, 0
    while least >= 0 and total + hist.get(least, 0) <= LEVELLED:
        total += hist.get(least, 0)
        least -= 1
    level = np.zeros(1 << LEVEL_BITS, np.uint8)
    # LEVELLED slots at most, however many keys are common
    for r in made.select("slots", "levels").mapInArrow(_over(least), "slots binary, levels binary").collect():
        np.maximum.at(level, np.frombuffer(r.slots, np.uint32), np.frombuffer(r.levels, np.uint8))
    return level


def shared_table(d: DataFrame, size: int, level, scratch: Scratch) -> np.ndarray:
    """A bit for each slot with a shingle that two documents have in their prefixes: a table of fixed size (16 MB).

    A list needs two members, so shingles without a bit are left out. As the corpus grows the table fills up and leaves out
    fewer; results don't depend on it, and the lists are bounded by all prefixes, a quarter of all shingles."""
    shared = np.zeros(1 << SHARED_BITS - 3, np.uint8)
    for r in _key_counts(d, size // 3, scratch, level).select("part", "shared").toLocalIterator():
        a = np.frombuffer(r.shared, np.uint8)
        shared[r.part * len(a) : (r.part + 1) * len(a)] = a
    return shared


def prefix_size(n):
    """How many first shingles a set of ``n`` must show: n less the smallest overlap of a link, plus one."""
    return n - -(-NUM * n // DEN) + 1


def bitmap(h: np.ndarray) -> bytes:
    """Parities of a set's hashes by their lower bits, in at least twice as many bits as hashes."""
    size = 1 << min(17, max(6, int(2 * len(h) - 1).bit_length()))
    return np.packbits(np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1 == 1).tobytes()


def least_overlap(n, m):
    """The smallest intersection of linked sets of sizes ``n`` and ``m``."""
    return -(-NUM * (n + m) // (NUM + DEN))


SIGNATURES = "row long, doc_id long, text_hash long, n long, fp binary, toks array<long>, pos array<int>, bits binary"


def _signed(shared, level):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared_, level_ = shared.value, level.value
        for batch in slices(batches):
            h, at = shingle_sets(*text_bytes(batch.column("text")))
            slot = h >> np.uint64(64 - SHARED_BITS)
            has = (shared_[slot >> np.uint64(3)] >> (np.uint64(7) - (slot & np.uint64(7))).astype(np.uint8)) & 1 == 1
            fps, bits, toks, pos = [], [], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                s = h[a:b]
                fps.append(hashlib.md5(s.tobytes()).digest())
                bits.append(bitmap(s))
                first = _in_order(s, level_)
                place = np.flatnonzero(has[a:b][first])
                toks.append(s[first[place]].view(np.int64))
                pos.append(place.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("text_hash"), pa.array(np.diff(at)), pa.array(fps, pa.binary()), pa.array(toks, pa.list_(pa.int64())), pa.array(pos, pa.list_(pa.int32())), pa.array(bits, pa.binary())], [f.split()[0] for f in SIGNATURES.split(", ")])

    return run


def signatures(d: DataFrame, scratch: Scratch) -> DataFrame:
    """Each row's key, list entries and bitmap."""
    sc = d.sparkSession.sparkContext
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    level = sc.broadcast(level_table(d, size, scratch))
    shared = sc.broadcast(shared_table(d, size, level, scratch))
    out = scratch.write(d.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text_hash", "text").mapInArrow(_signed(shared, level), SIGNATURES), "signatures", keep=True)
    for table in (level, shared):  # 20 MB in each worker
        table.unpersist()
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        h, at = shingle_sets(*text_bytes(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["row", "s"])


def wanted_sets(d: DataFrame, sig: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, s) for the given rows, from their texts: only these move, and each set is made once and read from then on."""
    wanted = scratch.write(sig.select("row", "doc_id", "text_hash").join(rows, "row", "left_semi"), "wanted").withColumnsRenamed({"doc_id": "id", "text_hash": "hash"})
    hits = bit_filter(d, "doc_id", wanted, "id").join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))
    return scratch.write(hits.dropDuplicates(["id", "hash"]).select("row", "text").mapInArrow(_sets, "row long, s binary"), "sets")


def can_link(n, i, m, j):
    """Whether sets of sizes n and m that share the shingle at places i and j, and none before, can link."""
    return (DEN * np.minimum(n, m) >= NUM * np.maximum(n, m)) & (np.minimum(n - i, m - j) >= least_overlap(n, m))


def _can_link(n: Column, i: Column, m: Column, j: Column) -> Column:
    return (DEN * F.least(n, m) >= NUM * F.greatest(n, m)) & ((NUM + DEN) * F.least(n - i, m - j) >= NUM * (n + m))


def _short_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From entries (tok, row, n, pos) sorted by tok, at most LONG a list: the pairs (a, b) that can link, lists of one size at a time."""

    def pairs(x: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.diff(x[:, 0], prepend=x[0, 0] - 1 if len(x) else 0))
        sizes = np.diff(starts, append=len(x))
        found = [np.zeros((0, 2), np.int64)]
        for k in np.unique(sizes[sizes > 1]).tolist():
            i, j = np.triu_indices(k, 1)
            at = starts[sizes == k]
            step = max(1, (1 << 16) // len(i))
            for c in range(0, len(at), step):
                u, v = x[(at[c : c + step, None] + i).ravel()], x[(at[c : c + step, None] + j).ravel()]
                ok = can_link(u[:, 2], u[:, 3], v[:, 2], v[:, 3])
                found.append(np.stack([np.minimum(u[ok, 1], v[ok, 1]), np.maximum(u[ok, 1], v[ok, 1])], 1))
        p = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])

    held = np.zeros((0, 4), np.int64)
    for batch in batches:
        x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tok", "row", "n", "pos")], 1)
        x = np.concatenate([held, x])
        last = int(np.searchsorted(x[:, 0], x[-1, 0])) if len(x) else 0
        held = x[last:]
        if last:
            yield pairs(x[:last])
    if len(held):
        yield pairs(held)


def _hamming(a: bytes, b: bytes) -> int:
    """Differing bits of two bitmaps, the longer one folded to the shorter's size."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):
        half = len(y) // 2
        y = y[:half] ^ y[half:]
    return int(np.bitwise_count(x ^ y).sum())


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps leave room for enough overlap."""
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("n", "m", "x", "y")]
        ok = [(n + m - _hamming(x, y)) // 2 >= least_overlap(n, m) for n, m, x, y in zip(*cols, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for s, t in zip(batch.column("s").to_pylist(), batch.column("t").to_pylist(), strict=True):
            x, y = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(DEN * both >= NUM * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def verify(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets. A bit filter keeps other rows' sets from being moved."""
    wanted = bit_filter(sets, "row", pairs.select(F.explode(F.array("a", "b")).alias("row")), "row").hint("merge")
    joined = pairs.join(wanted.withColumnRenamed("row", "a"), "a").join(wanted.select(F.col("row").alias("b"), F.col("s").alias("t")), "b")
    return joined.select("a", "b", "s", "t").mapInArrow(_verified, "a long, b long")


def _with_component(df: DataFrame, comp: DataFrame, row: str, name: str) -> DataFrame:
    known = comp.select(F.col("node").alias(row), F.col("component").alias(name))
    return df.join(known, row, "left").withColumn(name, F.coalesce(name, row))


def _across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends aren't known to be connected."""
    return _with_component(_with_component(pairs, comp, "a", "ca"), comp, "b", "cb").filter("ca <> cb").select("a", "b")


def block_links(drivers: list[np.ndarray], driver_comp: np.ndarray, members: list[np.ndarray], member_comp: np.ndarray) -> list[tuple[int, int]]:
    """Links (driver, member) across components, one for each two components that they join: a spanning forest at most.

    A driver's overlaps with all members are derived from the driver's before it where the two differ in less than the set has."""
    size = np.array([len(s) for s in members])
    owner = np.repeat(np.arange(len(members)), size)
    toks = np.concatenate(members)
    order = np.argsort(toks, kind="stable")
    toks, owner = toks[order], owner[order]

    def overlaps(s: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(toks, s), np.searchsorted(toks, s, side="right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(owner[at], minlength=len(members))

    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := parent.get(c, c)) != c:
            parent[c] = parent.get(up, up)
            c = up
        return c

    out = []
    before, shared = np.zeros(0, np.uint64), np.zeros(len(members), np.int64)
    for i in sorted(range(len(drivers)), key=lambda i: drivers[i][0]):
        s = drivers[i]
        gone, new = np.setdiff1d(before, s, assume_unique=True), np.setdiff1d(s, before, assume_unique=True)
        shared = shared - overlaps(gone) + overlaps(new) if len(gone) + len(new) < len(s) else overlaps(s)
        before = s
        for j in np.flatnonzero((DEN * shared >= NUM * (len(s) + size - shared)) & (member_comp != driver_comp[i])).tolist():
            a, b = root(int(driver_comp[i])), root(int(member_comp[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def _block_links(key: tuple, rows: pa.Table) -> pa.Table:
    drives = rows.column("drives").to_numpy(zero_copy_only=False).astype(bool)
    row, comp = (rows.column(c).to_numpy() for c in ("row", "comp"))
    sets = [np.frombuffer(s, np.uint64) for s in rows.column("s").to_pylist()]
    x, y = np.flatnonzero(drives), np.flatnonzero(~drives)
    found = block_links([sets[i] for i in x], comp[x], [sets[i] for i in y], comp[y]) if len(x) and len(y) else []
    return pa.table({"a": pa.array([int(row[x[i]]) for i, _ in found], pa.int64()), "b": pa.array([int(row[y[j]]) for _, j in found], pa.int64())})


def long_links(members: DataFrame, comp: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links across components within long lists. ``members``: tok, row, n, pos and the list's central row, mid.

    A list is cut by size (ratios of 4 / 3) and position (32nds of the set), and each cell of these by a hash into
    blocks of bounded bytes. Drivers go only to cells that bounds allow."""
    m = _with_component(_with_component(members, comp, "row", "comp"), comp, "mid", "major")
    m = m.withColumns({"sc": F.floor(F.log("n") / F.log(F.lit(DEN / NUM))).cast("int"), "pc": F.floor(32 * F.col("pos") / F.col("n")).cast("int")})
    drivers = scratch.write(m.filter("comp <> major").select("tok", "row", "n", "pos", "comp"), "drivers")
    m = m.join(drivers.select("tok").distinct(), "tok", "left_semi").select("tok", "row", "n", "pos", "comp", "sc", "pc")
    m = scratch.write(m, "open-lists")
    cells = m.groupBy("tok", "sc", "pc").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.ceil(F.sum("n") * 8 / BLOCK_BYTES).cast("int").alias("splits"))
    least_m = F.greatest("n0", F.ceil(NUM * F.col("n") / DEN))
    fits = (NUM * F.col("n") <= DEN * F.col("n1")) & (NUM * F.col("n0") <= DEN * F.col("n")) & ((NUM + DEN) * F.least(F.col("n") - F.col("pos"), "rest") >= NUM * (F.col("n") + least_m))
    sent = drivers.join(cells, "tok").filter(fits & ((F.col("c0") != F.col("comp")) | (F.col("c1") != F.col("comp"))))
    sent = scratch.write(sent.select("tok", "sc", "pc", "row", "n", "comp", "splits"), "visits")
    visited = sent.groupBy("tok", "sc", "pc").agg(F.max("splits").alias("splits"), F.ceil(F.sum("n") * 8 / BLOCK_BYTES).cast("int").alias("parts"))
    visited = scratch.write(visited, "visited")
    part, split = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("row"), F.col("splits")).cast("int")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    key = ["tok", "sc", "pc"]
    left = sent.drop("splits").join(visited, key).select(*key, part.alias("g"), all_of("splits").alias("h"), "row", "comp", F.lit(True).alias("drives"))
    right = m.join(visited, key).select(*key, all_of("parts").alias("g"), split.alias("h"), "row", "comp", F.lit(False).alias("drives"))
    rows = scratch.write(left.unionByName(right), "block-rows")
    wanted = bit_filter(sets, "row", rows, "row")
    return rows.join(wanted.hint("merge"), "row").groupBy(*key, "g", "h").applyInArrow(_block_links, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles (the set's size), component_id (smallest doc_id reachable by links), text_hash.

    Two documents link when their sets of five-word shingles have a Jaccard similarity of NUM / DEN or more.
    A text without words, empty or null has no shingles and links with nothing. Rows are compared as rows: those
    that repeat a doc_id each have their own set and component, so one doc_id may be in two components. A null
    doc_id is never a component_id unless all rows that it reaches have none. Other columns, whatever their names,
    are ignored; an empty table gives no rows. text_hash (xxhash64 of the text as it stands, null as empty) tells rows of one doc_id apart."""
    d = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    with Scratch(d.sparkSession) as scratch:
        sig = signatures(d, scratch)
        classes = scratch.write(sig.filter("n > 0").groupBy("fp").agg(F.min("row").alias("row"), F.min("doc_id").alias("least"), F.count("*").alias("size")), "classes")
        reps = scratch.write(sig.join(classes.select("row"), "row", "left_semi").select("row", "n", "toks", "pos", "bits"), "representatives")
        entries = reps.select("row", "n", F.explode(F.arrays_zip("toks", "pos")).alias("e")).select(F.col("e.toks").alias("tok"), "row", "n", F.col("e.pos").alias("pos"))
        long = entries.groupBy("tok").agg(F.count("*").alias("size"), F.min(F.struct("pos", "n", "row")).alias("mid")).filter(F.col("size") > LONG)
        long = scratch.write(long.select("tok", F.col("mid.row").alias("mid"), F.col("mid.n").alias("mid_n"), F.col("mid.pos").alias("mid_pos")), "long-lists")
        n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        short = entries.join(long, "tok", "left_anti").repartition(n, "tok").sortWithinPartitions("tok", "pos", "n").mapInArrow(_short_pairs, "a long, b long")
        members = scratch.write(entries.join(long, "tok"), "members")
        central = members.filter((F.col("row") != F.col("mid")) & _can_link(F.col("n"), F.col("pos"), F.col("mid_n"), F.col("mid_pos"))).select(F.least("row", "mid").alias("a"), F.greatest("row", "mid").alias("b"))
        pairs = scratch.write(short.unionByName(central).distinct(), "candidates")
        of = lambda c, k, bits: reps.select(F.col("row").alias(c), F.col("n").alias(k), F.col("bits").alias(bits))
        pairs = scratch.write(pairs.join(of("a", "n", "x"), "a").join(of("b", "m", "y"), "b").mapInArrow(_bounded, "a long, b long"), "pairs")
        sets = wanted_sets(d, sig, pairs.select(F.explode(F.array("a", "b")).alias("row")).unionByName(members.select("row")), scratch)
        tree = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        links = scratch.write(verify(sets, tree), "links")
        comp = components(links, scratch)
        links = links.unionByName(scratch.write(verify(sets, scratch.write(_across(pairs, comp), "open-pairs")), "links"))
        comp = components(links, scratch)
        if not members.isEmpty():
            links = links.unionByName(scratch.write(long_links(members, comp, sets, scratch), "links"))
            comp = components(links, scratch)
        named = classes.join(comp, F.col("row") == F.col("node"), "left").filter("size > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "row"))
        ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
        named = scratch.write(named.select("fp", "component").join(ids, "component").select("fp", "component_id"), "named", keep=True)
    found = sig.select("doc_id", "n", "fp", "text_hash").join(named.withColumn("known", F.lit(True)), "fp", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "text_hash")
