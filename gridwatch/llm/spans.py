"""Spans of pattern matches as DataFrame expressions: positions in code points, end exclusive.

All take time in proportion to text and matches (times a logarithm where spans are sorted): arrays are scanned in groups,
and long texts are cut into chunks before parts of them are taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: start, place of the kind in its list, kind, end, and the matched text.
SPAN = "struct<start: int, place: int, kind: string, end: int, m: string>"
NONE = f"array<{SPAN}>"
#: Elements of a group in a scan, and characters of a chunk of text.
RADIX, CHUNK = 128, 2048
#: Where no more pairs than this are at hand, each is looked at.
FEW_PAIRS = 1024


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value evaluated once however often ``of`` uses it."""
    return F.get(F.transform(F.array(value), of), 0)


def _short_scan(values: Column, start: Column, op: Callable[[Column, Column], Column]) -> Column:
    state = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, state, lambda s, x: F.struct(op(s["at"], x).cast("int").alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])


def scan(values: Column, op: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each of an array of ints, ``op`` (associative, with ``zero`` as its neutral element) over all before it.

    Arrays are built up in copies, so only groups of RADIX elements, and the groups' totals, are scanned one after the other."""
    total = lambda g: F.aggregate(g, F.lit(zero), lambda s, x: op(s, x).cast("int"))
    whole = lambda gs: F.flatten(F.zip_with(gs, _short_scan(F.transform(gs, total), F.lit(zero), op), lambda g, start: _short_scan(g, start, op)))
    groups = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / RADIX).cast("int")), lambda g: F.slice(v, g * RADIX + 1, F.lit(RADIX)))
    return bound(bound(values, groups), whole)


def plus(a: Column, b: Column) -> Column:
    return a + b


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def matches(text: Column, pattern: str, kind: str, place: int) -> Column:
    """The leftmost non-overlapping matches of a pattern that never matches the empty string.

    The text between matches (``split``) and the matches themselves (``regexp_extract_all``) come from
    the same matcher, so their running lengths are the positions. Patterns here avoid quadratic scans
    and recursion in the matcher: starts are anchored to the start of a run, and loops are possessive."""

    def placed(steps: Column) -> Column:
        starts = scan(F.transform(steps, lambda x: x["gap"] + x["size"]), plus, 0)
        return F.zip_with(steps, starts, lambda x, at: F.struct((at + x["gap"]).cast("int").alias("start"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), (at + x["gap"] + x["size"]).cast("int").alias("end"), x["m"].alias("m"))).cast(NONE)

    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    both = F.zip_with(gaps, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(g.alias("gap"), F.length(m).alias("size"), m.alias("m")))
    return F.when(text.rlike(pattern), bound(F.filter(both, lambda x: x["m"].isNotNull()), placed)).otherwise(F.array().cast(NONE))


def joined(spans: Column, by_kind: bool = False) -> Column:
    """kind:start:end, comma-joined, by start then kind; ``by_kind``: by kind then start."""
    if by_kind:
        spans = F.transform(spans, lambda x: F.struct(x["place"].alias("place"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def outside(spans: Column, base: Column) -> Column:
    """The spans that touch none of ``base``, in their order.

    Many of both are merged by their starts: what begins before a span must end before it, and what begins after it must begin past its end."""

    def few(x: Column, y: Column) -> Column:
        return F.filter(x, lambda a: ~F.exists(y, lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))

    def many(x: Column, y: Column) -> Column:
        entry = lambda own: lambda s, i: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), i.alias("i"), s["end"].alias("end"))

        def kept(merged: Column) -> Column:
            before = scan(F.transform(merged, lambda e: F.when(e["own"] == 0, e["end"]).otherwise(-1)), larger, -1)
            after = F.reverse(scan(F.transform(F.reverse(merged), lambda e: F.when(e["own"] == 0, -e["start"]).otherwise(-(2**31 - 1))), larger, -(2**31 - 1)))
            entries = F.filter(F.arrays_zip(merged.alias("e"), before.alias("b"), after.alias("a")), lambda z: (z["e"]["own"] == 1) & (z["b"] <= z["e"]["start"]) & (-z["a"] >= z["e"]["end"]))
            return F.transform(F.array_sort(F.transform(entries, lambda z: z["e"]["i"])), lambda i: F.get(x, i))

        return bound(F.array_sort(F.concat(F.transform(y, entry(0)), F.transform(x, entry(1)))), kept)

    both = lambda x, y: F.when(F.size(x) * F.size(y) <= FEW_PAIRS, few(x, y)).otherwise(many(x, y))
    return bound(F.struct(spans.cast(NONE).alias("x"), base.cast(NONE).alias("y")), lambda s: both(s["x"], s["y"]))


def chunks(text: Column) -> Column:
    """A text as an array: whole where it is short, else in parts of CHUNK characters."""
    return F.when(F.length(text) <= 2 * CHUNK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))


def part(pieces: Column, start: Column, end: Column) -> Column:
    """Characters from ``start`` to before ``end`` of a text that ``chunks`` has cut."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
    one = lambda i, a, n: F.substring(F.get(pieces, i), a, n)
    across = F.concat(one(first, start % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), one(last, F.lit(1), end - last * CHUNK))
    cut = F.when(first == last, one(first, start % CHUNK + 1, end - start)).otherwise(across)
    return F.when(end <= start, F.lit("")).when(F.size(pieces) == 1, F.substring(F.get(pieces, 0), start + 1, end - start)).otherwise(cut)


def redact(text: Column, spans: Column, mark: str) -> Column:
    """The text with each span, or run of overlapping spans, replaced by ``mark``."""

    def marked(pieces: Column) -> Column:
        def of(sorted_spans: Column) -> Column:
            upto = scan(F.transform(sorted_spans, lambda x: x["end"]), larger, 0)  # where all spans before a span have ended
            runs = F.filter(F.zip_with(sorted_spans, upto, lambda x, at: F.struct(x["start"].alias("start"), at.alias("at"))), lambda r: r["start"] >= r["at"])
            tail = part(pieces, F.array_max(F.transform(sorted_spans, lambda x: x["end"])), F.length(text))
            return F.concat(F.array_join(F.transform(runs, lambda r: F.concat(part(pieces, r["at"], r["start"]), F.lit(mark))), ""), tail)

        return bound(F.array_sort(spans), of)

    return F.when(F.size(spans) == 0, text).otherwise(bound(chunks(text), marked))
