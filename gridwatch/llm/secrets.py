"""Secret scans: fixed formats, and sliding-window Shannon entropy per character class.

DataFrame functions only. A candidate string is a long run of token characters that touches no span
of a fixed format. Its class (hexadecimal, digits with letters of one case, letters of both cases, or the
base64 alphabet) sets the entropy that one window must reach. Allow-lists suppress what isn't a secret
whatever its entropy: words of one case, numbers, UUIDs, digests named as such; paths and placeholders unless
what is left of them is as random as a secret. Windows slide by one character: the state is the sum of
c * log2(c) over the counts of a window's symbols, and a step changes two terms of that sum, for the
symbol that leaves and the one that enters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text
from .spans import NONE, bound, chunks, joined, matches, outside, part, redact

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex")
WINDOW = 20
#: Bits that a window of WINDOW characters must reach, by class.
LEAST_BITS = {"hex": 3.0, "lower": 3.4, "upper": 3.4, "letters": 4.0, "base64": 3.6}
#: From this length on, a part of a path is held to its class's bits, less by its length where that is under WINDOW.
LEAST_PART = 12
#: Strings that look random and are no secrets, by what the whole candidate or the text before it matches.
ALLOWED = (
    r"^(?:[A-Z]?[a-z]+|[A-Z]+)$",  # words of one case
    r"^[0-9_=/+-]+$",  # numbers, dates and rules
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(?:[a-z]{6,}[0-9]{1,8}(?:[a-z]{6,})?|[A-Z]{6,}[0-9]{1,8}(?:[A-Z]{6,})?)$",  # words of one case around or before one number
)
#: Words of placeholders; a candidate with one is allowed if what is left without them has too little entropy.
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|x{6,}|0{8,}|1234567"
#: What all parts between separators of a path or name match, in one case or the other; allowed if no part has its class's entropy.
PATH_PARTS = (r"^(?:[a-z]++[0-9]*+|[0-9]++)$", r"^(?:[A-Z]++[0-9]*+|[0-9]++)$")
#: Mixed-case paths: what all parts but the first match.
PATH_REST = r"^[A-Za-z]*+(?<=[a-z])[a-z0-9]*+$"
ALLOWED_BEFORE = r"(?i)(?:sha-?(?:1|256|512)|md5|checksum|integrity|commit|uuid|etag)[\"'\x20:=-]*$"


def base_spans(text: Column) -> Column:
    """The spans of the three fixed formats."""
    assign = F.filter(matches(text, ASSIGN, "assign", 0), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6)
    return F.array_sort(F.concat(assign, matches(text, ACCESS, "access", 1), matches(text, HEX, "hex", 2)))


def window_bits(s: Column, width: int = WINDOW) -> Column:
    """The highest entropy, in bits, of any window of ``width`` characters of an ASCII string; below 0 for a shorter one."""
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 2)])
    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c))
    state = F.struct(F.lit(0.0).alias("sum"), F.lit(-1.0).alias("bits"))

    def step(st: Column, x: Column) -> Column:
        # counts among the characters that stay in the window, once with and once without the one that leaves or enters
        stay, old, new = x["stay"], x["old"], x["new"]
        count = lambda c: F.size(stay) - F.size(F.array_remove(stay, c))
        less = F.when(old >= 0, F.get(terms, count(old)) - F.get(terms, count(old) + 1)).otherwise(0.0)
        total = st["sum"] + less + F.get(terms, count(new) + 1) - F.get(terms, count(new))
        return F.struct(total.alias("sum"), F.when(x["full"], F.greatest(st["bits"], F.lit(math.log2(width)) - total / width)).otherwise(st["bits"]).alias("bits"))

    first = lambda i: F.greatest(i - (width - 1), F.lit(0))

    def best(cs: Column) -> Column:
        steps = F.transform(cs, lambda c, i: F.struct(c.alias("new"), F.when(i >= width, F.get(cs, i - width)).otherwise(-1).alias("old"), F.slice(cs, first(i) + 1, i - first(i)).alias("stay"), (i >= width - 1).alias("full")))
        return F.aggregate(steps, state, step, lambda st: st["bits"])

    return F.get(F.transform(F.array(codes), best), 0)  # binds the codes once, for all steps


def _without(spans: Column, pattern: str) -> Column:
    return F.filter(spans, lambda x: ~x["m"].rlike(pattern))


def _least_bits(s: Column) -> Column:
    """What a window of a string must reach, by the string's class."""
    by_case = F.when(s.rlike("^[A-Za-z]+$"), LEAST_BITS["letters"]).when(~s.rlike("[A-Z]"), LEAST_BITS["lower"]).when(~s.rlike("[a-z]"), LEAST_BITS["upper"]).otherwise(LEAST_BITS["base64"])
    return F.when(s.rlike("^[0-9a-fA-F=-]+$"), LEAST_BITS["hex"]).otherwise(by_case)


def _short_bits(s: Column) -> Column:
    """The entropy, in bits, of a string shorter than WINDOW."""
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)])
    codes = F.split(s, "")
    total = F.aggregate(F.array_distinct(codes), F.lit(0.0), lambda t, c: t + F.get(terms, F.size(codes) - F.size(F.array_remove(codes, c))))
    return F.log2(F.length(s).cast("double")) - total / F.length(s)


def _random_part(s: Column) -> Column:
    """Whether a part between separators has letters, digits and its class's entropy."""
    share = F.log2(F.length(s).cast("double")) / math.log2(WINDOW)
    bits = F.when(F.length(s) >= WINDOW, window_bits(s) >= _least_bits(s)).otherwise(_short_bits(s) >= _least_bits(s) * share)
    return F.when((F.length(s) >= LEAST_PART) & s.rlike("[0-9]") & s.rlike("[A-Za-z]") & ~s.rlike("^[A-Za-z]+[0-9]{1,4}$"), bits).otherwise(False)


def _is_path(s: Column) -> Column:
    """Whether a string is several parts that look like words and numbers. Parts are matched one by one: time is linear in the length."""

    def shaped(parts: Column) -> Column:
        first = F.get(parts, 0)
        mixed = first.rlike("^[A-Za-z0-9]*+$") & first.rlike("[a-z]{2}") & F.forall(F.slice(parts, 2, F.size(parts)), lambda p: p.rlike(PATH_REST))
        one_case = [F.forall(parts, lambda p: p.rlike(PATH_PARTS[0])), F.forall(parts, lambda p: p.rlike(PATH_PARTS[1]))]
        return F.when(F.size(parts) >= 2, mixed | one_case[0] | one_case[1]).otherwise(False)

    return F.get(F.transform(F.array(F.filter(F.split(s, "[/_-]+"), lambda p: p != "")), shaped), 0)


def entropy_spans(text: Column, base: Column) -> Column:
    """Candidates outside ``base`` that aren't allowed and have a window with enough entropy for their class."""
    found = outside(matches(text, CANDIDATE, "entropy", 3), base)
    for pattern in ALLOWED:
        found = _without(found, pattern)
    before = lambda pieces, x: part(pieces, F.greatest(x["start"] - 16, F.lit(0)), x["start"])
    found = bound(F.struct(chunks(text).alias("pieces"), found.alias("found")), lambda s: F.filter(s["found"], lambda x: ~before(s["pieces"], x).rlike(ALLOWED_BEFORE)))
    found = F.filter(found, lambda x: ~_is_path(x["m"]) | F.exists(F.split(x["m"], "[/_-]"), _random_part))
    found = F.filter(found, lambda x: window_bits(x["m"]) >= _least_bits(x["m"]))

    def real(x: Column) -> Column:
        rest = F.regexp_replace(x["m"], PLACEHOLDER, "")
        return F.when(x["m"].rlike(PLACEHOLDER), window_bits(rest) >= _least_bits(rest)).otherwise(True)

    return F.filter(found, real)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, base (spans of fixed formats), added (by entropy); spans have start, end, kind and text.

    Null text counts as empty and has no spans; a null doc_id stays null; repeated rows each get theirs; spans that would
    touch a base span are left out; a very long text is scanned whole, in time linear in its length and matches; spans that start at one place are in
    the order of their kinds; other columns are ignored; an empty table gives no rows."""
    d = id_and_text(docs, id_col, text_col)
    text = F.col("text")
    d = d.withColumn("base", base_spans(text))
    return d.select("doc_id", "base", F.when(text.rlike(CANDIDATE), entropy_spans(text, F.col("base"))).otherwise(F.array().cast(NONE)).alias("added"))


def secret_digest(spans: DataFrame) -> DataFrame:
    """Counts per kind, the base spans' digest and all spans as a string."""
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *map(n, KINDS), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by ``mark``; null texts and all other columns stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = base_spans(text)
    spans = F.concat(base, F.when(text.rlike(CANDIDATE), entropy_spans(text, base)).otherwise(F.array().cast(NONE)))
    hit = text.rlike(ASSIGN) | text.rlike(CANDIDATE) | text.rlike(ACCESS)
    return docs.withColumn(text_col, F.when(hit, redact(text, spans, mark)).otherwise(F.col(text_col)))
