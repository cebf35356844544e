"""Personal data by weak supervision, with DataFrame functions only.

Candidate spans are strict formats (which always stand), what looks like them and fails (a card number
without its check digit, parts above 255, a phone number run together with what follows), and looser
patterns. Four labelers vote for or against each candidate, or abstain: format (regex and check digits),
gazetteer, context words, and shape. Expectation-maximisation over the counts of vote patterns estimates
how reliable each labeler is and how likely each pattern is real; those likelihoods train a logistic
classifier over kind, votes, length and the word before the span, which no labeler reads, and it decides
on all candidates that aren't strict. What reaches the driver is a count per pattern, of which there are
at most len(KINDS) * 3**4 * LENGTHS * WORDS.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, written
from .spans import SPAN, bound, chunks, joined, matches, outside, part

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
BASE = ("email", "ip", "card", "phone")
#: Candidates within a match of a strict pattern that fails: grouped or plain card numbers, a whole phone number at the start, the match itself.
FAILED = {
    "card_like": (2, r"(?<![0-9])(?:[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{13,19})(?![0-9])"),
    "phone_like": (3, r"^\+[0-9]{1,3}[\x20.-]?\(?[0-9]{1,4}\)?[\x20.-]?[0-9]{2,4}[\x20.-]?[0-9]{4}(?![0-9])"),
    "ip_like": (1, r"^.+$"),
}
_CAP = r"[A-Z][a-z]{1,30}"
#: Common given names: fixed values, and only a default of ``pii_spans``.
NAMES = tuple(
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Lisa Daniel Nancy Matthew Betty Anthony Margaret Mark Sandra "
    "Donald Ashley Steven Kimberly Paul Emily Andrew Donna Joshua Michelle Kenneth Carol Kevin Amanda Brian Dorothy George Melissa Edward Deborah Hans Peter Anna Laura Maria Jose Juan Carlos Luis Carmen Ana Isabel Pablo "
    "Jean Pierre Marie Jacques Michel Claude Sophie Camille Klaus Jürgen Monika Ursula Sabine Stefan Andreas Wolfgang Helga Petra".split()
)
#: Looser candidates, which the classifier decides on.
LOOSE = {
    "phone_local": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "email_spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]{1,64}(?:\x20?[\[(](?i:dot)[\])]\x20?[A-Za-z0-9-]{1,64}){1,4}",
    "name": None,  # a title or given name, and a name: made from the list of names
}
KINDS = (*BASE, *FAILED, *LOOSE)
LABELERS = ("format", "gazetteer", "context", "shape")
#: Classes of a span's length, and of the word before it (by a hash; 0 is none).
LENGTHS, WORDS = 8, 32
CANDIDATES = f"array<struct<s: {SPAN}, format: int, gazetteer: int, context: int, shape: int, len: int, word: int>>"
#: Characters of text before a span that the context labeler reads.
BEFORE = 40
CONTEXT_FOR = r"(?i)(?:e-?mail|mail|contact|reach|phone|tel|call|mobile|fax|card|visa|credit|ssn|social security|address|\bip\b|host|name|signed|regards|dear|born)"
CONTEXT_AGAINST = r"(?i)(?:invoice|order|version|isbn|part no|serial|ticket|page|section|build|release|figure|table)"
GAZETTEER = {
    "email": (r"(?i)@(?:gmail|yahoo|hotmail|outlook|icloud|mail[0-9]*)\.|\.(?:com|org|net|edu|de|fr|es|uk)$", r"(?i)\.(?:png|jpg|gif|js|css|html)$"),
    "ip": (r"^(?:[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\.", r"^(?:0|127|255)\."),
    "card": (r"^(?:4|5[1-5]|3[47]|6011|65|2[2-7])", r"^[01789]"),
    "phone": (r"^\+(?:1|7|2[07]|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])", r"^\+0"),
    "phone_local": (r"^\(?[2-9]", r"^\(?[01]"),
    "national_id": (r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)", r"^(?:000|666|9)|-00-|-0000$"),
    "email_spelled": (r"(?i)(?:com|org|net|edu|de|fr|es|uk)$", r"(?i)[\[(]dot[\])]\x20?(?:png|jpg|gif)$"),
    "name": (None, r"(?:Street|Road|Avenue|River|Company|Institute|University|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)"),
}
GAZETTEER |= {"card_like": GAZETTEER["card"], "phone_like": GAZETTEER["phone"], "ip_like": GAZETTEER["ip"]}
#: Loose kinds whose own numbering rules can be checked: what is valid, and what is not.
RULES = {
    "phone_local": (r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9]", r"^\(?[01]|^\(?[0-9]{3}\)?[\x20.-][01]"),
    "national_id": (r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)", r"^(?:000|666|9)|-00-|-0000$"),
    "email_spelled": (r"[\[(](?i:at)[\])].*[\[(](?i:dot)[\])]", r"^[^A-Za-z]+$"),
}


def _name(names: tuple[str, ...]) -> str:
    return rf"(?<![A-Za-z])(?:(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20{_CAP}(?:\x20{_CAP})?|(?:{'|'.join(names)})\x20{_CAP})(?![A-Za-z])"


#: A given name is learned from this many documents on that have it between a title and another name; so many of the most frequent at most.
SEEN, MOST_NAMES = 3, 300
TITLED = rf"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20({_CAP})\x20{_CAP}(?![A-Za-z])"


def learned_names(docs: DataFrame, text_col: str = "text", seen: int = SEEN, most: int = MOST_NAMES) -> tuple[str, ...]:
    """Given names that the corpus itself shows: words between a title and another name in ``seen`` documents or more, the ``most`` frequent, ties by name.

    Counted over all documents, once each; a gazetteer for ``pii_spans``, beside or instead of NAMES. Null texts have none."""
    text = F.col(text_col)
    found = docs.filter(text.rlike(TITLED)).select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(TITLED), F.lit(1)))).alias("name"))
    rows = found.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") >= seen).orderBy(F.desc("n"), "name").limit(most)
    return tuple(r.name for r in rows.collect())


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    d = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10 == 0


def strict_matches(text: Column) -> Column:
    """All matches of the strict patterns, those that fail their checks too."""
    none = F.array().cast(f"array<{SPAN}>")
    email = F.when(F.contains(text, F.lit("@")), matches(text, EMAIL, "email", 0)).otherwise(none)
    return F.concat(email, matches(text, IP, "ip", 1), matches(text, CARD, "card", 2), F.when(F.contains(text, F.lit("+")), matches(text, PHONE, "phone", 3)).otherwise(none))


def valid(x: Column) -> Column:
    """Whether a match of a strict pattern passes: parts up to 255, 13 to 19 digits passing Luhn, 9 to 15 digits."""
    digits = _digits(x["m"])
    card = F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    return F.when(x["place"] == 1, F.forall(F.split(x["m"], r"\."), lambda p: p.rlike(OCTET))).when(x["place"] == 2, card).when(x["place"] == 3, F.length(digits).between(9, 15)).otherwise(True)


def _within(kind: str, pattern: str, place: int):
    """Of a match, the matches of another pattern within it, by their places in the text."""

    def of(x: Column) -> Column:
        return F.transform(matches(x["m"], pattern, kind, place), lambda y: F.struct((y["start"] + x["start"]).alias("start"), y["place"].alias("place"), y["kind"].alias("kind"), (y["end"] + x["start"]).alias("end"), y["m"].alias("m")))

    return of


def _at_place(place: int):
    return lambda x: x["place"] == place


def failed_spans(failed: Column) -> Column:
    """The candidates within matches that fail."""
    parts = [F.transform(F.filter(failed, _at_place(place)), _within(kind, pattern, len(BASE) + i)) for i, (kind, (place, pattern)) in enumerate(FAILED.items())]
    return F.flatten(F.concat(*parts))


def _by_kind(s: Column, of, kinds: tuple[str, ...] = KINDS) -> Column:
    out = F.lit(0)
    for kind in kinds:
        out = F.when(s["kind"] == kind, of(kind)).otherwise(out)
    return out


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def voted(text: Column, spans: Column, names: tuple[str, ...] = NAMES) -> Column:
    """Each span with the four labelers' votes (1, -1, or 0 to abstain), a length class and a class of the word before."""
    named = rf"(?:^|\x20)(?:{'|'.join(names)})\b"

    def one(s: Column, pieces: Column) -> Column:
        m, digits = s["m"], _digits(s["m"])
        before = part(pieces, F.greatest(s["start"] - BEFORE, F.lit(0)), s["start"])
        check = {"card_like": _vote(luhn(digits), F.lit(True)), "phone_like": _vote(F.length(digits).between(9, 15), F.lit(True)), "ip_like": F.lit(-1), "name": _vote(m.rlike(r"^(?:Mr|Mrs|Ms|Dr|Prof)\b"), F.lit(False))}
        check |= {k: _vote(m.rlike(yes), m.rlike(no)) for k, (yes, no) in RULES.items()}
        fmt = F.when(s["place"] < len(BASE), 1).otherwise(_by_kind(s, check.__getitem__, tuple(check)))
        gaz = _by_kind(s, lambda k: _vote(m.rlike(GAZETTEER[k][0] or named) & ~m.rlike(GAZETTEER[k][1]), m.rlike(GAZETTEER[k][1])))
        shape = F.when(F.length(digits) >= 7, _vote(~digits.rlike(r"^([0-9])\1*+$|01234567|12345678"), digits.rlike(r"^([0-9])\1*+$"))).otherwise(0)
        last = F.lower(F.regexp_extract(before, r"(\p{L}+)\P{L}*$", 1))
        word = F.when(last == "", 0).otherwise(F.pmod(F.xxhash64(last), F.lit(WORDS - 1)) + 1).cast("int")
        return F.struct(s.alias("s"), fmt.alias("format"), gaz.alias("gazetteer"), _vote(before.rlike(CONTEXT_FOR), before.rlike(CONTEXT_AGAINST)).alias("context"), shape.alias("shape"), F.least(F.floor(F.length(m) / 5), F.lit(LENGTHS - 1)).cast("int").alias("len"), word.alias("word"))

    return bound(chunks(text), lambda pieces: F.transform(spans, lambda s: one(s, pieces))).cast(CANDIDATES)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, ...] = NAMES) -> DataFrame:
    """doc_id and all candidate spans with their votes; strict ones first, then those that touch no strict one."""
    d = id_and_text(docs, id_col, text_col)
    text = F.col("text")
    d = d.withColumn("all", strict_matches(text))
    d = d.withColumns({"base": F.filter("all", valid), "failed": F.filter("all", lambda x: ~valid(x))})
    d = d.withColumn("like", outside(failed_spans(F.col("failed")), F.col("base")))
    loose = F.concat(*[matches(text, p or _name(names), k, len(BASE) + len(FAILED) + i) for i, (k, p) in enumerate(LOOSE.items())])
    taken = F.concat("base", "like")
    return d.select("doc_id", voted(text, F.concat(taken, outside(loose, taken)), names).alias("found"))


def pattern_counts(found: DataFrame) -> list:
    """(kind place, votes..., length class, word class, rows) for each pattern, in order: a bounded number of rows."""
    rows = found.select(F.explode("found").alias("c")).groupBy(F.col("c.s.place").alias("place"), *[F.col(f"c.{x}").alias(x) for x in (*LABELERS, "len", "word")]).count()
    return sorted(tuple(r) for r in rows.collect())


def _one_hot(x: np.ndarray, sizes: list[int]) -> np.ndarray:
    return np.concatenate([np.eye(size)[x[:, i]] for i, size in enumerate(sizes)], 1)


def estimate(patterns: list, rounds: int = 50) -> np.ndarray:
    """EM over vote patterns: the likelihood that each pattern is real.

    A labeler has one distribution of votes for real and one for false candidates, shared by all kinds;
    each kind has its own share of real ones. Starts from the mean vote; add-one smoothing."""
    if not patterns:
        return np.zeros(0)
    p = np.array(patterns, np.int64)
    n, kind, votes = p[:, -1].astype(float), p[:, 0], p[:, 1:5]
    real = np.clip(0.5 + 0.45 * votes.sum(1) / 2, 0.05, 0.95)
    hot = [np.eye(3)[votes[:, i] + 1] for i in range(len(LABELERS))]
    of_kind = np.eye(len(KINDS))[kind]
    for _ in range(rounds):
        share = [1 + (n * q) @ of_kind for q in (1 - real, real)]
        logit = np.log(share[1] / share[0])[kind]
        for h in hot:
            no, yes = (1 + (n * q) @ h for q in (1 - real, real))
            logit = logit + h @ (np.log(yes / yes.sum()) - np.log(no / no.sum()))
        real = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return real


#: Sizes of the classifier's groups of weights: kinds, each labeler's votes, lengths, words before.
GROUPS = [len(KINDS), *[3] * len(LABELERS), LENGTHS, WORDS]


def fit_classifier(patterns: list, real: np.ndarray, steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> list[list[float]]:
    """Logistic regression on soft labels: weights by kind, by each labeler's vote, by length and by the word before."""
    w = np.zeros(sum(GROUPS))
    if patterns:
        p = np.array(patterns, np.int64)
        x = p[:, :-1].copy()
        x[:, 1:5] += 1
        n = np.zeros(len(KINDS))
        np.add.at(n, p[:, 0], p[:, -1])
        x, weight = _one_hot(x, GROUPS), p[:, -1] / np.sqrt(n[p[:, 0]])  # rare kinds count more than by their rows
        weight = weight / weight.sum()
        for _ in range(steps):
            w -= rate * (x.T @ (weight * (1 / (1 + np.exp(-x @ w)) - real)) + decay * w)
    return [part.tolist() for part in np.split(w, np.cumsum(GROUPS)[:-1])]


def score(c: Column, w: list[list[float]]) -> Column:
    """The classifier's log-odds for one candidate."""
    arrays = [F.array(*map(F.lit, row)) for row in w]
    total = F.get(arrays[0], c["s"]["place"]) + F.get(arrays[-2], c["len"]) + F.get(arrays[-1], c["word"])
    for a, name in zip(arrays[1:-2], LABELERS, strict=True):
        total = total + F.get(a, c[name] + 1)
    return total


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, ...] = NAMES) -> DataFrame:
    """One row per document: doc_id, base (strict spans), added (other candidates that the classifier accepts).

    Reliabilities and classifier come from the candidates of all documents. ``names``: the gazetteer of given
    names. A very long text is scanned whole, in time linear in its length and matches. Null text counts as empty and has no spans; a null doc_id stays null; repeated rows each get theirs;
    other columns are ignored; an empty table gives no rows."""
    found = written(candidates(docs, id_col, text_col, names), "pii-candidates")
    patterns = pattern_counts(found)
    w = fit_classifier(patterns, estimate(patterns))
    strict = F.filter("found", lambda c: c["s"]["place"] < len(BASE))
    loose = F.filter("found", lambda c: (c["s"]["place"] >= len(BASE)) & (score(c, w) >= 0))
    return found.select("doc_id", F.transform(strict, lambda c: c["s"]).alias("base"), F.transform(loose, lambda c: c["s"]).alias("added"))


def pii_digest(spans: DataFrame) -> DataFrame:
    """Counts per strict kind, their digest, all spans as a string, and their number."""
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *map(n, BASE), F.sha2(joined(F.col("base"), by_kind=True).cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", "added"), by_kind=True).alias("spans"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))
