"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element's own text, without elements that never hold
the article (menus, forms, scripts, notices and the like, by tag, role or class words). A line's weight
is its text outside links. Sums over a sliding window of lines show where text surges and dives; the
text between is kept. Only where the surge lies in an article or main element do element bounds replace the
surge and dive points: those of the enclosing main, or of the article and the articles beside it that
are dense too, so that short first and last lines stay.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices

WINDOW = 3
#: A window is dense from this share of the densest window's sum on.
SURGE = 0.1
#: A line counts as at most so many characters (a paragraph), so that one huge line makes no other look thin. Its text stays whole.
LINE_CAP = 400
#: Blocks that text flows through.
_FLOW = frozenset("p ul ol dl pre blockquote table figure center address details hr h1 h2 h3 h4 h5 h6 li dd dt tr tbody".split())
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_DROPPED = frozenset("aside audio button canvas datalist dialog footer form head iframe input label legend math menu nav noscript object option progress select svg template textarea title video".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3".split())
#: Elements that a new one of the same kind, or a block around them, ends.
_IMPLIED = frozenset("p li dd dt td th tr option".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements adsense sponsor sponsored promo promotion banner banners cookie cookies consent gdpr notice notices sidebar sidebars widget widgets menu menus nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead topbar comment comments disqus respond replies share sharing social related recommended newsletter subscribe signup login popup modal overlay pagination pager toolbar".split()
)
#: Words for text that is prose though not the article's; the others name parts of a layout, and often just say that a page has them.
_PROSE = frozenset("ad ads advert adverts advertisement advertisements adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices comment comments disqus respond replies".split())
LAYOUT, PROSE = 1, 2
#: Words that add nothing to those in an id.
_PLACES = frozenset("area bar block box bottom container content form inner item items left links list main outer page post posts primary right secondary section site the top wrap wrapper".split())
_ALL_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HEAD_WORDS = frozenset("header siteheader".split())
#: A tag as it should be. It holds no "<", and no part gives back what it took, so trying it at every "<" takes linear time in all.
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/<>]*+)((?:\s++[^\s\"'<>=/]++(?:\s*+=\s*+(?:\"[^\"<>]*+\"|'[^'<>]*+'|[^\s\"'<>=`]++))?+)*+\s*+/?+)>")
_TAG_START = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
_NAME = re.compile(r"[\s/]*+([^\s/>=][^\s/>=]*+|=[^\s/>=]*+)?+(\s*+=\s*+)?+")
_UNQUOTED = re.compile(r"[^\s>]*+")
#: What an unwanted element without an end tag can't hold: it ends there.
_ENDS_UNCLOSED = frozenset("article main section h1 h2 p".split())
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


def _judge(tag: str, attrs: str, in_article: bool) -> tuple[bool, int]:
    """Whether an element never holds the article, and what its class and id words vote: 0 nothing, LAYOUT or PROSE against it."""
    if tag in _DROPPED or (tag == "header" and not in_article):
        return True, 0
    vote = 0
    if not attrs or tag in ("html", "body", "article", "main"):
        return False, 0
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True, 0
        words = {w.lower() for w in _SPLIT.split(value) if w}
        if name == "role":
            if words & _ROLES:
                return True, 0
        elif name == "id" and (tag in _ALL_HEADINGS or tag == "section" and in_article or (in_article or tag == "section") and not words <= _WORDS | _PLACES):
            continue  # the name of a heading or section, as links to it use it
        elif name in ("class", "id") and (words & _WORDS or (not in_article and words & _HEAD_WORDS)):
            vote = PROSE if vote == PROSE or words & _PROSE else LAYOUT
    return False, vote


class Tag(NamedTuple):
    start: int
    after: int
    end: bool
    name: str
    attrs: str


def _attributes(page: str, at: int, last: dict[str, int]) -> int:
    """Where the attributes from ``at`` end (at a ">"), or -1 if the page ends first. Quotes hold a value only after "=", and only if
    white space, "/" or ">" follows the second one; a stray quote is part of a name or value. ``last``: the page's last quotes."""
    while True:
        m = _NAME.match(page, at)
        at = m.end()
        if at >= len(page):
            return -1
        if m[2] is None:
            if page[at] == ">":
                return at
            continue
        if (quote := page[at]) in last and at < last[quote]:
            close = page.index(quote, at + 1)
            if page[close + 1 : close + 2] in ("", " ", "\n", "\t", "\r", "\f", "/", ">"):
                at = close + 1
                continue
        at = _UNQUOTED.match(page, at).end()


def tags(page: str) -> list[Tag]:
    """A page's tags in order, comments and the like (with an empty name) and raw text elements whole; in time linear in its length."""
    found, at = [], 0
    last = {q: page.rfind(q) for q in "\"'"}
    gone: set[str] = set()  # raw elements that have no end tag any more
    while (at := page.find("<", at)) >= 0:
        start = at
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else len(page)
            found.append(Tag(start, at, False, "", ""))
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at)
            at = end + 1 if end >= 0 else len(page)
            found.append(Tag(start, at, False, "", ""))
        elif m := _TAG.match(page, at) or _TAG_START.match(page, at):
            if m.re is _TAG:
                at, attrs = m.end(), m[3]
            else:
                end = _attributes(page, m.end(), last)
                at, attrs = (end + 1, page[m.end() : end]) if end >= 0 else (len(page), "")
            name = m[2].lower()
            if name in _RAW and not m[1]:
                close = None if name in gone else re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
                if close is None:
                    gone.add(name)
                at, name = close.end() if close else len(page), ""
            found.append(Tag(start, at, bool(m[1]), name, attrs))
        else:
            at += 1
    return found


def _unclosed(found: list[Tag]) -> set[int]:
    """The start tags of unwanted elements that no end tag closes."""
    starts: dict[str, list[int]] = {}
    for i, t in enumerate(found):
        if t.name in _DROPPED or t.name == "header":
            if not t.end:
                starts.setdefault(t.name, []).append(i)
            elif starts.get(t.name):
                starts[t.name].pop()
    return {i for some in starts.values() for i in some}


class Line(NamedTuple):
    text: str
    weight: int  # its length outside links
    node: int  # the innermost block around it


#: Text, whether it is in a link, and the vote that holds for it.
Piece = tuple[str, bool, int]


class Vote(NamedTuple):
    kind: int
    around: int  # the vote around it


class Node(NamedTuple):
    tag: str
    parent: int
    region: int  # the outermost main around it, else the outermost article (0: none)
    own: int  # the outermost article inside that main (0: none)


def lines(page: str) -> tuple[list[Line], list[Node]]:
    """A page's lines in order, without those of elements voted out, and its block elements; element 0 is the page.

    An end tag ends what is open within its element; one without a start tag ends a line. An unwanted element without an
    end tag ends with its parent, or where a section, article, main, heading or paragraph starts."""
    raw: list[tuple[list[Piece], int]] = []
    nodes = [Node("", 0, 0, 0)]
    votes = [Vote(0, 0)]
    stack: list[tuple[str, bool, int, int]] = []  # tag, unwanted, the block and the vote around it
    places: dict[str, list[int]] = {}  # of each tag's open elements on the stack
    barriers: list[int] = []  # places of blocks that an implied end doesn't reach beyond
    open_ended: list[int] = []  # places of unwanted elements without an end tag
    text: list[Piece] = []
    unwanted = block = vote = 0
    mains = set()

    def flush() -> None:
        nonlocal text
        if text:
            raw.append((text, block))
            text = []

    def pop() -> None:
        nonlocal unwanted, block, vote
        tag, bad, before, voted = stack.pop()
        places[tag].pop()
        for some in (barriers, open_ended):
            if some and some[-1] == len(stack):
                some.pop()
        if tag in _BLOCKS:
            flush()
        unwanted -= bad
        block, vote = before, voted

    def last(tag: str) -> int:
        some = places.get(tag)
        return some[-1] if some else -1

    found = tags(page)
    unclosed = _unclosed(found)
    at, links = 0, 0
    for number, t in enumerate([*found, Tag(len(page), len(page), False, "", "")]):
        if t.start > at and not unwanted:
            text.append((page[at : t.start], bool(links), vote))
        at, tag = t.after, t.name
        if not tag:
            continue
        if t.end:
            if tag == "a":
                links = 0
            if (k := last(tag)) >= 0:
                while len(stack) > k:
                    pop()
            elif tag in _BLOCKS:
                flush()
            continue
        if tag == "br":
            text.append((" ", False, vote))
            continue
        if open_ended and tag in _ENDS_UNCLOSED:
            k = open_ended[0]
            while len(stack) > k:
                pop()
        if tag in _BLOCKS:
            flush()
            if tag in _IMPLIED or stack and stack[-1][0] == "p":
                k = max(last(tag), last("p"))
                if k >= 0 and k >= (barriers[-1] if barriers else -1):
                    while len(stack) > k:
                        pop()
        if tag in _VOID or t.attrs.endswith("/"):
            continue
        if tag == "a":
            links = 1
        bad, against = _judge(tag, t.attrs, nodes[block].region > 0)
        places.setdefault(tag, []).append(len(stack))
        if tag in _BLOCKS and tag not in _HEADINGS:
            barriers.append(len(stack))
        if bad and number in unclosed:
            open_ended.append(len(stack))
        stack.append((tag, bad, block, vote))
        unwanted += bad
        if against and not unwanted:
            votes.append(Vote(against, vote))
            vote = len(votes) - 1
        if tag in _BLOCKS and not unwanted:
            _, _, region, own = nodes[block]
            if tag == "main" and (not region or nodes[region].tag == "article"):
                region, own = len(nodes), 0
                mains.add(vote)
            elif tag == "article" and not region:
                region = own = len(nodes)
            elif tag == "article" and not own:
                own = len(nodes)
            nodes.append(Node(tag, block, region, own))
            block = len(nodes) - 1
    flush()
    stays = _upheld(raw, votes, mains, nodes) if len(votes) > 1 else [True]
    out = []
    for pieces, k in raw:
        kept = [p for p in pieces if stays[p[2]]]
        line = " ".join(html.unescape("".join(p[0] for p in kept)).split())
        if line:
            out.append(Line(line, max(0, len(line) - sum(len(p[0]) for p in kept if p[1])), k))
    return out, nodes


def _upheld(raw: list[tuple[list[Piece], int]], votes: list[Vote], mains: set[int], nodes: list[Node]) -> list[bool]:
    """For each vote, whether its element stays all the same, and with it all elements around it.

    A part of the layout stays if it, or what it holds, has most of the page's text or a window as dense as the
    article's, or if it holds a main. Other prose stays only if it has more than
    twice the text of all that stays, and a paragraph's at least where an article or main has text without it."""
    weights: list[dict[int, int]] = []
    for pieces, _ in raw:
        by: dict[int, int] = {}
        for p, link, v in pieces:
            if not link:
                by[v] = by.get(v, 0) + len(" ".join(p.split()))
        weights.append({v: min(w, LINE_CAP) for v, w in by.items()})
    own = [0] * len(votes)
    for by in weights:
        for v, w in by.items():
            own[v] += w
    held = own[:]
    for v in range(len(votes) - 1, 0, -1):
        held[votes[v].around] += held[v]
    stays = [True] + [False] * (len(votes) - 1)
    outside = own[0]
    in_article = any(by.get(0) and nodes[k].region for by, (_, k) in zip(weights, raw, strict=True))

    def keep(v: int) -> None:
        nonlocal outside
        while not stays[v]:
            stays[v] = True
            outside += own[v]
            v = votes[v].around

    for v in mains:
        keep(v)
    layout = [v for v in range(1, len(votes)) if votes[v].kind == LAYOUT]
    for v in layout:
        if 2 * held[v] > held[0]:
            keep(v)
    for v in sorted(range(1, len(votes)), key=lambda v: own[v] * (2 if votes[v].kind == LAYOUT else 1), reverse=True):
        if own[v] > outside if votes[v].kind == LAYOUT else own[v] > 2 * outside and (own[v] >= LINE_CAP or not in_article):
            keep(v)
    in_prose = [False] * len(votes)
    for v in range(1, len(votes)):
        in_prose[v] = votes[v].kind == PROSE or in_prose[votes[v].around]
    sums = window_sums([sum(w for v, w in by.items() if not in_prose[v] or stays[v]) for by in weights])
    least = max(sums, default=0)
    best = dict.fromkeys(layout, 0)
    for i in range(len(weights)):
        near: dict[int, int] = {}
        for by in weights[i : i + WINDOW]:
            for v, w in by.items():
                near[v] = near.get(v, 0) + w
        for v, w in near.items():
            if v in best:
                best[v] = max(best[v], w)
    for v in layout:
        if best[v] and (best[v] >= least or best[v] >= max(LINE_CAP, least / 2)):
            keep(v)
    return stays


def window_sums(weights: list[int], window: int = WINDOW) -> list[int]:
    capped = [min(w, LINE_CAP) for w in weights]
    return [sum(capped[i : i + window]) for i in range(len(capped))]


def surge_and_dive(weights: list[int], window: int = WINDOW) -> tuple[int, int]:
    """The lines (first, one past last) from the first dense window to the end of the last, with all that is between."""
    sums = window_sums(weights, window)
    if not sums or not max(sums):
        return 0, 0
    least = SURGE * max(sums)
    dense = [i for i, x in enumerate(sums) if x >= least]
    a, b = dense[0], dense[-1]
    while a < b and not weights[a]:
        a += 1
    return a, b + 1


def _beside(rows: list[Line], nodes: list[Node], at: int, step: int) -> int:
    """The farthest mostly unlinked line before (step -1) or after (1) ``at`` that flows in the same element as it."""
    found, own = at, rows[at].node
    around = nodes[own].parent
    while nodes[around].tag in _FLOW:
        own, around = around, nodes[around].parent
    i = at + step
    while 0 <= i < len(rows):
        k = rows[i].node
        while k and k != around and nodes[k].parent != around and nodes[k].tag in _FLOW:
            k = nodes[k].parent
        if k != around and (nodes[k].parent != around or nodes[k].tag not in _FLOW and nodes[k].tag != nodes[own].tag or nodes[own].tag not in _FLOW):
            break
        if 2 * rows[i].weight >= len(rows[i].text):
            found = i
        i += step
    return found


def _in_elements(rows: list[Line], nodes: list[Node], dense: list[bool], region: int) -> list[str]:
    """The lines of a main, or of an article and the dense articles with the same parent; articles in them without a dense line stay out."""
    full = {nodes[r.node].own for r, d in zip(rows, dense, strict=True) if d}
    if nodes[region].tag == "main":
        return [r.text for r in rows if nodes[r.node].region == region and (not nodes[r.node].own or nodes[r.node].own in full)]
    parts = {region} | {k for k in full if k and nodes[k].region == k and nodes[k].parent == nodes[region].parent}
    inside = [i for i, r in enumerate(rows) if nodes[r.node].region in parts]
    return [r.text for r in rows[inside[0] : inside[-1] + 1] if nodes[r.node].region in parts or not nodes[r.node].region and (r.weight or nodes[r.node].tag in _HEADINGS)]


def main_text(page: str | None) -> str:
    """The article of a page: its blocks joined by newlines; empty if none.

    The densest window decides. Articles with less than half as much text as the rest of the page are teasers
    unless they hold that window: they neither begin nor end the text."""
    rows, nodes = lines(page or "")
    weights = [min(r.weight, LINE_CAP) for r in rows]
    sums = window_sums(weights)
    if not sums or not max(sums):
        return ""
    top = max(range(len(sums)), key=sums.__getitem__)
    near = range(top, min(top + WINDOW, len(rows)))
    region = nodes[rows[max(near, key=weights.__getitem__)].node].region
    if 2 * sum(weights[i] for i in near if nodes[rows[i].node].region == region) <= sum(weights[i] for i in near):
        region = 0
    inside = sum(w for r, w in zip(rows, weights, strict=True) if nodes[r.node].region)
    minor = 2 * inside < sum(weights) - inside
    if region and not minor:
        least = SURGE * sums[top]
        # a line is dense with its window's lines of the same element
        dense = [sum(weights[j] for j in range(i, min(i + WINDOW, len(rows))) if nodes[rows[j].node].own == nodes[r.node].own) >= least for i, r in enumerate(rows)]
        return "\n".join(_in_elements(rows, nodes, dense, region))
    first, last = surge_and_dive([0 if minor and nodes[r.node].region not in (0, region) else r.weight for r in rows])
    first, last = _beside(rows, nodes, first, -1), _beside(rows, nodes, last - 1, 1) + 1
    while first > 0 and nodes[rows[first - 1].node].tag in _HEADINGS and not (minor and nodes[rows[first - 1].node].region):
        first -= 1
    return "\n".join(r.text for r in rows[first:last])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([main_text(x) for x in batch.column("html").to_pylist()], pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text (empty if none), n_chars (code points).

    Null html counts as empty; null ids and urls stay; repeated rows each get their text; of windows that are equally dense the first
    decides; very long pages take time linear in their length; an empty table gives no rows; other columns are ignored."""
    bounded_batches(pages.sparkSession)
    d = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return d.mapInArrow(_extracted, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
