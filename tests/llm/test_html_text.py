import random
import time

from gridwatch.llm import html_text as H

PARA = "A long enough paragraph with several words in it, so that it weighs more than a menu does."
PAGES = {
    f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>x</a></li></ul></nav><!-- ad --><div class=\"ad\">buy</div><article><h1>Head &amp; line</h1><p><b>{PARA}<br><p>Short.</p><p>a  \n b&nbsp;c &lt;x&gt; &eacute;</p></article><footer>&copy; me</footer></body></html>": f"Head & line\n{PARA}\nShort.\na b c <x> é",
    f"<body><header>Site</header><div id='cookie-notice'>We use cookies on this site to give you the best of all.</div><main><h2>Q</h2><p>{PARA}</p><form><p>Name</p></form><ul><li>one<li>two</ul><div class='comments'><p>{PARA} said a reader</p></div><aside>{PARA}</aside></main>": f"Q\n{PARA}\none\ntwo",
    f"<div class='menu'><a href=a>A</a></div><div><h1>No article</h1><p>{PARA}</p><p>{PARA}</p><p>{PARA}</p></div><div><a href='b'>Link one</a></div>": f"No article\n{PARA}\n{PARA}\n{PARA}",
    f"<article><p>{PARA}</p><p>cut off &am": f"{PARA}\ncut off &am",
    f"<article><p>{PARA}</p><p": PARA,
    "": "",
    "<nav>only a menu</nav>": "",
}


def test_pages():
    for page, want in PAGES.items():
        assert H.main_text(page) == want, page


def test_operator(spark):
    rows = [(i, f"u{i}", p, "x") for i, p in enumerate(PAGES)] + [(None, None, None, "y"), (0, "u0", next(iter(PAGES)), "x")]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = [*PAGES.values(), "", next(iter(PAGES.values()))]
    assert sorted((r.text, r.n_chars) for r in got) == sorted((t, len(t)) for t in want)
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_long_page_in_one_line():
    assert H.main_text("<article><p>" + "word " * 200_000 + "</p></article>") == ("word " * 200_000).strip()


def test_surge_and_dive():
    assert H.surge_and_dive([1, 0, 0, 0, 90, 80, 5, 100, 0, 0, 0, 0, 2]) == (4, 8)
    assert H.surge_and_dive([]) == (0, 0) == H.surge_and_dive([0, 0])


def test_the_surge_picks_the_elements():
    body = "".join(f"<p>{PARA} {PARA} {i}</p>" for i in range(4))
    text = "\n".join(f"{PARA} {PARA} {i}" for i in range(4))
    teaser = f"<article><h2>Teaser</h2><p>{PARA} {PARA}</p></article>"
    assert H.main_text(f"<body><div><h1>T</h1>{body}</div>{teaser}</body>") == f"T\n{text}"
    assert H.main_text(f"<body>{teaser}<div><h1>T</h1>{body}</div></body>") == f"T\n{text}"
    assert H.main_text(f"<main><h1>T</h1><p>lead</p><article>{body}</article><p>end</p></main>") == f"T\nlead\n{text}\nend"
    parts = f"<div><article><h2>One</h2>{body}</article><article><h2>Two</h2>{body}<p>end</p></article></div>"
    assert H.main_text(parts) == f"One\n{text}\nTwo\n{text}\nend"
    assert H.main_text(f"<main><article>{body}</article><article><a href=x>Other</a></article></main>") == text


def plain(*texts):
    """A page without article or main: a menu, the texts as paragraphs (lists as lists) of a div, and links."""
    inner = "".join("<ul>" + "".join(f"<li>{y}</li>" for y in t) + "</ul>" if isinstance(t, list) else f"<p>{t}</p>" for t in texts)
    return f"<body><div><a href=a>Home</a></div><div>{inner}</div><div><a href=b>Next page</a></div><div>(c) me</div></body>"


def test_all_dense_runs_stay():
    long = f"{PARA} {PARA} {PARA} {PARA}"
    for texts in (
        [long, long, long, ["one", "two", "three", "four", "five"], long, long],
        [long, long, ("word " * 10_000).strip(), long, long],
        [long, long, "The end."],
        ["By a writer", "Paris", "Monday", "Noon", long, long, "Bye.", "A", "B", "C", "D"],
        [long, ["one", "two"], ["a", "b", "c"]],
    ):
        assert H.main_text(plain(*texts)) == "\n".join(y for t in texts for y in (t if isinstance(t, list) else [t])), texts


def test_words_only_vote():
    long = f"{PARA} {PARA} {PARA} {PARA}"
    menu, ad, comments = "<div class='main-menu'><a href=a>Home</a> you are here</div>", f"<div class='ad'>{PARA}</div>", f"<div id='comments'><h3>2 comments</h3><div class='comment'>{long}</div><div class='comment'>{long} {long}</div></div>"
    for name in ("content-sidebar-wrap", "no-sidebar", "nav-open", "with-menu", "no-sidebar with-menu ad-free"):
        page = f"<body>{menu}<div class='{name}'><h1>T</h1><p>{long}</p>{ad}<p>{long}</p><div class='sidebar'>{PARA}</div></div>{comments}<div class='site-footer'>About us</div></body>"
        assert H.main_text(page) == f"T\n{long}\n{long}", name
        assert H.main_text(f"<div id='{name}'><div class='nav-open'><h1>T</h1><p>{PARA}</p></div></div><div class='footer'>About us</div>") == f"T\n{PARA}", name
    named = f"<section id='related-work'><h2>Related work</h2><p>{PARA}</p></section><h2 id='social-effects'>Social effects</h2><div id='menu-planning'><p>{PARA}</p></div><section id='comments'><p>short</p></section>"
    assert H.main_text(f"<article><p>{long}</p>{named}{ad}<div id='related-posts'>See this</div></article>") == f"{long}\nRelated work\n{PARA}\nSocial effects\n{PARA}\nshort"
    assert H.main_text(f"<div><p>{long}</p><section id='related-work'><p>{PARA}</p></section><h2 id='social-effects'>Social effects</h2><p>{long}</p></div>") == f"{long}\n{PARA}\nSocial effects\n{long}"


def test_broken_markup():
    two = f"{PARA}\n{PARA}"
    assert H.main_text(f"<body><div class='content no-sidebar'><p>{PARA}</p><p>{PARA}</p></div></body>") == two
    assert H.main_text(f"<body><nav><a href=x>Home</a><article><p>{PARA}</p><p>{PARA}</p></article></body>") == two  # a menu that nothing ends
    assert H.main_text(f"<body><nav><ul><li><a href=x>Home</a></ul><p>{PARA}</p><p>{PARA}</p></body>") == two
    assert H.main_text(f"<body><aside><article><p>{PARA}</p></article></aside><article><p>{PARA} own</p><p>{PARA}</p></article></body>") == f"{PARA} own\n{PARA}"
    assert H.main_text(f'<article><p class=x">{PARA}</p><p>{PARA}</p></article>') == two  # stray quotes
    assert H.main_text(f'<article><p class="x>{PARA}</p><p title="a">{PARA}</p></article>') == two
    assert H.main_text(f"<article><p title='a > b' data-x=\"<b>\">{PARA}</p><p>1 < 2 <3 a<b</p><p>{PARA}</p></article>") == f"{PARA}\n1 < 2 <3 a\n{PARA}"
    assert H.main_text(f"<article><p>{PARA}</p></span></b><p>{PARA}</p></div></article></body>") == two
    assert H.main_text(f"<article><p>{PARA}</p><!-- > never ends <p>{PARA}</p>") == PARA == H.main_text(f"<article><p>{PARA}</p><script>never ends</p>{PARA}")


def test_time_is_linear():
    for piece, end in (("<a ", ""), ("<a href='", ""), ("<a x=\"'\" y='", ">"), ("<div>", "</span></p></b>" * 30_000), ("<i>", "<li></li>" * 30_000), ("<p><b>", ""), ("<script>", "<!--" * 30_000), ("<nav><p>", ""), ("<div class='ad'>x", "")):
        began = time.process_time()
        H.main_text(piece * 30_000 + end + PARA)
        assert time.process_time() - began < 8, piece  # quadratic work took over a minute


def test_window_sums_and_points_match_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        w = [rng.choice([0, 0, 3, 20, 90, 400, 5000]) for _ in range(rng.randint(1, 30))]
        sums = [sum(min(x, H.LINE_CAP) for x in w[i : i + H.WINDOW]) for i in range(len(w))]
        assert H.window_sums(w) == sums
        dense = [i for i in range(len(w)) if sums[i] >= H.SURGE * max(sums)] if max(sums) else []
        want = (next(i for i in range(dense[0], len(w)) if w[i] or i == dense[-1]), dense[-1] + 1) if dense else (0, 0)
        assert H.surge_and_dive(w) == want


def test_plain_pages_by_windows_alone():
    """No article or main: the points alone find the text between menu lines and link lists."""
    rng = random.Random(12)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    text = lambda low, high: " ".join(rng.choices(words, k=rng.randint(low, high))) + "."
    links = lambda n: "<ul>" + "".join(f"<li><a href='/{i}'>{text(1, 3)}</a></li>" for i in range(n)) + "</ul>"
    for _ in range(100):
        blocks = [("h1", text(3, 8))]
        for _ in range(rng.randint(3, 12)):
            kind = rng.choice(["p", "p", "p", "h2", "ul"])
            blocks += [("p", text(40, 160))] if kind == "p" else [("h2", text(2, 5)), ("p", text(40, 160))] if kind == "h2" else [("ul", [text(1, 9) for _ in range(rng.randint(1, 5))])]
        blocks.append(("p", text(30, 90)))
        inner = "".join(f"<{k}>" + (b if k != "ul" else "".join(f"<li>{x}" for x in b)) + f"</{k}>" for k, b in blocks)
        page = f"<html><head><title>{text(2, 4)}</title></head><body><div>{links(rng.randint(2, 8))}</div><div>{inner}</div><div>{links(rng.randint(1, 9))}</div></body></html>"
        assert H.main_text(page) == "\n".join(y for k, b in blocks for y in (b if k == "ul" else [b])), page
