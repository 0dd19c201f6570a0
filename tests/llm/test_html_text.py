import math

import pytest

from threadlake.llm import html_text as H

LONG = "A long paragraph of the article that goes on for quite a while, with many words in it. "
PAGES = [
    ("", ""), (None, ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a b"), ("<html><body></body></html>", ""),
    ("<body><nav><a href=/>Home</a></nav><article><h1>T</h1><p>x&nbsp;y \n z</p><p>é &lt;b&gt;</p></article><footer>f</footer></body>", "T x y z é <b>"),
    (f"<div class=content><p>{LONG}</p><p>{LONG}</p><div class='comments'><p>reader {LONG}</p></div></div><div id=sidebar><a href=x>{LONG}</a></div>", f"{LONG.strip()} {LONG.strip()}"),
    (f"<main><h2>T</h2><p>{LONG}</p><form>go <input></form><ul><li>one<li>two</ul></main><script>var a='<p>';</script>", f"T {LONG.strip()} one two"),
    (f"<article>{LONG}<br>three<table><tr><td>c1<td>c2</table><aside>no</aside><div class='ad'>buy</div></article>", f"{LONG.strip()} three c1 c2"),
    (f"<body><header><h1>Site</h1></header><div><p>{LONG}</p><!-- <p>hidden</p> --><p hidden>no</p></div><div role=contentinfo>(c)</div>", LONG.strip()),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_extract(page, text):
    assert H.extract(page) == text


def test_very_long_and_broken_pages():
    assert H.extract("<" * 20000).startswith("<<<") and H.extract("<a " * 20000)
    deep = "<div>" * 3000 + "core" + "</div>" * 3000
    assert H.extract(deep) == "core"
    assert H.extract("<p>" + "w " * 100000) == "w " * 99999 + "w"


def test_report(spark):
    pages = spark.createDataFrame([(k, f"u{k}", p, "kept") for k, (p, _) in enumerate(PAGES)], "page_id long, url string, html string, _html string")
    got = {r.page_id: r for r in H.report(pages).collect()}
    assert {k: r.text for k, r in got.items()} == {k: t for k, (_, t) in enumerate(PAGES)} and all(r.n_chars == len(r.text) for r in got.values())
    assert H.main_text(pages).columns == ["page_id", "url", "_html", "text"] and H.report(pages.limit(0)).count() == 0


def test_layout_wrappers_are_kept_and_what_they_are_named_after_is_not():
    from threadlake.llm import html_text

    body = "".join(f"<p>Sentence number {k} of the article, which is long enough to count as text.</p>" for k in range(8))
    comment = "<div class='comments'><article class='comment'><p>" + "I say so too. " * 90 + "</p></article></div>"
    for name in ("class='container has-sidebar'", "class='content-sidebar'", "class='layout sidebar-right'", "id='page-widget-area'"):
        for inner in (f"<article>{body}</article>{comment}", f"<main>{body}</main>{comment}", body):
            got = html_text.extract(f"<html><body><nav>Home</nav><div {name}>{inner}</div><div class='sidebar'><p>Other news</p></div></body></html>")
            assert "number 0" in got and "number 7" in got and "I say so" not in got and "Other news" not in got
    assert "x plus y" in html_text.extract(f"<body><article>{body}<p><math><mi>x plus y</mi></math></p></article></body>")


NAMES = ["post has-sidebar", "content no-comments", "elementor-widget elementor-widget-text-editor", "entry-content social", "nav-on", "col ad-free", "related-work", "share price"]


@pytest.mark.parametrize("name", NAMES)
def test_names_that_only_hold_a_word_of_furniture(name):
    text = f"{LONG.strip()} {LONG.strip()}"
    both = f"<p>{LONG}</p><p>{LONG}</p>"
    for attribute in ("class", "id"):
        assert H.extract(f"<div {attribute}='{name}'>{both}</div>") == text
        assert H.extract(f"<body><article>{both}<section {attribute}='{name}'><p>{LONG}</p></section></article></body>") == f"{text} {LONG.strip()}"


@pytest.mark.parametrize("name", ["comments", "user-comments", "ad", "sidebar widget", "site-footer", "cookie-notice", "share-buttons", "related", "main-menu", "newsletter-signup"])
def test_furniture_by_name(name):
    assert H.extract(f"<body><div><p>{LONG}</p><p>{LONG}</p><div class='{name}'>Follow us on <a href=x>this site</a></div><p>{LONG}</p></div></body>") == " ".join([LONG.strip()] * 3)


def by_definition(node):
    """(characters, tags, link characters, link tags) below a node, counted down the tree each time."""
    kids = [c for c in node.children if not isinstance(c, str) and not c.drop]
    own = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
    below = [by_definition(c) for c in kids]
    chars = own + sum(b[0] for b in below)
    return chars, sum(1 + b[1] for b in below), chars if node.tag == "a" else sum(b[2] for b in below), sum((c.tag == "a") + b[3] for c, b in zip(kids, below, strict=True))


def composite(node, share):
    chars, tags, links, link_tags = by_definition(node)
    if not chars:
        return 0.0
    base = math.log(math.log(chars / max(1, chars - links) * links + share * chars + math.e) + math.e - 1)
    return chars / max(1, tags) * math.log(max(1 + 1e-9, chars / max(1, links) * max(1, tags) / max(1, link_tags))) / base


def test_densities_and_choice_match_their_definition(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()] + [p for p, _ in PAGES if p]
    for page in pages:
        root = H.parse(page)
        body = H.measure(root)
        chars, _, links, _ = by_definition(body)
        nodes = H._in_order(body)
        densities = {x: composite(x, links / max(1, chars)) for x in nodes}
        for x in nodes:
            assert x.density == pytest.approx(densities[x])
            assert x.sum == pytest.approx(sum(densities[c] for c in x.children if c in densities))
        # the taken subtree holds, or lies in, the one of the largest sum above the threshold of the densest node's path
        densest = max(nodes, key=densities.get)
        path = [densest]
        while path[-1] is not body:
            path.append(path[-1].parent)
        least = min(densities[x] for x in path)
        best = max((x for x in nodes if densities[x] >= least and x.chars and (x.tag in H.CONTAINERS or x is body)), key=lambda x: x.sum, default=body)
        taken = H.main_node(root)
        assert best in H._in_order(taken) or taken in H._in_order(best)


def test_sections_of_one_article_and_repeated_rows(spark):
    sections = "".join(f"<section><h2>Part {k}</h2>{f'<p>{LONG}</p>' * k}</section>" for k in (1, 4, 2))
    page = f"<body><div class=teaser><p>Short teaser</p></div><div><h1>Title</h1>{sections}</div></body>"
    want = " ".join(["Title", "Part 1", LONG.strip(), "Part 4", *[LONG.strip()] * 4, "Part 2", *[LONG.strip()] * 2])
    assert H.extract(page) == want
    rows = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.n_chars) for r in H.report(rows).collect()) == [(1, len(want)), (1, len(want)), (2, 0)]


HEADING_IDS = ["login", "cookies", "pagination", "navigation", "comments", "copyright", "menu", "modals", "consent", "subscribe", "notices", "search", "alerts"]


@pytest.mark.parametrize("name", HEADING_IDS)
def test_ids_made_from_headings_drop_nothing(name):
    text = LONG.strip()
    for page in (
        f"<body><article><p>{LONG}</p><h2 id='{name}'>About it</h2><p>{LONG}</p></article></body>",
        f"<body><article><p>{LONG}</p><section id='{name}'><h2>About it</h2><p>{LONG}</p></section></article></body>",
        f"<body><article><p>{LONG}</p><h2 class='{name}'>About it</h2><p>{LONG}</p></article></body>",
        f"<body><div><p>{LONG}</p><section id='{name}'><h2>About it</h2><p>{LONG}</p></section></div></body>",
        f"<body><article><p>{LONG}</p><p><b id='{name}' class='{name}'>About it</b></p><p>{LONG}</p></article></body>",
    ):
        assert H.extract(page) == f"{text} About it {text}", page


def test_ids_with_the_shape_of_furniture():
    text = LONG.strip()
    for inner in ("<form>your name <input></form><p>Write us</p>", "<div class='comment'>so true</div><div class='comment'>indeed</div>", "<p><a href=x>older</a> <a href=y>newer</a></p>"):
        for name in ("comments", "pagination", "newsletter-signup"):
            assert H.extract(f"<body><article><p>{LONG}</p><p>{LONG}</p><div id='{name}'>{inner}</div></article></body>") == f"{text} {text}"
    assert H.extract(f"<body><article><p>{LONG}</p></article><div id='sidebar'><p>Other news of the day</p></div></body>") == text


def test_labels_in_a_line_stay():
    assert H.extract(f"<article><p>{LONG}</p><p>Press <label>Enter</label> now.</p></article>") == f"{LONG.strip()} Press Enter now."


@pytest.mark.parametrize("name", ["ad" + "1" * 10000 + "x", "1" * 10000, "-" * 10000, "ad-1" * 5000, "post" * 5000, "site-" * 5000 + "x", "comment" * 5 + "x"])
def test_names_end_whatever_they_hold(name):
    import time

    began = time.perf_counter()
    for attribute in ("class", "id"):
        assert LONG.strip() in H.extract(f"<div><p {attribute}='{name}'>{LONG}</p><p>{LONG}</p></div>")
    assert time.perf_counter() - began < 0.5


def test_names_by_words():
    yes = ["ad", "Ads", "ad1", "ad-300", "adslot", "ad_unit_2", "side-bar", "sidebar-left", "site-footer", "mainmenu", "page-footer-inner", "post-comments", "comment-list", "cookie-consent-banner", "user_login_form", "newsletter-signup", "disqus_thread", "skip-link", "nav-menu"]
    no = ["has-sidebar", "no-comments", "advice", "address", "navigator-study", "main", "post", "list", "container", "download", "nav-on", "ad-free", "", "header", "content-sidebar", "site"]
    assert [n for n in yes if not H._furniture_name(n, H.SURE)] == [] and [n for n in no if H._furniture_name(n, H.SURE)] == []
