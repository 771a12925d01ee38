import html
import random
import re

import pytest

from ledgerlens.llm import htmltext
from ledgerlens.llm.htmltext import default_weights, extract_pages, is_mark, labelled_pages, main_text, read_blocks


def plain(page):
    """Brute force for the driver's layout: the article's blocks."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
    return "\n".join(b for b in blocks if b)


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    rows = extract_pages(pages).collect()
    assert {r.page_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)


WORDS, BODY = ("word " * 30).strip(), "\n".join([("body " * 30).strip()] * 3)
BODY_HTML = "".join(f"<p>{x}</p>" for x in BODY.split("\n"))
CASES = {
    "": "",
    "<": "<",
    "<!-- open": "",
    "<script>only code": "",
    "<nav>Home About</nav><p>one two &lt;b&gt; three&nbsp;four</p>": "one two <b> three four",
    "<article><h1>T</h1><p>hello world it is</p><div class='ad'>buy now</div><p>the end</p><section id=comments><p>first!</p></section></article>": "T\nhello world it is\nthe end",
    "<header>Site</header><article><p>a <b>b</b> c<br>d e</p></article><aside>more</aside><footer>&copy;</footer>": "a b c d e",
    "<div><ul><li><a href=/>Home</a></li></ul></div><div>" + "word " * 40 + "</div><div>Copyright us</div>": ("word " * 40).strip(),
    "<article><p>AT&ampT &am x</p><form>name</form><div role='alert'>note this</div></article>": "AT&T &am x",
    "<body class='has-sidebar nav-open'><div class='layout no-sidebar'><div class='site-header'>Site name here</div><article><div class='entry-header'><h1>T</h1></div><p>hello my world</p></article></div>": "T\nhello my world",
    "<div class='sidebar-layout'><article><p>all of it is inside here</p></article></div>": "all of it is inside here",
    "<article><style>p{}</style><p>x<!-- gone -->y</p></article>": "xy",
    # Short blocks of the article stay, whatever stands between them.
    f"<article><h1>Review</h1><div class='share'>Share Tweet</div><div class='ad'>buy it now</div><p>{WORDS}</p></article>": f"Review\n{WORDS}",
    f"<article><p>{WORDS}</p><aside>more here and there</aside><div class=ad>buy buy</div><p>Fin.</p></article>": f"{WORDS}\nFin.",
    # A mark counts as a whole class, not as a part of one.
    "<article><p>First one.</p><p class='form-text'>Second here</p><div class='related-work'>Third part</div></article>": "First one.\nSecond here\nThird part",
    "<article><p>a one</p><div class='share-buttons'>x</div><div class='ad-slot-3'>y</div><div class='post-footer'>z</div><p>b two</p></article>": "a one\nb two",
    # What is cut out stays out, also where nothing else is left.
    "<div class=comments><p>I like it a lot, it is really good</p></div>": "",
    "<nav><ul><li>Home</ul></nav><footer>Copyright</footer>": "",
    "<p class=ad>buy<p>real text": "real text",
    "<ul><li>one<li>two<li class=ad>three<li>four</ul>": "one\ntwo\nfour",
    "<table><tr><td>a one<td>b two<tr><td>c three</table>": "a one\nb two\nc three",
    # A teaser beside a long body, and beside a long article.
    f"<article><h3><a href=x>Teaser head</a></h3><p>small teaser</p></article><div>{BODY_HTML}</div>": BODY,
    f"<article>{BODY_HTML}</article><article><h2><a href=x>More</a></h2><p>teaser text</p></article>": BODY,
    # An article's header with a heading is its headline, any other header goes.
    "<article><header><h1>Head</h1><p>By me</p></header><p>text body of it</p></article>": "Head\nBy me\ntext body of it",
    "<article><header>Site menu</header><p>text body of it</p></article>": "text body of it",
    "<header><h1>Site</h1></header><article><p>text body of it</p></article>": "text body of it",
    f"<div id=page><div><a href=/>Home</a> <a href=/>News</a></div><div><h1>T</h1>{BODY_HTML}<p>Fin.</p></div><div>Copyright us</div></div>": f"T\n{BODY}\nFin.",
    "<form id=aspnet><article><p>whole page here</p><form>ask</form></article></form>": "whole page here",
    "<article><p>a<span class=ad>X</span>b c</p></article>": "a b c",
    "<article><p><b>bold start<p>next one</b> tail<p>third</article><footer>x</footer>": "bold start\nnext one tail\nthird",
    f"<main><h1>Title</h1><article><p>{WORDS}</p></article></main>": f"Title\n{WORDS}",
}


@pytest.mark.parametrize("page", CASES)
def test_cases(page):
    assert main_text(page) == CASES[page]


def test_words_positive_tags_negative():
    w = default_weights()
    assert w["word:article:prose:long"] > w["word:article:link"] and all((v > 0) == k.startswith("word") for k, v in w.items())


def test_marks():
    assert all(map(is_mark, ["ad", "cookie-banner", "ad_unit_300", "site-footer", "comments-area", "article-comments", "nav-links", "page-sidebar", "share__list"]))
    assert not any(map(is_mark, ["address", "form-text", "related-work", "has-sidebar", "nav-open", "article", "post-content", "entry-header", "header", "no-comment", "download"]))


def test_linear_scan_is_the_best_of_all_regions():
    """Brute force over all regions of generated pages."""
    weights = default_weights()
    for pieces in labelled_pages(60, seed=77):
        blocks, _ = read_blocks("".join(p for p, _ in pieces))
        score = lambda tags: sum(weights.get(t, htmltext.TAG_BOUNDS[1]) for _, t in tags)
        own = [b.words * weights.get(b.word_class(), htmltext.WORD_BOUNDS[0]) + score(b.inline) for b in blocks]
        gaps = [score(b.gap) for b in blocks]
        sums = {(lo, hi): sum(own[lo:hi]) + sum(gaps[lo + 1 : hi]) for lo in range(len(blocks)) for hi in range(lo + 1, len(blocks) + 1)}
        lo, hi = htmltext.best_region(blocks, weights)
        assert abs(sums[lo, hi] - max(sums.values())) < 1e-6


def soup(rng):
    """A page of plain divisions, and its content; nothing tells them apart but words and tags."""
    text = lambda lo, hi: " ".join("x" * rng.randint(1, 8) for _ in range(rng.randint(lo, hi)))
    links = "".join(f"<li><a href=#>{text(1, 3)}</a></li>" for _ in range(rng.randint(4, 10)))
    blocks = [text(2, 8), *[text(20, 60) for _ in range(rng.randint(3, 8))], text(1, 3)]
    content = "<h2>%s</h2>" % blocks[0] + "".join(f"<p>{b}</p>" for b in blocks[1:])
    side = rng.choice([f"<div><h4>{text(1, 2)}</h4><ul>{links}</ul></div>", f"<table><tr><td><a href=#>{text(1, 3)}</a></td></tr></table>", ""])
    page = f"<body><div><div><ul>{links}</ul></div><div>{text(1, 3)}</div><div class=c>{content}</div>{side}<div>{text(1, 4)}</div></div></body>"
    return page, "\n".join(blocks)


def test_the_scan_finds_the_content_of_unmarked_pages():
    rng = random.Random(9)
    pages = [soup(rng) for _ in range(300)]
    whole = lambda page: "\n".join(b.text for b in read_blocks(page)[0])
    right = [main_text(page) == text for page, text in pages]
    assert sum(right) >= 0.97 * len(pages) and not any(whole(page) == text for page, text in pages)


def test_broken_markup_is_linear():
    for page in ("<p>" * 50_000, "<a b='" * 20_000, "<" * 50_000, "<div class=\"" * 20_000, "<b><div>" * 20_000 + "</b>" * 20_000, "<div><p>x y" * 20_000, "<table><tr><td>x" * 9_000, "<span class=ad>" * 20_000 + "x"):
        main_text(page)


def test_edges(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    df = spark.createDataFrame([(1, None, None, "x", "y"), (None, "u", "", "x", "y"), (1, None, None, "x", "y"), (2, "v", "<p>" + "a b " * 400_000 + "</p>", "x", "y")], schema)
    rows = extract_pages(df).collect()
    assert len(rows) == 4 and sorted(r.n_chars for r in rows) == [0, 0, 0, 400_000 * 4 - 1]
    assert extract_pages(df.limit(0)).collect() == []
