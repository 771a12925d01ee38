"""Main text of web pages by a maximum-scoring subsequence.

A page is read as a sequence of words and tags. Boilerplate elements (menus, page
headers, footers, sidebars, notices, adverts, forms, comments, scripts) are cut out of
the sequence; what stays is grouped in blocks. Every word scores its block's class's
weight (positive), every tag its class's (negative); the weights are log odds counted on
labelled pages. One linear scan finds the contiguous run of blocks with the greatest
sum (the first of equal ones).

That region says where the content is; whole elements say where it ends:

* Where at least half of its words stand in ``<article>`` (or ``<main>``) elements, the text
  is all of those elements, however short their blocks, and of the region around them
  only what stands in ``<main>``. Beside a far longer one, a touched article is a teaser.
* Else articles are teasers too: they are cut out, the scan runs again, and the region
  grows over the neighbouring paragraphs of the element that holds it.

Labelled pages come from ``labelled_pages``: a seeded generator of small pages in
many layouts whose pieces are known to be content or not. Nothing is read from the
table to be extracted.

Elements are boilerplate by name, or by a class, id or role that is exactly such a word
or made of such words alone (``ad-slot``, not ``form-text``). A ``<header>`` inside an
article or main that holds a heading is the article's headline and stays; any other
header goes. A ``<form>`` around an article is a wrapper and stays.

Edge cases: null or empty html, or a page of boilerplate only: empty text. Broken
markup is read to the end: unclosed tags, comments and references never raise, and end
tags that HTML implies (of ``p``, ``li``, ``dd``, ``tr``, ``td``, ``option``) are implied. ``<br>`` is
white space inside its block. Pages are read whole at any length, in linear time.
Repeated rows count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as htmllib
import math
import random
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import arrow_pass

# Element names of the HTML standard by their role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template textarea title iframe svg object xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav footer aside form button select fieldset dialog menu search head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p li td th dd dt pre blockquote figcaption caption summary".split())
LISTS = frozenset("ul ol li dl dt dd".split())
#: Elements that are parts of the one around them.
PARTS_OF = HEADINGS | PROSE | frozenset("tr tbody thead tfoot a".split())
INLINE = frozenset("b i em strong span u small sub sup code mark font abbr cite q".split())
#: Start tags that end an open element of these names, within the nearest element of the last set.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
IMPLIED: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tr": (frozenset({"td", "th", "tr"}), frozenset({"tbody", "thead", "tfoot", "table"})),
    "option": (frozenset({"option"}), frozenset({"select", "optgroup"})),
}
#: Words that mark an element as boilerplate where they are a whole class, id or role.
MARKS = frozenset(
    "ad ads adbox advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert alerts alertdialog dialog popup modal overlay toast newsletter subscribe subscription signup login sidebar "
    "widget widgets menu menubar nav navbar navigation topnav breadcrumb breadcrumbs pagination pager share sharing social socials comment comments "
    "respond discussion disqus related recommended recommendations footer masthead toolbar topbar contentinfo complementary search searchbox form".split()
)
#: Words that a mark may be joined to (``share-buttons``, ``site-footer``) and still be one.
JOINED = frozenset(
    "area bar block blocks body box btn button buttons card cards container content feed group inner item items label link links list "
    "module outer panel placeholder posts row section slot stories strip thread title top bottom left right unit wrap wrapper zone "
    "articles articlelist icons site page main global primary secondary mobile desktop sticky fixed header policy the".split()
)
#: Words of which a joined mark speaks of the article's own parts (``post-footer``, ``article-comments``).
OWN_PARTS = frozenset("article post entry story".split())
OWN_MARKS = frozenset("footer sidebar comments comment share sharing social related nav navigation ad ads".split())
#: Words that name a page's header; inside an article a header is told by its headings.
HEADERS = (frozenset({"header"}), frozenset("site page main global top mobile sticky fixed wrap wrapper container inner".split()))
#: Wrappers of whole pages; their marks tell of the layout, not of their content.
WHOLE = frozenset("html body main article".split())
#: A touched article with fewer words than this share of the longest is a teaser.
TEASER = 0.25
#: Words from which a block counts as of medium and as of great length.
MEDIUM, LONG = 5, 15

_TOKEN = regex.compile(
    r"<!--(?:.*?--!?>|.*+)"
    r"|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|$)",
    regex.S,
)
_MARKED = regex.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", regex.I)
_PARTS = regex.compile(r"[a-z]+|[0-9]+")
_RAW_END = {name: regex.compile(rf"</{name}(?=[\s/>])[^>]*+>?", regex.I) for name in RAW}
_HEADER_END = regex.compile(r"</header[\s/>]|<(h[1-6])[\s/>]", regex.I)
_FORM_END = regex.compile(r"</form[\s/>]|<(article|main)[\s/>]", regex.I)


def is_mark(token: str) -> bool:
    """Whether a class, id or role speaks of boilerplate: a mark, or marks joined to plain words of layout."""
    words = [w for w in _PARTS.findall(token.lower()) if not w.isdigit()]
    marks = [w for w in words if w in MARKS]
    if not marks:
        return len(words) > 1 and set(words) <= HEADERS[0] | HEADERS[1] and "header" in words
    rest = {w for w in words if w not in MARKS}
    return rest <= JOINED or (rest <= OWN_PARTS and any(w in OWN_MARKS for w in marks))


def _is_boilerplate(page: str, end: int, name: str, attrs: str, in_article: bool) -> bool:
    """Whether the element that starts here (its tag ends at ``end``) is cut out."""
    if name == "header":
        return not (in_article and (m := _HEADER_END.search(page, end)) and m[1])
    if name == "form":
        return not ((m := _FORM_END.search(page, end)) and m[1])
    if name in BOILERPLATE:
        return True
    if not attrs or name in WHOLE and (name != "article" or not in_article):
        return False
    for m in _MARKED.finditer(attrs):
        for token in (m[1] or m[2] or m[3] or "").lower().split():
            if is_mark(token) or token == "header" and not in_article:
                return True
    return False


class Block:
    """A run of text between block boundaries."""

    __slots__ = ("article", "element", "gap", "inline", "kind", "links", "main", "offset", "text", "words")

    def __init__(self, offset: int, kind: str, element: int, article: int, main: int, gap: list) -> None:
        self.offset, self.kind, self.element, self.article, self.main, self.gap = offset, kind, element, article, main, gap
        self.text, self.inline, self.words, self.links = "", [], 0, 0

    def word_class(self) -> str:
        zone = "article" if self.article >= 0 else "main" if self.main >= 0 else "body"
        if 2 * self.links >= self.words:
            return f"word:{zone}:link"
        return f"word:{zone}:{self.kind}:" + ("long" if self.words >= LONG else "medium" if self.words >= MEDIUM else "short")


class Elements:
    """All elements in the order of their start tags: names, parents and the last element inside each."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.parents: list[int] = []
        self.last: list[int] = []

    def add(self, name: str, parent: int) -> int:
        self.names.append(name)
        self.parents.append(parent)
        return len(self.names) - 1

    def close(self) -> None:
        self.last = list(range(len(self.names)))
        for i in range(len(self.names) - 1, -1, -1):
            if (p := self.parents[i]) >= 0 and self.last[p] < self.last[i]:
                self.last[p] = self.last[i]

    def holds(self, element: int, lo: int, hi: int) -> bool:
        return element < 0 or element <= lo and hi <= self.last[element]


class _OpenElements:
    """The stack of open elements, with what the reader asks of it at hand."""

    def __init__(self) -> None:
        self.names: list[str] = []  # "" where an inline element ended before the blocks inside it
        self.cut: list[int] = []
        self.numbers: list[int] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.headings = self.prose = self.links = self.cutting = 0
        self.articles: list[int] = []
        self.mains: list[int] = []

    def push(self, name: str, cut: int, number: int) -> None:
        place = len(self.names)
        self.names.append(name)
        self.cut.append(cut)
        self.numbers.append(number)
        self.places.setdefault(name, []).append(place)
        if name in BLOCKS:
            self.blocks.append(place)
        self.cutting += cut
        self._count(name, 1)
        if not self.cutting and name in ("article", "main"):
            (self.articles if name == "article" else self.mains).append(number)

    def _count(self, name: str, n: int) -> None:
        self.headings += n * (name in HEADINGS)
        self.prose += n * (name in PROSE)
        self.links += n * (name == "a")

    def drop(self, place: int) -> None:
        """End the element at ``place`` alone."""
        name = self.names[place]
        self.names[place] = ""
        self.places[name].pop()
        self.cutting -= self.cut[place]
        self.cut[place] = 0
        self._count(name, -1)

    def pop_to(self, place: int) -> None:
        while len(self.names) > place:
            at = len(self.names) - 1
            if self.names[at]:
                self.drop(at)
            if self.blocks and self.blocks[-1] == at:
                self.blocks.pop()
            number = self.numbers.pop()
            for kept in (self.articles, self.mains):
                if kept and kept[-1] == number:
                    kept.pop()
            self.names.pop()
            self.cut.pop()

    def innermost(self, name: str) -> int:
        own = self.places.get(name)
        return own[-1] if own else -1

    def within(self, wanted: frozenset[str], border: frozenset[str]) -> int:
        """Place of the innermost open element of ``wanted`` inside the innermost of ``border``; -1 without."""
        edge = max(map(self.innermost, border))
        return max((p for p in map(self.innermost, wanted) if p > edge), default=-1)


def _tag_class(name: str) -> str:
    if name in LISTS:
        return "tag:list"
    if name in BLOCKS:
        return "tag:block"
    return "tag:link" if name == "a" else "tag:inline" if name in INLINE else "tag:br" if name == "br" else "tag:other"


def read_blocks(page: str) -> tuple[list[Block], Elements]:
    """The page's blocks in order, without boilerplate, and its elements."""
    open_, elements = _OpenElements(), Elements()
    blocks: list[Block] = []
    parts: list[str] = []
    link_parts: list[str] = []
    block: Block | None = None
    gap: list[tuple[int, str]] = []

    def close_block() -> None:
        nonlocal block, gap
        if block is not None:
            words = "".join(parts).split()
            if words:
                block.text, block.words, block.links = " ".join(words), len(words), len("".join(link_parts).split())
                blocks.append(block)
            else:
                gap = block.gap + block.inline + gap
            block = None
            parts.clear()
            link_parts.clear()

    def count_tag(offset: int, name: str) -> None:
        (gap if block is None else block.inline).append((offset, _tag_class(name)))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at and not open_.cutting:
            raw = page[at:end]
            if block is None and not raw.isspace():
                kind = "heading" if open_.headings else "prose" if open_.prose else "bare"
                article, main = open_.articles[0] if open_.articles else -1, open_.mains[0] if open_.mains else -1
                block, gap = Block(at, kind, open_.numbers[-1] if open_.numbers else -1, article, main, gap), []
            if block is not None:
                text = htmllib.unescape(raw) if "&" in raw else raw
                parts.append(text)
                if open_.links:
                    link_parts.append(text + " ")
        if m is None:
            break
        at = max(m.end(), end + 1)
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, is_block = bool(m[1] or m[4]), name in BLOCKS
        if is_block and not open_.cutting:
            close_block()
        attrs = m[3] or m[6] or ""
        if name in RAW:
            if not closing and not attrs.rstrip().endswith("/"):
                stop = _RAW_END[name].search(page, at)
                at = stop.end() if stop else n
            continue
        if closing:
            if not open_.cutting:
                count_tag(end, name)
            if (place := open_.innermost(name)) >= 0:
                if is_block or not open_.blocks or open_.blocks[-1] < place:
                    open_.pop_to(place)
                else:  # an inline end tag doesn't end the blocks inside its element
                    open_.drop(place)
            continue
        if name in VOID:
            if not open_.cutting:
                count_tag(end, name)
                if name == "br" and block is not None:
                    parts.append(" ")
                    link_parts.append(" ")
            continue
        if name in CLOSES_P and (place := open_.innermost("p")) >= 0 and open_.blocks[-1] == place:
            open_.pop_to(place)
        elif name in IMPLIED:
            while (place := open_.within(*IMPLIED[name])) >= 0:
                open_.pop_to(place)
        cut = not open_.cutting and _is_boilerplate(page, at, name, attrs, bool(open_.articles or open_.mains))
        if cut and not is_block and block is not None:
            parts.append(" ")
        if not cut and not open_.cutting:
            count_tag(end, name)
        open_.push(name, int(cut), elements.add(name, open_.numbers[-1] if open_.numbers else -1))
    close_block()
    elements.close()
    return blocks, elements


def labelled_pages(n: int = 600, seed: int = 5) -> list[list[tuple[str, bool]]]:
    """Generated pages as lists of (piece of html, whether it is content)."""
    rng = random.Random(seed)

    def prose(lo: int, hi: int) -> str:
        return " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(lo, hi)))

    def links(tag: str, lo: int, hi: int) -> str:
        return "".join(f'<{tag}><a href="/{i}">{prose(1, 4)}</a></{tag}>' for i in range(rng.randint(lo, hi)))

    pages = []
    for _ in range(n):
        menu = rng.choice([f"<nav><ul>{links('li', 3, 9)}</ul></nav>", f"<div><ul>{links('li', 3, 9)}</ul></div>", f"<table><tr>{links('td', 2, 6)}</tr></table>", f"<div>{links('span', 3, 8)}</div>", f"<div><h3>{prose(1, 2)}</h3><ul>{links('li', 3, 9)}</ul></div>", ""])
        before = [
            f"<html><head><title>{prose(3, 8)}</title><script>var a='{prose(2, 9)}'</script></head><body>",
            rng.choice(["", "<div>"]) + menu,
            rng.choice([f'<div class="ad">{prose(4, 20)}</div>', f"<div>{prose(1, 6)}</div>", f"<p>{prose(1, 4)}</p>", ""]),
            rng.choice([f"<header><h1>{prose(2, 4)}</h1></header>", f"<div><a>{prose(1, 3)}</a></div>", f"<h2><a>{prose(1, 3)}</a></h2>", ""]),
        ]
        paragraphs = [f"<p>{prose(10, 90) if rng.random() < 0.85 else prose(1, 9)}</p>" for _ in range(rng.randint(2, 9))]
        if rng.random() < 0.3:
            paragraphs.insert(1, f'<p>{prose(5, 30)} <a href="x">{prose(1, 4)}</a> {prose(5, 30)}</p>')
        if rng.random() < 0.3:
            paragraphs.insert(1, f"<ul><li>{prose(4, 20)}</li><li>{prose(4, 20)}</li></ul>")
        if rng.random() < 0.3:
            paragraphs.insert(1, f"<h2>{prose(1, 6)}</h2>")
        if rng.random() < 0.2:
            paragraphs.insert(1, f"<blockquote><em>{prose(4, 30)}</em></blockquote>")
        if rng.random() < 0.3:
            paragraphs.insert(1, f"<aside>{prose(3, 20)}</aside>")
        if rng.random() < 0.3:  # prose without paragraph elements
            paragraphs = [f"<div>{prose(15, 90)}</div>" if rng.random() < 0.5 else f"{prose(15, 90)}<br><br>" for _ in paragraphs]
        body = rng.choice([f"<h1>{prose(1, 9)}</h1>", f"<header><h1>{prose(1, 9)}</h1></header>", ""]) + "".join(paragraphs)
        wrap = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ("<div>", "</div>"), ("<div><div>", "</div></div>"), ("", "")])
        side = f"<h3>{prose(1, 3)}</h3>" if rng.random() < 0.7 else ""
        after = [
            rng.choice([f"<div>{side}<ul>{links('li', 2, 8)}</ul></div>", f"<div>{side}<p>{prose(1, 4)}</p></div>", f"<div>{side}<div>{prose(1, 6)}</div></div>", ""]),
            rng.choice([f'<section id="comments"><p>{prose(5, 40)}</p></section>', f"<div>{prose(1, 6)}</div>", f"<ul>{links('li', 2, 8)}</ul>", f"<article><h3><a>{prose(2, 8)}</a></h3></article>", ""]),
            rng.choice([f"<footer>{prose(4, 15)}</footer>", f"<div><a>{prose(1, 3)}</a> <a>{prose(1, 3)}</a></div>", f"<p>{prose(2, 4)}</p>", f"<div>{prose(2, 9)}</div>"]),
            "</body></html>",
        ]
        pages.append([*((x, False) for x in before), (wrap[0] + body + wrap[1], True), *((x, False) for x in after)])
    return pages


#: Bounds of the weights: words score positive, tags negative.
WORD_BOUNDS, TAG_BOUNDS = (0.1, 3.0), (-3.0, -0.3)


def fit_weights(pages: list[list[tuple[str, bool]]]) -> dict[str, float]:
    """Log odds of content for each class of words and tags, within their bounds."""
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    for pieces in pages:
        page = "".join(p for p, _ in pieces)
        good = bytearray()
        for piece, content in pieces:
            good += bytes([content]) * len(piece)
        for block in read_blocks(page)[0]:
            (inside if good[block.offset] else outside)[block.word_class()] += block.words
            for offset, kind in block.gap + block.inline:
                (inside if good[offset] else outside)[kind] += 1
    weights = {}
    for kind in {*inside, *outside}:
        odds = math.log((inside[kind] + 1) / (outside[kind] + 1))
        lo, hi = WORD_BOUNDS if kind.startswith("word") else TAG_BOUNDS
        weights[kind] = max(lo, min(hi, odds))
    return weights


_weights: dict[str, float] = {}


def default_weights() -> dict[str, float]:
    if not _weights:
        _weights.update(fit_weights(labelled_pages()))
    return _weights


def best_region(blocks: list[Block], weights: dict[str, float]) -> tuple[int, int]:
    """(first, end) of the contiguous blocks with the greatest sum of word and tag scores."""
    best, lo, hi, total, begin = 0.0, 0, 0, 0.0, 0
    for i, block in enumerate(blocks):
        total += sum(weights.get(kind, TAG_BOUNDS[1]) for _, kind in block.gap)
        if total <= 0:
            total, begin = 0.0, i
        total += block.words * weights.get(block.word_class(), WORD_BOUNDS[0]) + sum(weights.get(kind, TAG_BOUNDS[1]) for _, kind in block.inline)
        if total > best:
            best, lo, hi = total, begin, i + 1
    return lo, hi


def _grown(blocks: list[Block], elements: Elements, lo: int, hi: int) -> tuple[int, int]:
    """The region with the neighbouring paragraphs of the innermost element that holds all of it."""
    own = [b.element for b in blocks[lo:hi]]
    first, last, holder = min(own), max(own), blocks[lo].element
    while not elements.holds(holder, first, last):
        holder = elements.parents[holder]

    def joins(i: int) -> bool:
        block = blocks[i]
        return block.kind != "bare" and 2 * block.links < block.words and elements.holds(holder, block.element, block.element)

    # From a paragraph to what is around it, and from a cell or an item to its whole table or list.
    while holder >= 0 and (elements.names[holder] in PARTS_OF or elements.names[holder] in INLINE):
        holder = elements.parents[holder]
    if holder >= 0 and elements.names[holder] not in ("html", "body"):
        while lo > 0 and joins(lo - 1):
            lo -= 1
        while hi < len(blocks) and joins(hi):
            hi += 1
    return lo, hi


def main_blocks(page: str, weights: dict[str, float]) -> list[Block]:
    """The blocks of the page's main text."""
    blocks, elements = read_blocks(page)
    lo, hi = best_region(blocks, weights)
    region = blocks[lo:hi]
    inside = sum(b.words for b in region if b.article >= 0 or b.main >= 0)
    if 2 * inside >= sum(b.words for b in region):
        of_article: Counter[int] = Counter()
        for b in blocks:
            if b.article >= 0:
                of_article[b.article] += b.words
        touched = {b.article for b in region if b.article >= 0}
        longest = max((of_article[a] for a in touched), default=0)
        touched = {a for a in touched if of_article[a] >= TEASER * longest}
        mains = set() if touched else {b.main for b in region if b.main >= 0}
        # Of main's parts beside its articles those count that the scan found.
        own = lambda i, b: b.article in touched if b.article >= 0 else b.main >= 0 and (b.main in mains or lo <= i < hi)
        return [b for i, b in enumerate(blocks) if own(i, b)]
    plain = [b for b in blocks if b.article < 0]
    lo, hi = best_region(plain, weights)
    if lo < hi:
        lo, hi = _grown(plain, elements, lo, hi)
    return plain[lo:hi]


def main_text(page: str | None, weights: dict[str, float] | None = None) -> str:
    """The page's main text: blocks joined by a line end, white space in them single."""
    return "\n".join(b.text for b in main_blocks(page, weights or default_weights())) if page else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row; one pass, no shuffle."""
    weights = default_weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = [main_text(x.as_py(), weights) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return arrow_pass(rows, run, "page_id long, url string, text string, n_chars long")
