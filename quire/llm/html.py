"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut at block tags into flat blocks. A block is told by its words and link density
and by those of its neighbours, by whether it ends as a sentence does, is a heading or a list
item, and by weak hints: what tags, roles and names (classes, ids) of the regions around it
tell of. A name counts by any of its parts, unless it is a phrase (notice-of-death) or the part
stands behind one that tells of layout or topic (has-sidebar); a name of boilerplate counts for nothing on
a region that holds the page's main element or top heading, however many words that region has. A decision tree, grown
from a small labelled table of blocks (``labelled_pages``: every site with each of six articles),
keeps or drops each block. Time and memory are in proportion to the page, however deep its tags are nested.

Scripts, styles and text that is never shown (also inline) is in no block, nor are inline
adverts. Character references are decoded once, white space inside a block becomes one
space, kept blocks are joined in page order by a line break. Nothing kept is shortened.

Defined results. Null and empty pages, and pages of no main block: an empty text. Tags that
are left open, links too, end with what encloses them; a page may end anywhere. Repeated rows are read
one by one. An empty table gives no rows. All asked-for columns are kept; the result is a
column whose name gets a number if it is taken.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.plans.staging import fresh

HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas select option textarea audio video map datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr img br input nobr acronym".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Hints that tags and roles give.
BOILER_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
CONTENT_ROLES = frozenset(("main", "article"))
#: Hints that names give: a class or id that is such a word, or has one as a part ("site-footer", "comment_body", "gdprCookieNotice").
AD_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion".split())
BOILER_NAMES = AD_NAMES | frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comment comments commentlist respond reply replies discussion disqus cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended trending widget widgets "
    "pagination pager toolbar topbar copyright legal disclaimer toc skip search".split()
)
#: Names that tell of boilerplate outside content only: an article has a header of its own.
HEAD_NAMES = frozenset("header masthead banner".split())
CONTENT_NAMES = frozenset("article content post entry story maintext hentry".split())
#: Parts after which a name tells of a page's layout or a text's topic, not of what is in the element.
LAYOUT_PARTS = frozenset("has with no is without category tag type status format".split())
#: Parts that make a name a phrase.
PHRASE_PARTS = frozenset("of the and for in to a on about".split())

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "sentence", "heading", "listed", "boiler", "content", "nearest")


#: Ends of a sentence, before closing quotes and brackets; the hint of elements that are not shown.
SENTENCE_ENDS = tuple(".!?\u2026:;\u3002\uff01\uff1f")
HIDE = -2


class Region:
    """An open element and what it stands in: what its tag and names hint at, whether it wraps a page's main part."""

    def __init__(self, tag: str, by_tag: int, by_name: int, parent: Region | None):
        self.tag, self.by_tag, self.by_name, self.parent, self.wraps = tag, by_tag, by_name, parent, False
        self.inside = bool(parent and parent.inside) or by_tag > 0 or by_name > 0

    def settle(self) -> None:
        """Work out the hints of all regions around, those of the parent being worked out."""
        p, name = self.parent, 0 if self.wraps and self.by_name < 0 else self.by_name
        side = -1 if -1 in (self.by_tag, name) else max(self.by_tag, name)
        self.tag_told = self.by_tag < 0 or bool(p and p.tag_told)
        self.name_told = name < 0 or bool(p and p.name_told)
        self.content = side > 0 or bool(p and p.content)
        self.nearest = side or (p.nearest if p else 0)
        self.heading = self.tag in HEADINGS or bool(p and p.heading)
        self.listed = self.tag == "li" or bool(p and p.listed)


def names_of(told: dict) -> set[str]:
    """Name words of class and id."""
    found = set()
    for name in f"{told.get('class') or ''} {told.get('id') or ''}".split():
        parts = [x for x in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if x]
        if PHRASE_PARTS & set(parts[:-1]):
            continue
        layout = next((k for k, x in enumerate(parts[:-1]) if x in LAYOUT_PARTS), len(parts))
        found.update(parts[:layout])
    return found


def unseen(told: dict) -> bool:
    style = (told.get("style") or "").replace(" ", "").lower()
    return "hidden" in told or "display:none" in style or "visibility:hidden" in style


class Blocks(HTMLParser):
    """Flat blocks of a page: text, words, words in links, and the region that they stand in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.regions: list[Region] = []  # all, each after the one that it stands in
        self.open: list[Region] = []
        self.counts: Counter[str] = Counter()  # open regions of each tag
        self.unseen: list[tuple[str, int]] = []  # open inline elements that are not shown or adverts: tag, open regions
        self.hidden = 0
        self.link: int | None = None  # open regions where the open link began
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[dict] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            words = len(text.split())
            ends = text.rstrip("\"'\u201d\u2019\u00bb)")[-1:] in SENTENCE_ENDS
            self.blocks.append({"text": text, "words": words, "linked": min(words, self.linked), "region": self.open[-1] if self.open else None, "sentence": int(ends)})
        self.parts, self.linked = [], 0

    def _region(self, tag: str, told: dict) -> Region:
        parent = self.open[-1] if self.open else None
        if tag in ("html", "body"):
            return Region(tag, 0, 0, parent)
        names, role = names_of(told), (told.get("role") or "").lower()
        inside = bool(parent and parent.inside)
        by_tag = -1 if tag in BOILER_TAGS or role in BOILER_ROLES or told.get("aria-hidden") == "true" or (tag == "header" and not inside and not names & CONTENT_NAMES) else int(tag in CONTENT_TAGS or role in CONTENT_ROLES)
        by_name = -1 if names & BOILER_NAMES else int(bool(names & CONTENT_NAMES)) or -int(bool(names & HEAD_NAMES) and not inside)
        if tag in ("main", "h1") or role == "main":
            # Those around a marked region are marked already.
            around = parent
            while around and not around.wraps:
                around.wraps, around = True, around.parent
        return Region(tag, by_tag, by_name, parent)

    def handle_starttag(self, tag, attrs):
        told = dict(attrs)
        if tag in VOID or tag in INLINE:
            if tag in ("br", "hr", "img", "input"):
                self.parts.append(" ")
            if tag not in INLINE:
                self.flush()
            if tag not in VOID and (self.unseen and self.unseen[-1][0] == tag or unseen(told) or names_of(told) & AD_NAMES):
                self.unseen.append((tag, len(self.open)))
            if tag == "a":
                self.link = len(self.open)
            return
        self.flush()
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", *HEADINGS):
            self._close(tag, siblings=True)
        region = self._region(tag, told)
        self.open.append(region)
        self.regions.append(region)
        self.counts[tag] += 1
        if tag in HIDDEN or unseen(told):
            region.by_tag = HIDE
            self.hidden += 1

    def _close(self, tag: str, siblings: bool = False) -> None:
        """End the innermost open tag of this name and all within it; a paragraph left open ends where the next starts."""
        if not self.counts[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                for r in self.open[k:]:
                    self.hidden -= r.by_tag == HIDE
                    self.counts[r.tag] -= 1
                del self.open[k:]
                # Links and inline elements left open end with the element that they stand in.
                while self.unseen and self.unseen[-1][1] > k:
                    self.unseen.pop()
                if self.link is not None and self.link > k:
                    self.link = None
                return
            if siblings and self.open[k].tag != "p":
                return

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = None
        if tag in INLINE:
            if self.unseen and self.unseen[-1][0] == tag:
                self.unseen.pop()
        elif tag not in VOID:
            self.flush()
            self._close(tag)

    def handle_data(self, data):
        if not self.hidden and not self.unseen:
            self.parts.append(data)
            if self.link is not None:
                self.linked += len(data.split())


def blocks_of(html: str | None) -> list[dict]:
    """The blocks of a page with the hints of their regions."""
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    for r in parser.regions:
        r.settle()
    for b in parser.blocks:
        r = b.pop("region")
        b["boiler"] = 2 * r.tag_told or int(r.name_told) if r else 0
        for hint in ("content", "nearest", "heading", "listed"):
            b[hint] = int(getattr(r, hint)) if r else 0
    return parser.blocks


def features(blocks: list[dict]) -> np.ndarray:
    """A row of FEATURES for each block; beyond the page's ends there are no words."""
    n = len(blocks)
    if not n:
        return np.zeros((0, len(FEATURES)))
    words = np.array([b["words"] for b in blocks], float)
    links = np.array([b["linked"] / b["words"] for b in blocks])
    around = [np.concatenate(p) for p in (([0.0], words[:-1]), ([0.0], links[:-1]), (words[1:], [0.0]), (links[1:], [0.0]))]
    own = [np.array([b[f] for b in blocks], float) for f in FEATURES[6:]]
    return np.column_stack((words, links, *around, *own))


class Tree:
    """A decision tree by Gini impurity; ties go to the earlier feature and the lower threshold."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 4):
        self.label = bool(2 * y.sum() > len(y))
        self.feature = None
        if depth == 0 or y.all() or not y.any():
            return
        best = (1e-12, None, None)
        gini = lambda v: len(v) * 2 * v.mean() * (1 - v.mean()) if len(v) else 0.0
        whole = gini(y)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for t in (values[1:] + values[:-1]) / 2:
                low = x[:, f] <= t
                if least <= low.sum() <= len(y) - least and (gain := whole - gini(y[low]) - gini(y[~low])) > best[0] + 1e-12:
                    best = (gain, f, t)
        if best[1] is not None:
            _, self.feature, self.at = best
            low = x[:, self.feature] <= self.at
            self.low, self.high = Tree(x[low], y[low], depth - 1, least), Tree(x[~low], y[~low], depth - 1, least)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.label)
        out = np.empty(len(x), bool)
        low = x[:, self.feature] <= self.at
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


#: Texts that fill the labelled table: paragraphs, sentences, short sentences, names and titles.
LONG = [
    "The committee met in the old town hall and after a long debate agreed to repair the bridge before the winter, since the river had risen twice and the road to the mill was closed for a week each time.",
    "Der Rat der Stadt hat am Abend beschlossen, die alte Br\u00fccke noch vor dem Winter zu erneuern, weil der Fluss im vergangenen Jahr zweimal \u00fcber die Ufer getreten war und niemand mehr zur M\u00fchle kam.",
    "Les habitants du village ont attendu toute la journ\u00e9e sur la place, mais le maire n'est arriv\u00e9 que tard dans la soir\u00e9e pour expliquer pourquoi le pont resterait ferm\u00e9 jusqu'au printemps.",
    "She had kept the letters in a drawer for thirty years. Nobody knew of them until the house was sold; then the new owner found the key, read the first lines, and drove to the coast to give them back.",
]
MID = ["Nobody had expected so many visitors on the first day.", "El r\u00edo creci\u00f3 otra vez y nadie pudo cruzar el puente.", "The second attempt, made in spring, went better than the first one.", "We use what we have and ask for nothing more than a little time."]
SHORT = ["So it was.", "He agreed.", "Nadie lo sab\u00eda.", "Yes."]
NAME = ["Home", "About us.", "The town paper", "Contact", "Older posts", "Ten bridges you must see!", "Sport", "Log in", "News.", "and,", "Weather: rain."]
TITLE = ["The bridge is repaired", "Aftermath", "Visitors in the valley", "What now?", "A letter from the coast", "Die Br\u00fccke", "What the river took"]

#: Articles: a line that starts with + is main text, one with - is not. Each line is a block's HTML, or tags alone.
ARTICLES = [
    ["+<h1>{T}</h1>", "+<p>{L}</p>", "+<p>{S}</p>", "+<p>{L} {M}</p>", "+<p>{M}</p>"],
    ["+<h1>{T}</h1>", "+<p>{M}</p>", "+<ul><li>{M}</li>", "+<li>{N}</li>", '+<li><a href="/s">{M}</a></li></ul>', "+<p>{L}</p>", "+<blockquote>{L}</blockquote>", "+<p>{S}</p>"],
    ["+<h2>{T}</h2>", '+<p>{M} <a href="/x">{N}</a> {L}</p>', "+<p>{L} {L}</p>", '+<p><a href="/map">{T}</a></p>', "+<h3>{T}</h3>", "+<p>{L}</p>"],
    ["+<h1>{T}</h1>", "+<p>{L}</p>", '-<div class="related"><a href="/r">{N}</a></div>', "+<p>{M} {M}</p>", "-<aside>{M}</aside>", "+<p>{L}</p>", '-<div class="newsletter">{M}</div>', "+<p>{S}</p>"],
    ["+<h1>{T}</h1>", "+<p>{L}</p>", "+<table><tr><td>{N}</td>", "+<td>12</td></tr>", "+<tr><td>{N}</td>", "+<td>7</td></tr></table>", "+<p>{L}</p>", '+<p class="body-text notice-of-death">{M}</p>', "+<p>{L}</p>"],
    ['+<div class="entry-header"><h1>{T}</h1></div>', "+<p>{S}</p>", "+<p>{L}</p>", '-<div class="share-links"><a href="/f">{N}</a></div>', "+<p>{L} {M} {L}</p>"],
]
#: Sites: lines before the article, its wrapper's tags, and lines after it.
SITES = [
    (['-<nav><ul><li><a href="/">{N}</a></li>', '-<li><a href="/a">{N}</a></li>', '-<li><a href="/b">{N}</a></li></ul></nav>', '-<div class="ad">{M}</div>'], "<article>", "</article>", ["-<footer>&copy; {N} &middot; {M}</footer>"]),
    (["-<header><div>{N}</div>", '-<a href="/in">{N}</a></header>', '-<div class="cookie-notice">{M} {M}</div>'], "<main>", "</main>", ['-<section id="comments"><h3>{N}</h3>', "-<p>{L}</p>", "-<p>{S}</p></section>", "-<form><label>{N}</label></form>", '-<div role="contentinfo">{N}</div>']),
    (['-<div><a href="/1">{N}</a> <a href="/2">{N}</a> <a href="/3">{N}</a></div>'], "<div>", "</div>", ['-<p><a href="/4">{N}</a></p>', '-<div><a href="/5">{N}</a> <a href="/6">{N}</a> <a href="/7">{N}</a></div>']),
    (['-<div class="site-header"><a href="/">{N}</a></div>'], '<div class="site has-sidebar"><div class="post-content">', "</div></div>", ['-<div class="comments"><div class="comment-content"><p>{L}</p>', "-<p>{M}</p></div></div>", '-<div class="sidebar"><p>{L}</p>', '-<ul><li><a href="/r">{N}</a></li></ul></div>', '-<div role="alert">{M}</div>']),
    (["-<header><h1>{N}</h1></header>", '-<div class="notice">{L}</div>'], '<article class="post"><header>', "</article>", ['-<aside class="promo">{L}</aside>', '-<nav><a href="/8">{T}</a></nav>', '-<div id="comments"><p>{M}</p></div>', "-<footer><p>{L}</p></footer>"]),
    (['-<table><tr><td><a href="/1">{N}</a></td>', '-<td><a href="/2">{N}</a></td></tr></table>'], "", "", ['-<p><a href="/3">{N}</a> <a href="/4">{N}</a></p>']),
    ([], "", "", []),
    ([], "<article>", "</article>", []),
    ([], "<div>", "</div>", ['-<p><a href="/b">{N}</a></p>']),
    (['-<p><a href="/b">{N}</a></p>'], '<div class="story">', "</div>", []),
    (['-<ul><li><a href="/1">{N}</a></li>', '-<li><a href="/2">{N}</a></li>', '-<li><a href="/3">{N}</a></li></ul>'], "<section>", "</section>", ['-<ul><li><a href="/9">{T}</a></li>', '-<li><a href="/10">{T}</a></li></ul>', '-<div>&copy; <a href="/11">{N}</a></div>']),
    (['-<div id="masthead"><a href="/">{N}</a>', '-<form><input name="q"> {N}</form></div>', '-<div class="breadcrumbs"><a href="/">{N}</a> / <a href="/n">{N}</a></div>'], '<div id="content"><div class="story">', "</div></div>", ['-<div class="tags"><a href="/t">{N}</a> <a href="/u">{N}</a></div>', '-<div class="related"><h3>{N}</h3>', '-<p><a href="/x">{T}</a></p>', '-<p><a href="/y">{T}</a></p></div>', '-<div id="footer">{M} <a href="/p">{N}</a></div>']),
    (['-<div class="popup">{M} {M}</div>', '-<div class="menu"><a href="/1">{N}</a> <a href="/2">{N}</a></div>'], '<div role="main">', "</div>", ['-<div class="author-box"><a href="/me">{N}</a></div>', '-<div class="disqus"><p>{M}</p>', "-<p>{L}</p></div>", '-<div class="copyright">{M}</div>']),
    (['-<p><a href="/">{N}</a></p>'], "<div><div>", "</div></div>", ['-<p><a href="/next">{N}</a></p>', '-<p><a href="/prev">{T}</a></p>']),
    (['-<div class="top-bar"><a href="/">{N}</a> <a href="/l">{N}</a></div>', '-<div class="sponsored">{L}</div>'], '<article><div class="entry">', "</div></article>", ['-<section class="comments"><article class="comment"><p>{L}</p></article>', '-<article class="comment"><p>{S}</p></article></section>', '-<div class="legal"><a href="/c">{N}</a> {M}</div>']),
    (['-<div class="social"><a href="/f">{N}</a> <a href="/g">{N}</a></div>'], '<div class="hentry">', "</div>", ['-<ol class="commentlist"><li><p>{M}</p></li>', "-<li><p>{L}</p></li></ol>", '-<div id="respond">{N}</div>', '-<aside><a href="/z">{N}</a></aside>']),
    ([*[f'-<li><a href="/{k}">{{N}}</a></li>' for k in range(8)], "-<div>{N}</div>"], "<div>", "</div>", [*[f'-<li><a href="/{k}">{{T}}</a></li>' for k in range(8)], '-<p>{N} &middot; <a href="/i">{N}</a></p>']),
    ([*[f'-<td><a href="/{k}">{{N}}</a></td>' for k in range(6)]], "<center>", "</center>", ['-<p><a href="/b">{N}</a></p>', *[f'-<td><a href="/{k}">{{N}} {{N}}</a></td>' for k in range(6)]]),
    (['-<dl><dt><a href="/d">{T}</a></dt>', *[f'-<dd><a href="/{k}">{{N}}</a> {{N}}</dd>' for k in range(5)], "+</dl>"], "<div><section>", "</section></div>", [*[f'-<p><a href="/{k}">{{T}}</a>, <a href="/q{k}">{{N}}</a></p>' for k in range(6)], "-<div>{N}</div>"]),
    (['-<div class="cookie-consent-banner">{M} {L}</div>'], "<div>", "</div>", ["-<h3>{N}</h3>", '-<ul><li><a href="/1">{T}</a></li>', '-<li><a href="/2">{T}</a></li></ul>', '-<div class="wp-block-latest-comments"><p>{L}</p>', "-<p>{L}</p>", "-<p>{S}</p>", "-<p>{L} {L}</p>", "-<p>{M}</p></div>"]),
    (['-<div class="top-ad-slot">{L}</div>', "-<h4>{N}</h4>", '-<p><a href="/1">{N}</a> <a href="/2">{N}</a></p>'], '<div class="page-sidebar-wrap"><main>', "</main></div>", ["-<h2>{N}</h2>", '-<li><a href="/1">{T}</a></li>', '-<li><a href="/2">{N}</a></li>', '-<div class="gdpr-notice-box"><p>{L}</p>', "-<p>{L}</p></div>"]),
    (['-<div><a href="/l">{N}</a></div>', *[f'-<li><a href="/{k}">{{N}}</a></li>' for k in range(5)]], "<div>", "</div>", ['-<div><a href="/m">{N}</a> {N} <a href="/n">{N}</a></div>', *[f'-<li><a href="/{k}">{{T}}</a></li>' for k in range(7)]]),
]


def labelled_pages() -> list[list[str]]:
    """The labelled table: every site with every article, filled with the texts in turn."""
    pages, turn = [], 0
    for before, opening, closing, after in SITES:
        for article in ARTICLES:
            lines = [*before, f"+{opening}", *article, f"+{closing}", *after]
            if opening.endswith("<header>"):  # the header of an article holds its title
                lines = [*before, f"+{opening}", article[0], "+</header>", *article[1:], f"+{closing}", *after]
            for k, line in enumerate(lines):
                for mark, texts in (("{L}", LONG), ("{M}", MID), ("{S}", SHORT), ("{N}", NAME), ("{T}", TITLE)):
                    while mark in line:
                        line, turn = line.replace(mark, texts[turn % len(texts)], 1), turn + 1
                lines[k] = line
            pages.append(lines)
    return pages


def rows_of_page(page: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a labelled page's blocks; a line may hold several blocks or none, all have its label."""
    blocks = blocks_of("".join(line[1:] for line in page))
    marks = [line[0] == "+" for line in page for _ in blocks_of(line[1:])]
    if len(marks) != len(blocks):
        raise ValueError("a labelled line does not end its block")
    return features(blocks), np.array(marks)


def train(labelled: list[list[str]] | None = None) -> Tree:
    """A tree from the labelled table."""
    rows = [rows_of_page(p) for p in (labelled_pages() if labelled is None else labelled)]
    return Tree(np.concatenate([x for x, _ in rows]), np.concatenate([y for _, y in rows]))


def main_text(html: str | None, tree: Tree) -> str:
    blocks = blocks_of(html)
    kept = tree.predict(features(blocks))
    return "\n".join(b["text"] for b, k in zip(blocks, kept, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None, name: str = "main_text") -> tuple[DataFrame, str]:
    """The pages (columns keep, or all) with their main text, and the text's column name."""
    name = fresh(pages.columns, name)
    kept = pages.columns if keep is None else keep
    base = pages.select(*dict.fromkeys([*kept, html_col]))
    tree = train()

    def run(batches):
        for batch in batches:
            texts = pa.array([main_text(h, tree) for h in batch.column(html_col).to_pylist()], pa.string())
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, texts], names=[*kept, name])

    return base.mapInArrow(run, T.StructType([*[base.schema[c] for c in kept], T.StructField(name, T.StringType())])), name


def op2_html(spark, sf_dir: str) -> DataFrame:
    from quire.plans.tables import table

    found, at = extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", F.col(at).alias("text"), F.length(at).cast("long").alias("n_chars"))
