"""Main text of web pages by two passes of block rules.

A page is cut into blocks at its block elements. First pass: a block in a menu, header, footer, sidebar,
notice, advert, form or comment section (by element, role, or class and id words) is boilerplate, as is
one that is mostly links; a block of running text, told by the share of stop words and its length, is
content; short blocks and others that the rules cannot tell are ambiguous. Second pass: an ambiguous
block inherits the label of its nearest decided neighbour. Where the page marks its article (article or
main element, or an element named as content), blocks outside are boilerplate and the edges of the
article are decided neighbours, too: content on the inside.

Pages are parsed one by one inside Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A shorter block is ambiguous, a longer one of running text is content by itself; between them it is nearly so.
SHORT, LONG = 70, 200
#: Least share of stop words in running text; under ``NO_LANGUAGE`` in all lists, the page's language has none.
STOPS, NO_LANGUAGE = 0.2, 0.05
#: Greatest share of characters in links, on a page without a marked article and within one.
LINKED, LINKED_INSIDE = 0.2, 0.5

# FIXED VALUES: elements and names of HTML, common words.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup p pre section summary table tbody td "
    "tfoot th thead tr ul".split())
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements whose text is never part of the page's text.
_SILENT = set(
    "audio button canvas datalist embed head iframe map math-annotation noembed noframes noscript object option script select style "
    "svg template textarea title video".split())
_BOILERPLATE = set("aside dialog fieldset footer form header label legend menu nav".split())
_BOILERPLATE_ROLES = set(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: Words in a class or id that name boilerplate; the first list holds for article elements as well.
_NAMED_ANYWHERE = set(
    "ad ads adsense advert adverts advertisement advertisements advertising comment comments commentlist disqus promo promotion "
    "recommended recommendations related replies reply responses sponsor sponsored teaser".split())
_NAMED = _NAMED_ANYWHERE | set(
    "alert banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer discussion footer gdpr header login masthead "
    "menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popular popup respond "
    "search share sharebar sharing sidebar sidenav signup skip social subscribe subscription toast toolbar topbar trending widget "
    "widgets".split())
_DENIED = {"has", "no", "with", "without", "is", "after", "before"}
_CONTENT = {
    "content", "main", "main-content", "maincontent", "article", "article-body", "article-content", "article-text", "articlebody", "entry",
    "entry-content", "page-content", "post", "post-body", "post-content", "story", "story-body", "body-text", "text-body"}
_STOPS = {
    "en": "the of and to in a is that it for was on are as with be at by this from or an have not but which they his were we all their "
          "has been will would there what if can more no out so up into when who them some",
    "de": "der die das und in zu den ist von mit nicht ein eine es sich auf für im dem als auch er sie an werden aus bei hat dass wird "
          "sind noch wie einer um haben nur oder aber vor bis mehr durch man nach einem über so zum war",
    "fr": "de la le et les des en un une du est que dans qui pour pas au sur par plus ce avec il ne se sont mais ou son cette elle nous "
          "comme vous aux leur être ont sa ses fait était tout deux même si entre sans",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya "
          "entre cuando todo esta ser son dos también fue había era muy hasta desde está",
}
_STOP_SETS = {lang: frozenset(words.split()) for lang, words in _STOPS.items()}
_WORD = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links, white space apart
    chars: int  # all characters, white space apart
    node: int
    heading: bool
    label: str = ""


@dataclass
class Node:
    tag: str
    parent: int
    silent: bool  # the element or one above has no text of the page
    code: bool  # in preformatted text, where class words name syntax
    by_tag: bool = False  # boilerplate by element, role or being hidden
    by_name: bool = False  # boilerplate by a word of class or id
    core: bool = False  # an article or main element lies within
    headline: bool = False  # a first-level heading lies within
    rank: int = 0  # 3 for an article, 2 for main, 1 for an element named as content


class _Parser(HTMLParser):
    """Collects the blocks of a page and the elements that they lie in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.blocks, self.stack, self.open = [Node("", -1, False, False)], [], [0], {}
        self.pieces, self.linked, self.own, self.links, self.lang = [], 0, 0, 0, ""

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            heading = any(self.nodes[n].tag in _HEADINGS for n in self.stack[-3:])
            self.blocks.append(Block(text, self.linked, len(text) - text.count(" "), self.own, heading))
        self.pieces, self.linked = [], 0

    def handle_data(self, data: str) -> None:
        top = self.nodes[self.stack[-1]]
        if not top.silent:
            if not self.pieces:
                self.own = self.stack[-1]
            self.pieces.append(data)
            self.linked += len("".join(data.split())) if self.links else 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.handle_data(" ")
        if tag in _VOID:
            if tag == "hr":
                self.flush()
            return
        if tag in _BLOCK:
            self.close_to("p")  # a paragraph ends where the next block begins
            if tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
                self.close_sibling(tag)
        if tag == "a":
            self.close_to("a")
        node = self.describe(tag, {k: v or "" for k, v in attrs})
        if tag in _BLOCK or node.by_tag or node.by_name:
            self.flush()
        self.nodes.append(node)
        self.stack.append(len(self.nodes) - 1)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.links += tag == "a"
        own = node.by_tag or node.by_name
        if (node.rank >= 2 or tag == "h1") and not own and not node.silent:
            mark = "headline" if tag == "h1" else "core"
            for n in reversed(self.stack[:-1]):
                if getattr(self.nodes[n], mark):
                    break
                setattr(self.nodes[n], mark, True)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash does not close an HTML element, except a foreign one
        if tag in ("svg", "path", "math"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_data(" ")
        self.close_to(tag)

    def close_to(self, tag: str) -> None:
        """Closes the innermost open element of that name and all within; an end without a beginning does nothing."""
        if not self.open.get(tag):
            return
        if tag in ("p", "a") and any(self.nodes[n].tag in ("td", "th", "table") for n in self.stack[self.last(tag):]):
            return
        while True:
            node = self.nodes[self.stack[-1]]
            if node.tag in _BLOCK or node.by_tag or node.by_name:
                self.flush()
            self.stack.pop()
            self.open[node.tag] -= 1
            self.links -= node.tag == "a"
            if node.tag == tag:
                return

    def last(self, tag: str) -> int:
        return max(k for k, n in enumerate(self.stack) if self.nodes[n].tag == tag)

    def close_sibling(self, tag: str) -> None:
        """An item or cell left open ends where the next begins, unless that one is of a list or table inside it."""
        kinds = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
        for n in reversed(self.stack):
            found = self.nodes[n].tag
            if found in kinds:
                return self.close_to(found)
            if found in ("ul", "ol", "dl", "table", "menu") or found in ("tr", "tbody") and tag in ("td", "th"):
                return None
        return None

    def describe(self, tag: str, attrs: dict[str, str]) -> Node:
        parent = self.nodes[self.stack[-1]]
        if tag == "html":
            self.lang = attrs.get("lang", "").lower()[:2]
        node = Node(tag, self.stack[-1], parent.silent or tag in _SILENT, parent.code or tag in ("pre", "code"))
        role = attrs.get("role", "").strip().lower()
        article = tag == "article" or role == "article" or attrs.get("itemprop") == "articleBody"
        node.rank = 3 if article else 2 if tag == "main" or role == "main" else 0
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(_UNSEEN.search(attrs.get("style", "").lower()))
        if hidden and tag not in ("html", "body"):
            node.silent = True
        inside = bool(self.open.get("article"))
        node.by_tag = tag in _BOILERPLATE and not (tag == "header" and inside) or role in _BOILERPLATE_ROLES
        if tag not in ("html", "body", "main") and not node.code and ("class" in attrs or "id" in attrs):
            names = f"{attrs.get('class', '')} {attrs.get('id', '')}".split()
            node.by_name = any(self.named(name, article, inside) for name in names)
            if not node.rank and not node.by_name and any(name.lower().replace("_", "-") in _CONTENT for name in names):
                node.rank = 1
        return node

    @staticmethod
    def named(name: str, article: bool, inside: bool) -> bool:
        words = [w.lower() for w in _NAME.findall(name)]
        kinds = _NAMED_ANYWHERE if article else _NAMED
        return any(w in kinds and not (k and words[k - 1] in _DENIED) and not (inside and w == "header") for k, w in enumerate(words))

    def finish(self) -> None:
        self.close()
        self.flush()


def blocks(html: str | None) -> list[Block]:
    """The blocks of a page in order, labelled content or boilerplate."""
    parser = _Parser()
    parser.feed(html or "")
    parser.finish()
    bad, article = _places(parser.nodes)
    top = max((r for r, b in zip(article, bad) if not b), default=0)
    held = [b for b in parser.blocks if not bad[b.node]]
    marked = top > 0 and any(article[b.node] >= top for b in held)
    stops = _stops(held, parser.lang)
    for b in parser.blocks:
        if bad[b.node] or marked and article[b.node] < top:
            b.label = "boilerplate"
        else:
            b.label = _first_label(b, marked, stops)
    _second_pass([b for b in parser.blocks if not bad[b.node] and (not marked or article[b.node] >= top)], marked)
    return parser.blocks


def _places(nodes: list[Node]) -> tuple[list[bool], list[int]]:
    """For each element: whether it lies in boilerplate, and the highest rank of marked article around it.

    A named element that holds the article is its wrapper, and so is a menu, header or form (left open,
    or round the whole page).
    """
    bad, article = [False], [0]
    for node in nodes[1:]:
        tag = node.by_tag and not (node.core and node.tag in ("nav", "header", "form") or node.headline and node.tag == "form")
        name = node.by_name and not node.core and not node.headline
        bad.append(bad[node.parent] or tag or name)
        article.append(max(article[node.parent], node.rank))
    return bad, article


def _stops(held: list[Block], lang: str) -> frozenset | None:
    """The stop words of the page's language, by its attribute or by the words; None if no list fits."""
    words = [w for b in held for w in _WORD.findall(b.text.lower())]
    count = {k: sum(w in s for w in words) for k, s in _STOP_SETS.items()}
    best = lang if lang in count and count[lang] >= NO_LANGUAGE * len(words) else max(count, key=count.get)
    return _STOP_SETS[best] if count[best] >= NO_LANGUAGE * len(words) else None


def _first_label(b: Block, marked: bool, stops: frozenset | None) -> str:
    linked = b.linked / b.chars if b.chars else 0.0
    if linked > (LINKED_INSIDE if marked else LINKED) and not b.heading:
        return "boilerplate"
    if not marked and "©" in b.text and len(b.text) < LONG:
        return "boilerplate"
    if len(b.text) < SHORT:
        return "ambiguous"
    words = _WORD.findall(b.text.lower())
    running = stops is None or sum(w in stops for w in words) >= STOPS * len(words)
    if marked:
        return "content" if running else "ambiguous"
    if running:
        return "content" if len(b.text) >= LONG else "nearly"
    return "boilerplate"


def _second_pass(held: list[Block], marked: bool) -> None:
    """Ambiguous blocks take the label of their nearest decided neighbour; a heading takes that of what follows.

    Nearly content becomes content, unless the page has content elsewhere and both its neighbours are boilerplate.
    """
    edge = "content" if marked else "boilerplate"
    if not any(b.label == "content" for b in held):
        for b in held:
            b.label = "content" if b.label == "nearly" else b.label
    first = [b.label for b in held]
    before, after, label, at = [], [None] * len(held), edge, -1
    for k, b in enumerate(first):
        before.append((k - at, label))
        if b in ("content", "boilerplate"):
            label, at = b, k
    label, at = edge, len(held)
    for k in range(len(held) - 1, -1, -1):
        after[k] = (at - k, label)
        if first[k] in ("content", "boilerplate"):
            label, at = first[k], k
    for b, (left, was), (right, will) in zip(held, before, after):
        if b.label == "nearly":
            b.label = "boilerplate" if was == will == "boilerplate" else "content"
        elif b.label == "ambiguous":
            nearer = was if left < right else will
            if b.heading:
                nearer = will if right == 1 or not marked else nearer
            elif left == right:
                nearer = "content" if "content" in (was, will) else "boilerplate"
            b.label = nearer


def main_text(html: str | None) -> str:
    return " ".join(b.text for b in blocks(html) if b.label == "content")


def text_column(html: Column) -> Column:
    """The main text of each page."""

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(main_text, na_action=None).astype(object)

    return extract(html)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, ...) -> (page_id, url, text, n_chars), one row for each page.

    Null or empty html and pages without content give an empty text; broken markup is read as far as it
    goes; pages of any length are read whole; null and repeated ids and repeated rows are kept; an empty
    table gives an empty result; other columns are not read.
    """
    out = pages.select("page_id", "url", text_column(F.col("html")).alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
