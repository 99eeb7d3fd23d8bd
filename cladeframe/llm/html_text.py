"""Main text of web pages by tree scoring.

Paragraphs give points for length and commas to all their ancestors, less with every level; an element's points are
discounted by the share of its text that stands in links. The best container and its siblings are kept, whatever their
size, without the parts that are never text of an article (menus, forms, scripts, notices and so on) and siblings that
are mostly links.

What is clutter is told by element names, roles and whole class tokens: `content-with-sidebar` is no sidebar and
`entry-header` holds a title. Words of page layout and forms are outvoted by the text: an element that holds more than
half of the page's paragraphs is none. Reader comments are told by words or, outside articles, by form: two or more items
beside each other, each with an author or a time and without a heading.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML and common words of class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
NEVER = frozenset("script style noscript template head title nav footer aside button select textarea input iframe object svg canvas audio video dialog menu datalist map".split())
CLOSES_P = BLOCKS - {"body", "html", "li", "dd", "dt", "caption", "legend", "summary", "tbody", "thead", "tfoot", "tr", "figcaption"}
ENDS_SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table div section article main body html".split())
PARAGRAPHS = frozenset("p pre blockquote li dd td th h1 h2 h3 h4 h5 h6 figcaption".split())
DISCUSSION = frozenset("comment comments commentlist reply replies respond responses discussion discussions disqus".split())
OFFERS = frozenset(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup "
    "breadcrumb breadcrumbs pager pagination share sharing social related recommended recommendations login skip".split()
)
LAYOUT = frozenset("sidebar sidenav side rail menu nav navbar navigation toc footer header masthead topbar toolbar search widget widgets hidden".split())
STATES = frozenset("has with without no not is js open closed enabled disabled".split())
LAST_STATES = frozenset("fixed sticky".split())
BYLINES = frozenset("author user username byline date timestamp avatar posted".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
BODY_WORDS = frozenset("article content post entry story main text body".split())
LINKED = 0.5
TEXTS = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li div article section dd".split())
SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("tag", "parent", "kids", "clutter", "points", "chars", "linked", "bonus", "inside", "gain", "below", "soft", "byline", "mass")

    def __init__(self, tag, parent=None, clutter=False, bonus=0.0, soft=False, byline=False):
        self.tag, self.parent, self.kids, self.clutter = tag, parent, [], clutter
        self.soft, self.byline, self.mass = soft, byline, 0  # mass: unlinked characters of paragraphs
        self.points, self.chars, self.linked, self.bonus = 0.0, 0, 0, bonus
        self.gain, self.below = 0.0, [0.0] * 5  # gains from this many levels down; the last for all deeper ones
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)


@lru_cache(maxsize=4096)
def meant(token: str) -> str:
    """What a class or id token says of its element: discussion, offer, layout, body or nothing."""
    words = SPLIT.split(token)
    named = set(words)
    if named & STATES or words[-1] in LAST_STATES:
        return "body" if named & BODY_WORDS else ""
    if named & DISCUSSION:
        return "discussion"
    if named & OFFERS:
        return "offer"
    if named & LAYOUT:
        return "" if named & LAYOUT == {"header"} and named & (BODY_WORDS - {"main"}) else "layout"
    return "body" if named & BODY_WORDS else ""


def judged(tag: str, attrs, inside: bool) -> tuple[bool, bool, bool, float]:
    """Of an element: whether it is clutter, or is unless it holds most of the text, whether it names an author or a time,
    and its head start as a container. inside: it stands in an article or main."""
    if tag in NEVER or (tag == "header" and not inside):
        return True, False, False, 0.0
    kinds, byline, bonus = set(), tag in ("time", "cite", "address"), 25.0 if tag in ("article", "main") else 0.0
    for key, value in attrs:
        value = (value or "").lower()
        if key in ("class", "id"):
            for token in value.split():
                kinds.add(meant(token))
                byline = byline or not BYLINES.isdisjoint(SPLIT.split(token))
        elif key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return True, False, False, 0.0
        elif key == "itemprop" and value == "articlebody" or key == "role" and value in ("main", "article"):
            bonus += 25.0
    whole = tag in ("html", "body", "main")
    if "body" in kinds:
        bonus += 10.0
    if "discussion" in kinds and not whole or "offer" in kinds and not whole and tag != "article":
        return True, False, byline, 0.0
    return False, tag == "form" or "layout" in kinds and not whole and tag != "article", byline, bonus


class Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html")
        self.doubtful, self.bylines = False, 0  # whether layout words or forms were met; authors and times

    def _close(self, tags, stop):
        node = self.at
        while node is not None and node.tag not in stop:
            if node.tag in tags:
                self.at = node.parent or self.root
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag in CLOSES_P:
            self._close(("p",), SCOPE - {"p"})
        if tag in ENDS_SAME:
            self._close(ENDS_SAME[tag], SCOPE - {tag})
        if tag == "body":
            self._close(("head",), ())
        clutter, soft, byline, bonus = judged(tag, attrs, self.at.inside)
        self.doubtful |= soft
        self.bylines += byline
        node = Node(tag, self.at, clutter, bonus, soft, byline)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            if node.tag in ("td", "th") and tag not in ("tr", "table", "tbody", "thead", "tfoot") and tag not in BLOCKS:
                return
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        if data:
            self.at.kids.append(data)


def walk(root: Node):
    """Nodes that are not clutter, children before their parents."""
    stack, out = [root], []
    while stack:
        n = stack.pop()
        out.append(n)
        stack += [k for k in n.kids if isinstance(k, Node) and not k.clutter]
    return reversed(out)


def weigh(root: Node) -> None:
    """Mass of all nodes that are not clutter."""
    for n in walk(root):
        own = sum(k.mass if isinstance(k, Node) else len(k.strip()) for k in n.kids if isinstance(k, str) or not k.clutter)
        n.mass = 0 if n.tag == "a" else own


def settle(b: Builder) -> None:
    """Layout and forms become clutter unless they hold more than half of the page's text; discussions told by form, too."""
    weigh(b.root)
    every = list(walk(b.root))
    for n in every:
        if n.soft and 2 * n.mass <= b.root.mass:
            n.clutter = True
    if b.bylines > 1:
        weigh(b.root)
        for n in walk(b.root):
            if not n.inside and n.tag in ("div", "section", "ul", "ol") and n.mass < b.root.mass and discussion(n):
                n.clutter = True


def discussion(n: Node) -> bool:
    """Whether an element is two or more items, each with an author or a time and text of its own, and no heading."""
    items = [k for k in n.kids if isinstance(k, Node) and k.tag in ITEMS and not k.clutter and k.mass]
    if len(items) < 2 or 2 * sum(k.mass for k in items) < n.mass:
        return False
    for k in items:
        own = list(walk(k))
        named = [x for x in own if x.byline]
        if not named or any(x.tag in ("h1", "h2", "h3", "main") for x in own) or k.mass <= sum(x.mass for x in named if x is not k):
            return False
    return True


def score(root: Node) -> None:
    for n in walk(root):
        own = commas = direct = 0
        for k in n.kids:
            if isinstance(k, str):
                size = len(k.strip())
                own, direct, commas = own + size, direct + size, commas + k.count(",")
            elif not k.clutter:
                own, n.linked = own + k.chars, n.linked + k.linked
                if k.tag not in BLOCKS:
                    direct += k.chars
                n.below[0] += k.gain
                for level, gains in enumerate(k.below, 1):
                    n.below[min(level, 4)] += gains
        n.chars = own
        if n.tag == "a":
            n.linked = own
        if direct and (n.tag in PARAGRAPHS or n.tag in BLOCKS):
            gain = (1 + commas + min(direct / 100, 3)) * (1 - n.linked / max(1, n.chars))
            if n.tag in PARAGRAPHS:
                n.gain = gain  # counts for its parent and further up
            else:
                n.below[0] += gain
        n.points = sum(g / by for g, by in zip(n.below, (1, 2, 6, 9, 12)))


def value(n: Node) -> float:
    return (n.points + (n.bonus if n.points else 0)) * (1 - n.linked / max(1, n.chars))


def blocks(nodes: list[Node]) -> list[str]:
    out, run = [], []

    def end():
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    stack = [("open", n) for n in reversed(nodes)]
    while stack:
        what, n = stack.pop()
        if isinstance(n, str):
            run.append(n)
            continue
        if n.tag in BLOCKS:
            end()
        elif n.tag in ("br", "td", "th", "option"):
            run.append(" ")
        if what == "open":
            if n.tag in BLOCKS or n.tag in ("td", "th"):
                stack.append(("close", n))
            stack += [("open", k) for k in reversed(n.kids) if isinstance(k, str) or not k.clutter]
    end()
    return out


def main_text(html: str | None) -> str:
    """Article text of a whole page: blocks in page order, one per line. Null, empty and textless pages give ''."""
    if not html:
        return ""
    b = Builder()
    b.feed(html)
    b.close()
    if b.doubtful or b.bylines > 1:
        settle(b)
    score(b.root)
    candidates = [n for n in walk(b.root) if n.tag not in PARAGRAPHS and n.tag in BLOCKS and n.points > 0]
    if not candidates:
        return "\n".join(blocks([b.root]))
    best = max(candidates, key=value)
    top = value(best)
    while best.parent is not None and best.parent.tag not in ("body", "html") and best.tag not in ("article", "main"):
        beside = [k for k in best.parent.kids if k is not best and (k.strip() if isinstance(k, str) else not k.clutter and k.chars)]
        if beside and not any(isinstance(k, Node) and value(k) + k.gain >= 0.25 * top for k in beside):
            break
        best = best.parent
    if best.parent is None or best.tag == "body":
        return "\n".join(blocks([k for k in best.kids if belongs(k, best)]))
    return "\n".join(blocks([k for k in best.parent.kids if k is best or belongs(k, best)]))


def belongs(k: Node | str, best: Node) -> bool:
    """Whether a sibling of the best container (or a child of the page's body, if that is the best) is text of the article
    as well: not clutter and no division, list or table of mostly links."""
    return isinstance(k, str) or not k.clutter and (k.tag in TEXTS or k.linked <= LINKED * k.chars)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without html_col, with text (main text of the whole page) and n_chars (its code points).

    Null, empty and textless pages give the empty text. Of containers of equal value the one that ends first in the page
    is the best. Rows are kept one by one, repeated ones too; columns called text or n_chars are replaced. An empty table
    gives an empty result.
    """
    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches):
        for pdf in batches:
            text = [main_text(h) for h in pdf[html_col]]
            yield pdf[rest].assign(text=text, n_chars=[len(t) for t in text])

    return pages.select(*[F.col(f"`{c}`") for c in rest], F.col(html_col)).mapInPandas(run, f"{fields}{', ' if fields else ''}text string, n_chars long")
