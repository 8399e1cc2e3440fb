"""Main text of web pages by boosted trees over DOM nodes.

A page is read into a tree of elements. Each block element has features: its tag, depth and place among its siblings,
the length, link density and punctuation of its subtree, and which groups of words its own and its ancestors' attributes
hold. Trees fitted to pages that `sample_pages` makes up, whose right texts are known, give the odds that an
element holds part of the article. The tree is then decoded as a whole: an element can only be kept inside kept
ones, and the choice with the largest total odds is taken, so no choice contradicts an ancestor's or a descendant's.

Elements that never show text (`UNSEEN`) are left out before that. Text that stands in the body itself, in no other
block, makes a block of its own up to the next one. Text in kept elements is decoded; white space within a block
becomes one space, blocks are joined by one.

Inputs: a null or empty page and one without an article have an empty text; broken mark-up is read as browsers would
roughly do: an element that isn't closed ends with its parent, a paragraph with the next block, a comment or script
with the page, the head with what can't stand in it; a body that isn't there is implied; a tag without an end is text. The
work is linear in the length of a page, however deep or broken it is; repeated rows are extracted each on its own; other columns are not read; an empty table gives an
empty result. Pages are read whole.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship
from . import gbdt
from ._common import fresh, map_arrow, slices, texts_of

#: Made-up pages that the model is fitted to.
PAGES, SEED = 900, 7
# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
UNSEEN = frozenset("head script style template noscript iframe object embed svg canvas math audio video textarea title select option datalist button input dialog map".split()) | frozenset(("xmp", "noembed", "noframes"))
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address nav header footer aside fieldset details summary hgroup center menu search form".split()
)
CLOSES_P = BLOCKS - frozenset("html body caption thead tbody tfoot tr td th summary".split()) | {"hr"}
#: Blocks that an inline end tag may end.
OPEN = frozenset("p li h1 h2 h3 h4 h5 h6".split())
#: What may stand in the head.
IN_HEAD = frozenset("html head title meta link style script base noscript template basefont bgsound noframes".split())
#: What an opening tag ends if it is open within the same list or table.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}
#: Groups of words in attributes (class, id, role, aria-label and names of data attributes).
GROUPS = {
    "content": "article content main body post entry story text page blog news copy prose single hentry",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs crumbs pagination pager tabs toc toolbar skip links",
    "head": "header masthead banner topbar logo brand hero site",
    "foot": "footer foot bottom copyright legal colophon imprint",
    "side": "sidebar side aside widget rail related recommended recommendations trending popular more teaser promo complementary secondary",
    "advert": "ad ads advert adverts advertisement adslot adsense sponsor sponsored promotion banner-ad dfp outbrain taboola",
    "comment": "comment comments commentlist respond reply replies discussion disqus thread reviews review",
    "notice": "cookie cookies consent gdpr notice alert warning popup modal overlay newsletter subscribe subscription signup paywall toast message notification",
    "share": "share sharing social follow twitter facebook tags author byline meta date login search form",
}
_WORD_GROUP = {w: 1 << i for i, words in enumerate(GROUPS.values()) for w in words.split()}
TAGS = ("body", "main", "article", "section", "div", "p", "heading", "list", "li", "table", "cell", "quote", "nav", "header", "footer", "aside", "figure", "other")
_TAG_PLACE = {t: i for i, t in enumerate(TAGS)} | {f"h{i}": 6 for i in range(1, 7)} | {"ul": 7, "ol": 7, "dl": 7, "menu": 12, "dt": 8, "dd": 8, "tr": 9, "tbody": 9, "thead": 9, "td": 10, "th": 10, "blockquote": 11, "pre": 11, "figcaption": 16, "html": 0}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@lru_cache(20_000)
def attribute_groups(raw: str) -> int:
    """Bits of the GROUPS that words of the attributes belong to."""
    out = 0
    for name, value in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "aria-label", "itemprop") or name.startswith("data-"):
            words = _PARTS.findall(_CAMEL.sub(" ", value).lower()) + (_PARTS.findall(name[5:]) if name.startswith("data-") else [])
            for w in words:
                out |= _WORD_GROUP.get(w, 0)
    return out


class Tree:
    """Block elements in page order and the pieces of text in them. Element 0 is the page."""

    __slots__ = ("parent", "tag", "groups", "texts", "owner", "linked", "inputs")

    def __init__(self) -> None:
        self.parent, self.tag, self.groups, self.inputs = [0], ["html"], [0], [0]
        self.texts, self.owner, self.linked = [], [], []


class _Open:
    """The open elements of a page: of each its tag, the block it belongs to, whether its text is seen and whether it's a link. Finds the innermost of a kind without a walk."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool, bool]] = [("html", 0, True, False)]
        self.places: dict[str, list[int]] = {}  # depths by tag
        self.blocks: list[int] = []
        self.walls: list[int] = []  # blocks that inline end tags don't end

    def push(self, tag: str, block: int, seen: bool, link: bool) -> None:
        depth = len(self.stack)
        self.places.setdefault(tag, []).append(depth)
        if tag in BLOCKS:
            self.blocks.append(depth)
            if tag not in OPEN:
                self.walls.append(depth)
        self.stack.append((tag, block, seen, link))

    def cut(self, depth: int) -> bool:
        """Ends the elements from a depth on; whether there was a block among them."""
        parted = bool(self.blocks) and self.blocks[-1] >= depth
        for tag, *_ in self.stack[depth:]:
            self.places[tag].pop()
        del self.stack[depth:]
        for depths in (self.blocks, self.walls):
            while depths and depths[-1] >= depth:
                depths.pop()
        return parted

    def innermost(self, tags) -> int:
        """Depth of the innermost of these tags, 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def ended_by(self, tag: str) -> int:
        """Depth of the outermost element that an opening tag ends, 0 if none."""
        p = self.places.get("p")
        if tag not in ENDS:
            if tag not in CLOSES_P:
                return 0
            top = max(self.blocks[-1] if self.blocks else 0, self.innermost(("button",)))
            return top if top and self.stack[top][0] == "p" else 0
        ends, within = ENDS[tag]
        limit, at = self.innermost(within), self.innermost(ends)
        if at > limit:
            return at
        return p[bisect_right(p, limit)] if p and tag in CLOSES_P and p[-1] > limit else 0


def parse(page: str) -> Tree:
    out, tags = Tree(), _Open()
    at, size, last = 0, len(page), page.rfind(">")
    texts, owner, linked, stack = out.texts, out.owner, out.linked, tags.stack
    body = bare = 0  # the block of the body, and the open block of text that stands in it directly

    def element(tag: str, parent: int, groups: int) -> int:
        out.parent.append(parent)
        out.tag.append(tag)
        out.groups.append(groups)
        out.inputs.append(0)
        return len(out.tag) - 1

    def start_body(groups: int = 0) -> None:
        nonlocal body
        body = element("body", 0, groups)
        tags.push("body", body, True, False)

    def text(raw: str) -> None:
        nonlocal bare
        _, block, seen, link = stack[-1]
        if not (seen or stack[-1][0] == "head") or not raw:
            return
        shown = not raw.isspace()
        if shown and tags.places.get("head"):
            tags.cut(tags.places["head"][0])
            _, block, seen, link = stack[-1]
        if not block and not body:
            if not shown:
                return
            start_body()
            _, block, seen, link = stack[-1]
        if block == body or not block:
            if not bare:
                if not shown:
                    return
                bare = element("div", body, 0)
            block = bare
        texts.append(html.unescape(raw) if "&" in raw else raw)
        owner.append(block)
        linked.append(link)

    def close(depth: int) -> None:
        nonlocal bare
        if tags.cut(depth):
            bare = 0
            text(" ")

    while at < size:
        start = page.find("<", at)
        if start < 0 or start > last and not page.startswith("<!--", start):
            text(page[at:])
            break
        m = _TOKEN.match(page, start) or _LOOSE.match(page, start)
        if m is None:
            text(page[at : start + 1])
            at = start + 1
            continue
        text(page[at:start])
        at = m.end()
        if m.lastindex is None:
            continue
        tag, raw = m[2].lower(), m[3]
        if m[1]:
            depth = tags.innermost((tag,))
            if depth and tag not in ("body", "html") and (tag in BLOCKS or not tags.walls or tags.walls[-1] <= depth):
                close(depth)
            elif tag == "br" or tag == "p":
                text(" ")
            continue
        if tags.places.get("head") and tag not in IN_HEAD:
            tags.cut(tags.places["head"][0])
        if tag == "body":
            if not body:
                start_body(attribute_groups(raw) if raw else 0)
            continue
        if not body and tag not in IN_HEAD:
            start_body()
        if depth := tags.ended_by(tag):
            close(depth)
        _, block, seen, link = stack[-1]
        if tag in VOID:
            if tag == "input":
                out.inputs[block] += 1
            if tag in ("br", "hr"):
                text(" ")
            continue
        groups = attribute_groups(raw) if raw else 0
        if tag in ("button", "select", "textarea", "form"):
            out.inputs[block] += 1
        if tag in BLOCKS and tag != "html":
            text(" ")
            bare, block = 0, element(tag, block, groups)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if raw.endswith("/") and tag in ("svg", "path", "iframe"):
            continue
        if tag != "html":
            tags.push(tag, block, seen and tag not in UNSEEN, link or tag == "a")
    return out


def _subtrees(parent: list[int]) -> np.ndarray:
    """The number of elements in each one's subtree, itself included; elements are in page order, and roots are their own parents."""
    size = [1] * len(parent)
    for i in range(len(parent) - 1, -1, -1):
        if parent[i] != i:
            size[parent[i]] += size[i]
    return np.array(size, np.int64)


def features(trees: list[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of the elements of all pages, with parent, depth and page of each. Parents come before their children."""
    sizes = np.array([len(t.tag) for t in trees])
    first = np.cumsum(sizes) - sizes
    page = np.repeat(np.arange(len(trees)), sizes)
    parent = np.concatenate([np.array(t.parent) + f for t, f in zip(trees, first.tolist())])
    n = len(parent)
    tag = np.array([_TAG_PLACE.get(x, 17) for t in trees for x in t.tag])
    groups = np.array([g for t in trees for g in t.groups])
    inputs = np.array([x for t in trees for x in t.inputs])
    depth = np.zeros(n, np.int64)
    root = np.zeros(n, bool)
    root[first] = True
    above = groups.copy()
    tags_above = np.zeros(n, np.int64)
    for i, p in enumerate(parent.tolist()):  # parents first
        if not root[i]:
            depth[i] = depth[p] + 1
            above[i] |= above[p]
            tags_above[i] = tags_above[p] | 1 << int(tag[p])
    above[root] = 0
    own_above = np.where(root, 0, above[parent] | groups[parent])
    owner = np.array([o + f for t, f in zip(trees, first.tolist()) for o in t.owner], np.int64)
    count = lambda f: np.bincount(owner, [f(x) for t in trees for x in t.texts], n) if len(owner) else np.zeros(n)
    chars = count(lambda x: len(x.strip()))
    link = np.bincount(owner, [len(x.strip()) * y for t in trees for x, y in zip(t.texts, t.linked)], n) if len(owner) else chars
    stops = count(lambda x: x.count(".") + x.count("!") + x.count("?"))
    commas = count(lambda x: x.count(","))
    words = count(lambda x: x.count(" ") + 1 if x.strip() else 0)
    end = np.arange(n) + _subtrees(parent.tolist())

    def up(value: np.ndarray) -> np.ndarray:
        """Sums over subtrees, which are runs of elements."""
        total = np.append(0.0, np.cumsum(value, dtype=np.float64))
        return total[end] - total[:-1]

    all_chars, all_link, all_stops, all_commas, all_words, elements = up(chars), up(link), up(stops), up(commas), up(words), up(np.ones(n))
    paragraphs, headings, items, all_inputs = up(tag == 5), up(tag == 6), up(tag == 8), up(inputs)
    has = up((tag == 2) | (tag == 1))
    order = np.lexsort((np.arange(n), parent))
    order = order[~root[order]]
    same = np.append(False, parent[order][1:] == parent[order][:-1]) if len(order) else np.zeros(0, bool)
    runs = np.flatnonzero(~same)
    place, siblings = np.zeros(n), np.ones(n)
    length = np.diff(np.append(runs, len(order)))
    place[order] = np.arange(len(order)) - np.repeat(runs, length)
    siblings[order] = np.repeat(length, length)
    rest = lambda v: np.where(root, 0, v[parent] - v)
    total = np.maximum(all_chars[first[page]], 1)
    bits = lambda x: [(x >> i & 1) for i in range(len(GROUPS))]
    safe = np.maximum(all_chars, 1)
    columns = [
        *[tag == i for i in range(len(TAGS))],
        *bits(groups),
        *bits(own_above),
        *[(tags_above >> i & 1) for i in (1, 2, 12, 13, 14, 15)],
        depth,
        place,
        siblings,
        place / siblings,
        np.log1p(all_chars),
        np.log1p(chars),
        all_chars / total,
        all_link / safe,
        all_stops / np.maximum(all_words, 1),
        all_commas / np.maximum(all_words, 1),
        all_words / np.maximum(elements, 1),
        np.log1p(elements),
        paragraphs / elements,
        np.log1p(paragraphs),
        headings,
        items / elements,
        all_inputs,
        has > 0,
        np.log1p(rest(all_chars)),
        rest(all_link) / np.maximum(rest(all_chars), 1),
        all_chars / np.maximum(np.where(root, all_chars, all_chars[parent]), 1),
    ]
    return np.stack([np.asarray(c, np.float32) for c in columns], 1), parent, depth, page


def decode(odds: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Which elements, in page order, are kept: those of the largest total odds such that each one's parent is kept; the roots always are."""
    best, above = odds.tolist(), parent.tolist()
    for i in range(len(best) - 1, -1, -1):
        if best[i] > 0 and above[i] != i:
            best[above[i]] += best[i]
    keep = [False] * len(best)
    for i, d in enumerate(depth.tolist()):
        keep[i] = d == 0 or best[i] > 0 and keep[above[i]]
    return np.array(keep, bool)


def extract_texts(model: gbdt.Trees, pages: list[str]) -> list[str]:
    trees = [parse(p) for p in pages]
    if not trees:
        return []
    x, parent, depth, page = features(trees)
    p = model.score(x)
    keep = decode(np.log(p / (1 - p)), parent, depth)
    # The page as a whole only counts as far as it holds kept blocks.
    out, first = [], 0
    for tree in trees:
        mine = keep[first : first + len(tree.tag)]
        first += len(tree.tag)
        parts, last = [], -1
        for text, owner in zip(tree.texts, tree.owner):
            if owner and mine[owner]:
                if owner != last:
                    parts.append(" ")
                parts.append(text)
            last = owner
        out.append(" ".join("".join(parts).split()))
    return out


def sample_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[str, list[bool]]]:
    """Made-up pages and, for each block element in page order, whether it holds part of the article."""
    return [_page(random.Random(f"{seed} {i}")) for i in range(n)]


def _page(r: random.Random) -> tuple[str, list[bool]]:
    syllables = [a + b for a in "b d f g k l m n p r s t v".split() for b in "a e i o u an er is".split()]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(r.randint(low, high)))

    def sentence() -> str:
        s = words(2, 18).capitalize()
        return (s.replace(" ", ", ", 1) if r.random() < 0.5 else s) + r.choice(("." * 8 + "!?")[:10])

    prose = lambda low, high: " ".join(sentence() for _ in range(r.randint(low, high)))
    out: list[str] = []
    labels: list[bool] = []

    def block(tag: str, good: bool, inside, attributes: str = "") -> None:
        labels.append(good)
        out.append(f"<{tag}{attributes}>")
        inside() if callable(inside) else out.append(inside)
        if not (tag in ("p", "li") and r.random() < 0.08):
            out.append(f"</{tag}>")

    def named(group: str, chance: float = 0.9) -> str:
        if r.random() > chance:
            return "" if r.random() < 0.6 else f' class="{word()}"'
        names = [w for w in GROUPS[group].split() if _WORD_GROUP[w] == 1 << list(GROUPS).index(group)]
        return f' {r.choice(("class", "class", "id"))}="{r.choice(names)}{r.choice(("", "", "-" + word(), " " + word(), "_box"))}"'

    def links(low: int, high: int) -> None:
        def item() -> None:
            out.append(f'<a href="/{word()}">{words(1, 3)}</a>')

        def items() -> None:
            for _ in range(r.randint(low, high)):
                block("li", False, item)

        block(r.choice(("ul", "ul", "ol")), False, items) if r.random() < 0.8 else [item() for _ in range(r.randint(low, high))]

    def menu() -> None:
        block(*(("nav", False, lambda: links(3, 9), named("menu", 0.4)) if r.random() < 0.7 else ("div", False, lambda: links(3, 9), named("menu"))))

    def head() -> None:
        def inside() -> None:
            block(r.choice(("h1", "div", "p")), False, words(1, 4), named("head", 0.5))
            if r.random() < 0.5:
                block("p", False, words(3, 9))
            if r.random() < 0.5:
                menu()

        block(*(("header", False, inside, named("head", 0.3)) if r.random() < 0.7 else ("div", False, inside, named("head"))))

    def foot() -> None:
        def inside() -> None:
            out.append(f"&copy; {word()}.example &middot; {prose(0, 2)}")
            if r.random() < 0.5:
                links(2, 6)
            if r.random() < 0.4:
                block("p", False, prose(1, 3))

        block(*(("footer", False, inside, named("foot", 0.3)) if r.random() < 0.75 else ("div", False, inside, named("foot"))))

    def side() -> None:
        def inside() -> None:
            for _ in range(r.randint(1, 3)):
                block(r.choice(("h2", "h3", "h4")), False, words(1, 4))
                links(2, 6) if r.random() < 0.6 else block("p", False, prose(1, 4))

        block(*(("aside", False, inside, named("side", 0.5)) if r.random() < 0.6 else (r.choice(("div", "section")), False, inside, named("side"))))

    def advert() -> None:
        block(r.choice(("div", "div", "aside", "section", "p")), False, (lambda: block("p", False, prose(1, 3))) if r.random() < 0.3 else prose(1, 4), named("advert", 1))

    def notice() -> None:
        block(r.choice(("div", "div", "section", "aside", "p")), False, (lambda: [block("p", False, prose(1, 3)), out.append(f"<button>{words(1, 2)}</button>")]) if r.random() < 0.5 else prose(1, 4), named("notice", 1) if r.random() < 0.85 else ' role="alert"')

    def form() -> None:
        fields = lambda: block("form", False, f'<label>{words(1, 3)}</label><input name="q"><button>{word()}</button>', f' action="/{word()}"')
        block("div", False, fields, named("share", 0.6)) if r.random() < 0.7 else fields()

    def comments() -> None:
        def one() -> None:
            block(r.choice(("p", "div")), False, words(1, 2), named("share", 0.5))
            block("p", False, prose(1, 4))

        def inside() -> None:
            block(r.choice(("h2", "h3")), False, words(1, 3))
            for _ in range(r.randint(1, 5)):
                block(r.choice(("div", "article", "li", "div")), False, one, named("comment", 0.8))

        block(r.choice(("section", "div", "div", "ul", "aside")), False, inside, named("comment", 1))

    def share() -> None:
        if r.random() < 0.7:
            block("div", False, lambda: links(2, 4), named("share", 0.9))
        else:
            block(r.choice(("p", "div")), False, f"{words(1, 2)} " + " ".join(f'<a href="/{word()}">{words(1, 2)}</a>' for _ in range(r.randint(1, 4))), named("share", 0.9))

    def bare(good: bool, inside: str) -> None:
        """Text in the body itself."""
        labels.append(good)
        out.append(inside)

    def inline() -> str:
        s = prose(1, 6)
        if r.random() < 0.3:
            a, _, b = s.partition(" ")
            s = f"{a} <b>{b}</b>"
        if r.random() < 0.25:
            s += f' <a href="/{word()}">{words(1, 4)}</a> {prose(1, 2)}'
        return s

    def article_part() -> None:
        kind = r.random()
        if kind < 0.1:
            block("p", True, words(1, 4) + r.choice(("", ".")))
        elif kind < 0.72:
            block("p", True, inline())
        elif kind < 0.8:
            block(r.choice(("h2", "h3")), True, words(1, 7))
        elif kind < 0.86:
            block(r.choice(("ul", "ol")), True, lambda: [block("li", True, prose(1, 2)) for _ in range(r.randint(2, 6))])
        elif kind < 0.9:
            block("blockquote", True, (lambda: block("p", True, prose(1, 3))) if r.random() < 0.5 else prose(1, 3))
        elif kind < 0.93:
            block("table", True, lambda: [block("tr", True, lambda: [block("td", True, words(1, 3)) for _ in range(3)]) for _ in range(r.randint(2, 4))])
        elif kind < 0.95:
            block("pre", True, f"{word()} = {word()}({word()})\n  {word()}")
        elif kind < 0.97:
            block("figure", True, lambda: [out.append('<img src="x.png">'), block("figcaption", True, prose(1, 1))])
        else:
            block("div", True, lambda: [block("p", True, inline()) for _ in range(r.randint(1, 3))])

    def article() -> None:
        def inside() -> None:
            if r.random() < 0.9:
                block("header", True, lambda: block("h1", True, words(2, 12)), "") if r.random() < 0.15 else block("h1", True, words(2, 12))
            for _ in range(r.choice((1, 2, 4, 8, 15, 30))):
                if r.random() < 0.06:
                    r.choice((advert, share, notice, side, form))()
                if r.random() < 0.08 and out[-1].endswith("</p>"):
                    labels.append(True)  # a paragraph that isn't closed, as in `<p><b>x<br><p>`
                    out.append(f"<p><b>{sentence()}<br>")
                article_part()
            if r.random() < 0.25:
                r.choice((share, comments, side, foot))()

        kind = r.random()
        if kind < 0.55:
            block("article", True, inside, "" if r.random() < 0.6 else named("content"))
        elif kind < 0.75:
            block(r.choice(("div", "section")), True, inside, named("content", 1))
        elif kind < 0.85:
            block("main", True, inside, named("content", 0.3))
        elif kind < 0.93:
            block("div", True, lambda: block("div", True, inside, named("content", 0.9)), named("content", 0.4))
        else:
            block("div", True, inside)

    def bare_article() -> None:
        for _ in range(r.randint(1, 8)):
            if r.random() < 0.7:
                bare(True, "<br><br>".join(inline() for _ in range(r.randint(1, 4))))
                out.append("<hr>") if r.random() < 0.2 else None
            block(r.choice(("p", "h2", "blockquote")), True, inline())

    def page() -> None:
        if r.random() < 0.05:
            if r.random() < 0.5:
                bare(False, " | ".join(f'<a href="/{word()}">{words(1, 2)}</a>' for _ in range(r.randint(2, 7))))
            block("h1", True, words(2, 12))
            bare_article()
            foot() if r.random() < 0.6 else None
            return
        if r.random() < 0.06:  # one form around all
            block("form", True, parts, f' id="{word()}"')
        else:
            parts()

    def parts() -> None:
        plain = r.random() < 0.12
        for part in (notice, head, menu, advert, form):
            if not plain and r.random() < 0.5:
                part()

        def middle() -> None:
            if r.random() < 0.2:
                side()
            article()
            for part in (comments, side, advert, share):
                if not plain and r.random() < 0.3:
                    part()

        wrap = r.random()
        if wrap < 0.5:
            middle()
        else:
            block(r.choice(("main", "div", "div")), True, middle, named("content", 0.3) if r.random() < 0.5 else f' class="{word()}"')
        for part in (advert, notice, foot):
            if not plain and r.random() < (0.3 if part is not foot else 0.8):
                part()

    head_part = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{words(2, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
    block("body", True, page)
    return head_part + "".join(out).removesuffix("</body>") + r.choice(("</body></html>", "")), labels


@lru_cache(2)
def train(n: int = PAGES, seed: int = SEED) -> gbdt.Trees:
    """The model; the whole page, element 0, is always kept and not learnt from."""
    pages = sample_pages(n, seed)
    trees = [parse(p) for p, _ in pages]
    x, _, depth, page = features(trees)
    labels = [[True, *l] for (_, l), t in zip(pages, trees)]
    ok = np.array([len(l) == len(t.tag) for l, t in zip(labels, trees)])
    y = np.concatenate([np.resize(np.array(l, float), len(t.tag)) for l, t in zip(labels, trees)])
    use = ok[page] & (depth > 0)
    return gbdt.fit(x[use].astype(np.float64), y[use], trees=60, depth=5, rate=0.25)


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", model: gbdt.Trees | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """df's id_col, the columns in keep, and the main text of html_col, in text, of each row."""
    source, out = fresh(df, "__html"), fresh(df, "__text")
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, source, 1 << 20):
                texts = extract_texts(shared.value, texts_of(part, source))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*part.schema.names[:-1], out])

    rows = df.select(id_col, *keep, df[html_col].alias(source))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return map_arrow(rows, run, f"{fields}, `{out}` string").withColumnRenamed(out, "text")
