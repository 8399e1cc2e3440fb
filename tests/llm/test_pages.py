"""Pages that no generator made, hard pages, and the parser's shortcuts against plain walks."""

import random
import time

import numpy as np
import pytest

from sketchgraph.llm import html_extract

FIRST = "The old harbour was rebuilt in the spring. Boats now land twice a day, and the market has returned."
SECOND = "Nobody expected the ferry to run again so soon. The crew had waited for years, they said."
THIRD = "In the end, the town paid for half of the work. The rest came from the county."
TITLE = "A harbour returns"
BODY = f"<h1>{TITLE}</h1><p>{FIRST}</p><p>{SECOND}</p><p>{THIRD}</p>"
#: Layouts without an article element.
LAYOUTS = {
    "classes": f'<html><head><title>x</title></head><body class="home"><div id="page"><div id="masthead" class="site-header"><div class="site-title"><a href="/">Harbour News</a></div><ul class="menu"><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></div><div id="content"><div class="entry-content">{BODY}</div></div><div id="secondary" class="widget-area"><h3>Recent posts</h3><ul><li><a href="/1">One post</a></li><li><a href="/2">Two posts</a></li></ul></div><div id="colophon" class="site-footer">Proudly made by us</div></div></body></html>',
    "table": f'<html><body><table><tr><td class="nav"><a href="/">Home</a><br><a href="/x">News</a><br><a href="/y">Contact</a></td><td>{BODY}</td></tr></table></body></html>',
    "main": f'<body><header><h2>Site</h2><nav><a href="/">Home</a> <a href="/n">News</a></nav></header><main>{BODY}</main><footer><p>Copyright 2020 Harbour News. All rights reserved.</p></footer></body>',
    "bare": f"<html><body><h1>{TITLE}</h1>{FIRST}<br><br>{SECOND}<br><br>{THIRD}</body></html>",
    "one form": f'<html><body><form id="all"><div class="topbar"><a href="/">Home</a> <a href="/n">News</a></div><div id="main">{BODY}</div><div class="footer">Terms | Privacy</div></form></body></html>',
    "no end of the head": f'<html><head><title>t</title><meta charset=utf-8><body><div class="story">{BODY}</div></body></html>',
    "comments": f'<body><div class="post">{BODY}</div><div id="comments"><h3>2 comments</h3><ol class="commentlist"><li><div class="comment-author">Ann</div><p>What a fine thing to read. I was there, too.</p></li><li><div class="comment-author">Bob</div><p>I do not agree with this at all.</p></li></ol></div></body>',
    "notices": f'<body><div class="cookie-banner"><p>We use cookies to improve your visit. Do you accept them?</p><button>Yes</button></div><div class="article-body"><h1>{TITLE}</h1><p>{FIRST}</p><div class="advert">Buy a boat today. Best boats in town!</div><p>{SECOND}</p><p>{THIRD}</p><p class="tags">Tagged <a href="/t">boats</a> <a href="/u">sea</a></p></div></body>',
    "no tags": f"{TITLE} {FIRST} {SECOND} {THIRD}",
}


@pytest.fixture(scope="module")
def model():
    return html_extract.train()


def test_layouts(model):
    want = f"{TITLE} {FIRST} {SECOND} {THIRD}".split()
    got = html_extract.extract_texts(model, [*LAYOUTS.values()])
    exact = 0
    for name, text in zip(LAYOUTS, got):
        mine = text.split()
        common = len({*mine} & {*want})
        assert common >= 0.9 * len({*want}) and common >= 0.9 * len({*mine}), (name, text)
        exact += mine == want
    assert exact >= 7


@pytest.mark.parametrize("unit", ["<a ", "<b>", "<div>", "<b>x</i>", "<i><div>", "<p>x", '<a "', "<!-- ", "<li>", "<b><hr>", "<td>"])
def test_work_is_linear(model, unit):
    def seconds(n: int) -> float:
        start = time.process_time()
        html_extract.extract_texts(model, [unit * n])
        return time.process_time() - start

    few = max(0.02, seconds(10_000))
    assert seconds(100_000) < 40 * few


def test_nested_tags_keep_the_text(model):
    assert html_extract.extract_texts(model, ["<b>" * 100_000 + FIRST + "</b>" * 100_000]) == [FIRST]
    assert isinstance(html_extract.extract_texts(model, ["<div>" * 100_000 + f"<p>{FIRST}</p>"])[0], str)
    assert html_extract.extract_texts(model, ["<a " * 333_333]) == [("<a " * 333_333).strip()]


def walked(stack: list[str], tag: str) -> int:
    """What an opening tag ends, by a walk down the open elements."""
    found = 0
    if tag in html_extract.CLOSES_P or tag in html_extract.ENDS:
        ends, within = html_extract.ENDS.get(tag, ({"p"}, {"table", "button"}))
        for depth in range(len(stack) - 1, 0, -1):
            name = stack[depth]
            if name in ends or name == "p" and tag in html_extract.CLOSES_P:
                found = depth
                if tag not in html_extract.ENDS or name != "p":
                    break
            elif name in within or name in html_extract.BLOCKS and tag not in html_extract.ENDS:
                break
    return found


def test_open_elements_against_walks():
    r = random.Random(7)
    names = ["p", "li", "ul", "b", "i", "a", "div", "td", "tr", "table", "button", "dd", "dl", "h2", "span", "form"]
    for _ in range(300):
        tags, stack = html_extract._Open(), ["html"]
        for _ in range(60):
            tag = r.choice(names)
            if r.random() < 0.7:
                assert tags.ended_by(tag) == walked(stack, tag)
                tags.push(tag, 0, True, False)
                stack.append(tag)
            elif len(stack) > 1:
                depth = r.randrange(1, len(stack))
                assert tags.cut(depth) == any(x in html_extract.BLOCKS for x in stack[depth:])
                del stack[depth:]
            assert [x[0] for x in tags.stack] == stack
            assert tags.innermost(names) == len(stack) - 1 and all(tags.innermost((n,)) == max((i for i, x in enumerate(stack) if x == n), default=0) for n in names)
            assert tags.blocks == [i for i, x in enumerate(stack) if x in html_extract.BLOCKS and i] and tags.walls == [i for i in tags.blocks if stack[i] not in html_extract.OPEN]


def test_subtrees_against_walks():
    r = np.random.default_rng(8)
    for _ in range(50):
        path, parent = [0], [0]
        for i in range(1, 40):  # in page order: a new element's parent is open
            del path[int(r.integers(1, len(path) + 1)) :]
            parent.append(path[-1])
            path.append(i)
        want = np.zeros(40, int)
        for i in range(40):
            while True:
                want[i] += 1
                if parent[i] == i:
                    break
                i = parent[i]
        assert html_extract._subtrees(parent).tolist() == want.tolist()
