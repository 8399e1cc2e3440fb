"""Links of pages with weights by their nearness to keywords.

A page's text from its first `<p>` is cut into tokens by one pattern. Each page is read in one pass of an Arrow batch:
its tokens stay where the page is, and the work is linear in them (but for a search in its sorted keywords).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

# Fixed patterns and values of the tokenizer and of the weights; classes are those of ASCII, and a point is no line end.
BODY, TOKEN = re.compile(r"<p>", re.I | re.A), re.compile(r"<a\s+[^>]*>|</a>|[a-zA-Z0-9_-]+|<[^>]*>", re.I | re.A)
_POINT = "[^\\n\\r\\u0085\\u2028\\u2029]"
HREF = re.compile(rf'<a{_POINT}*href="([^"]*)"{_POINT}*>', re.I | re.A)
FARTHEST, SPACES = 17, tuple(" \t\n\x0b\f\r")


def body(html: str | None) -> str:
    """What follows the first `<p>`, itself included; empty without one."""
    m = BODY.search(html or "")
    return html[m.start() :] if m else ""


def accepted(href: str) -> bool:
    """No anchors, no colons (other sites, files), no double slash in front."""
    return "#" not in href and ":" not in href and not href.startswith("//")


def page_links(html: str | None, keywords: Sequence[str], topic_sensitive: bool = True) -> list[tuple[str, float, int]]:
    """href, weight and seq of the links of one page, as extract_links says."""
    wanted, events, spans, at, n = {*keywords}, [], [], [], 0
    for token in TOKEN.findall(body(html)):
        if token[0] != "<":
            if spans:
                spans[-1] = (spans[-1][0] if spans[-1][0] >= 0 else n, n)
            if token.lower() in wanted:
                at.append(n)
            n += 1
        elif token.lower() == "</a>":
            events.append(None)
            spans.append((-1, -1))
        elif token[:2].lower() == "<a" and token[2:3] in SPACES and (m := HREF.match(token)) and accepted(m[1]):
            events.append(m[1])
            spans.append((-1, -1))
    best: dict[str, tuple[float, int]] = {}
    for i, href in enumerate(events):
        if href is None or i + 1 == len(events) or events[i + 1] is not None:
            continue
        weight = 0.0
        if topic_sensitive:
            begin, end = spans[i]
            low = href.lower()
            place = bisect_left(at, begin)
            if place < len(at) and at[place] <= end or any(k in low for k in keywords):
                weight = 1.0
            else:
                near = [abs(e - at[j]) for e in (begin, end) for j in (bisect_left(at, e) - 1, bisect_left(at, e)) if 0 <= j < len(at)]
                weight = 1.0 / (min(near) + 2) if near and min(near) <= FARTHEST else 0.0
        if href not in best or weight > best[href][0]:
            best[href] = weight, i + 1
    return [(href, w, seq) for href, (w, seq) in best.items()]


def extract_links(pages: DataFrame, keywords: Sequence[str], topic_sensitive: bool = True, drop_self: bool = True) -> DataFrame:
    """url, href, weight and seq (order of the page) of each distinct link of a page; the largest weight counts.

    A link is an `<a>` whose next event is an `</a>`; other `<a>` without a usable href don't count. Weight: 0 if not
    topic_sensitive; 1 if a keyword stands in the link or its href contains one; else 1 / (d + 2) for the distance d in words
    from its begin or end to the nearest keyword, 0 beyond FARTHEST. A link without words lies at -1. Pages without `<p>`, and
    null ones, have no links.
    """
    low = [k.lower() for k in keywords]
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html")):
                if rows := page_links(html.as_py(), low, topic_sensitive):
                    hrefs, weights, seqs = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array([url] * len(rows), pa.string()), pa.array(hrefs, pa.string()), pa.array(weights, pa.float64()), pa.array(seqs, pa.int64())], ["url", "href", "weight", "seq"])

    out = pages.select("url", "html").mapInArrow(run, "url string, href string, weight double, seq long")
    return out.where(F.lower("href") != F.lower("url")) if drop_self else out
