"""Crawling a site, best pages first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..reports import log
from ..sources.pages import Fetcher, fetcher_of
from .links import extract_links
from .weighted import WeightedQueue

#: Urls of the queue whose pages are fetched together.
AHEAD = 256


def crawl(seed: str, pages: DataFrame | Fetcher, keywords: Sequence[str], most: int, topic_sensitive: bool = True, prefixes: Sequence[str] = (), keep_self: bool = True, spark: SparkSession | None = None) -> tuple[DataFrame, DataFrame]:
    """Visited pages (url, seq) and the edges between them (src, dst, seq), from a fetcher or a table of pages (url, html).

    At most `most` pages are visited, in order of the weight of the links to them; without topic_sensitive in order of
    discovery. Urls that begin with one of the prefixes (of a robots.txt) are not visited. Pages are fetched, and their
    links extracted, for the front of the queue at a time; the queue, bounded by what `most` pages link to, is the driver's.
    """
    spark = spark or SparkSession.active()
    fetcher, barred = fetcher_of(pages), tuple(prefixes)
    known: dict[str, list[tuple[str, float]]] = {}

    def fetch(urls: list[str]) -> None:
        known.update((u, []) for u in urls)
        found = extract_links(fetcher.fetch(spark.createDataFrame([(u,) for u in urls], "url string")), keywords, topic_sensitive, drop_self=not keep_self)
        for r in sorted(found.collect(), key=lambda r: (-r["weight"], r["seq"])):  # the links of AHEAD pages
            known[r["url"]].append((r["href"], r["weight"]))
        log.info("Crawl: fetched %d pages", len(urls))

    queue, visited, edges = WeightedQueue(), {}, []
    queue.add(seed)
    while len(queue) and len(visited) < most:
        url, _ = queue.extract()
        if url in visited or url.startswith(barred):
            continue
        visited[url] = len(visited)
        if url not in known:
            fetch([url, *[u for u, _ in queue.items() if u not in known and not u.startswith(barred)][: AHEAD - 1]])
        for href, weight in known[url]:
            edges.append((url, href, len(edges)))
            queue.add(href, weight)
    log.info("Crawl: visited %d pages, %d are left in the queue", len(visited), len(queue))
    seen = spark.createDataFrame([(u, i) for u, i in visited.items()], "url string, seq long")
    kept = spark.createDataFrame([e for e in edges if e[1] in visited], "src string, dst string, seq long")
    return seen, kept
