"""A crawl, its graph's rankings by three measures and five settings, and how alike these are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import written
from ..functions.vectors import jaccard
from ..operators import graph
from ..operators.crawl import crawl
from ..sources.pages import Fetcher

DAMPING, APPROXIMATIONS, TOP, DIGITS = 0.85, (0.01, 0.005, 0.001), 20, 8


def rankings(edges: DataFrame, k: int = TOP, approximations: Sequence[float] = APPROXIMATIONS, extra: DataFrame | None = None, damping: float = DAMPING) -> DataFrame:
    """list (A by out-degree, B by in-degree, C and on by PageRank for each approximation), place and id."""
    tops, by = [], ["out_degree", "in_degree"]
    for ranks in graph.page_ranks(edges, approximations, damping, extra=extra).values():
        if not tops:  # ranks come with the degrees of all vertices
            tops = [graph.top_k(ranks, "out_degree", k), graph.top_k(ranks, "in_degree", k)]
        # Sums of another order differ in the last digits; equal ranks are ties by id.
        tops.append(graph.top_k(ranks.withColumn("rank", F.round("rank", DIGITS)), "rank", k))
        by.append("rank")
    out = None
    for i, (rows, c) in enumerate(zip(tops, by)):
        rows = rows.select(F.lit(chr(ord("A") + i)).alias("list"), F.row_number().over(Window.orderBy(F.desc(c), "id")).alias("place"), "id")  # k rows
        out = rows if out is None else out.unionAll(rows)
    return written(out, "rankings")


def likeness(ranked: DataFrame) -> DataFrame:
    """list_a, list_b and jaccard of each two lists."""
    sets = ranked.groupBy("list").agg(F.collect_set("id").alias("ids"))
    all_lists = sets.agg(F.array_sort(F.collect_list(F.struct("list", "ids"))).alias("all"))  # a row for each list
    pair = all_lists.select("all", F.posexplode("all").alias("i", "a")).select("a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b"))
    return pair.select(F.col("a.list").alias("list_a"), F.col("b.list").alias("list_b"), jaccard(F.col("a.ids"), F.col("b.ids")).alias("jaccard"))


def crawl_and_rank(seed: str, pages: DataFrame | Fetcher, keywords: Sequence[str], most: int = 500, k: int = TOP, prefixes: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges of the crawl, rankings and their likeness. prefixes: what the site's robots.txt disallows."""
    _, edges = crawl(seed, pages, keywords, most, prefixes=prefixes)
    ranked = rankings(edges.select("src", "dst"), k)
    return edges, ranked, likeness(ranked)
