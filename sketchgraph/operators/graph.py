"""Degrees and PageRank of directed graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import written
from ..reports import log


def clean(edges: DataFrame) -> DataFrame:
    """Distinct src, dst."""
    return edges.select("src", "dst").distinct()


def vertices(edges: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """id of each end of an edge, and of the rows of extra (column id), which may be without edges."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return (ids if extra is None else ids.unionAll(extra.select("id"))).distinct()


def degrees(edges: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """id, out_degree and in_degree by distinct neighbours, 0 included, in one aggregation."""
    return _degrees_of_distinct(clean(edges), extra)


def _degrees_of_distinct(once: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    ends = once.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    if extra is not None:
        ends = ends.unionAll(extra.select("id", F.lit(0), F.lit(0)))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def edge_count(edges: DataFrame) -> DataFrame:
    """edges: how many distinct edges there are."""
    return clean(edges).agg(F.count(F.lit(1)).alias("edges"))


def page_rank(edges: DataFrame, approximation: float = 0.01, damping: float = 0.85, iterations: int | None = None, extra: DataFrame | None = None, normalize: bool = False) -> DataFrame:
    """id, rank, out_degree and in_degree. Ranks begin at 1, so they sum to the number of vertices; normalize divides by it.

    Runs until the ranks change by no more than approximation in total, or for a fixed number of iterations. A
    vertex without outgoing edges gives its rank to all alike. Of a step only sums come to the driver; its ranks are
    written, which ends their lineage.
    """
    return page_ranks(edges, (approximation,), damping, iterations, extra, normalize)[approximation]


def page_ranks(edges: DataFrame, approximations: Sequence[float], damping: float = 0.85, iterations: int | None = None, extra: DataFrame | None = None, normalize: bool = False) -> dict[float, DataFrame]:
    """page_rank for several approximations, in one run that hands out its ranks as it reaches each."""
    once = written(clean(edges), "edges")
    state = written(_degrees_of_distinct(once, extra).select("*", F.lit(1.0).alias("rank"), F.lit(0.0).alias("before")), "ranks")

    def sums(of: DataFrame) -> tuple[int, float, float, float]:
        """Vertices, total rank, rank of vertices without outgoing edges, change: in one job."""
        dangling = F.sum(F.when(F.col("out_degree") == 0, F.col("rank")).otherwise(0.0))
        return of.agg(F.count(F.lit(1)), F.sum("rank"), dangling, F.sum(F.abs(F.col("rank") - F.col("before")))).head()

    def handed_out() -> DataFrame:
        rank = F.col("rank") / n if normalize else F.col("rank")
        return state.select("id", rank.alias("rank"), "out_degree", "in_degree")

    n, total, dangling, _ = sums(state)
    turn, out = 0, {}
    while n and len(out) < len(approximations) and (iterations is None or turn < iterations):
        shares = state.where("out_degree > 0").select(F.col("id").alias("src"), (F.col("rank") / F.col("out_degree")).alias("share"))
        given = once.join(shares, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("given"))
        rest = damping * dangling / n + (1 - damping) * total / n
        new = state.join(given, "id", "left").select("id", "out_degree", "in_degree", (damping * F.coalesce("given", F.lit(0.0)) + rest).alias("rank"), F.col("rank").alias("before"))
        state = written(new, "ranks")
        n, total, dangling, change = sums(state)
        turn += 1
        log.info("PageRank: step %d over %d vertices changed the ranks by %g", turn, n, change)
        if iterations is None:
            for a in approximations:
                if a not in out and change <= a:
                    log.info("PageRank: within %g after %d steps", a, turn)
                    out[a] = handed_out()
    return out | {a: handed_out() for a in approximations if a not in out}


def top_k(ranked: DataFrame, by: str, k: int, ascending: bool = False) -> DataFrame:
    """The k rows of largest `by` (smallest if ascending), ties by id; fewer if there are fewer."""
    return ranked.orderBy(F.asc(by) if ascending else F.desc(by), "id").limit(k)
