"""Queues of weighted items: as a table operation, and as a heap for driver loops."""

from __future__ import annotations

import heapq
from collections.abc import Hashable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def heaviest(items: DataFrame, item_col: str = "item", weight_col: str = "weight", seq_col: str = "seq", by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each item (within `by`): its largest weight and the first seq that had it. In queue order: weight descending, then seq."""
    return items.groupBy(*by, item_col).agg(F.max(F.struct(F.col(weight_col).alias("w"), (-F.col(seq_col)).alias("s"))).alias("best")).select(*by, item_col, F.col("best.w").alias(weight_col), (-F.col("best.s")).alias(seq_col))


def first(items: DataFrame, k: int, item_col: str = "item", weight_col: str = "weight", seq_col: str = "seq") -> DataFrame:
    """The k first rows in queue order, with their position; items of equal weight and seq by themselves."""
    order = [F.desc(weight_col), seq_col, item_col]
    return items.orderBy(*order).limit(k).withColumn("position", F.row_number().over(Window.orderBy(*order)))  # k rows


def positions(items: DataFrame, by: tuple[str, ...], item_col: str = "item", weight_col: str = "weight", seq_col: str = "seq") -> DataFrame:
    """items with position, from 1, in queue order within `by`; items of equal weight and seq by themselves."""
    return items.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(weight_col), seq_col, item_col)))


class WeightedQueue:
    """Unique items; the heaviest comes first, of equals the one that got its weight first."""

    def __init__(self) -> None:
        self.heap: list[tuple[float, int, Hashable]] = []
        self.best: dict[Hashable, tuple[float, int]] = {}
        self.seq = 0

    def add(self, item: Hashable, weight: float = 0.0) -> None:
        """An item that is here already is replaced if the new weight is larger."""
        if item in self.best and weight <= -self.best[item][0]:
            return
        self.seq += 1
        self.best[item] = (-weight, self.seq)
        heapq.heappush(self.heap, (-weight, self.seq, item))

    def extract(self) -> tuple[Hashable, float]:
        while self.heap:
            weight, seq, item = heapq.heappop(self.heap)
            if self.best.get(item) == (weight, seq):
                del self.best[item]
                return item, -weight
        raise IndexError("the queue is empty")

    def __len__(self) -> int:
        return len(self.best)

    def items(self) -> list[tuple[Hashable, float]]:
        return [(i, -w) for i, (w, _) in sorted(self.best.items(), key=lambda x: x[1])]
