"""Results as text, in fixed formats."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger("sketchgraph")


class StopWatch:
    """Adds up the time between start and pause."""

    def __init__(self) -> None:
        self.total, self.since = 0.0, None

    def start(self) -> None:
        self.since = self.since or time.perf_counter()

    def pause(self) -> None:
        if self.since is not None:
            self.total, self.since = self.total + time.perf_counter() - self.since, None

    @property
    def nanoseconds(self) -> int:
        return int((self.total + (time.perf_counter() - self.since if self.since else 0)) * 1e9)

    @contextmanager
    def running(self):
        self.start()
        try:
            yield self
        finally:
            self.pause()


def timed(action: Callable[[], object]) -> tuple[object, float]:
    watch = StopWatch()
    with watch.running():
        out = action()
    return out, watch.total


def times(construction: float, exact: float, estimated: float) -> str:
    return "\n".join(f"{name}: {value:.3f} s" for name, value in (("Signatures", construction), ("Exact similarities", exact), ("Estimated similarities", estimated)))


def access_lines(counts: DataFrame) -> DataFrame:
    """report: a line for each method of overlay.access_counts."""
    return counts.select(F.format_string("%s: %d file accesses, %d lines read", "method", "accesses", "lines").alias("report"))


def saved_line(saved: DataFrame) -> DataFrame:
    return saved.select(F.format_string("Saved by the filter: %.2f %% of accesses, %.2f %% of lines", "accesses_saved", "lines_saved").alias("report"))


def false_positive_lines(rates: DataFrame) -> DataFrame:
    return rates.select(F.format_string("%s: %.4f %% measured, %.4f %% expected", "kind", "measured", "theoretical").alias("report"))


def matrix_text(cells: DataFrame, columns: int) -> DataFrame:
    """row and line of a small matrix (row, col, value) with five digits."""
    found = cells.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.col("col").cast("int").alias("col"), "value"))).alias("m"))
    return found.select("row", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: F.format_string("%.5f", F.coalesce(F.try_element_at("m", c), F.lit(0.0)))), " ").alias("line"))


def term_table(tf: DataFrame, docs: list[str], width: int = 12) -> DataFrame:
    """A line for each term with its count in each of a few documents."""
    wide = tf.groupBy("term").pivot("doc", docs).agg(F.first("tf"))
    return wide.select(F.concat(F.rpad("term", width, " "), *[F.lpad(F.coalesce(F.col(f"`{d}`"), F.lit(0)).cast("string"), width, " ") for d in docs]).alias("line"))


def signature_table(sigs: DataFrame, width: int = 12) -> DataFrame:
    return sigs.select(F.concat(F.rpad(F.col("doc").cast("string"), width, " "), F.array_join(F.transform("signature", lambda x: F.lpad(x.cast("string"), width, " ")), "")).alias("line"))


SCORE_HEADER = f"{'Document':<40}{'TP score':>12}{'VS score':>12}{'Relevance':>12}"


def score_line() -> Column:
    """A row of search scores as text under SCORE_HEADER."""
    return F.format_string("%-40s%12.5f%12.5f%12.5f", F.col("doc").cast("string"), F.col("tp"), F.col("vs").cast("double"), F.col("relevance"))
