"""Rules of robots.txt for all agents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGENT, DISALLOW = r"(?i)^user-agent:\s*(.*)$", r"(?i)^disallow:\s*(.*)$"


def disallowed_prefixes(lines: DataFrame, standard: bool = False) -> DataFrame:
    """prefix: what `Disallow` lines give while the last `User-agent` is exactly `*`, in order of line_no. `Allow` doesn't count.

    An empty prefix disallows everything unless standard is set, which leaves it out.
    """
    agent = F.when(F.col("line").rlike(AGENT), F.regexp_extract("line", AGENT, 1) == "*")
    rows = lines.withColumn("__all", F.last(agent, True).over(Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))  # one small file
    rows = rows.where(F.col("__all") & F.col("line").rlike(DISALLOW)).select("line_no", F.regexp_extract("line", DISALLOW, 1).alias("prefix"))
    return (rows.where("prefix <> ''") if standard else rows).orderBy("line_no").select("prefix")


def rules_by_host(lines: DataFrame, standard: bool = False) -> DataFrame:
    """host and prefixes (array) of the rules of many files; lines: host, line_no and line. As disallowed_prefixes, for each host."""
    agent = F.when(F.col("line").rlike(AGENT), F.regexp_extract("line", AGENT, 1) == "*")
    rows = lines.withColumn("__all", F.last(agent, True).over(Window.partitionBy("host").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))  # a file is one host's
    rows = rows.where(F.col("__all") & F.col("line").rlike(DISALLOW)).select("host", F.regexp_extract("line", DISALLOW, 1).alias("prefix"))
    return (rows.where("prefix <> ''") if standard else rows).groupBy("host").agg(F.collect_set("prefix").alias("prefixes"))


def flag_disallowed(urls: DataFrame, rules: DataFrame, path_col: str = "path", host_col: str = "host", out_col: str = "disallowed") -> DataFrame:
    """urls with out_col: whether a rule of its host bars the path. Joined by host; hosts without rules bar nothing."""
    met = urls.join(rules.select(F.col("host").alias("__host"), "prefixes"), F.col(host_col) == F.col("__host"), "left")
    return met.select(*urls.columns, F.coalesce(F.exists("prefixes", lambda p: F.startswith(F.col(path_col), p)), F.lit(False)).alias(out_col))


def is_disallowed(url: Column, prefixes: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(url, p)) if prefixes else F.lit(False)
