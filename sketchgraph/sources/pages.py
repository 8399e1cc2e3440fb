"""Where pages come from: anything that gives url and html for a table of urls."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Fetcher(Protocol):
    def fetch(self, urls: DataFrame) -> DataFrame:
        """url and html of the distinct urls (column url), a row each; html is null where there is no such page."""


class TableFetcher:
    """Pages of a table with url and html; of several rows of a url the least html counts."""

    def __init__(self, pages: DataFrame):
        self.pages = pages.select("url", "html")

    def fetch(self, urls: DataFrame) -> DataFrame:
        asked = urls.select("url").distinct()
        found = self.pages.join(asked, "url", "left_semi").groupBy("url").agg(F.min("html").alias("html"))
        return asked.join(found, "url", "left")


class ConstantFetcher:
    """The same page for every url."""

    def __init__(self, html: str):
        self.html = html

    def fetch(self, urls: DataFrame) -> DataFrame:
        return urls.select("url").distinct().select("url", F.lit(self.html).alias("html"))


def fetcher_of(pages: DataFrame | Fetcher) -> Fetcher:
    return TableFetcher(pages) if isinstance(pages, DataFrame) else pages
