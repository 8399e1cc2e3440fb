"""Search by TF-IDF cosine and ordered nearness of terms, over a positional index.

The index is five tables, made as they are asked for: documents, postings by occurrence (doc, term, pos), counts (doc,
term, tf), document frequencies and norms. All queries are scored in one job: the positions of their few terms are put side by side for
each document, and one search in them finds the distances of neighbouring terms. Documents without a hit still score, as distances are
capped; they get the score of no hit without being looked at term by term.
"""

from __future__ import annotations

import re
import time
from collections.abc import Sequence
from functools import cached_property, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import written
from ..functions.text import words
from ..reports import log, timed
from ..shipping import ship
from .terms import counted, placed

TABLES = ("docs", "postings", "counts", "frequencies", "norms")

# Fixed values of the scores.
FARTHEST, NEARNESS, COSINE = 17, 0.6, 0.4
_WORD = re.compile(r"[^\W_]+")


def query_terms(query: str) -> list[str]:
    """Words of a query in order, repeats included; as the index cuts documents."""
    return _WORD.findall(query.lower())


class PositionalIndex:
    """docs (doc), postings (doc, term, pos), counts (doc, term, tf), frequencies (term, df), norms (doc, norm) and n, the number of documents.

    Each table is made when it is first asked for; counts and frequencies, which others are made from, are written then.
    `save` writes all of them, and `open` takes them from there, so that searches share one index.
    """

    def __init__(self, rows: DataFrame | None = None, tables: dict[str, DataFrame] | None = None):
        self._rows, self._tables = rows, tables or {}

    @classmethod
    def build(cls, corpus: DataFrame, doc_col: str = "doc", text_col: str = "text") -> PositionalIndex:
        """The index of distinct documents."""
        return cls(corpus.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PositionalIndex:
        return cls(tables={name: spark.read.parquet(f"{path}/{name}") for name in TABLES})

    def save(self, path: str) -> PositionalIndex:
        """Writes all tables below path and gives the index that reads them."""
        for name in TABLES:
            _, seconds = timed(lambda name=name: getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}"))
            log.info("Index: wrote %s in %.3f s", name, seconds)
        return self.open(self.docs.sparkSession, path)

    def _table(self, name: str, make, store: bool = False) -> DataFrame:
        if name not in self._tables:
            began = time.perf_counter()
            self._tables[name] = written(make(), name) if store else make()
            if store:
                log.info("Index: made %s in %.3f s", name, time.perf_counter() - began)
        return self._tables[name]

    @property
    def docs(self) -> DataFrame:
        return self._table("docs", lambda: self._rows.select("doc").distinct())

    @property
    def postings(self) -> DataFrame:
        return self._table("postings", lambda: self._rows.select("doc", F.posexplode(words(F.col("text"))).alias("pos", "term")))

    @property
    def counts(self) -> DataFrame:
        return self._table("counts", lambda: counted(self._rows, words(F.col("text"))), store=True)

    def _places(self, only: Sequence[str] | None = None) -> DataFrame:
        """doc, term and at (its positions, ascending); only: of these terms alone."""
        if self._rows is not None:
            return placed(self._rows, words(F.col("text")), only=only)
        rows = self.postings if only is None else self.postings.where(F.col("term").isin(*only))
        return rows.groupBy("doc", "term").agg(F.array_sort(F.collect_list("pos")).alias("at"))

    @property
    def frequencies(self) -> DataFrame:
        return self._table("frequencies", lambda: self.counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), store=True)

    @property
    def norms(self) -> DataFrame:
        weights = lambda: self.counts.join(self.frequencies, "term").select("doc", weight(self.n).alias("w"))
        return self._table("norms", lambda: weights().groupBy("doc").agg(F.sqrt(F.sum(F.col("w").cast("double") * F.col("w"))).alias("norm")))

    @cached_property
    def n(self) -> int:
        return self.docs.count()

    def term_frequency(self) -> DataFrame:
        return self.counts

    def weights(self) -> DataFrame:
        """doc, term and weight (float)."""
        return self.counts.join(self.frequencies, "term").select("doc", "term", weight(self.n).alias("weight"))

    def entries(self) -> DataFrame:
        """term, doc and entry: `<doc:p1,p2>` with positions ascending. The whole index, a row for each document of a term."""
        entry = F.concat(F.lit("<"), F.col("doc").cast("string"), F.lit(":"), F.array_join(F.transform("at", lambda p: p.cast("string")), ","), F.lit(">"))
        return self._places().select("term", "doc", entry.alias("entry"))

    def postings_lists(self, terms: Sequence[str]) -> DataFrame:
        """term and list: `[<doc:p1,p2>,<doc2:...>]` of a few terms, documents ascending. A row holds all documents of its term: a printed form, for terms that are not in most documents."""
        lists = self.entries().where(F.col("term").isin(*terms)).groupBy("term").agg(F.array_sort(F.collect_list(F.struct("doc", F.col("entry").alias("e")))).alias("all"))
        return lists.select("term", F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["e"]), ","), F.lit("]")).alias("list"))

    def scores(self, queries: Sequence[str]) -> DataFrame:
        """query (its number), doc, tp, vs (float) and relevance of every document for every query."""
        terms = [query_terms(q) for q in queries]
        if any(not t for t in terms):
            raise ValueError("a query without a term")
        distinct = [[*dict.fromkeys(t)] for t in terms]
        spark = self.docs.sparkSession
        wanted = spark.createDataFrame([(i, k, t, terms[i].count(t), len(d)) for i, d in enumerate(distinct) for k, t in enumerate(d)], "query int, place int, term string, qtf int, size int")
        ship(spark)
        at = lambda t: F.col("places")[t]
        found = self._places(sorted({t for d in distinct for t in d})).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("term", "at"))).alias("places"))
        pairs = {(a, b): f"gap{i}" for i, (a, b) in enumerate(dict.fromkeys(p for d in distinct for p in zip(d, d[1:])))}
        found = found.withColumns({c: first_gap(at(a), at(b)) for (a, b), c in pairs.items()})
        gap = lambda d, k: F.col(pairs[d[k], d[k + 1]]) if k + 1 < len(d) else F.lit(None).cast("int")
        each = [F.struct(F.lit(i).alias("query"), F.lit(k).alias("place"), F.lit(t).alias("term"), F.lit(len(d)).alias("size"), F.lit(terms[i].count(t)).alias("qtf"), gap(d, k).alias("gap"), F.size(at(t)).alias("tf")) for i, d in enumerate(distinct) for k, t in enumerate(d)]
        by_term = found.select("doc", F.explode(F.array(*each)).alias("e")).select("doc", "e.*").where("tf > 0")
        idf = self.frequencies.join(F.broadcast(wanted.select("term").distinct()), "term")
        by_term = by_term.join(F.broadcast(idf), "term")  # a row for each term of the queries
        w, q = weight(self.n).cast("double"), weight(self.n, "qtf").cast("double")
        missing = lambda found: FARTHEST * (F.col("size") - 1 - found)
        hit = by_term.groupBy("query", "doc", "size").agg(F.sum(w * q).alias("dot"), F.sum(F.when(F.col("place") < F.col("size") - 1, F.least(F.coalesce("gap", F.lit(FARTHEST)), F.lit(FARTHEST)))).alias("near"), F.count_if(F.col("place") < F.col("size") - 1).alias("found"))
        hit = hit.select("query", "doc", "dot", (F.coalesce("near", F.lit(0)) + missing(F.col("found"))).alias("distance"))
        query_norm = wanted.join(F.broadcast(idf), "term").groupBy("query").agg(F.sqrt(F.sum(q * q)).alias("qnorm"))
        sizes = F.array(*[F.struct(F.lit(i).alias("query"), F.lit(len(d)).alias("size")) for i, d in enumerate(distinct)])
        every = self.docs.select("doc", F.explode(sizes).alias("q")).select("q.query", "doc", "q.size")
        every = every.join(hit, ["query", "doc"], "left").join(self.norms, "doc", "left").join(F.broadcast(query_norm), "query", "left")
        distance = F.coalesce("distance", FARTHEST * (F.col("size") - 1))
        tp = F.when(F.col("size") == 1, F.lit(0.0)).otherwise(F.col("size") / distance)
        norms = F.coalesce(F.col("norm") * F.col("qnorm"), F.lit(0.0))
        vs = F.when(norms == 0, F.lit(0.0)).otherwise(F.coalesce("dot", F.lit(0.0)) / norms).cast("float")
        scored = every.select("query", "doc", tp.alias("tp"), vs.alias("vs"))
        return scored.withColumn("relevance", NEARNESS * F.col("tp") + COSINE * F.col("vs").cast("double"))

    def top_k(self, queries: Sequence[str], k: int) -> DataFrame:
        """The k documents of largest relevance of each query, ties by doc; with their place and scores."""
        order = Window.partitionBy("query").orderBy(F.desc("relevance"), "doc")
        return self.scores(queries).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def weight(n: int, tf: str = "tf") -> Column:
    """sqrt(tf) * log10(n / df), as a float."""
    return (F.sqrt(F.col(tf)) * F.log10(F.lit(float(n)) / F.col("df"))).cast("float")


@F.pandas_udf(T.IntegerType())
def first_gap(first: pd.Series, second: pd.Series) -> pd.Series:
    """Of two arrays of positions, ascending: the smallest step from one of the first to a later one of the second; null without such."""
    out = []
    for a, b in zip(first, second):
        steps = ()
        if a is not None and b is not None:
            later = np.searchsorted(b, a, side="right")
            steps = b[later[later < len(b)]] - a[later < len(b)]
        out.append(int(np.min(steps)) if len(steps) else None)
    return pd.Series(out, dtype="Int32")


def ordered_distance(first: Column, second: Column) -> Column:
    """Of two arrays of positions: the smallest step from one of the first to a later one of the second, at most FARTHEST."""
    steps = F.flatten(F.transform(first, lambda a: F.transform(F.filter(second, lambda b: b > a), lambda b: b - a)))
    return F.least(F.lit(FARTHEST), F.coalesce(F.array_min(steps), F.lit(FARTHEST)))


def nearness(lists: Sequence[Column]) -> Column:
    """n over the sum of the distances of neighbouring arrays; 0 for one."""
    if not lists:
        raise ValueError("no term")
    if len(lists) == 1:
        return F.lit(0.0)
    return F.lit(float(len(lists))) / reduce(lambda x, y: x + y, [ordered_distance(a, b) for a, b in zip(lists, lists[1:])])
