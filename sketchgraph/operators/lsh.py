"""Locality-sensitive hashing of MinHash signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import java_array_hash
from .minhash import estimate


def band_count(k: int, threshold: float) -> int:
    """The divisor b of k, below k, whose curve (1/b) ** (1/r) comes nearest to the threshold; the first of equals, 1 if there is none."""
    best, out = float("inf"), 1
    for b in range(1, k):
        if k % b == 0 and (off := abs(threshold - (1 / b) ** (b / k))) < best:
            best, out = off, b
    return out


def buckets(sigs: DataFrame, k: int, bands: int, exact: bool = False) -> DataFrame:
    """doc, band and key of each band of the signatures. exact: the rows themselves are the key, not their 32-bit hash, which makes some false candidates."""
    if k % bands:
        raise ValueError(f"{bands} bands don't divide {k} values")
    r = k // bands
    part = F.slice("signature", F.col("band") * r + 1, F.lit(r))
    rows = sigs.select("doc", "signature", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    return rows.select("doc", "band", (F.array_join(part, ",") if exact else java_array_hash(part)).alias("key"))


def near_duplicates_of(queries: DataFrame, sigs: DataFrame, k: int, threshold: float, exact_keys: bool = False, min_similarity: float | None = None) -> DataFrame:
    """doc and near: for each row of queries (column doc) the documents that share a bucket with it, ascending.

    The candidates aren't held against the threshold, which only chooses the bands, unless min_similarity asks for an
    estimate of at least that.
    """
    all_buckets = buckets(sigs, k, band_count(k, threshold), exact_keys)
    mine = all_buckets.join(queries.select("doc").distinct(), "doc", "left_semi").select(F.col("doc").alias("query"), "band", "key")
    met = mine.join(all_buckets, ["band", "key"]).where("query <> doc").select("query", "doc").distinct()
    if min_similarity is not None:
        sig = lambda c: sigs.select(F.col("doc").alias(c), F.col("signature").alias(f"sig_{c}"))
        met = met.join(sig("query"), "query").join(sig("doc"), "doc").where(estimate(F.col("sig_query"), F.col("sig_doc")) >= min_similarity)
    lists = met.groupBy("query").agg(F.array_sort(F.collect_list("doc")).alias("near"))
    kind = lists.schema["near"].dataType.simpleString()
    return queries.select("doc").distinct().join(lists, F.col("doc") == F.col("query"), "left").select("doc", F.coalesce("near", F.array().cast(kind)).alias("near"))
