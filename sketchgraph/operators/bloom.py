"""Bloom filters as tables of set bits.

A filter is a table of bit places, so it has no size limit; a probe explodes its places and joins. Spark
broadcasts the set bits while their size allows that and shuffles both sides beyond. Filters of up to PACKED bits can be
packed into bytes that all executors hold, which shuffles no probe.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import fnv_positions, linear_positions, murmur_positions, next_prime
from ..shipping import ship

KINDS = ("fnv", "murmur", "ran")
#: Share of false positives falls by this with each bit for an element.
RATE = 0.618
#: Bits of a filter that is handed out whole (32 MB), and of one of its pages.
PACKED, PAGE = 1 << 28, 1 << 19


@dataclass(frozen=True)
class BloomSpec:
    """Sizing of a filter. kind: how places are hashed; seed: of the random parameters of `ran`."""

    set_size: int
    bits: int
    kind: str = "murmur"
    seed: int = 0
    size: int = field(init=False)
    hashes: int = field(init=False)

    def __post_init__(self) -> None:
        if self.set_size <= 0 or self.bits <= 0:
            raise ValueError("set size and bits must be above 0")
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        object.__setattr__(self, "size", self.set_size * self.bits)
        object.__setattr__(self, "hashes", math.ceil(math.log(2) * self.size / self.set_size))

    @property
    def prime(self) -> int:
        return next_prime(self.size)

    @property
    def params(self) -> list[tuple[int, int]]:
        """(a, b) of each hash of `ran`: a from 1, b from 0, below the prime."""
        r = random.Random(self.seed)
        return [(r.randrange(1, self.prime), r.randrange(self.prime)) for _ in range(self.hashes)]

    def positions(self, key: Column) -> Column:
        """Places of a key, which is taken in lower case."""
        low = F.lower(key)
        if self.kind == "fnv":
            return fnv_positions(low, self.hashes, self.size)
        if self.kind == "murmur":
            return murmur_positions(low, self.hashes, self.size)
        return linear_positions(low, self.params, self.prime, self.size)


def build(keys: DataFrame, spec: BloomSpec, key_col: str = "key") -> DataFrame:
    """pos: the set bits after all keys. Null keys are an error."""
    ship(keys.sparkSession)
    key = F.when(F.col(key_col).isNull(), F.raise_error(F.lit("null can't be added"))).otherwise(F.col(key_col))
    return keys.select(F.explode(spec.positions(key)).alias("pos")).distinct()


def appears(probes: DataFrame, filter_bits: DataFrame, spec: BloomSpec, key_col: str = "key", out_col: str = "appears") -> DataFrame:
    """The distinct keys of probes and whether all their bits are set."""
    ship(probes.sparkSession)
    keys = probes.select(key_col).where(F.col(key_col).isNotNull()).distinct()
    places = keys.select(key_col, F.explode(F.array_distinct(spec.positions(F.col(key_col)))).alias("pos"))
    met = places.join(filter_bits.select("pos", F.lit(True).alias("__set")), "pos", "left")
    return met.groupBy(key_col).agg(F.every(F.coalesce("__set", F.lit(False))).alias(out_col))


def packed(keys: DataFrame, spec: BloomSpec, key_col: str = "key") -> Callable[[Column], Column]:
    """The filter after all keys, in bytes: gives the test of a key column. Null keys are an error, and don't appear. Each task packs its own keys' bits, so what moves is pages of bits."""
    if spec.size > PACKED:
        raise ValueError(f"a filter of {spec.size} bits isn't packed")
    spark, size = keys.sparkSession, spec.size
    ship(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(-(-size // PAGE) * PAGE // 8, np.uint8)
        for batch in batches:
            at = batch.column("pos").flatten().to_numpy()
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        pages = bits.reshape(-1, PAGE // 8)
        for i in np.flatnonzero(pages.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pages[i].tobytes()], pa.binary())], ["page", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        out = np.bitwise_or.reduce([np.frombuffer(b.as_py(), np.uint8) for b in table.column("bits")])
        return pa.table({"page": table.column("page")[:1].cast(pa.int32()), "bits": pa.array([out.tobytes()], pa.binary())})

    key = F.when(F.col(key_col).isNull(), F.raise_error(F.lit("null can't be added"))).otherwise(F.col(key_col))
    pages = keys.select(spec.positions(key).alias("pos")).mapInArrow(pack, "page int, bits binary").groupBy("page").applyInArrow(merge, "page int, bits binary")
    bits = np.zeros(-(-size // PAGE) * PAGE // 8, np.uint8)
    for page, part in pages.collect():  # no more than the filter
        bits[page * PAGE // 8 : (page + 1) * PAGE // 8] = np.frombuffer(part, np.uint8)
    held = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def holds(places: pd.Series) -> pd.Series:
        at = np.concatenate([*places]).reshape(len(places), -1) if len(places) else np.zeros((0, 1), np.int64)
        return pd.Series((held.value[at >> 3] >> (at & 7) & 1).all(axis=1))

    return lambda key: F.when(key.isNotNull(), holds(spec.positions(F.coalesce(key, F.lit(""))))).otherwise(False)


def metadata(keys: DataFrame, spec: BloomSpec) -> DataFrame:
    """data_size (keys added, repeats included), num_hashes and filter_size."""
    return keys.agg(F.count(F.lit(1)).alias("data_size")).withColumns({"num_hashes": F.lit(spec.hashes).cast("long"), "filter_size": F.lit(spec.size).cast("long")})


def printed(filter_bits: DataFrame, spec: BloomSpec) -> DataFrame:
    """bits: a string of X for set bits and O for others; for small filters."""
    bits = filter_bits.agg(F.collect_set("pos").alias("on"))
    return bits.select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(spec.size - 1)), lambda i: F.when(F.array_contains("on", i.cast("long")), "X").otherwise("O")), "").alias("bits"))


def random_keys(spark: SparkSession, n: int, name: str) -> DataFrame:
    """key: n texts in the shape of UUIDs, the same each time for a name."""
    digest = F.md5(F.concat_ws(" ", F.lit(name), F.col("id").cast("string")).cast("binary"))
    parts = [F.substring(digest, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return spark.range(n).select(F.concat_ws("-", *parts).alias("key"))


def false_positives(spark: SparkSession, set_size: int = 10_000, bits: int = 16, probes: int = 100_000, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """kind, probes, hits, measured and theoretical per cent of false positives."""
    inside, outside, rows = random_keys(spark, set_size, "in"), random_keys(spark, probes, "out"), None
    for kind in kinds:
        spec = BloomSpec(set_size, bits, kind)
        hits = appears(outside, build(inside, spec), spec).agg(F.count(F.lit(1)).alias("probes"), F.count_if("appears").alias("hits"))
        hits = hits.select(F.lit(kind).alias("kind"), "probes", "hits", (100.0 * F.col("hits") / F.col("probes")).alias("measured"), F.lit(100 * RATE**bits).alias("theoretical"))
        rows = hits if rows is None else rows.unionAll(hits)
    return rows
