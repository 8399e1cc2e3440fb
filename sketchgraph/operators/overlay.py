"""Lookups in a base table that a differential table overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import PACKED, BloomSpec, appears, build, packed

#: Sizing of the filter over the differential's keys.
FILTER = (12_000_000, 16)
#: A filter has place for so many times its keys, if it is to let no other key through: with 16 bits each, one key in 10^23 gets through.
SPARSE = 64


def first_records(records: DataFrame, key_col: str = "phrase") -> DataFrame:
    """__key (lower case) and __record of the first line of each key. records have line_no and any other columns."""
    record = F.struct(*records.columns)
    rows = records.where(F.col(key_col).isNotNull())
    return rows.groupBy(F.lower(key_col).alias("__key")).agg(F.min_by(record, "line_no").alias("__record"))


def lookup(keys: DataFrame, base: DataFrame, diff: DataFrame, key_col: str = "key", record_key: str = "phrase") -> DataFrame:
    """Each row of keys with record: the differential's first one for the key, else the base's, else null. Case doesn't matter."""
    found = _located(keys, base, diff, key_col, record_key)
    return found.select(*keys.columns, F.coalesce("__diff", "__base").alias("record"))


def lookup_with_filter(keys: DataFrame, base: DataFrame, diff: DataFrame, spec: BloomSpec | None = None, key_col: str = "key", record_key: str = "phrase") -> DataFrame:
    """As lookup, with probed: whether a Bloom filter over the differential's keys let the key through to it. The records are the same."""
    spec = spec or BloomSpec(*FILTER)
    rows = _probed(keys, diff, spec, key_col, record_key, "probed")
    found = _located(rows, base, diff, key_col, record_key, F.col("probed"))
    return found.select(*keys.columns, F.coalesce("__diff", "__base").alias("record"), "probed")


def sparse(diff: DataFrame, least: int, bits: int) -> BloomSpec:
    """A filter for the keys of the differential that no other key gets through, of at least a size."""
    return BloomSpec(max(least, SPARSE * diff.count()), bits)


def _probed(keys: DataFrame, diff: DataFrame, spec: BloomSpec, key_col: str, record_key: str, out_col: str) -> DataFrame:
    """keys and whether a filter over the differential's keys lets each through. Small filters are packed; others are tables that the keys are joined to."""
    added = diff.where(F.col(record_key).isNotNull()).select(F.col(record_key).alias("__k"))
    if spec.size <= PACKED:
        return keys.withColumn(out_col, packed(added, spec, "__k")(F.col(key_col)))
    flags = appears(keys.select(F.lower(key_col).alias("__low")), build(added, spec, "__k"), spec, "__low", out_col)
    return keys.join(flags, F.lower(keys[key_col]) == F.col("__low"), "left").withColumn(out_col, F.coalesce(out_col, F.lit(False))).drop("__low")


def _located(keys: DataFrame, base: DataFrame, diff: DataFrame, key_col: str, record_key: str, through: Column | None = None) -> DataFrame:
    """keys with __diff and __base, their records. through: whether a key is looked up in the differential."""
    side = lambda rows, name: first_records(rows, record_key).select(F.col("__key").alias(f"{name}_key"), F.col("__record").alias(name))
    same = F.lower(keys[key_col]) == F.col("__diff_key")
    rows = keys.join(side(diff, "__diff"), same if through is None else same & through, "left")
    return rows.join(side(base, "__base"), F.lower(keys[key_col]) == F.col("__base_key"), "left")


def access_counts(keys: DataFrame, base: DataFrame, diff: DataFrame, spec: BloomSpec | None = None, key_col: str = "key", record_key: str = "phrase") -> DataFrame:
    """method, accesses (scans of a file) and lines (read until the first match) of looking up all rows of keys one by one.

    With spec there is a second row, `bloom`: keys that the filter holds back don't scan the differential, and building
    the filter costs one access and all of its lines.
    """
    found = _located(keys, base, diff, key_col, record_key)
    found = found.withColumns({"base_lines": F.lit(base.count()), "diff_lines": F.lit(diff.count())})
    in_diff, at = F.col("__diff").isNotNull(), lambda c: F.col(f"{c}.line_no")
    base_lines = F.coalesce(at("__base"), F.col("base_lines"))

    def counted(rows: DataFrame, method: str, scans_diff: Column, extra: Column, extra_lines: Column) -> DataFrame:
        accesses = F.when(scans_diff, 1).otherwise(0) + F.when(scans_diff & in_diff, 0).otherwise(1)
        lines = F.when(scans_diff, F.coalesce(at("__diff"), F.col("diff_lines"))).otherwise(0) + F.when(scans_diff & in_diff, 0).otherwise(base_lines)
        return rows.agg((F.coalesce(F.sum(accesses), F.lit(0)) + extra).cast("long").alias("accesses"), (F.coalesce(F.sum(lines), F.lit(0)) + F.coalesce(F.max(extra_lines), F.lit(0))).cast("long").alias("lines")).select(F.lit(method).alias("method"), "accesses", "lines")

    out = counted(found, "naive", F.lit(True), F.lit(0), F.lit(0))
    if spec is not None:
        probed = _probed(found, diff, spec, key_col, record_key, "__probed")
        out = out.unionAll(counted(probed, "bloom", F.col("__probed"), F.lit(1), F.col("diff_lines")))
    return out


def saved(counts: DataFrame) -> DataFrame:
    """Per cent of accesses and lines that `bloom` saves of `naive`."""
    of = lambda method, c: F.max(F.when(F.col("method") == method, F.col(c)))
    share = lambda c: (100.0 * (of("naive", c) - of("bloom", c)) / of("naive", c)).alias(f"{c}_saved")
    return counts.agg(share("accesses"), share("lines"))
