"""Dense vectors and sets as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def l1_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))


def subtract(a: Column, b: Column) -> Column:
    """Elementwise; an error if the lengths differ."""
    difference = F.zip_with(a, b, lambda x, y: x - y)
    return F.when(F.size(a) == F.size(b), difference).otherwise(F.raise_error(F.lit("vectors of different length")).cast("array<double>"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is 0; an error for empty vectors or different lengths."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), value).otherwise(F.raise_error(F.lit("vectors are empty or of different length")).cast("double"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; NaN if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(NAN)).otherwise(F.size(F.array_intersect(a, b)) / union)


def printed(v: Column, digits: int = 3) -> Column:
    """A vector as text with NaN and Infinity spelled out."""
    one = lambda x: F.when(F.isnan(x.cast("double")), "NaN").when(F.abs(x) == float("inf"), F.when(x > 0, "Infinity").otherwise("-Infinity")).otherwise(F.format_string(f"%.{digits}f", x.cast("double")))
    return F.concat(F.lit("["), F.array_join(F.transform(v, one), ", "), F.lit("]"))
