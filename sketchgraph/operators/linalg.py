"""Sparse matrices as tables of row, col and value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two matrices. Cells that no pair of cells adds to are absent."""
    left = a.select("row", F.col("col").alias("k"), F.col("value").alias("x"))
    right = b.select(F.col("row").alias("k"), "col", F.col("value").alias("y"))
    return left.join(right, "k").groupBy("row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def multiply_vector(a: DataFrame, v: DataFrame) -> DataFrame:
    """row and value of a matrix times a vector (row, value)."""
    return a.join(v.select(F.col("row").alias("col"), F.col("value").alias("y")), "col").groupBy("row").agg(F.sum(F.col("value") * F.col("y")).alias("value"))


def check_shapes(columns_of_a: int, rows_of_b: int) -> None:
    if columns_of_a != rows_of_b:
        raise ValueError(f"a matrix of {columns_of_a} columns can't be multiplied by one of {rows_of_b} rows")


def from_arrays(rows: DataFrame, row_col: str, array_col: str) -> DataFrame:
    """row, col (from 0) and value of a table of arrays."""
    return rows.select(F.col(row_col).alias("row"), F.posexplode(array_col).alias("col", "value")).select("row", "col", F.col("value").cast("double").alias("value"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")
