"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..checkpoints import shared_path, written  # noqa: F401
from ..shipping import ship

#: Bytes of text that a Python worker handles at once; a longer single text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch, which stands in the JVM's and the worker's memory as a whole.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about `most` bytes in a string column, so that memory follows bytes and not rows."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow, with this package at hand on the executors, and batches of no more than BATCH_BYTES (a setting of the session) or one row."""
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH).rstrip("b")) > BATCH_BYTES:
        conf.set(_BATCH, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name
