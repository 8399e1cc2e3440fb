"""Quality of documents by boosted trees over statistics of their whole texts.

The statistics of all documents are computed once and written; a model is fitted on the driver to a bounded
sample of labelled ones (about `max_rows` at most, chosen by a hash of their id), flattened into arrays and broadcast; all
documents are then scored from their statistics.

Inputs: null and empty texts have statistics of zero and are scored like others; repeated ids are scored each on its
own; of several labels of an id the largest counts, null labels not at all; without usable labels the score is 0.5;
no column but the text is read for a score; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import gbdt
from ._common import map_arrow, slices, texts_of, written
from .token_counts import LETTER, NUMBER, OTHER, char_classes

#: Labelled rows that a fit takes at most.
MAX_ROWS = 20_000
THRESHOLD = 0.3
NAMES = (
    "log_chars log_words mean_word std_word longest_word letters digits others white ascii_share capital_letters capital_words kinds_of_words top_word"
    " repeated_neighbours line_count mean_line kinds_of_lines ended_lines words_with_others words_with_digits stops commas bars compressed entropy kinds_of_others"
).split()
_OTHERS_IN_WORD = re.compile(r"[^\w\s]+\w*[^\w\s]\S*|\w[^\w\s]{2,}(?=\s|$)")
_DIGIT = re.compile(r"\d")
_PIECE = 1 << 20


def statistics(text: str) -> list[float]:
    """The values of NAMES for a text."""
    n = len(text)
    if not n:
        return [0.0] * len(NAMES)
    words, lines = text.split(), text.split("\n")
    m = max(1, len(words))
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kinds = np.bincount(char_classes()[points], minlength=5) / n
    low = np.bincount(points[points < 128], minlength=128)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    counts, seen = Counter(words), {x for x in lines if x}
    chars = low[low > 0] / n
    packer, packed = zlib.compressobj(1), 0
    raw = text.encode()
    for i in range(0, len(raw), _PIECE):
        packed += len(packer.compress(raw[i : i + _PIECE]))
    packed += len(packer.flush())
    return [
        np.log1p(n),
        np.log1p(len(words)),
        sizes.mean(),
        sizes.std(),
        np.log1p(sizes.max()),
        kinds[LETTER],
        kinds[NUMBER],
        kinds[OTHER],
        kinds[3] + kinds[4],
        low.sum() / n,
        low[65:91].sum() / max(1, low[65:91].sum() + low[97:123].sum()),
        sum(map(str.isupper, words)) / m,
        len(counts) / m,
        max(counts.values(), default=0) / m,
        sum(map(str.__eq__, words, words[1:])) / m,
        np.log1p(len(lines)),
        n / len(lines),
        len(seen) / max(1, sum(1 for x in lines if x)),
        sum(x.endswith((".", "!", "?", ":", '"')) for x in lines) / len(lines),
        len(_OTHERS_IN_WORD.findall(text)) / m,
        sum(1 for w in counts if _DIGIT.search(w)) / max(1, len(counts)),
        (low[46] + low[33] + low[63]) / m,
        low[44] / m,
        (low[124] + low[123] + low[125] + low[60] + low[62] + low[92]) / m,
        packed / len(raw),
        float(-(chars * np.log2(chars)).sum()),
        float((low[33:48] > 0).sum() + (low[58:65] > 0).sum()),
    ]


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and stats, an array of the values of NAMES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                flat = np.array([statistics(t) for t in texts_of(part)]).ravel()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, len(NAMES)), pa.int32()), pa.array(flat))], ["id", "stats"])

    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, stats array<double>").withColumnRenamed("id", id_col)


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = MAX_ROWS) -> gbdt.Trees:
    """Trees for label_col (0 or 1) of the labelled rows of stats."""
    labels = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("double").alias("label"))
    labels = labels.withColumn("__order", F.xxhash64(F.col(id_col).cast("string")))
    if (n := labels.count()) > max_rows:  # each task then sends its share of the sample, and not max_rows rows
        labels = labels.where(F.pmod("__order", F.lit(1_000_000)) < min(1_000_000, int(1_000_000 * (1.1 * max_rows + 1000) / n) + 1))
    rows = stats.join(labels, id_col).orderBy("__order", "label").limit(max_rows).select("stats", "label").toArrow()
    x = rows.column("stats").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) if len(rows) else np.zeros((0, len(NAMES)))
    return gbdt.fit(x, rows.column("label").to_numpy())


def score(stats: DataFrame, model: gbdt.Trees, id_col: str = "doc_id") -> DataFrame:
    """id_col and score (0 to 1) of each row of stats."""
    ship(stats.sparkSession)
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], ["id", "score"])

    rows = stats.select(stats[id_col].alias("id"), "stats")
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def remainder(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo of."""
    return F.crc32(F.col(id_col).cast("string")) % of


def classify(df: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """id_col and score of each row of df, learnt from the labels where `learn` (over id_col) holds."""
    stats = written(document_statistics(df, id_col, text_col), "statistics")
    return score(stats, fit(stats, labels.where(learn), id_col, label_col, max_rows), id_col)
