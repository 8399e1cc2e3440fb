"""Near duplicates by SimHash fingerprints, their candidates found by the pigeonring principle.

If two fingerprints differ in at most d bits and are cut into m segments on a ring, then from some segment on every
chain of l segments differs in at most l * d / m bits. For d = 2 and m = 5 the first two segments of that
chain are equal, which gives five keys of 25 or 26 bits; the chain's later budgets (1, 1, 2) then prune a key's
pairs before all bits are compared.

Equal fingerprints are one node, so copies cost nothing after the first aggregation. A key that few fingerprints
share has its pairs compared. In a key that many share, each fingerprint instead meets the others at the values one
flipped bit away: two fingerprints at most two bits apart share such a value, and at most one more fingerprint than
bits has a given value, so the work is linear in the key's size and no link is lost.

Inputs: null and empty texts, and texts without a word, have fingerprint zero and are linked like any other; null
ids are never the smallest unless all ids of a component are null; repeated ids and rows are rows of their own;
other columns are not read; an empty table gives an empty result; texts are hashed whole, in bounded pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near_copies
from ._common import fresh, map_arrow, slices, texts_of, written
from .components import components

SEED, SHINGLE, BITS = 42, 3, 64
DISTANCE, SEGMENTS = 2, 5
#: Fingerprints of a key up to which its pairs are compared; above, they meet at their neighbours. Either way is exact.
FEW = 32
SALTS = 32
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PIECE = 1 << 14


def fingerprint(text: str) -> int:
    """Bits set in over half the hashes of the text's word shingles."""
    words = text.encode().translate(_LOWER).split()  # bytes split at exactly space and 9 to 13
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - SHINGLE + 1)
    first = [0, *ends[: n - 1].tolist()]
    last = (ends[min(SHINGLE, len(words)) - 1 :] - 1).tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for i in range(0, n, _PIECE):
        hashes = np.fromiter([digest(line[a:b], SEED) for a, b in zip(first[i : i + _PIECE], last[i : i + _PIECE])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fp (bigint) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(t) for t in texts_of(part)], pa.int64())], ["id", "fp"])

    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, fp long").withColumnRenamed("id", id_col)


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def segment_masks(segments: int = SEGMENTS) -> list[int]:
    edges = [BITS * i // segments for i in range(segments + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def chain(start: int, distance: int = DISTANCE, segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """Mask and budget of the chains that begin at a segment, from one segment to all."""
    masks, mask, out = segment_masks(segments), 0, []
    for n in range(1, segments + 1):
        mask |= masks[(start + n - 1) % segments]
        out.append((mask, n * distance // segments))
    return out


def links(prints: DataFrame) -> DataFrame:
    """Pairs a, b of distinct fingerprints (column fp) that connect all that differ in up to DISTANCE bits; not every such pair, but no connection is lost."""
    chains = [chain(i) for i in range(SEGMENTS)]
    masks = [max(m for m, budget in c if budget == 0) for c in chains]
    key = F.explode(F.array(*[F.struct(F.lit(i).alias("ring"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)]))
    keys = prints.select("fp", key.alias("k")).select("k.ring", "k.key", "fp")
    sizes = keys.groupBy("ring", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = written(sizes, "sizes")  # an exchange of its own, so that the join below can split a hot key
    shared = written(keys.join(sizes, ["ring", "key"]), "keys")

    def within(a: Column, b: Column, ring: Column) -> Column:
        differ = a.bitwiseXOR(b)
        out = F.lit(False)
        for i, c in enumerate(chains):
            ok = F.lit(True)
            for mask, budget in c:
                if budget:
                    ok &= F.bit_count(differ.bitwiseAND(F.lit(_signed(mask)))) <= budget
            out = F.when(ring == i, ok).otherwise(out)
        return out

    few = shared.where(F.col("n") <= FEW).groupBy("ring", "key").agg(F.collect_list("fp").alias("fps"))
    few = few.select("ring", "fps", F.explode("fps").alias("a"))
    few = few.select("a", F.explode(F.filter("fps", lambda x: (x > F.col("a")) & within(x, F.col("a"), F.col("ring")))).alias("b"))

    free = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in range(BITS) if not m >> b & 1]) for m in masks])
    meet = shared.where(F.col("n") > FEW).select("ring", "key", "fp", F.explode(free[F.col("ring")]).alias("flip"))
    meet = meet.groupBy("ring", "key", F.col("fp").bitwiseXOR(F.col("flip")).alias("at")).agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    many = meet.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return few.unionAll(many)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fp (bigint), fingerprint (16 hex digits) and component_id (the smallest id reachable over links) of each row."""
    docs = written(fingerprints(df, id_col, text_col), "fingerprints")
    prints = written(docs.groupBy("fp").agg(F.min(id_col).alias("least")), "prints")
    of = _of_components(prints, components(links(prints)))
    return docs.join(of, "fp").select(id_col, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_print: bool = False) -> DataFrame:
    """df with one row of each group of texts that are alike by their five-word shingles (see near_copies) or, with by_print, linked by their fingerprints as in near_duplicates: the one of the smallest id (a null only if there is no other), then of the smallest hash of its text."""
    least = F.struct(F.col("id").isNull().alias("null"), "id", "row")
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text"), F.xxhash64(df[text_col]).alias("row"))
    texts, docs = docs, written(near_copies.nodes(docs.select(F.struct("id", "row").alias("id"), "text"), fingerprint if by_print else lambda text: 0).select("id.*", "fp", "n", "keys", "print"), "nodes")
    prints = written(docs.groupBy("fp").agg(F.min(least).alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys")), "prints")

    linked = _linked(docs.select("print", "fp").distinct()) if by_print else None

    def texts_at(ends: DataFrame) -> DataFrame:
        """fp and text of the row that stands for each node."""
        first = prints.join(ends, "fp", "left_semi").select("fp", F.col("least.id").alias("__id"), F.col("least.row").alias("__row"))
        return texts.join(first, F.col("id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__row"))).select("fp", "text").dropDuplicates(["fp"])

    best = _of_components(prints.select("fp", "least"), near_copies.roots(prints, texts_at, linked)).select("least").distinct()
    best = best.select(F.col("least.id").alias("__best_id"), F.col("least.row").alias("__best_row"))
    out = df.join(best, df[id_col].eqNullSafe(best["__best_id"]) & (F.xxhash64(df[text_col]) == best["__best_row"]), "left_semi")
    again = docs.groupBy("id", "row").count().where("count > 1").join(best, F.col("id").eqNullSafe(F.col("__best_id")) & (F.col("row") == F.col("__best_row")), "left_semi")
    if not again.isEmpty():  # rows that are equal in id and text: one of them
        row = fresh(df, "__row")
        out = out.withColumn(row, F.xxhash64(text_col)).dropDuplicates([id_col, row]).drop(row)
    return out


def _linked(of: DataFrame) -> DataFrame:
    """Nodes a and b whose fingerprints are equal or linked, from each fingerprint's (print) nodes (fp)."""
    of = written(of, "of")
    first = written(of.groupBy("print").agg(F.min("fp").alias("node")), "first")
    end = lambda a, x: first.select(F.col("print").alias(a), F.col("node").alias(x))
    met = links(first.select(F.col("print").alias("fp"))).join(end("a", "x"), "a").join(end("b", "y"), "b").select("x", "y")
    return written(of.join(first, "print").select(F.col("node").alias("a"), F.col("fp").alias("b")).unionAll(met).where("a <> b"), "linked")


def _of_components(prints: DataFrame, roots: DataFrame | None) -> DataFrame:
    """fp and the least of its component, from fp and the least of its rows."""
    if roots is None:
        return prints
    member = prints.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    # A component may hold most of the linked fingerprints, so its rows are dealt over SALTS keys.
    member = member.withColumn("salt", F.when(F.col("root").isNotNull(), F.pmod(F.xxhash64("fp"), F.lit(SALTS))))
    least = member.where("root is not null").groupBy("root").agg(F.min("least").alias("least_of_all"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return member.join(least, ["root", "salt"], "left").select("fp", F.coalesce("least_of_all", "least").alias("least"))
