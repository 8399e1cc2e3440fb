"""Texts whose sets of five-word shingles have a Jaccard similarity of `ALIKE` or more.

These links come beside those of SimHash fingerprints (see simhash.keep_one). A fingerprint of 64 bits is no key for them: at a
similarity of 0.8 about ten bits differ, so an exact cut into segments would leave some four bits to each. Candidates are texts that share one of `BANDS` keys of `ROWS` minima each; a
pair of similarity 0.8 has none in common with a probability of 1e-7. Each candidate is verified by its exact similarity.

Equal sets are one node. Of a key that few nodes share all pairs are compared. Of the keys that many share, each node meets
the least of their first nodes; then the first node of each key from which it's still apart. Nodes that are apart even then
are compared with those that share one of their rarest shingles: sets that are alike do, and a passage that many texts have
in common is not rare. So no pair is lost, and none is made of texts that only share a passage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, slices, texts_of, written
from .components import components

SHINGLE = 5
#: Similarity as a fraction.
ALIKE = (4, 5)
BANDS, ROWS = 40, 5
FEW = 32
MAX_WORDS = 200_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PIECE = 1 << 10
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_FACTORS = np.random.default_rng(42).integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False) | np.uint64(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MAX_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


_words = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: str) -> np.ndarray:
    """The set of hashed shingles, ascending; a text of fewer words is one shingle, one without a word has none."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mixed(out) * _STEP + hashes[i : len(words) - width + 1 + i]
    return np.unique(_mixed(out))


def node_of(grams: np.ndarray) -> int:
    """Equal for equal sets; 0 for the empty one."""
    return int(_mixed(grams).sum(dtype=np.uint64).view(np.int64)) if len(grams) else 0


def keys_of(grams: np.ndarray) -> np.ndarray:
    """A key for each band, from the minima of its rows."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), _PIECE):
        np.minimum(least, np.multiply.outer(_FACTORS, grams[i : i + _PIECE]).min(1), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = _mixed(out) * _STEP + row
    return _mixed(out).view(np.int64)


def nodes(df: DataFrame, print_of: Callable[[str], int]) -> DataFrame:
    """id, fp (the node), n (shingles), keys and print (what print_of gives for the text) of each row of df (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part)
                sets = [shingles(t) for t in texts]
                keys = [keys_of(s) if len(s) else [] for s in sets]
                arrays = [part.column(0), pa.array(map(node_of, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array([print_of(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "fp", "n", "keys", "print"])

    rows = df.select("id", "text")
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, fp long, n long, keys array<long>, print long")


def _sets(df: DataFrame) -> DataFrame:
    """fp and grams (the set) of each row of df (fp, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                grams = pa.array([shingles(t).view(np.int64) for t in texts_of(part)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), grams], ["fp", "grams"])

    return map_arrow(df.select("fp", "text"), run, "fp long, grams array<long>")


def _may(a: Column, b: Column) -> Column:
    """Whether different sets of these sizes can be alike: the smaller may lie within the larger, of equal ones each must have a shingle of its own."""
    less, more = F.least(a, b), F.greatest(a, b)
    return F.when(a == b, (a - 1) * ALIKE[1] >= (a + 1) * ALIKE[0]).otherwise(less * ALIKE[1] >= more * ALIKE[0])


def roots(prints: DataFrame, texts_at: Callable[[DataFrame], DataFrame], linked: DataFrame | None = None) -> DataFrame | None:
    """node and root of each node that is alike to another or linked to one, as components() gives them.

    prints: fp, n and keys of each node, once; texts_at: fp and text of each node of a table of them; linked: nodes a and b of links known before.
    """
    keys = prints.select("fp", F.col("n").alias("size"), F.explode("keys").alias("key"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("fp", "size")).alias("first")).where("n > 1")
    sizes = written(sizes, "sizes")  # an exchange of its own, so that the join below can split a hot key
    shared = written(keys.join(sizes, "key"), "keys")
    sets = written(_sets(texts_at(shared.select("fp").distinct())), "sets")  # texts move once, whatever is compared below
    few = shared.where(F.col("n") <= FEW).groupBy("key").agg(F.collect_list(F.struct("fp", "size")).alias("all"))
    few = few.select("all", F.explode("all").alias("x"))
    few = few.select(F.col("x.fp").alias("a"), F.explode(F.filter("all", lambda y: (y["fp"] > F.col("x.fp")) & _may(y["size"], F.col("x.size")))["fp"]).alias("b"))
    hot = shared.where(F.col("n") > FEW).select("key", "fp", "size", F.col("first.fp").alias("first"), F.col("first.size").alias("first_size"))
    meets = (F.col("fp") != F.col("first")) & _may(F.col("size"), F.col("first_size"))
    # Nodes of one cluster share many keys, so one first node for each will do for most.
    many = hot.where(meets).groupBy("fp").agg(F.min("first").alias("a")).select("a", F.col("fp").alias("b"))
    pairs = written(few.unionAll(many).distinct(), "pairs")
    edges = _alike(pairs, sets)
    if linked is not None:
        edges = edges.unionAll(linked)
    found = components(edges)
    if hot.isEmpty():
        return found

    def apart(found: DataFrame | None) -> DataFrame:
        """The rows of hot keys, with the roots of both nodes."""
        if found is None:
            return hot.withColumns({"root": F.col("fp"), "first_root": F.col("first")})
        of = found.select(F.col("node").alias("fp"), "root")
        rows = hot.join(of, "fp", "left").join(of.select(F.col("fp").alias("first"), F.col("root").alias("first_root")), "first", "left")
        return rows.withColumns({"root": F.coalesce("root", "fp"), "first_root": F.coalesce("first_root", "first")})

    rest = apart(found).where(meets & (F.col("root") != F.col("first_root"))).select(F.col("first").alias("a"), F.col("fp").alias("b")).distinct()
    rest = written(rest.join(pairs, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        pairs, edges = pairs.unionAll(rest), edges.unionAll(_alike(rest, sets))
        found = components(edges)
    rows = written(apart(found), "hot")
    asking = rows.where("root <> first_root")
    if asking.isEmpty():
        return found
    nodes_of = lambda of: of.select("fp", "size", "root").distinct()
    prefixes = written(_prefixes(sets.join(rows.join(asking.select("key").distinct(), "key", "left_semi").select("fp").distinct(), "fp", "left_semi")), "prefixes")
    one = prefixes.join(nodes_of(asking), "fp")
    other = prefixes.join(nodes_of(rows), "fp").select("gram", F.col("fp").alias("b"), F.col("size").alias("b_size"), F.col("root").alias("b_root"))
    met = one.join(other, "gram").where((F.col("root") != F.col("b_root")) & _may(F.col("size"), F.col("b_size")))
    met = met.select(F.least("fp", "b").alias("a"), F.greatest("fp", "b").alias("b")).distinct()
    met = written(met.join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "met")
    if met.isEmpty():
        return found
    return components(edges.unionAll(_alike(met, sets)))


def _prefixes(sets: DataFrame) -> DataFrame:
    """fp and gram: of each set the rarest shingles, in an order that is the same for all, so many that sets which are alike have one of them in common."""
    grams = sets.select("fp", F.explode("grams").alias("gram"))
    ranked = grams.join(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("rank")), "gram")
    ranked = ranked.groupBy("fp").agg(F.sort_array(F.collect_list(F.struct("rank", "gram"))).alias("all"))
    n = F.size("all")
    least = n - F.ceil(n * ALIKE[0] / ALIKE[1]).cast("int") + 1
    return ranked.select("fp", F.explode(F.slice("all", F.lit(1), least)).alias("x")).select("fp", F.col("x.gram").alias("gram"))


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose exact similarity is ALIKE or more. sets: fp and grams."""
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("grams").alias("of_a")), "a").join(sets.select(F.col("fp").alias("b"), F.col("grams").alias("of_b")), "b")
    common, sizes = F.size(F.array_intersect("of_a", "of_b")), F.size("of_a") + F.size("of_b")
    return written(both.where(common * sum(ALIKE) >= sizes * ALIKE[0]).select("a", "b"), "alike")
