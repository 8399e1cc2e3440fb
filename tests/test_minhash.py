import math
import random

import pytest
from pyspark.sql import functions as F

from sketchgraph.functions import text, vectors
from sketchgraph.operators import lsh, minhash


def corpus(spark, texts):
    return spark.createDataFrame([*enumerate(texts)], "doc int, text string")


def test_default_terms(spark):
    got = corpus(spark, ["The quick, ... don't of THE.", None, ""]).select(text.terms(F.col("text"))).collect()
    assert [r[0] for r in got] == [["quick", "", "dont"], [], []]


def test_words(spark):
    assert corpus(spark, ["Été 12? a-b"]).select(text.words(F.col("text"))).head()[0] == ["été", "12", "a", "b"]


def java(s):
    h = 0
    for c in s:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def test_signatures_against_brute_force(spark):
    r = random.Random(5)
    docs = corpus(spark, [" ".join(r.choice(["apple", "pear", "plum", "quince", "fig", "date"]) for _ in range(r.randint(0, 9))) for _ in range(30)] + [None])
    params, prime = minhash.permutation_params(8, 101, 1), 101
    tf = minhash.term_frequencies(docs)
    got = {r["doc"]: r["signature"] for r in minhash.signatures(tf, params, prime, docs).collect()}
    for doc, t in docs.collect():
        terms = {x for x in (t or "").lower().split() if len(x) > 2}
        want = []
        for a, b in params:
            values = []
            for x in terms:
                v = (a * java(x) + b) & 0xFFFFFFFF
                v = v - (1 << 32) if v >> 31 else v
                values.append(int(math.fmod(v, prime)))
            want.append(min(values, default=minhash.EMPTY))
        assert got[doc] == want


def test_jaccard(spark):
    docs = corpus(spark, ["aaa aaa bbb", "aaa bbb ccc", "ddd", "", None])
    tf = minhash.term_frequencies(docs)
    assert [tuple(r) for r in minhash.multiset_jaccard(tf, tf, ordered=True).collect()] == [(0, 1, 0.5)]
    pairs = spark.createDataFrame([(0, 1), (0, 2), (3, 4)], "doc_a int, doc_b int")
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in minhash.set_jaccard(tf, tf, pairs=pairs).collect()}
    assert got[0, 1] == 2 / 3 and got[0, 2] == 0 and math.isnan(got[3, 4])
    assert [tuple(r["counts"]) for r in minhash.dense(tf, ["aaa", "bbb", "zzz"]).orderBy("doc").collect()] == [(2, 1, 0), (1, 1, 0), (0, 0, 0)]


def test_set_jaccard_of_arrays(spark):
    df = spark.createDataFrame([([1, 1, 2], [2, 3]), ([], [])], "a array<int>, b array<int>")
    got = [r[0] for r in df.select(vectors.jaccard(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1 / 3 and math.isnan(got[1])


def test_band_counts():
    assert [lsh.band_count(*x) for x in ((600, 0.85), (600, 0.4), (400, 0.5), (100, 0.8))] == [30, 120, 80, 10]
    assert lsh.band_count(1, 0.5) == 1


def test_lsh(spark):
    sigs = spark.createDataFrame([("a", [1, 2, 3, 4]), ("b", [1, 2, 9, 9]), ("c", [2, -29, 0, 0]), ("d", [7, 7, 7, 7])], "doc string, signature array<int>")
    assert lsh.band_count(4, 0.7) == 2
    near = {r["doc"]: r["near"] for r in lsh.near_duplicates_of(sigs, sigs, 4, 0.7).collect()}
    assert near == {"a": ["b", "c"], "b": ["a", "c"], "c": ["a", "b"], "d": []}  # c only by a collision of the 32-bit key
    exact = {r["doc"]: r["near"] for r in lsh.near_duplicates_of(sigs, sigs, 4, 0.7, exact_keys=True).collect()}
    assert exact == {"a": ["b"], "b": ["a"], "c": [], "d": []}
    verified = lsh.near_duplicates_of(sigs, sigs, 4, 0.7, min_similarity=0.6).where("doc = 'a'").head()["near"]
    assert verified == []
    with pytest.raises(ValueError):
        lsh.buckets(sigs, 4, 3)


def test_params():
    assert len({*minhash.permutation_params(20, 7, 2)}) == 20
    with pytest.raises(ValueError):
        minhash.permutation_params(10, 3)


def test_estimates(spark):
    sigs = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [1, 9, 3, 3]), (3, [5, 6, 7, 8])], "doc int, signature array<int>")
    assert {tuple(r) for r in minhash.estimates(sigs, sigs, 4).collect()} == {(1, 2, 0.5), (2, 1, 0.5)}
    side = lambda x: sigs.where(F.col("doc") == x).select(F.col("signature").alias(f"s{x}"), F.lit(1).alias("one"))
    assert side(1).join(side(2), "one").select(minhash.estimate(F.col("s1"), F.col("s2"))).head()[0] == 0.5


def test_accuracy(spark):
    docs = corpus(spark, ["aaa bbb ccc", "aaa bbb ccc", "ddd eee fff"])
    tf = minhash.term_frequencies(docs)
    prime = 10_007
    sigs = minhash.signatures(tf, minhash.permutation_params(16, prime), prime, docs)
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "doc_a int, doc_b int")
    assert tuple(minhash.accuracy(pairs, minhash.multiset_jaccard(tf, tf, ordered=True), sigs, 0.5).head()) == (3, 0)
