import random

import pytest
from pyspark.sql import functions as F

from sketchgraph.operators import blocks, minhash
from sketchgraph.plans import queries


@pytest.mark.parametrize("most", [1 << 16, 7])
def test_all_pairs_against_brute_force(spark, monkeypatch, most):
    """Of one block, and of many."""
    monkeypatch.setattr(blocks, "DOCS", most)
    r = random.Random(8)
    bags = {i: [r.choice(["apple", "pear", "plum", "fig", "date", f"own{i}"]) for _ in range(r.randint(0, 6))] for i in range(30)}
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in bags.items()] + [(None, "apple")], "doc int, text string")
    tf = minhash.term_frequencies(docs)
    want = {}
    for a, x in bags.items():
        for b, y in bags.items():
            both = sum(min(x.count(t), y.count(t)) for t in {*x})
            if both:
                want[a, b] = both / (len(x) + len(y) - both), len({*x} & {*y}) / len({*x} | {*y})
    got = {(r["doc_a"], r["doc_b"]): (r["multiset"], r["set"]) for r in minhash.similarities(tf, tf).collect()}
    assert got == want
    apart = minhash.similarities(tf.where("doc % 3 = 0"), tf)
    assert {(r["doc_a"], r["doc_b"]): (r["multiset"], r["set"]) for r in apart.collect()} == {k: v for k, v in want.items() if k[0] % 3 == 0}
    assert "Join" not in minhash.similarities(tf, tf)._jdf.queryExecution().toString()
    k, eps = 8, 0.1
    sigs = minhash.signatures(tf, minhash.permutation_params(k, 10_007, 1), 10_007, docs)
    of = {r["doc"]: r["signature"] for r in sigs.collect()}
    estimate = {(a, b): sum(x == y for x, y in zip(of[a], of[b])) / k for a in bags for b in bags if a != b}
    assert {(r["doc_a"], r["doc_b"]): r["estimate"] for r in minhash.estimates(sigs, sigs, k).collect()} == {p: e for p, e in estimate.items() if e}
    off = {p for p, e in estimate.items() if abs(want.get(p, (0,))[0] - e) > eps}
    met = {p for p in want if p[0] != p[1]}
    assert tuple(minhash.accuracy_of_met(tf, sigs, k, eps).head()) == (len(met), len(met & off))
    assert tuple(minhash.accuracy_of_all(docs.where("doc is not null"), tf, sigs, k, eps).head()) == (30 * 29 // 2, len(off) // 2)


def test_exact_queries_take_all_documents(spark, sf):
    """Not only documents of ids divisible by 50 on one side."""
    assert queries.exact_jaccard(spark, sf).select("doc_a").distinct().count() > 150
    assert queries.minhash_accuracy(spark, sf).head()["pairs"] == queries.exact_jaccard(spark, sf).where(F.col("doc_a") != F.col("doc_b")).count()
